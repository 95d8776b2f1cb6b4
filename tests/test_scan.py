import random

import pytest
from tessera.functions.scan import before, run_from


@pytest.mark.parametrize("levels", [0, 1, 2])
def test_running(spark, levels):
    rng = random.Random(levels)
    rows = sorted((n, rng.randrange(100)) for n in rng.sample(range(300), 80))
    df = spark.createDataFrame(rows, "n long, v long").repartition(3)
    got = {r.n: (r.s, r.m) for r in before(before(df, "n", "v", "s", block=4, levels=levels), "n", "v", "m", "max", block=4, levels=levels).collect()}
    for i, (n, _) in enumerate(rows):
        earlier = [v for _, v in rows[:i]]
        assert got[n] == (sum(earlier), max(earlier, default=None))


@pytest.mark.parametrize("n", [0, 1, 3, 4, 15, 16, 17, 40, 64, 70])
def test_run_from(spark, n):
    numbers = spark.createDataFrame([(i,) for i in [*range(n), *range(n + 1, n + 30)]], "k long")
    assert run_from(numbers, "k", 0, block=4) == n
