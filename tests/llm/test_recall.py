"""Copies and paraphrases of items of every length against the checks alone."""

import random

import numpy as np
import pytest
from tessera.llm import decontamination as D


@pytest.fixture(scope="module")
def planted(spark, make, words):
    """For each kept share (1 for copies of short items) pairs of document and item that the checks accept."""
    rng = random.Random(11)
    bench, rows, want = [], [], {}
    for k in range(240):
        share = (0.62, 0.7, 0.8, 1.0)[k % 4]
        n = 5 + k // 4 % 8 if share == 1 else 15 + k // 4 * 7 % 45
        item = words(n, 20_000 + k).split()
        bench.append((k, " ".join(item)))
        lost = rng.sample(range(n - 5), min(n - 5, int(round((1 - share) * n, 6))))
        leak = [f"{rng.choice(words(40, k).split())}x" if i in lost else w for i, w in enumerate(item)]
        around = words(120, 30_000 + k).split()
        at = rng.randrange(100)
        rows.append((k, " ".join(around[:at] + leak + around[at:])))
        own, region = (D._hash(" ".join(x)).tolist() for x in (item, leak))
        if D.lcs(own, region) >= D.PARAPHRASE * len(own):
            want[k] = share
    rows += [(1000 + i, words(150, 40_000 + i)) for i in range(300)]
    docs = make(rows)
    got = {(r.doc_id, r.item_id) for r in D.decontaminate(docs, spark.createDataFrame(bench, "item_id long, text string")).collect()}
    return got, want


@pytest.mark.parametrize("share", [0.62, 0.7, 0.8, 1.0])
def test_recall(planted, share):
    got, want = planted
    mine = [k for k, s in want.items() if s == share]
    found = sum((k, k) in got for k in mine)
    print(f"share {share}: {found} of {len(mine)}")
    assert len(mine) > 40 and found >= (1 if share == 1 else 0.9) * len(mine)


def test_windows():
    for n in range(1, 400):
        assert abs(D.window_of(n) - n) <= n / 8
    assert D.window_of(5) == 5 and np.all([D.window_of(n) % D.GRAIN == 0 for n in range(16, 400)])
