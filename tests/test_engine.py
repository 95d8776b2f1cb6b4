"""Every query against its SQL on the smallest tables."""

import os

import pytest
from tessera import catalog

DATA = os.environ.get("TESSERA_DATA", "/root/testdata/sf0.001")
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    return con


def norm(v):
    if isinstance(v, float):
        return round(v, 9)
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(norm(x) for x in r) for r in df.select(*(f"`{c}`" for c in columns)).collect()), key=repr)
    cur = duck.execute(SQL[name])
    place = [x[0] for x in cur.description]
    assert sorted(place) == columns
    want = sorted((tuple(norm(r[place.index(c)]) for c in columns) for r in cur.fetchall()), key=repr)
    assert got == want


def test_hull(spark):
    """Slopes fall strictly along each block's kept points, and no dropped point lies above the hull by more than a place of the log domain."""
    rows = QUERIES["hull_slopes"](spark, DATA).collect()
    blocks = {}
    for r in sorted(rows, key=lambda r: (r.cblk, r["pass"])):
        blocks.setdefault(r.cblk, []).append(r)
    for own in blocks.values():
        kept = [(0, 0), *((r.rate, r.saved) for r in own if r.slope > 0)]
        slopes = [(b[1] - a[1]) / (b[0] - a[0]) for a, b in zip(kept, kept[1:])]
        assert all(b < a for a, b in zip(slopes, slopes[1:]))
        for r in own:
            for a, b in zip(kept, kept[1:]):
                if a[0] <= r.rate <= b[0]:
                    assert r.saved <= a[1] + (b[1] - a[1]) / (b[0] - a[0]) * (r.rate - a[0]) + (2 ** (1 / 256) - 1) * (b[1] - a[1])


def test_hull_by_hand():
    """Points that cost nothing, that save nothing, and whose slopes share a place of the log domain."""
    from tessera.operators.rate import hull, to_log

    assert [to_log(x) for x in (1.0, 2.0, 0.5, 2.0**64, 2.0**70, 2.0**-300)] == [49152, 49408, 48896, 65535, 65535, 1]
    assert sorted(hull([10, 10, 30], [100, 200, 300])) == [1, 2]  # the second pass costs nothing, so the first goes
    assert sorted(hull([10, 20, 30], [100, 100, 150])) == [0, 2]  # the second saves nothing
    assert sorted(hull([10, 20, 30], [100, 90, 95])) == [0]  # the third is below the first
    assert sorted(hull([10, 20], [100, 300])) == [1] and sorted(hull([1000, 2000], [100_000, 199_999])) == [1]
    assert hull([], []) == {}


def test_budget(spark):
    from tessera.operators import rate
    from tessera.plans import rasters

    hull = rate.hull_slopes(rate.cumulate(rasters.passes(spark, DATA))).cache()
    whole = rate.make_layer(hull, 0.0).agg({"rate": "sum"}).first()[0]
    got = rate.threshold_for(hull, whole // 2).first()
    assert 0 < got.bytes <= whole // 2
    assert rate.threshold_for(hull, whole).first().bytes == whole


def test_lru_bytes(spark):
    trace = [1, 2, 3, 1, 4, 5, 1, 2]
    from tessera.operators.tiles import lru_bytes, lru_trace

    df = spark.createDataFrame([(0, i, t, 1) for i, t in enumerate(trace)], "cache long, step long, tile long, size long")
    want = [False, False, False, True, False, False, True, False]
    assert [r.hit for r in lru_bytes(df, 3).orderBy("step").collect()] == want
    assert [r.hit for r in lru_trace(df.drop("size"), 3).orderBy("step").collect()] == want
