"""Operators over whole tables, beyond the rows that the older queries read."""

import os
import random

import pytest
from tessera import catalog
from tessera.operators import tiles

DATA = os.environ.get("TESSERA_DATA", "/root/testdata/sf0.001")


def hits(trace, capacity):
    """By counting the distinct tiles since the last use."""
    out = {}
    for cache in {c for c, _, _ in trace}:
        own = sorted((s, t) for c, s, t in trace if c == cache)
        for i, (s, t) in enumerate(own):
            before = [j for j in range(i) if own[j][1] == t]
            out[cache, s] = bool(before) and len({x for _, x in own[before[-1] + 1 : i]}) < capacity
    return out


@pytest.mark.parametrize("capacity", [0, 1, 6, 40])
def test_lru_pieces(spark, monkeypatch, capacity):
    monkeypatch.setattr(tiles, "LRU_STEPS", 16)
    rng = random.Random(capacity)
    trace = [(c, s, rng.choice([rng.randrange(5), rng.randrange(60)])) for c in range(3) for s in range(1, 300) if s < 100 or s > 150]
    got = tiles.lru_trace(spark.createDataFrame(trace, "cache long, step long, tile long"), capacity).collect()
    assert len(got) == len(trace) and {(r.cache, r.step): r.hit for r in got} == hits(trace, capacity)


def test_lru_trace_is_not_quadratic(spark):
    """No join of accesses with the uses of their cache."""
    trace = spark.range(100).selectExpr("0L as cache", "id as step", "id % 9 as tile")
    assert "Join" not in tiles.lru_trace(trace, 6)._jdf.queryExecution().optimizedPlan().toString()


def test_whole_tables(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    rows, q = events.count(), catalog.queries()
    assert q["lru_trace"](spark, DATA).count() == rows
    assert q["pack_interleave"](spark, DATA).count() == rows
    assert q["pnm_roundtrip"](spark, DATA).count() == -(-rows // 128) * 128 * 3
    assert q["mj2_decompact"](spark, DATA).count() == events.selectExpr("sum(user_id % 4)").first()[0]
