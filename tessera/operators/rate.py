"""Rate control: slopes on the convex hull, layers at thresholds, budgets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tessera.functions.workers import ship


def cumulate(passes: DataFrame) -> DataFrame:
    """Running rate and distortion saved over each block's passes."""
    w = W.partitionBy("cblk").orderBy("pass").rowsBetween(W.unboundedPreceding, 0)
    return passes.withColumn("rate", F.sum("len").over(w).cast("long")).withColumn("saved", F.sum("dist").over(w).cast("long"))


#: Fixed values of the log domain: 256 steps for each doubling of a slope, 2^64 as the steepest, and places 1 to 65535; 0 marks a point that is not feasible.
STEPS, STEEPEST, PLACES = 256, 2.0**64, 1 << 16
_SCALE = STEPS / math.log(2)


def to_log(slope: float) -> int:
    """A positive slope's place in the log domain."""
    return int(min(PLACES - 1, max(1.0, math.log(min(slope, STEEPEST)) * _SCALE - math.log(STEEPEST) * _SCALE + PLACES)))


def hull(rates: list[int], saved: list[int]) -> dict[int, tuple[float, int]]:
    """The feasible truncation points of one block, by index, with slope and place in the log domain.

    A point is feasible if distortion falls all the way from the feasible point before it, and if slopes fall strictly from point to point, in the log
    domain too; where they don't, the earlier point goes, and so does one that the current point reaches at no cost.
    """
    kept: list[int] = []
    found: dict[int, tuple[float, int]] = {}
    for i, (rate, total) in enumerate(zip(rates, saved, strict=True)):
        low = i  # the passes down to here were seen to save something
        while True:
            before = kept[-1] if kept else -1
            while low > before and total > (saved[low - 1] if low else 0):
                low -= 1
            if low > before:
                break
            dr, dd = rate - (rates[before] if kept else 0), total - (saved[before] if kept else 0)
            if kept and (dr == 0 or found[before][0] * dr <= dd):
                del found[kept.pop()]
                continue
            slope = dd / dr if dr else math.inf
            found[i] = slope, to_log(slope)
            if kept and found[i][1] >= found[before][1]:
                del found[kept.pop()]
            kept.append(i)
            break
    return found


def hull_slopes(passes: DataFrame) -> DataFrame:
    """rate, saved, slope and logslope of every pass, both 0 where it isn't on its block's hull. A block has at most some tens of passes by the format;
    blocks are read as a sorted stream, one in memory at a time."""
    names = ["cblk", "pass", "rate", "saved"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def close(columns: list[np.ndarray]) -> pa.RecordBatch:
            """Whole blocks, one after another."""
            slope, place = np.zeros(len(columns[0])), np.zeros(len(columns[0]), np.int64)
            edges = np.flatnonzero(np.diff(columns[0], prepend=columns[0][0] - 1))
            rates, saved = columns[2].tolist(), columns[3].tolist()
            for a, z in zip(edges.tolist(), [*edges[1:].tolist(), len(slope)], strict=True):
                for i, (x, at) in hull(rates[a:z], saved[a:z]).items():
                    slope[a + i], place[a + i] = x, at
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (*columns, slope, place)], names=[*names, "slope", "logslope"])

        for batch in batches:
            now = [batch.column(c).to_numpy() for c in names]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now, strict=True)]
            if not len(now[0]):
                continue
            cut = int(np.searchsorted(now[0], now[0][-1]))  # the last block may go on
            if cut:
                yield close([c[:cut] for c in now])
            held = [c[cut:] for c in now]
        if held is not None and len(held[0]):
            yield close(held)

    ship(passes.sparkSession)
    dealt = passes.select(*(F.col(c).cast("long").alias(c) for c in names)).repartition("cblk").sortWithinPartitions("cblk", "pass")
    return dealt.mapInArrow(run, "cblk long, pass long, rate long, saved long, slope double, logslope long")


def first_slopes(passes: DataFrame) -> DataFrame:
    """Slope of each pass against the one before: what is fed to thresholds where blocks' slopes already fall."""
    return passes.withColumn("slope", F.col("dist").cast("double") / F.col("len"))


def _included(passes: DataFrame, thresholds: list[int]) -> DataFrame:
    """cblk, and for each threshold b0, b1, ... the last pass (with its rate) before the first feasible one that is no steeper. One shuffle for all."""
    block = W.partitionBy("cblk")
    flat = [F.min(F.when((F.col("logslope") > 0) & (F.col("logslope") <= t), F.col("pass"))).over(block).alias(f"f{i}") for i, t in enumerate(thresholds)]
    seen = passes.where("logslope > 0").select("cblk", "pass", "rate", "logslope", *flat)
    best = [F.max(F.when((F.col("logslope") > t) & (F.col(f"f{i}").isNull() | (F.col("pass") < F.col(f"f{i}"))), F.struct("pass", "rate"))).alias(f"b{i}") for i, t in enumerate(thresholds)]
    return seen.groupBy("cblk").agg(*best)


def make_layer(passes: DataFrame, threshold: int) -> DataFrame:
    """What each block contributes at a threshold in the log domain: passes up to the first feasible one that is no steeper, and their bytes."""
    return _included(passes, [threshold]).where("b0 is not null").select("cblk", F.col("b0.pass").alias("last"), F.col("b0.rate").alias("rate"))


def whole_layer(passes: DataFrame) -> DataFrame:
    """The layer that drops nothing: each block's last pass and all its bytes."""
    return passes.groupBy("cblk").agg(F.max("pass").alias("last"), F.max("rate").alias("rate"))


def allocate_layers(passes: DataFrame, thresholds: list[int]) -> DataFrame:
    """Bytes of each layer over all blocks, for falling thresholds in the log domain and slopes that fall within a block."""
    blocks = _included(passes, thresholds)
    one = blocks.agg(*(F.coalesce(F.sum(f"b{i}.rate"), F.lit(0)).cast("long").alias(f"t{i}") for i in range(len(thresholds))))
    rows = F.array(*(F.struct(F.lit(i).alias("layer"), (F.col(f"t{i}") - (F.col(f"t{i - 1}") if i else F.lit(0))).cast("long").alias("bytes"), F.col(f"t{i}").alias("upto")) for i in range(len(thresholds))))
    return one.select(F.inline(rows))


def threshold_for(passes: DataFrame, budget: int) -> DataFrame:
    """The least threshold whose bytes fit the budget, and those bytes: bytes are summed for each of the 65,535 places, then from the steepest down
    (one pass over the data in place of a bisection)."""
    step = W.partitionBy("cblk").orderBy("pass")
    added = passes.where("logslope > 0").withColumn("add", F.col("rate") - F.coalesce(F.lag("rate").over(step), F.lit(0)))
    counted = added.groupBy("logslope").agg(F.sum("add").cast("long").alias("bytes"))  # 65,535 rows at most
    run = counted.withColumn("upto", F.sum("bytes").over(W.orderBy(F.desc("logslope")).rowsBetween(W.unboundedPreceding, 0)).cast("long"))
    return run.agg(F.coalesce(F.max(F.when(F.col("upto") > budget, F.col("logslope"))), F.lit(0)).cast("long").alias("threshold"), F.coalesce(F.max(F.when(F.col("upto") <= budget, F.col("upto"))), F.lit(0)).cast("long").alias("bytes"))


def slope_bounds(passes: DataFrame) -> DataFrame:
    return passes.where("slope > 0").agg(F.min("slope").alias("least"), F.max("slope").alias("greatest"))


def log_slope(passes: DataFrame) -> DataFrame:
    """Places of slopes in the log domain; 0 where a slope isn't positive."""
    place = F.log(F.least("slope", F.lit(STEEPEST))) * _SCALE - math.log(STEEPEST) * _SCALE + PLACES
    return passes.withColumn("logslope", F.when(F.col("slope") > 0, F.greatest(F.lit(1), F.least(F.lit(PLACES - 1), F.floor(place)))).otherwise(0).cast("long"))


def target_bytes(samples: int, prec: int, ratio: float) -> int:
    return int(samples * prec / 8 / ratio)
