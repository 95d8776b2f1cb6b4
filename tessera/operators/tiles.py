"""Compositing, swaths, tile caches, completion."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from tessera.functions.scan import before, run_from
from tessera.functions.workers import ship


def composite(tiles: DataFrame, canvas: DataFrame) -> DataFrame:
    """Pastes samples of tiles (of which later ones win) on a canvas of places; what no tile covers is 0."""
    top = tiles.groupBy("comp", "y", "x").agg(F.max_by("v", "tile").alias("v"))
    return canvas.join(top, ["comp", "y", "x"], "left").select("comp", "y", "x", F.coalesce("v", F.lit(0)).alias("v"))


#: Ranges of the sample types of a caller's buffer.
RANGES = {"u8": (0, 255), "i16": (-32768, 32767), "u16": (0, 65535), "u32": (0, 4294967295), "i32": (-2147483648, 2147483647)}


def swath(samples: DataFrame, bounds: tuple[int, int, int, int], band_map: list[int], kind: str = "u8", spacing: tuple[int, int, int] | None = None, alpha: int = 0) -> DataFrame:
    """Samples of a rectangle as a caller's buffer: bands (1-based components) in the order of band_map, clamped, with each sample's place.

    spacing: between pixels, lines and bands; by default band after band. alpha: the component (from 1) that is an opacity of one bit, and becomes 0 or 255."""
    x0, y0, x1, y1 = bounds
    w, h = x1 - x0, y1 - y0
    px, line, plane = spacing or (1, w, w * h)
    lo, hi = RANGES[kind]
    bands = F.array(*(F.struct(F.lit(b).alias("band"), F.lit(c - 1).alias("c")) for b, c in enumerate(band_map)))
    inside = samples.where(f"x >= {x0} and x < {x1} and y >= {y0} and y < {y1}").withColumn("m", F.explode(F.filter(bands, lambda m: m["c"] == F.col("comp"))))
    place = F.col("m.band") * plane + (F.col("y") - y0) * line + (F.col("x") - x0) * px
    value = F.when(F.col("comp") == alpha - 1, F.col("v") * 255).otherwise(F.col("v"))
    return inside.select(F.col("m.band").alias("band"), place.cast("long").alias("place"), F.greatest(F.lit(lo), F.least(F.lit(hi), value)).cast("long").alias("v"))


def pack_interleaved(samples: DataFrame) -> DataFrame:
    """Planar to pixels: the components of each place, in order."""
    got = F.array_sort(F.collect_list(F.struct("comp", "v")))  # as many as there are components
    return samples.groupBy("y", "x").agg(F.transform(got, lambda s: s["v"]).alias("pixel"))


def unpack_interleaved(pixels: DataFrame) -> DataFrame:
    return pixels.select("y", "x", F.posexplode("pixel").alias("comp", "v"))


#: Steps of a cache that are replayed in one go.
LRU_STEPS = 1 << 16


def lru_trace(trace: DataFrame, capacity: int) -> DataFrame:
    """Whether each access (cache, step, tile) hits a cache of ``capacity`` tiles: fewer than that many other tiles were used since the last time.

    Each cache is replayed in pieces of ``LRU_STEPS`` steps. A piece begins with the tiles that the ones before it leave, which are the
    last ``capacity`` tiles used; for these only the last uses in each piece count, so no task reads a whole trace."""
    cut = trace.select(*(F.col(c).cast("long").alias(c) for c in ("cache", "step", "tile"))).withColumn("piece", F.floor(F.col("step") / LRU_STEPS))
    last = cut.groupBy("cache", "piece", "tile").agg(F.max("step").alias("step"))
    newest = last.withColumn("rank", F.row_number().over(W.partitionBy("cache", "piece").orderBy(F.desc("step")))).where(F.col("rank") <= capacity)

    def carry(df: pd.DataFrame) -> pd.DataFrame:
        held: dict[int, int] = {}
        out = []
        for piece, uses in df.sort_values(["piece", "step"]).groupby("piece"):
            out += [(step, tile, piece) for tile, step in held.items()]
            for step, tile in uses[["step", "tile"]].itertuples(index=False):
                held.pop(tile, None)
                held[tile] = step
                if len(held) > capacity:
                    held.pop(next(iter(held)))
        return pd.DataFrame(out, columns=["step", "tile", "piece"]).assign(cache=df["cache"].iloc[0])[["cache", "step", "tile", "piece"]]

    def replay(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("step")
        held: dict[int, None] = {}
        out = []
        for tile, known in df[["tile", "known"]].itertuples(index=False):
            out.append(tile in held)
            held.pop(tile, None)
            held[tile] = None
            if len(held) > capacity:
                held.pop(next(iter(held)))
        return df.assign(hit=out)[~df["known"]][["cache", "step", "tile", "hit"]]

    ship(trace.sparkSession)
    kept = newest.groupBy("cache").applyInPandas(carry, "cache long, step long, tile long, piece long")
    rows = cut.withColumn("known", F.lit(False)).unionByName(kept.withColumn("known", F.lit(True)))
    return rows.groupBy("cache", "piece").applyInPandas(replay, "cache long, step long, tile long, hit boolean")


def lru_bytes(trace: DataFrame, budget: int) -> DataFrame:
    """Hits of a cache of so many bytes (cache, step, tile, size), replayed in order: each cache's trace is one task's work, read in order."""

    def replay(df: pd.DataFrame) -> pd.DataFrame:
        held: dict[int, int] = {}
        used, out = 0, []
        for _, tile, size in df.sort_values("step")[["step", "tile", "size"]].itertuples(index=False):
            hit = tile in held
            if hit:
                used -= held.pop(tile)
            held[tile] = size
            used += size
            while used > budget and len(held) > 1:
                used -= held.pop(next(iter(held)))
            out.append(hit)
        return df.sort_values("step").assign(hit=out)[["cache", "step", "tile", "hit"]]

    ship(trace.sparkSession)
    return trace.groupBy("cache").applyInPandas(replay, "cache long, step long, tile long, hit boolean")


def row_completion(done: DataFrame, columns: int) -> DataFrame:
    """Rows of tiles of which every tile is done (repeats count once), and when."""
    first = done.groupBy("row", "tile").agg(F.min("at").alias("at"))
    return first.groupBy("row").agg(F.count("*").alias("tiles"), F.max("at").alias("at")).where(F.col("tiles") == columns)


def band_order(rows: DataFrame) -> DataFrame:
    """When each finished row can be handed on: not before all rows above it."""
    return before(rows, "row", "at", "emitted", "max").withColumn("emitted", F.greatest("emitted", "at"))


def swath_wait(swaths: DataFrame, done: DataFrame) -> DataFrame:
    """For each swath of rows (swath, lo, hi) when the last tile under it is done, and how many are."""
    rows = swaths.select("swath", F.explode(F.sequence("lo", "hi")).alias("row"))
    return rows.join(done, "row").groupBy("swath").agg(F.max("at").alias("ready"), F.count("*").alias("tiles"))


def contiguous(done: DataFrame, key: str = "row") -> DataFrame:
    """The longest run from 0 of finished numbers."""
    numbers = done.select(key).distinct()
    return numbers.where((F.col(key) >= 0) & (F.col(key) < run_from(numbers, key, 0))).withColumn("n", F.col(key))


def chunk_places(chunks: DataFrame) -> DataFrame:
    """Offsets of non-contiguous pieces in the logical stream that they form."""
    w = W.partitionBy("stream").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    return chunks.withColumn("offset", F.coalesce(F.sum("length").over(w), F.lit(0)).cast("long"))
