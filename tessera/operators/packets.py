"""Packets: progression orders, order changes, index tables, byte ranges, transcoding. The most relational part."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tessera.functions.scan import before

#: Sort keys of each progression.
ORDERS = {
    "LRCP": ["layer", "res", "comp", "precinct"],
    "RLCP": ["res", "layer", "comp", "precinct"],
    "RPCL": ["res", "py", "px", "comp", "layer"],
    "PCRL": ["py", "px", "comp", "res", "layer"],
    "CPRL": ["comp", "py", "px", "res", "layer"],
    "PRCL": ["py", "px", "res", "comp", "layer"],
}
SOP_BYTES, EPH_BYTES = 6, 2


def progress(packets: DataFrame, order: str) -> DataFrame:
    """Numbers each tile's packets in a progression (ties by precinct, then key).

    In two levels: packets with the same two leading keys are ranked among themselves, behind a running count of such groups, so a tile isn't one task's work."""
    keys = ORDERS[order] + [k for k in ("precinct", "k") if k not in ORDERS[order]]
    lead = ["tile", *keys[:2]]
    counted = packets.groupBy(*lead).agg(F.count("*").alias("_n"))
    base = counted.withColumn("_base", F.coalesce(F.sum("_n").over(W.partitionBy("tile").orderBy(*keys[:2]).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    ranked = packets.withColumn("_rank", F.row_number().over(W.partitionBy(*lead).orderBy(*keys[2:])) - 1)
    return ranked.join(base, lead).withColumn("seq", (F.col("_base") + F.col("_rank")).cast("long")).drop("_base", "_rank").select(*packets.columns, "seq")


def change_order(packets: DataFrame, changes: list[tuple[int, int, int, int, int, int, str]]) -> DataFrame:
    """Order changes (first res, first comp, end layer, end res, end comp, number, order): a packet goes with the first change that holds it.

    Which change that is, and the packet's keys in that change's order, are expressions; so one sort of each tile does."""
    holds = [(F.col("res") >= r0) & (F.col("comp") >= c0) & (F.col("layer") < l1) & (F.col("res") < r1) & (F.col("comp") < c1) for r0, c0, l1, r1, c1, _, _ in changes]
    keyed = packets.withColumn("poc", F.coalesce(*(F.when(h, F.lit(i).cast("long")) for i, h in enumerate(holds)))).where("poc is not null")
    keys = F.coalesce(*(F.when(F.col("poc") == i, F.array(*(F.col(k).cast("long") for k in [*ORDERS[c[6]], "precinct", "k"]))) for i, c in enumerate(changes)))
    # Orders have four keys or five; the shorter ones differ from the others in poc already.
    return keyed.withColumn("seq", F.row_number().over(W.partitionBy("tile").orderBy("poc", keys)).cast("long") - 1)


def total_packets(packets: DataFrame) -> DataFrame:
    return packets.groupBy("tile").agg(F.count("*").alias("packets"), F.sum("length").alias("bytes"))


def offsets(parts: DataFrame, key: str = "tile") -> DataFrame:
    """Where each tile part lies among its tile's, by a running sum."""
    w = W.partitionBy(key).orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    return parts.withColumn("offset", F.coalesce(F.sum("length").over(w), F.lit(0)).cast("long"))


def offsets_in_stream(parts: DataFrame) -> DataFrame:
    """Offsets in one stream of all parts, in levels: no task sees all parts."""
    return before(parts, "seq", "length", "offset")


def pop_lengths(packets: DataFrame, n: int) -> DataFrame:
    """For each packet the bytes of it and the next n - 1."""
    w = W.partitionBy("tile").orderBy("seq").rowsBetween(0, n - 1)
    return packets.withColumn("popped", F.sum("length").over(w).cast("long"))


def varint_bytes(packets: DataFrame) -> DataFrame:
    """Bytes that a length takes in an index of 7-bit groups."""
    return packets.withColumn("plt_bytes", F.ceil(F.length(F.bin("length")) / 7).cast("long"))


def fetch_ranges(packets: DataFrame, gap: int) -> DataFrame:
    """Wanted packets (offset, length) merged into byte ranges wherever at most ``gap`` bytes lie between."""
    w = W.partitionBy("tile").orderBy("offset")
    ends = F.max(F.col("offset") + F.col("length")).over(w.rowsBetween(W.unboundedPreceding, -1))
    starts = packets.withColumn("new", F.when(ends.isNull() | (F.col("offset") - ends > gap), 1).otherwise(0))
    numbered = starts.withColumn("range", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy("tile", "range").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("end"), F.count("*").alias("packets"))


def packet_mask(packets: DataFrame, max_res: int, max_layers: int, comps: list[int]) -> DataFrame:
    return packets.withColumn("wanted", (F.col("res") <= max_res) & (F.col("layer") < max_layers) & F.col("comp").isin(comps))


def chunks(ranges: DataFrame, size: int) -> DataFrame:
    """The fixed-size chunks that each range of bytes touches."""
    return ranges.select("*", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size))).alias("chunk"))


def transcode(packets: DataFrame, order: str = "LRCP", max_layers: int = 0, max_res: int | None = None, sop: bool = False, eph: bool = False) -> DataFrame:
    """Drops layers and resolutions, reorders, adds delimiters, and lays the packets out anew. Samples are never decoded."""
    kept = packets
    if max_layers:
        kept = kept.where(F.col("layer") < max_layers)
    if max_res is not None:
        kept = kept.where(F.col("res") <= max_res)
    kept = kept.withColumn("length", F.col("length") + SOP_BYTES * sop + EPH_BYTES * eph)
    return offsets(progress(kept, order))


def tile_parts_by(packets: DataFrame, divider: str) -> DataFrame:
    """A new tile part wherever the divider (res, layer or comp) moves on."""
    return packets.withColumn("part", F.dense_rank().over(W.partitionBy("tile").orderBy(divider)) - 1)


def precinct_grid(res: DataFrame, size_log2: int) -> DataFrame:
    """Precincts across and down of each resolution's rectangle."""
    p = 1 << size_log2
    n = lambda lo, hi: F.when(F.col(hi) > F.col(lo), F.ceil(F.col(hi) / p) - F.floor(F.col(lo) / p)).otherwise(0).cast("long")
    return res.withColumn("pw", n("x0", "x1")).withColumn("ph", n("y0", "y1"))


def seek(queries: DataFrame, parts: DataFrame, block: int = 1 << 20) -> DataFrame:
    """The part that holds each offset: an equi-join on the blocks of bytes that parts cover, then the exact test."""
    covered = parts.select("seq", "offset", "length", F.explode(F.sequence(F.floor(F.col("offset") / block), F.floor((F.col("offset") + F.col("length") - 1) / block))).alias("block"))
    asked = queries.withColumn("block", F.floor(F.col("at") / block))
    return asked.join(covered, "block").where("at >= offset and at < offset + length").select("at", "seq", (F.col("at") - F.col("offset")).alias("within"))


def newly_needed(packets: DataFrame, had: DataFrame, layers: int, resolutions: int) -> DataFrame:
    """Packets of the first ``layers`` layers and ``resolutions`` resolutions that their tile wasn't decoded with. had: tile, layers, res, for tiles decoded before."""
    wanted = packets.where((F.col("layer") < layers) & (F.col("res") < resolutions))
    state = had.select("tile", F.col("layers").alias("had_layers"), F.col("res").alias("had_res"))
    return wanted.join(state, "tile", "left").where("had_layers is null or layer >= had_layers or res >= had_res").drop("had_layers", "had_res")
