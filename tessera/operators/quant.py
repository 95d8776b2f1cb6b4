"""Step sizes, dequantization, regions of interest, magnitudes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def encode_step(step: Column, guard_log2: Column) -> tuple[Column, Column]:
    """Exponent and 11-bit mantissa of a step scaled by 8192."""
    p = F.floor(F.log2(step)).cast("long") - 13
    n = 11 - F.floor(F.log2(step)).cast("long")
    mantissa = F.when(n < 0, F.floor(step / F.pow(F.lit(2.0), -n))).otherwise(F.floor(step * F.pow(F.lit(2.0), n))).cast("long") % 2048
    return guard_log2 - p, mantissa


def band_steps(bands: DataFrame, base: float = 1.0) -> DataFrame:
    """bands (level, orient, norm, gain): the step that makes errors count alike, packed."""
    step = F.floor(F.lit(base) * (F.lit(1.0) / F.col("norm")) * 8192.0)
    expn, mant = encode_step(step, F.lit(8) + F.col("gain"))
    return bands.select("level", "orient", step.cast("long").alias("step"), expn.cast("long").alias("expn"), mant.alias("mant"))


def dequantize_reversible(df: DataFrame) -> DataFrame:
    """Half steps are dropped, towards 0."""
    return df.withColumn("v", F.expr("v div 2").cast("long"))


def dequantize(df: DataFrame, step: float) -> DataFrame:
    return df.withColumn("v", F.col("v") * (step / 2))


def narrow(df: DataFrame) -> DataFrame:
    """To 16 bits, half away from 0, clamped."""
    return df.withColumn("v", F.greatest(F.lit(-32768), F.least(F.lit(32767), F.round("v"))).cast("long"))


def unshift_roi(df: DataFrame, shift: int) -> DataFrame:
    """Magnitudes of 2^shift and more lie in the region of interest and are shifted down; signs stay."""
    mag = F.abs("v")
    return df.withColumn("v", F.when(mag >= (1 << shift), F.signum("v").cast("long") * F.shiftright(mag, shift)).otherwise(F.col("v")))


def magnitudes(df: DataFrame, keys: list[str]) -> DataFrame:
    """The largest magnitude of each block and its bit planes."""
    top = F.max(F.abs("v"))
    return df.groupBy(*keys).agg(top.alias("top"), F.when(top > 0, F.length(F.bin(top))).otherwise(0).cast("long").alias("planes"))


def tag_tree(leaves: DataFrame, levels: int) -> DataFrame:
    """Values of a tag tree's nodes: at each level the least of the four below. leaves: (x, y, v)."""
    low = leaves.select(F.lit(0).alias("level"), "x", "y", "v")
    out = low
    for level in range(1, levels + 1):
        low = low.groupBy(F.floor(F.col("x") / 2).cast("long").alias("x"), F.floor(F.col("y") / 2).cast("long").alias("y")).agg(F.min("v").alias("v")).select(F.lit(level).alias("level"), "x", "y", "v")
        out = out.unionByName(low)
    return out
