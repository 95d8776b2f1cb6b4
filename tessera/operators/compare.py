"""Comparing images, dumps and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def compare(base: DataFrame, other: DataFrame) -> DataFrame:
    """For each component: samples that differ, largest error, mean squared error, samples that only one side has."""
    b, o = base.select("comp", "y", "x", F.col("v").alias("a")), other.select("comp", "y", "x", F.col("v").alias("b"))
    both = b.join(o, ["comp", "y", "x"], "full_outer")
    d = F.abs(F.col("a") - F.col("b"))
    return both.groupBy("comp").agg(
        F.count_if(d > 0).alias("differ"), F.max(d).alias("peak"), (F.sum(d * d) / F.count(d)).alias("mse"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("unmatched"),
    )


def within(compared: DataFrame, peak: float, mse: float) -> DataFrame:
    return compared.withColumn("ok", (F.col("unmatched") == 0) & (F.col("peak") <= peak) & (F.col("mse") <= mse))


def same_components(components: DataFrame) -> DataFrame:
    """Whether all components of an image agree in size, spacing, precision and sign."""
    return components.groupBy("image_id").agg((F.countDistinct("w", "h", "dx", "dy", "prec", "sgnd") == 1).alias("same"), F.count("*").alias("components"))


def canonical_rows(samples: DataFrame) -> DataFrame:
    """An md5 of each line's samples in order, as text: a hash that doesn't depend on how rows are dealt out."""
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "v"))), lambda s: s["v"].cast("string")), ",")  # one line of one component
    return samples.groupBy("image_id", "comp", "y").agg(F.md5(line).alias("md5"))


def canonical(samples: DataFrame) -> DataFrame:
    rows = canonical_rows(samples)
    return rows.groupBy("image_id", "comp").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "md5"))), lambda s: s["md5"]), "")).alias("md5"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two dumps has."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def tile_distortion(base: DataFrame, other: DataFrame) -> DataFrame:
    """Squared error of each tile and component, over the samples that both have."""
    b, o = base.select("tile", "comp", "y", "x", F.col("v").alias("a")), other.select("comp", "y", "x", F.col("v").alias("b"))
    d = F.col("a") - F.col("b")
    return b.join(o, ["comp", "y", "x"]).groupBy("tile", "comp").agg(F.sum(d * d).alias("distortion"), F.count("*").alias("n"))
