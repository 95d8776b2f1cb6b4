"""Running sums and maxima over a whole table in levels: blocks of the order's numbers first, then rows within, so that no task sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

#: Numbers in a block; with two levels the last window has a row for each 16 million numbers.
BLOCK = 4096


def before(df: DataFrame, order: str, value: str, name: str, kind: str = "sum", block: int = BLOCK, levels: int = 2) -> DataFrame:
    """Adds the sum (0 for the first row) or max (null for the first row) of ``value`` over all rows before each, by ``order`` (whole numbers without ties)."""
    total = F.sum if kind == "sum" else F.max

    def upto_last(column: str, window):
        got = total(column).over(window.rowsBetween(W.unboundedPreceding, -1))
        return F.coalesce(got, F.lit(0)).cast("long") if kind == "sum" else got

    if not levels:
        return df.withColumn(name, upto_last(value, W.orderBy(order)))
    at, all_of, base = f"_block{levels}", f"_total{levels}", f"_base{levels}"
    cut = df.withColumn(at, F.floor(F.col(order) / block).cast("long"))
    totals = cut.groupBy(at).agg(total(value).alias(all_of))
    bases = before(totals, at, all_of, base, kind, block, levels - 1).select(at, base)
    within = upto_last(value, W.partitionBy(at).orderBy(order))
    both = F.col(base) + within if kind == "sum" else F.greatest(base, within)
    return cut.join(bases, at).withColumn(name, both).drop(at, base)


def run_from(numbers: DataFrame, column: str, start: int, block: int = BLOCK, levels: int = 2) -> int:
    """The first number from ``start`` (a multiple of the blocks' sizes) on that is missing among distinct ``numbers``. Whole blocks first; a number comes to the driver."""
    if levels:
        cut = numbers.groupBy(F.floor(F.col(column) / block).cast("long").alias(column)).agg(F.count("*").alias("n")).where(F.col("n") == block).select(column)
        start = run_from(cut, column, start // block, block, levels - 1) * block
        numbers = numbers.where((F.col(column) >= start) & (F.col(column) < start + block))
    placed = numbers.where(F.col(column) >= start).withColumn("_at", F.row_number().over(W.orderBy(column)) - 1 + start)
    return start + placed.where(F.col(column) == F.col("_at")).count()
