"""Rectangles and integer arithmetic on the reference grid, as column expressions. Rectangles are half open."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ceil_div(a: Column, b: int | Column) -> Column:
    """ceil(a / b) for b > 0, in integers."""
    b = b if isinstance(b, Column) else F.lit(b).cast("long")
    return F.floor((a + b - 1) / b).cast("long")


def ceil_pow2(a: Column, k: int) -> Column:
    return F.shiftright(a + ((1 << k) - 1), k)


def floor_pow2(a: Column, k: int) -> Column:
    return F.shiftright(a, k)


def floor_log2(a: Column) -> Column:
    return F.length(F.bin(a)) - 1


def clip(lo: Column, hi: Column, to_lo: Column, to_hi: Column) -> tuple[Column, Column]:
    return F.greatest(lo, to_lo), F.least(hi, to_hi)


def meets(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1) -> Column:
    """Whether two rectangles share a sample; widths must not be used before this holds."""
    return (F.greatest(ax0, bx0) < F.least(ax1, bx1)) & (F.greatest(ay0, by0) < F.least(ay1, by1))


def holds(x: Column, y: Column, x0, y0, x1, y1) -> Column:
    return (x >= x0) & (x < x1) & (y >= y0) & (y < y1)


def grow(x0: Column, x1: Column, by: int, lo, hi) -> tuple[Column, Column]:
    return F.greatest(x0 - by, lo), F.least(x1 + by, hi)


def clamp(v: Column, prec: int, signed: bool = False) -> Column:
    lo, hi = (-(1 << (prec - 1)), (1 << (prec - 1)) - 1) if signed else (0, (1 << prec) - 1)
    return F.greatest(F.lit(lo).cast("long"), F.least(F.lit(hi).cast("long"), v))
