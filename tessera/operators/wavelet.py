"""Lifting wavelet transforms of long-form samples, by window functions along one axis, and of blocks by numpy.

A window holds one line of one tile, so its size is bounded by the tile. Coordinates start at an even origin unless ``origin`` says
otherwise; lines are extended symmetrically, and a line of one sample is copied (doubled at an odd origin by the reversible kernel).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tessera.functions.workers import ship

#: Fixed values of the irreversible kernel (ITU-T T.800).
ALPHA, BETA, GAMMA, DELTA, KAPPA = -1.586134342059924, -0.052980118572961, 0.882911075530934, 0.443506852043971, 1.230174104914001


def _line(axis: str, keys: list[str]):
    other = "x" if axis == "y" else "y"
    return W.partitionBy(*keys, other).orderBy(axis)


def _around(v: str, line) -> tuple[Column, Column]:
    """The neighbours of a sample, mirrored at the ends; null on both sides for a line of one."""
    before, after = F.lag(v).over(line), F.lead(v).over(line)
    return F.coalesce(before, after), F.coalesce(after, before)


def _step(df: DataFrame, odd: bool, axis: str, line, formula) -> DataFrame:
    a, b = _around("v", line)
    moved = df.withColumn("_a", a).withColumn("_b", b)
    return moved.withColumn("v", F.when((F.col(axis) % 2 == int(odd)) & F.col("_a").isNotNull(), formula(F.col("v"), F.col("_a"), F.col("_b"))).otherwise(F.col("v"))).drop("_a", "_b")


def dwt53(df: DataFrame, axis: str, keys: list[str]) -> DataFrame:
    """Reversible forward transform in place: low-pass values at even places, high-pass at odd ones."""
    line = _line(axis, keys)
    df = _step(df, True, axis, line, lambda v, a, b: v - F.shiftright(a + b, 1))
    return _step(df, False, axis, line, lambda v, a, b: v + F.shiftright(a + b + 2, 2))


def idwt53(df: DataFrame, axis: str, keys: list[str]) -> DataFrame:
    line = _line(axis, keys)
    df = _step(df, False, axis, line, lambda v, a, b: v - F.shiftright(a + b + 2, 2))
    return _step(df, True, axis, line, lambda v, a, b: v + F.shiftright(a + b, 1))


def dwt97(df: DataFrame, axis: str, keys: list[str]) -> DataFrame:
    """Irreversible forward transform in doubles."""
    line = _line(axis, keys)
    for odd, k in ((True, ALPHA), (False, BETA), (True, GAMMA), (False, DELTA)):
        df = _step(df, odd, axis, line, lambda v, a, b, k=k: v + k * (a + b))
    return df.withColumn("v", F.when(F.count("*").over(line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) == 1, F.col("v")).when(F.col(axis) % 2 == 0, F.col("v") / KAPPA).otherwise(F.col("v") * KAPPA))


def idwt97(df: DataFrame, axis: str, keys: list[str]) -> DataFrame:
    line = _line(axis, keys)
    df = df.withColumn("v", F.when(F.count("*").over(line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) == 1, F.col("v")).when(F.col(axis) % 2 == 0, F.col("v") * KAPPA).otherwise(F.col("v") / KAPPA))
    for odd, k in ((False, DELTA), (True, GAMMA), (False, BETA), (True, ALPHA)):
        df = _step(df, odd, axis, line, lambda v, a, b, k=k: v - k * (a + b))
    return df


def forward_2d(df: DataFrame, keys: list[str], kernel=dwt53) -> DataFrame:
    """One level: columns, then rows."""
    return kernel(kernel(df, "y", keys), "x", keys)


def inverse_2d(df: DataFrame, keys: list[str], kernel=idwt53) -> DataFrame:
    return kernel(kernel(df, "x", keys), "y", keys)


def split_bands(df: DataFrame) -> DataFrame:
    """Deinterleaves one level: band (LL, HL, LH, HH) and places within it."""
    band = F.concat(F.when(F.col("x") % 2 == 0, "L").otherwise("H"), F.when(F.col("y") % 2 == 0, "L").otherwise("H"))
    return df.withColumn("band", band).withColumn("x", F.floor(F.col("x") / 2).cast("long")).withColumn("y", F.floor(F.col("y") / 2).cast("long"))


def join_bands(df: DataFrame) -> DataFrame:
    """The inverse of split_bands."""
    return df.withColumn("x", F.col("x") * 2 + F.startswith("band", F.lit("H")).cast("long")).withColumn("y", F.col("y") * 2 + F.endswith("band", F.lit("H")).cast("long")).drop("band")


def forward_levels(df: DataFrame, keys: list[str], levels: int, kernel=dwt53) -> DataFrame:
    """Several levels: columns level and band; the last level's LL is kept as level ``levels``."""
    out, low = None, df
    for level in range(1, levels + 1):
        bands = split_bands(forward_2d(low, keys, kernel))
        keep = bands if level == levels else bands.where("band != 'LL'")
        part = keep.withColumn("level", F.lit(level))
        out = part if out is None else out.unionByName(part)
        low = bands.where("band = 'LL'").drop("band")
    return out


def inverse_levels(df: DataFrame, keys: list[str], levels: int, kernel=idwt53) -> DataFrame:
    low = None
    for level in range(levels, 0, -1):
        bands = df.where(F.col("level") == level).drop("level")
        if low is not None:
            bands = bands.unionByName(low.withColumn("band", F.lit("LL")))
        low = inverse_2d(join_bands(bands), keys, kernel)
    return low


def window_support(lo: int, hi: int, margin: int = 4) -> tuple[int, int]:
    """Interleaved coefficients that a region of one line needs, with an even start."""
    return max(0, lo - margin) & ~1, hi + margin


def inverse_region(coeffs: DataFrame, keys: list[str], bounds: tuple[int, int, int, int], size: tuple[int, int]) -> DataFrame:
    """One level's inverse over a region alone: coefficients of the region and the kernel's support, then the crop."""
    x0, y0, x1, y1 = bounds
    ax, bx = window_support(x0, x1)
    ay, by = window_support(y0, y1)
    near = coeffs.where(f"x >= {ax} and x < {min(bx, size[0])} and y >= {ay} and y < {min(by, size[1])}")
    return inverse_2d(near, keys).where(f"x >= {x0} and x < {x1} and y >= {y0} and y < {y1}")


# ------------------------------------------------------------ blocks


def lift_lines(a: np.ndarray, steps: list[tuple[int, float, float, int]], origin: int = 0, clamp: bool = False) -> np.ndarray:
    """Data-driven lifting along the last axis: (parity, coefficient, offset, shift) each; shift < 0 stays in floats. Symmetric or clamped ends."""
    a = a.copy()
    n = a.shape[-1]
    if n == 1:
        return a
    for parity, k, offset, shift in steps:
        start = (parity - origin) % 2
        i = np.arange(start, n, 2)
        left, right = i - 1, i + 1
        if clamp:
            left, right = np.maximum(left, 0), np.minimum(right, n - 1)
        else:
            left, right = np.where(left < 0, right, left), np.where(right >= n, i - 1, right)
        around = a[..., left] + a[..., right]
        a[..., i] += (k * around + offset) if shift < 0 else ((int(k) * around + int(offset)) >> shift)
    return a


FORWARD_53, INVERSE_53 = [(1, -1, 1, 1), (0, 1, 2, 2)], [(0, -1, 1, 2), (1, 1, 0, 1)]


def block_dwt53(block: np.ndarray) -> np.ndarray:
    """One level of a whole block: columns, then rows."""
    return lift_lines(lift_lines(block.T, FORWARD_53).T, FORWARD_53)


def block_idwt53(block: np.ndarray) -> np.ndarray:
    """The inverse of ``block_dwt53``."""
    return lift_lines(lift_lines(block, INVERSE_53).T, INVERSE_53).T


def dwt53_blocks(blocks: DataFrame) -> DataFrame:
    """The block form: rows (image_id, comp, tile, w, h, data ARRAY<INT>) are transformed in Arrow batches, with no shuffle."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            out = []
            for w, h, data in zip(batch.column("w").to_pylist(), batch.column("h").to_pylist(), batch.column("data"), strict=True):
                out.append(block_dwt53(np.array(data.as_py(), np.int64).reshape(h, w)).reshape(-1))
            rest = [batch.column(c) for c in ("image_id", "comp", "tile", "w", "h")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(out, pa.list_(pa.int32()))], names=["image_id", "comp", "tile", "w", "h", "data"])

    ship(blocks.sparkSession)
    return blocks.select("image_id", "comp", "tile", "w", "h", "data").mapInArrow(run, "image_id long, comp int, tile long, w int, h int, data array<int>")


def _synthesis(kernel: str, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """One level of a line without rounding; the line is long enough for its ends not to matter."""
    out = np.zeros(2 * len(low))
    out[::2], out[1::2] = low, high
    steps = ((0, -0.25), (1, 0.5)) if kernel == "5/3" else ((0, -DELTA), (1, -GAMMA), (0, -BETA), (1, -ALPHA))
    if kernel == "9/7":
        out[::2] *= KAPPA
        out[1::2] /= KAPPA
    for first, k in steps:
        around = np.roll(out, 1) + np.roll(out, -1)
        out[first::2] += k * around[first::2]
    return out


def basis_norm(kernel: str, band: str, level: int) -> float:
    """Length of a synthesis basis image: by how much an error of one in a coefficient counts in the samples. level 0: LL before any
    transform, other bands after one."""

    def along(part: str, depth: int) -> float:
        if not depth:
            return 1.0
        line, zero = np.zeros(64), np.zeros(64)
        line[32] = 1
        out = _synthesis(kernel, line, zero) if part == "L" else _synthesis(kernel, zero, line)
        for _ in range(depth - 1):
            out = _synthesis(kernel, out, np.zeros(len(out)))
        return float(np.linalg.norm(out))

    depth = level + (band != "LL")
    return along(band[0], depth) * along(band[1], depth)
