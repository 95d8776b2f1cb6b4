"""Sample-wise transforms: precision, colour, palettes, components. Samples are LONG; products stay far inside."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.geometry import clamp

V = "v"


def clip_precision(samples: DataFrame, prec: int, signed: bool = False) -> DataFrame:
    return samples.withColumn(V, clamp(F.col(V), prec, signed))


def scale_precision(samples: DataFrame, have: int, want: int) -> DataFrame:
    """Up by multiplying; down by a division that truncates towards 0."""
    if want >= have:
        return samples.withColumn(V, F.col(V) * (1 << (want - have)))
    d = 1 << (have - want)
    return samples.withColumn(V, F.expr(f"{V} div {d}").cast("long"))


def rescale(samples: DataFrame, src: tuple[float, float], dst: tuple[float, float]) -> DataFrame:
    """Linear from one range to another, clamped, then rounded half away from 0. A reversed target range turns the samples round."""
    if src[0] == src[1]:
        raise ValueError("the source range is empty")
    k = (dst[1] - dst[0]) / (src[1] - src[0])
    lo, hi = min(dst), max(dst)
    moved = (F.col(V).cast("double") - float(src[0])) * k + float(dst[0])
    return samples.withColumn(V, F.round(F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), moved))).cast("long"))


def rescaled_precision(lo: float, hi: float) -> tuple[int, bool]:
    """Bits and sign that a target range needs."""
    signed = min(lo, hi) < 0
    n = 1
    while not ((-(1 << (n - 1)) <= min(lo, hi) and max(lo, hi) <= (1 << (n - 1)) - 1) if signed else max(lo, hi) <= (1 << n) - 1):
        n += 1
    return n, signed


def precision_of(comp: int, policy: list[int], own: int) -> int:
    """A list's entry for a component; the last one repeats, and 0 keeps what there is."""
    return (policy[min(comp, len(policy) - 1)] or own) if policy else own


def dc_shift(samples: DataFrame, prec: int) -> DataFrame:
    return samples.withColumn(V, F.col(V) - (1 << (prec - 1)))


def dc_unshift(samples: DataFrame, prec: int) -> DataFrame:
    return samples.withColumn(V, clamp(F.col(V) + (1 << (prec - 1)), prec))


def rct(pixels: DataFrame) -> DataFrame:
    """r, g, b to y, u, v; reversible."""
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    return pixels.select("x", "y", F.shiftright(r + 2 * g + b, 2).alias("c0"), (b - g).alias("c1"), (r - g).alias("c2"))


def rct_inverse(pixels: DataFrame) -> DataFrame:
    g = F.col("c0") - F.shiftright(F.col("c1") + F.col("c2"), 2)
    return pixels.select("x", "y", (F.col("c2") + g).alias("r"), g.alias("g"), (F.col("c1") + g).alias("b"))


#: Fixed values of the irreversible colour transform (ITU-T T.800).
ICT = ((0.299, 0.587, 0.114), (-0.16875, -0.33126, 0.5), (0.5, -0.41869, -0.08131))


def ict(pixels: DataFrame) -> DataFrame:
    r, g, b = (F.col(c).cast("double") for c in "rgb")
    return pixels.select("x", "y", *((r * a + g * q + b * c).alias(f"c{i}") for i, (a, q, c) in enumerate(ICT)))


def ict_inverse(pixels: DataFrame) -> DataFrame:
    y, u, v = F.col("c0"), F.col("c1"), F.col("c2")
    return pixels.select("x", "y", (y + 1.402 * v).alias("r"), (y - 0.34413 * u - 0.71414 * v).alias("g"), (y + 1.772 * u).alias("b"))


def _fixed(k: float) -> int:
    """30-bit fixed point."""
    return round(k * (1 << 30))


def sycc_to_rgb(y: Column, cb: Column, cr: Column, prec: int = 8) -> list[Column]:
    """Fixed-point conversion: products are rounded half up by a shift, then clamped. cb and cr still hold their offset."""
    half, one = F.lit(1 << 29).cast("long"), 1 << (prec - 1)
    cb, cr = cb - one, cr - one
    shift = lambda p: F.shiftright(p + half, 30)
    red = y + shift(cr * F.lit(_fixed(1.402)).cast("long"))
    green = y - shift(cb * F.lit(_fixed(0.344)).cast("long") + cr * F.lit(_fixed(0.714)).cast("long"))
    blue = y + shift(cb * F.lit(_fixed(1.772)).cast("long"))
    return [clamp(c, prec) for c in (red, green, blue)]


def sycc444(pixels: DataFrame) -> DataFrame:
    red, green, blue = sycc_to_rgb(F.col("r"), F.col("g"), F.col("b"))
    return pixels.select("x", "y", red.alias("r"), green.alias("g"), blue.alias("b"))


def sycc_subsampled(luma: DataFrame, chroma: DataFrame, dx: int, dy: int, odd_x: int = 0, odd_y: int = 0) -> DataFrame:
    """luma (x, y, l) and chroma (x, y, cb, cr) at a dx-th and dy-th of its size; each chroma sample covers dx times dy of luma.

    Where the grid begins at an odd line or column, chroma begins after it. The odd first line has no chroma, and its samples are taken as 0; so are those of
    the odd first column, but for the lines that repeat a line of chroma."""
    cx, cy = F.floor(F.greatest(F.col("x") - odd_x, F.lit(0)) / dx), F.floor((F.col("y") - odd_y) / dy)
    none = (F.col("y") < odd_y) | ((F.col("x") < odd_x) & (F.pmod(F.col("y") - odd_y, F.lit(dy)) == 0))
    placed = luma.withColumn("cx", cx.cast("long")).withColumn("cy", cy.cast("long")).withColumn("none", none)
    held = chroma.select(F.col("x").alias("cx"), F.col("y").alias("cy"), "cb", "cr")
    both = placed.join(held, ["cx", "cy"], "left" if odd_x or odd_y else "inner").where("none or cb is not null")
    both = both.select("x", "y", "l", *(F.when(F.col("none"), F.lit(0).cast("long")).otherwise(F.col(c)).alias(c) for c in ("cb", "cr")))
    red, green, blue = sycc_to_rgb(F.col("l"), F.col("cb"), F.col("cr"))
    return both.select("x", "y", red.alias("r"), green.alias("g"), blue.alias("b"))


#: Fixed values of the e-sYCC conversion.
ESYCC = ((1.0, -0.0000368, 1.40199), (1.0003, -0.344125, -0.7141128), (0.999823, 1.77204, -0.000008))


def esycc(pixels: DataFrame, prec: int = 8) -> DataFrame:
    """e-sYCC: a matrix in doubles, half added and truncated, clamped."""
    y, cb, cr = F.col("r").cast("double"), (F.col("g") - (1 << (prec - 1))).cast("double"), (F.col("b") - (1 << (prec - 1))).cast("double")
    out = [y * a + cb * b + cr * c for a, b, c in ESYCC]
    return pixels.select("x", "y", *(clamp(F.floor(F.greatest(e + 0.5, F.lit(0.0))).cast("long"), prec).alias(n) for n, e in zip("rgb", out, strict=True)))


def cmyk_to_rgb(pixels: DataFrame, prec: int = 8) -> DataFrame:
    """c, m, y, k to r, g, b of 8 bits, truncated."""
    top = float((1 << prec) - 1)
    k = 1.0 - F.col("k") / top
    return pixels.select("x", "y", *(F.floor(255.0 * (1.0 - F.col(c) / top) * k).cast("long").alias(n) for n, c in (("r", "cc"), ("g", "cm"), ("b", "cy"))))


def apply_palette(samples: DataFrame, lut: DataFrame, entries: int) -> DataFrame:
    """Samples become entries; an index beyond the last means the last. lut holds at most 1024 entries, by the format."""
    return samples.withColumn("idx", F.least(F.col(V), F.lit(entries - 1).cast("long"))).join(F.broadcast(lut.select("idx", "value")), "idx").withColumn(V, F.col("value")).drop("idx", "value")


def swap_channels(samples: DataFrame, definitions: list[tuple[int, int]]) -> DataFrame:
    """definitions: (channel, association), association 1 for the first colour. Applied in order: a swap rewrites later entries."""
    entries = [list(d) for d in definitions]
    order = {c: c for c, _ in entries}
    for i, (channel, asoc) in enumerate(entries):
        if asoc in (0, 65535) or channel == asoc - 1:
            continue
        target = asoc - 1
        order[channel], order[target] = order.get(target, target), order.get(channel, channel)
        for later in entries[i + 1 :]:
            if later[0] == channel:
                later[0] = target
            elif later[0] == target:
                later[0] = channel
    moved = F.create_map(*(F.lit(x) for new, old in order.items() for x in (old, new)))
    return samples.withColumn("comp", F.coalesce(moved[F.col("comp")], F.col("comp")))


def grey_to_rgb(samples: DataFrame) -> DataFrame:
    return samples.where("comp = 0").drop("comp").withColumn("comp", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))


def upsample(samples: DataFrame, dx: int, dy: int) -> DataFrame:
    """Each sample covers dx times dy."""
    wide = samples.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(dx - 1).cast("long")))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(dy - 1).cast("long"))))
    return wide.withColumn("x", F.col("x") * dx + F.col("i")).withColumn("y", F.col("y") * dy + F.col("j")).drop("i", "j")


#: The matrix of the sRGB primaries.
PRIMARIES = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))


def inverse(matrix: DataFrame) -> DataFrame:
    """The inverse of a square matrix in rows (row, col, m), as large as the number of components; an error where there is none."""

    def solve(df: pd.DataFrame) -> pd.DataFrame:
        n = int(df["row"].max()) + 1
        full = np.zeros((n, n))
        full[df["row"], df["col"]] = df["m"]
        row, col = np.divmod(np.arange(n * n), n)
        return pd.DataFrame({"row": row, "col": col, "m": np.linalg.inv(full).reshape(-1)})

    return matrix.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(solve, "row long, col long, m double")


def rgb_to_xyz(pixels: DataFrame, prec: int = 12) -> DataFrame:
    """Rec. 709 to DCI X'Y'Z': linear light, matrix, 48 / 52.37, and the projector's gamma."""
    top = float((1 << prec) - 1)
    lin = [F.pow(F.col(c) / top, F.lit(2.2)) for c in "rgb"]
    rows = [sum((a * c for a, c in zip(m, lin, strict=True)), F.lit(0.0)) for m in PRIMARIES]
    return pixels.select("x", "y", *((F.pow(e * (48 / 52.37), F.lit(1 / 2.6)) * top).alias(n) for n, e in zip(("cx", "cy", "cz"), rows, strict=True)))


def custom_mct(samples: DataFrame, matrix: list[list[float]]) -> DataFrame:
    """New components as weighted sums of the old ones at each place."""
    weights = F.array(*(F.array(*(F.lit(float(row[c])) for row in matrix)) for c in range(len(matrix[0]))))
    parts = samples.select("image_id", "y", "x", "v", F.posexplode(F.element_at(weights, F.col("comp") + 1)).alias("comp", "w"))
    return parts.groupBy("image_id", "comp", "y", "x").agg(F.sum(F.col("w") * F.col("v")).alias("v"))


def mct_norms(matrix: DataFrame) -> DataFrame:
    """Length of each column of a matrix in rows (row, col, m)."""
    return matrix.groupBy("col").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))


def sample_type(prec: int, guard: int = 3) -> str:
    """16 bits where precision and headroom fit."""
    return "int16" if prec + guard <= 16 else "int32"


def needs_rgb(color_space: Column, fmt: Column, force: bool = False) -> Column:
    return F.lit(force) | (color_space.isin("SYCC", "EYCC", "CMYK") & ~fmt.isin("UNK", "TIF", "PGX"))


def post_process(samples: DataFrame, lut: DataFrame | None = None, entries: int = 0, definitions=(), grey: bool = False, src=None, dst=None, prec: int = 0, dx: int = 1, dy: int = 1) -> DataFrame:
    """Palette, channel definitions, grey to RGB, rescale, precision, upsampling: in this order, each only if asked for."""
    out = samples
    if lut is not None:
        out = apply_palette(out, lut, entries)
    if definitions:
        out = swap_channels(out, list(definitions))
    if grey:
        out = grey_to_rgb(out)
    if src:
        out = rescale(out, src, dst)
    if prec:
        out = clip_precision(out, prec)
    return upsample(out, dx, dy) if dx * dy > 1 else out


def is_no_op(**steps) -> bool:
    """Whether post_process with these arguments changes nothing."""
    return not any(steps.get(k) for k in ("lut", "definitions", "grey", "src", "prec")) and steps.get("dx", 1) * steps.get("dy", 1) == 1
