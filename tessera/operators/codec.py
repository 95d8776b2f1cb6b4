"""Lossless coding of colour images, tile by tile: level shift, reversible colour transform, wavelet levels and coded blocks, and all of it back.

A tile is one task's work, in numpy; tiles are independent of each other, so there is one shuffle each way.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tessera.functions.workers import ship
from tessera.operators.blocks import decode_block, encode_block
from tessera.operators.wavelet import block_dwt53, block_idwt53

#: Places of each band among a level's interleaved coefficients: first line and column.
BANDS = {"LL": (0, 0), "HL": (0, 1), "LH": (1, 0), "HH": (1, 1)}
BLOCKS = "tile long, y0 long, x0 long, th int, tw int, comp int, level int, band string, by int, bx int, w int, h int, planes int, passes int, data binary"


def _spread(rows: DataFrame) -> DataFrame:
    """Over all shuffle partitions: a tile's coding takes long for its few bytes, by which partitions would be put together for a few tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "tile")


def compress(pixels: DataFrame, prec: int, tile: int, levels: int = 2, size: int = 64) -> DataFrame:
    """Coded blocks of an image (x, y, r, g, b); what a tile's rectangle lacks is 0. tile: the side of a tile, a multiple of 2 to the power of ``levels``."""
    if tile % (1 << levels):
        raise ValueError(f"tiles of {tile} samples don't halve {levels} times")
    half = 1 << (prec - 1)

    def build(df: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(df.y.min()) // tile * tile, int(df.x.min()) // tile * tile
        planes = np.zeros((3, int(df.y.max()) - y0 + 1, int(df.x.max()) - x0 + 1), np.int64)
        for c, name in enumerate("rgb"):
            planes[c, df.y - y0, df.x - x0] = df[name]
        r, g, b = planes - half
        rows = []
        for comp, low in enumerate(((r + 2 * g + b) >> 2, b - g, r - g)):
            for level in range(1, levels + 1):
                turned = block_dwt53(low)
                low = turned[::2, ::2]
                for band, (y, x) in BANDS.items():
                    part = turned[y::2, x::2]
                    for by in range(0, part.shape[0] if band != "LL" or level == levels else 0, size):
                        for bx in range(0, part.shape[1], size):
                            own = part[by : by + size, bx : bx + size]
                            data, bits, passes = encode_block(own, band)
                            rows.append((df.tile.iloc[0], y0, x0, *planes.shape[1:], comp, level, band, by, bx, own.shape[1], own.shape[0], bits, passes, data))
        return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in BLOCKS.split(", ")])

    ship(pixels.sparkSession)
    number = F.floor(F.col("y") / tile).cast("long") * (1 << 20) + F.floor(F.col("x") / tile).cast("long")
    return _spread(pixels.select("x", "y", "r", "g", "b", number.alias("tile"))).groupBy("tile").applyInPandas(build, BLOCKS)


def expand(blocks: DataFrame, prec: int, reduce: int = 0, drop: int = 0) -> DataFrame:
    """The image (x, y, r, g, b) of coded blocks. reduce: levels that are not undone, so sides are halved as often; drop: last passes of each block left out."""
    half, top = 1 << (prec - 1), (1 << prec) - 1

    def build(df: pd.DataFrame) -> pd.DataFrame:
        one, levels = df.iloc[0], int(df.level.max())
        sizes = [(int(one.th), int(one.tw))]
        for _ in range(levels):
            sizes.append((-(-sizes[-1][0] // 2), -(-sizes[-1][1] // 2)))
        parts = {(c, n, b): rows for (c, n, b), rows in df.groupby(["comp", "level", "band"])}
        turned = []
        for comp in range(3):
            low = None
            for level in range(levels, 0, -1):
                out = np.zeros(sizes[level - 1], np.int64)
                for band, (y, x) in BANDS.items():
                    place = out[y::2, x::2]
                    if band == "LL" and low is not None:
                        place[:] = low
                    elif (comp, level, band) in parts and (level > reduce or band == "LL"):
                        for b in parts[comp, level, band].itertuples(index=False):
                            place[b.by : b.by + b.h, b.bx : b.bx + b.w] = decode_block(b.data or b"", b.w, b.h, band, b.planes, max(0, b.passes - drop))
                if level <= reduce:
                    low = out[::2, ::2] if low is None else low
                    break
                low = block_idwt53(out)
            turned.append(low)
        y, u, v = turned
        g = y - ((u + v) >> 2)
        planes = np.clip(np.stack([v + g, g, u + g]) + half, 0, top)
        at, step = np.indices(y.shape).reshape(2, -1), 1 << reduce
        return pd.DataFrame({"x": at[1] + -(-int(one.x0) // step), "y": at[0] + -(-int(one.y0) // step), **{n: planes[c].reshape(-1) for c, n in enumerate("rgb")}})

    ship(blocks.sparkSession)
    return _spread(blocks).groupBy("tile").applyInPandas(build, "x long, y long, r long, g long, b long")
