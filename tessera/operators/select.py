"""Choosing what to decode: regions, tiles, components, resolutions, layers."""

from __future__ import annotations

from math import ceil, floor

from pyspark.sql import DataFrame, Window as W, functions as F

from tessera.functions import geometry as G


def region_bounds(region: tuple[float, float, float, float], width: int, height: int) -> tuple[int, int, int, int]:
    """A region in samples. All values up to 1.0 are shares of the image: floor for the near corner, ceil for the far one. What
    sticks out to the right or below is clipped; what begins outside is an error."""
    x0, y0, x1, y1 = region
    if max(region) <= 1.0:
        x0, y0, x1, y1 = floor(x0 * width), floor(y0 * height), ceil(x1 * width), ceil(y1 * height)
    if x0 < 0 or y0 < 0 or x0 >= width or y0 >= height:
        raise ValueError("the region begins outside the image")
    return int(x0), int(y0), min(int(x1), width), min(int(y1), height)


def region(samples: DataFrame, bounds: tuple[int, int, int, int]) -> DataFrame:
    x0, y0, x1, y1 = bounds
    return samples.where(G.holds(F.col("x"), F.col("y"), x0, y0, x1, y1))


def assign_tiles(samples: DataFrame, tw: int, th: int, columns: int) -> DataFrame:
    """Adds the tile of each sample, numbered by rows of ``columns`` tiles."""
    return samples.withColumn("tile", F.floor(F.col("y") / th).cast("long") * columns + F.floor(F.col("x") / tw).cast("long"))


def tile_region(tiled: DataFrame, bounds: tuple[int, int, int, int], tw: int, th: int, columns: int) -> DataFrame:
    """A region of samples stored by tile: tile numbers are derived from the bounds, so partitions are pruned before samples are read."""
    x0, y0, x1, y1 = bounds
    wanted = [ty * columns + tx for ty in range(y0 // th, (y1 - 1) // th + 1) for tx in range(x0 // tw, (x1 - 1) // tw + 1)]
    return region(tiled.where(F.col("tile").isin(wanted)), bounds)


def tile_bounds(tiles: DataFrame, width: int, height: int, tw: int, th: int, columns: int) -> DataFrame:
    """Each tile's rectangle: its cell of the grid within the image."""
    tx, ty = F.col("tile") % columns, F.floor(F.col("tile") / columns).cast("long")
    return tiles.select("tile", (tx * tw).alias("x0"), (ty * th).alias("y0"), F.least((tx + 1) * tw, F.lit(width)).alias("x1"), F.least((ty + 1) * th, F.lit(height)).alias("y1"))


def slated_tiles(tiles: DataFrame, regions: DataFrame) -> DataFrame:
    """Tiles that any region meets (a semi join on the grid cells that each region covers, not on all pairs)."""
    first = tiles.agg(F.max(F.col("x1") - F.col("x0")).alias("tw"), F.max(F.col("y1") - F.col("y0")).alias("th")).first()
    tw, th = first["tw"], first["th"]
    cells = regions.where("x0 < x1 and y0 < y1").select(
        F.explode(F.sequence(F.floor(F.col("x0") / tw), F.floor((F.col("x1") - 1) / tw))).alias("tx"), F.floor(F.col("y0") / th).alias("lo"), F.floor((F.col("y1") - 1) / th).alias("hi")
    )
    cells = cells.select("tx", F.explode(F.sequence("lo", "hi")).alias("ty")).distinct()
    return tiles.withColumn("tx", F.floor(F.col("x0") / tw)).withColumn("ty", F.floor(F.col("y0") / th)).join(cells, ["tx", "ty"], "left_semi").drop("tx", "ty")


def pending_tiles(slated: DataFrame, cached: DataFrame) -> DataFrame:
    """Slated tiles that the cache lacks or holds dirty."""
    return slated.join(cached.where("not dirty"), "tile", "left_anti")


def project_components(samples: DataFrame, keep: list[int]) -> DataFrame:
    """The listed components, renumbered in the order of the list."""
    place = F.array_position(F.array(*(F.lit(c) for c in keep)), F.col("comp")).cast("int") - 1
    return samples.where(F.col("comp").isin(keep)).withColumn("comp", place)


def reduce_geometry(rects: DataFrame, r: int) -> DataFrame:
    """A rectangle after dropping r resolutions: both corners are divided, then subtracted."""
    c = {n: G.ceil_pow2(F.col(n), r) for n in ("x0", "y0", "x1", "y1")}
    return rects.select("region", *(c[n].alias(n) for n in c), (c["x1"] - c["x0"]).alias("w"), (c["y1"] - c["y0"]).alias("h"))


def subsample_geometry(rects: DataFrame, dx: int, dy: int) -> DataFrame:
    c = {"x0": G.ceil_div(F.col("x0"), dx), "y0": G.ceil_div(F.col("y0"), dy), "x1": G.ceil_div(F.col("x1"), dx), "y1": G.ceil_div(F.col("y1"), dy)}
    return rects.select("region", *(c[n].alias(n) for n in c), (c["x1"] - c["x0"]).alias("w"), (c["y1"] - c["y0"]).alias("h"))


def limit_layers(packets: DataFrame, layers: int) -> DataFrame:
    """The first layers (0: all)."""
    return packets.where(F.col("layer") < layers) if layers else packets


def limit_resolutions(packets: DataFrame, total: int, drop: int) -> DataFrame:
    return packets.where(F.col("res") < total - drop)


def progression_state(changes: DataFrame) -> DataFrame:
    """For each tile the most layers asked for over its resolutions, and whether that differs from what it had."""
    return changes.groupBy("tile").agg(F.max("layers").alias("layers"), F.max("had").alias("had")).withColumn("dirty", F.col("layers") != F.col("had"))


def renumber(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1)


def window_tiles(windows: DataFrame, origin: tuple[int, int], tile: tuple[int, int], limits: tuple[int, int, int, int]) -> DataFrame:
    """Adds the tile columns tx0 to tx1 and rows ty0 to ty1 (half open) under each window, clipped to the tiles x0, y0, x1, y1 of ``limits``; empty windows have none."""
    out = windows.where("x0 < x1 and y0 < y1")
    for axis, first, size, lo, hi in (("x", origin[0], tile[0], limits[0], limits[2]), ("y", origin[1], tile[1], limits[1], limits[3])):
        out = out.withColumn(f"t{axis}0", F.greatest(F.lit(lo), F.floor((F.col(f"{axis}0") - first) / size)).cast("long"))
        out = out.withColumn(f"t{axis}1", F.least(F.lit(hi), F.floor((F.col(f"{axis}1") - first - 1) / size) + 1).cast("long"))
    return out


def pan(rects: DataFrame, x: int, y: int) -> DataFrame:
    """Rectangles relative to (x, y)."""
    return rects.withColumns({c: F.col(c) - (x if c[0] == "x" else y) for c in ("x0", "y0", "x1", "y1")})


def bounding(rects: DataFrame) -> DataFrame:
    """The least rectangle around all that aren't empty, and the sum of their areas."""
    some = rects.where("x0 < x1 and y0 < y1")
    return some.agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"))


def single_tile(samples: DataFrame, tile: int, tw: int, th: int, columns: int, tiles: int) -> DataFrame:
    """One tile's samples, by its rectangle; an error for a tile beyond the grid."""
    if not 0 <= tile < tiles:
        raise ValueError(f"tile {tile} is not among the {tiles} of the grid")
    x, y = tile % columns * tw, tile // columns * th
    return samples.where((F.col("x") >= x) & (F.col("x") < x + tw) & (F.col("y") >= y) & (F.col("y") < y + th))
