"""Queries over entropy coding, packet headers, further raster files, windows and matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.operators import blocks as B, codec, coding as K, packets as P, point, select as S, tiles as T, wavelet as Wv
from tessera.plans import rasters as R
from tessera.plans.containers import SEGMENTS, files, streams
from tessera.plans.queries import query
from tessera.plans.rasters import sql
from tessera.sources import markers as M, rasterfiles as RF

# ------------------------------------------------------------ entropy coding


@query(sql("emb", "select y, x, v from emb"))
def ebcot_roundtrip(spark, d):
    """Blocks of 32 by 32 samples, coded and decoded."""
    return B.decode_samples(B.encode_samples(R.emb_grid(spark, d), 32, "HL"), "HL").select("y", "x", "v")


@query(sql("wide", ", size as (select max(y) h from wide), grid as (select x, y from range(0, 128) a(x), range(0, (select h + 1 from size)) b(y)) select x, y, coalesce(r, 0) r, coalesce(g, 0) g, coalesce(b, 0) b from grid left join wide using (x, y)"))
def codec_roundtrip(spark, d):
    """A whole image: colour transform, tiles of 32 by 32, two wavelet levels, coded blocks, and back; what the ragged last line lacks is 0."""
    wide = R.rgb_wide(spark, d)
    grid = spark.range(128 * (wide.agg(F.max("y")).first()[0] + 1)).select((F.col("id") % 128).alias("x"), F.floor(F.col("id") / 128).cast("long").alias("y"))
    whole = grid.join(wide, ["x", "y"], "left").select("x", "y", *(F.coalesce(c, F.lit(0)).alias(c) for c in "rgb"))
    return codec.expand(codec.compress(whole, 8, 32, 2, 16), 8)


def _symbols(spark, d) -> DataFrame:
    e = R.table(spark, d, "events").select(F.col("user_id").cast("long").alias("block"), F.col("event_id").cast("long").alias("e"), F.pmod(F.floor("value").cast("long"), F.lit(2)).cast("int").alias("bit"))
    both = e.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("e", "bit"))).alias("s"))
    return both.select("block", F.expr("transform(s, t -> t.bit)").alias("bits"), F.expr("transform(s, t -> cast(t.e % 19 as int))").alias("contexts"))


@query("select user_id::bigint block, i::integer i, ((cast(floor(value) as bigint) % 2) + 2)::bigint % 2 bit from (select *, row_number() over (partition by user_id order by event_id) - 1 i from events)")
def mq_roundtrip(spark, d):
    """Decisions in 19 contexts, coded and decoded."""
    return K.decode_blocks(K.encode_blocks(_symbols(spark, d))).select("block", F.posexplode("bits").alias("i", "bit")).withColumn("bit", F.col("bit").cast("long"))


@query(sql("packets", "select precinct tree, least(7, k % 60 % 8)::bigint x, (k % 60 // 8)::bigint y, length % 9 v from packets"))
def tag_tree_roundtrip(spark, d):
    """Leaves of one tree for each precinct, coded and read back."""
    p = R.packets(spark, d).select(F.col("precinct").alias("tree"), (F.col("k") % 60 % 8).alias("x"), F.floor(F.col("k") % 60 / 8).cast("long").alias("y"), (F.col("length") % 9).alias("v"))
    return K.code_tag_tree(p).select("tree", "x", "y", "v")


_CONTENT = "b as (select precinct, layer, (k % 12) as block, max(k * 5 % 11)::bigint zero, max(length % 40)::bigint passes, max(length)::bigint length from packets group by precinct, layer, k % 12)"


@query(sql("packets", f", {_CONTENT}, z as (select precinct, block, max(zero) zero, min(layer) filter (passes > 0) first from b group by all) select precinct, layer, block, case when layer = first then z.zero else -1 end zero_planes, passes, length from b join z using (precinct, block) where passes > 0"))
def packet_header_roundtrip(spark, d):
    """Packet headers written and read: inclusion, zero bit planes, passes and lengths."""
    p = R.packets(spark, d).withColumn("block", F.col("k") % 12)
    b = p.groupBy("precinct", "layer", "block").agg(F.max(F.col("k") * 5 % 11).alias("zero"), F.max(F.col("length") % 40).alias("passes"), F.max("length").alias("length"))
    z = b.groupBy("precinct", "block").agg(F.max("zero").alias("zero_planes"))
    return B.header_roundtrip(b.drop("zero").withColumn("length", F.when(F.col("passes") > 0, F.col("length")).otherwise(0)).join(z, ["precinct", "block"]))


# ------------------------------------------------------------ files


@query(sql("regions", "select region::varchar path, true same, {n}::bigint n from regions".replace("{n}", str(4 + sum(4 + sum(n for _, n in parts) for _, _, parts, _ in SEGMENTS) + 2))))
def codestream_extract(spark, d):
    """Codestreams put into files and taken out again."""
    raw = streams(spark, d)
    back = M.extract(M.wrap(raw, 3))
    return raw.join(back.withColumnRenamed("content", "got"), "path").select("path", (F.col("content") == F.col("got")).alias("same"), F.octet_length("got").cast("long").alias("n"))


@query(sql("regions", "select region::varchar path, l::bigint as level, b box from regions, (values (0, 'jP  '), (0, 'ftyp'), (0, 'jp2h'), (1, 'ihdr'), (1, 'colr'), (0, 'jp2c'), (0, 'xml ')) t(l, b)"))
def jp2_write(spark, d):
    """Boxes of written files; a late box follows the codestream."""
    from tessera.sources import codestream as CS

    return CS.box_rows(M.wrap(streams(spark, d), 3, [("xml ", b"<x/>")])).select("path", "level", "box")


_GRID = ", size as (select max(y) h from wide), grid as (select x, y from range(0, 128) a(x), range(0, (select h + 1 from size)) b(y)) select c comp, g.y, g.x, coalesce(case c when 0 then r when 1 then w.g else b end, 0) v from grid g left join wide w using (x, y), unnest([0, 1, 2]) t(c)"


@query(sql("wide", _GRID))
def bmp_roundtrip(spark, d):
    """Samples to an uncompressed BMP file and back."""
    return RF.read_samples(RF.to_parts(R.rgb_img(spark, d), 8, kind="bmp").withColumnRenamed("name", "path")).select("comp", "y", "x", "v")


@query(sql("wide", _GRID))
def pam_roundtrip(spark, d):
    return RF.read_samples(RF.to_parts(R.rgb_img(spark, d), 8, kind="pam").withColumnRenamed("name", "path")).select("comp", "y", "x", "v")


@query(sql("regions", ", r as (select region k from regions), f as (select k, i, i // (k + 1) chunk from r, range(0, 3) t(i)) select k::varchar path, i::bigint frame, (k * 5000 + chunk * 77 + coalesce((select sum(k * 1000 + j) from range(0, 3) u(j) where j >= chunk * (k + 1) and j < i), 0))::bigint \"offset\", (k * 1000 + i)::bigint as size from f where chunk < 2"))
def frame_scan(spark, d):
    """Where each frame of each movie lies."""
    return M.frames(M.box_rows(files(spark, d)))


@query(sql("regions", ", r as (select region::varchar path, * from regions) select path, l::integer line, case l when 0 then format('image x0={} y0={} x1={} y1={}', x0, y0, x1, y1) when 1 then format('tiles {}x{} of 16x16', (x1 + 15) // 16, (y1 + 15) // 16) when 2 then format('components 3 transform {}', region % 2) else format('layers {} resolutions 3', region + 1) end as text from r, range(0, 4) t(l)"))
def header_dump(spark, d):
    from tessera.sources import codestream as CS

    return M.dump_lines(CS.images(streams(spark, d)))


@query(sql("wide", _GRID.replace("select c comp,", "select '0-' || c || '.pgm' path,")))
def split_components(spark, d):
    """Each component as a file of its own, and back."""
    img = R.rgb_img(spark, d).withColumn("image_id", F.concat_ws("-", "image_id", "comp")).withColumn("comp", F.lit(0))
    return RF.read_samples(RF.to_parts(img, 8).withColumnRenamed("name", "path")).select("path", "y", "x", "v")


# ------------------------------------------------------------ colour


def _odd(dy: int) -> str:
    """Chroma of a grid whose first line and column are odd."""
    zero = f"l.y < {dy - 1} or (l.x < 1 and (l.y - {dy - 1}) % {dy} = 0)"
    chroma = {"cb": f"case when {zero} then 0 else c.g end", "cr": f"case when {zero} then 0 else c.b end"}
    from tessera.plans.queries import _SYCC

    return sql("wide", f"select l.x, l.y, {_SYCC.format(y='l.r', **chroma)} from wide l left join wide c on c.x = greatest(l.x - 1, 0) // 2 and c.y = (l.y - {dy - 1}) // {dy} and l.y >= {dy - 1} where c.x is not null or {zero}")


def _chroma(spark, d, dy: int) -> DataFrame:
    w = R.rgb_wide(spark, d)
    return point.sycc_subsampled(w.select("x", "y", F.col("r").alias("l")), w.select("x", "y", F.col("g").alias("cb"), F.col("b").alias("cr")), 2, dy, 1, dy - 1)


@query(_odd(2))
def sycc420_odd(spark, d):
    return _chroma(spark, d, 2)


@query(_odd(1))
def sycc422_odd(spark, d):
    return _chroma(spark, d, 1)


@query("select r::bigint as row, c::bigint col, case when r = c then 1.0 else 0.0 end::double m from range(0, 3) a(r), range(0, 3) b(c)")
def matrix_inverse(spark, d):
    """A colour matrix times its inverse."""
    m = spark.createDataFrame([(r, c, v) for r, row in enumerate(point.PRIMARIES) for c, v in enumerate(row)], "row long, col long, m double")
    inverse = point.inverse(m)
    return m.join(inverse.select(F.col("row").alias("col"), F.col("col").alias("c"), F.col("m").alias("n")), "col").groupBy("row", F.col("c").alias("col")).agg((F.round(F.sum(F.col("m") * F.col("n")), 9) + 0.0).alias("m"))


# ------------------------------------------------------------ windows


@query(sql("regions", "select region, greatest(1, (x0 - 2) // 17)::bigint tx0, greatest(1, (y0 - 1) // 13)::bigint ty0, least(7, (x1 - 2 - 1) // 17 + 1)::bigint tx1, least(5, (y1 - 1 - 1) // 13 + 1)::bigint ty1 from regions where x1 > x0 and y1 > y0 and x0 >= 2 and y0 >= 1"))
def swath_tiles(spark, d):
    """Tiles under each window, within tile columns 1 to 7 and rows 1 to 5, on a grid that begins at (2, 1)."""
    r = R.regions(spark, d).where("x0 >= 2 and y0 >= 1")
    return S.window_tiles(r, (2, 1), (17, 13), (1, 1, 7, 5)).select("region", "tx0", "ty0", "tx1", "ty1")


@query(sql("regions", "select min(x0) x0, min(y0) y0, max(x1) x1, max(y1) y1, sum((x1 - x0) * (y1 - y0))::bigint area from (select x0 - 7 x0, y0 - 3 y0, x1 - 7 x1, y1 - 3 y1 from regions where x0 < x1 and y0 < y1)"))
def rect_union_pan(spark, d):
    """Rectangles relative to a place, their bounding one and their area."""
    return S.bounding(S.pan(R.regions(spark, d), 7, 3))


_STATE = "s as (select tile, tile % 3 layers, 1 + tile % 4 res from (select distinct tile from packets))"


@query(sql("packets", f", {_STATE} select p.tile, count(*) n, sum(length)::bigint bytes from packets p left join s using (tile) where p.layer < 4 and p.res <= 2 and (s.tile is null or s.tile % 5 = 0 or p.layer >= s.layers or p.res >= s.res) group by p.tile"))
def differential_packets(spark, d):
    """Packets that a finer view needs beyond what each tile was decoded with; every fifth tile was never decoded."""
    p = R.packets(spark, d)
    had = p.select("tile").distinct().where("tile % 5 != 0").select("tile", (F.col("tile") % 3).alias("layers"), (1 + F.col("tile") % 4).alias("res"))
    return P.newly_needed(p, had, 4, 3).groupBy("tile").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))


@query(sql("wide", "select n::integer band, (n * 200 + (y - 2) * 20 + (x - 5))::bigint place, case n when 1 then (r % 2) * 255 else least(255, r) end v from wide, (values (0), (1)) t(n) where x >= 5 and x < 25 and y >= 2 and y < 12"))
def swath_alpha(spark, d):
    """A band and an opacity of one bit, which becomes 0 or 255."""
    img = R.rgb_img(spark, d).where("comp = 0")
    both = img.unionByName(img.withColumn("comp", F.lit(1)).withColumn("v", F.col("v") % 2))
    return T.swath(both, (5, 2, 25, 12), [1, 2], alpha=2)


_NORMS = {("5/3", "LL"): (1.0, 1.5, 2.75, 5.375), ("5/3", "HL"): (1.038, 1.592, 2.919, 5.703), ("5/3", "HH"): (0.7186, 0.9218, 1.586, 3.043), ("9/7", "LL"): (1.0, 1.966, 4.122, 8.417)}


@query("select * from (values " + ", ".join(f"('{k}', '{b}', {i}::bigint, {round(v, 1)}::double)" for (k, b), row in _NORMS.items() for i, v in enumerate(row)) + ") t(kernel, band, \"level\", norm)")
def basis_norms(spark, d):
    """Lengths of the synthesis basis, from the kernels themselves; the SQL has the published values, to one digit."""
    rows = [(k, b, i, round(Wv.basis_norm(k, b, i), 1)) for k, b in _NORMS for i in range(4)]
    return spark.createDataFrame(rows, "kernel string, band string, level long, norm double")


@query(sql("wide rgb", "select comp, y, x, v from rgb where (y // 16) * 8 + x // 16 = 5"))
def single_tile(spark, d):
    img = R.rgb_img(spark, d)
    return S.single_tile(img, 5, 16, 16, 8, 8 * 1_000).select("comp", "y", "x", "v")


@query(sql("wide rgb", "select (y // 16) * 8 + x // 16 tile, comp, sum((v - v // 4 * 4) * (v - v // 4 * 4))::bigint distortion, count(*) n from rgb group by all"))
def tile_distortion(spark, d):
    """What dropping two bits costs each tile."""
    from tessera.operators import compare as C

    img = S.assign_tiles(R.rgb_img(spark, d), 16, 16, 8)
    return C.tile_distortion(img, img.withColumn("v", F.expr("v div 4 * 4")))


@query(sql("passes", "select cblk, count(*) as \"last\", sum(len)::bigint rate from passes group by cblk"))
def lossless_layer(spark, d):
    """One layer of all passes."""
    from tessera.operators import rate

    return rate.whole_layer(rate.cumulate(R.passes(spark, d)))
