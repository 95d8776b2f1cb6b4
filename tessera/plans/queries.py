"""The engine's queries over rasters derived from the driver's tables, each with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions import geometry as G
from tessera.operators import compare as C, packets as P, point, quant, rate, select as S, tiles as T, wavelet as Wv
from tessera.plans import rasters as R
from tessera.plans.rasters import sql
from tessera.sources import codestream as CS, rasterfiles as RF

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(text: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return add


# ------------------------------------------------------------ selection


@query(sql("wide rgb", "select comp, y, x, v from rgb where x >= 10 and x < 75 and y >= 3 and y < 41"))
def region_filter(spark, d):
    return S.region(R.rgb_img(spark, d), S.region_bounds((10, 3, 75, 500), 128, 41)).select("comp", "y", "x", "v")


@query(sql("emb", ", h as (select max(y) + 1 h from emb) select y, x, v from emb, h where x >= 16 and x < 48 and y >= floor(0.25 * h) and y < ceil(0.75 * h)"))
def region_fractional(spark, d):
    img = R.emb_grid(spark, d)
    height = img.agg(F.max("y")).first()[0] + 1
    return S.region(img, S.region_bounds((0.25, 0.25, 0.75, 0.75), 64, height)).select("y", "x", "v")


@query(sql("wide rgb", "select (y // 16) * 8 + x // 16 tile, comp, count(*) n, sum(v)::bigint total from rgb group by all"))
def tile_assign(spark, d):
    return S.assign_tiles(R.rgb_img(spark, d), 16, 16, 8).groupBy("tile", "comp").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query("select t tile, (t % 8) * 17 x0, (t // 8) * 13 y0, least((t % 8 + 1) * 17, 128) x1, least((t // 8 + 1) * 13, 79) y1 from range(0, 56) r(t)")
def tile_bounds(spark, d):
    return _tiles(spark)


def _tiles(spark) -> DataFrame:
    return S.tile_bounds(spark.range(56).withColumnRenamed("id", "tile"), 128, 79, 17, 13, 8).select("tile", *(F.col(c).cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")))


_TILES = "tiles as (select t tile, (t % 8) * 17 x0, (t // 8) * 13 y0, least((t % 8 + 1) * 17, 128) x1, least((t // 8 + 1) * 13, 79) y1 from range(0, 56) r(t))"


@query(sql("regions", f", {_TILES} select tile from tiles where exists (select 1 from regions r where greatest(r.x0, tiles.x0) < least(r.x1, tiles.x1) and greatest(r.y0, tiles.y0) < least(r.y1, tiles.y1))"))
def tile_slate_semi(spark, d):
    return S.slated_tiles(_tiles(spark), R.regions(spark, d)).select("tile")


@query(sql("regions trace", f", {_TILES}, cached as (select tile, max(step) % 2 = 1 dirty from trace group by tile) select tile from tiles t where exists (select 1 from regions r where greatest(r.x0, t.x0) < least(r.x1, t.x1) and greatest(r.y0, t.y0) < least(r.y1, t.y1)) and not exists (select 1 from cached c where c.tile = t.tile and not dirty)"))
def pending_tiles_anti(spark, d):
    cached = R.access_trace(spark, d).groupBy("tile").agg((F.max("step") % 2 == 1).alias("dirty"))
    return S.pending_tiles(S.slated_tiles(_tiles(spark), R.regions(spark, d)), cached).select("tile")


@query(sql("wide rgb", "select case comp when 2 then 0 else 1 end comp, sum(v)::bigint total, count(*) n from rgb where comp in (0, 2) group by 1"))
def component_project(spark, d):
    return S.project_components(R.rgb_img(spark, d), [2, 0]).groupBy("comp").agg(F.sum("v").alias("total"), F.count("*").alias("n"))


@query(sql("regions", "select *, x1 - x0 w, y1 - y0 h from (select region, (x0 + 3) >> 2 x0, (y0 + 3) >> 2 y0, (x1 + 3) >> 2 x1, (y1 + 3) >> 2 y1 from regions)"))
def reduce_geometry(spark, d):
    return S.reduce_geometry(R.regions(spark, d), 2)


@query(sql("regions", "select *, x1 - x0 w, y1 - y0 h from (select region, (x0 + 2) // 3 x0, (y0 + 1) // 2 y0, (x1 + 2) // 3 x1, (y1 + 1) // 2 y1 from regions)"))
def subsample_geometry(spark, d):
    return S.subsample_geometry(R.regions(spark, d), 3, 2)


@query(sql("packets", "select tile, count(*) n, sum(length)::bigint bytes from packets where layer < 3 group by tile"))
def layer_limit(spark, d):
    return S.limit_layers(R.packets(spark, d), 3).groupBy("tile").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))


@query(sql("packets", "select tile, max(layer + 1) layers, max(res + 1) had, max(layer + 1) <> max(res + 1) dirty from packets group by tile"))
def progression_state(spark, d):
    return S.progression_state(R.packets(spark, d).select("tile", (F.col("layer") + 1).alias("layers"), (F.col("res") + 1).alias("had")))


@query(sql("regions", "select a.region a, b.region b, greatest(a.x0, b.x0) x0, greatest(a.y0, b.y0) y0, least(a.x1, b.x1) x1, least(a.y1, b.y1) y1, least(a.x0, b.x0) ux0, greatest(a.x1, b.x1) ux1, greatest(a.x0 - 4, 0) gx0, least(a.x1 + 4, 128) gx1 from regions a join regions b on a.region < b.region where greatest(a.x0, b.x0) < least(a.x1, b.x1) and greatest(a.y0, b.y0) < least(a.y1, b.y1)"))
def rect_algebra(spark, d):
    r = R.regions(spark, d)  # 25 rows of a fixed table
    a, b = r.alias("a"), F.broadcast(r).alias("b")
    c = lambda n: F.col(n)
    j = a.join(b, (c("a.region") < c("b.region")) & G.meets(*(c(f"a.{n}") for n in ("x0", "y0", "x1", "y1")), *(c(f"b.{n}") for n in ("x0", "y0", "x1", "y1"))))
    x0, x1 = G.clip(c("a.x0"), c("a.x1"), c("b.x0"), c("b.x1"))
    y0, y1 = G.clip(c("a.y0"), c("a.y1"), c("b.y0"), c("b.y1"))
    g0, g1 = G.grow(c("a.x0"), c("a.x1"), 4, F.lit(0), F.lit(128))
    return j.select(c("a.region").alias("a"), c("b.region").alias("b"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), F.least("a.x0", "b.x0").alias("ux0"), F.greatest("a.x1", "b.x1").alias("ux1"), g0.alias("gx0"), g1.alias("gx1"))


# ------------------------------------------------------------ samples

_RGB = "wide rgb"


def _summed(df: DataFrame) -> DataFrame:
    return df.groupBy("comp").agg(F.sum("v").alias("total"), F.min("v").alias("least"), F.max("v").alias("greatest"), F.sum(F.col("v") * (F.col("x") + 1) + F.col("y")).alias("mixed"))


def _sum(v: str, src: str = "rgb") -> str:
    return f"select comp, sum(v)::bigint total, min(v) least, max(v) greatest, sum(v * (x + 1) + y)::bigint mixed from (select comp, y, x, {v} v from {src}) group by comp"


@query(sql("emb", "select y, x, greatest(-128, least(127, v)) v from emb"))
def clip_precision(spark, d):
    return point.clip_precision(R.emb_grid(spark, d), 8, True).select("y", "x", "v")


@query(sql("emb", "select y, x, v * 16 v from emb"))
def scale_up(spark, d):
    return point.scale_precision(R.emb_grid(spark, d), 8, 12).select("y", "x", "v")


@query(sql("emb", "select y, x, v // 8 v from emb"))
def scale_down(spark, d):
    return point.scale_precision(R.emb_grid(spark, d), 11, 8).select("y", "x", "v")


@query(sql("emb", "select y, x, cast(round(greatest(0::double, least(255::double, (v + 600)::double * (255.0::double / 1200.0::double) + 0.0::double))) as bigint) v from emb"))
def rescale_linear(spark, d):
    return point.rescale(R.emb_grid(spark, d), (-600, 600), (0, 255)).select("y", "x", "v")


@query(sql("wide rgb", "select comp, y, x, cast(round(greatest(0::double, least(100::double, (v)::double * (-100.0::double / 255.0::double) + 100.0::double))) as bigint) v from rgb"))
def rescale_reversed(spark, d):
    return point.rescale(R.rgb_img(spark, d), (0, 255), (100, 0)).select("comp", "y", "x", "v")


@query(sql(_RGB, _sum("greatest(0, least(255, v - 128 + 128))")))
def dc_shift(spark, d):
    return _summed(point.dc_unshift(point.dc_shift(R.rgb_img(spark, d), 8), 8))


@query(sql("wide", "select x, y, (r + 2 * g + b) >> 2 c0, b - g c1, r - g c2 from wide"))
def rct_forward(spark, d):
    return point.rct(R.rgb_wide(spark, d))


@query(sql("wide", "select x, y, r, g, b from wide"))
def rct_roundtrip(spark, d):
    return point.rct_inverse(point.rct(R.rgb_wide(spark, d)))


_ICT = "r * 0.299::double + g * 0.587::double + b * 0.114::double c0, r * -0.16875::double + g * -0.33126::double + b * 0.5::double c1, r * 0.5::double + g * -0.41869::double + b * -0.08131::double c2"


@query(sql("wide", f"select x, y, cast(floor(c0 * 16 + 0.5) as bigint) c0, cast(floor(c1 * 16 + 0.5) as bigint) c1, cast(floor(c2 * 16 + 0.5) as bigint) c2 from (select x, y, {_ICT} from wide)"))
def ict_forward_rounded(spark, d):
    w = point.ict(R.rgb_wide(spark, d))
    return w.select("x", "y", *(F.floor(F.col(c) * 16 + 0.5).cast("long").alias(c) for c in ("c0", "c1", "c2")))


@query(sql("wide", "select x, y, r, g, b from wide"))
def ict_roundtrip(spark, d):
    w = point.ict_inverse(point.ict(R.rgb_wide(spark, d)))
    return w.select("x", "y", *(F.round(c).cast("long").alias(c) for c in "rgb"))


_SYCC = "greatest(0, least(255, {y} + ((({cr} - 128) * 1505397801 + 536870912) >> 30))) r, greatest(0, least(255, {y} - ((({cb} - 128) * 369367187 + ({cr} - 128) * 766651662 + 536870912) >> 30))) g, greatest(0, least(255, {y} + ((({cb} - 128) * 1902670512 + 536870912) >> 30))) b"


@query(sql("wide", "select x, y, " + _SYCC.format(y="r", cb="g", cr="b") + " from wide"))
def sycc444_rgb(spark, d):
    return point.sycc444(R.rgb_wide(spark, d))


def _subsampled(dx: int, dy: int) -> str:
    return sql("wide", f"select l.x, l.y, {_SYCC.format(y='l.r', cb='c.g', cr='c.b')} from wide l join wide c on c.x = l.x // {dx} and c.y = l.y // {dy}")


@query(_subsampled(2, 2))
def sycc420_rgb(spark, d):
    w = R.rgb_wide(spark, d)
    return point.sycc_subsampled(w.select("x", "y", F.col("r").alias("l")), w.select("x", "y", F.col("g").alias("cb"), F.col("b").alias("cr")), 2, 2)


@query(_subsampled(2, 1))
def sycc422_rgb(spark, d):
    w = R.rgb_wide(spark, d)
    return point.sycc_subsampled(w.select("x", "y", F.col("r").alias("l")), w.select("x", "y", F.col("g").alias("cb"), F.col("b").alias("cr")), 2, 1)


@query(sql("wide", ", e as (select x, y, r::double l, (g - 128)::double u, (b - 128)::double w from wide) select x, y, " + ", ".join(f"greatest(0, least(255, cast(floor(greatest(l * {a}::double + u * {p}::double + w * {q}::double + 0.5::double, 0)) as bigint))) {n}" for n, (a, p, q) in zip("rgb", (("1.0", "-0.0000368", "1.40199"), ("1.0003", "-0.344125", "-0.7141128"), ("0.999823", "1.77204", "-0.000008")), strict=True)) + " from e"))
def esycc_rgb(spark, d):
    return point.esycc(R.rgb_wide(spark, d))


@query(sql("wide", "select x, y, cast(floor(255.0::double * (1.0::double - r / 255.0::double) * (1.0::double - x / 255.0::double)) as bigint) r, cast(floor(255.0::double * (1.0::double - g / 255.0::double) * (1.0::double - x / 255.0::double)) as bigint) g, cast(floor(255.0::double * (1.0::double - b / 255.0::double) * (1.0::double - x / 255.0::double)) as bigint) b from wide"))
def cmyk_rgb(spark, d):
    return point.cmyk_to_rgb(R.rgb_wide(spark, d).select("x", "y", F.col("r").alias("cc"), F.col("g").alias("cm"), F.col("b").alias("cy"), F.col("x").alias("k")))


@query(sql("wide rgb palette", "select comp, y, x, value v from rgb join palette on idx = least(v, 199)"))
def palette_lookup(spark, d):
    return point.apply_palette(R.rgb_img(spark, d), R.palette(spark, d), 200).select("comp", "y", "x", F.col("v"))


@query(sql(_RGB, _sum("v", "(select case comp when 0 then 2 when 2 then 0 else 1 end comp, y, x, v from rgb)")))
def channel_swap(spark, d):
    return _summed(point.swap_channels(R.rgb_img(spark, d), [(0, 3), (1, 2), (2, 1)]))


@query(sql(_RGB, _sum("v", "(select c comp, y, x, v from rgb, unnest([0, 1, 2]) t(c) where rgb.comp = 0)")))
def grey_to_rgb(spark, d):
    return _summed(point.grey_to_rgb(R.rgb_img(spark, d)))


@query(sql(_RGB, _sum("v", "(select comp, y * 2 + j y, x * 3 + i x, v from rgb, range(0, 3) a(i), range(0, 2) b(j))")))
def upsample(spark, d):
    return _summed(point.upsample(R.rgb_img(spark, d), 3, 2))


@query(sql("wide rgb palette", _sum("v", "(select c comp, y * 2 + j y, x * 2 + i x, least(15, cast(round(greatest(0::double, least(31::double, value::double * (31.0::double / 50.0::double) + 0.0::double))) as bigint)) v from (select y, x, value from rgb join palette on idx = least(v, 199) where comp = 0), unnest([0, 1, 2]) t(c), range(0, 2) a(i), range(0, 2) b(j))")))
def post_process_chain(spark, d):
    return _summed(point.post_process(R.rgb_img(spark, d), R.palette(spark, d), 200, grey=True, src=(0, 50), dst=(0, 31), prec=4, dx=2, dy=2))


@query(sql("wide", ", l as (select x, y, (r / 255.0::double) ** 2.2::double r, (g / 255.0::double) ** 2.2::double g, (b / 255.0::double) ** 2.2::double b from wide) select y, sum(cast(floor(pow((r * 0.2126729::double + g * 0.7151522::double + b * 0.072175::double) * (48.0::double / 52.37::double), 1 / 2.6::double) * 255 + 0.5) as bigint))::bigint luma from l group by y"))
def xyz_luma(spark, d):
    w = point.rgb_to_xyz(R.rgb_wide(spark, d), 8)
    return w.groupBy("y").agg(F.sum(F.floor(F.col("cy") + 0.5).cast("long")).alias("luma"))


@query(sql("wide", "select x, y, cast(floor(r * 0.5::double + g * 0.25::double + b * 0.25::double + 0.5) as bigint) c0, cast(floor(g * 0.5::double - b * 0.5::double + 0.5) as bigint) c1 from wide"))
def custom_mct(spark, d):
    out = point.custom_mct(R.rgb_img(spark, d), [[0.5, 0.25, 0.25], [0.0, 0.5, -0.5]])
    return out.groupBy("x", "y").agg(*(F.max(F.when(F.col("comp") == c, F.floor(F.col("v") + 0.5))).cast("long").alias(f"c{c}") for c in (0, 1)))


@query("select c col, sqrt(sum(m * m)) norm from (values (0, 0, 1.0::double), (0, 1, 0.0), (0, 2, 1.402), (1, 0, 1.0), (1, 1, -0.34413), (1, 2, -0.71414), (2, 0, 1.0), (2, 1, 1.772), (2, 2, 0.0)) t(r, c, m) group by c")
def mct_norms(spark, d):
    inverse = [(0, 0, 1.0), (0, 1, 0.0), (0, 2, 1.402), (1, 0, 1.0), (1, 1, -0.34413), (1, 2, -0.71414), (2, 0, 1.0), (2, 1, 1.772), (2, 2, 0.0)]
    return point.mct_norms(spark.createDataFrame(inverse, "row int, col int, m double"))


@query(sql(_RGB, ", h as (select max(y) + 1 h from rgb) select c comp, y, x, coalesce(v, 7) v from range(0, 3) a(c), range(0, 128) b(x), range(0, (select h from h)) e(y) left join rgb on comp = c and rgb.x = b.x and rgb.y = e.y where coalesce(v, 7) % 2 = 1".replace("y, x, coalesce(v, 7) v", "e.y, b.x, coalesce(v, 7) v")))
def uniform_join(spark, d):
    """A uniform image (the constructor) under the samples: of all its places the odd values; 7 where the last line lacks a sample."""
    img = R.rgb_img(spark, d)
    canvas = uniform(spark, 3, 128, img.agg(F.max("y")).first()[0] + 1, 7)
    both = canvas.withColumnRenamed("v", "own").join(img.select("comp", "y", "x", "v"), ["comp", "y", "x"], "left").select("comp", "y", "x", F.coalesce("v", "own").alias("v"))
    return both.where("v % 2 = 1")


def uniform(spark: SparkSession, comps: int, w: int, h: int, value: int) -> DataFrame:
    """An image whose samples are all equal."""
    i = spark.range(comps * w * h)
    return i.select(F.floor(F.col("id") / (w * h)).cast("int").alias("comp"), (F.floor(F.col("id") / w).cast("long") % h).alias("y"), (F.col("id") % w).alias("x"), F.lit(value).cast("long").alias("v"))


# ------------------------------------------------------------ wavelets


def _lift(src: str, out: str, axis: str, steps: list[tuple[int, str]], keys: str = "") -> str:
    """CTEs of lifting steps; formulas over v, a and b."""
    other = "x" if axis == "y" else "y"
    w = f"over (partition by {keys}{other} order by {axis})"
    ctes, now = [], src
    for i, (parity, formula) in enumerate(steps):
        nxt = out if i == len(steps) - 1 else f"{out}_{i}"
        ctes.append(f"{nxt}_n as (select *, coalesce(lag(v) {w}, lead(v) {w}) a, coalesce(lead(v) {w}, lag(v) {w}) b from {now}), {nxt} as (select * exclude (v, a, b), case when {axis} % 2 = {parity} and a is not null then {formula} else v end v from {nxt}_n)")
        now = nxt
    return ", ".join(ctes)


_F53, _I53 = [(1, "v - ((a + b) >> 1)"), (0, "v + ((a + b + 2) >> 2)")], [(0, "v - ((a + b + 2) >> 2)"), (1, "v + ((a + b) >> 1)")]


@query(sql("emb", f", {_lift('emb', 'h', 'x', _F53)} select y, x, v from h"))
def dwt53_h(spark, d):
    return Wv.dwt53(R.emb_grid(spark, d), "x", ["image_id", "comp"]).select("y", "x", "v")


@query(sql(_RGB, f", {_lift('rgb', 'h', 'y', _F53, 'comp, ')} select comp, y, x, v from h"))
def dwt53_v(spark, d):
    return Wv.dwt53(R.rgb_img(spark, d), "y", ["image_id", "comp"]).select("comp", "y", "x", "v")


_BAND = "case x % 2 when 0 then 'L' else 'H' end || case y % 2 when 0 then 'L' else 'H' end"


@query(sql("emb", f", {_lift('emb', 'c', 'y', _F53)}, {_lift('c', 'h', 'x', _F53)} select {_BAND} band, count(*) n, sum(v * v)::bigint energy, max(abs(v)) peak from h group by 1"))
def dwt53_2d_energy(spark, d):
    bands = Wv.split_bands(Wv.forward_2d(R.emb_grid(spark, d), ["image_id", "comp"]))
    return bands.groupBy("band").agg(F.count("*").alias("n"), F.sum(F.col("v") * F.col("v")).alias("energy"), F.max(F.abs("v")).alias("peak"))


@query(sql("emb", "select y, x, v from emb"))
def dwt53_roundtrip(spark, d):
    keys = ["image_id", "comp"]
    return Wv.inverse_2d(Wv.join_bands(Wv.split_bands(Wv.forward_2d(R.emb_grid(spark, d), keys))), keys).select("y", "x", "v")


@query(sql("emb", f", {_lift('emb', 'c', 'y', _F53)}, {_lift('c', 'h', 'x', _F53)}, ll as (select y // 2 y, x // 2 x, v from h where x % 2 = 0 and y % 2 = 0), {_lift('ll', 'c2', 'y', _F53)}, {_lift('c2', 'h2', 'x', _F53)} select 1 as level, {_BAND} band, count(*) n, sum(v * v)::bigint energy from h where {_BAND} <> 'LL' group by 2 union all select 2, {_BAND}, count(*), sum(v * v)::bigint from h2 group by 2"))
def dwt53_multilevel(spark, d):
    out = Wv.forward_levels(R.emb_grid(spark, d), ["image_id", "comp"], 2)
    return out.groupBy("level", "band").agg(F.count("*").alias("n"), F.sum(F.col("v") * F.col("v")).alias("energy"))


@query(sql("emb", "select y, x, v from emb"))
def dwt53_multilevel_roundtrip(spark, d):
    keys = ["image_id", "comp"]
    return Wv.inverse_levels(Wv.forward_levels(R.emb_grid(spark, d), keys, 3), keys, 3).select("y", "x", "v")


_F97 = [(p, f"v + ({k!r})::double * (a + b)") for p, k in ((1, Wv.ALPHA), (0, Wv.BETA), (1, Wv.GAMMA), (0, Wv.DELTA))]


@query(sql("emb", f", e as (select y, x, v::double v from emb), {_lift('e', 'c', 'y', _F97)}, cs as (select y, x, case when y % 2 = 0 then v / {Wv.KAPPA!r}::double else v * {Wv.KAPPA!r}::double end v from c), {_lift('cs', 'h', 'x', _F97)}, hs as (select y, x, case when x % 2 = 0 then v / {Wv.KAPPA!r}::double else v * {Wv.KAPPA!r}::double end v from h) select {_BAND} band, count(*) n, cast(round(sum(v * v) / 100) as bigint) energy from hs group by 1"))
def dwt97_energy(spark, d):
    e = R.emb_grid(spark, d).withColumn("v", F.col("v").cast("double"))
    bands = Wv.split_bands(Wv.forward_2d(e, ["image_id", "comp"], Wv.dwt97))
    return bands.groupBy("band").agg(F.count("*").alias("n"), F.round(F.sum(F.col("v") * F.col("v")) / 100).cast("long").alias("energy"))


@query(sql("emb", "select y, x, v from emb"))
def dwt97_roundtrip(spark, d):
    keys = ["image_id", "comp"]
    e = R.emb_grid(spark, d).withColumn("v", F.col("v").cast("double"))
    return Wv.inverse_2d(Wv.forward_2d(e, keys, Wv.dwt97), keys, Wv.idwt97).select("y", "x", F.round("v").cast("long").alias("v"))


@query(sql("emb", "select y, x, v from emb where x >= 13 and x < 41 and y >= 100 and y < 207"))
def partial_idwt(spark, d):
    keys = ["image_id", "comp"]
    return Wv.inverse_region(Wv.forward_2d(R.emb_grid(spark, d), keys), keys, (13, 100, 41, 207), (64, 1 << 40)).select("y", "x", "v")


@query(sql("emb", f", b as (select y // 50 tile, y % 50 y, x, v from emb), {_lift('b', 'c', 'y', _F53, 'tile, ')}, {_lift('c', 'h', 'x', _F53, 'tile, ')} select tile, sum(v * (x + 1) * (y + 1))::bigint mixed, sum(v * v)::bigint energy from h group by tile"))
def dwt53_blocks(spark, d):
    """The block form: one array for each tile, transformed by numpy in Arrow batches."""
    e = R.emb_grid(spark, d).withColumn("tile", F.floor(F.col("y") / 50).cast("long"))
    data = F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "v"))), lambda s: s["v"].cast("int"))
    blocks = e.groupBy("image_id", "comp", "tile").agg(data.alias("data"), F.countDistinct("y").cast("int").alias("h")).withColumn("w", F.lit(64))
    flat = Wv.dwt53_blocks(blocks).select("tile", F.posexplode("data").alias("i", "v"))
    return flat.groupBy("tile").agg(F.sum(F.col("v").cast("long") * (F.col("i") % 64 + 1) * (F.floor(F.col("i") / 64) + 1)).cast("long").alias("mixed"), F.sum(F.col("v").cast("long") * F.col("v")).alias("energy"))


# ------------------------------------------------------------ quantization


@query("""with b as (select l as level, o as orient, case o when 0 then 0 when 3 then 2 else 1 end gain, 1.0::double + l * 1.37::double + o * 0.21::double norm from range(1, 6) a(l), range(0, 4) c(o)),
s as (select *, floor(1.0::double * (1.0::double / norm) * 8192.0::double) step from b), q as (select *, cast(floor(log2(step)) as bigint) f from s)
select level, orient, cast(step as bigint) step, 8 + gain - (f - 13) expn, cast(case when 11 - f < 0 then floor(step / pow(2.0::double, f - 11)) else floor(step * pow(2.0::double, 11 - f)) end as bigint) % 2048 mant from q""")
def quant_steps(spark, d):
    b = spark.range(1, 6).withColumnRenamed("id", "level").withColumn("orient", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    b = b.withColumn("gain", F.when(F.col("orient") == 0, 0).when(F.col("orient") == 3, 2).otherwise(1).cast("long")).withColumn("norm", F.lit(1.0) + F.col("level") * 1.37 + F.col("orient") * 0.21)
    return quant.band_steps(b)


@query(sql("emb", "select y, x, v // 2 v from emb"))
def dequant_rev(spark, d):
    return quant.dequantize_reversible(R.emb_grid(spark, d)).select("y", "x", "v")


@query(sql("emb", "select y, x, cast(greatest(-32768, least(32767, round(v * (40.5::double / 2)))) as bigint) v from emb"))
def dequant_narrow(spark, d):
    return quant.narrow(quant.dequantize(R.emb_grid(spark, d), 40.5)).select("y", "x", "v")


@query(sql("emb", "select y, x, case when abs(v) >= 64 then cast(sign(v) as bigint) * (abs(v) >> 6) else v end v from emb"))
def roi_unshift(spark, d):
    return quant.unshift_roi(R.emb_grid(spark, d), 6).select("y", "x", "v")


@query(sql("emb", "select y // 16 bj, x // 16 bi, max(abs(v)) top, case when max(abs(v)) > 0 then cast(length(bin(max(abs(v)))) as bigint) else 0 end planes from emb group by all"))
def block_magnitudes(spark, d):
    e = R.emb_grid(spark, d).withColumn("bj", F.floor(F.col("y") / 16).cast("long")).withColumn("bi", F.floor(F.col("x") / 16).cast("long"))
    return quant.magnitudes(e, ["bj", "bi"])


@query(sql("emb", "select l as level, y >> l y, x >> l x, min(v) v from emb, range(0, 4) r(l) group by all"))
def tagtree_min(spark, d):
    return quant.tag_tree(R.emb_grid(spark, d).select("x", "y", "v"), 3).select(F.col("level").cast("long").alias("level"), "y", "x", "v")


# ------------------------------------------------------------ packets


def _progression(name: str) -> None:
    keys = P.ORDERS[name] + [k for k in ("precinct", "k") if k not in P.ORDERS[name]]
    text = sql("packets", f"select tile, k, row_number() over (partition by tile order by {', '.join(keys)}) - 1 seq from packets")

    def run(spark, d):
        return P.progress(R.packets(spark, d), name).select("tile", "k", "seq")

    run.__name__ = f"prog_{name.lower()}"
    query(text)(run)


for _name in P.ORDERS:
    _progression(_name)


@query(sql("packets", """, h as (select *, case when res < 2 and comp < 3 and layer < 3 then 0 when res < 4 and comp < 2 and layer < 5 then 1 when res < 4 and comp < 3 and layer < 5 then 2 end poc from packets),
r as (select *, case when poc = 1 then row_number() over (partition by tile, poc order by res, py, px, comp, layer, precinct, k) else row_number() over (partition by tile, poc order by layer, res, comp, precinct, k) end rank from h where poc is not null)
select tile, k, poc, row_number() over (partition by tile order by poc, rank) - 1 seq from r"""))
def poc_dedup(spark, d):
    changes = [(0, 0, 3, 2, 3, 0, "LRCP"), (0, 0, 5, 4, 2, 1, "RPCL"), (0, 0, 5, 4, 3, 2, "LRCP")]
    return P.change_order(R.packets(spark, d), changes).select("tile", "k", "poc", "seq")


@query(sql("tile_parts", "select seq, tile, coalesce(sum(length) over (partition by tile order by seq rows between unbounded preceding and 1 preceding), 0)::bigint as \"offset\" from tile_parts"))
def tlm_offsets(spark, d):
    return P.offsets(R.tile_parts(spark, d)).select("seq", "tile", "offset")


@query(sql("tile_parts", "select seq, tile, coalesce(sum(length) over (order by seq rows between unbounded preceding and 1 preceding), 0)::bigint as \"offset\" from tile_parts"))
def stream_offsets(spark, d):
    return P.offsets_in_stream(R.tile_parts(spark, d)).select("seq", "tile", "offset")


_LRCP = "q as (select *, row_number() over (partition by tile order by layer, res, comp, precinct, k) - 1 seq from packets)"


@query(sql("packets", f", {_LRCP} select tile, seq, sum(length) over (partition by tile order by seq rows between current row and 3 following)::bigint popped from q"))
def plt_pop(spark, d):
    return P.pop_lengths(P.progress(R.packets(spark, d), "LRCP"), 4).select("tile", "seq", "popped")


@query(sql("packets", "select tile, sum(cast(ceil(length(bin(length)) / 7.0::double) as bigint))::bigint plt_bytes from packets group by tile"))
def plt_bytes(spark, d):
    return P.varint_bytes(R.packets(spark, d)).groupBy("tile").agg(F.sum("plt_bytes").alias("plt_bytes"))


@query(sql("packets", "select tile, count(*) packets, sum(length)::bigint bytes from packets group by tile"))
def total_packets(spark, d):
    return P.total_packets(R.packets(spark, d))


_OFF = f"{_LRCP}, o as (select *, coalesce(sum(length) over (partition by tile order by seq rows between unbounded preceding and 1 preceding), 0)::bigint as off from q)"
_RANGES = f"{_OFF}, w as (select *, max(off + length) over (partition by tile order by off rows between unbounded preceding and 1 preceding) e from o where res <= 2 and layer < 4), n as (select *, sum(case when e is null or off - e > 200000 then 1 else 0 end) over (partition by tile order by off rows unbounded preceding)::bigint rg from w), f as (select tile, rg as \"range\", min(off) as \"start\", max(off + length) as \"end\", count(*) packets from n group by all)"


def _ranges(spark, d):
    placed = P.offsets(P.progress(R.packets(spark, d), "LRCP"))
    return P.fetch_ranges(P.packet_mask(placed, 2, 4, [0, 1, 2]).where("wanted"), 200000)


@query(sql("packets", f", {_RANGES} select * from f"))
def fetch_ranges(spark, d):
    return _ranges(spark, d)


@query(sql("packets", f", {_RANGES} select tile, \"range\", c chunk from f, unnest(range(\"start\" // 1048576, (\"end\" - 1) // 1048576 + 1)) t(c)"))
def chunk_cover(spark, d):
    return P.chunks(_ranges(spark, d), 1 << 20).select("tile", "range", "chunk")


def _transcoded(where: str, order: str, extra: int) -> str:
    keys = ", ".join(P.ORDERS[order] + [k for k in ("precinct", "k") if k not in P.ORDERS[order]])
    return sql("packets", f", q as (select tile, k, length + {extra} length, row_number() over (partition by tile order by {keys}) - 1 seq from packets where {where}) select tile, k, seq, length, coalesce(sum(length) over (partition by tile order by seq rows between unbounded preceding and 1 preceding), 0)::bigint as \"offset\" from q")


_T = ["tile", "k", "seq", "length", "offset"]


@query(_transcoded("layer < 2", "LRCP", 8))
def transcode_layers(spark, d):
    return P.transcode(R.packets(spark, d), max_layers=2, sop=True, eph=True).select(*_T)


@query(_transcoded("res <= 1", "RLCP", 6))
def transcode_res(spark, d):
    return P.transcode(R.packets(spark, d), "RLCP", max_res=1, sop=True).select(*_T)


@query(_transcoded("true", "CPRL", 0))
def transcode_reorder(spark, d):
    return P.transcode(R.packets(spark, d), "CPRL").select(*_T)


@query(sql("packets", "select tile, dense_rank() over (partition by tile order by res) - 1 part, res, count(*) n, sum(length)::bigint bytes from packets group by tile, res"))
def tile_parts_by_res(spark, d):
    return P.tile_parts_by(R.packets(spark, d), "res").groupBy("tile", F.col("part").cast("long").alias("part"), "res").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))


@query(sql("regions", "select region, case when x1 > x0 then cast(ceil(x1 / 16.0::double) - floor(x0 / 16.0::double) as bigint) else 0 end pw, case when y1 > y0 then cast(ceil(y1 / 16.0::double) - floor(y0 / 16.0::double) as bigint) else 0 end ph from regions"))
def precinct_grid(spark, d):
    return P.precinct_grid(R.regions(spark, d), 4).select("region", "pw", "ph")


@query(sql("tile_parts", ", o as (select seq, length, coalesce(sum(length) over (order by seq rows between unbounded preceding and 1 preceding), 0)::bigint off from tile_parts), a as (select seq * 100003 p from tile_parts) select p as \"at\", o.seq, p - off as \"within\" from a join o on p >= off and p < off + length"))
def seek_parts(spark, d):
    parts = R.tile_parts(spark, d)
    return P.seek(parts.select((F.col("seq") * 100003).alias("at")), P.offsets_in_stream(parts))


# ------------------------------------------------------------ rate control

_CUM = "c as (select *, sum(len) over (partition by cblk order by pass)::bigint rate, sum(dist) over (partition by cblk order by pass)::bigint saved, dist::double / len slope from passes)"


def _cum(spark, d):
    return rate.first_slopes(rate.cumulate(R.passes(spark, d)))


_LOG = "greatest(1, least(65535, cast(floor(ln(least({0}, 18446744073709551616.0::double)) * (256 / ln(2.0::double)) - ln(18446744073709551616.0::double) * (256 / ln(2.0::double)) + 65536) as bigint)))"
#: The hull, a pass at a time: the last feasible point goes while the new slope is as steep, and once more if both have one place in the log domain.
_HULL = f"""with recursive {R.SQL["passes"]}, {_CUM}, k as (
  select cblk, 1::bigint i, []::struct(pass bigint, rate bigint, saved bigint, slope double, place bigint)[] kept from (select distinct cblk from c)
  union all
  select cblk, case when pop then i else i + 1 end, case when pop then kept[1:len(kept) - 1] else list_append(case when place >= kept[-1].place then kept[1:len(kept) - 1] else kept end, {{'pass': i, 'rate': rate, 'saved': saved, 'slope': slope, 'place': place}}) end
  from (select *, coalesce(kept[-1].slope * dr <= dd, false) pop, dd / dr slope, {_LOG.format("dd / dr")} place
    from (select k.cblk, k.i, k.kept, c.rate, c.saved, (c.rate - coalesce(kept[-1].rate, 0))::double dr, (c.saved - coalesce(kept[-1].saved, 0))::double dd from k join c on c.cblk = k.cblk and c.pass = k.i))),
h as (select cblk, unnest(kept, recursive := true) from (select cblk, max_by(kept, i) kept from k group by cblk)),
hull as (select c.cblk, c.pass, c.rate, c.saved, coalesce(h.slope, 0) slope, coalesce(h.place, 0)::bigint logslope from c left join h using (cblk, pass))"""
#: A block's passes up to the first feasible one that is no steeper than t.
_UPTO = "(select cblk, max(pass) \"last\", max_by(rate, pass) rate from (select *, min(pass) filter (logslope > 0 and logslope <= {0}) over (partition by cblk) flat from hull) where logslope > {0} and (flat is null or pass < flat) group by cblk)"


def _hulled(spark, d):
    return rate.hull_slopes(rate.cumulate(R.passes(spark, d)))


@query(f"{_HULL} select * from {_UPTO.format(50258)}")
def make_layer(spark, d):
    return rate.make_layer(_hulled(spark, d), 50258)


@query(f"{_HULL}, s as (select (select coalesce(sum(rate), 0)::bigint from {_UPTO.format(51108)}) t0, (select coalesce(sum(rate), 0)::bigint from {_UPTO.format(50596)}) t1, (select coalesce(sum(rate), 0)::bigint from {_UPTO.format(49746)}) t2) select 0 as layer, t0 bytes, t0 upto from s union all select 1, t1 - t0, t1 from s union all select 2, t2 - t1, t2 from s")
def layer_alloc(spark, d):
    return rate.allocate_layers(_hulled(spark, d), [51108, 50596, 49746])


@query(f"{_HULL} select * from hull")
def hull_slopes(spark, d):
    return _hulled(spark, d)


@query(f"{_HULL}, a as (select logslope, rate - coalesce(lag(rate) over (partition by cblk order by pass), 0) add from hull where logslope > 0), b as (select logslope, sum(add) bytes from a group by 1), u as (select logslope, (sum(bytes) over (order by logslope desc))::bigint upto from b) select coalesce(max(logslope) filter (upto > 100000), 0)::bigint threshold, coalesce(max(upto) filter (upto <= 100000), 0)::bigint bytes from u")
def pcrd_threshold(spark, d):
    return rate.threshold_for(_hulled(spark, d), 100_000)


@query(sql("passes", f", {_CUM} select min(slope) least, max(slope) greatest from c where slope > 0"))
def slope_bounds(spark, d):
    return rate.slope_bounds(_cum(spark, d))


@query(sql("passes", f", {_CUM} select cblk, pass, {_LOG.format('slope')} logslope from c"))
def log_slope(spark, d):
    return rate.log_slope(_cum(spark, d)).select("cblk", "pass", "logslope")


# ------------------------------------------------------------ tiles


@query(sql(_RGB, ", t as (select (y // 16) * 8 + x // 16 tile, comp, y, x, v from rgb), p as (select comp, y, x, v from t where tile % 3 <> 0) select comp, count(*) n, sum(coalesce(p.v, 0))::bigint total, sum(case when p.v is null then 1 else 0 end)::bigint blank from (select comp, y, x from rgb) c left join p using (comp, y, x) group by comp"))
def composite_tiles(spark, d):
    img = R.rgb_img(spark, d)
    tiles = S.assign_tiles(img, 16, 16, 8).where("tile % 3 != 0")
    out = T.composite(tiles, img.select("comp", "y", "x")).join(tiles.select("comp", "y", "x", F.lit(1).alias("one")), ["comp", "y", "x"], "left")
    return out.groupBy("comp").agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.sum(F.when(F.col("one").isNull(), 1).otherwise(0)).alias("blank"))


@query(sql(_RGB, "select b::integer band, (b * 200 + (y - 2) * 20 + (x - 5))::bigint place, greatest(0, least(255, v * 2 - 100)) v from (select 0 b, 2 c union all select 1, 0) m join rgb on comp = c where x >= 5 and x < 25 and y >= 2 and y < 12"))
def swath_copy(spark, d):
    return T.swath(R.rgb_img(spark, d).withColumn("v", F.col("v") * 2 - 100), (5, 2, 25, 12), [3, 1])


@query(sql("trace", ", u as (select cache, step, tile, lag(step) over (partition by cache, tile order by step) as last from trace) select cache, step, tile, last is not null and (select count(distinct t.tile) from u t where t.cache = u.cache and t.step > u.last and t.step < u.step) < 6 hit from u"))
def lru_trace(spark, d):
    return T.lru_trace(R.access_trace(spark, d), 6)


@query("with recursive " + R.SQL["trace"] + """, c as (
  select cache, 1::bigint step, null::bigint tile, null::boolean hit, []::struct(tile bigint, size bigint)[] held from (select distinct cache from trace)
  union all
  select cache, step + 1, asked, was, list_filter(now, lambda x, i: i = len(now) or list_sum(list_transform(now[i:], lambda e: e.size)) <= 40)
  from (select c.cache, c.step, t.tile asked, len(list_filter(held, lambda e: e.tile = t.tile)) > 0 was, list_append(list_filter(held, lambda e: e.tile <> t.tile), {'tile': t.tile, 'size': 1 + t.tile % 7}) now
    from c join trace t on t.cache = c.cache and t.step = c.step))
select cache, step - 1 step, tile, hit from c where tile is not null""")
def lru_bytes(spark, d):
    return T.lru_bytes(R.access_trace(spark, d).withColumn("size", 1 + F.col("tile") % 7), 40)


_DONE = "done as (select (event_id // 4) % 50 as row, event_id % 4 tile, event_id e from events)"


def _done(spark, d):
    e = F.col("event_id").cast("long")
    return R.table(spark, d, "events").select((F.floor(e / 4).cast("long") % 50).alias("row"), (e % 4).alias("tile"), e.alias("at"))


_FIRST = f"{_DONE}, first as (select row, tile, min(e) e from done group by all), rows_ as (select row, count(*) tiles, max(e) as \"at\" from first group by row having count(*) = 4)"


@query(f"with {_FIRST} select * from rows_")
def row_completion(spark, d):
    return T.row_completion(_done(spark, d), 4)


@query(f"with {_FIRST} select *, max(\"at\") over (order by row rows unbounded preceding) emitted from rows_")
def band_order(spark, d):
    return T.band_order(T.row_completion(_done(spark, d), 4))


@query(f"with {_FIRST}, s as (select w swath, w * 3 lo, w * 3 + 4 hi from range(0, 15) t(w)) select swath, max(e) ready, count(*) tiles from s join first on row >= lo and row <= hi group by swath")
def swath_wait(spark, d):
    first = _done(spark, d).groupBy("row", "tile").agg(F.min("at").alias("at"))
    swaths = spark.range(15).select(F.col("id").alias("swath"), (F.col("id") * 3).alias("lo"), (F.col("id") * 3 + 4).alias("hi"))
    return T.swath_wait(swaths, first)


@query("with d as (select distinct event_id // 3 n from events where event_id % 7 <> 5), r as (select n, row_number() over (order by n) - 1 k from d) select n as row, k n from r where n = k")
def contiguous_prefix(spark, d):
    done = R.table(spark, d, "events").where("event_id % 7 != 5").select(F.floor(F.col("event_id") / 3).cast("long").alias("row"))
    return T.contiguous(done).select("row", F.col("n").cast("long").alias("n"))


@query("select doc_id % 16 stream, doc_id piece, coalesce(sum(n_chars) over (partition by doc_id % 16 order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as \"offset\" from documents")
def sparse_buffer(spark, d):
    docs = R.table(spark, d, "documents").select((F.col("doc_id") % 16).alias("stream"), F.col("doc_id").alias("piece"), F.col("n_chars").alias("length"))
    return T.chunk_places(docs).select("stream", "piece", "offset")


@query(sql("wide", "select y, x, [r, g, b] pixel from wide"))
def pack_interleave(spark, d):
    return T.pack_interleaved(R.rgb_img(spark, d))


@query(sql(_RGB, "select comp, y, x, v from rgb"))
def unpack_deinterleave(spark, d):
    return T.unpack_interleaved(T.pack_interleaved(R.rgb_img(spark, d))).select("comp", "y", "x", "v")


# ------------------------------------------------------------ comparison


@query(sql(_RGB, ", o as (select comp, y, x, v // 4 * 4 w from rgb) select comp, sum(case when v <> w then 1 else 0 end)::bigint differ, max(abs(v - w)) peak, sum((v - w) * (v - w))::double / count(*) mse, 0::bigint unmatched from rgb join o using (comp, y, x) group by comp"))
def compare_mse_peak(spark, d):
    img = R.rgb_img(spark, d)
    return C.compare(img, point.scale_precision(point.scale_precision(img, 8, 6), 6, 8))


@query(sql(_RGB, "select comp, 0::bigint differ, 0::bigint peak, 0.0::double mse, 0::bigint unmatched from rgb group by comp"))
def compare_region(spark, d):
    """The crop of a whole image against the region of its tiles."""
    img, b = R.rgb_img(spark, d), (20, 5, 90, 33)
    return C.compare(S.region(img, b), S.tile_region(S.assign_tiles(img, 16, 16, 8), b, 16, 16, 8))


@query(sql("regions", "select region % 5 image_id, count(distinct (x1 - x0)) = 1 as same, count(*) components from regions group by 1"))
def image_equal(spark, d):
    r = R.regions(spark, d).select((F.col("region") % 5).alias("image_id"), (F.col("x1") - F.col("x0")).alias("w"), F.lit(1).alias("h"), F.lit(1).alias("dx"), F.lit(1).alias("dy"), F.lit(8).alias("prec"), F.lit(False).alias("sgnd"))
    return C.same_components(r)


@query(sql(_RGB, ", l as (select image_id, comp, y, md5(string_agg(v::varchar, ',' order by x)) m from rgb group by all) select image_id, comp, md5(string_agg(m, '' order by y)) md5 from l group by all"))
def canon_md5(spark, d):
    return C.canonical(R.rgb_img(spark, d))


@query(sql("wide", ", a as (select x, y, r from wide where y % 5 <> 2), b as (select x, y, r from wide where y % 5 <> 3) select x, y, r, 'left' side from (select * from a except all select * from b) union all select x, y, r, 'right' from (select * from b except all select * from a)"))
def dump_difference(spark, d):
    """Each line is in one dump at least."""
    w = R.rgb_wide(spark, d).select("x", "y", "r")
    return C.same_rows(w.where("y % 5 != 2"), w.where("y % 5 != 3"))


# ------------------------------------------------------------ sources and sinks


def _streams(spark, d) -> DataFrame:
    """Codestreams with a header and one empty tile part for each region, made for the scan."""
    r = R.regions(spark, d).select("region", "x0", "y0", "x1", "y1")
    head = F.concat(F.lit("FF4FFF51002F0000"), *(F.lpad(F.hex(c), 8, "0") for c in ("x1", "y1", "x0", "y0")), F.lit("00000010000000100000000000000000"), F.lit("0003"), F.lit("070101" * 3), F.lit("FF52000C00020005000504040001"), F.lit("FF90000A00000000000E0001FF93FFD9"))
    return r.select(F.col("region").cast("string").alias("path"), F.unhex(head).alias("content"))


@query(sql("regions", ", m as (select * from (values ('SOC', 0, 2), ('SIZ', 2, 49), ('COD', 51, 14), ('SOT', 65, 12), ('SOD', 77, 2), ('EOC', 79, 2)) t(marker, pos, length)) select region::varchar path, marker, pos::bigint pos, length::bigint length from regions, m"))
def marker_scan(spark, d):
    return CS.marker_rows(_streams(spark, d))


@query(sql("regions", "select region::varchar path, x0, y0, x1, y1, 16::bigint tw, 16::bigint th, 3::bigint numcomps, 5::bigint layers, 6::bigint numres, 0::bigint mct from regions"))
def header_read(spark, d):
    return CS.images(_streams(spark, d))


@query(sql("regions", "select region::varchar path, c comp, 8::bigint prec, false sgnd, 1::bigint dx, 1::bigint dy from regions, range(0, 3) t(c)"))
def component_read(spark, d):
    return CS.components(_streams(spark, d))


@query(sql("regions", "select region::varchar path, case region % 4 when 0 then 'J2K' when 1 then 'JP2' when 2 then 'MJ2' else 'UNK' end fmt from regions"))
def format_detect(spark, d):
    jp2 = F.lit("0000000C6A5020200D0A870A0000001466747970")
    r = R.regions(spark, d)
    content = F.unhex(F.when(F.col("region") % 4 == 0, F.lit("FF4FFF510029")).when(F.col("region") % 4 == 1, F.concat(jp2, F.lit("6A703220"))).when(F.col("region") % 4 == 2, F.concat(jp2, F.lit("6D6A7032"))).otherwise(F.lit("89504E47")))
    return r.select(F.col("region").cast("string").alias("path"), CS.detect(content).alias("fmt"))


@query("select page_id, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/]+)/?(.*)$', 1) scheme, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/]+)/?(.*)$', 2) bucket, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/]+)/?(.*)$', 3) object from pages")
def url_parse(spark, d):
    parts = CS.url_parts(F.col("url"))
    return R.table(spark, d, "pages").select("page_id", *(c.alias(n) for n, c in parts.items()))


@query("with r as (select event_id % 5 movie, event_id entry, user_id % 4 n, cast(floor(value) as bigint) v from events), p as (select *, coalesce(sum(n) over (partition by movie order by entry rows between unbounded preceding and 1 preceding), 0)::bigint f from r) select movie, f + i frame, v from p, unnest(range(0, n)) t(i)")
def mj2_decompact(spark, d):
    e = R.table(spark, d, "events")
    return CS.decompact(e.select((F.col("event_id") % 5).alias("movie"), F.col("event_id").alias("entry"), (F.col("user_id") % 4).cast("long").alias("n"), F.floor("value").cast("long").alias("v")))


@query(sql("wide", ", size as (select max(y) h from wide), grid as (select x, y from range(0, 128) a(x), range(0, (select h + 1 from size)) b(y)) select c comp, g.y, g.x, coalesce(case c when 0 then r when 1 then w.g else b end, 0) v from grid g left join wide w using (x, y), unnest([0, 1, 2]) t(c)"))
def pnm_roundtrip(spark, d):
    """Samples to a PNM file's bytes and back; what the ragged last line lacks is 0."""
    files = RF.to_parts(R.rgb_img(spark, d), 8)
    return RF.read_samples(files.withColumnRenamed("name", "path")).select("comp", "y", "x", "v")


@query(sql("regions", "select region::varchar path, l as level, b box, n from regions, (values (0, 'jP  ', 1), (0, 'ftyp', 1), (0, 'jp2h', 1), (1, 'ihdr', 1), (1, 'colr', 1), (0, 'jp2c', 1)) t(l, b, n)"))
def box_scan(spark, d):
    ihdr, colr = CS.box("ihdr", bytes(14)), CS.box("colr", bytes(7))
    data = CS.box("jP  ", b"\r\n\x87\n") + CS.box("ftyp", b"jp2 \0\0\0\0jp2 ") + CS.box("jp2h", ihdr + colr) + CS.box("jp2c", b"\xff\x4f")
    files = R.regions(spark, d).select(F.col("region").cast("string").alias("path"), F.lit(bytearray(data)).alias("content"))
    return CS.box_rows(files).groupBy("path", F.col("level").cast("int").alias("level"), "box").agg(F.count("*").cast("int").alias("n"))
