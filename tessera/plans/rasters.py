"""Rasters, packets, passes and traces derived from the driver's tables, in the schemas of the engine.

samples(image_id, comp, y, x, v) is the long form that defines every operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def emb_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One signed component: a row of samples for each vector."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("y"), F.posexplode("embedding").alias("x", "e"))
    return e.select(F.lit(0).cast("long").alias("image_id"), F.lit(0).alias("comp"), "y", F.col("x").cast("long").alias("x"), F.floor(F.col("e").cast("double") * 1000 + 0.5).cast("long").alias("v"))


def rgb_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x, y, r, g, b: 128 columns, the last row ragged."""
    i = F.col("event_id").cast("long")
    e = table(spark, sf_dir, "events")
    return e.select(
        (i % 128).alias("x"), F.floor(i / 128).cast("long").alias("y"), F.pmod(F.floor("value").cast("long"), F.lit(256)).cast("long").alias("r"),
        F.pmod(F.col("user_id").cast("long") * 17, F.lit(256)).cast("long").alias("g"), (i * 37 % 256).alias("b"),
    )


def rgb_img(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as samples of three components."""
    w = rgb_wide(spark, sf_dir)
    return w.select(F.lit(0).cast("long").alias("image_id"), F.posexplode(F.array("r", "g", "b")).alias("comp", "v"), "y", "x").select("image_id", "comp", "y", "x", "v")


def tile_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").cast("long").alias("seq"), (F.col("o_custkey").cast("long") % 64).alias("tile"), F.floor("o_totalprice").cast("long").alias("length"))


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets with component, resolution, layer, precinct, its place on the reference grid, and length."""
    k = F.col("o_orderkey").cast("long")
    p = table(spark, sf_dir, "orders").select(
        k.alias("k"), (k % 3).alias("comp"), F.floor(k / 3).cast("long").alias("q"), F.floor("o_totalprice").cast("long").alias("length"), (F.col("o_custkey").cast("long") % 8).alias("tile")
    )
    p = p.withColumn("res", F.col("q") % 4).withColumn("layer", F.floor(F.col("k") / 12).cast("long") % 5).withColumn("precinct", F.floor(F.col("k") / 60).cast("long"))
    step = F.expr("shiftleft(64L, cast(3 - res as int))")
    return p.select("tile", "k", "comp", "res", "layer", "precinct", (F.floor(F.col("precinct") / 16).cast("long") * step).alias("py"), ((F.col("precinct") % 16) * step).alias("px"), "length")


def passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coding passes of code blocks, with length and distortion saved."""
    from pyspark.sql import Window as W

    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("cblk"), F.col("event_id").cast("long").alias("e"), F.floor(F.abs("value")).cast("long").alias("a"))
    return e.select("cblk", F.row_number().over(W.partitionBy("cblk").orderBy("e")).cast("long").alias("pass"), (1 + F.col("a") % 97).alias("len"), (1 + F.col("a") * 7 % 1009).alias("dist"))


def palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy((F.col("p_partkey").cast("long") % 256).alias("idx")).agg(F.min("p_size").cast("long").alias("value"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 rectangles, half open."""
    k = F.col("n_nationkey").cast("long")
    n = table(spark, sf_dir, "nation")
    return n.select(k.alias("region"), (k * 5 % 100).alias("x0"), (k * 3 % 40).alias("y0"), (k * 5 % 100 + 20 + k).alias("x1"), (k * 3 % 40 + 10 + k).alias("y1"))


def access_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """step, tile, at: tiles in the order in which they are asked for."""
    from pyspark.sql import Window as W

    e = table(spark, sf_dir, "events")
    # A trace is one ordered sequence; each cache (tile % 8) replays its own part.
    return e.select((F.col("user_id").cast("long") % 8).alias("cache"), F.col("user_id").cast("long").alias("tile"), "ts", F.col("event_id").cast("long").alias("e")).withColumn(
        "step", F.row_number().over(W.partitionBy("cache").orderBy("ts", "e")).cast("long")
    ).select("cache", "step", "tile")


#: The same as common table expressions for the SQL that checks the queries.
SQL = {
    "emb": "emb as (select 0::bigint image_id, 0 comp, vec_id::bigint y, (i - 1)::bigint x, cast(floor(embedding[i]::double * 1000 + 0.5) as bigint) v from embeddings, unnest(range(1, len(embedding) + 1)) t(i))",
    "wide": "wide as (select event_id % 128 x, event_id // 128 y, ((cast(floor(value) as bigint) % 256) + 256) % 256 r, (user_id::bigint * 17) % 256 g, (event_id * 37) % 256 b from events)",
    "rgb": "rgb as (select 0::bigint image_id, c comp, y, x, case c when 0 then r when 1 then g else b end v from wide, unnest([0, 1, 2]) t(c))",
    "tile_parts": "tile_parts as (select o_orderkey::bigint seq, (o_custkey::bigint) % 64 tile, cast(floor(o_totalprice) as bigint) length from orders)",
    "packets": "packets as (select o_custkey::bigint % 8 tile, k, k % 3 comp, (k // 3) % 4 res, (k // 12) % 5 layer, k // 60 precinct, ((k // 60) // 16) * (64 << (3 - (k // 3) % 4)) py, ((k // 60) % 16) * (64 << (3 - (k // 3) % 4)) px, cast(floor(o_totalprice) as bigint) length from (select *, o_orderkey::bigint k from orders))",
    "passes": "passes as (select user_id::bigint cblk, row_number() over (partition by user_id order by event_id) pass, 1 + a % 97 len, 1 + a * 7 % 1009 dist from (select *, cast(floor(abs(value)) as bigint) a from events))",
    "palette": "palette as (select p_partkey::bigint % 256 idx, min(p_size)::bigint value from part group by 1)",
    "regions": "regions as (select k region, k * 5 % 100 x0, k * 3 % 40 y0, k * 5 % 100 + 20 + k x1, k * 3 % 40 + 10 + k y1 from (select n_nationkey::bigint k from nation))",
    "trace": "trace as (select cache, row_number() over (partition by cache order by ts, event_id) step, tile from (select *, user_id::bigint tile, user_id::bigint % 8 cache from events))",
}


def sql(names: str, body: str) -> str:
    return "with " + ", ".join(SQL[n] for n in names.split()) + ("" if body.startswith(",") else " ") + body
