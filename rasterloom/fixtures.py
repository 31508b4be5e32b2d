"""Rasters made from ordinary tables: small, deterministic, expressible in any SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _byte(c: Column) -> Column:
    return c.cast("int").cast("double") / F.lit(255.0)


def events_raster(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, int]:
    """One RGB texture, 100 wide; byte channels as byte / 255. Returns plane, width, height."""
    events = table(spark, sf_dir, "events")
    h = events.count() // WIDTH
    rows = events.select(
        F.lit(0).alias("plane"),
        (F.col("event_id") % WIDTH).cast("int").alias("x"),
        F.floor(F.col("event_id") / WIDTH).cast("int").alias("y"),
        _byte(F.least(F.lit(255), F.floor("value"))).alias("c0"),
        _byte(F.hour("ts") * 11).alias("c1"),
        _byte((F.col("user_id") * 37) % 256).alias("c2"),
    )
    return rows, WIDTH, h


def orders_raster(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, int]:
    """A second texture as wide; all orders, what is left of the last row as 0."""
    orders = table(spark, sf_dir, "orders")
    h = -(-orders.count() // WIDTH)
    rows = orders.select(
        F.lit(0).alias("plane"),
        (F.col("o_orderkey") % WIDTH).cast("int").alias("x"),
        F.floor(F.col("o_orderkey") / WIDTH).cast("int").alias("y"),
        _byte(F.floor(F.col("o_totalprice") / 2000)).alias("c0"),
        _byte(F.dayofyear("o_orderdate") % 256).alias("c1"),
        _byte(F.substring("o_orderpriority", 1, 1).cast("int") * 51).alias("c2"),
    )
    return filled(rows, WIDTH, h), WIDTH, h


def filled(plane: DataFrame, w: int, h: int) -> DataFrame:
    """``plane`` on all of w x h, holes as 0."""
    grid = plane.sparkSession.range(w * h).select(F.lit(0).alias("plane"), (F.col("id") % w).cast("int").alias("x"), F.floor(F.col("id") / w).cast("int").alias("y"))
    own = [c for c in plane.columns if c not in ("plane", "x", "y")]
    return grid.join(plane, ["plane", "x", "y"], "left").select("plane", "x", "y", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in own])


def both_rasters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int, int]:
    """Both textures on the higher one's extent, holes as 0."""
    events, w, he = events_raster(spark, sf_dir)
    orders, _, ho = orders_raster(spark, sf_dir)
    h = max(he, ho)
    return filled(events, w, h) if he < h else events, filled(orders, w, h) if ho < h else orders, w, h


def customers_raster(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, int]:
    """A small texture, 20 wide: balance, nation and segment."""
    rows = table(spark, sf_dir, "customer")
    w, h = 20, -(-rows.count() // 20)
    plane = rows.select(
        F.lit(0).alias("plane"),
        (F.col("c_custkey") % w).cast("int").alias("x"),
        F.floor(F.col("c_custkey") / w).cast("int").alias("y"),
        _byte(F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col("c_acctbal") + 1000) / 44)))).alias("c0"),
        _byte(F.col("c_nationkey") * 10).alias("c1"),
        _byte(F.length("c_mktsegment") * 20).alias("c2"),
    )
    return filled(plane, w, h), w, h


def embeddings_raster(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, int]:
    """One grey channel: a row per vector, clamped around 0.5."""
    vectors = table(spark, sf_dir, "embeddings")
    rows = vectors.select(F.lit(0).alias("plane"), F.posexplode("embedding").alias("x", "e"), F.col("vec_id").cast("int").alias("y"))
    return rows.select("plane", "x", "y", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(0.5) + F.col("e").cast("double"))).alias("c0")), 64, vectors.count()


def lineitem_raster(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, int]:
    """A 64 x 64 scatter of line items: count and summed quantity, holes as 0."""
    cells = table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 64).cast("int").alias("x"), (F.col("l_suppkey") % 64).cast("int").alias("y")).agg(
        (F.count(F.lit(1)) % 256).alias("r"), (F.sum("l_quantity").cast("long") % 256).alias("g")
    )
    grid = spark.range(64 * 64).select((F.col("id") % 64).cast("int").alias("x"), F.floor(F.col("id") / 64).cast("int").alias("y"))
    full = grid.join(cells, ["x", "y"], "left")
    return full.select(F.lit(0).alias("plane"), "x", "y", *[_byte(F.coalesce(c, F.lit(0))).alias(n) for c, n in (("r", "c0"), ("g", "c1"))]), 64, 64


def pattern(spark: SparkSession, kind: str, w: int, h: int) -> DataFrame:
    """The synthetic pictures: flat ones, gradients, stripes, a checkerboard, a dot, hash noise."""
    x, y = F.col("x"), F.col("y")
    rgb = {
        "black": (0, 0, 0),
        "white": (255, 255, 255),
        "grey": (128, 128, 128),
        "constant": (17, 200, 90),
        "gradient": (F.floor(x * 255 / max(1, w - 1)), F.floor(y * 255 / max(1, h - 1)), F.floor((x + y) * 255 / max(1, w + h - 2))),
        "noise": tuple((x * 7919 + y * 104729 + k * 1299709) % 256 for k in range(3)),
        "stripes": ((x % 2) * 255,) * 3,
        "checker": (((x + y) % 2) * 255,) * 3,
        "quadrants": ((x < w // 2).cast("int") * 255, (y < h // 2).cast("int") * 255, ((x >= w // 2) & (y >= h // 2)).cast("int") * 255),
        "dot": (((x == 50 % w) & (y == 18 % h)).cast("int") * 255,) * 3,
    }[kind]
    rows = spark.range(w * h).select(F.lit(0).alias("plane"), (F.col("id") % w).cast("int").alias("x"), F.floor(F.col("id") / w).cast("int").alias("y"))
    return rows.select("plane", "x", "y", *[_byte(c if isinstance(c, Column) else F.lit(c)).alias(f"c{i}") for i, c in enumerate(rgb)])
