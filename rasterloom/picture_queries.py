"""Registered queries of pictures, movements, residuals and frame checks, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom import fixtures
from rasterloom.functions import scalar as S
from rasterloom.operators import aggregate as A
from rasterloom.operators import resample as R
from rasterloom.raster_queries import BIAS, DIRECTION, MEAN, W, _as_bytes, _base, _rounded, luma_plane, mean_plane
from rasterloom.session import forget, shared_path, stored
from rasterloom.sources import asset, images

SHRUNK = 2
DIVISOR = 0.75
CROPPED = (64, 200)


def _seen(spark: SparkSession, root: str) -> DataFrame:
    """name, width, height, pixels and the sums of the bytes of every picture below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,bmp}").load(root)
    base = lambda c: S.base_name(F.col(c)).alias("name")
    sized = images.sizes(files).select(base("path"), "width", "height")
    byte = lambda c: F.floor(F.col(c) * 255 + 0.5)
    sums = [F.sum(byte(f"c{i}")).alias(f"s{i}") for i in range(3)]
    read = images.read(spark, root).groupBy("path").agg(F.count(F.lit(1)).alias("pixels"), *sums, F.sum(byte("c0") * (F.col("x") + 3 * F.col("y"))).alias("placed"))
    return sized.join(read.withColumn("path", base("path")).withColumnRenamed("path", "name"), "name")


def q69(spark: SparkSession, d: str) -> DataFrame:
    """Both whole rasters as a PNG and a bitmap each, written, scanned and read back."""
    root = shared_path(spark, "pictures")
    events, orders, _, _ = fixtures.both_rasters(spark, d)
    named = [_as_bytes(df).withColumn("name", F.lit(name)) for name, df in (("events", events), ("orders", orders))]
    pixels = stored(named[0].unionByName(named[1]), "pixels")
    pictures = [pixels.withColumn("path", F.concat("name", F.lit(f".{kind}"))) for kind in ("png", "bmp")]
    for kind, own in zip(("png", "bmp"), pictures, strict=True):
        images.save(own, root, kind, keep=False)
    forget(pixels)
    return _seen(spark, root)


def q70(spark: SparkSession, d: str) -> DataFrame:
    """A PNG of every level of the source chain, read back."""
    root = shared_path(spark, "levels")
    chain, _, _, _ = _base(spark, d, 3)
    images.save(asset.level_pixels(chain, "p", "src"), root)
    return _seen(spark, root)


def q71(spark: SparkSession, d: str) -> DataFrame:
    """The raster at half its size through the box filter's trapezoid."""
    plane, w, h = fixtures.events_raster(spark, d)
    return _rounded(R.resize(plane, w, h, max(1, w // SHRUNK), max(1, h // SHRUNK), "box", "clamp"), 6)


def q72(spark: SparkSession, d: str) -> DataFrame:
    """How level 1 moves from the events' means towards the orders': values over half a step, and squared norms."""
    events, orders, w, h = fixtures.both_rasters(spark, d)
    size = R.geometry_table(spark, R.geometry(w, h, 0))
    before, after = (R.to_long(mean_plane(df, size)) for df in (events, orders))
    mixed = after.withColumnRenamed("v", "o").join(before, ["plane", "x", "y", "ch"]).select("plane", "x", "y", "ch", F.round(F.col("v") + (F.col("o") - F.col("v")) / 64, 9).alias("v"))
    grid = spark.createDataFrame([(c, -1.0, 1.0) for c in range(2)], "ch int, lo double, hi double")
    return _rounded(A.movement(before.withColumn("v", F.round("v", 9)), mixed, grid, 255), 6)


def q73(spark: SparkSession, d: str) -> DataFrame:
    """The residual of the starting planes along a direction, as a level-0 channel."""
    from rasterloom.operators.initialise import residual, seed_channel

    source, size, _, _ = _base(spark, d)
    left = residual(luma_plane(source), mean_plane(source, size), source, size, W, BIAS)
    seeded = seed_channel(left.withColumn("p", A.projection(left, DIRECTION, MEAN)), DIVISOR)
    return _rounded(seeded.select("plane", "x", "y", "c0", "c1", "c2", "v"), 6)


def q74(spark: SparkSession, d: str) -> DataFrame:
    """Two frames compared by bars, and a summary of the verdicts."""
    from rasterloom.operators.sampling import shown_channel
    from rasterloom.operators.verify import frame_check, summary

    events, orders, _, _ = fixtures.both_rasters(spark, d)
    near = events.select("plane", "x", "y", *[F.least(F.lit(1.0), F.col(c) + F.lit(i / 255.0)).alias(c) for i, c in enumerate(("c0", "c1", "c2"))])
    parts = [frame_check(A.frame_diff(events, df), 1, 40.0).withColumn("name", F.lit(name)) for name, df in (("near", near), ("orders", orders), ("grey", shown_channel(events, 0)))]
    told = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return _rounded(summary(told.withColumn("difference", F.col("max_diff"))), 6)


def q77(spark: SparkSession, d: str) -> DataFrame:
    """Both rasters' pictures cropped and expanded to one size, the first as grey, and read back through the material file."""
    from rasterloom.sources import crop, material

    root, out = shared_path(spark, "originals"), shared_path(spark, "cropped")
    events, orders, _, _ = fixtures.both_rasters(spark, d)
    named = [_as_bytes(df).withColumn("path", F.lit(f"{name}.png")) for name, df in (("events", events), ("orders", orders))]
    images.save(named[0].unionByName(named[1]), root)
    told = crop.crop_set(spark, [f"{root}/{n}.png" for n in ("events", "orders")], *CROPPED, out, "c", "center", (3, -2), "set.json", gray_first=True)
    sums = [F.sum(F.round(F.col(f"c{i}") * 255).cast("long")).alias(f"s{i}") for i in range(3)]
    read = images.read(spark, out).groupBy(S.base_name(F.col("path")).alias("file")).agg(F.count(F.lit(1)).alias("pixels"), *sums, F.sum(F.round(F.col("c0") * 255).cast("long") * (F.col("x") + 3 * F.col("y"))).alias("placed"))
    listed = material.read(spark, f"{out}/*.json").select("t", "file", "filter", "weight")
    return told.join(read, "file").join(listed, "file")


NAMES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "q69_pictures": q69,
    "q70_level_pictures": q70,
    "q71_box_resize": q71,
    "q72_level1_movement": q72,
    "q73_residual_seed": q73,
    "q74_frame_checks": q74,
    "q77_crop_set": q77,
}


def oracle_sql() -> dict[str, str]:
    from rasterloom.raster_sql import _BOTH, _EVENTS, _byte, _head, _level1, _outputs, _psnr_of, _resize

    sums = ", ".join(f"sum(b{i})::bigint AS s{i}" for i in range(3))
    bytes_ = lambda t: ", ".join(f"{_byte(f'{t}c{i}')} AS b{i}" for i in range(3))
    seen = f"max(x) + 1 AS width, max(y) + 1 AS height, count(*)::bigint AS pixels, {sums}, sum(b0 * (x + 3 * y))::bigint AS placed"
    outs = ", ".join(f"{o} - t.c{i} AS r{i}" for i, o in enumerate(_outputs()))
    along = " + ".join(["0.0::double", *[f"{e!r}::double * (r{i} - {m!r}::double)" for i, (e, m) in enumerate(zip(DIRECTION, MEAN, strict=True))]])
    box = _resize("mitchell", "clamp")
    start, end = box.index("CASE WHEN d < 1"), box.index("END AS wt")
    kernel = "CASE WHEN d >= 0.5::double + s / 2 THEN 0 WHEN d <= 0.5::double - s / 2 THEN 1 ELSE (0.5::double + s / 2 - d) / s "
    box = box.replace(box[start:end], kernel)
    for n in "wh":
        box = box.replace(f"(greatest(1, {n} // 2)::double / {n})) AS d, w, h", f"(greatest(1, {n} // 2)::double / {n})) AS d, greatest(1, {n} // 2)::double / {n} AS s, w, h")
    other = {"near": ", ".join(f"least(1.0::double, c{i} + {i / 255.0!r}::double) AS c{i}" for i in range(3)), "grey": "c0, c0 AS c1, c0 AS c2"}
    frames = " UNION ALL ".join([*[f"SELECT '{name}' AS name, plane, x, y, {c} FROM evf" for name, c in other.items()], "SELECT 'orders', plane, x, y, c0, c1, c2 FROM odf"])
    cw, ch = CROPPED
    axis = lambda n, to, off: f"CASE WHEN {n} <= {to} THEN 0 ELSE greatest(0, least({n} - {to}, ({n} - {to}) // 2 + {off})) END"
    return {
        "q77_crop_set": f"""WITH {_BOTH}, a AS (SELECT 1 AS n, x, y, {bytes_('')} FROM evf UNION ALL SELECT 2, x, y, {bytes_('')} FROM odf),
g AS (SELECT max(x) + 1 AS w, max(y) + 1 AS h FROM evf),
spot AS (SELECT px, py, {axis('w', cw, 3)} + least(px, least(w, {cw}) - 1) AS x, {axis('h', ch, -2)} + least(py, least(h, {ch}) - 1) AS y FROM g, (SELECT unnest(range({cw})) AS px), (SELECT unnest(range({ch})) AS py)),
c AS (SELECT n, px AS x, py AS y, CASE n WHEN 1 THEN (19595 * b0 + 38470 * b1 + 7471 * b2 + 32768) >> 16 ELSE b0 END AS b0, CASE n WHEN 1 THEN (19595 * b0 + 38470 * b1 + 7471 * b2 + 32768) >> 16 ELSE b1 END AS b1, CASE n WHEN 1 THEN (19595 * b0 + 38470 * b1 + 7471 * b2 + 32768) >> 16 ELSE b2 END AS b2 FROM spot JOIN a USING (x, y))
SELECT n, 'c' || n || '.png' AS file, any_value(g.w) AS source_width, any_value(g.h) AS source_height, CASE n WHEN 1 THEN 1 ELSE 3 END AS channels, {cw} AS width, {ch} AS height, count(*)::bigint AS pixels, {sums}, sum(b0 * (x + 3 * y))::bigint AS placed, n - 1 AS t, 'mitchell' AS filter, 1.0::double AS weight FROM c, g GROUP BY n""",
        "q69_pictures": f"WITH {_BOTH}, a AS (SELECT 'events' AS n, x, y, {bytes_('')} FROM evf UNION ALL SELECT 'orders', x, y, {bytes_('')} FROM odf) SELECT n || k AS name, {seen} FROM a, (VALUES ('.png'), ('.bmp')) f(k) GROUP BY n, k",
        "q70_level_pictures": f"{_head(3)}, a AS (SELECT plane, x, y, {bytes_('')} FROM src) SELECT 'p_src' || CASE WHEN plane > 0 THEN '_M' || plane ELSE '' END || '.png' AS name, {seen} FROM a GROUP BY plane",
        "q71_box_resize": box,
        "q72_level1_movement": f"""WITH {_BOTH}, g AS (SELECT max(x) + 1 AS w, max(y) + 1 AS h FROM evf),
mean AS (
  SELECT k, least(((x + 1)::bigint * (w // 4) - 1) // w, w // 4 - 1) AS x, least(((y + 1)::bigint * (h // 4) - 1) // h, h // 4 - 1) AS y, avg(c0) AS c0, avg(c1) AS c1
  FROM (SELECT 0 AS k, * FROM evf UNION ALL SELECT 1, * FROM odf), g GROUP BY ALL),
v AS (SELECT k, x, y, unnest([0, 1]) AS ch, unnest([2 * c0 - 1, 2 * c1 - 1]) AS v FROM mean),
m AS (SELECT round(a.v, 9) AS old, round(a.v + (b.v - a.v) / 64, 9) AS v FROM v a JOIN v b USING (x, y, ch) WHERE a.k = 0 AND b.k = 1)
SELECT 0 AS plane, count(*) FILTER (abs(v - old) > 2.0::double / 510)::bigint AS moved, round(sum((v - old) * (v - old)), 6) AS delta2, round(sum(v * v), 6) AS plane2 FROM m""",
        "q73_residual_seed": f"{_head(0, ',' + _level1('l0', 'plane, x, y, s0'))}, r AS (SELECT z.plane, z.x, z.y, {outs} FROM z JOIN src t USING (plane, x, y)) SELECT plane, x, y, round(r0, 6) AS c0, round(r1, 6) AS c1, round(r2, 6) AS c2, round(greatest(-1.0::double, least(1.0::double, ({along}) / {DIVISOR!r}::double)), 6) AS v FROM r",
        "q74_frame_checks": f"""WITH {_BOTH}, f AS ({frames}),
e AS (SELECT name, unnest([0, 1, 2]) AS ch, unnest([{', '.join(f"{_byte(f'a.c{i}')} - {_byte(f'f.c{i}')}" for i in range(3))}]) AS d FROM evf a JOIN f USING (x, y)),
c AS (SELECT name, ch, max(abs(d)) AS worst, avg((d * d)::double) AS mse FROM e GROUP BY ALL)
SELECT name, count(*)::bigint AS calls, count(*) FILTER (NOT (worst <= 1 AND {_psnr_of('mse')} >= 40))::bigint AS failures, max(worst) AS largest FROM c GROUP BY name""",
    }
