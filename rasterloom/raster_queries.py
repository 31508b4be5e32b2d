"""Registered raster queries over the fixture rasters, and their SQL.

Levels 0 and 1 of the read-side queries are plain starting planes (luma, block
means) and the decoder is a literal, so every number can be checked in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom import fixtures
from rasterloom.functions import scalar as S
from rasterloom.operators import aggregate as A
from rasterloom.operators import blocks as B
from rasterloom.operators import resample as R
from rasterloom.operators.sites import tiled_site_rows
from rasterloom.schema import channels

LEVELS = 3
# Literal decoder of one texture: C0 = 1, C1 = 2, features [z0, z1, s0, s0*z0, s0*z1].
W = [[0.30, 0.05, 0.22, 0.04, -0.03], [0.06, 0.28, 0.19, -0.02, 0.05], [0.10, 0.12, 0.25, 0.03, 0.02]]
BIAS = [0.48, 0.45, 0.50]
CW = [1.0, 1.0, 1.0]
LUMA = (0.299, 0.587, 0.114)
GRID = (-1.0, 1.0)


def _rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles rounded, so that the order of summation doesn't show."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def luma_plane(source: DataFrame) -> DataFrame:
    """Level 0 of one channel: 2 * luma - 1."""
    luma = sum((S.lit(w) * F.col(f"c{i}") for i, w in enumerate(LUMA[1:], 1)), S.lit(LUMA[0]) * F.col("c0"))
    return source.select("plane", "x", "y", (S.lit(2) * luma - S.lit(1)).alias("c0"))


def mean_plane(source: DataFrame, size: DataFrame) -> DataFrame:
    """Level 1 of two channels: 2 * block mean - 1."""
    means = A.block_means(source.select("plane", "x", "y", "c0", "c1"), size)
    return means.select("plane", "x", "y", *[(S.lit(2) * F.col(c) - S.lit(1)).alias(c) for c in ("c0", "c1")])


def _base(spark: SparkSession, sf_dir: str, levels: int = 0) -> tuple[DataFrame, DataFrame, int, int]:
    source, w, h = fixtures.events_raster(spark, sf_dir)
    size = R.geometry_table(spark, R.geometry(w, h, levels))
    return (R.box_chain(source, w, h, levels) if levels else source), size, w, h


def _as_bytes(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in channels(df)], *[S.to_byte(F.col(c)).alias(c) for c in channels(df)])


def q01(spark, d):
    return _as_bytes(fixtures.events_raster(spark, d)[0])


def q02(spark, d):
    return _as_bytes(R.pack(fixtures.both_rasters(spark, d)[:2]))


def q03(spark, d):
    packed = R.pack(fixtures.both_rasters(spark, d)[:2])
    swapped = R.insert(packed, 0, R.extract(packed, 1))
    return R.to_long(swapped).select("plane", "x", "y", "ch", S.to_byte(F.col("v")).alias("v"))


def q04(spark, d):
    plane, w, h = fixtures.events_raster(spark, d)
    return _as_bytes(R.pad(plane, w, h)[0])


def q05(spark, d):
    _, w, h = fixtures.events_raster(spark, d)
    return R.geometry_table(spark, R.geometry(w, h))


def q06(spark, d):
    plane, w, h = fixtures.events_raster(spark, d)
    return R.box(plane, w, h).select("x", "y", *[F.round(F.col(c) * 1020).cast("int").alias(f"sum{i}") for i, c in enumerate(channels(plane))])


def q07(spark, d):
    plane, w, h = fixtures.events_raster(spark, d)
    return _rounded(R.box_chain(plane, w, h, LEVELS).filter("plane > 0"), 6)


def q08(spark, d):
    plane, w, h = fixtures.events_raster(spark, d)
    return _rounded(R.resize(plane, w, h, max(1, w // 2), max(1, h // 2), "mitchell", "clamp"), 6)


def q09(spark, d):
    plane, w, h = fixtures.events_raster(spark, d)
    return _rounded(R.resize(plane, w, h, max(1, w // 2), max(1, h // 2), "catmullrom", "wrap"), 6)


def q10(spark, d):
    plane, w, h = fixtures.events_raster(spark, d)
    own = channels(plane)
    linear = plane.withColumns({c: S.srgb_to_linear(F.col(c)) for c in own})
    return _rounded(R.box(linear, w, h).withColumns({c: S.clamp01(S.linear_to_srgb(F.col(c))) for c in own}), 6)


def q11(spark, d):
    plane, _, _ = fixtures.events_raster(spark, d)
    own = channels(plane)
    return _rounded(plane.withColumns(dict(zip(own, S.renormalised([F.col(c) for c in own]), strict=True))), 6)


def q12(spark, d):
    plane, w, h = fixtures.events_raster(spark, d)
    return _as_bytes(R.fit(plane, w, h, 64, 128, "center", (3, 0)))


def q13(spark, d):
    source, size, _, _ = _base(spark, d)
    return _rounded(A.block_means(source, size))


def q14(spark, d):
    source, size, _, _ = _base(spark, d)
    return _rounded(R.read_level1(source.select("plane", "x", "y"), mean_plane(source, size), size, ["z0", "z1"]))


def q15(spark, d):
    source, _, _, _ = _base(spark, d)
    pixels = source.select("x", "y")
    parts = [R.sites(pixels, k).withColumn("k", F.lit(k)) for k in (1, 2, 4)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def q16(spark, d):
    chain, size, _, _ = _base(spark, d, LEVELS)
    points = spark.range(2000).select(((F.col("id") * 37 % 1000).cast("double") / 1000).alias("u"), ((F.col("id") * 91 % 997).cast("double") / 997).alias("v"), ((F.col("id") % 31).cast("double") / 10).alias("lod"), F.col("id"))
    return _rounded(R.trilinear(points, chain, size, ["r", "g", "b"]).select("id", "r", "g", "b"))


def q51(spark, d):
    """Four rows of every point and no column that tells them apart: each is read on its own."""
    chain, size, _, _ = _base(spark, d, LEVELS)
    n = F.col("id") % 500
    points = spark.range(2000).select(((n * 37 % 100).cast("double") / 100).alias("u"), ((n * 91 % 97).cast("double") / 97).alias("v"), ((n % 7).cast("double") / 2).alias("lod"))
    return _rounded(R.trilinear(points, chain, size, ["r", "g", "b"]))


def _gradient_points(spark: SparkSession) -> DataFrame:
    """2,000 places with footprints from none to three texels, round and long."""
    n = F.col("id")
    part = lambda c, over: c.cast("double") / over
    return spark.range(2000).select(n, part(n * 37 % 1000, 1000).alias("u"), part(n * 91 % 997, 997).alias("v"), part(n % 7, 200).alias("dudx"), part(n % 3, 500).alias("dvdx"), part(n % 5, 400).alias("dudy"), part(n % 11, 300).alias("dvdy"))


def q55(spark, d):
    """Points read by their gradients in three modes; the last without product terms and level 1 by its own extent."""
    from rasterloom.operators.sampling import sample_gradients

    chain, size, _, _ = _base(spark, d, LEVELS)
    asset, points = (luma_plane(chain), mean_plane(chain, size), size), _gradient_points(spark)
    linear = [sample_gradients(points, *asset, W, BIAS, mode).withColumn("mode", F.lit(mode)) for mode in ("bilinear", "trilinear")]
    point = sample_gradients(points, *asset, [row[:3] for row in W], BIAS, "point", level1_scale=1.0, terms=3).withColumn("mode", F.lit("point"))
    return _rounded(linear[0].unionByName(linear[1]).unionByName(point).select("mode", "id", "c0", "c1", "c2"))


def q56(spark, d):
    """The same points read anisotropically, up to eight probes each."""
    from rasterloom.operators.sampling import sample_gradients

    chain, size, _, _ = _base(spark, d, LEVELS)
    return _rounded(sample_gradients(_gradient_points(spark), luma_plane(chain), mean_plane(chain, size), size, W, BIAS, "anisotropic").select("id", "c0", "c1", "c2"))


def _rows(spark, d, levels: int, k: int = 4) -> tuple[DataFrame, DataFrame]:
    source, size, _, _ = _base(spark, d, levels)
    return tiled_site_rows(luma_plane(source), mean_plane(source, size), source, size, k), size


def q17(spark, d):
    rows, _ = _rows(spark, d, 0)
    errors = A.squared_errors(rows, W, BIAS, CW)
    return _rounded(errors.groupBy("j").agg(F.count(F.lit(1)).alias("n"), F.sum("s0").alias("sum_s"), F.sum(F.col("s0") * F.col("z0")).alias("sum_sz"), F.sum(F.col("z0") * F.col("t0")).alias("sum_zt"), F.sum("plain").alias("se")), 6)


def q18(spark, d):
    _, size, _, _ = _base(spark, d, LEVELS)
    parts = [A.mip_weights(size, kind).withColumn("kind", F.lit(kind)) for kind in ("uniform", "sqrt", "pixels")]
    return _rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]), 12)


def q19(spark, d):
    rows, size = _rows(spark, d, LEVELS)
    return _rounded(A.objective(A.objective_sums(A.squared_errors(rows, W, BIAS, CW)), size, A.mip_weights(size), CW, 4))


def q20(spark, d):
    source, size, _, _ = _base(spark, d)
    rows = R.read_level1(source, mean_plane(source, size), size, ["z0", "z1"])
    return _rounded(rows.agg(*[f(F.col(f"c{i}"), F.col("z0")).alias(f"{n}{i}") for i in range(3) for f, n in ((F.regr_slope, "slope"), (F.regr_intercept, "intercept"))]), 6)


def q21(spark, d):
    from rasterloom.operators.decoder import plane_fit

    source, size, _, _ = _base(spark, d)
    rows = R.read_level1(source, mean_plane(source, size), size, ["z0", "z1"])
    return _rounded(plane_fit(rows, "z0", "z1", ["c0", "c1", "c2"]), 6)


def q23(spark, d):
    source, size, _, _ = _base(spark, d)
    return _rounded(A.covariance(A.block_means(source, size)), 9)


DIRECTION, MEAN = [0.6, 0.64, 0.48], [0.4, 0.5, 0.5]


def q25(spark, d):
    source, _, _, _ = _base(spark, d)
    projected = source.select(F.round(A.projection(source, DIRECTION, MEAN), 12).alias("p"))
    return _rounded(A.histogram_percentile(A.projection_histogram(projected, "p", 256), 0.99, 256))


def q26(spark, d):
    source, size, _, _ = _base(spark, d)
    long = R.to_long(A.block_means(source, size)).withColumn("v", F.round("v", 9))
    return A.value_range(long, "pct").withColumn("policy", F.lit("pct")).unionByName(A.value_range(long, "minmax").withColumn("policy", F.lit("minmax")))


def q27(spark, d):
    source, _, _, _ = _base(spark, d)
    lo, hi = (S.lit(x) for x in GRID)
    v = F.round(S.lit(2) * F.col("c0") - S.lit(1), 9)
    return source.select("x", "y", *[S.grid_index(lo, hi, b, v).alias(f"k{b}") for b in range(3, 9)], *[S.grid_value(lo, hi, b, S.grid_index(lo, hi, b, v)).alias(f"v{b}") for b in (3, 5, 8)])


def q28(spark, d):
    rows = spark.range(1)
    parts = [rows.select(F.lit(b).alias("bits"), F.lit(block).alias("block"), F.posexplode(S.palette(b, block)).alias("k", "value")) for b in range(1, 5) for block in (False, True)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def q29(spark, d):
    from rasterloom.operators.verify import grid_violations

    source, _, _, _ = _base(spark, d)
    lo, hi = (S.lit(x) for x in GRID)
    long = R.to_long(source).withColumn("v", F.round(S.lit(2) * F.col("v") - S.lit(1), 9))
    parts = []
    for b in range(4, 9):
        k = S.grid_index(lo, hi, b, F.col("v"))
        snapped = long.select("plane", "ch", k.alias("k")).withColumn("v", S.grid_value(lo, hi, b, F.col("k")))
        parts.append(grid_violations(snapped, *GRID, b).withColumn("bits", F.lit(b)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _indices(spark, d, bits: int) -> tuple[DataFrame, int, int]:
    source, _, w, h = _base(spark, d)
    return R.to_long(_as_bytes(source)).withColumn("v", F.shiftright("v", 8 - bits)), w, h


def q30(spark, d):
    texels, w, h = _indices(spark, d, 4)
    e = B.pack(B.encode(B.gather(texels, w, h), 4), "b")
    return _rounded(e.select("ch", "bx", "by", "r0", "r1", B.selector_bits(F.col("sel")).alias("bits"), F.lower(F.hex("b")).alias("bytes"), "se"), 3)


def q31(spark, d):
    texels, w, h = _indices(spark, d, 4)
    packed = B.pack(B.encode(B.gather(texels, w, h), 4), "b").select("plane", "ch", "bx", "by", "b")
    return _rounded(B.decode(B.unpack(packed, "b"), w, h).drop("plane"), 4)


def q32(spark, d):
    texels, w, h = _indices(spark, d, 4)
    error = B.packing_error(B.encode(B.gather(texels, w, h), 4), texels, w, h, 4)
    return _rounded(error.select("ch", "n", F.col("se"), S.mse_to_db(F.col("se") / F.col("n"), 255.0).alias("psnr")), 3)


def q33(spark, d):
    parts = []
    for bits in (1, 2, 3):
        texels, w, h = _indices(spark, d, bits)
        parts.append(B.packing_error(B.encode(B.gather(texels, w, h), bits), texels, w, h, bits).select("ch", F.round("se", 3).alias("se"), "n", F.lit(bits).alias("bits")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def q34(spark, d):
    from rasterloom.operators.search import best_palette

    source, size, _, _ = _base(spark, d)
    rows = R.read_level1(source, mean_plane(source, size), size, ["z0", "z1"])
    return _rounded(best_palette(rows, W, BIAS, CW, bits=4, block=False).select("x", "y", "k", "value", "energy"), 7)


def _decoded(spark, d, levels: int) -> tuple[DataFrame, DataFrame]:
    from rasterloom.operators.sampling import decode

    source, size, _, _ = _base(spark, d, levels)
    return decode(luma_plane(source), mean_plane(source, size), size, W, BIAS), source


def q35(spark, d):
    return _as_bytes(_decoded(spark, d, 0)[0])


def q36(spark, d):
    decoded, source = _decoded(spark, d, LEVELS)
    by = A.psnr(A.byte_errors(source, decoded))
    worst = A.worst_texture(by).select("plane", F.lit(-1).alias("texture"), F.lit(None).cast("double").alias("mse"), "psnr")
    return _rounded(by.unionByName(worst), 6)


def q37(spark, d):
    decoded, source = _decoded(spark, d, LEVELS)
    return _rounded(A.worst_case(A.byte_errors(source, decoded)), 6)


def q38(spark, d):
    source, _, _, _ = _base(spark, d, LEVELS)
    grid = spark.createDataFrame([(c, 0.0, 1.0) for c in range(3)], "ch int, lo double, hi double")
    return _rounded(A.channel_stats(R.to_long(source), grid), 6)


def q39(spark, d):
    return _rounded(A.frame_diff(*fixtures.both_rasters(spark, d)[:2]), 6)


def q40(spark, d):
    events = fixtures.events_raster(spark, d)[0]
    return R.duplicate_channels(events.select("plane", "x", "y", "c0", "c1", "c2", F.col("c0").alias("c3"), F.col("c2").alias("c4")))


def _files(size: DataFrame, w: int, h: int) -> DataFrame:
    """The levels of an asset of two block channels and plain bytes."""
    level = lambda dxgi, a, b: size.select(F.col("plane").alias("level"), F.lit(dxgi).alias("dxgi"), F.col(a).alias("width"), F.col(b).alias("height"), F.lit(w).alias("w"), F.lit(h).alias("h"))
    return level(83, "w0", "h0").unionByName(level(28, "w1", "h1"))


def q41(spark, d):
    _, size, w, h = _base(spark, d, LEVELS)
    return _rounded(A.rates(_files(size, w, h), 1), 9)


def q58(spark, d):
    """All figures of the fixed planes in one table."""
    from rasterloom.plans.report import report

    source, size, w, h = _base(spark, d, LEVELS)
    return _rounded(report(luma_plane(source), mean_plane(source, size), source, size, W, BIAS, CW, _files(size, w, h), (w, h)), 5)


def q48(spark, d):
    return _rounded(spark.createDataFrame(A.lean(W, 1, 2), "texture int, level string, channel int, rms double"), 9)


def q49(spark, d):
    return _as_bytes(fixtures.lineitem_raster(spark, d)[0])


def q50(spark, d):
    plane, w, h = fixtures.embeddings_raster(spark, d)
    halved = R.box(plane, w, h)
    back = plane.join(halved.select(F.col("x").alias("hx"), F.col("y").alias("hy"), F.col("c0").alias("m")), (F.floor(F.col("x") / 2) == F.col("hx")) & (F.floor(F.col("y") / 2) == F.col("hy")))
    error = back.select("x", "y", F.abs(S.to_byte(F.col("c0")) - S.to_byte(F.round("m", 9))).alias("d"))
    return _rounded(error.groupBy(F.floor(F.col("x") / 16).cast("int").alias("band")).agg(F.max("d").alias("max_diff"), F.avg((F.col("d") * F.col("d")).cast("double")).alias("mse"), F.count(F.lit(1)).alias("n")), 6)


NAMES = {
    "q01_events_raster": q01,
    "q02_material_pack": q02,
    "q03_channel_insert_long": q03,
    "q04_pad": q04,
    "q05_plane_geometry": q05,
    "q06_box_sums": q06,
    "q07_box_chain": q07,
    "q08_mitchell_clamp": q08,
    "q09_catmullrom_wrap": q09,
    "q10_linear_light_box": q10,
    "q11_normal_renorm": q11,
    "q12_fit": q12,
    "q13_block_means": q13,
    "q14_bilinear_gather": q14,
    "q15_sites": q15,
    "q16_trilinear": q16,
    "q17_objective_sums": q17,
    "q18_mip_weights": q18,
    "q19_objective": q19,
    "q20_decoder_one_feature": q20,
    "q21_decoder_two_features": q21,
    "q23_covariance": q23,
    "q25_projection_histogram": q25,
    "q26_value_range": q26,
    "q27_grid_snap": q27,
    "q28_palettes": q28,
    "q29_grid_closure": q29,
    "q30_block_pack": q30,
    "q31_block_decode": q31,
    "q32_packing_error": q32,
    "q33_lossless_relabel": q33,
    "q34_palette_argmin": q34,
    "q35_decode": q35,
    "q36_psnr": q36,
    "q37_worst_case": q37,
    "q38_channel_stats": q38,
    "q39_frame_diff": q39,
    "q40_duplicate_channels": q40,
    "q41_rates": q41,
    "q48_decoder_lean": q48,
    "q49_lineitem_raster": q49,
    "q50_embeddings_box": q50,
    "q51_repeated_points": q51,
    "q55_gradient_sampling": q55,
    "q56_anisotropic_sampling": q56,
    "q58_report": q58,
}






# ---- solvers: what SQL can't express, tested against dense or brute-force versions


def q22(spark, d):
    from rasterloom.operators.decoder import fit as fit_decoder

    rows, size = _rows(spark, d, LEVELS)
    weights = A.mip_weights(size)
    total = weights.join(size, "plane").agg(F.sum(F.col("per_site") * F.col("w0") * F.col("h0") * 5)).first()[0]
    got = fit_decoder(rows, weights, CW, total)
    out = [(r, *map(float, w), float(b)) for r, (w, b) in enumerate(zip(got.w, got.b, strict=True))]
    return _rounded(spark.createDataFrame(out, "output int, w0 double, w1 double, w2 double, w3 double, w4 double, bias double"), 4)


def q24(spark, d):
    from rasterloom.operators.initialise import leading_direction

    source, size, _, _ = _base(spark, d)
    means = A.block_means(source, size)
    found = leading_direction(A.covariance(means))
    projected = means.select("x", "y", A.projection(means, found.direction, found.mean).alias("p"))
    peak = projected.agg(F.max(F.abs("p")).alias("peak"))
    return _rounded(projected.crossJoin(peak).select("x", "y", (F.col("p") / F.col("peak")).alias("v")), 6)


def q47(spark, d):
    from rasterloom.functions.config import Options
    from rasterloom.plans.fit import fit_report, with_material

    source = fixtures.events_raster(spark, d)[0]
    orders = fixtures.orders_raster(spark, d)[0]
    materials = with_material(source, "events").unionByName(with_material(orders, "orders"))
    return _rounded(fit_report(materials, Options(c0=1, c1=3)), 6)


def q57(spark, d):
    """Both materials fitted by tiles with halos: the error after every block of two rounds."""
    from rasterloom.functions.config import Options
    from rasterloom.plans import tiles as T
    from rasterloom.plans.fit import with_material
    from rasterloom.session import forget, stored

    events, orders, w, h = fixtures.both_rasters(spark, d)
    size, parts = R.geometry_table(spark, R.geometry(w, h, LEVELS)), ([], [], [])
    chains = []
    for name, source in (("events", events), ("orders", orders)):
        # Every level reads the base, and every part of a tile the chain: both are made once.
        base = stored(source, "base")
        chain = stored(R.box_chain(base, w, h, LEVELS), "chain")
        forget(base)
        chains.append(chain)
        for rows, plane in zip(parts, (luma_plane(chain), mean_plane(chain, size), chain), strict=True):
            rows.append(with_material(plane, name))
    cut = T.cut(*[a.unionByName(b) for a, b in parts], size)
    forget(*chains)
    return _rounded(T.rounds(cut, CW, 2, Options(c0=1, c1=2))[2], 5)


_DESCRIPTORS = [
    ("good.json", '{"format":"latent-pair","decode":{"width":8,"height":8,"textures_out":1},"textures":[{"file":"a.dds","mip_count":1,"mip_sizes":[[8,8]],"dxgi_format_id":80,"dxgi_format":"BC4"},{"files":["b.dds","sub/c.dds"],"mip_count":1,"mip_sizes":[[2,2]],"dxgi_format_id":28,"dxgi_format":"RGBA8"}],"decoder":{"C0":1,"C1":1,"nin":3,"nout":3,"layers":[{"rows":3,"cols":3,"weights":[1,2,3,4,5,6,7,8,9],"bias":[0,0,0]}]}}'),
    ("bad.json", '{"format":"latent-pair","decode":{"width":8,"height":8,"textures_out":1},"textures":[{"file":"d.dds","mip_count":2,"mip_sizes":[[8,8]],"dxgi_format_id":80,"dxgi_format":"BC4"},{"file":"e.dds","mip_count":1,"mip_sizes":[[2,2]],"dxgi_format_id":28,"dxgi_format":"RGBA8"}],"decoder":{"C0":1,"C1":1,"nin":4,"nout":3,"layers":[{"rows":3,"cols":3,"weights":[1,2,3],"bias":[0,0,0]}]}}'),
    ("other.json", '{"hello": 1}'),
]


def q42(spark, d):
    from rasterloom.sources import descriptor as X

    found = X.find(spark.createDataFrame(_DESCRIPTORS, "name string, text string"))
    broken = X.violations(found).select("name", F.lit(None).cast("string").alias("file"), F.col("error").alias("state"))
    files = spark.createDataFrame([("a.dds",), ("b.dds",), ("e.dds",)], "file string")
    return broken.unionByName(X.resolve(X.named_files(found), files))


def q43(spark, d):
    from rasterloom.functions.config import merge_settings

    textures = spark.createDataFrame([(0, None, None, None, None, 500.0), (1, "mitchell", True, None, None, None), (2, None, True, None, None, 1e-9), (3, "box", None, "wrap", True, 0.0)], "t int, filter string, srgb boolean, edge string, normal_map boolean, weight double")
    given = spark.createDataFrame([(0, "catmullrom", None), (1, None, 2.0)], "t int, filter string, weight double")
    return merge_settings(textures, given)


def _indexed(plane: DataFrame) -> DataFrame:
    """8-bit indices of a plane on GRID."""
    lo, hi = (S.lit(x) for x in GRID)
    return plane.select("plane", "x", "y", *[S.grid_index(lo, hi, 8, F.round(F.col(c), 9)).alias(c) for c in channels(plane)])


def q52(spark, d):
    """Planes to files (blocks, bytes, descriptor), files to planes, planes to decibels."""
    from rasterloom.session import shared_path
    from rasterloom.sources import asset

    source, size, _, _ = _base(spark, d, LEVELS)
    root = shared_path(spark, "asset")
    asset.write(_indexed(luma_plane(source)), _indexed(mean_plane(source, size)), size, W, BIAS, ([GRID[0]], [GRID[1]]), ([GRID[0]] * 2, [GRID[1]] * 2), root, "events")
    return _rounded(asset.quality(asset.load(spark, root, "events"), source), 6)


def q53(spark, d):
    """What the files of q52 hold: level 1's closure on its grid, read back from them."""
    from rasterloom.session import shared_path
    from rasterloom.sources import asset

    source, size, _, _ = _base(spark, d, LEVELS)
    root = shared_path(spark, "asset")
    asset.write(_indexed(luma_plane(source)), _indexed(mean_plane(source, size)), size, W, BIAS, ([GRID[0]], [GRID[1]]), ([GRID[0]] * 2, [GRID[1]] * 2), root, "events", packed=False)
    found = asset.load(spark, root, "events")
    sums = R.to_long(found.level1).groupBy("plane", "ch").agg(F.sum(F.col("v")).alias("total"))
    return _rounded(asset.closure(found).join(sums, ["plane", "ch"]), 5)


def q54(spark, d):
    """The fit of both materials to files, and the decibels of what the files decode to."""
    from rasterloom.functions.config import Options
    from rasterloom.plans.fit import with_material
    from rasterloom.session import shared_path
    from rasterloom.sources import asset

    planes = {"events": fixtures.events_raster(spark, d), "orders": fixtures.orders_raster(spark, d)}
    options, root = Options(c0=1, c1=3, mips=False), shared_path(spark, "asset")
    materials = [with_material(plane, name) for name, (plane, _, _) in planes.items()]
    asset.write_fitted(materials[0].unionByName(materials[1]), root, options)
    parts = []
    for name, (plane, w, h) in planes.items():
        source, _, _ = R.pad(plane, w, h)
        parts.append(asset.quality(asset.load(spark, root, name), source).withColumn("material_id", F.lit(name)))
    return _rounded(parts[0].unionByName(parts[1]), 6)


NAMES |= {
    "q52_asset_round_trip": q52,
    "q53_asset_closure": q53,
    "q54_fitted_asset": q54,
    "q22_decoder_fit": q22,
    "q24_leading_direction": q24,
    "q42_descriptor_files": q42,
    "q43_settings_merge": q43,
    "q47_material_fit": q47,
    "q57_tiled_rounds": q57,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from rasterloom import fit_queries, picture_queries, setting_queries

    return NAMES | fit_queries.NAMES | setting_queries.NAMES | picture_queries.NAMES
