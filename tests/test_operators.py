"""Operators against the numpy twins, on small synthetic pictures."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from rasterloom import fixtures, raster_queries
from rasterloom.functions.config import Options
from rasterloom.operators import aggregate as A
from rasterloom.operators import blocks as B
from rasterloom.operators import decoder as D
from rasterloom.operators import initialise as I
from rasterloom.operators import latents as L
from rasterloom.operators import resample as R
from rasterloom.operators import sampling as S
from rasterloom.operators import verify as V
from rasterloom.plans import fit as P

W = [[0.3, 0.05, 0.2, 0.04, -0.03], [0.06, 0.28, 0.19, -0.02, 0.05], [0.1, 0.12, 0.25, 0.03, 0.02]]
BIAS = [0.4, 0.45, 0.5]
H, WD = 12, 20


def as_array(df, n):
    return P.to_array(df.toPandas(), [f"c{i}" for i in range(n)])


@pytest.fixture(scope="module")
def planes(spark):
    source = fixtures.pattern(spark, "noise", WD, H)
    size = R.geometry_table(spark, R.geometry(WD, H, 0))
    level0 = I.luma(source)
    level1 = A.block_means(source.select("plane", "x", "y", "c0", "c1"), size)
    return source.cache(), size, level0.cache(), level1.cache()


@pytest.mark.parametrize("k", [0, 1, 2, 4])
def test_objective_meets_the_twin(spark, planes, k):
    source, size, level0, level1 = planes
    rows = R.site_rows(level0, level1, source, size, k)
    got = A.objective_sums(A.squared_errors(rows, W, BIAS, [1.0, 0.5, 2.0])).first()
    twin = L.Plane(as_array(level0, 1), as_array(level1, 2), as_array(source, 3))
    want = L.plane_error(twin, np.array(W), np.array(BIAS), np.array([1.0, 0.5, 2.0]), k)
    assert [got["weighted"], got["centre"], got["fractional"]] == pytest.approx(list(want), rel=1e-9)


def test_gram_meets_the_twin(spark, planes):
    source, size, level0, level1 = planes
    a, r = D.gram(R.site_rows(level0, level1, source, size, 4), A.mip_weights(size))
    twin = L.Plane(as_array(level0, 1), as_array(level1, 2), as_array(source, 3))
    parts = [(np.concatenate([D.phi_matrix(t0.read(twin.v0), t1.read(twin.v1)), np.ones((H * WD, 1))], 1), t) for _, t0, t1, t in L.sites(twin, 4)]
    assert a == pytest.approx(sum(v.T @ v for v, _ in parts)) and r == pytest.approx(sum(v.T @ t for v, t in parts))


def test_decode_and_sampling_modes(spark, planes):
    source, size, level0, level1 = planes
    decoded = as_array(S.decode(level0, level1, size, W, BIAS), 3)
    # At texel centres every mode but point reads level 1 as the decoder does.
    points = source.select("x", "y", ((F.col("x") + 0.5) / WD).alias("u"), ((F.col("y") + 0.5) / H).alias("v"), F.lit(0.0).alias("lod"))
    for mode in ("bilinear", "trilinear"):
        assert as_array(S.sample(points, level0, level1, size, W, BIAS, mode), 3) == pytest.approx(decoded, abs=1e-9)
    point = S.sample(points, level0, level1, size, W, BIAS, "point", raw=0)
    assert P.to_array(point.toPandas(), ["s0"]) == pytest.approx(as_array(level0, 1))
    bent = S.sample(points, level0, level1, size, W, BIAS, "bilinear", texture=0, renorm=True)
    assert bent.count() == H * WD
    assert as_array(S.shown_channel(source, 1), 3)[..., 2] == pytest.approx(as_array(source, 3)[..., 1])
    residual = as_array(I.residual(level0, level1, source, size, W, BIAS), 3)
    assert np.clip(residual + as_array(source, 3), 0, 1) == pytest.approx(decoded)


def test_repeated_points_stay_apart(spark, planes):
    _, size, level0, level1 = planes
    flat = level0.select("plane", "x", "y", F.lit(0.5).alias("c0"))
    points = spark.createDataFrame([(0.3, 0.3, 0.0)] * 3 + [(0.9, 0.1, 0.0)], "u double, v double, lod double")
    assert [r["c"] for r in R.trilinear(points, flat, size, ["c"]).collect()] == [0.5] * 4
    assert S.sample(points, level0, level1, size, W, BIAS, "trilinear").count() == 4


@pytest.mark.parametrize("levels", [0, 2])
def test_reads_plan_no_products(spark, levels):
    """Extents never become a join without keys, whichever planes are literals."""
    source = fixtures.pattern(spark, "noise", WD, H)
    size = R.geometry_table(spark, R.geometry(WD, H, levels))
    chain = R.box_chain(source, WD, H, levels) if levels else source
    level0, level1 = I.luma(chain), A.block_means(chain.select("plane", "x", "y", "c0", "c1"), size)
    points = spark.range(5).select((F.col("id") / 5).alias("u"), (F.col("id") / 5).alias("v"), F.lit(0.5).alias("lod"))
    for df in (R.site_rows(level0, level1, chain, size, 4), R.read_level1(level0, level1, size, ["z0", "z1"]), R.trilinear(points, chain, size, ["r", "g", "b"]), S.decode(level0, level1, size, W, BIAS), S.sample(points, level0, level1, size, W, BIAS, "point")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_extents_of_many_planes_are_joined(spark, monkeypatch):
    size = R.geometry_table(spark, R.geometry(64, 64, 3))
    rows = spark.range(6).select(F.col("id").cast("int").alias("plane"))
    want = [(0, 64, 16), (1, 32, 8), (2, 16, 4), (3, 8, 2)]
    got = lambda: sorted(map(tuple, R.with_extent(rows, size, {"a": "w0", "b": "h1"}).collect()))
    assert got() == want
    for sent in (100, 1):
        size._few = None
        monkeypatch.setattr(R, "SENT", sent)
        assert got() == want


def test_source_chain_settings(spark):
    source = fixtures.pattern(spark, "gradient", 16, 8)
    both = R.pack([source, source])
    chain = R.source_chain(both, 16, 8, 1, [{}, {"filter": "box", "srgb": True, "edge": "wrap"}])
    got = as_array(chain.filter("plane = 1"), 6)
    assert got[..., :3] == pytest.approx(P.box_chain(as_array(source, 3), 1)[1])
    assert got.shape == (4, 8, 6) and (got >= 0).all() and (got <= 1).all()
    assert R.source_chain(both, 16, 8, 1, [{"filter": "mitchell", "normal_map": True}] * 2).filter("plane = 1").count() == 32
    for kernel in ("box", "mitchell", "catmullrom"):
        for edge in ("clamp", "wrap"):
            rows = R.axis_weights(10, 5, kernel, edge)
            assert [sum(w for i, _, w in rows if i == o) for o in range(5)] == pytest.approx([1.0] * 5)
    assert sorted(R.axis_weights(8, 4, "box"))[0][2] == pytest.approx(0.5)


@pytest.mark.parametrize("w,h", [(1, 1), (2, 2), (5, 3), (64, 4)])
def test_odd_sizes(spark, w, h):
    source = fixtures.pattern(spark, "noise", w, h)
    assert as_array(R.box(source, w, h), 3) == pytest.approx(P.box_chain(as_array(source, 3), 1)[1])
    padded, wp, hp = R.pad(source, w, h)
    assert as_array(padded, 3) == pytest.approx(np.pad(as_array(source, 3), [(0, hp - h), (0, wp - w), (0, 0)], mode="edge"))
    chain = R.box_chain(source, w, h, 2)
    assert as_array(chain.filter("plane = 2"), 3) == pytest.approx(P.box_chain(as_array(source, 3), 2)[2])


def test_blocks_meet_the_twin(spark):
    source = fixtures.pattern(spark, "noise", WD, H)
    long = R.to_long(source).select("plane", "x", "y", "ch", F.floor(F.col("v") * 255 + 0.5).cast("int").alias("v"))
    packed = B.pack(B.encode(B.gather(long, WD, H), 8), "b")
    r0, r1, sel = L.seed_blocks(np.round(as_array(source, 3) * 255).astype(np.int64))
    for r in packed.collect():
        at = (r["by"], r["bx"], r["ch"])
        assert (r["r0"], r["r1"], list(r["sel"])) == (r0[at], r1[at], sel[at].tolist())
    again = B.unpack(packed.select("plane", "ch", "bx", "by", "b"), "b").orderBy("ch", "by", "bx")
    assert [(r["r0"], r["r1"], list(r["sel"])) for r in again.collect()] == [(r["r0"], r["r1"], list(r["sel"])) for r in packed.orderBy("ch", "by", "bx").collect()]


def test_directions_and_snaps(spark, planes):
    source, size, _, _ = planes
    found = I.leading_direction(A.covariance(source))
    flat = as_array(source, 3).reshape(-1, 3)
    values, vectors = np.linalg.eigh(np.cov(flat.T, bias=True))
    assert found.eigenvalue == pytest.approx(values[-1]) and abs(np.dot(found.direction, vectors[:, -1])) == pytest.approx(1)
    assert I.leading_direction(A.covariance(R.pack([source, source])), by_texture=True).texture in (0, 1)
    seeded = I.seed_channel(source.select(A.projection(source, found.direction, found.mean).alias("p")), 0.25)
    assert seeded.agg(F.max(F.abs("v"))).first()[0] <= 1
    palette = (-1 + 2 * np.arange(8) / 7).astype(np.float32).astype(float)
    snapped = I.snap_palette(I.luma(source), [3], True).toPandas()
    assert np.abs(snapped["c0"].to_numpy()[:, None] - palette).min(1).max() == 0
    grid = I.snap_grid(I.luma(source), [-1.0], [1.0], 5)
    long = grid.select("plane", F.lit(0).alias("ch"), F.col("k0").alias("k"), F.col("c0").alias("v"))
    assert V.grid_violations(long, -1.0, 1.0, 5).filter("off_grid + not_closed > 0").count() == 0


def test_checks(spark, planes):
    source, _, level0, _ = planes
    other = source.withColumn("c1", F.least(F.lit(1.0), F.col("c1") + 0.02))
    diff = V.frame_check(A.frame_diff(source, other), max_diff=0)
    assert {r["ch"]: r["passed"] for r in diff.collect()} == {0: True, 1: False, 2: True}
    with pytest.raises(Exception, match="passed is false"):
        V.require(diff).collect()
    assert V.same_rows(source, source).count() == 0 and V.same_rows(source, other).count() > 0
    named = diff.select(F.lit("frame").alias("name"), "passed", F.col("max_diff").alias("difference"))
    assert V.summary(named).first()["failures"] == 1
    long = R.to_long(source)
    grid = spark.createDataFrame([(c, 0.0, 1.0) for c in range(3)], "ch int, lo double, hi double")
    moved = A.movement(long, R.to_long(other), grid, 255).first()
    assert 0 < moved["moved"] <= H * WD and moved["delta2"] > 0
    assert R.to_wide(long, 3).count() == source.count()


def test_fitted_parts(spark):
    materials = P.with_material(fixtures.pattern(spark, "gradient", 16, 8), "a").unionByName(P.with_material(fixtures.pattern(spark, "checker", 16, 8), "b"))
    rows = P.fit(materials, Options(c0=1, c1=2, rounds=2)).collect()
    assert {(r["material_id"], r["part"]) for r in rows} >= {(m, p) for m in "ab" for p in ("level0", "level1", "r0", "sel", "weights", "bias", "lo0", "hi1")}
    w = next(r for r in rows if r["part"] == "weights")
    assert np.frombuffer(bytes(w["data"]), "<f8").shape == (3 * 5,)
    with pytest.raises(ValueError, match="c0"):
        P.fit_report(materials, Options(c0=9))


def test_keys_of_several_materials(spark):
    one, two = (P.with_material(fixtures.pattern(spark, k, 8, 8), k) for k in ("noise", "gradient"))
    keys = ("material_id", "plane")
    got = R.box(one.unionByName(two), 8, 8, keys)
    assert got.groupBy("material_id").count().count() == 2
    alone = as_array(R.box(fixtures.pattern(spark, "noise", 8, 8), 8, 8), 3)
    assert as_array(got.filter("material_id = 'noise'"), 3) == pytest.approx(alone)


@pytest.mark.skipif(not (DATA / "sf0.1").exists(), reason="test tables are missing")
def test_material_fit_takes_whole_rasters(spark, monkeypatch):
    seen = {}

    def report(materials, options=None):
        seen.update(materials=materials, options=options)
        return spark.createDataFrame([("events", 0, "a", 0.0, 0)], P.REPORT)

    monkeypatch.setattr(P, "fit_report", report)
    raster_queries.queries()["q47_material_fit"](spark, str(DATA / "sf0.1"))
    _, w, h = fixtures.events_raster(spark, str(DATA / "sf0.1"))
    counts = {r["material_id"]: r["count"] for r in seen["materials"].groupBy("material_id").count().collect()}
    assert counts["events"] == w * h > 128 * w
    assert counts["orders"] == fixtures.orders_raster(spark, str(DATA / "sf0.1"))[0].count() > 128 * w
    assert seen["options"].rounds == Options().rounds


def test_sampling_by_gradients(spark, planes):
    """Repeated rows, rows without gradients and an own lod column; round footprints take one probe."""
    _, size, level0, level1 = planes
    data = [(1, 0.31, 0.42, 0.1, 0.0, 0.0, 0.1, 9.0), (1, 0.31, 0.42, 0.1, 0.0, 0.0, 0.1, 9.0), (2, 0.7, 0.2, None, None, None, None, 9.0), (3, 0.5, 0.5, 0.4, 0.0, 0.0, 0.0, 9.0)]
    points = spark.createDataFrame(data, "id int, u double, v double, dudx double, dvdx double, dudy double, dvdy double, lod double")
    got = S.sample_gradients(points, level0, level1, size, W, BIAS, "anisotropic").collect()
    assert sorted(r["id"] for r in got) == [1, 1, 2, 3] and {r["lod"] for r in got} == {9.0}
    assert {r["id"]: r["__probes"] for r in S.footprints(points, size, most=8).collect()}[3] == 8
    still = {r["id"]: r for r in S.sample(points.withColumn("lod", F.lit(0.0)), level0, level1, size, W, BIAS, "trilinear").collect()}
    for mode in ("anisotropic", "trilinear", "bilinear"):
        two = [r for r in S.sample_gradients(points, level0, level1, size, W, BIAS, mode).collect() if r["id"] == 2]
        assert [two[0][f"c{i}"] for i in range(3)] == pytest.approx([still[2][f"c{i}"] for i in range(3)])
    # The mean of the probes along the axis, by hand.
    at = [(0.5 + 0.4 * (i / 9 - 0.5), 0.5, 0.0, i) for i in range(1, 9)]
    probes = spark.createDataFrame(at, "u double, v double, lod double, i int")
    want = [np.mean([r["s0"] for r in S.sample(probes, level0, level1, size, W, BIAS, "trilinear", raw=0).collect()])]
    three = S.sample_gradients(points.filter("id = 3"), level0, level1, size, W, BIAS, "anisotropic", mips=False, raw=0).first()
    assert [three["s0"]] == pytest.approx(want)
    assert S.sample_gradients(points.limit(0), level0, level1, size, W, BIAS, "anisotropic").count() == 0
    assert "NestedLoopJoin" not in S.sample_gradients(points, level0, level1, size, W, BIAS, "anisotropic")._jdf.queryExecution().executedPlan().toString()


def test_sites_by_tile_are_those_of_windows(spark):
    """Two materials and levels, tiles of 8 pixels, holes in both tables, level 1 of any extent."""
    from rasterloom.operators.sites import tiled_site_rows

    keys = ["material", "plane"]
    size, tables = [], ([], [], [])
    for m, (plane, w, h, w1, h1) in enumerate(((0, 21, 19, 5, 4), (1, 10, 9, 2, 2), (0, 33, 7, 33, 7))):
        rng = np.random.default_rng(m)
        name = "a" if m < 2 else "b"
        size.append((name, plane, w, h, w1, h1))
        for rows, n, (a, b), hole in zip(tables, (1, 3, 2), ((w, h), (w, h), (w1, h1)), (False, False, False), strict=True):
            rows += [(name, plane, x, y, *map(float, rng.random(n))) for y in range(b) for x in range(a) if not hole]
    kind = "material string, plane int, x int, y int, "
    level0, source, level1 = (spark.createDataFrame(rows, kind + ", ".join(f"c{i} double" for i in range(n))) for rows, n in zip(tables, (1, 3, 2), strict=True))
    size = spark.createDataFrame(size, "material string, plane int, w0 int, h0 int, w1 int, h1 int")
    for k in (0, 1, 2, 4):
        want, got = (f(level0, level1, source, size, k, keys) for f in (R.site_rows, lambda *a: tiled_site_rows(*a, edge=8)))
        assert set(want.columns) == set(got.columns)
        at = [*keys, "x", "y", "j"]
        both = want.join(got.withColumnsRenamed({c: f"_{c}" for c in got.columns if c not in at}), at, "full")
        apart = [F.abs(F.col(c) - F.col(f"_{c}")) for c in want.columns if c not in at]
        worst = both.agg(F.max(F.greatest(*apart)).alias("worst"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("s0").isNull() | F.col("_s0").isNull()).alias("lacking")).first()
        assert worst["worst"] < 1e-12 and worst["lacking"] == 0 and worst["n"] == got.count() == (k + 1) * (21 * 19 + 10 * 9 + 33 * 7)
    fewer = tiled_site_rows(level0.filter("x <> 3"), level1, source.filter("y <> 2"), size, 1, keys, 8)
    assert fewer.filter("x = 3 or y = 2").count() == 0 and fewer.filter("j = 0").count() == level0.filter("x <> 3 and y <> 2").count()


@pytest.mark.skipif(not (DATA / "sf0.01").exists(), reason="test tables are missing")
def test_resize_gives_halfway_values_exactly(spark):
    """A texel of q09 lies halfway between two roundings: what its sum ends in must not depend on the order of its terms."""
    plane, w, h = fixtures.events_raster(spark, str(DATA / "sf0.01"))
    got = R.resize(plane, w, h, w // 2, h // 2, "catmullrom", "wrap").filter("x = 28 and y = 33").first()["c0"]
    assert got == 0.2015625
