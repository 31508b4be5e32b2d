"""Tiled fits against whole planes."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest

from rasterloom.functions.config import Options
from rasterloom.operators import latents as L
from rasterloom.operators import resample as R
from rasterloom.plans import fit as P
from rasterloom.plans import tiles as T

DATA = Path("/root/testdata/sf0.001")

H, WD, EDGE = 72, 100, 32
CW = [1.0, 0.5, 2.0]
O = Options(c0=1, c1=2, k=4)


def rows(spark, a: np.ndarray, plane: int = 0, name: str = "m"):
    y, x = np.indices(a.shape[:2])
    data = [(name, plane, int(i), int(j), *map(float, a[j, i])) for j, i in zip(y.ravel(), x.ravel(), strict=True)]
    return spark.createDataFrame(data, "material_id string, plane int, x int, y int, " + ", ".join(f"c{i} double" for i in range(a.shape[2])))


@pytest.fixture(scope="module")
def case(spark):
    rng = np.random.default_rng(11)
    f4 = lambda a: a.astype(np.float32).astype(float)
    src = [f4(rng.random((h, w, 3))) for h, w in ((H, WD), (H // 2, WD // 2))]
    v0 = [f4(rng.normal(size=(*s.shape[:2], 1)) * 0.5) for s in src]
    v1 = [f4(rng.normal(size=(h, w, 2)) * 0.5) for h, w in ((H // 4, WD // 4), (H // 8, WD // 8))]
    size = R.geometry_table(spark, [(p, s.shape[1], s.shape[0], z.shape[1], z.shape[0]) for p, (s, z) in enumerate(zip(src, v1, strict=True))])
    assert size.columns == ["plane", "w0", "h0", "w1", "h1"]
    tables = [rows(spark, a[0]).unionByName(rows(spark, a[1], 1)) for a in (v0, v1, src)]
    m = P.Model([L.Plane(*a) for a in zip(v0, v1, src, strict=True)], np.array(CW), P.per_site_weights([s.shape[0] * s.shape[1] for s in src], O.mip_weight, O.mip_mix, O.k), O)
    P.solve_decoder(m)
    return T.cut(*tables, size, EDGE), m, tables


def arrays(df, n):
    pdf = df.toPandas()
    return [P.to_array(pdf[pdf["plane"] == p], [f"c{i}" for i in range(n)]) for p in (0, 1)]


def test_tiles_cover_every_texel_once():
    for h0, w0 in ((72, 100), (500, 333), (31, 8), (257, 128)):
        h1, w1 = max(1, h0 // 4), max(1, w0 // 4)
        grid, seen0, seen1 = T.Grid(h0, w0, h1, w1, EDGE), np.zeros((h0, w0), int), np.zeros((h1, w1), int)
        for ty in range(grid.counts[0]):
            for tx in range(grid.counts[1]):
                for seen, (y, x, h, w) in zip((seen0, seen1), grid.own(ty, tx), strict=True):
                    seen[y : y + h, x : x + w] += 1
        assert (seen0 == 1).all() and (seen1 == 1).all()


def test_narrow_tiles_are_refused(case):
    with pytest.raises(ValueError, match="narrower"):
        T.cut(*case[2], None, 16)


def test_sums_and_planes_are_those_of_whole_planes(spark, case):
    tiles, m, tables = case
    assert tiles.count() == 2 * 3 + 1 and tiles.groupBy("plane", T.colour()).count().count() == 5
    for level0, want, n in ((True, tables[0], 1), (False, tables[1], 2)):
        for got, whole in zip(arrays(T.planes(tiles, level0, n, EDGE), n), arrays(want, n), strict=True):
            assert (got == whole).all()
    found = T.decoders(tiles, CW, O, edge=EDGE)
    w, b = T._decoder_of(found.toPandas(), 3)
    assert w == pytest.approx(m.decoder.w, abs=1e-6) and b == pytest.approx(m.decoder.b, abs=1e-6)
    assert T.errors(tiles, found, CW, O, EDGE).first()["error"] == pytest.approx(m.error(), rel=1e-6)
    again = T.decoders(tiles, CW, O, found, EDGE)
    assert T.errors(tiles, again, CW, O, EDGE).first()["error"] <= m.error() * (1 + 1e-6)


@pytest.mark.parametrize("level0", [False, True])
def test_tiles_meet_the_whole_solution(case, level0):
    """A tile's own system is exact, so passes over the colours go to the minimum of the whole plane."""
    tiles, m, _ = case
    found = T.decoders(tiles, CW, O, edge=EDGE)
    o = Options(c0=1, c1=2, k=4, ridge=0.0)
    before, last = m.error(), []
    for _ in range(3):
        tiles = T.step(tiles, found, T.solving(level0, CW, o), EDGE)
        last.append(T.errors(tiles, found, CW, o, EDGE).first()["error"])
    w, b = m.weights()
    whole = P.Model([L.Plane(p.v0.copy(), p.v1.copy(), p.src) for p in m.planes], m.cw, m.per_site, o, m.decoder)
    for p in whole.planes:
        L.solve(p, w, b, m.cw, 4, 0.0, level0)
    assert before > last[0] >= last[1] - 1e-9 and last[1] >= last[2] - 1e-9
    assert last[2] == pytest.approx(whole.error(), rel=1e-3) and last[2] >= whole.error() - 1e-9


def test_sweeps_and_palettes_stay_on_their_values(case):
    tiles, _, _ = case
    found = T.decoders(tiles, CW, O, edge=EDGE)
    lo, hi = np.full(2, -1.0), np.full(2, 1.0)
    swept = T.step(tiles, found, T.sweeping(False, CW, lo, hi, 6, O), EDGE)
    first = T.errors(swept, found, CW, O, EDGE).first()["error"]
    for v in arrays(T.planes(swept, False, 2, EDGE), 2):
        assert (L.grid_value(lo, hi, 6, L.grid_index(lo, hi, 6, v)) == v).all()
    palette = [np.linspace(-1, 1, 4)]
    searched = T.step(swept, found, T.searching(CW, palette, O), EDGE)
    assert {round(float(x), 5) for v in arrays(T.planes(searched, True, 1, EDGE), 1) for x in v.ravel()} <= {round(float(x), 5) for x in palette[0].astype(np.float32)}
    more = T.step(searched, found, T.sweeping(False, CW, lo, hi, 6, O), EDGE)
    assert T.errors(more, found, CW, O, EDGE).first()["error"] <= T.errors(searched, found, CW, O, EDGE).first()["error"] + 1e-9
    assert first > 0


def test_a_steps_tiles_are_dealt_over_all_cores(spark):
    """Little data for adaptive execution, but work for every core: a step's groups must not be put into a few tasks."""
    rows = spark.createDataFrame([("m", 0, ty, 0) for ty in range(64)], "material_id string, plane int, ty int, tx int")
    from pyspark.sql import functions as F

    def where(pdf):
        from pyspark import TaskContext

        return pdf.assign(task=TaskContext.get().partitionId())[["ty", "task"]]

    found = T._met(rows).applyInPandas(where, "ty int, task int").agg(F.countDistinct("task")).first()[0]
    assert found > spark.sparkContext.defaultParallelism


@pytest.mark.skipif(not DATA.exists(), reason="test tables are missing")
def test_blocks_are_encoded_once_for_all_readers(spark):
    """q62 reads the raster once more per number of bits, for the indices; its three readers of blocks read what is stored."""
    from rasterloom import fit_queries

    plan = fit_queries.NAMES["q62_block_decoders"](spark, str(DATA))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [event_id") == 4


@pytest.mark.parametrize("level0", [False, True])
def test_wide_halos_give_the_whole_planes_sweep(case, level0):
    """One job instead of one a colour of tiles, and every texel is that of the sweep of the whole plane."""
    tiles, m, tables = case
    found = T.decoders(tiles, CW, O, edge=EDGE)
    w, b = T._decoder_of(found.toPandas(), 3)
    o = Options(c0=1, c1=2, k=4, ridge=0.0, q1_sweeps=2)
    n = 1 if level0 else 2
    lo, hi = np.full(n, -1.0), np.full(n, 1.0)
    got = T.step(tiles, found, T.sweeping(level0, CW, lo, hi, 6, o), EDGE, halo=T.reach_of(level0, o, True), k=4)
    moved, delta = 0, 0.0
    for mine, v0, v1, src in zip(arrays(T.planes(got, level0, n, EDGE), n), *(arrays(t, c) for t, c in zip(tables, (1, 2, 3), strict=True)), strict=True):
        p = L.Plane(v0, v1, src)
        index = L.grid_index(lo, hi, 6, v0 if level0 else v1)
        if level0:
            p.k0, p.v0 = index, L.grid_value(lo, hi, 6, index)
        else:
            p.k1, p.v1 = index, L.grid_value(lo, hi, 6, index)
        report = L.grid_sweep(p, w, b, np.array(CW), 4, 0.0, level0, lo, hi, 6, 2)
        moved, delta = moved + report.moved, delta + report.delta_e
        assert (mine == (p.v0 if level0 else p.v1)).all()
    told = got.toPandas()
    assert told["moved"].sum() == moved and told["delta_e"].sum() == pytest.approx(delta, rel=1e-9)
    quick, slow = (T.decoders(t, CW, O, found, EDGE).toPandas() for t in (got, got.drop("gram")))
    for one, other in zip(T._decoder_of(quick, 3), T._decoder_of(slow, 3), strict=True):
        assert one == pytest.approx(other, abs=1e-6)
    assert quick["after"][0] == pytest.approx(slow["after"][0], rel=1e-9)


@pytest.mark.parametrize("level0", [False, True])
def test_wide_halos_give_the_whole_planes_solution(case, level0):
    tiles, m, _ = case
    found = T.decoders(tiles, CW, O, edge=EDGE)
    o = Options(c0=1, c1=2, k=4, ridge=0.0)
    got = T.step(tiles, found, T.solving(level0, CW, o), EDGE, halo=T.reach_of(level0, o, False))
    w, b = m.weights()
    n = 1 if level0 else 2
    for mine, p in zip(arrays(T.planes(got, level0, n, EDGE), n), m.planes, strict=True):
        whole = L.Plane(p.v0.copy(), p.v1.copy(), p.src)
        L.solve(whole, w, b, m.cw, 4, 0.0, level0)
        assert np.abs(mine - (whole.v0 if level0 else whole.v1)).max() < 1e-4


def test_packing_at_once_is_packing_by_turns(spark, case):
    from rasterloom.plans import packing as Q

    tiles, _, _ = case
    found = T.decoders(tiles, CW, O, edge=EDGE)
    lo, hi = [-1.5], [1.25]
    grids = spark.createDataFrame([("m", lo, hi)], Q.GRIDS)
    want = Q.refine(Q.seed(tiles, grids, EDGE), found, grids, CW, O, 2, EDGE)[0].orderBy(*T._KEYS).toPandas()
    blob = T._bytes(np.array(lo + hi + [-1.0, -1.0, 1.0, 1.0]), "<f8")
    from pyspark.sql import functions as F

    got = Q.packed(tiles, found.withColumn("g", F.lit(bytearray(blob))), CW, O, 2, EDGE).orderBy(*T._KEYS).toPandas()
    for name in T._names(Q.PACKED):
        assert got[name].tolist() == want[name].tolist(), name


@pytest.mark.parametrize("level0", [False, True])
def test_small_blocks_are_summed_directly(monkeypatch, level0):
    """A block of few entries needs no monomials of the other level, of which there are more."""
    rng = np.random.default_rng(2)
    p = L.Plane(rng.normal(size=(24, 20, 1)), rng.normal(size=(6, 5, 2)), rng.random((24, 20, 3)))
    w, b = rng.normal(size=(3, 5)), rng.random(3)
    before = L.plane_error(p, w, b, np.array(CW), 4)[0]
    monkeypatch.setattr(L.Form, "matrices", None)
    s = L.assemble(p, w, b, np.array(CW), 4, level0)
    d = rng.normal(size=s.gradient.shape)
    moved = L.Plane(p.v0 + d, p.v1, p.src) if level0 else L.Plane(p.v0, p.v1 + d, p.src)
    assert before + s.change(d) == pytest.approx(L.plane_error(moved, w, b, np.array(CW), 4)[0], rel=1e-10)


def test_changed_tiles_are_handed_on_one_at_a_time(spark, case, monkeypatch):
    """A batch has as many tiles as a task reads; what is made of them must not be held together."""
    from pyspark.sql import functions as F

    from rasterloom.plans import encode as E

    tiles, _, _ = case
    held = []
    monkeypatch.setattr(type(tiles), "mapInPandas", lambda self, work, schema: held.append(work) or self)
    monkeypatch.setattr(T, "_written", lambda df: df)
    E.changed(tiles, tiles.select("material_id").distinct(), EDGE, lambda v0, v1, src, r: (v0, v1))
    batch = tiles.select(*T._names(T.TILE)).filter(F.col("plane") == 0).toPandas()
    assert [len(part) for part in held[0](iter([batch]))] == [1] * len(batch) and len(batch) > 1


def test_halos_are_little_of_a_steps_work():
    """Narrow tiles of a long plane in groups: every tile in one, none too large, and what they read is hardly more than the plane."""
    for extent, edge, halo in (((5000, 100, 1250, 25), 64, 144), ((3000, 2100, 750, 525), 64, 32), ((72, 100, 18, 25), 32, 144), ((31, 8, 7, 2), 32, 16)):
        g, seen0, seen1, read, held = T.Groups(*extent, edge, halo), np.zeros(extent[:2], int), np.zeros(extent[2:], int), 0, []
        for gy in range(g.counts[0]):
            for gx in range(g.counts[1]):
                far, parts = g.reach(gy, gx)[0], [g.single.own(*t) for t in g.members(gy, gx)]
                read += far[2] * far[3]
                assert far[2] * far[3] <= 1.3 * T.GROUPED and all(g.holder(*t) == (gy, gx) for t in g.members(gy, gx))
                held += g.members(gy, gx)
                for own in parts:
                    for seen, (y, x, h, w) in zip((seen0, seen1), own, strict=True):
                        seen[y : y + h, x : x + w] += 1
                assert sum(h * w for (_, _, h, w), _ in parts) == np.prod(g.own(gy, gx)[0][2:]) and sum(h * w for _, (_, _, h, w) in parts) == np.prod(g.own(gy, gx)[1][2:])
        assert (seen0 == 1).all() and (seen1 == 1).all() and len(held) == len(set(held)) == np.prod(g.tiles)
        assert read <= 1.5 * extent[0] * extent[1]


def test_a_step_is_the_same_in_any_groups(spark, case):
    """Tile by tile, in several groups and in one: the same texels, changes, moves and sums for the decoder."""
    from pyspark.sql import functions as F

    from rasterloom.plans import packing as Q

    tiles, _, _ = case
    found = T.decoders(tiles, CW, O, edge=EDGE)
    o, lo, hi = Options(c0=1, c1=2, k=4, ridge=0.0, q1_sweeps=1), np.full(1, -1.0), np.full(1, 1.0)
    halo = T.reach_of(True, o, True)
    blob = T._bytes(np.array([-1.5, 1.25, -1.0, -1.0, 1.0, 1.0]), "<f8")
    assert T.Groups(H, WD, H // 4, WD // 4, EDGE, halo, 6000).counts == (1, 2) and T.Groups(H, WD, H // 4, WD // 4, EDGE, halo).counts == (1, 1)
    steps, packs, sums = [], [], []
    for most in (1, 6000, T.GROUPED):
        got = T.step(tiles, found, T.sweeping(True, CW, lo, hi, 6, o), EDGE, halo=halo, k=4, most=most)
        steps.append(got.orderBy(*T._KEYS).toPandas())
        sums.append(T.decoders(got, CW, O, found, EDGE).toPandas())
        packs.append(Q.packed(tiles, found.withColumn("g", F.lit(bytearray(blob))), CW, O, 1, EDGE, most).orderBy(*T._KEYS).toPandas())
    for step, pack, told in zip(steps[1:], packs[1:], sums[1:], strict=True):
        assert len(step) == len(pack) == 7
        for name in T._names(T.TILE):
            assert step[name].tolist() == steps[0][name].tolist(), name
        for name in T._names(Q.PACKED):
            assert pack[name].tolist() == packs[0][name].tolist(), name
        assert step["moved"].sum() == steps[0]["moved"].sum() > 0 and step["delta_e"].sum() == pytest.approx(steps[0]["delta_e"].sum(), rel=1e-9)
        assert told["after"][0] == pytest.approx(sums[0]["after"][0], rel=1e-9)
    assert [int(s["gram"].notna().sum()) for s in steps] == [7, 3, 2]


@pytest.mark.parametrize("level0", [False, True])
def test_sites_are_read_channel_by_channel(monkeypatch, level0):
    """A step's system and the decoder's products come from arrays over sites, one channel after another; no table of sites is kept for them."""
    rng = np.random.default_rng(5)
    p = L.Plane(rng.normal(size=(24, 20, 2)), rng.normal(size=(6, 5, 3)), rng.random((24, 20, 3)), kept=None)
    w, b, cw = rng.normal(size=(3, 11)), rng.random(3), np.array(CW)
    before = L.plane_error(p, w, b, cw, 4)[0]
    table = [np.concatenate([T.D.phi_matrix(t0.read(p.v0), t1.read(p.v1)), np.ones((len(t), 1)), t], 1) for _, t0, t1, t in L.sites(p, 4)]
    for holder, name in ((L.Form, "slope"), (L.Form, "constant"), (T.D, "phi_matrix")):
        with monkeypatch.context() as without:
            without.setattr(holder, name, None)
            s, gram = L.assemble(p, w, b, cw, 4, level0), T._gram(p, 4)
    assert p.kept is None and gram == pytest.approx(sum(t.T @ t for t in table), rel=1e-12)
    d = rng.normal(size=s.gradient.shape)
    moved = L.Plane(p.v0 + d, p.v1, p.src) if level0 else L.Plane(p.v0, p.v1 + d, p.src)
    assert before + s.change(d) == pytest.approx(L.plane_error(moved, w, b, cw, 4)[0], rel=1e-10)
