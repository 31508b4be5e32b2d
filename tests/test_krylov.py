"""Solves and packs across tiles against the same on whole planes."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.test_tiles import CW, EDGE, O, arrays, case  # noqa: F401

from rasterloom.functions.config import Options
from rasterloom.operators import latents as L
from rasterloom.operators.order import order_statistics
from rasterloom.plans import krylov as K
from rasterloom.plans import packing as Q
from rasterloom.plans import tiles as T


def whole_planes(tables):
    both = [arrays(t, n) for t, n in zip(tables, (1, 2, 3), strict=True)]
    return [L.Plane(*(a[p].astype(np.float32).astype(float) for a in both)) for p in (0, 1)]


@pytest.mark.parametrize("level0", [False, True])
def test_krylov_gives_the_dense_solution(case, level0):  # noqa: F811
    tiles, _, tables = case
    found = T.decoders(tiles, CW, O, edge=EDGE)
    w, b = T._decoder_of(found.toPandas(), 3)
    o = Options(c0=1, c1=2, k=4, ridge=1e-3)
    got = K.solve(tiles, found, level0, CW, o, EDGE)
    n = 1 if level0 else 2
    told = got.report.toPandas().set_index("plane")
    assert (told["residual"] < 1e-9).all() and (told["iterations"] > 0).all() and len(told) == 2
    for p, (d, plane) in enumerate(zip(arrays(K.corrected(got, level0, n, EDGE), n), whole_planes(tables), strict=True)):
        s = L.assemble(plane, w, b, np.array(CW), 4, level0)
        lam = 1e-3 * s.mean_diagonal
        if not level0:
            a, r = L.dense_system(s, lam)
            assert d.ravel() == pytest.approx(np.linalg.solve(a, r), abs=1e-6)
        else:
            assert d == pytest.approx(L.conjugated(s, lam)[0], abs=1e-6)
        moved = arrays(T.planes(got.tiles, level0, n, EDGE), n)[p]
        before = plane.v0 if level0 else plane.v1
        assert moved == pytest.approx(before + d, rel=1e-6, abs=1e-6)


def test_krylov_sends_rings_not_planes(case):  # noqa: F811
    """What a tile gives to another is a texel wide, so it grows with its edge, not its area."""
    tiles, _, _ = case
    rows = K.systems(tiles, T.decoders(tiles, CW, O, edge=EDGE), False, CW, O, EDGE)
    empty = [F.lit(None).cast("binary").alias(n) for n in ("x", "r", "p", "s", "u", "w")]
    ready = rows.select("*", *empty, F.lit(0.0).alias("alpha"), F.lit(0.0).alias("beta"), F.lit(0.1).alias("lam"))
    sent = [r["rect"] for r in K._advance(ready, False, EDGE).filter("x is null").collect()]
    assert sent and all(min(rect[2:]) == 1 for rect in sent)


def test_krylov_stops_and_freezes(case):  # noqa: F811
    tiles, _, _ = case
    found = T.decoders(tiles, CW, O, edge=EDGE)
    few = K.solve(tiles, found, False, CW, O, EDGE, most=2)
    assert max(few.report.toPandas()["iterations"]) == 2
    errors = lambda t: T.errors(t, found, CW, O, EDGE).first()["error"]
    assert errors(few.tiles) < errors(tiles)


def test_packing_by_tiles_is_packing_whole(spark, case):  # noqa: F811
    tiles, _, tables = case
    found = T.decoders(tiles, CW, O, edge=EDGE)
    w, b = T._decoder_of(found.toPandas(), 3)
    lo, hi = np.array([-1.5]), np.array([1.25])
    grids = spark.createDataFrame([("m", lo.tolist(), hi.tolist())], Q.GRIDS)
    packed = Q.seed(tiles, grids, EDGE)
    refined, told = Q.refine(packed, found, grids, CW, O, 3, EDGE)
    planes = whole_planes(tables)
    improved = np.zeros(3, int)
    for p in planes:
        p.blocks = L.seed_blocks(L.grid_index(lo, hi, 8, p.v0))
        p.v0 = L.block_values(p.blocks, *p.size0, lo, hi)
    for got, p in zip(arrays(T.planes(packed, True, 1, EDGE), 1), planes, strict=True):
        assert (got == p.v0).all()
    for p in planes:
        for i, r in enumerate(L.refine_blocks(p, w, b, np.array(CW), 4, lo, hi, 3)):
            improved[i] += r.improved
    for got, p in zip(arrays(T.planes(refined, True, 1, EDGE), 1), planes, strict=True):
        assert got == pytest.approx(p.v0, abs=1e-6)
    report = told.orderBy("pass").toPandas()
    assert report["improved"].tolist() == improved[: len(report)].tolist() and (report["delta_e"] <= 0).all()
    errors = lambda t: T.errors(t.select(*T._names(T.TILE)), found, CW, O, EDGE).first()["error"]
    assert errors(refined) < errors(packed)
    versions = Q.Versions(packed)
    nobody = spark.createDataFrame([], "material_id string")
    assert versions.accept(refined, nobody).exceptAll(packed).isEmpty()
    assert versions.accept(refined, spark.createDataFrame([("m",)], "material_id string")).exceptAll(refined).isEmpty()
    assert versions.restore(2) is packed
    with pytest.raises(ValueError, match="within blocks"):
        Q.seed(tiles, grids, 34)


@pytest.mark.parametrize("bins", [7, 4096])
def test_order_statistics(spark, bins):
    rng = np.random.default_rng(4)
    groups = {"a": rng.normal(size=700), "b": np.repeat([3.0, -2.0, 7.5], [400, 1, 30]), "c": np.array([5.0]), None: rng.integers(0, 9, 200) * 1e300 - 4e300, "e": np.exp(rng.normal(size=300) * 9) * rng.choice([-1, 1], 300), "z": np.array([-0.0, 0.0, 0.0])}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("a", None), ("a", float("nan")), ("n", None)]
    table = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = {"lo": 0.001, "mid": 0.5, "hi": 0.999, "max": 1.0, "min": 0.0}
    got = {r["g"]: r for r in order_statistics(table, ["g"], "v", shares, bins).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        v = np.sort(values)
        for name, q in shares.items():
            assert got[g][name] == v[int(q * (len(v) - 1) + 0.5)]
    assert order_statistics(table.limit(0), ["g"], "v", shares, bins).count() == 0
    alone = order_statistics(table.filter("g = 'a'"), [], "v", {"mid": 0.5}, bins).collect()
    assert [r["mid"] for r in alone] == [np.sort(groups["a"])[int(0.5 * 699 + 0.5)]]
