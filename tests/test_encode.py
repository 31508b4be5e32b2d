"""The fit by tiles against the fit of whole planes."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.test_tiles import rows

from rasterloom.functions.config import Options
from rasterloom.plans import encode as E
from rasterloom.plans import fit as P
from rasterloom.plans import tiles as T


def picture(h: int, w: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    y, x = np.indices((h, w)) / 16.0
    waves = np.stack([np.sin(x + seed) * np.cos(y), np.cos(x * 1.7), np.sin(y * 0.9 + x)], 2)
    return np.floor(np.clip(0.5 + 0.3 * waves + 0.08 * rng.normal(size=(h, w, 3)), 0, 1) * 255) / 255


def whole(a: np.ndarray, o: Options):
    padded = np.pad(a, [(0, -a.shape[0] % 4), (0, -a.shape[1] % 4), (0, 0)], mode="edge")
    chain = P.box_chain(padded, len(sizes_of(padded, o)) - 1)
    return P.fit_planes([c.astype(np.float32).astype(float) for c in chain], o, [1.0] * 3)


def sizes_of(a: np.ndarray, o: Options):
    return T.R.geometry(a.shape[1], a.shape[0], T.R.mip_count(a.shape[1], a.shape[0], o.mip_min) if o.mips else 0)


@pytest.mark.parametrize(("options", "edge"), [(Options(c0=1, c1=2, rounds=3, bc_refine=2, bc_outer=1, mip_min=16), 128), (Options(c0=1, c1=2, l0="palette", bits0=(2,), rounds=2, q1_start=1, init="pca", mips=False), 128)])
def test_one_tile_is_the_whole_plane(spark, tmp_path, options, edge):
    """Planes of a single tile go through the same steps as in one task."""
    a = picture(68, 100, 1)
    chain, sizes = E.chain_of(rows(spark, a).drop("material_id"), 100, 68, "m", options)
    got = E.encode(chain, sizes, [1.0] * 3, options, edge)
    m, report = whole(a, options)
    mine = {(r["round"], r["block"]): r["error"] for r in got.report.collect()}
    theirs = {(n, block): e for n, block, e, _ in report}
    common = set(mine) & set(theirs)
    assert {(1, "a"), (1, "b"), (1, "c")} <= common and any(b == "freeze" for _, b in common)
    for key in common:
        assert mine[key] == pytest.approx(theirs[key], rel=0.02), key
    assert min(mine.values()) == pytest.approx(min(theirs.values()), rel=0.02)
    final = T.errors(got.tiles.select(*T._names(T.TILE)), got.models, [1.0] * 3, options, edge).first()["error"]
    assert final == pytest.approx(m.error(), rel=0.02)
    check_files(spark, got, sizes, options, edge, f"file:{tmp_path}/one")


def check_files(spark, got, sizes, o, edge, root):
    """What the files of an encode give back is what its tiles hold."""
    from rasterloom.sources import asset

    asset.write_encoded(got, sizes, root, o, edge)
    for name in {r["material_id"] for r in got.models.collect()}:
        found = asset.load(spark, root, name)
        for level0, plane, n in ((True, found.level0, o.c0), (False, found.level1, o.c1)):
            mine = T.planes(got.tiles.filter(f"material_id = '{name}'"), level0, n, edge).drop("material_id")
            both = mine.join(plane.withColumnsRenamed({f"c{i}": f"d{i}" for i in range(n)}), ["plane", "x", "y"], "full")
            worst = both.agg(*[F.max(F.abs(F.col(f"c{i}") - F.col(f"d{i}"))).alias(f"w{i}") for i in range(n)], F.count_if(F.col("c0").isNull() | F.col("d0").isNull()).alias("lacking")).first()
            assert worst["lacking"] == 0 and all(worst[f"w{i}"] < 1e-6 for i in range(n))
        assert asset.closure(found).filter("off_grid > 0 or not_closed > 0").count() == 0


def test_materials_of_many_tiles(spark, tmp_path):
    """Two materials that settle at different rounds; the tiles' fit ends near the whole planes'."""
    o = Options(c0=1, c1=2, rounds=6, tol=2e-3, q1_start=1, bc_refine=1, bc_outer=1, mips=False)
    flat = np.full((64, 96, 3), 0.25)
    chain, sizes = E.chain_of(rows(spark, picture(64, 96, 2)).drop("material_id"), 96, 64, "busy", o)
    other, _ = E.chain_of(rows(spark, flat).drop("material_id"), 96, 64, "flat", o)
    got = E.encode(chain.unionByName(other), sizes, [1.0] * 3, o, 32)
    report = got.report.toPandas()
    rounds = report[report["block"] == "c"].groupby("material_id")["round"].max()
    assert rounds["flat"] == rounds["busy"]  # the last steps are taken by all
    settled = report[(report["block"] == "a")].groupby("material_id")["round"].nunique()
    assert settled["flat"] < settled["busy"]
    m, theirs = whole(picture(64, 96, 2), o)
    final = {r["material_id"]: r["error"] for r in T.errors(got.tiles.select(*T._names(T.TILE)), got.models, [1.0] * 3, o, 32).collect()}
    assert final["busy"] == pytest.approx(m.error(), rel=0.1) and final["flat"] < 1e-6
    busy = report[(report["material_id"] == "busy") & report["block"].isin(["a", "b", "c"])]
    for n, part in busy.groupby("round"):
        e = part["error"].tolist()
        assert n == 0 or all(b <= a * (1 + 1e-6) for a, b in zip(e, e[1:])) or part["block"].iloc[0] != "a"
    last = report[report["round"] == report["round"].max()].set_index(["material_id", "block"])["error"]
    assert last["busy", "refit"] <= last["busy", "pack"] * (1 + 1e-6)
    check_files(spark, got, sizes, o, 32, f"file:{tmp_path}/many")
    grids = {r["material_id"]: r for r in got.grids.collect()}
    for name in ("busy", "flat"):
        v1 = T.planes(got.tiles.filter(f"material_id = '{name}'"), False, 2, 32).toPandas()
        for c in range(2):
            lo, hi = grids[name]["lo1"][c], grids[name]["hi1"][c]
            v = v1[f"c{c}"].to_numpy()
            assert (np.abs((v - lo) / (hi - lo) * 255 - np.round((v - lo) / (hi - lo) * 255)) < 1e-3).all()


def test_large_materials_go_by_tiles(spark, tmp_path):
    """A material beyond what a task holds is fitted and written without a group of its pixels, beside one that is not; both as in one task."""
    from rasterloom.sources import asset

    o = Options(c0=1, c1=2, rounds=4, bc_refine=1, bc_outer=1, mips=False)
    big, little = picture(68, 52, 3), picture(12, 8, 4)
    both = rows(spark, big, name="big").unionByName(rows(spark, little, name="little"))
    report = P.fit_report(both, o, most=1000)
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 1 and "LEFT ANTI" in plan.upper().replace("LEFTANTI", "LEFT ANTI")
    got = {}
    for r in report.collect():
        got.setdefault(r["material_id"], []).append((r["round"], r["block"], r["error"]))
    for name, a in (("big", big), ("little", little)):
        want = {(n, block): e for n, block, e, _ in whole(a, o)[1]}
        assert {k[:2] for k in got[name]} & set(want) >= {(1, "a"), (1, "b"), (1, "c"), (3, "freeze"), (4, "c")}
        for n, block, e in got[name]:
            if (n, block) in want:
                assert e == pytest.approx(want[n, block], rel=1e-2), (name, n, block)
    root = f"file:{tmp_path}/fitted"
    asset.write_fitted(both, root, o, most=1000)
    for name, a in (("big", big), ("little", little)):
        told = asset.quality(asset.load(spark, root, name), rows(spark, a).drop("material_id")).filter("texture = 0").first()
        assert told["psnr"] > 15
