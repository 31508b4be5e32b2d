"""Quads, the second block decoder and the comparison of models, against plain versions."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions.config import Options
from rasterloom.operators import blocks as B
from rasterloom.operators.sampling import GRADIENTS, quad_gradients
from rasterloom.operators.verify import compare_models, float32_place, model_values
from rasterloom.plans import fit as P


def plain_gradients(pixels, fine):
    at = {(x, y): (u, v) for x, y, u, v in pixels}
    out = {}
    for x, y in at:
        x0, y0 = x // 2 * 2, y // 2 * 2
        diffs = []
        for a, b, own in (((0, 0), (1, 0), y - y0), ((0, 0), (0, 1), x - x0)):
            along = lambda k, a=a, b=b: ((x0 + a[0] + (k if b[1] else 0), y0 + a[1] + (0 if b[1] else k)), (x0 + b[0] + (k if b[1] else 0), y0 + b[1] + (0 if b[1] else k)))
            first = own if fine else 0
            found = next(((at[q][0] - at[p][0], at[q][1] - at[p][1]) for p, q in (along(first), along(1 - first)) if p in at and q in at), (0.0, 0.0))
            diffs.append(found)
        out[x, y] = (diffs[0][0], diffs[0][1], diffs[1][0], diffs[1][1])
    return out


@pytest.mark.parametrize("fine", [False, True])
def test_quads(spark, fine):
    rng = np.random.default_rng(9)
    cells = [(x, y) for x in range(-3, 6) for y in range(7)]
    pixels = [(x, y, *map(float, rng.random(2))) for i, (x, y) in enumerate(cells) if i % 5]
    df = spark.createDataFrame([(*p, "a", "tag") for p in pixels], "px int, py int, u double, v double, frame string, fine string")
    got = quad_gradients(df, fine, ["frame"])
    assert got.columns == [*df.columns, *GRADIENTS]
    want = plain_gradients(pixels, fine)
    rows = got.collect()
    assert len(rows) == len(pixels)
    for r in rows:
        assert [r[g] for g in ("dudx", "dvdx", "dudy", "dvdy")] == pytest.approx(want[r["px"], r["py"]])
    twice = quad_gradients(df.unionByName(df), fine, ["frame"])
    assert twice.count() == 2 * len(pixels) and twice.distinct().count() == len(pixels)
    assert quad_gradients(df.limit(0), fine).count() == 0
    with pytest.raises(ValueError, match="gradients already"):
        quad_gradients(got)


def test_both_block_decoders(spark):
    """All orders of ends, all selectors: exact fractions, and the other decoder's float32."""
    rng = np.random.default_rng(1)
    ends = [(0, 255), (255, 0), (7, 7), (200, 13), (13, 200), (1, 0), (254, 255)]
    blocks = [(0, 0, i, 0, a, b, rng.permutation(16).tolist()) for i, (a, b) in enumerate(ends)]
    blocks = [(*row[:6], [int(s) % 8 for s in row[6]]) for row in blocks]
    df = spark.createDataFrame(blocks, "plane int, ch int, bx int, by int, r0 int, r1 int, sel array<int>")
    packed = B.pack(df, "bytes")
    got = {(r["x"], r["y"]): Fraction(r["num"], r["den"]) for r in B.decode_exact(packed, "bytes", 26, 3).collect()}
    assert len(got) == 26 * 3
    for _, _, bx, _, a, b, sel in blocks:
        table = [Fraction(a), Fraction(b), *([Fraction((8 - i) * a + (i - 1) * b, 7) for i in range(2, 8)] if a > b else [*(Fraction((6 - i) * a + (i - 1) * b, 5) for i in range(2, 6)), Fraction(0), Fraction(255)])]
        for t, s in enumerate(sel):
            if (bx * 4 + t % 4, t // 4) in got:
                assert got[bx * 4 + t % 4, t // 4] == table[s]
    told = B.decoders_agree(packed, "bytes", 26, 3).first()
    assert (told["n"], told["differ"], told["worst"], told["lacking"]) == (78, 0, 0.0, 0) and told["total35"] == 35 * sum(got.values())


def test_places_of_float32(spark):
    values = np.array([0.0, 1.0, -1.0, 1.5, np.nextafter(np.float32(1), np.float32(0)), np.nextafter(np.float32(1), np.float32(2)), 3e38, 1e-38, 1e-45, -1e-45, 2.0**-126, 2.0**-127, 8.0, np.nextafter(np.float32(8), np.float32(0)), -3.14], np.float32)
    bits = values.view(np.int32).astype(int)
    want = np.where(bits < 0, -(bits & 0x7FFFFFFF), bits)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    got = [r["p"] for r in df.select("i", float32_place(F.col("v")).alias("p")).orderBy("i").collect()]
    assert got == want.tolist()


def test_models_are_compared(spark):
    one = np.float32(1)
    a = [("m", "weights", -1, i, "value", v) for i, v in enumerate((1.0, 2.0, 0.0, 5.0))] + [("m", "level0", 0, i, "choice", v) for i, v in enumerate((3.0, 7.0, 9.0))]
    b = [("m", "weights", -1, i, "value", v) for i, v in enumerate((float(np.nextafter(one, one * 2)), 2.001, 0.0))] + [("m", "level0", 0, i, "choice", v) for i, v in enumerate((3.0, 8.0, 4.0))] + [("n", "bias", -1, 0, "value", 1.0)]
    schema = "material_id string, part string, plane int, at long, kind string, v double"
    got = {(r["material_id"], r["part"]): r for r in compare_models(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).collect()}
    w = got["m", "weights"]
    assert (w["n"], w["only_a"], w["only_b"], w["equal"], w["flips"], w["beyond"], w["same"]) == (3, 1, 0, 1, 0, 1, False)
    assert w["worst_ulps"] == int(np.float32(2.001).view(np.int32)) - int(np.float32(2).view(np.int32)) and w["worst_rel"] == pytest.approx(0.001 / 2.001, rel=1e-3)
    k = got["m", "level0"]
    assert (k["n"], k["equal"], k["flips"], k["worst_flip"], k["same"]) == (3, 1, 2, 5, True)
    assert got["n", "bias"]["only_b"] == 1 and not got["n", "bias"]["same"]


def test_one_fit_however_its_rows_are_dealt(spark):
    """A material's rows in one partition and in seven give one model, value by value."""
    y, x = np.indices((24, 32))
    data = [("m", 0, int(i), int(j), *(float((i * k + j * 7) % 23) / 23 for k in (3, 5, 11))) for i, j in zip(x.ravel(), y.ravel(), strict=True)]
    rows = spark.createDataFrame(data, "material_id string, plane int, x int, y int, c0 double, c1 double, c2 double")
    o = Options(c0=1, c1=2, rounds=2, q1_start=1, mips=False, bc_outer=0, bc_refine=1)
    one, seven = (model_values(P.fit(rows.repartition(n), o)) for n in (1, 7))
    told = compare_models(one, seven).collect()
    assert {r["part"] for r in told} >= {"weights", "bias", "level0", "level1", "r0", "r1", "sel"}
    assert all(r["same"] and r["flips"] == 0 and r["worst_ulps"] == 0 and r["equal"] == r["n"] > 0 for r in told)


def test_decoded_texels_are_not_broadcast(spark):
    """Blocks are stored in a few bytes, so the texels they decode to look small to the planner: none of them goes through the driver."""
    import re

    import __spark_entry__ as e

    df = e.queries()["q62_block_decoders"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Broadcast\w*Join \[[^\]]*\bx#", plan) and len(re.findall(r"SortMergeJoin \[[^\]]*\bx#", plan)) == 8
