"""Solvers against dense systems and brute force; invariants of a whole fit."""

from __future__ import annotations

import numpy as np
import pytest

from rasterloom.functions.config import Options, violations
from rasterloom.operators import decoder as D
from rasterloom.operators import latents as L
from rasterloom.plans import fit as P

RNG = np.random.default_rng(3)
H, WD, C0, C1, NOUT = 20, 12, 2, 3, 3
W = RNG.normal(size=(NOUT, C1 + C0 + C0 * C1)) * 0.3
B = RNG.random(NOUT)
CW = np.array([1.0, 0.5, 2.0])


def plane() -> L.Plane:
    rng = np.random.default_rng(5)
    return L.Plane(rng.normal(size=(H, WD, C0)) * 0.5, rng.normal(size=(H // 4, WD // 4, C1)) * 0.5, rng.random((H, WD, NOUT)))


def error(p: L.Plane, k: int = 4) -> float:
    return L.plane_error(p, W, B, CW, k)[0]


def naive_error(p: L.Plane, k: int) -> float:
    """Every site on its own."""
    total = 0.0
    h0, w0 = p.size0

    def read(a, x, y):
        h, w = a.shape[:2]
        x0, y0 = int(np.floor(x)), int(np.floor(y))
        out = 0.0
        for dx in (0, 1):
            for dy in (0, 1):
                weight = (x - x0 if dx else 1 - x + x0) * (y - y0 if dy else 1 - y + y0)
                out = out + weight * a[min(h - 1, max(0, y0 + dy)), min(w - 1, max(0, x0 + dx))]
        return out

    for j in range(k + 1):
        dx, dy = (o.reshape(h0, w0) for o in L.site_offsets(h0, w0, k, j))
        for y in range(h0):
            for x in range(w0):
                sx, sy = x + dx[y, x], y + dy[y, x]
                s, t = read(p.v0, sx, sy), read(p.src, sx, sy)
                z = read(p.v1, (sx + 0.5) * p.size1[1] / w0 - 0.5, (sy + 0.5) * p.size1[0] / h0 - 0.5)
                phi = np.concatenate([z, s, np.outer(s, z).ravel()])
                total += float((CW * (W @ phi + B - t) ** 2).sum())
    return total


@pytest.mark.parametrize("k", [0, 1, 2, 4])
def test_objective_is_the_sum_over_sites(k):
    assert L.plane_error(plane(), W, B, CW, k)[0] == pytest.approx(naive_error(plane(), k), rel=1e-10)


@pytest.mark.parametrize("level0", [False, True])
def test_stencil_is_the_exact_quadratic(level0):
    p = plane()
    s = L.assemble(p, W, B, CW, 4, level0)
    d = RNG.normal(size=s.gradient.shape) * 0.1
    q = L.Plane(p.v0 + d if level0 else p.v0, p.v1 if level0 else p.v1 + d, p.src)
    assert error(q) == pytest.approx(error(p) + 2 * (s.gradient * d).sum() + (d * s.apply(d)).sum(), rel=1e-10)


@pytest.mark.parametrize("level0", [False, True])
def test_iteration_meets_the_dense_solution(level0):
    s = L.assemble(plane(), W, B, CW, 4, level0)
    x, report = L.conjugate_gradients(s, 1e-4)
    a, r = L.dense_system(s, 1e-4 * s.mean_diagonal)
    assert np.abs(np.linalg.solve(a, r) - x.ravel()).max() < 1e-6
    assert report.residual < 1e-6


@pytest.mark.parametrize("bits", range(3, 9))
def test_grid_is_closed(bits):
    lo, hi = np.array(-0.7), np.array(1.3)
    k = np.arange(1 << bits)
    assert (L.grid_index(lo, hi, bits, L.grid_value(lo, hi, bits, k)) == k).all()
    assert (L.grid_index(np.array(1.0), np.array(1.0), bits, k.astype(float)) == 0).all()


def test_grid_sweep_falls_and_stays_on_the_grid():
    lo, hi = np.full(C1, -1.0), np.full(C1, 1.0)
    p = plane()
    p.k1 = L.grid_index(lo, hi, 4, p.v1)
    p.v1 = L.grid_value(lo, hi, 4, p.k1)
    errors = [error(p)]
    for _ in range(3):
        L.grid_sweep(p, W, B, CW, 4, 1e-4, False, lo, hi, 4, 1)
        errors.append(error(p))
    assert errors == sorted(errors, reverse=True) and errors[-1] < errors[0]
    assert (L.grid_value(lo, hi, 4, p.k1) == p.v1).all()


def test_palette_step_is_the_best_single_change():
    palette = np.linspace(-1, 1, 4)
    p = plane()
    p.k0 = np.abs(p.v0[..., None] - palette).argmin(-1)
    p.v0 = palette[p.k0]
    L.palette_search(p, W, B, CW, 4, [palette] * C0)
    best = error(p)
    # The last colour's texels can't be improved by any state of their own.
    for y, x in ((1, 1), (3, 5), (19, 11)):
        for state in np.ndindex(4, 4):
            q = L.Plane(p.v0.copy(), p.v1, p.src)
            q.v0[y, x] = palette[list(state)]
            assert error(q) >= best - 1e-9


def test_block_refinement_only_falls():
    lo, hi = np.full(C0, -1.5), np.full(C0, 1.5)
    p = plane()
    p.k0 = L.grid_index(lo, hi, 8, p.v0)
    p.blocks = L.seed_blocks(p.k0)
    p.v0 = L.block_values(p.blocks, H, WD, lo, hi)
    before = error(p)
    reports = L.refine_blocks(p, W, B, CW, 4, lo, hi)
    assert error(p) == pytest.approx(before + sum(r.delta_e for r in reports), rel=1e-9) and error(p) < before
    assert np.array_equal(L.block_values(p.blocks, H, WD, lo, hi), p.v0)


def test_decoder_ladder():
    v = RNG.normal(size=(200, 5))
    a, r = v.T @ v, v.T @ RNG.normal(size=(200, 3))
    first = D.solve(a, r, [1, 1, 1], 200)
    assert first.rung == 0
    assert np.abs(np.linalg.solve(a, r) - np.concatenate([first.w.T, first.b[None]])).max() < 1e-4
    assert D.solve(a, r, [1, 1, 1], 200, first).rung == 0  # a step of nothing is taken
    empty = D.solve(np.zeros((5, 5)), np.zeros((5, 3)), [1, 1, 1], 0)
    assert np.isfinite(empty.b).all()
    assert D.gauss_jordan(np.zeros((2, 2)), np.ones((2, 1))) is None


def picture(kind: str, h: int, w: int) -> np.ndarray:
    y, x = np.indices((h, w))
    flat = {"black": 0, "white": 255, "grey": 128}
    if kind in flat:
        return np.full((h, w, 3), flat[kind] / 255)
    if kind == "dot":
        out = np.zeros((h, w, 3))
        out[18 % h, 50 % w] = 1
        return out
    one = {"gradient": x / max(1, w - 1), "noise": ((x * 7919 + y * 104729) % 256) / 255, "stripes": (x % 2) * 1.0, "checker": ((x + y) % 2) * 1.0}[kind]
    return np.repeat(one[..., None], 3, 2)


@pytest.mark.parametrize("kind", ["black", "white", "grey", "gradient", "noise", "stripes", "checker", "dot"])
@pytest.mark.parametrize("h,w", [(4, 4), (20, 12), (4, 64)])
def test_fit_never_rises(kind, h, w):
    for o in (Options(c0=1, c1=2, rounds=4), Options(c0=2, c1=2, rounds=3, l0="palette", bits0=(2,))):
        _, report = P.fit_planes(P.box_chain(picture(kind, h, w), 0), o, [1, 1, 1])
        assert all(np.isfinite(r[2]) for r in report)
        for before, after in zip(report, report[1:], strict=False):
            if after[1] in ("a", "b", "c", "repack", "refit", "refine") and not before[1].startswith("seed"):
                assert after[2] <= before[2] * (1 + 1e-6) + 1e-12, (before, after)


def test_wide_material():
    src = np.concatenate([picture(k, 24, 24) for k in ("gradient", "noise", "checker", "white", "stripes", "grey")], 2)
    m, report = P.fit_planes(P.box_chain(src, 1), Options(c0=2, c1=4, rounds=2), [1.0] * 18)
    assert m.decoder.w.shape == (18, 14) and report[-1][2] < report[0][2]


def test_options_are_checked():
    assert violations(Options(), 1) == []
    assert violations(Options(c0=5, k=3, mip_mix=1.0), 7)


def test_probe_is_the_gradient_and_vanishes_at_the_minimum():
    p, step = plane(), 1e-2
    slopes = np.abs(2 * L.assemble(p, W, B, CW, 4, False).gradient)
    found = L.gradient_probe(p, W, B, CW, 4, step, 400, 1.0) / step
    assert found == pytest.approx(slopes.max(), rel=1e-4)  # enough probes to meet the steepest of 45
    scale = error(p)
    for _ in range(3):
        L.solve(p, W, B, CW, 4, 0.0, False)
    assert L.gradient_probe(p, W, B, CW, 4, step, 20, scale) < 1e-5
    assert L.gradient_probe(p, W, B, CW, 4, step, 5, 0.0) == 0.0
