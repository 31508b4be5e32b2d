"""Fitting materials: initial planes, the alternating rounds, the pack.

A material of up to ``GROUP_PIXELS`` is one group of ``applyInPandas``: its planes, decoder and grids live in
one task, so a round costs no shuffle, and any number of materials fit side by
side.  A group's memory and time grow with one material's pixels, so ``fit_report`` and ``asset.write_fitted``
take larger ones through ``plans.encode``, tile by tile; ``fit`` alone gives planes as values and has no other way.

Every step lowers the error or leaves it (but for the round in which the grids are
frozen), and the report says so round by round.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.config import Options, violations
from rasterloom.operators import decoder as D
from rasterloom.operators import latents as L
from rasterloom.operators.aggregate import output_weights
from rasterloom.operators.resample import distinct_first
from rasterloom.schema import channels

PERCENTILE, BINS = 0.99, 4096
#: Pixels of a material up to which one task fits it.
GROUP_PIXELS = 1 << 18
LUMA = (0.299, 0.587, 0.114)


@dataclass
class Model:
    planes: list[L.Plane]
    cw: np.ndarray
    per_site: np.ndarray
    options: Options
    decoder: D.Decoder | None = None
    lo0: np.ndarray | None = None
    hi0: np.ndarray | None = None
    lo1: np.ndarray | None = None
    hi1: np.ndarray | None = None
    palettes: list[np.ndarray] = field(default_factory=list)
    frozen: bool = False
    decoders: list[D.Decoder] = field(default_factory=list)

    @property
    def block_format(self) -> bool:
        return self.options.l0 == "bc8"

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        return self.decoder.w.astype(float), self.decoder.b.astype(float)

    def error(self) -> float:
        w, b = self.weights()
        k = self.options.k
        total = [L.plane_error(p, w, b, self.cw, k)[0] for p in self.planes]
        sites = [p.v0.shape[0] * p.v0.shape[1] * (1 + k) for p in self.planes]
        return float(np.dot(self.per_site, total) / (self.cw.sum() * np.dot(self.per_site, sites)))


def per_site_weights(pixels: Sequence[int], kind: str, mix: float, k: int) -> np.ndarray:
    n = np.asarray(pixels, float)
    if len(n) == 1:
        return np.ones(1)
    raw = {"uniform": np.ones_like(n), "sqrt": np.sqrt(n), "pixels": n}[kind].copy()
    raw[0] = 0
    share = mix * raw / raw.sum()
    share[0] = 1 - mix
    return share / (n * (1 + k))


def box_chain(base: np.ndarray, levels: int) -> list[np.ndarray]:
    out = [base]
    for _ in range(levels):
        a = out[-1]
        h, w = max(1, a.shape[0] // 2), max(1, a.shape[1] // 2)
        ys, xs = np.arange(h) * 2, np.arange(w) * 2
        y1, x1 = np.minimum(ys + 1, a.shape[0] - 1), np.minimum(xs + 1, a.shape[1] - 1)
        out.append(((a[ys][:, xs] + a[ys][:, x1]) + (a[y1][:, xs] + a[y1][:, x1])) * 0.25)
    return out


def footprint_means(src: np.ndarray, h1: int, w1: int) -> np.ndarray:
    h0, w0 = src.shape[:2]
    starts = lambda n0, n1: np.minimum(np.arange(n1) * n0 // n1, n0 - 1)
    ys, xs = starts(h0, h1), starts(w0, w1)
    sums = np.add.reduceat(np.add.reduceat(src, ys, 0), xs, 1)
    count = np.diff(np.append(ys, h0))[:, None] * np.diff(np.append(xs, w0))[None, :]
    return sums / count[..., None]


def value_range(planes: Sequence[np.ndarray], policy: str) -> tuple[np.ndarray, np.ndarray]:
    v = np.sort(np.concatenate([a.reshape(-1, a.shape[2]) for a in planes]), 0)
    last = len(v) - 1
    lo, hi = (v[0], v[last]) if policy == "minmax" else (v[int(0.001 * last + 0.5)], v[int(0.999 * last + 0.5)])
    flat = ~(hi > lo)
    return np.where(flat, -1.0, lo).astype(np.float32).astype(float), np.where(flat, 1.0, hi).astype(np.float32).astype(float)


def solve_decoder(m: Model) -> None:
    """Block (a): one Gram over all sites of all planes, then the ridge ladder."""
    k = m.options.k
    a = r = 0.0
    for omega, p in zip(m.per_site, m.planes, strict=True):
        for _, t0, t1, target in L.sites(p, k):
            v = np.concatenate([D.phi_matrix(t0.read(p.v0), t1.read(p.v1)), np.ones((target.shape[0], 1))], 1)
            a, r = a + omega * (v.T @ v), r + omega * (v.T @ target)
    weight = sum(omega * p.v0.shape[0] * p.v0.shape[1] * (1 + k) for omega, p in zip(m.per_site, m.planes, strict=True))
    m.decoder = D.solve(a, r, m.cw, weight, m.decoder)
    m.decoders.append(m.decoder)


def _freeze1(m: Model, policy: str) -> None:
    m.lo1, m.hi1 = value_range([p.v1 for p in m.planes], policy)
    for p in m.planes:
        p.k1 = L.grid_index(m.lo1, m.hi1, m.options.bits1, p.v1)
        p.v1 = L.grid_value(m.lo1, m.hi1, m.options.bits1, p.k1)


def _freeze0(m: Model, policy: str) -> None:
    m.lo0, m.hi0 = value_range([p.v0 for p in m.planes], policy)
    for p in m.planes:
        p.k0 = L.grid_index(m.lo0, m.hi0, 8, p.v0)
        p.v0 = L.grid_value(m.lo0, m.hi0, 8, p.k0)


def _snap_palette(m: Model, p: L.Plane, c: int) -> None:
    p.k0[..., c] = np.abs(p.v0[..., c, None] - m.palettes[c]).argmin(-1)
    p.v0[..., c] = m.palettes[c][p.k0[..., c]]


def init_level1(m: Model) -> None:
    o = m.options
    nout = m.planes[0].src.shape[2]
    means = [footprint_means(p.src, *p.size1) for p in m.planes]
    if o.init == "pca":
        flat = means[0].reshape(-1, nout)
        mu = flat.mean(0)
        values, vectors = np.linalg.eigh((flat - mu).T @ (flat - mu) / len(flat))
        order = np.argsort(-values)[: min(o.c1, nout)]
        found = [(a - mu) @ vectors[:, order] for a in means]
        peak = np.max([np.abs(a).max((0, 1)) for a in found], 0)
        found = [a / np.where(peak > 0, peak, 1) for a in found]
    else:
        same = [(a, b) for a in range(nout) for b in range(a + 1, nout) if all((p.src[..., a] == p.src[..., b]).all() for p in m.planes)]
        use = distinct_first(nout, same)[: o.c1]
        found = [2 * a[..., use] - 1 for a in means]
    for p, a in zip(m.planes, found, strict=True):
        p.v1 = np.concatenate([a, np.zeros((*a.shape[:2], o.c1 - a.shape[2]))], 2)
    _freeze1(m, "minmax")


def init_level0(m: Model) -> None:
    o = m.options
    for p in m.planes:
        p.v0 = np.zeros((*p.src.shape[:2], o.c0))
        if o.init0 == "luma":
            p.v0[..., 0] = 2 * (p.src[..., :3] @ np.array(LUMA)) - 1
        p.k0 = np.zeros(p.v0.shape, np.int64)
        if not m.block_format:
            for c in range(o.c0):
                _snap_palette(m, p, c)


def residuals(m: Model, p: L.Plane) -> np.ndarray:
    """Unclamped decode minus source at the texel centres."""
    w, b = m.weights()
    _, t0, t1, target = next(L.sites(p, 0))
    return (D.phi_matrix(t0.read(p.v0), t1.read(p.v1)) @ w.T + b - target).reshape(p.src.shape)


def seed_channel(m: Model, c: int) -> float:
    """Level-0 channel c along the residual's leading direction; returns its share of the variance."""
    o = m.options
    scope = list(zip(m.per_site, m.planes, strict=True)) if o.init0_scope == "chain" else [(1.0, m.planes[0])]
    n, s1, s2 = 0.0, 0.0, 0.0
    for omega, p in scope:
        r = residuals(m, p).reshape(-1, p.src.shape[2])
        n, s1, s2 = n + omega * len(r), s1 + omega * r.sum(0), s2 + omega * (r.T @ r)
    mu = s1 / n
    cov = s2 / n - np.outer(mu, mu)
    e = np.zeros(len(mu))
    if o.init0 == "texture":
        tops = [np.linalg.eigh(cov[t : t + 3, t : t + 3]) for t in range(0, len(mu), 3)]
        best = int(np.argmax([v[-1] for v, _ in tops]))
        e[3 * best : 3 * best + 3], top = tops[best][1][:, -1], tops[best][0][-1]
    else:
        values, vectors = np.linalg.eigh(cov)
        e, top = vectors[:, -1], values[-1]
    e = e * np.sign(e[np.abs(e).argmax()] or 1.0)
    projected = [(residuals(m, p) - mu) @ e for p in m.planes]
    peak = max(float(np.abs(a).max()) for a in projected)
    divisor = peak
    if not m.block_format and peak > 0:
        counts = sum(np.bincount(np.minimum(BINS - 1, (np.abs(a) / peak * BINS).astype(int)).ravel(), minlength=BINS) for a in projected)
        at = int(np.argmax(np.cumsum(counts) >= int(PERCENTILE * counts.sum())))
        divisor = peak * (at + 1) / BINS
    for p, a in zip(m.planes, projected, strict=True):
        p.v0[..., c] = np.clip(a / divisor if divisor > 0 else 0 * a, -1, 1).astype(np.float32)
        if not m.block_format:
            _snap_palette(m, p, c)
    return float(top / np.trace(cov)) if np.trace(cov) > 0 else 0.0


def level1_step(m: Model) -> int:
    o, (w, b) = m.options, m.weights()
    moved = 0
    for p in m.planes:
        if m.frozen:
            moved += L.grid_sweep(p, w, b, m.cw, o.k, o.ridge, False, m.lo1, m.hi1, o.bits1, o.q1_sweeps).moved
        else:
            moved += L.solve(p, w, b, m.cw, o.k, o.ridge, False).iterations
    return moved


def level0_step(m: Model) -> int:
    o, (w, b) = m.options, m.weights()
    moved = 0
    for p in m.planes:
        if not m.block_format:
            moved += sum(L.palette_search(p, w, b, m.cw, o.k, m.palettes, o.sweeps))
        elif m.frozen:
            moved += L.grid_sweep(p, w, b, m.cw, o.k, o.ridge, True, m.lo0, m.hi0, 8, o.q1_sweeps).moved
        else:
            moved += L.solve(p, w, b, m.cw, o.k, o.ridge, True).iterations
    return moved


def _pack(m: Model, passes: int, seed: bool) -> int:
    """Blocks (from the indices, if seeded) decoded into the planes, then refined."""
    w, b = m.weights()
    improved = 0
    for p in m.planes:
        if seed or p.blocks is None:
            p.blocks = L.seed_blocks(p.k0)
        p.v0 = L.block_values(p.blocks, *p.size0, m.lo0, m.hi0)
        improved += sum(r.improved for r in L.refine_blocks(p, w, b, m.cw, m.options.k, m.lo0, m.hi0, passes)) if passes else 0
    return improved


def _copy(m: Model) -> tuple:
    return m.decoder, [(p.v0.copy(), p.k0.copy(), p.blocks) for p in m.planes]


def _restore(m: Model, state: tuple) -> None:
    m.decoder = state[0]
    for p, (v0, k0, blocks) in zip(m.planes, state[1], strict=True):
        p.v0, p.k0, p.blocks = v0, k0, blocks


def fit_planes(chain: list[np.ndarray], options: Options, cw: Sequence[float]) -> tuple[Model, list[tuple[int, str, float, int]]]:
    """A fitted model and its report rows (round, block, error, moved); ``chain`` is the padded source's pyramid."""
    sizes = [(max(1, chain[0].shape[0] // 4), max(1, chain[0].shape[1] // 4))]
    for _ in chain[1:]:
        sizes.append((max(1, sizes[-1][0] // 2), max(1, sizes[-1][1] // 2)))
    planes = [L.Plane(np.zeros((*a.shape[:2], options.c0)), np.zeros((*s, options.c1)), a) for a, s in zip(chain, sizes, strict=True)]
    m = Model(planes, np.asarray(cw, float), per_site_weights([a.shape[0] * a.shape[1] for a in chain], options.mip_weight, options.mip_mix, options.k), options)
    if not m.block_format:
        m.palettes = [(-1 + 2 * L.replicate(np.arange(1 << b), b) / 255.0).astype(np.float32).astype(float) for b in options.palette_bits]
    report: list[tuple[int, str, float, int]] = []
    note = lambda r, block, moved=0: report.append((r, block, m.error(), moved))
    init_level0(m)
    init_level1(m)
    solve_decoder(m)
    note(0, "a")
    if options.init0 != "luma":
        for c in range(options.c0):
            seed_channel(m, c)
            solve_decoder(m)
            if not m.block_format:
                level0_step(m)
                solve_decoder(m)
            note(0, f"seed{c}")
    quiet = 0
    for r in range(1, options.rounds + 1):
        start = report[-1][2]
        solve_decoder(m)
        note(r, "a")
        if r > options.q1_start - 1 and not m.frozen:
            _freeze1(m, options.q1_range)
            if m.block_format:
                _freeze0(m, options.q1_range)
            m.frozen = True
            note(r, "freeze")
        moved1 = level1_step(m)
        note(r, "b", moved1)
        moved0 = level0_step(m)
        note(r, "c", moved0)
        drop = (start - report[-1][2]) / start if start > 0 else 0.0
        quiet = quiet + 1 if drop < options.tol else 0
        if m.frozen and (quiet >= 2 or moved0 + moved1 == 0):
            break
    last = report[-1][0] + 1
    if not m.frozen:
        _freeze1(m, options.q1_range)
        if m.block_format:
            _freeze0(m, options.q1_range)
        m.frozen = True
        note(last, "freeze")
    for block, step in (("b", level1_step), ("c", level0_step)):
        note(last, block, step(m))
    solve_decoder(m)
    note(last, "a")
    if m.block_format:
        _pack(m, options.bc_refine, True)
        note(last, "pack")
        for _ in range(options.bc_outer):
            state, best = _copy(m), report[-1][2]
            solve_decoder(m)
            for p in m.planes:  # the sweep goes on from the decoded blocks' nearest indices
                p.k0 = L.grid_index(m.lo0, m.hi0, 8, p.v0)
                p.v0 = L.grid_value(m.lo0, m.hi0, 8, p.k0)
            level0_step(m)
            _pack(m, options.bc_refine, True)
            if not m.error() < best:
                _restore(m, state)
                break
            note(last, "repack")
        solve_decoder(m)
        note(last, "refit")
        if options.bc_refine_after:
            _pack(m, options.bc_refine_after, False)
            note(last, "refine")
    return m, report


def to_array(pdf: pd.DataFrame, names: Sequence[str]) -> np.ndarray:
    """(h, w, channels) of a dense plane's rows."""
    h, w = int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1
    out = np.zeros((h, w, len(names)))
    out[pdf["y"].to_numpy(), pdf["x"].to_numpy()] = pdf[list(names)].to_numpy(float)
    return out


def _chain_of(pdf: pd.DataFrame, names: Sequence[str], o: Options) -> list[np.ndarray]:
    from rasterloom.functions.scalar import mip_count

    base = to_array(pdf[pdf["plane"] == 0], names)
    h, w = base.shape[:2]
    base = np.pad(base, [(0, -h % 4), (0, -w % 4), (0, 0)], mode="edge")
    given = sorted(set(pdf["plane"]) - {0})
    if given:
        return [base, *(to_array(pdf[pdf["plane"] == p], names) for p in given)]
    return box_chain(base, mip_count(base.shape[1], base.shape[0], o.mip_min) if o.mips else 0)


def _checked(materials: DataFrame, o: Options) -> tuple[list[str], list[float]]:
    """The channels and their weights; ValueError if the options break a rule. One triple of weights is every texture's."""
    names = channels(materials)
    textures = len(names) // 3
    bad = violations(o, textures)
    if bad:
        raise ValueError("; ".join(bad))
    triples = o.rgb_weights * textures if len(o.rgb_weights) == 1 else o.rgb_weights
    return names, output_weights(o.weights or (1.0,) * textures, triples or ((1.0, 1.0, 1.0),) * textures)


REPORT = "material_id string, round int, block string, error double, moved long"


def parted(materials: DataFrame, most: int = GROUP_PIXELS) -> tuple[DataFrame | None, dict[tuple[int, int], list[str]]]:
    """Materials that a task can hold (None if there are none), and the names of larger ones by extent (w, h)."""
    pixels = materials.filter("plane = 0").groupBy("material_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    large: dict[tuple[int, int], list[str]] = {}
    for r in pixels.filter(F.col("w").cast("long") * F.col("h") > most).orderBy("material_id").toLocalIterator():
        large.setdefault((r["w"], r["h"]), []).append(r["material_id"])
    names = [n for part in large.values() for n in part]
    if not names:
        return materials, large
    small = materials.join(F.broadcast(materials.sparkSession.createDataFrame([(n,) for n in names], "material_id string")), "material_id", "left_anti")
    return (None if small.isEmpty() else small), large


def fit_report(materials: DataFrame, options: Options | None = None, most: int = GROUP_PIXELS) -> DataFrame:
    """The error after every block of every round: a group per material of up to ``most`` pixels, tiles of the others.

    ``materials`` has material_id, plane, x, y and channels c0 .. c(3T - 1).
    """
    o = options or Options()
    names, cw = _checked(materials, o)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _, report = fit_planes(_chain_of(pdf, names, o), o, cw)
        return pd.DataFrame([(pdf["material_id"].iloc[0], *row) for row in report], columns=["material_id", "round", "block", "error", "moved"])

    small, large = parted(materials, most)
    parts = [] if small is None else [small.groupBy("material_id").applyInPandas(run, REPORT)]
    if large:
        from rasterloom.plans import encode as E

        parts.append(E.encode_chains(E.chains_of(materials, large, o), cw, o).report)
    return reduce(DataFrame.unionByName, parts)


FITTED = "material_id string, part string, plane int, height int, width int, channels int, data binary"


def fit(materials: DataFrame, options: Options | None = None) -> DataFrame:
    """Fitted materials, a row per stored part: level indices or blocks per plane, grids, decoder (float64 or int64 bytes)."""
    o = options or Options()
    names, cw = _checked(materials, o)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m, _ = fit_planes(_chain_of(pdf, names, o), o, cw)
        rows = []

        def add(part: str, plane: int, a: np.ndarray) -> None:
            a = np.asarray(a)
            shape = (*a.shape, 1, 1, 1)[:3] if a.ndim <= 3 else (a.shape[0], a.shape[1], int(np.prod(a.shape[2:])))
            rows.append((pdf["material_id"].iloc[0], part, plane, *map(int, shape), a.astype("<f8" if a.dtype.kind == "f" else "<i8").tobytes()))

        for i, p in enumerate(m.planes):
            add("level0", i, p.k0)
            add("level1", i, p.k1)
            if p.blocks is not None:
                for part, a in zip(("r0", "r1", "sel"), p.blocks, strict=True):
                    add(part, i, a)
        for part, a in (("weights", m.decoder.w), ("bias", m.decoder.b), ("lo1", m.lo1), ("hi1", m.hi1), ("lo0", m.lo0), ("hi0", m.hi0)):
            if a is not None:
                add(part, -1, a)
        return pd.DataFrame(rows, columns=[c.split()[0] for c in FITTED.split(", ")])

    return materials.groupBy("material_id").applyInPandas(run, FITTED)


def with_material(plane: DataFrame, name: str) -> DataFrame:
    return plane.withColumn("material_id", F.lit(name))
