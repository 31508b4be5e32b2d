"""Latent-plane solvers: sparse least squares on a nine-point block stencil.

One plane of one material is one group of ``applyInPandas`` (see ``plans.fit``);
inside it everything is vectorised over sites, texels or blocks.  With the decoder
and the other level held, the error is exactly quadratic in a plane:

    E(v + d) = E(v) + 2 g.d + d.H.d

where texels couple only with their eight neighbours.  ``assemble`` builds g and the
five owned blocks of H; ``conjugate_gradients`` moves the plane freely,
``grid_sweep`` on a frozen grid, ``palette_search`` over a palette and
``refine_blocks`` within the block codec's endpoint and selector choices.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import cached_property

import numpy as np

from rasterloom.operators.resample import OFFSETS, STENCIL

TOLERANCE, MAX_ITERATIONS, PROBE = 1e-10, 200, 4
#: Blocks whose dense systems are held at once.
BLOCKS_AT_ONCE = 4096
#: Pixels of a plane up to which its sites are kept between steps (some 800 bytes each); beyond, they are made anew.
KEPT_PIXELS = 1 << 18


Rect = tuple[int, int, int, int]  # y, x, height, width


@dataclass(frozen=True)
class Window:
    """Where a part of a larger plane lies: only ``owned`` texels move, only pixels of ``core`` have sites."""

    whole0: tuple[int, int]
    whole1: tuple[int, int]
    at0: tuple[int, int]
    at1: tuple[int, int]
    core: Rect
    owned0: Rect
    owned1: Rect
    told0: Rect | None = None  # whose changes are told, if not those of all owned texels
    told1: Rect | None = None


@dataclass
class Plane:
    """Both latents and the source of one mip: arrays (h, w, channels)."""

    v0: np.ndarray
    v1: np.ndarray
    src: np.ndarray
    k0: np.ndarray | None = None
    k1: np.ndarray | None = None
    blocks: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None  # r0, r1 (by, bx, c) and selectors (by, bx, c, 16)
    window: Window | None = None
    kept: dict[int, list] | None = field(default_factory=dict, repr=False)  # sites by k, as they depend on the extents and the source alone; None: made anew

    @property
    def size0(self) -> tuple[int, int]:
        return self.v0.shape[0], self.v0.shape[1]

    @property
    def size1(self) -> tuple[int, int]:
        return self.v1.shape[0], self.v1.shape[1]

    def owned(self, level0: bool) -> np.ndarray | None:
        """The texels of a level that may move; None for all of a whole plane."""
        if self.window is None:
            return None
        (y, x, h, w), (oy, ox) = (self.window.owned0, self.window.at0) if level0 else (self.window.owned1, self.window.at1)
        out = np.zeros(self.size0 if level0 else self.size1, bool)
        out[y - oy : y - oy + h, x - ox : x - ox + w] = True
        return out


    def told(self, level0: bool) -> tuple[slice, slice]:
        """The texels of a level whose changes are told."""
        rect = None if self.window is None else self.window.told0 if level0 else self.window.told1
        if rect is None:
            return np.s_[:, :]
        (y, x, h, w), (oy, ox) = rect, self.window.at0 if level0 else self.window.at1
        return np.s_[y - oy : y - oy + h, x - ox : x - ox + w]


@dataclass
class Taps:
    """Corner texels (x, y as (4, n)) and weights (4, n) of n sites; duplicates are left apart and add up."""

    x: np.ndarray
    y: np.ndarray
    w: np.ndarray
    at: np.ndarray  # position in the plane's rows one after another

    def read(self, plane: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(self.read_first(plane).T)

    def read_first(self, plane: np.ndarray) -> np.ndarray:
        """The same as (channels, n): channels are few, so each is read as numbers one after another."""
        at = self.at.astype(np.intp)
        out = np.empty((plane.shape[2], at.shape[1]))
        for q, one in enumerate(out):
            flat = np.ascontiguousarray(plane[..., q]).reshape(-1)
            np.multiply(self.w[0], flat.take(at[0]), out=one)
            for a in range(1, 4):
                one += self.w[a] * flat.take(at[a])
        return out


def site_offsets(h: int, w: int, k: int, j: int, at: tuple[int, int] = (0, 0)) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of site j (0: the centre) of every pixel of an (h, w) rectangle at ``at``."""
    dx, dy = _turned_offsets(k, j)
    y, x = np.indices((h, w))
    y, x = (y + at[0] & 1).ravel(), (x + at[1] & 1).ravel()
    return dx[y, x], dy[y, x]


def _turned_offsets(k: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of site j of a pixel by the parities of its row and column."""
    if j == 0:
        return np.zeros((2, 2)), np.zeros((2, 2))
    ox, oy = OFFSETS[k][j - 1]
    if k == 2:
        return np.full((2, 2), ox), np.full((2, 2), oy)
    return np.array([[ox, -oy], [-ox, oy]]), np.array([[oy, ox], [-oy, -ox]])


def taps(h0: int, w0: int, k: int, j: int, h: int, w: int, core: Rect | None = None, at: tuple[int, int] = (0, 0), width: int | None = None) -> Taps:
    """Bilinear taps in an (h, w) plane of site j of every pixel of an (h0, w0) plane.

    Of those in the rectangle ``core`` alone, if it is given; the taps' places are then
    those in an array that begins at ``at`` of the (h, w) plane and is ``width`` wide. A column's taps
    depend on the parity of the row alone, and a row's on that of the column: what is computed is two tables each.
    """
    top, left, ch, cw = core or (0, 0, h0, w0)
    dx, dy = _turned_offsets(k, j)

    def table(first: int, n: int, n0: int, size: int, offsets: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = np.arange(first, first + n)
        d = offsets[:, p & 1]
        v = p + d if size == n0 else (p + 0.5 + d) * size / n0 - 0.5
        low = np.floor(v).astype(int)
        near, far = (np.clip(low + i, 0, size - 1).astype(np.int32) - np.int32(start) for i in (0, 1))
        return v - low, near, far

    fx, x0, x1 = (t[np.arange(top, top + ch) & 1].ravel() for t in table(left, cw, w0, w, dx, at[1]))
    fy, y0, y1 = (t[np.arange(left, left + cw) & 1].T.ravel() for t in table(top, ch, h0, h, dy.T, at[0]))
    gx, gy = 1 - fx, 1 - fy
    weights = np.stack([gx * gy, fx * gy, gx * fy, fx * fy])
    r0, r1 = y0 * np.int32(width or w), y1 * np.int32(width or w)
    return Taps(np.stack([x0, x1, x0, x1]), np.stack([y0, y0, y1, y1]), weights, np.stack([r0 + x0, r0 + x1, r1 + x0, r1 + x1]))


def _made_sites(p: Plane, k: int) -> Iterator[tuple[int, Taps, Taps, np.ndarray]]:
    (h0, w0), (h1, w1), core, at0, at1 = p.size0, p.size1, None, (0, 0), (0, 0)
    if p.window is not None:
        (h0, w0), (h1, w1), core, at0, at1 = p.window.whole0, p.window.whole1, p.window.core, p.window.at0, p.window.at1
    for j in range(k + 1):
        t0 = taps(h0, w0, k, j, h0, w0, core, at0, p.size0[1])
        yield j, t0, taps(h0, w0, k, j, h1, w1, core, at1, p.size1[1]), t0.read(p.src)


def sites(p: Plane, k: int) -> Iterator[tuple[int, Taps, Taps, np.ndarray]]:
    """(j, level-0 taps, level-1 taps, targets) of every kind of site."""
    if p.kept is None or p.size0[0] * p.size0[1] > KEPT_PIXELS:
        return _made_sites(p, k)
    if k not in p.kept:
        p.kept[k] = list(_made_sites(p, k))
    return iter(p.kept[k])


# Pairs of corners, each once, and what becomes of their step (dx, dy), at place 3 * dy + dx + 1: the slot that
# owns it, how often it counts there, and whether the second corner owns it.
_PAIRS = [(a, e) for a in range(4) for e in range(a, 4)]
_SLOT = np.array([STENCIL.index(d) for d in ((1, 0), (0, 0), (1, 0), (-1, 1), (0, 1), (1, 1))])
_TIMES = np.array([1.0, 2.0, 1.0, 1.0, 1.0, 1.0])


@dataclass
class Form:
    """The decoder seen from one level: out = m + sum_q (base + sum_j other_j * cross_j)[:, q] * own_q."""

    bias: np.ndarray
    base: np.ndarray  # (nout, own)
    other: np.ndarray  # (nout, others)
    cross: np.ndarray  # (others, nout, own)

    @staticmethod
    def of(w: np.ndarray, b: np.ndarray, c0: int, c1: int, level0: bool) -> Form:
        z, s, x = w[:, :c1], w[:, c1 : c1 + c0], w[:, c1 + c0 :].reshape(len(w), c0, c1)
        return Form(b, s, z, np.moveaxis(x, 2, 0)) if level0 else Form(b, z, s, np.moveaxis(x, 1, 0))

    def slope(self, other: np.ndarray) -> np.ndarray:
        return self.base + np.einsum("nj,jrq->nrq", other, self.cross)

    def constant(self, other: np.ndarray) -> np.ndarray:
        return self.bias + other @ self.other.T

    def monomials(self, other: np.ndarray) -> np.ndarray:
        n = other.shape[1]
        return np.stack([np.ones(len(other)), *other.T, *[other[:, i] * other[:, j] for i in range(n) for j in range(i, n)]], 1)

    def matrices(self, cw: np.ndarray) -> np.ndarray:
        """slope^T diag(cw) slope as a fixed matrix per monomial."""
        product = lambda a, b: np.einsum("rp,r,rq->pq", a, cw, b)
        n, c = len(self.cross), self.cross
        out = [product(self.base, self.base)]
        out += [product(self.base, c[i]) + product(c[i], self.base) for i in range(n)]
        out += [product(c[i], c[i]) if i == j else product(c[i], c[j]) + product(c[j], c[i]) for i in range(n) for j in range(i, n)]
        return np.stack(out)


def times(blocks: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Blocks (C, C, h, w) times x (C, h, w), texel by texel."""
    out = blocks[:, 0] * x[0]
    for q in range(1, len(x)):
        out += blocks[:, q] * x[q]
    return out


@dataclass
class Stencil:
    """blocks (5, h, w, C, C): the owned directions of H; gradient (h, w, C)."""

    blocks: np.ndarray
    gradient: np.ndarray

    @property
    def mean_diagonal(self) -> float:
        return float(np.einsum("hwii->hwi", self.blocks[0]).mean())

    @cached_property
    def _parts(self) -> np.ndarray:
        """The blocks as (5, C, C, h, w): entries of a block are few, so loops go over them and arrays over texels."""
        return np.ascontiguousarray(np.moveaxis(self.blocks, (3, 4), (1, 2)))

    def _applied(self, x: np.ndarray) -> np.ndarray:
        """H x of (C, h, w)."""
        parts, (c, h, w) = self._parts, x.shape
        y = times(parts[0], x)
        for (dx, dy), blk in zip(STENCIL[1:], parts[1:], strict=True):
            here = np.s_[0 : h - dy, max(0, -dx) : w - max(0, dx)]
            there = np.s_[dy:h, max(0, dx) : w - max(0, -dx)]
            for i in range(c):
                for q in range(c):
                    y[(i, *here)] += blk[(i, q, *here)] * x[(q, *there)]
                    y[(i, *there)] += blk[(q, i, *here)] * x[(q, *here)]
        return y

    def apply(self, x: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(np.moveaxis(self._applied(np.ascontiguousarray(np.moveaxis(x, 2, 0))), 0, 2))

    def change(self, d: np.ndarray, told: tuple[slice, slice] = np.s_[:, :]) -> float:
        """What moves by d do to the weighted error; the share of the texels ``told``, so that shares of tiles add up."""
        return float((d * (2 * self.gradient + self.apply(d)))[told].sum())

    def coloured(self, x: np.ndarray, colour: int) -> np.ndarray:
        """(C, h, w) of the texels of a colour: H x without each one's own block. ``x`` is (C, h + 2, w + 2) with a rim of 0."""
        c, h, w = x.shape[0], x.shape[1] - 2, x.shape[2] - 2
        y, z = colour >> 1, colour & 1
        out = np.zeros((c, len(range(y, h, 2)), len(range(z, w, 2))))
        for (dx, dy), blk in zip(STENCIL[1:], self._rimmed[1:], strict=True):
            mine = np.s_[y + 1 : h + 1 : 2, z + 1 : w + 1 : 2]
            after = np.s_[y + 1 + dy : h + 1 + dy : 2, z + 1 + dx : w + 1 + dx : 2]
            before = np.s_[y + 1 - dy : h + 1 - dy : 2, z + 1 - dx : w + 1 - dx : 2]
            for i in range(c):
                for q in range(c):
                    out[i] += blk[(i, q, *mine)] * x[(q, *after)]
                    out[i] += blk[(q, i, *before)] * x[(q, *before)]
        return out

    @cached_property
    def _rimmed(self) -> np.ndarray:
        return np.pad(self._parts, [(0, 0)] * 3 + [(1, 1)] * 2)


def _restricted(s: Stencil, owned: np.ndarray) -> Stencil:
    """The system of the owned texels with all others held; theirs becomes d = 0."""
    h, w, c = s.gradient.shape
    s.gradient[~owned] = 0
    s.blocks[0][~owned] = np.einsum("nii->ni", s.blocks[0][owned]).mean() * np.eye(c)
    for (dx, dy), blk in zip(STENCIL[1:], s.blocks[1:], strict=True):
        here = np.s_[0 : h - dy, max(0, -dx) : w - max(0, dx)]
        there = np.s_[dy:h, max(0, dx) : w - max(0, -dx)]
        blk[here] *= (owned[here] & owned[there])[..., None, None]
    return s


def assemble(p: Plane, w: np.ndarray, b: np.ndarray, cw: np.ndarray, k: int, level0: bool) -> Stencil:
    """The system of a level, of its owned texels if the plane is a window."""
    whole, owned = assemble_all(p, w, b, cw, k, level0), p.owned(level0)
    return whole if owned is None else _restricted(whole, owned)


def assemble_all(p: Plane, w: np.ndarray, b: np.ndarray, cw: np.ndarray, k: int, level0: bool) -> Stencil:
    """All that the sites of a plane or window give; a window's outermost texels lack what lies beyond it."""
    c0, c1 = p.v0.shape[2], p.v1.shape[2]
    form = Form.of(w, b, c0, c1, level0)
    own_plane, c = (p.v0, c0) if level0 else (p.v1, c1)
    h, wd = own_plane.shape[:2]
    # A block is summed as its own entries or as monomials of the other level, whichever are fewer.
    entries = [(a, e) for a in range(c) for e in range(a, c)]
    others = c1 if level0 else c0
    direct = len(entries) <= 1 + others + others * (others + 1) // 2
    matrices = None if direct else form.matrices(cw)
    n = h * wd
    sums = np.zeros((len(entries) if direct else len(matrices), len(STENCIL), n))
    gradient = np.zeros((c, n))
    for j, t0, t1, target in sites(p, k):
        own, other = (t0, t1.read_first(p.v1)) if level0 else (t1, t0.read_first(p.v0))
        at_own = own.read_first(own_plane)
        pull, terms = [0.0] * c, [0.0] * len(entries)
        for r, weight in enumerate(np.asarray(cw, float)):  # outputs and channels are few: loops go over them and arrays over sites
            slope = [form.base[r, q] + sum(x * form.cross[i, r, q] for i, x in enumerate(other)) for q in range(c)]
            residual = form.bias[r] + sum(x * form.other[r, i] for i, x in enumerate(other)) - target[:, r]
            for q in range(c):
                residual += slope[q] * at_own[q]
            residual *= weight
            pull = [pull[q] + slope[q] * residual for q in range(c)]
            if direct:
                weighted = [x * weight for x in slope]
                terms = [t + weighted[a] * slope[e] for t, (a, e) in zip(terms, entries, strict=True)]
        if not direct:
            terms = list(np.ascontiguousarray(form.monomials(other.T).T))
        corners = range(1) if level0 and j == 0 else range(4)  # the centre site is one texel
        at = own.at.astype(np.intp)
        for a in corners:
            for q in range(c):
                gradient[q] += np.bincount(at[a], own.w[a] * pull[q], n)
        for a, e in _PAIRS if len(corners) == 4 else _PAIRS[:1]:
            scale = own.w[a] * own.w[e]
            if a == e:
                for i, term in enumerate(terms):
                    sums[i, 0] += np.bincount(at[a], scale * term, n)
                continue
            step = 3 * (own.y[e] - own.y[a]) + own.x[e] - own.x[a] + 1
            usual = 3 * (e // 2 - a // 2) + e % 2 - a % 2 + 1
            apart = np.flatnonzero(step != usual)  # at an edge both corners may be one texel, and count either way
            rare = scale[apart] * _TIMES[step[apart]]
            scale[apart] = 0
            slot, place = _SLOT[usual], at[e] if usual == 0 else at[a]
            where = _SLOT[step[apart]] * n + np.where(step[apart] == 0, at[e][apart], at[a][apart])
            for i, term in enumerate(terms):
                sums[i, slot] += np.bincount(place, scale * term, n)
                if len(apart):
                    np.add.at(sums[i].reshape(-1), where, rare * term[apart])
    if direct:
        blocks = np.empty((len(STENCIL), n, c, c))
        for i, (a, e) in enumerate(entries):
            blocks[..., a, e] = blocks[..., e, a] = sums[i]
        blocks = blocks.reshape(len(STENCIL), h, wd, c, c)
    else:
        blocks = np.tensordot(sums, matrices, (0, 0)).reshape(len(STENCIL), h, wd, c, c)
    gradient = np.ascontiguousarray(gradient.T)
    return Stencil(blocks, gradient.reshape(h, wd, c))


@dataclass
class Report:
    iterations: int = 0
    residual: float = 0.0
    moved: int = 0
    delta_e: float = 0.0
    delta2: float = 0.0
    lo: list[float] = field(default_factory=list)
    hi: list[float] = field(default_factory=list)


def conjugate_gradients(s: Stencil, ridge: float) -> tuple[np.ndarray, Report]:
    """(H + ridge * mean diagonal) d = -g."""
    return conjugated(s, ridge * s.mean_diagonal)


def conjugated(s: Stencil, lam: float) -> tuple[np.ndarray, Report]:
    """(H + lam) d = -g, preconditioned by each texel's own block."""
    c = s.gradient.shape[2]
    own = s.blocks[0] + lam * np.eye(c)
    singular = ~(np.abs(np.linalg.det(own)) > 0)
    own[singular] = np.eye(c)
    inverse = np.linalg.inv(own).astype(np.float32).astype(float)
    first = lambda a: np.ascontiguousarray(np.moveaxis(a, 2, 0))
    inverse = np.ascontiguousarray(np.moveaxis(inverse, (2, 3), (0, 1)))
    r = -first(s.gradient)
    x = np.zeros_like(r)
    z = times(inverse, r)
    d, rz, start = z.copy(), float(np.vdot(r, z)), float(np.vdot(r, r))
    report = Report()
    for it in range(MAX_ITERATIONS if start > 0 else 0):
        ad = s._applied(d) + lam * d
        curve = float(np.vdot(d, ad))
        if curve == 0:
            break
        alpha = rz / curve
        x += alpha * d
        r -= alpha * ad
        z = times(inverse, r)
        rz, old = float(np.vdot(r, z)), rz
        d = z + (rz / old if old else 0.0) * d
        report.iterations, report.residual = it + 1, (float(np.vdot(r, r)) / start) ** 0.5
        if (it + 1) % PROBE == 0 and report.residual < TOLERANCE:
            break
    return np.ascontiguousarray(np.moveaxis(x, 0, 2)), report


def replicate(k: np.ndarray, bits: int) -> np.ndarray:
    out, shift = np.zeros_like(k), 8 - bits
    while shift > -bits:
        out |= k << shift if shift >= 0 else k >> -shift
        shift -= bits
    return out & 255


def grid_value(lo: np.ndarray, hi: np.ndarray, bits: int, k: np.ndarray) -> np.ndarray:
    return (lo + replicate(k, bits) / 255.0 * (hi - lo)).astype(np.float32).astype(float)


def grid_index(lo: np.ndarray, hi: np.ndarray, bits: int, v: np.ndarray) -> np.ndarray:
    """The nearest grid value's index, the lower on ties."""
    n = (1 << bits) - 1
    span = np.where(hi > lo, hi - lo, 1.0)
    guess = np.floor(np.clip((v - lo) / span * n, 0, n) + 0.5).astype(np.int64)
    near = np.stack([np.clip(guess + d, 0, n) for d in (-1, 0, 1)])
    best = np.abs(v - grid_value(lo, hi, bits, near)).argmin(0)
    return np.where(hi > lo, np.take_along_axis(near, best[None], 0)[0], 0)


def _nearest(table: np.ndarray, lo: float, hi: float, v: np.ndarray) -> np.ndarray:
    """``grid_index`` by a table of one channel's values."""
    n = len(table) - 1
    best = np.floor(np.clip((v - lo) / (hi - lo) * n, 0, n) + 0.5).astype(np.int64)
    low, high = np.maximum(best - 1, 0), np.minimum(best + 1, n)
    off, below, above = (np.abs(v - table[i]) for i in (best, low, high))
    best = np.where(below <= off, low, best)
    return np.where(above < np.minimum(below, off), high, best)


def solve(p: Plane, w: np.ndarray, b: np.ndarray, cw: np.ndarray, k: int, ridge: float, level0: bool) -> Report:
    """The continuous block step of one level."""
    s = assemble(p, w, b, cw, k, level0)
    d, report = conjugate_gradients(s, ridge)
    report.delta_e = s.change(d, p.told(level0))
    moved = ((p.v0 if level0 else p.v1) + d).astype(np.float32).astype(float)
    if level0:
        p.v0 = moved
    else:
        p.v1 = moved
    report.delta2 = float((d * d).sum())
    report.lo, report.hi = moved.min((0, 1)).tolist(), moved.max((0, 1)).tolist()
    return report


def grid_sweep(p: Plane, w: np.ndarray, b: np.ndarray, cw: np.ndarray, k: int, ridge: float, level0: bool, lo: np.ndarray, hi: np.ndarray, bits: int, sweeps: int) -> Report:
    """Four-colour Gauss-Seidel on a frozen grid: every value takes its exact best grid point."""
    s = assemble(p, w, b, cw, k, level0)
    lam = ridge * s.mean_diagonal
    prev = np.ascontiguousarray(np.moveaxis(p.v0 if level0 else p.v1, 2, 0))
    index = np.ascontiguousarray(np.moveaxis(p.k0 if level0 else p.k1, 2, 0))
    value, gradient = prev.copy(), np.ascontiguousarray(np.moveaxis(s.gradient, 2, 0))
    c, h, wd = prev.shape
    rimmed = np.zeros((c, h + 2, wd + 2))
    d = rimmed[:, 1:-1, 1:-1]
    told = np.zeros((h, wd), bool)
    told[p.told(level0)] = True
    own_blocks = s._parts[0]
    tables = [grid_value(lo[q], hi[q], bits, np.arange(1 << bits)) for q in range(c)]
    report = Report()
    for _ in range(sweeps):
        for colour in range(4):
            at = np.s_[colour >> 1 :: 2, colour & 1 :: 2]
            around = s.coloured(rimmed, colour)
            counted = told[at]
            for q in range(c):
                if not hi[q] > lo[q]:
                    continue
                here = (q, *at)
                a = own_blocks[(q, q, *at)] + lam
                rest = around[q] + sum(own_blocks[(q, j, *at)] * d[(j, *at)] for j in range(c) if j != q)
                use = a > 0
                want = prev[here] - (gradient[here] + rest) / np.where(use, a, 1.0)
                new = np.where(use, _nearest(tables[q], lo[q], hi[q], want.astype(np.float32).astype(float)), index[here])
                report.moved += int(((new != index[here]) & counted).sum())
                index[here] = new
                value[here] = np.where(use, tables[q][new], value[here])
                d[here] = value[here] - prev[here]
    d, value, index = (np.ascontiguousarray(np.moveaxis(a, 0, 2)) for a in (d, value, index))
    report.delta_e = s.change(d, p.told(level0))
    if level0:
        p.v0, p.k0 = value, index
    else:
        p.v1, p.k1 = value, index
    return report


def palette_search(p: Plane, w: np.ndarray, b: np.ndarray, cw: np.ndarray, k: int, palettes: list[np.ndarray], sweeps: int = 2) -> list[int]:
    """Exact argmin of every level-0 texel over its palettes, four colours in turn; returns texels moved by colour."""
    h, wd, c0 = p.v0.shape
    form = Form.of(w, b, c0, p.v1.shape[2], True)
    prepared = []
    for j, t0, t1, target in sites(p, k):
        z = t1.read(p.v1)
        prepared.append((j, t0, form.slope(z), form.constant(z) - target))
    levels = [len(x) for x in palettes]
    joint = np.prod(levels) <= 256
    moved = []
    for colour in range(4):
        n = h * wd
        a0, a1, a2 = np.zeros(n), np.zeros((n, c0)), np.zeros((n, c0, c0))
        flat = p.v0.reshape(-1, c0)
        for j, t, slope, base in prepared:
            at = t.at
            for a in range(1 if j == 0 else 4):
                mine = (t.x[a] & 1 == colour & 1) & (t.y[a] & 1 == colour >> 1)
                for e in range(a):  # a texel that is two corners is dealt with once
                    mine &= at[e] != at[a]
                if j == 0:
                    alpha, beta = np.ones(at.shape[1]), np.zeros((at.shape[1], c0))
                else:
                    same = at == at[a]
                    alpha = (t.w * same).sum(0)
                    beta = np.einsum("an,anc->nc", t.w * ~same, flat[at])
                use = np.flatnonzero(mine & (alpha > 0))
                q, r, al = slope[use], (base + np.einsum("nrq,nq->nr", slope, beta))[use], alpha[use]
                a0 += np.bincount(at[a][use], (cw * r * r).sum(1), n)
                for i in range(c0):
                    a1[:, i] += np.bincount(at[a][use], al * (cw * q[:, :, i] * r).sum(1), n)
                    for i2 in range(c0):
                        a2[:, i, i2] += np.bincount(at[a][use], al * al * (cw * q[:, :, i] * q[:, :, i2]).sum(1), n)
        texels = (np.arange(colour >> 1, h, 2)[:, None] * wd + np.arange(colour & 1, wd, 2)[None, :]).ravel()
        texels = texels if p.window is None else texels[p.owned(True).ravel()[texels]]
        cur = p.k0.reshape(-1, c0)[texels]
        best = cur.copy()
        energy = lambda x: a0[texels] + 2 * (x * a1[texels]).sum(-1) + np.einsum("ti,tij,tj->t", x, a2[texels], x)
        values = lambda state: np.stack([palettes[i][state[:, i]] for i in range(c0)], 1)
        best_e = energy(values(cur))
        if joint:
            for state in np.ndindex(*levels[::-1]):
                tried = np.broadcast_to(np.array(state[::-1]), cur.shape)
                e = energy(values(tried))
                better = e < best_e
                best_e, best = np.where(better, e, best_e), np.where(better[:, None], tried, best)
        else:
            for _ in range(sweeps):
                before = best.copy()
                for i in range(c0):
                    for state in range(levels[i]):
                        tried = best.copy()
                        tried[:, i] = state
                        e = energy(values(tried))
                        better = e < best_e
                        best_e, best = np.where(better, e, best_e), np.where(better[:, None], tried, best)
                if (before == best).all():
                    break
        p.k0.reshape(-1, c0)[texels] = best
        p.v0.reshape(-1, c0)[texels] = values(best)
        moved.append(int((best != cur).any(1).sum()))
    return moved


# ---- the block codec inside the solve

_SHARE = np.array([1.0, 0.0, *[(8 - s) / 7 for s in range(2, 8)]])


def block_palette(r0: np.ndarray, r1: np.ndarray) -> np.ndarray:
    """Eight byte values (last axis) of endpoint pairs, as a decoder evaluates them."""
    eight = np.stack([r0, r1, *[((8 - i) * r0 + (i - 1) * r1) / 7 for i in range(2, 8)]], -1)
    six = np.stack([r0, r1, *[((6 - i) * r0 + (i - 1) * r1) / 5 for i in range(2, 6)], 0 * r0, 0 * r0 + 255], -1)
    return np.where((r0 > r1)[..., None], eight, six).astype(np.float32).astype(float)


def _blocked(a: np.ndarray, h: int, w: int) -> np.ndarray:
    """(h, w, ...) to (blocks_y, blocks_x, 16, ...), edges repeated."""
    hp, wp = -(-h // 4) * 4, -(-w // 4) * 4
    full = np.pad(a, [(0, hp - h), (0, wp - w)] + [(0, 0)] * (a.ndim - 2), mode="edge")
    return np.moveaxis(full.reshape(hp // 4, 4, wp // 4, 4, *a.shape[2:]), 2, 1).reshape(hp // 4, wp // 4, 16, *a.shape[2:])


def _unblocked(a: np.ndarray, h: int, w: int) -> np.ndarray:
    by, bx = a.shape[:2]
    return np.moveaxis(a.reshape(by, bx, 4, 4, *a.shape[3:]), 1, 2).reshape(by * 4, bx * 4, *a.shape[3:])[:h, :w]


def seed_blocks(k0: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Endpoints and selectors of 8-bit indices: largest and smallest, nearest entries."""
    v = np.moveaxis(_blocked(k0, *k0.shape[:2]), 2, 3).astype(float)
    r0, r1 = v.max(-1).astype(int), v.min(-1).astype(int)
    sel = np.abs(block_palette(r0, r1)[..., None, :].astype(np.float32) - v[..., None].astype(np.float32)).argmin(-1)
    return r0, r1, np.where((r0 == r1)[..., None], 0, sel)


def block_values(blocks: tuple[np.ndarray, np.ndarray, np.ndarray], h: int, w: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The plane a reader decodes."""
    r0, r1, sel = blocks
    byte = np.take_along_axis(block_palette(r0, r1), sel, -1)
    plane = _unblocked(np.moveaxis(byte, 2, 3), h, w)
    return (lo + plane / 255.0 * (hi - lo)).astype(np.float32).astype(float)


@dataclass
class RefineReport:
    improved: int = 0
    blocks: int = 0
    delta_e: float = 0.0


def refine_blocks(p: Plane, w: np.ndarray, b: np.ndarray, cw: np.ndarray, k: int, lo: np.ndarray, hi: np.ndarray, passes: int = 4) -> list[RefineReport]:
    """Endpoints by least squares with their nine neighbours, selectors by exact eight-way choice; strict falls only.

    ``p.v0`` must be the planes' decoded blocks; blocks two apart share no site, so
    the four colours of the block grid take turns.
    """
    h, wd, c = p.v0.shape
    s = assemble(p, w, b, cw, k, True)
    prev = p.v0.copy()
    r0, r1, sel = (a.copy() for a in p.blocks)
    reports = []
    for _ in range(passes):
        report = RefineReport()
        for colour in range(4):
            ys, xs = np.arange(colour >> 1, r0.shape[0], 2), np.arange(colour & 1, r0.shape[1], 2)
            all_by, all_bx = (g.ravel() for g in np.meshgrid(ys, xs, indexing="ij"))
            for at in range(0, len(all_by), BLOCKS_AT_ONCE):
                _refine_colour(p, s, prev, r0, r1, sel, all_by[at : at + BLOCKS_AT_ONCE], all_bx[at : at + BLOCKS_AT_ONCE], lo, hi, report)
        reports.append(report)
        if not report.improved:
            break
    p.blocks = (r0, r1, sel)
    return reports


def _refine_colour(p: Plane, s: Stencil, prev: np.ndarray, r0: np.ndarray, r1: np.ndarray, sel: np.ndarray, by: np.ndarray, bx: np.ndarray, lo: np.ndarray, hi: np.ndarray, report: RefineReport, within: Rect | None = None) -> None:
    """``within`` is the rectangle of the plane whose blocks these are; what lies around it is held."""
    c = p.v0.shape[2]
    oy, ox, h, wd = within or (0, 0, *p.v0.shape[:2])
    n = len(by)
    if not n:
        return
    t = np.arange(16)
    ty, tx = by[:, None] * 4 + t // 4, bx[:, None] * 4 + t % 4
    inside = (ty < h) & (tx < wd)
    ty, tx = ty + oy, tx + ox
    cy, cx = np.minimum(ty, oy + h - 1), np.minimum(tx, ox + wd - 1)
    # Dense quadratic of every block: A2 over its sixteen texels, A1 from everything outside it.
    a2 = np.zeros((n, 16, c, 16, c))
    for a in range(16):
        for e in range(16):
            dx, dy = e % 4 - a % 4, e // 4 - a // 4
            both = (inside[:, a] & inside[:, e])[:, None, None]
            if (dx, dy) in STENCIL:
                a2[:, a, :, e, :] = np.where(both, s.blocks[STENCIL.index((dx, dy))][cy[:, a], cx[:, a]], 0)
            elif (-dx, -dy) in STENCIL:
                a2[:, a, :, e, :] = np.where(both, np.swapaxes(s.blocks[STENCIL.index((-dx, -dy))][cy[:, e], cx[:, e]], 1, 2), 0)
    delta = p.v0 - prev
    d = np.where(inside[..., None], delta[cy, cx], 0)
    total = s.apply(delta)[cy, cx] + s.gradient[cy, cx]
    force = np.where(inside[..., None], total, 0)  # A1 + A2 d at the present d
    scale = (hi - lo) / 255.0
    exact = lambda e0, e1, choice, q: (lo[q] + np.take_along_axis(block_palette(e0, e1), choice, -1) / 255.0 * (hi[q] - lo[q])).astype(np.float32).astype(float)
    improved = np.zeros(n, bool)

    def gain(step: np.ndarray, q: int) -> np.ndarray:
        """E's change if channel q of every block moves by ``step`` (n, 16)."""
        return 2 * (force[:, :, q] * step).sum(1) + np.einsum("na,nae,ne->n", step, a2[:, :, q, :, q], step)

    def take(step: np.ndarray, q: int, use: np.ndarray) -> None:
        step = np.where(use[:, None], step, 0)
        d[:, :, q] += step
        np.add(force, np.einsum("naie,ne->nai", a2[:, :, :, :, q], step), out=force)

    base = prev[cy, cx]
    for q in range(c):
        if not scale[q] > 0:
            continue
        e0, e1, choice = r0[by, bx, q], r1[by, bx, q], sel[by, bx, q]
        pp, qq = scale[q] * _SHARE[choice] * inside, scale[q] * (1 - _SHARE[choice]) * inside
        m = a2[:, :, q, :, q]
        fp, fq = (force[:, :, q] * pp).sum(1), (force[:, :, q] * qq).sum(1)
        mpp, mpq, mqq = (np.einsum("na,nae,ne->n", x, m, y) for x, y in ((pp, pp), (pp, qq), (qq, qq)))
        det = mpp * mqq - mpq * mpq
        safe = np.where(np.abs(det) > 0, det, 1.0)
        v0 = np.where(np.abs(det) > 0, (-fp * mqq + fq * mpq) / safe, 0)
        v1 = np.where(np.abs(det) > 0, (-fq * mpp + fp * mpq) / safe, 0)
        best_gain, best0, best1 = np.zeros(n), e0.copy(), e1.copy()
        for o0 in (-1, 0, 1):
            for o1 in (-1, 0, 1):
                n0, n1 = np.clip(np.round(e0 + v0) + o0, 0, 255).astype(int), np.clip(np.round(e1 + v1) + o1, 0, 255).astype(int)
                d0, d1 = n0 - e0, n1 - e1
                g = 2 * fp * d0 + 2 * fq * d1 + mpp * d0 * d0 + 2 * mpq * d0 * d1 + mqq * d1 * d1
                better = (n0 > n1) & (g < best_gain)
                best_gain, best0, best1 = np.where(better, g, best_gain), np.where(better, n0, best0), np.where(better, n1, best1)
        step = np.where(inside, exact(best0, best1, choice, q) - (base[:, :, q] + d[:, :, q]), 0)
        change = gain(step, q)
        use = (best_gain < 0) & (change < 0)
        take(step, q, use)
        report.delta_e += float(change[use].sum())
        improved |= use
        r0[by[use], bx[use], q], r1[by[use], bx[use], q] = best0[use], best1[use]
    for _ in range(2):
        for q in range(c):
            table = (lo[q] + block_palette(r0[by, bx, q], r1[by, bx, q]) / 255.0 * (hi[q] - lo[q])).astype(np.float32).astype(float)
            for a in range(16):
                step = table - (base[:, a, q] + d[:, a, q])[:, None]
                e = 2 * force[:, a, q][:, None] * step + a2[:, a, q, a, q][:, None] * step * step
                best = e.argmin(1)
                change = e[np.arange(n), best]
                use = (change < 0) & inside[:, a] & (best != sel[by, bx, q, a])
                move = np.zeros((n, 16))
                move[:, a] = step[np.arange(n), best]
                take(move, q, use)
                report.delta_e += float(change[use].sum())
                improved |= use
                sel[by[use], bx[use], q, a] = best[use]
    report.improved += int(improved.sum())
    report.blocks += n
    p.v0[ty[inside], tx[inside]] = (base + d)[inside]


def refine_window(p: Plane, s: Stencil, prev: np.ndarray, within: Rect, first: tuple[int, int], colour: int, lo: np.ndarray, hi: np.ndarray) -> RefineReport:
    """The blocks of one colour of a part of a plane, whose first block is number ``first`` of the whole plane's."""
    report = RefineReport()
    r0, r1, sel = p.blocks
    ys, xs = (np.arange(((colour >> turn & 1) - f) % 2, n, 2) for turn, f, n in ((1, first[0], r0.shape[0]), (0, first[1], r0.shape[1])))
    by, bx = (g.ravel() for g in np.meshgrid(ys, xs, indexing="ij"))
    for at in range(0, len(by), BLOCKS_AT_ONCE):
        _refine_colour(p, s, prev, r0, r1, sel, by[at : at + BLOCKS_AT_ONCE], bx[at : at + BLOCKS_AT_ONCE], lo, hi, report, within)
    return report


def plane_error(p: Plane, w: np.ndarray, b: np.ndarray, cw: np.ndarray, k: int) -> tuple[float, float, float]:
    """Weighted error over all sites, plain error over centre and over fractional sites."""
    weighted = centre = fractional = 0.0
    form = Form.of(w, b, p.v0.shape[2], p.v1.shape[2], True)
    for j, t0, t1, target in sites(p, k):
        z = t1.read(p.v1)
        e = form.constant(z) + np.einsum("nrq,nq->nr", form.slope(z), t0.read(p.v0)) - target
        weighted += float((cw * e * e).sum())
        if j == 0:
            centre += float((e * e).sum())
        else:
            fractional += float((e * e).sum())
    return weighted, centre, fractional


# The sequence that picks the probed values, so that every run probes the same ones.
PROBE_START, PROBE_TIMES, PROBE_PLUS, PROBE_SHIFT = 0x9E3779B97F4A7C15, 6364136223846793005, 1442695040888963407, 16


def gradient_probe(p: Plane, w: np.ndarray, b: np.ndarray, cw: np.ndarray, k: int, step: float, samples: int, scale: float) -> float:
    """The steepest slope of the weighted error in ``samples`` level-1 values, by central differences, times step over scale.

    The error is quadratic in the plane, so at its minimum this is 0 but for rounding
    and the ridge's pull. Both ends are float32 values, and their real distance counts.
    """
    if not (p.v1.size and scale > 0):
        return 0.0
    steepest, state, flat = 0.0, PROBE_START, p.v1.reshape(-1)
    for _ in range(samples):
        state = (state * PROBE_TIMES + PROBE_PLUS) % (1 << 64)
        at = (state >> PROBE_SHIFT) % flat.size
        ends = [float(np.float32(flat[at] + s)) for s in (step, -step)]
        if ends[0] > ends[1]:
            errors = []
            for v in ends:
                moved = flat.copy()
                moved[at] = v
                errors.append(plane_error(replace(p, v1=moved.reshape(p.v1.shape)), w, b, cw, k)[0])
            steepest = max(steepest, abs(errors[0] - errors[1]) / (ends[0] - ends[1]))
    return steepest * step / scale


def dense_system(s: Stencil, lam: float) -> tuple[np.ndarray, np.ndarray]:
    """The whole stencil as one matrix and right-hand side: for small planes, in tests."""
    h, w, c = s.gradient.shape
    a = np.zeros((h * w * c, h * w * c))
    for i in range(h * w * c):
        x = np.zeros(h * w * c)
        x[i] = 1
        a[:, i] = (s.apply(x.reshape(h, w, c)) + lam * x.reshape(h, w, c)).ravel()
    return a, -s.gradient.ravel()
