"""Fitting rasters of any extent: tiles with halos, a row per tile, four colours in turn.

A plane is cut into tiles of ``edge`` pixels a side (the last of a row or column takes
what is left, so 2 * edge - 1 at most). A step sends every tile of one colour what lies
around it and solves its own texels with all others held; tiles of one colour don't
touch, so the error of the whole falls as it does within each. Decoders are solved from
Gram matrices, one per tile, never from rows.

No task holds more than its tiles one at a time, and the driver holds nothing of them.
Each colour's new tiles are written to the shared folder, so a lost executor costs one
colour of a step. With a halo as wide as a step's moves reach (``step`` with ``halo``) no turns are
needed: every tile works out its neighbours' moves as well and keeps its own. Grids are given, not found here: ``operators.aggregate`` finds them
over ``planes``, and ``operators.blocks`` packs those.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from functools import cached_property, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from rasterloom.functions.config import Options
from rasterloom.operators import decoder as D
from rasterloom.operators import latents as L
from rasterloom.operators import resample as R
from rasterloom.plans.fit import per_site_weights
from rasterloom.schema import channels
from rasterloom.session import stored

EDGE = 128
#: Pixels around a tile whose sites may reach its texels: under 8 are needed at a quarter of the extent a side.
HALO = 16
DEALT = 4  # tasks a core that a step's tiles are dealt over
LEAST = 32  # a tile's neighbours alone hold its halo
#: Pixels, with their halo, of neighbouring tiles that are worked on as one: the wider they lie, the less of the work is halo.
GROUPED = 1 << 17
_EXTENT = "h0 int, w0 int, h1 int, w1 int"
TILE = f"material_id string, plane int, ty int, tx int, {_EXTENT}, v0 binary, v1 binary, src binary"
_PIECE = f"material_id string, plane int, ty int, tx int, {_EXTENT}, w binary, b binary, g binary, r0 array<int>, r1 array<int>, v0 binary, v1 binary, src binary"
#: A material's decoder, its grids if any (float64: lo and hi of level 0, lo and hi of level 1) and the error before and after it was found.
DECODER = "material_id string, w binary, b binary, g binary, before double, after double"
_KEYS = ["material_id", "plane", "ty", "tx"]


@dataclass(frozen=True)
class Grid:
    """The tiles of a plane of (h0, w0) pixels and (h1, w1) level-1 texels."""

    h0: int
    w0: int
    h1: int
    w1: int
    edge: int
    halo: int = HALO

    @property
    def tiles(self) -> tuple[int, int]:
        return max(1, self.h0 // self.edge), max(1, self.w0 // self.edge)

    @property
    def counts(self) -> tuple[int, int]:
        return self.tiles

    def _span(self, t: int, count: int, n0: int) -> tuple[int, int]:
        n = max(1, n0 // self.edge)
        return t * n // count * self.edge, n0 if t == count - 1 else (t + 1) * n // count * self.edge

    def holder(self, ty: int, tx: int) -> tuple[int, int]:
        """Where a tile is held."""
        (cy, cx), (ny, nx) = self.counts, self.tiles
        return ((ty + 1) * cy - 1) // ny, ((tx + 1) * cx - 1) // nx

    def members(self, gy: int, gx: int) -> list[tuple[int, int]]:
        """The tiles that are held there."""
        ys, xs = (range(g * n // c, (g + 1) * n // c) for g, c, n in zip((gy, gx), self.counts, self.tiles, strict=True))
        return [(y, x) for y in ys for x in xs]

    def own(self, ty: int, tx: int) -> tuple[L.Rect, L.Rect]:
        """The pixels and the level-1 texels of a tile."""
        (ny, nx) = self.counts
        (a, b), (c, d) = self._span(ty, ny, self.h0), self._span(tx, nx, self.w0)
        low = [p * n1 // n0 for p, n0, n1 in ((a, self.h0, self.h1), (b, self.h0, self.h1), (c, self.w0, self.w1), (d, self.w0, self.w1))]
        return (a, c, b - a, d - c), (low[0], low[2], low[1] - low[0], low[3] - low[2])

    def reach(self, ty: int, tx: int) -> tuple[L.Rect, L.Rect]:
        """The same with all that the sites near its texels read."""
        (y, x, h, w), _ = self.own(ty, tx)
        a, b, c, d = max(0, y - self.halo), min(self.h0, y + h + self.halo), max(0, x - self.halo), min(self.w0, x + w + self.halo)
        e, f = max(0, (a * self.h1 // self.h0 - 2) & ~1), min(self.h1, -(-b * self.h1 // self.h0) + 2)  # even, as colours are of the plane
        g, i = max(0, (c * self.w1 // self.w0 - 2) & ~1), min(self.w1, -(-d * self.w1 // self.w0) + 2)
        return (a, c, b - a, d - c), (e, g, f - e, i - g)

    def inner(self, ty: int, tx: int) -> tuple[L.Rect, L.Rect]:
        """The texels of ``reach`` of which all sites are there: all but a rim where the plane goes on."""
        out = []
        for (y, x, h, w), n, m, rim in zip(self.reach(ty, tx), (self.h0, self.h1), (self.w0, self.w1), (2, 5), strict=True):
            a, b, c, d = y + rim * (y > 0), y + h - rim * (y + h < n), x + rim * (x > 0), x + w - rim * (x + w < m)
            out.append((a, c, b - a, d - c))
        return out[0], out[1]

    def core(self, ty: int, tx: int) -> L.Rect:
        """The pixels whose sites lie wholly within ``reach``."""
        (y, x, h, w), _ = self.reach(ty, tx)
        a, b, c, d = y + (y > 0), y + h - (y + h < self.h0), x + (x > 0), x + w - (x + w < self.w0)
        return a, c, b - a, d - c


@dataclass(frozen=True)
class Groups(Grid):
    """The same with neighbouring tiles as one: as many a side as ``most`` pixels with their halo allow, and one at least."""

    most: int = GROUPED

    @cached_property
    def counts(self) -> tuple[int, int]:
        n, (ny, nx) = 1, self.tiles
        held = lambda n: min(self.h0, n * self.edge + 2 * self.halo) * min(self.w0, n * self.edge + 2 * self.halo)
        while n < max(ny, nx) and held(n + 1) <= self.most:
            n += 1
        return -(-ny // n), -(-nx // n)

    @property
    def single(self) -> Grid:
        return Grid(self.h0, self.w0, self.h1, self.w1, self.edge, self.halo)


def _grid(extent: Sequence[int], edge: int, halo: int, most: int | None) -> Grid:
    return Grid(*extent, edge, halo) if most is None else Groups(*extent, edge, halo, most)


def _meet(a: L.Rect, b: L.Rect) -> L.Rect:
    y, x = max(a[0], b[0]), max(a[1], b[1])
    return y, x, max(0, min(a[0] + a[2], b[0] + b[2]) - y), max(0, min(a[1] + a[3], b[1] + b[3]) - x)


def _part(a: np.ndarray, at: L.Rect, part: L.Rect) -> np.ndarray:
    y, x = part[0] - at[0], part[1] - at[1]
    return a[y : y + part[2], x : x + part[3]]


def _raw(data: bytes, rect: Sequence[int], kind: str = "<f4") -> np.ndarray:
    return np.frombuffer(data, kind).reshape(rect[2], rect[3], -1)


def _array(data: bytes, rect: Sequence[int], kind: str = "<f4") -> np.ndarray:
    return _raw(data, rect, kind).astype(float)


def _bytes(a: np.ndarray, kind: str = "<f4") -> bytes:
    return np.ascontiguousarray(a).astype(kind).tobytes()


def colour() -> F.Column:
    return (F.col("ty") % 2) * 2 + F.col("tx") % 2


def cut(level0: DataFrame, level1: DataFrame, source: DataFrame, size: DataFrame, edge: int = EDGE) -> DataFrame:
    """Tiles (``TILE``) of dense planes of (material_id, plane, x, y, channels); ``size`` has the extents of every plane.

    Source values are kept as float32, as the latents are. A null channel is 0.
    """
    if edge < LEAST:
        raise ValueError(f"tiles of {edge} pixels are narrower than {LEAST}")
    tables = (level0, level1, source)
    widths = [len(channels(t)) for t in tables]
    rows = []
    for part, t in enumerate(tables):
        at = R.with_extent(t, size, {n: n for n in ("h0", "w0", "h1", "w1")})
        tile = {}
        for name, p, n0, n1 in (("ty", "y", "h0", "h1"), ("tx", "x", "w0", "w1")):
            last = F.greatest(F.lit(1), F.floor(F.col(n0) / edge).cast("int")) - 1
            found = F.floor(((F.col(p).cast("long") + 1) * F.col(n0) - 1) / (F.col(n1).cast("long") * edge)) if part == 1 else F.floor(F.col(p) / edge)
            tile[name] = F.least(found.cast("int"), last)
        at = at.withColumns(tile)
        own = channels(t)
        rows.append(at.select(*_KEYS, "h0", "w0", "h1", "w1", F.lit(part).alias("part"), "x", "y", *[(F.coalesce(F.col(own[i]), F.lit(0.0)) if i < len(own) else F.lit(0.0)).cast("float").alias(f"c{i}") for i in range(max(widths))]))

    def build(key: tuple, table: pa.Table) -> pa.Table:
        extent = [table[n][0].as_py() for n in ("h0", "w0", "h1", "w1")]
        own = Grid(*extent, edge).own(key[2].as_py(), key[3].as_py())
        parts, out = table["part"].to_numpy(), []
        for part, rect in enumerate((own[0], own[1], own[0])):
            out.append(_bytes(dense(table.filter(pa.array(parts == part)), rect, [f"c{i}" for i in range(widths[part])])))
        return as_row([*(k.as_py() for k in key), *extent, *out], TILE)

    whole = rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy(*_KEYS).applyInArrow(build, TILE)
    return _written(whole)


def dense(table: pa.Table, rect: L.Rect, names: Sequence[str]) -> np.ndarray:
    """Rows (x, y and ``names``) as the array of a rectangle, holes as 0. A tile's texels are many rows: none becomes Python objects."""
    out = np.zeros((rect[2], rect[3], len(names)), np.float32)
    y, x = table["y"].to_numpy() - rect[0], table["x"].to_numpy() - rect[1]
    for i, name in enumerate(names):
        out[y, x, i] = table[name].to_numpy()
    return out


def as_row(values: Sequence, schema: str) -> pa.Table:
    kinds = {"string": pa.string(), "int": pa.int32(), "binary": pa.binary()}
    return pa.table({field.split()[0]: pa.array([v], kinds[field.split()[1]]) for v, field in zip(values, schema.split(", "), strict=True)})


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def _written(df: DataFrame) -> DataFrame:
    return stored(df, "tiles")


def _pieces(tiles: DataFrame, decoders: DataFrame | None, edge: int, turn: int | None, halo: int = HALO, most: int | None = None) -> DataFrame:
    """What every tile gives to itself and those within ``halo`` (of colour ``turn``, if it is given), a tile's pieces at a time; to groups of up to ``most`` pixels, if that is given."""
    far = -(-halo // edge)

    def give(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for r in pdf.itertuples(index=False):
                grid = _grid((r.h0, r.w0, r.h1, r.w1), edge, halo, most)
                own0, own1 = _grid((r.h0, r.w0, r.h1, r.w1), edge, halo, None).own(r.ty, r.tx)
                v0, v1, src = _raw(r.v0, own0), _raw(r.v1, own1), _raw(r.src, own0)
                out, (ny, nx) = [], grid.tiles
                first, last = grid.holder(max(0, r.ty - far), max(0, r.tx - far)), grid.holder(min(ny - 1, r.ty + far), min(nx - 1, r.tx + far))
                for ty in range(first[0], last[0] + 1):
                    for tx in range(first[1], last[1] + 1):
                        if turn is not None and (ty % 2) * 2 + tx % 2 != turn:
                            continue
                        far0, far1 = grid.reach(ty, tx)
                        r0, r1 = _meet(own0, far0), _meet(own1, far1)
                        if not r0[2] * r0[3] + r1[2] * r1[3]:
                            continue
                        out.append((r.material_id, r.plane, ty, tx, r.h0, r.w0, r.h1, r.w1, r.w, r.b, r.g, list(r0), list(r1), _bytes(_part(v0, own0, r0)), _bytes(_part(v1, own1, r1)), _bytes(_part(src, own0, r0))))
                if out:
                    yield pd.DataFrame(out, columns=_names(_PIECE))

    given = {n: F.col(n) if decoders is not None and n in decoders.columns else F.lit(b"") for n in ("w", "b", "g")}
    both = tiles.select(*_names(TILE)).join(decoders, "material_id") if decoders is not None else tiles
    return both.select(*_names(TILE), *[c.alias(n) for n, c in given.items()]).mapInPandas(give, _PIECE)


def _met(pieces: DataFrame) -> GroupedData:
    """Pieces by the tile they are for, dealt over all cores.

    A tile is little data and much work: by their bytes alone, adaptive execution puts a step's tiles into a few tasks.
    """
    return pieces.repartition(DEALT * pieces.sparkSession.sparkContext.defaultParallelism, *_KEYS).groupBy(*_KEYS)


def _assembled(pdf: pd.DataFrame, edge: int, summing: bool, halo: int = HALO, wide: bool = False, most: int | None = None) -> tuple[L.Plane, Grid, int, int]:
    """A tile (or group, with ``most``) and its surroundings as one plane; for sums only its own pixels have sites, and if it is ``wide`` all its texels move."""
    key = pdf.iloc[0]
    ty, tx = int(key["ty"]), int(key["tx"])
    grid = _grid([int(key[n]) for n in ("h0", "w0", "h1", "w1")], edge, halo, most)
    far0, far1 = grid.reach(ty, tx)
    arrays: dict[str, np.ndarray] = {}
    for r0, r1, v0, v1, src in zip(pdf["r0"], pdf["r1"], pdf["v0"], pdf["v1"], pdf["src"], strict=True):
        for name, rect, far, data in (("v0", r0, far0, v0), ("v1", r1, far1, v1), ("src", r0, far0, src)):
            if rect[2] * rect[3]:
                a = _raw(data, rect)
                whole = arrays.setdefault(name, np.zeros((far[2], far[3], a.shape[2])))
                _part(whole, far, rect)[:] = a
    own0, own1 = grid.own(ty, tx)
    moving = (*grid.inner(ty, tx), own0, own1) if wide else (own0, own1)
    window = L.Window((grid.h0, grid.w0), (grid.h1, grid.w1), far0[:2], far1[:2], own0 if summing else grid.core(ty, tx), *moving)
    kept = None if summing or most is not None else {}  # sums and steps go over the sites once
    return L.Plane(arrays["v0"], arrays["v1"], arrays["src"], window=window, kept=kept), grid, ty, tx


def parted(p: L.Plane, grid: Grid, gy: int, gx: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """The tiles of a group as its plane has them: their place and the bytes of both levels and the source."""
    far0, far1 = grid.reach(gy, gx)
    single = grid.single if isinstance(grid, Groups) else grid
    for ty, tx in grid.members(gy, gx):
        own0, own1 = single.own(ty, tx)
        yield ty, tx, [_bytes(_part(a, far, rect)) for a, far, rect in ((p.v0, far0, own0), (p.v1, far1, own1), (p.src, far0, own0))]


def _decoder_of(pdf: pd.DataFrame, nout: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(pdf["w"].iloc[0], "<f8").reshape(nout, -1), np.frombuffer(pdf["b"].iloc[0], "<f8")


def _gram(p: L.Plane, k: int) -> np.ndarray:
    """The products of features, 1 and targets over a plane's sites."""
    total = 0.0
    for _, t0, t1, target in L.sites(p, k):
        s, z = t0.read_first(p.v0), t1.read_first(p.v1)
        row = np.concatenate([z, s, *[x * z for x in s], np.ones((1, len(target))), target.T])  # as in ``decoder.phi_matrix``, transposed
        total = total + row @ row.T
    return total


def decoders(tiles: DataFrame, cw: Sequence[float], options: Options | None = None, previous: DataFrame | None = None, edge: int = EDGE) -> DataFrame:
    """Every material's best decoder (``DECODER``), no worse than its previous one.

    A tile gives the products of its features and targets; a task adds those of its tiles up before they are
    summed by entry, so what meets in a material's group is one matrix per plane however many tiles it has.
    The same sums give the error of the previous decoder (null without one) and of the new one. Tiles that a
    step left with their products (``gram``) aren't read again.
    """
    o, weights, kept = options or Options(), np.asarray(cw, float), previous is not None
    nout = len(weights)
    schema = "material_id string, plane int, pixels long, gram binary, w binary, b binary, g binary"

    def gram(pdf: pd.DataFrame) -> pd.DataFrame:
        p, grid, _, _ = _assembled(pdf, edge, True, most=GROUPED)
        key = pdf.iloc[0]
        return pd.DataFrame([(key["material_id"], int(key["plane"]), grid.h0 * grid.w0, _bytes(_gram(p, o.k), "<f8"), key["w"], key["b"], key["g"])], columns=_names(schema))

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        for pdf in parts:
            for r in pdf.itertuples(index=False):
                g = np.frombuffer(r.gram, "<f8")
                mine = held.setdefault((r.material_id, r.plane), [r, np.zeros(len(g))])
                mine[1] += g
        for r, g in held.values():
            rest = [None] * (len(g) - 1)  # the bytes go with the first entry alone
            yield pd.DataFrame({"material_id": r.material_id, "plane": r.plane, "pixels": r.pixels, "at": np.arange(len(g), dtype=np.int32), "v": g, "w": [r.w, *rest], "b": [r.b, *rest], "g": [r.g, *rest]})

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        pixels = pdf.groupby("plane")["pixels"].first()
        omega = dict(zip(pixels.index, per_site_weights(pixels, o.mip_weight, o.mip_mix, o.k), strict=True))
        v = pdf["v"] * pdf["plane"].map(omega)
        total = v.groupby(pdf["at"]).sum().sort_index().to_numpy()
        total = total.reshape(round(len(total) ** 0.5), -1)
        n = len(total) - nout
        sites = sum(omega[p] * c * (1 + o.k) for p, c in pixels.items())
        norm = weights.sum() * sites

        def error(d: D.Decoder) -> float:
            x = np.concatenate([d.w.T.astype(float), d.b[None].astype(float), -np.eye(nout)])
            return float(weights @ np.einsum("ic,ij,jc->c", x, total, x)) / norm if norm > 0 else 0.0

        named = pdf[pdf["at"] == 0]  # the bytes come with one entry of every matrix
        old = D.Decoder(*_decoder_of(named, nout)) if kept else None
        got = D.solve(total[:n, :n], total[:n, n:], weights, sites, old)
        return pd.DataFrame([(pdf["material_id"].iloc[0], _bytes(got.w, "<f8"), _bytes(got.b, "<f8"), named["g"].iloc[0], error(old) if kept else None, error(got))], columns=_names(DECODER))

    if "gram" in tiles.columns and kept:
        each = tiles.filter("gram is not null").join(previous.select("material_id", "w", "b", "g"), "material_id").select("material_id", "plane", (F.col("h0").cast("long") * F.col("w0")).alias("pixels"), "gram", "w", "b", "g")
    else:
        each = _met(_pieces(tiles, previous, edge, None, most=GROUPED)).applyInPandas(gram, schema)
    grams = each.mapInPandas(partial, "material_id string, plane int, pixels long, at int, v double, w binary, b binary, g binary")
    summed = grams.groupBy("material_id", "plane", "at").agg(F.first("pixels").alias("pixels"), F.sum("v").alias("v"), *[F.first(n, ignorenulls=True).alias(n) for n in ("w", "b", "g")])
    return _written(summed.groupBy("material_id").applyInPandas(best, DECODER))


def errors(tiles: DataFrame, found: DataFrame, cw: Sequence[float], options: Options | None = None, edge: int = EDGE) -> DataFrame:
    """(material_id, error): the weighted mean square over all sites of all planes."""
    o, weights = options or Options(), np.asarray(cw, float)

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        p, grid, ty, tx = _assembled(pdf, edge, True, most=GROUPED)
        e = L.plane_error(p, *_decoder_of(pdf, len(weights)), weights, o.k)[0]
        return pd.DataFrame([(pdf["material_id"].iloc[0], int(pdf["plane"].iloc[0]), ty, tx, grid.h0 * grid.w0, e)], columns=["material_id", "plane", "ty", "tx", "pixels", "e"])

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        sums = pdf.sort_values(["plane", "ty", "tx"]).groupby("plane").agg({"pixels": "first", "e": "sum"})
        omega = per_site_weights(sums["pixels"], o.mip_weight, o.mip_mix, o.k)
        e = float(np.dot(omega, sums["e"]) / (weights.sum() * np.dot(omega, sums["pixels"] * (1 + o.k))))
        return pd.DataFrame([(pdf["material_id"].iloc[0], e)], columns=["material_id", "error"])

    each = _met(_pieces(tiles, found, edge, None, most=GROUPED)).applyInPandas(own, "material_id string, plane int, ty int, tx int, pixels long, e double")
    return each.groupBy("material_id").applyInPandas(mean, "material_id string, error double")


#: What is done to a plane under a decoder (w, b) and the material's grids; gives the error's change and how many values moved.
Action = Callable[[L.Plane, np.ndarray, np.ndarray, np.ndarray], tuple[float, int]]
STEPPED = f"{TILE}, delta_e double, moved long"


def solving(level0: bool, cw: Sequence[float], options: Options | None = None) -> Action:
    """The continuous step of a level."""
    o, weights = options or Options(), np.asarray(cw, float)

    def run(p: L.Plane, w: np.ndarray, b: np.ndarray, _: np.ndarray) -> tuple[float, int]:
        report = L.solve(p, w, b, weights, o.k, o.ridge, level0)
        return report.delta_e, report.iterations

    return run


def grids_of(g: np.ndarray, c0: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """lo and hi of level 0, lo and hi of level 1."""
    c1 = len(g) // 2 - c0
    return g[:c0], g[c0 : 2 * c0], g[2 * c0 : 2 * c0 + c1], g[2 * c0 + c1 :]


def sweeping(level0: bool, cw: Sequence[float], lo: Sequence[float] | None, hi: Sequence[float] | None, bits: int, options: Options | None = None) -> Action:
    """Sweeps of a level over a grid (without ends, over each material's own); values off the grid are snapped to it first."""
    o, weights = options or Options(), np.asarray(cw, float)

    def run(p: L.Plane, w: np.ndarray, b: np.ndarray, g: np.ndarray) -> tuple[float, int]:
        own = p.v0 if level0 else p.v1
        low, high = (np.asarray(lo, float), np.asarray(hi, float)) if lo is not None else grids_of(g, p.v0.shape[2])[:2] if level0 else grids_of(g, p.v0.shape[2])[2:]
        index = L.grid_index(low, high, bits, own)
        if level0:
            p.k0, p.v0 = index, L.grid_value(low, high, bits, index)
        else:
            p.k1, p.v1 = index, L.grid_value(low, high, bits, index)
        report = L.grid_sweep(p, w, b, weights, o.k, o.ridge, level0, low, high, bits, o.q1_sweeps)
        return report.delta_e, report.moved

    return run


def searching(cw: Sequence[float], palettes: Sequence[Sequence[float]], options: Options | None = None) -> Action:
    """The exact search of level 0 over palettes; values off them are snapped to the nearest first."""
    o, weights, tables = options or Options(), np.asarray(cw, float), [np.asarray(t, float) for t in palettes]

    def run(p: L.Plane, w: np.ndarray, b: np.ndarray, _: np.ndarray) -> tuple[float, int]:
        p.k0 = np.stack([np.abs(p.v0[..., c, None] - t).argmin(-1) for c, t in enumerate(tables)], 2)
        p.v0 = np.stack([t[p.k0[..., c]] for c, t in enumerate(tables)], 2)
        before = L.plane_error(p, w, b, weights, o.k)[0]
        moved = sum(L.palette_search(p, w, b, weights, o.k, tables, o.sweeps))
        return L.plane_error(p, w, b, weights, o.k)[0] - before, moved

    return run


def colours(sizes: Sequence[tuple[int, int]], edge: int = EDGE) -> list[int]:
    """The colours that tiles of planes of these (h0, w0) have at all: one if every plane is a single tile."""
    out = set()
    for h0, w0 in sizes:
        ny, nx = Grid(h0, w0, 1, 1, edge).counts
        out |= {2 * (y % 2) + x % 2 for y in range(min(2, ny)) for x in range(min(2, nx))}
    return sorted(out)


#: How far (in texels of its level) a continuous step's moves reach: beyond, they have faded to its own tolerance.
FADED = 32


def reach_of(level0: bool, options: Options, frozen: bool) -> int:
    """The halo in pixels with which a tile's step (sweeps, if ``frozen``) is that of the whole plane: a colour's moves reach one texel on."""
    texels = 4 * options.q1_sweeps + 4 if frozen else FADED
    return -(-texels // 8) * 8 if level0 else -(-texels * 9 // 16) * 8  # up to 4.5 pixels a texel


def step(tiles: DataFrame, found: DataFrame, action: Action, edge: int = EDGE, turns: Sequence[int] = range(4), halo: int | None = None, k: int | None = None, most: int = GROUPED) -> DataFrame:
    """``tiles`` (``STEPPED``: with the change of the plane's weighted error, and values moved) after ``action`` on every one of them.

    A colour at a time; or all at once with a ``halo`` as wide as the action's moves reach, each group of neighbouring tiles (up to
    ``most`` pixels with the halo) then keeping its own part; its change and moves are told by its first tile. With ``k`` that tile
    has the group's products for its decoder too (``gram``).
    """
    grouped = None if halo is None else most

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p, grid, gy, gx = _assembled(pdf, edge, False, halo or HALO, halo is not None, grouped)
        told = action(p, *_decoder_of(pdf, p.src.shape[2]), np.frombuffer(pdf["g"].iloc[0] or b"", "<f8"))
        if k is not None:
            told = (*told, _bytes(_gram(replace(p, window=replace(p.window, core=grid.own(gy, gx)[0])), k), "<f8"))
        out = []
        for i, (ty, tx, own) in enumerate(parted(p, grid, gy, gx)):
            rest = told if i == 0 else (0.0, 0, None)[: len(told)]
            out.append((pdf["material_id"].iloc[0], int(pdf["plane"].iloc[0]), ty, tx, grid.h0, grid.w0, grid.h1, grid.w1, *own, *rest))
        return pd.DataFrame(out, columns=_names(schema))

    schema = STEPPED if k is None else f"{STEPPED}, gram binary"
    if halo is not None:
        return _written(_met(_pieces(tiles.select(*_names(TILE)), found, edge, None, halo, most)).applyInPandas(run, schema))
    state = {c: tiles.filter(colour() == c).select(*_names(TILE)) for c in turns}
    stepped = {}
    for c in turns:
        whole = reduce(DataFrame.unionByName, state.values())
        stepped[c] = _written(_met(_pieces(whole, found, edge, c)).applyInPandas(run, STEPPED))
        state[c] = stepped[c].select(*_names(TILE))
    out = reduce(DataFrame.unionByName, stepped.values())
    if len(stepped) > 1:
        out._stored_parts = tuple(stepped.values())
    return out


def planes(tiles: DataFrame, level0: bool, n: int, edge: int = EDGE) -> DataFrame:
    """A level of ``n`` channels as rows again: material_id, plane, x, y, c0 and so on."""

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for r in pdf.itertuples(index=False):
                rect = Grid(r.h0, r.w0, r.h1, r.w1, edge).own(r.ty, r.tx)[not level0]
                a = _array(r.v0 if level0 else r.v1, rect)
                y, x = np.indices(a.shape[:2])
                yield pd.DataFrame({"material_id": r.material_id, "plane": r.plane, "x": x.ravel() + rect[1], "y": y.ravel() + rect[0]} | {f"c{i}": a[..., i].ravel() for i in range(n)})

    return tiles.mapInPandas(rows, "material_id string, plane int, x int, y int, " + ", ".join(f"c{i} double" for i in range(n)))


def rounds(tiles: DataFrame, cw: Sequence[float], n: int, options: Options | None = None, level1: Action | None = None, level0: Action | None = None, edge: int = EDGE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``n`` rounds of decoder, level 1 and level 0: the tiles, the decoders and (material_id, round, block, error)."""
    level1, level0 = level1 or solving(False, cw, options), level0 or solving(True, cw, options)
    turns = colours([(r["h0"], r["w0"]) for r in tiles.select("h0", "w0").distinct().collect()], edge)  # a row per level
    found, report = None, []
    for r in range(1, n + 1):
        found = decoders(tiles, cw, options, found, edge)
        report.append(errors(tiles, found, cw, options, edge).select("material_id", F.lit(r).alias("round"), F.lit("a").alias("block"), "error"))
        for block, action in (("b", level1), ("c", level0)):
            tiles = step(tiles, found, action, edge, turns)
            report.append(errors(tiles, found, cw, options, edge).select("material_id", F.lit(r).alias("round"), F.lit(block).alias("block"), "error"))
    out = report[0]
    for one in report[1:]:
        out = out.unionByName(one)
    return tiles, found, out
