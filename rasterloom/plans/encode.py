"""The whole fit of rasters of any extent: start, rounds, freeze, pack, repack and refit over tiles.

The steps are those of ``plans.fit``, which holds a material in one task; here a material is a
set of tiles, and what belongs to a material as a whole - decoder, grids, starting
directions, error - comes from sums, extremes and order statistics of its tiles, a row per
material.  All materials of one call have the same extents and go through a round together.

The active set: a material whose error has settled leaves the rounds, and its tiles are not
read again until all have; a repack is taken or rolled back material by material by its error.

The error after a decoder is exact (from the decoder's own sums, which also give that of the one before);
after a level's step it is what the step's own quadratic says, tile by tile.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.config import Options, violations
from rasterloom.operators import decoder as D
from rasterloom.operators import latents as L
from rasterloom.operators.order import order_statistics
from rasterloom.operators.resample import distinct_first
from rasterloom.plans import fit as P
from rasterloom.plans import packing as Q
from rasterloom.plans import tiles as T
from rasterloom.schema import channels
from rasterloom.session import forget, stored

_TILE = T._names(T.TILE)
#: Steps take their neighbours' moves with them (``tiles.reach_of``), so tiles are larger than those of single steps.
EDGE = 256
REPORT = "material_id string, round int, block string, error double, moved long"


@dataclass
class Encoded:
    """Tiles (with their blocks if they are packed), a row per material (``tiles.DECODER``) and the report."""

    tiles: DataFrame
    models: DataFrame
    report: DataFrame
    grids: DataFrame  # material_id, lo0, hi0, lo1, hi1


# ---- tiles from the source alone


def start(source: DataFrame, size: DataFrame, options: Options, edge: int = T.EDGE) -> DataFrame:
    """Tiles of a source chain (material_id, plane, x, y, channels) with both levels at 0; every texel meets its tile once."""
    own = channels(source)
    rows = T.R.with_extent(source, size, {n: n for n in ("h0", "w0", "h1", "w1")})
    at = {name: F.least(F.floor(F.col(p) / edge).cast("int"), F.greatest(F.lit(1), F.floor(F.col(n0) / edge).cast("int")) - 1) for name, p, n0 in (("ty", "y", "h0"), ("tx", "x", "w0"))}
    rows = rows.withColumns(at).select(*T._KEYS, "h0", "w0", "h1", "w1", "x", "y", *[F.coalesce(F.col(c), F.lit(0.0)).cast("float").alias(c) for c in own])

    def build(key: tuple, table: pa.Table) -> pa.Table:
        extent = [table[n][0].as_py() for n in ("h0", "w0", "h1", "w1")]
        own0, own1 = T.Grid(*extent, edge).own(key[2].as_py(), key[3].as_py())
        src = T.dense(table, own0, own)
        v0, v1 = np.zeros((own0[2], own0[3], options.c0)), np.zeros((own1[2], own1[3], options.c1))
        if options.init0 == "luma":
            v0[..., 0] = 2 * (src[..., :3].astype(float) @ np.array(P.LUMA)) - 1
        return T.as_row([*(k.as_py() for k in key), *extent, T._bytes(v0), T._bytes(v1), T._bytes(src)], T.TILE)

    return T._written(rows.groupBy(*T._KEYS).applyInArrow(build, T.TILE))


# ---- a row per material from all of its tiles, and back

Tile = tuple[L.Plane, T.Grid, int, int]


def gathered(tiles: DataFrame, models: DataFrame | None, edge: int, each: Callable[[Tile, np.ndarray | None, np.ndarray | None], dict[str, np.ndarray]], how: dict[str, str]) -> DataFrame:
    """``each`` gives named arrays of a tile with its surroundings; they are combined over a material's tiles (``how``: sum, max or min by name) entry by entry.

    Tasks combine their own tiles first: a row per material, plane, name and task is what is sent on.
    Returns material_id, plane, pixels (of the plane), name, at, v.
    """
    schema, decoded = "material_id string, plane int, pixels long, name string, at int, v double", models is not None

    def per_tile(pdf: pd.DataFrame) -> pd.DataFrame:
        p, grid, ty, tx = T._assembled(pdf, edge, True, most=T.GROUPED)
        wb = T._decoder_of(pdf, p.src.shape[2]) if decoded else (None, None)
        found = each((p, grid, ty, tx), *wb)
        key, pixels = (pdf["material_id"].iloc[0], int(pdf["plane"].iloc[0])), grid.h0 * grid.w0
        rows = [pd.DataFrame({"material_id": key[0], "plane": key[1], "pixels": pixels, "name": name, "at": np.arange(a.size, dtype=np.int32), "v": np.asarray(a, float).ravel()}) for name, a in found.items()]
        return pd.concat(rows) if rows else pd.DataFrame(columns=T._names(schema))

    def partial(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, pd.DataFrame] = {}
        for pdf in parts:
            for name, rows in pdf.groupby("name"):
                both = rows if name not in held else pd.concat([held[name], rows])
                held[name] = both.groupby(["material_id", "plane", "pixels", "name", "at"], as_index=False)["v"].agg(how[name])
        yield from held.values()

    rows = T._met(T._pieces(tiles, models, edge, None, most=T.GROUPED)).applyInPandas(per_tile, schema).mapInPandas(partial, schema)
    kind = F.col("name")
    combined = reduce(lambda a, b: a.when(b[0], b[1]), [(kind == n, {"sum": F.sum, "max": F.max, "min": F.min}[h]("v")) for n, h in how.items()], F)
    return rows.groupBy("material_id", "plane", "name", "at").agg(F.first("pixels").alias("pixels"), combined.alias("v"))


def _arrays(pdf: pd.DataFrame, name: str) -> dict[int, np.ndarray]:
    """The array ``name`` of every plane of one material."""
    own = pdf[pdf["name"] == name]
    return {int(p): rows.sort_values("at")["v"].to_numpy() for p, rows in own.groupby("plane")}


def changed(tiles: DataFrame, values: DataFrame, edge: int, change: Callable[[np.ndarray, np.ndarray, np.ndarray, pd.Series], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Tiles with both levels as ``change`` (v0, v1, source, the material's row of ``values``) makes them; no tile looks at another."""
    names = values.columns

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for _, r in pdf.iterrows():  # a tile at a time: a batch holds as many as a task reads
                own0, own1 = T.Grid(r["h0"], r["w0"], r["h1"], r["w1"], edge).own(r["ty"], r["tx"])
                v0, v1 = change(T._array(r["v0"], own0), T._array(r["v1"], own1), T._array(r["src"], own0), r)
                yield pd.DataFrame([(*[r[n] for n in _TILE[:8]], T._bytes(v0), T._bytes(v1), r["src"])], columns=_TILE)

    return T._written(tiles.select(*_TILE).join(values, "material_id").select(*_TILE, *[n for n in names if n != "material_id"]).mapInPandas(work, T.TILE))


# ---- starting planes


def _window_means(t: Tile) -> np.ndarray:
    """Footprint means of a tile's own level-1 texels; footprints may begin in the tiles around it."""
    p, grid, ty, tx = t
    (y0, x0), own1 = p.window.at0, p.window.owned1

    def edges(at: int, n: int, n0: int, n1: int) -> np.ndarray:
        k = np.arange(at, at + n + 1)
        return np.where(k >= n1, n0, np.minimum(k * n0 // n1, n0 - 1))

    ys, xs = edges(own1[0], own1[2], grid.h0, grid.h1), edges(own1[1], own1[3], grid.w0, grid.w1)
    part = p.src[ys[0] - y0 : max(ys[-1], ys[-2] + 1) - y0, xs[0] - x0 : max(xs[-1], xs[-2] + 1) - x0]
    sums = np.add.reduceat(np.add.reduceat(part, ys[:-1] - ys[0], 0), xs[:-1] - xs[0], 1)
    return sums / (np.maximum(1, np.diff(ys))[:, None] * np.maximum(1, np.diff(xs))[None, :])[..., None]


def init_level1(tiles: DataFrame, options: Options, nout: int, edge: int = T.EDGE) -> DataFrame:
    """Level 1 from the source: block means of the first distinct channels, or their leading directions, scaled to [-1, 1]."""
    pca = options.init == "pca"
    n = min(options.c1, nout)

    def means_of(pdf: pd.DataFrame) -> pd.DataFrame:
        tile = T._assembled(pdf, edge, True)
        own, r = _window_means(tile), pdf.iloc[0]
        own0 = tile[1].own(tile[2], tile[3])[0]
        v0, src = (T._part(a, (*tile[0].window.at0, *a.shape[:2]), own0) for a in (tile[0].v0, tile[0].src))
        return pd.DataFrame([(r["material_id"], int(r["plane"]), tile[2], tile[3], *[int(r[c]) for c in ("h0", "w0", "h1", "w1")], T._bytes(v0), T._bytes(own), T._bytes(src))], columns=_TILE)

    meant = T._written(T._met(T._pieces(tiles, None, edge, None)).applyInPandas(means_of, T.TILE))
    schema = "material_id string, use array<double>, mean array<double>, scale array<double>"

    def stats(t: Tile, *_: object) -> dict[str, np.ndarray]:
        p, _, _, _ = t
        (y, x, h, w), (oy, ox) = p.window.owned1, p.window.at1
        own = p.v1[y - oy : y - oy + h, x - ox : x - ox + w].reshape(-1, nout)
        (y, x, h, w), (oy, ox) = p.window.owned0, p.window.at0
        src = p.src[y - oy : y - oy + h, x - ox : x - ox + w].reshape(-1, nout)
        return {"n": np.array([len(own)]), "s1": own.sum(0), "s2": own.T @ own, "same": (src[:, :, None] == src[:, None, :]).all(0)}

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        if pca:
            count, s1, s2 = (_arrays(pdf, name)[0] for name in ("n", "s1", "s2"))
            mean = s1 / count[0]
            values, vectors = np.linalg.eigh(s2.reshape(nout, nout) / count[0] - np.outer(mean, mean))
            use = vectors[:, np.argsort(-values)[:n]]
            return pd.DataFrame([(pdf["material_id"].iloc[0], use.ravel(), mean, np.ones(n))], columns=["material_id", "use", "mean", "scale"])
        same = np.min(list(_arrays(pdf, "same").values()), 0).reshape(nout, nout) > 0
        first = distinct_first(nout, [(a, b) for a in range(nout) for b in range(a + 1, nout) if same[a, b]])[:n]
        return pd.DataFrame([(pdf["material_id"].iloc[0], np.eye(nout)[:, first].ravel(), np.full(nout, 0.5), np.full(n, 0.5))], columns=["material_id", "use", "mean", "scale"])

    chosen = stored(gathered(meant, None, edge, stats, {"n": "sum", "s1": "sum", "s2": "sum", "same": "min"}).groupBy("material_id").applyInPandas(choose, schema), "encode-start")
    if pca:
        def peaks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                out = []
                for _, r in pdf.iterrows():
                    own = T._array(r["v1"], T.Grid(r["h0"], r["w0"], r["h1"], r["w1"], edge).own(r["ty"], r["tx"])[1])
                    out.append((r["material_id"], np.abs((own - r["mean"]) @ np.asarray(r["use"]).reshape(nout, n)).max((0, 1))))
                yield pd.DataFrame(out, columns=["material_id", "peak"])

        per_tile = meant.select(*_TILE).join(chosen, "material_id").mapInPandas(peaks, "material_id string, peak array<double>")
        peak = per_tile.select("material_id", F.posexplode("peak").alias("at", "v")).groupBy("material_id", "at").agg(F.max("v").alias("v"))
        peak = peak.groupBy("material_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "v"))), lambda s: F.when(s["v"] > 0, s["v"]).otherwise(F.lit(1.0))).alias("scale"))
        chosen = stored(chosen.drop("scale").join(peak, "material_id").select("material_id", "use", "mean", "scale"), "encode-start")

    def project(v0: np.ndarray, v1: np.ndarray, src: np.ndarray, r: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        found = (v1 - np.asarray(r["mean"])) @ np.asarray(r["use"]).reshape(nout, n) / np.asarray(r["scale"])
        return v0, np.concatenate([found, np.zeros((*found.shape[:2], options.c1 - n))], 2)

    out = changed(meant, chosen, edge, project)
    forget(meant, chosen)
    return out


# ---- grids


def ranges(tiles: DataFrame, level0: bool, n: int, policy: str, edge: int = T.EDGE) -> DataFrame:
    """material_id, lo and hi (arrays by channel): the extremes, or the exact 0.1 % and 99.9 % order statistics of all planes; [-1, 1] if flat; float32."""
    long = T.planes(tiles, level0, n, edge).select("material_id", F.posexplode(F.array(*[f"c{i}" for i in range(n)])).alias("ch", "v"))
    if policy == "minmax":
        found = long.groupBy("material_id", "ch").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    else:
        values = stored(long, "encode-values")
        found = order_statistics(values, ["material_id", "ch"], "v", {"lo": 0.001, "hi": 0.999})
        forget(values)
    flat = ~(F.col("hi") > F.col("lo"))
    end = lambda c, other: F.when(flat, F.lit(other)).otherwise(F.col(c)).cast("float").cast("double")
    ends = F.struct("ch", end("lo", -1.0).alias("lo"), end("hi", 1.0).alias("hi"))
    listed = found.groupBy("material_id").agg(F.sort_array(F.collect_list(ends)).alias("e"))
    return stored(listed.select("material_id", F.col("e.lo").alias("lo"), F.col("e.hi").alias("hi")), "encode-grid")


def snapped(tiles: DataFrame, grid: DataFrame, level0: bool, bits: int, edge: int = T.EDGE) -> DataFrame:
    """A level on its material's grid."""

    def snap(v0: np.ndarray, v1: np.ndarray, src: np.ndarray, r: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = np.asarray(r["lo"], float), np.asarray(r["hi"], float)
        on = lambda v: L.grid_value(lo, hi, bits, L.grid_index(lo, hi, bits, v))
        return (on(v0), v1) if level0 else (v0, on(v1))

    return changed(tiles, grid, edge, snap)


# ---- seeding level 0 from the residual


def seeded(tiles: DataFrame, models: DataFrame, c: int, options: Options, palettes: list[np.ndarray], edge: int = T.EDGE) -> DataFrame:
    """Level-0 channel ``c`` along the residual's leading direction, scaled by its peak (or the percentile of a palette's)."""
    o, blocks = options, options.l0 == "bc8"

    def residual(t: Tile, w: np.ndarray, b: np.ndarray) -> np.ndarray:
        p, _, _, _ = t
        _, t0, t1, target = next(L.sites(p, 0))
        return D.phi_matrix(t0.read(p.v0), t1.read(p.v1)) @ w.T + b - target

    def stats(t: Tile, w: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
        r = residual(t, w, b)
        return {"n": np.array([len(r)]), "s1": r.sum(0), "s2": r.T @ r}

    def direction(pdf: pd.DataFrame) -> pd.DataFrame:
        pixels = pdf.groupby("plane")["pixels"].first()
        omega = P.per_site_weights(pixels, o.mip_weight, o.mip_mix, o.k) if o.init0_scope == "chain" else np.array([float(p == 0) for p in pixels.index])
        n, s1, s2 = (sum(w * a[p] for w, p in zip(omega, pixels.index, strict=True)) for a in (_arrays(pdf, "n"), _arrays(pdf, "s1"), _arrays(pdf, "s2")))
        mu = s1 / n[0]
        m = len(mu)
        cov = s2.reshape(m, m) / n[0] - np.outer(mu, mu)
        e = np.zeros(m)
        if o.init0 == "texture":
            tops = [np.linalg.eigh(cov[t : t + 3, t : t + 3]) for t in range(0, m, 3)]
            best = int(np.argmax([v[-1] for v, _ in tops]))
            e[3 * best : 3 * best + 3] = tops[best][1][:, -1]
        else:
            e = np.linalg.eigh(cov)[1][:, -1]
        e = e * (np.sign(e[np.abs(e).argmax()]) or 1.0)
        return pd.DataFrame([(pdf["material_id"].iloc[0], e, mu)], columns=["material_id", "e", "mu"])

    found = stored(gathered(tiles, models, edge, stats, {"n": "sum", "s1": "sum", "s2": "sum"}).groupBy("material_id").applyInPandas(direction, "material_id string, e array<double>, mu array<double>"), "encode-direction")

    def project(pdf: pd.DataFrame) -> pd.DataFrame:
        t = T._assembled(pdf, edge, True)
        r = pdf.iloc[0]
        extent, own0, own1 = t[1], *t[1].own(t[2], t[3])
        w, b = T._decoder_of(pdf, t[0].src.shape[2])
        held = np.frombuffer(r["g"], "<f8").reshape(2, -1)  # e, mu
        v0 = np.array(T._part(t[0].v0, (*t[0].window.at0, *t[0].v0.shape[:2]), own0))
        v0[..., c] = ((residual(t, w, b) - held[1]) @ held[0]).reshape(own0[2], own0[3])
        v1 = T._part(t[0].v1, (*t[0].window.at1, *t[0].v1.shape[:2]), own1)
        src = T._part(t[0].src, (*t[0].window.at0, *t[0].src.shape[:2]), own0)
        return pd.DataFrame([(r["material_id"], int(r["plane"]), t[2], t[3], extent.h0, extent.w0, extent.h1, extent.w1, T._bytes(v0), T._bytes(v1), T._bytes(src))], columns=_TILE)

    def blob(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame({"material_id": pdf["material_id"], "g": [T._bytes(np.stack([np.asarray(e), np.asarray(m)]), "<f8") for e, m in zip(pdf["e"], pdf["mu"], strict=True)]})

    directed = models.drop("g").join(found.mapInPandas(blob, "material_id string, g binary"), "material_id")
    projected = T._written(T._met(T._pieces(tiles, directed, edge, None)).applyInPandas(project, T.TILE))
    values = T.planes(projected, True, o.c0, edge).select("material_id", F.abs(F.col(f"c{c}")).alias("v"))
    peak = values.groupBy("material_id").agg(F.max("v").alias("peak"))
    if blocks:
        divisor = peak.select("material_id", F.col("peak").alias("divisor"))
    else:
        rows = values.join(peak, "material_id").filter("peak > 0")
        bins = rows.groupBy("material_id", "peak", F.least(F.lit(P.BINS - 1), F.floor(F.col("v") / F.col("peak") * P.BINS)).alias("bin")).count()
        w = F.sum("count").over(T.R.Window.partitionBy("material_id").orderBy("bin")).alias("upto")
        total = F.sum("count").over(T.R.Window.partitionBy("material_id")).alias("total")
        hit = bins.select("material_id", "peak", "bin", w, total).filter(F.col("upto") >= F.floor(F.lit(P.PERCENTILE) * F.col("total")))
        found_bin = hit.groupBy("material_id").agg((F.first("peak") * (F.min("bin") + 1) / P.BINS).alias("d"))
        divisor = peak.join(found_bin, "material_id", "left").select("material_id", F.coalesce("d", "peak").alias("divisor"))

    def scale(v0: np.ndarray, v1: np.ndarray, src: np.ndarray, r: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        d = r["divisor"]
        v0 = np.array(v0)
        v0[..., c] = np.clip(v0[..., c] / d if d > 0 else 0 * v0[..., c], -1, 1)
        if not blocks:
            v0[..., c] = palettes[c][np.abs(v0[..., c, None] - palettes[c]).argmin(-1)]
        return v0, v1

    out = changed(projected, stored(divisor, "encode-divisor"), edge, scale)
    forget(projected, found)
    return out


# ---- the loop


class _Fit:
    """The driver's side: which materials are where, and what has been noted of them."""

    def __init__(self, tiles: DataFrame, cw: Sequence[float], options: Options, edge: int, turns: Sequence[int], weights: Callable[[DataFrame], DataFrame]) -> None:
        self.tiles, self.cw, self.o, self.edge, self.turns, self.norm = tiles, cw, options, edge, turns, weights
        self.models: DataFrame | None = None
        self.errors: dict[str, float] = {}  # a number per material
        self.rows: list[tuple] = []
        self.blocks = options.l0 == "bc8"
        self.palettes = [] if self.blocks else [(-1 + 2 * L.replicate(np.arange(1 << b), b) / 255.0).astype(np.float32).astype(float) for b in options.palette_bits]

    def note(self, n: int, block: str, moved: dict[str, int] | None = None) -> None:
        self.rows += [(m, n, block, e, (moved or {}).get(m, 0)) for m, e in sorted(self.errors.items())]

    def decode(self, n: int, block: str) -> None:
        """Block (a): the decoders, and exact errors."""
        old = self.models
        self.models = T.decoders(self.tiles, self.cw, self.o, self.models, self.edge)
        forget(old)
        self.errors = {r["material_id"]: r["after"] for r in self.models.select("material_id", "after").collect()}
        self.note(n, block)

    def with_grids(self, grid0: DataFrame | None, grid1: DataFrame) -> None:
        """The models with their grids as the steps want them."""
        both = self.models.drop("g").join(grid1.select("material_id", F.col("lo").alias("lo1"), F.col("hi").alias("hi1")), "material_id")
        if grid0 is not None:
            both = both.join(grid0.select("material_id", F.col("lo").alias("lo0"), F.col("hi").alias("hi0")), "material_id")
        else:
            both = both.withColumns({n: F.array(*[F.lit(v)] * self.o.c0) for n, v in (("lo0", -1.0), ("hi0", 1.0))})

        def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                pdf["g"] = [T._bytes(np.concatenate([np.asarray(r[n], float) for n in ("lo0", "hi0", "lo1", "hi1")]), "<f8") for _, r in pdf.iterrows()]
                yield pdf[T._names(T.DECODER)]

        self.models = T._written(both.mapInPandas(pack, T.DECODER))

    def stepped(self, tiles: DataFrame, models: DataFrame, level0: bool, frozen: bool) -> DataFrame:
        """Tiles after a level's step: all at once, but for the search of palettes."""
        if level0 and not self.blocks:
            return T.step(tiles, models, self.level0(frozen), self.edge, self.turns)
        action = self.level0(frozen) if level0 else self.level1(frozen)
        return T.step(tiles, models, action, self.edge, halo=T.reach_of(level0, self.o, frozen), k=self.o.k if level0 else None)

    def step(self, n: int, block: str, level0: bool, frozen: bool) -> None:
        """A level's step, and the errors its own changes give."""
        old, self.tiles = self.tiles, self.stepped(self.tiles, self.models, level0, frozen)
        change = self.norm(self.tiles).collect()  # a row per material
        for r in change:
            self.errors[r["material_id"]] += r["change"]
        forget(old)
        self.note(n, block, {r["material_id"]: r["moved"] for r in change})

    def level1(self, frozen: bool) -> T.Action:
        return T.sweeping(False, self.cw, None, None, self.o.bits1, self.o) if frozen else T.solving(False, self.cw, self.o)

    def level0(self, frozen: bool) -> T.Action:
        if not self.blocks:
            return T.searching(self.cw, self.palettes, self.o)
        return T.sweeping(True, self.cw, None, None, 8, self.o) if frozen else T.solving(True, self.cw, self.o)

    def freeze(self, n: int) -> tuple[DataFrame | None, DataFrame]:
        o = self.o
        grid1 = ranges(self.tiles, False, o.c1, o.q1_range, self.edge)
        self.tiles = snapped(self.tiles, grid1, False, o.bits1, self.edge)
        grid0 = None
        if self.blocks:
            grid0 = ranges(self.tiles, True, o.c0, o.q1_range, self.edge)
            self.tiles = snapped(self.tiles, grid0, True, 8, self.edge)
        self.with_grids(grid0, grid1)
        self.errors |= {r["material_id"]: r["error"] for r in T.errors(self.tiles, self.models, self.cw, o, self.edge).collect()}
        self.note(n, "freeze")
        return grid0, grid1


def _changes(tiles: DataFrame, cw: Sequence[float], o: Options) -> Callable[[DataFrame], DataFrame]:
    """What a step's tiles say of the material's error: (material_id, change, moved)."""

    def weigh(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("plane")
        omega = P.per_site_weights(pdf["pixels"], o.mip_weight, o.mip_mix, o.k)
        norm = float(sum(cw)) * float(np.dot(omega, pdf["pixels"] * (1 + o.k)))
        return pdf[["material_id", "plane"]].assign(weight=omega / norm if norm > 0 else 0.0)

    pixels = tiles.select("material_id", "plane", (F.col("h0").cast("long") * F.col("w0")).alias("pixels")).distinct()
    weights = stored(pixels.groupBy("material_id").applyInPandas(weigh, "material_id string, plane int, weight double"), "encode-weights")
    return lambda tiles: tiles.select("material_id", "plane", "delta_e", "moved").join(weights, ["material_id", "plane"]).groupBy("material_id").agg(F.sum(F.col("delta_e") * F.col("weight")).alias("change"), F.sum("moved").alias("moved"))


def encode(source: DataFrame, sizes: Sequence[tuple[int, int, int, int, int]], cw: Sequence[float], options: Options | None = None, edge: int = EDGE) -> Encoded:
    """Materials fitted and packed tile by tile.

    ``source`` is their padded chain (material_id, plane, x, y, c0 ..), ``sizes`` its (plane, w0, h0, w1, h1), planes from 0 on:
    every material of a call has them all.
    """
    return encode_chains([(source, sizes)], cw, options, edge)


def encode_chains(chains: Sequence[tuple[DataFrame, Sequence[tuple[int, int, int, int, int]]]], cw: Sequence[float], options: Options | None = None, edge: int = EDGE) -> Encoded:
    """The same of materials of several extents: chains of those of one extent, and its sizes."""
    o = options or Options()
    nout = len(channels(chains[0][0]))
    bad = violations(o, nout // 3)
    if bad:
        raise ValueError("; ".join(bad))
    if edge % 4 or edge < T.LEAST:
        raise ValueError(f"tiles of {edge} pixels are narrower than {T.LEAST} or end within blocks")
    spark = chains[0][0].sparkSession
    begun = [start(source, T.R.geometry_table(spark, list(sizes)), o, edge) for source, sizes in chains]
    extents = [(h0, w0) for _, sizes in chains for _, w0, h0, _, _ in sizes]
    begun = reduce(DataFrame.unionByName, begun)
    m = _Fit(begun, cw, o, edge, T.colours(extents, edge), _changes(begun, cw, o))
    if not m.blocks:
        tables, names = m.palettes, m.tiles.select("material_id").distinct()
        m.tiles = changed(m.tiles, names, edge, lambda v0, v1, src, r: (np.stack([t[np.abs(v0[..., c, None] - t).argmin(-1)] for c, t in enumerate(tables)], 2), v1))
    m.tiles = init_level1(m.tiles, o, nout, edge)
    m.tiles = snapped(m.tiles, ranges(m.tiles, False, o.c1, "minmax", edge), False, o.bits1, edge)
    m.decode(0, "a")
    if o.init0 != "luma":
        for c in range(o.c0):
            m.tiles = seeded(m.tiles, m.models, c, o, m.palettes, edge)
            m.decode(0, f"seed{c}")
            if not m.blocks:
                m.step(0, f"search{c}", True, False)
                m.decode(0, f"seed{c}")
    done: list[tuple[DataFrame, DataFrame]] = []
    grids: tuple[DataFrame | None, DataFrame] | None = None
    quiet: dict[str, int] = {}
    last = 0
    for n in range(1, o.rounds + 1):
        last, began = n, dict(m.errors)
        m.decode(n, "a")
        if n > o.q1_start - 1 and grids is None:
            grids = m.freeze(n)
        m.step(n, "b", False, grids is not None)
        moved = {r[0]: r[4] for r in m.rows if r[1] == n and r[2] == "b"}
        m.step(n, "c", True, grids is not None)
        over = []
        for r in [r for r in m.rows if r[1] == n and r[2] == "c"]:
            drop = (began[r[0]] - r[3]) / began[r[0]] if began[r[0]] > 0 else 0.0
            quiet[r[0]] = quiet.get(r[0], 0) + 1 if drop < o.tol else 0
            if grids is not None and (quiet[r[0]] >= 2 or moved[r[0]] + r[4] == 0):
                over.append(r[0])
        if over and n < o.rounds:
            names = spark.createDataFrame([(x,) for x in over], "material_id string")
            done.append((stored(m.tiles.select(*_TILE).join(names, "material_id"), "tiles"), stored(m.models.join(names, "material_id"), "tiles")))
            m.errors = {k: v for k, v in m.errors.items() if k not in over}
            if not m.errors:
                break
            m.tiles = stored(m.tiles.join(names, "material_id", "left_anti"), "tiles")
            m.models = stored(m.models.join(names, "material_id", "left_anti"), "tiles")
    if done:
        left = bool(m.errors)
        m.tiles = reduce(DataFrame.unionByName, [t for t, _ in done] + ([m.tiles.select(*_TILE)] if left else []))
        m.models = reduce(DataFrame.unionByName, [d for _, d in done] + ([m.models] if left else []))
    ends = {}
    for material, n, _, e, _ in m.rows:
        ends[material] = (n, e)
    m.errors = {k: e for k, (_, e) in ends.items()}
    last += 1
    if grids is None:
        grids = m.freeze(last)
    m.step(last, "b", False, True)
    m.step(last, "c", True, True)
    m.decode(last, "a")
    grid0, grid1 = grids
    if m.blocks:
        _pack(m, grid0, last)
    both = grid1.select("material_id", F.col("lo").alias("lo1"), F.col("hi").alias("hi1"))
    ends0 = grid0.select("material_id", F.col("lo").alias("lo0"), F.col("hi").alias("hi0")) if grid0 is not None else both.select("material_id", *[F.array(*[F.lit(v)] * o.c0).alias(n) for n, v in (("lo0", -1.0), ("hi0", 1.0))])
    return Encoded(m.tiles, m.models, spark.createDataFrame(m.rows, REPORT), both.join(ends0, "material_id"))


def _pack(m: _Fit, grid0: DataFrame, n: int) -> None:
    """Blocks, then repacks that are kept by the materials they help, a refit and a last refinement."""
    o = m.o
    spark = m.tiles.sparkSession

    def packed(tiles: DataFrame, models: DataFrame, seed: bool, passes: int) -> DataFrame:
        return Q.packed(tiles, models, m.cw, o, passes, m.edge) if seed else Q.refine(tiles, models, grid0, m.cw, o, passes, m.edge)[0]

    def errors(tiles: DataFrame, models: DataFrame) -> dict[str, float]:
        return {r["material_id"]: r["error"] for r in T.errors(tiles.select(*_TILE), models, m.cw, o, m.edge).collect()}

    versions = Q.Versions(packed(m.tiles, m.models, True, o.bc_refine))
    m.tiles = versions.latest
    m.errors = errors(m.tiles, m.models)
    m.note(n, "pack")
    active = set(m.errors)
    for _ in range(o.bc_outer):
        if not active:
            break
        mine = spark.createDataFrame([(x,) for x in sorted(active)], "material_id string")
        tiles = versions.latest.join(mine, "material_id")
        models = T.decoders(tiles.select(*_TILE), m.cw, o, m.models, m.edge)
        stepped = m.stepped(tiles, models, True, True)
        again = packed(stepped, models, True, o.bc_refine)
        found = errors(again, models)
        active = {k for k, e in found.items() if e < m.errors[k]}
        better = spark.createDataFrame([(x,) for x in sorted(active)], "material_id string")
        versions.accept(again, better)
        m.models = stored(models.join(better, "material_id").unionByName(m.models.join(better, "material_id", "left_anti")), "tiles")
        m.errors |= {k: found[k] for k in active}
        m.rows += [(k, n, "repack", found[k], 0) for k in sorted(active)]
    m.tiles = versions.latest
    m.decode(n, "refit")
    if o.bc_refine_after:
        m.tiles = packed(m.tiles, m.models, False, o.bc_refine_after)
        m.errors = errors(m.tiles, m.models)
        m.note(n, "refine")


def chain_of(plane: DataFrame, w: int, h: int, name: str, options: Options) -> tuple[DataFrame, list[tuple[int, int, int, int, int]]]:
    """A picture's padded chain as ``encode`` takes it, and its sizes."""
    from rasterloom.functions.scalar import mip_count

    padded, w, h = T.R.pad(plane, w, h)
    padded = stored(padded, "encode-base")  # every level reads it
    levels = mip_count(w, h, options.mip_min) if options.mips else 0
    return P.with_material(T.R.box_chain(padded, w, h, levels), name), T.R.geometry(w, h, levels)


def chains_of(materials: DataFrame, extents: dict[tuple[int, int], list[str]], options: Options) -> list[tuple[DataFrame, list[tuple[int, int, int, int, int]]]]:
    """Chains and sizes as ``encode_chains`` takes them, of materials by their extent (w, h); levels that are given are taken as they are."""
    out = []
    for (w, h), names in extents.items():
        for name in names:
            mine = materials.filter(F.col("material_id") == name).drop("material_id")
            given = sorted((r["plane"], r["w"], r["h"]) for r in mine.filter("plane > 0").groupBy("plane").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h")).collect())  # a row per level
            chain, sizes = chain_of(mine.filter("plane = 0"), w, h, name, replace(options, mips=options.mips and not given))
            if given:
                sizes = [sizes[0], *((p, gw, gh, *low[3:]) for (p, gw, gh), low in zip(given, T.R.geometry(*sizes[0][1:3], len(given))[1:], strict=True))]
                chain = chain.unionByName(P.with_material(mine.filter("plane > 0"), name))
            out.append((chain, sizes))
    return out
