"""The block step of a level over whole planes of any extent: conjugate gradients across tiles.

The system (H + lam) d = -g of a plane has nine-point rows, so a tile that keeps its own rows
needs of the others no more than the ring of texels around it.  Tiles hold their rows
(written once, bucketed by tile), their parts of the vectors are a small table of their own, and
an iteration is

* *advance*, without a shuffle of rows: every tile moves its parts along the last direction,
  solves its own block of the system for the new residual (the preconditioner), and
  sends one-texel strips of the result to its eight neighbours;
* *multiply*: strips meet at their tile, which applies its rows and adds up two products;
* two sums per plane, from which the step lengths of the next iteration follow.

The recurrences are those with one reduction per iteration: both products are of the same
vectors, so one pass over the tiles gives them.  Planes that have converged leave the
iteration with their solution; the others go on.  Every iteration's vectors are written
to the shared folder and the ones before it deleted: a lost executor costs part of one iteration.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.config import Options
from rasterloom.operators import latents as L
from rasterloom.plans import tiles as T
from rasterloom.session import forget, shared_path, stored

TOLERANCE, MAX_ITERATIONS = 1e-9, 200
_PLANE = ["material_id", "plane"]
_SYSTEM = f"material_id string, plane int, ty int, tx int, {T._EXTENT}, blocks binary, gradient binary, trace double, values long"
_VECTORS = "x binary, r binary, p binary, s binary, u binary, w binary"
_STATE = f"material_id string, plane int, ty int, tx int, {_VECTORS}, gamma double, delta double, rr double"
_PIECE = "material_id string, plane int, ty int, tx int, rect array<int>, u binary, x binary, r binary, p binary, s binary"


def _ring(own: L.Rect, h: int, w: int) -> L.Rect:
    """A rectangle and the texels around it, within (h, w)."""
    y, x = max(0, own[0] - 1), max(0, own[1] - 1)
    return y, x, min(h, own[0] + own[2] + 1) - y, min(w, own[1] + own[3] + 1) - x


class _Tile:
    """One row's rectangles at the level that is solved."""

    def __init__(self, r, edge: int, level0: bool) -> None:
        self.grid = T.Grid(r.h0, r.w0, r.h1, r.w1, edge)
        self.level0, self.ty, self.tx = level0, r.ty, r.tx
        self.h, self.w = (r.h0, r.w0) if level0 else (r.h1, r.w1)
        self.own = self.of(r.ty, r.tx)
        self.ring = _ring(self.own, self.h, self.w)

    def of(self, ty: int, tx: int) -> L.Rect:
        return self.grid.own(ty, tx)[not self.level0]

    def neighbours(self) -> Iterator[tuple[int, int, L.Rect]]:
        """Tiles that need a part of this one's, and the part (not this one itself)."""
        for ty in range(max(0, self.ty - 1), min(self.grid.counts[0], self.ty + 2)):
            for tx in range(max(0, self.tx - 1), min(self.grid.counts[1], self.tx + 2)):
                part = T._meet(self.own, _ring(self.of(ty, tx), self.h, self.w))
                if (ty, tx) != (self.ty, self.tx) and part[2] * part[3]:
                    yield ty, tx, part


def _vector(data: bytes, rect: L.Rect) -> np.ndarray:
    return T._array(data, rect, "<f8")


def _system_of(r, tile: _Tile) -> np.ndarray:
    y, x, h, w = tile.ring
    c = round((len(r.blocks) / 8 / (5 * h * w)) ** 0.5) if h * w else 1
    return np.frombuffer(r.blocks, "<f8").reshape(5, h, w, c, c)


def systems(tiles: DataFrame, found: DataFrame, level0: bool, cw: Sequence[float], options: Options | None = None, edge: int = T.EDGE) -> DataFrame:
    """Every tile's rows of its plane's system: blocks of its own texels and of the ring around them, and its part of g."""
    o, weights = options or Options(), np.asarray(cw, float)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        p, _, _, _ = T._assembled(pdf, edge, False)
        r = next(pdf.itertuples(index=False))
        tile = _Tile(r, edge, level0)
        s = L.assemble_all(p, *T._decoder_of(pdf, len(weights)), weights, o.k, level0)
        at = p.window.at0 if level0 else p.window.at1
        far = (*at, *s.gradient.shape[:2])
        y, x, h, w = tile.ring[0] - at[0], tile.ring[1] - at[1], *tile.ring[2:]
        own = T._part(s.blocks[0], far, tile.own)
        return pd.DataFrame(
            [(r.material_id, r.plane, r.ty, r.tx, r.h0, r.w0, r.h1, r.w1, T._bytes(s.blocks[:, y : y + h, x : x + w], "<f8"), T._bytes(T._part(s.gradient, far, tile.own), "<f8"), float(np.einsum("hwii->", own)), own.shape[0] * own.shape[1] * own.shape[2])],
            columns=T._names(_SYSTEM),
        )

    return T._met(T._pieces(tiles, found, edge, None)).applyInPandas(build, _SYSTEM)


def _bucketed(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, dealt by tile into as many buckets as shuffles have partitions: joins by tile leave it in place."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    table = "t_" + path.rsplit("/", 1)[-1].replace("-", "_")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, *T._KEYS).write.bucketBy(n, *T._KEYS).option("path", path).saveAsTable(table)
    out = spark.table(table)
    out._stored_path = path
    return out, table


def _advance(rows: DataFrame, level0: bool, edge: int) -> DataFrame:
    """Tiles with their rows, vectors, alpha, beta and lam: strips for the neighbours and the tile's own new vectors."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for r in pdf.itertuples(index=False):
                tile = _Tile(r, edge, level0)
                own, out = tile.own, []
                blocks = _system_of(r, tile)
                y, x = own[0] - tile.ring[0], own[1] - tile.ring[1]
                if r.u is None:  # the beginning
                    res = -_vector(r.gradient, own)
                    sol, p, s = np.zeros_like(res), np.zeros_like(res), np.zeros_like(res)
                else:
                    sol, res, p, s, u, w = (_vector(v, own) for v in (r.x, r.r, r.p, r.s, r.u, r.w))
                    p, s = u + r.beta * p, w + r.beta * s
                    sol, res = sol + r.alpha * p, res - r.alpha * s
                mine = np.array(blocks[:, y : y + own[2], x : x + own[3]])
                u, _ = L.conjugated(L.Stencil(mine, -res), r.lam)
                for ty, tx, part in tile.neighbours():
                    out.append((r.material_id, r.plane, ty, tx, list(part), T._bytes(T._part(u, own, part), "<f8"), None, None, None, None))
                out.append((r.material_id, r.plane, r.ty, r.tx, list(own), *(T._bytes(v, "<f8") for v in (u, sol, res, p, s))))
                yield pd.DataFrame(out, columns=T._names(_PIECE))

    return rows.mapInPandas(work, _PIECE)


def _multiply(rows: DataFrame, level0: bool, edge: int) -> DataFrame:
    """Tiles with their rows, vectors and all pieces of u: their state with w = (H + lam) u and its products."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for r in pdf.itertuples(index=False):
                tile = _Tile(r, edge, level0)
                blocks = _system_of(r, tile)
                whole = np.zeros((*blocks.shape[1:3], blocks.shape[4]))
                for piece in r.pieces:
                    rect = tuple(piece["rect"])
                    T._part(whole, tile.ring, rect)[:] = _vector(piece["u"], rect)
                u = T._part(whole, tile.ring, tile.own)
                w = T._part(L.Stencil(blocks, whole).apply(whole), tile.ring, tile.own) + r.lam * u
                res = _vector(r.r, tile.own)
                yield pd.DataFrame([(r.material_id, r.plane, r.ty, r.tx, r.x, r.r, r.p, r.s, T._bytes(u, "<f8"), T._bytes(w, "<f8"), float((res * u).sum()), float((w * u).sum()), float((res * res).sum()))], columns=T._names(_STATE))

    return rows.mapInPandas(work, _STATE)


def _lengths(state: DataFrame, before: DataFrame | None, tolerance: float) -> DataFrame:
    """alpha, beta, residual and going (whether to iterate on) of every plane."""
    sums = state.groupBy(*_PLANE).agg(F.sum("gamma").alias("gamma"), F.sum("delta").alias("delta"), F.sum("rr").alias("rr"))
    if before is None:
        beta, least, start, n = F.lit(0.0), F.col("delta"), F.col("rr"), F.lit(0)
    else:
        old = before.select(*_PLANE, F.col("gamma").alias("gamma_"), F.col("alpha").alias("alpha_"), F.col("start").alias("start_"), F.col("iterations").alias("n_"))
        sums = sums.join(old, _PLANE)
        beta = F.col("gamma") / F.col("gamma_")
        least, start, n = F.col("delta") - beta * F.col("gamma") / F.col("alpha_"), F.col("start_"), F.col("n_") + 1
    residual = F.when(start > 0, F.sqrt(F.col("rr") / start)).otherwise(F.lit(0.0))
    out = sums.select(*_PLANE, "gamma", F.when(least > 0, F.col("gamma") / least).alias("alpha"), F.coalesce(beta, F.lit(0.0)).alias("beta"), start.alias("start"), n.alias("iterations"), residual.alias("residual"))
    return out.withColumn("going", (F.col("residual") >= tolerance) & F.coalesce(F.col("alpha") > 0, F.lit(False)))


@dataclass
class Solution:
    """Tiles after the step, every texel's correction, and how each plane came to it."""

    tiles: DataFrame
    corrections: DataFrame  # tile keys, extents, x: float64 bytes of d over the tile's texels
    report: DataFrame  # material_id, plane, iterations, residual


def solve(tiles: DataFrame, found: DataFrame, level0: bool, cw: Sequence[float], options: Options | None = None, edge: int = T.EDGE, tolerance: float = TOLERANCE, most: int = MAX_ITERATIONS) -> Solution:
    """The continuous block step of a level over all planes of all materials at once."""
    o = options or Options()
    rows, table = _bucketed(systems(tiles, found, level0, cw, o, edge), "krylov_rows")
    try:
        return _solved(tiles, rows, level0, float(o.ridge), edge, tolerance, most)
    finally:
        tiles.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
        forget(rows)


def _solved(tiles: DataFrame, rows: DataFrame, level0: bool, ridge: float, edge: int, tolerance: float, most: int) -> Solution:
    lam = stored(rows.groupBy(*_PLANE).agg((F.lit(ridge) * F.sum("trace") / F.sum("values")).alias("lam")), "krylov-lam")
    keys = T._KEYS
    state: DataFrame | None = None
    lengths: DataFrame | None = None
    done: list[DataFrame] = []
    reports: list[DataFrame] = []
    for it in range(most + 1):
        if state is None:
            empty = [F.lit(None).cast(t).alias(n) for n, t in (f.split() for f in _VECTORS.split(", "))]
            ready = rows.join(lam, _PLANE).select("*", *empty, F.lit(0.0).alias("alpha"), F.lit(0.0).alias("beta"))
        else:
            moving = lengths.filter("going").select(*_PLANE, "alpha", "beta")
            ready = rows.join(state.drop("gamma", "delta", "rr"), keys).join(lam, _PLANE).join(moving, _PLANE)
        pieces = _advance(ready, level0, edge)
        first = lambda n: F.first(n, ignorenulls=True).alias(n)
        met = pieces.groupBy(*keys).agg(F.collect_list(F.struct("rect", "u")).alias("pieces"), *[first(n) for n in ("x", "r", "p", "s")])
        new = stored(_multiply(rows.drop("gradient").join(met, keys).join(lam, _PLANE), level0, edge), "krylov-state")
        told = stored(_lengths(new, lengths, tolerance), "krylov-lengths")
        forget(state, lengths)
        state, lengths = new, told
        still, at_end = told.agg(F.count_if("going"), F.count_if(~F.col("going"))).first()
        if at_end or it == most:
            over = told if it == most else told.filter("not going")
            done.append(stored(state.join(over.select(*_PLANE), _PLANE).select(*keys, "x"), "krylov-done"))
            reports.append(stored(over.select(*_PLANE, "iterations", "residual"), "krylov-report"))
        if not still:
            break
    report = reduce(DataFrame.unionByName, reports)
    corrections = reduce(DataFrame.unionByName, done)
    moved = stored(_moved(tiles.join(corrections, keys), level0, edge), "tiles")
    corrections = rows.select(*keys, "h0", "w0", "h1", "w1").join(corrections, keys)
    corrections = stored(corrections, "krylov-x")
    forget(lam, state, lengths, *done)
    return Solution(moved, corrections, report)


def _moved(rows: DataFrame, level0: bool, edge: int) -> DataFrame:
    """Tiles with their corrections added, as float32 like all latents."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for name in ["v0" if level0 else "v1"]:
                values = []
                for r in pdf.itertuples(index=False):
                    own = _Tile(r, edge, level0).own
                    values.append(T._bytes(T._array(getattr(r, name), own) + _vector(r.x, own)))
                pdf[name] = values
            yield pdf[T._names(T.TILE)]

    return rows.mapInPandas(work, T.TILE)


def corrected(solution: Solution, level0: bool, n: int, edge: int = T.EDGE) -> DataFrame:
    """The corrections d of ``n`` channels as rows: material_id, plane, x, y, c0 and so on, in double precision."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for r in pdf.itertuples(index=False):
                own = _Tile(r, edge, level0).own
                a = _vector(r.x, own)
                y, x = np.indices(a.shape[:2])
                yield pd.DataFrame({"material_id": r.material_id, "plane": r.plane, "x": x.ravel() + own[1], "y": y.ravel() + own[0]} | {f"c{i}": a[..., i].ravel() for i in range(n)})

    return solution.corrections.mapInPandas(work, "material_id string, plane int, x int, y int, " + ", ".join(f"c{i} double" for i in range(n)))
