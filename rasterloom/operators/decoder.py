"""Decoder least squares: one Gram aggregation over all sites, one small dense solve.

The Gram matrix of [features, 1] and the right-hand sides are at most 25 x 43
numbers whatever the raster's size: partial sums are built vectorised per Arrow
batch and added up by Spark, and only the sums reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F



# The ridges that are tried in turn, relative to the mean diagonal, and the rise of E that is refused.
RIDGES = (1e-9, 1e-12, 0.0)
ACCEPT_RISE = 1e-12


@dataclass
class Decoder:
    """out = w . phi + b, as stored: single precision."""

    w: np.ndarray
    b: np.ndarray
    rung: int = 0  # which ridge was taken; len(RIDGES) if none

    def rows(self) -> tuple[list[list[float]], list[float]]:
        return self.w.astype(float).tolist(), self.b.astype(float).tolist()


def _counts(columns: Sequence[str]) -> tuple[int, int, int]:
    n = lambda p: len([c for c in columns if c[:1] == p and c[1:].isdigit()])
    return n("s"), n("z"), n("t")


def phi_matrix(s: np.ndarray, z: np.ndarray) -> np.ndarray:
    """[z_j][s_i][s_i * z_j], a row per site."""
    return np.concatenate([z, s, (s[:, :, None] * z[:, None, :]).reshape(len(s), -1)], 1)


def gram(rows: DataFrame, weights: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """A = sum omega v v^T and R = sum omega v t^T over all site rows, v = [phi; 1]; ``weights`` has plane, per_site."""
    c0, c1, nt = _counts(rows.columns)
    m = c1 + c0 + c0 * c1 + 1
    names = [f"s{i}" for i in range(c0)] + [f"z{i}" for i in range(c1)] + [f"t{i}" for i in range(nt)]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            plane = batch.column("plane").to_numpy(zero_copy_only=False)
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names], 1)
            v = np.concatenate([phi_matrix(x[:, :c0], x[:, c0 : c0 + c1]), np.ones((len(x), 1)), x[:, c0 + c1 :]], 1)
            for p in np.unique(plane):
                own = v[plane == p]
                total[int(p)] = total.get(int(p), 0) + own[:, :m].T @ own
        for p, g in total.items():
            i, j = np.indices(g.shape)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(g.size, p, np.int32)), pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(g.ravel())], names=["plane", "i", "j", "v"])

    parts = rows.select("plane", *[F.col(c).cast("double").alias(c) for c in names]).mapInArrow(partial, "plane int, i int, j int, v double")
    summed = parts.groupBy("plane", "i", "j").agg(F.sum("v").alias("v")).join(weights.select("plane", "per_site"), "plane")
    g = np.zeros((m, m + nt))
    for r in summed.groupBy("i", "j").agg(F.sum(F.col("per_site") * F.col("v")).alias("v")).collect():  # at most 25 x 43 sums
        g[r["i"], r["j"]] = r["v"]
    return (g[:, :m] + g[:, :m].T) / 2, g[:, m:]


def gauss_jordan(a: np.ndarray, rhs: np.ndarray) -> np.ndarray | None:
    """Solution with partial pivoting; None on an exactly zero pivot."""
    m = len(a)
    g = np.concatenate([a, rhs], 1).astype(float)
    for k in range(m):
        pivot = k + int(np.argmax(np.abs(g[k:, k])))
        if g[pivot, k] == 0:
            return None
        g[[k, pivot]] = g[[pivot, k]]
        g[k] *= 1.0 / g[k, k]
        others = np.arange(m) != k
        g[others] -= np.outer(g[others, k], g[k])
    return g[:, m:]


def _quadratic(x: np.ndarray, a: np.ndarray, r: np.ndarray, cw: np.ndarray, norm: float) -> tuple[float, float]:
    """E's change as a function of the decoder, and a bound on its own rounding; x is (m, nout)."""
    q = float(cw @ (np.einsum("ic,ij,jc->c", x, a, x) - 2 * np.einsum("ic,ic->c", x, r)))
    size = float(cw @ (np.einsum("ic,ij,jc->c", np.abs(x), np.abs(a), np.abs(x)) + 2 * np.einsum("ic,ic->c", np.abs(x), np.abs(r))))
    return q, np.finfo(float).eps * len(a) * size * norm


def solve(a: np.ndarray, r: np.ndarray, cw: Sequence[float], weight: float, previous: Decoder | None = None) -> Decoder:
    """The best decoder that doesn't raise E: ridges in turn, else the previous one.

    ``weight`` is the weighted number of sites, so the test is in E's own units.
    """
    m, nout = r.shape
    cw = np.asarray(cw, float)
    norm = 1.0 / (cw.sum() * weight) if cw.sum() * weight > 0 else 0.0
    mean_diag = np.trace(a) / m if np.trace(a) > 0 else 1.0
    if previous is not None:
        x_old = np.concatenate([previous.w.T, previous.b[None]]).astype(float)
        q_old, err_old = _quadratic(x_old, a, r, cw, norm)
    for rung, ridge in enumerate(RIDGES):
        x = gauss_jordan(a + ridge * mean_diag * np.eye(m), r)
        if x is None:
            continue
        with np.errstate(over="ignore"):
            x = x.astype(np.float32).astype(float)
        if not np.isfinite(x).all():
            continue
        if previous is not None:
            q, err = _quadratic(x, a, r, cw, norm)
            if not (norm > 0 and (q - q_old) * norm + err_old + err <= ACCEPT_RISE):
                continue
        return Decoder(x[:-1].T.astype(np.float32), x[-1].astype(np.float32), rung)
    if previous is not None:
        return Decoder(previous.w, previous.b, len(RIDGES))
    mean = r[-1] / a[-1, -1] if a[-1, -1] > 0 else np.zeros(nout)
    return Decoder(np.zeros((nout, m - 1), np.float32), mean.astype(np.float32), len(RIDGES))


def fit(rows: DataFrame, weights: DataFrame, cw: Sequence[float], weight: float, previous: Decoder | None = None) -> Decoder:
    a, r = gram(rows, weights)
    return solve(a, r, cw, weight, previous)


def plane_fit(rows: DataFrame, u: str, v: str, targets: Sequence[str]) -> DataFrame:
    """Least squares of every target on two features and a constant, in closed form: one aggregation."""
    x, y = F.col(u), F.col(v)
    sums = rows.agg(F.avg(x).alias("mu"), F.avg(y).alias("mv"), F.covar_pop(x, x).alias("uu"), F.covar_pop(x, y).alias("uv"), F.covar_pop(y, y).alias("vv"), *[e for t in targets for e in (F.avg(t).alias(f"m_{t}"), F.covar_pop(x, F.col(t)).alias(f"u_{t}"), F.covar_pop(y, F.col(t)).alias(f"v_{t}"))])
    det = F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")
    out = []
    for t in targets:
        a = (F.col(f"u_{t}") * F.col("vv") - F.col(f"v_{t}") * F.col("uv")) / det
        b = (F.col(f"v_{t}") * F.col("uu") - F.col(f"u_{t}") * F.col("uv")) / det
        out += [a.alias(f"{t}_{u}"), b.alias(f"{t}_{v}"), (F.col(f"m_{t}") - a * F.col("mu") - b * F.col("mv")).alias(f"{t}_b")]
    return sums.select(*out)


def ridge_tally(decoders: Sequence[Decoder]) -> dict[str, int]:
    names = ("standard", "reduced", "none", "refused")
    return {n: sum(d.rung == i for d in decoders) for i, n in enumerate(names)}


