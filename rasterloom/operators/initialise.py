"""Starting planes as DataFrame projections: luma, palette snap, residual directions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.scalar import affine, features, grid_index, grid_value, lit, palette_value
from rasterloom.operators.resample import read_level1
from rasterloom.schema import KEYS, channels


@dataclass(frozen=True)
class Direction:
    direction: list[float]
    mean: list[float]
    eigenvalue: float
    share: float
    texture: int = -1


def leading_direction(covariance: DataFrame, by_texture: bool = False) -> Direction:
    """The leading eigenvector of a covariance table (at most 18 x 18), its largest component positive.

    With ``by_texture`` the leading direction of the texture with the largest one.
    """
    rows = covariance.collect()  # 324 numbers at most
    n = 1 + max(r["i"] for r in rows)
    cov, mean = np.zeros((n, n)), np.zeros(n)
    for r in rows:
        cov[r["i"], r["j"]], mean[r["i"]] = r["cov"], r["mean_i"]
    e, texture = np.zeros(n), -1
    if by_texture:
        tops = [np.linalg.eigh(cov[t : t + 3, t : t + 3]) for t in range(0, n, 3)]
        texture = int(np.argmax([v[-1] for v, _ in tops]))
        top, e[3 * texture : 3 * texture + 3] = tops[texture][0][-1], tops[texture][1][:, -1]
    else:
        values, vectors = np.linalg.eigh(cov)
        top, e = values[-1], vectors[:, -1]
    e = e * (1.0 if e[np.abs(e).argmax()] >= 0 else -1.0)
    trace = float(np.trace(cov))
    return Direction(e.tolist(), mean.tolist(), float(top), float(top) / trace if trace > 0 else 0.0, texture)


def luma(source: DataFrame, weights: Sequence[float] = (0.299, 0.587, 0.114), keys: Sequence[str] = KEYS) -> DataFrame:
    total = lit(0)
    for i, w in enumerate(weights):
        total = total + lit(w) * F.col(f"c{i}")
    return source.select(*keys, "x", "y", (lit(2) * total - lit(1)).alias("c0"))


def snap_palette(plane: DataFrame, bits: Sequence[int], block: bool) -> DataFrame:
    """Every channel at its nearest palette value, with index columns k0, k1, ..."""
    out = plane
    for c, b in zip(channels(plane), bits, strict=True):
        near = F.array_min(F.array(*[F.struct(F.abs(F.col(c) - palette_value(b, F.lit(k), block)).alias("d"), F.lit(k).alias("k")) for k in range(1 << b)]))["k"]
        out = out.withColumn(f"k{c[1:]}", near).withColumn(c, palette_value(b, F.col(f"k{c[1:]}"), block))
    return out


def snap_grid(plane: DataFrame, lo: Sequence[float], hi: Sequence[float], bits: int) -> DataFrame:
    """Every channel on its grid, with index columns."""
    out = plane
    for c, a, b in zip(channels(plane), lo, hi, strict=True):
        out = out.withColumn(f"k{c[1:]}", grid_index(lit(a), lit(b), bits, F.col(c))).withColumn(c, grid_value(lit(a), lit(b), bits, F.col(f"k{c[1:]}")))
    return out


def residual(level0: DataFrame, level1: DataFrame, source: DataFrame, size: DataFrame, weights: Sequence[Sequence[float]], bias: Sequence[float], keys: Sequence[str] = KEYS) -> DataFrame:
    """Unclamped decode minus source at the texel centres."""
    at = [*keys, "x", "y"]
    s = channels(level0)
    both = level0.select(*at, *[F.col(c).alias(f"s{i}") for i, c in enumerate(s)]).join(source, at)
    z = [f"z{i}" for i in range(len(channels(level1)))]
    read = read_level1(both, level1, size, z, keys)
    out = affine(weights, bias, features([F.col(f"s{i}") for i in range(len(s))], [F.col(c) for c in z]))
    return read.select(*at, *[(o - F.col(f"c{i}")).alias(f"c{i}") for i, o in enumerate(out)])


def seed_channel(projected: DataFrame, divisor: float) -> DataFrame:
    """A projection ``p`` scaled and clamped to [-1, 1] as a channel."""
    return projected.withColumn("v", F.greatest(lit(-1), F.least(lit(1), F.col("p") / lit(divisor))) if divisor > 0 else lit(0))
