"""One exact palette step at pixel centres as a relational argmin: candidates are columns, not rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.scalar import affine, features, lit, palette_value


def best_palette(rows: DataFrame, weights: Sequence[Sequence[float]], bias: Sequence[float], cw: Sequence[float], bits: int, block: bool) -> DataFrame:
    """``rows`` (z*, targets c*) with the index k, value and energy of the best level-0 value of one channel.

    The energy is a parabola in the value: three sums of a row give it at all palette
    entries in place; the lowest index wins ties.
    """
    z = [F.col(c) for c in rows.columns if c[:1] == "z" and c[1:].isdigit()]
    targets = [F.col(c) for c in rows.columns if c[:1] == "c" and c[1:].isdigit()]

    start, step = affine(weights, bias, features([lit(0)], z)), affine(weights, bias, features([lit(1)], z))
    total = lambda parts: sum(parts[1:], parts[0])
    sums = {
        "__a": total([lit(c) * (o - t) * (o - t) for c, o, t in zip(cw, start, targets, strict=True)]),
        "__b": total([lit(c) * (o - t) * (s - o) for c, o, s, t in zip(cw, start, step, targets, strict=True)]),
        "__c": total([lit(c) * (s - o) * (s - o) for c, o, s in zip(cw, start, step, strict=True)]),
    }
    at = lambda v: F.round(F.col("__a") + v * (lit(2) * F.col("__b") + v * F.col("__c")), 12)
    states = F.array(*[F.struct(at(palette_value(bits, F.lit(k), block)).alias("energy"), F.lit(k).alias("k"), palette_value(bits, F.lit(k), block).alias("value")) for k in range(1 << bits)])
    return rows.withColumns(sums).withColumn("__best", F.array_min(states)).select("*", "__best.k", "__best.value", "__best.energy").drop("__best", *sums)
