"""Checks that are queries: grid closure, thresholds, equality of states."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.scalar import grid_index, grid_value, lit


def grid_violations(indexed: DataFrame, lo: float, hi: float, bits: int, keys: Sequence[str] = ("plane", "ch")) -> DataFrame:
    """Per key: values, values that aren't their index's grid value, indices that don't quantise to themselves."""
    value = grid_value(lit(lo), lit(hi), bits, F.col("k"))
    back = grid_index(lit(lo), lit(hi), bits, F.col("v"))
    return indexed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("v") != value).cast("int")).alias("off_grid"), F.sum((back != F.col("k")).cast("int")).alias("not_closed"))


def frame_check(diff: DataFrame, max_diff: int | None = None, min_psnr: float | None = None) -> DataFrame:
    """Frame differences with a verdict per channel."""
    good = F.lit(True)
    if max_diff is not None:
        good = good & (F.col("max_diff") <= max_diff)
    if min_psnr is not None:
        good = good & (F.col("psnr") >= min_psnr)
    return diff.withColumn("passed", good)


def require(checked: DataFrame, column: str = "passed") -> DataFrame:
    """The same rows, but the query fails on the first that didn't pass."""
    return checked.filter(F.assert_true(F.col(column), F.lit(f"{column} is false")).isNull())


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table that the other lacks, duplicates counted; empty if they are equal."""
    left, right = a.exceptAll(b.select(*a.columns)), b.select(*a.columns).exceptAll(a)
    return left.withColumn("side", F.lit("left")).unionByName(right.withColumn("side", F.lit("right")))


def summary(results: DataFrame, by: str = "name") -> DataFrame:
    """Calls, failures and the largest difference per checked function."""
    return results.groupBy(by).agg(F.count(F.lit(1)).alias("calls"), F.sum((~F.col("passed")).cast("int")).alias("failures"), F.max("difference").alias("largest"))


#: Relative bars of ``compare_models`` by part, and that of all others.
BARS = {"weights": 1e-4, "bias": 1e-4}
BAR = 1e-5


def float32_place(v: Column) -> Column:
    """A float32 value's place among all float32 numbers in order, 0 for zero; neighbours are 1 apart.

    From the exponent and the mantissa, both exact in doubles: logarithms only find the exponent, and are set right by it.
    """
    m = F.abs(v)
    e = F.floor(F.log2(m))
    e = e - F.when(F.pow(F.lit(2.0), e.cast("double")) > m, 1).otherwise(0)
    e = e + F.when(F.pow(F.lit(2.0), (e + 1).cast("double")) <= m, 1).otherwise(0)
    normal = (e + 126) * F.lit(1 << 23) + (m / F.pow(F.lit(2.0), e.cast("double"))) * F.lit(float(1 << 23))
    least = m / F.lit(2.0**-149)
    return (F.signum(v) * F.when(m == 0, F.lit(0.0)).when(m < F.lit(2.0**-126), least).otherwise(normal)).cast("long")


def compare_models(a: DataFrame, b: DataFrame, bars: dict[str, float] | None = None, keys: Sequence[str] = ("material_id", "part")) -> DataFrame:
    """Two models value by value; both tables are long: ``keys`` (among them part), plane, at, kind and v.

    ``kind`` is choice for what was chosen among whole numbers (grid indices, selectors, endpoints) and value for
    float32 numbers. Per key: n (pairs), only_a, only_b, equal (float32 bits alike, or choices), flips (choices that
    differ, counted apart as one flip moves what follows it) and the largest, worst_ulps (units in the last place),
    worst_rel, beyond (values over their part's relative bar, of the larger of both), and same: nothing missing, none beyond.
    """
    at = [*keys, "plane", "at"]
    side = lambda df, n: df.select(*at, "kind", F.col("v").cast("float").cast("double").alias(f"__{n}"), F.col("v").cast("double").alias(f"__{n}0"))
    both = side(a, "a").join(side(b, "b"), [*at, "kind"], "full")
    limit = F.lit(BAR)
    for part, bar in (BARS if bars is None else bars).items():
        limit = F.when(F.col("part") == part, F.lit(float(bar))).otherwise(limit)
    x, y = F.col("__a"), F.col("__b")
    pair = x.isNotNull() & y.isNotNull()
    value, choice = pair & (F.col("kind") == "value"), pair & (F.col("kind") == "choice")
    largest = F.greatest(F.abs(x), F.abs(y))
    rel = F.when(value, F.when(largest > 0, F.abs(x - y) / largest).otherwise(F.lit(0.0)))
    flip = choice & (F.col("__a0") != F.col("__b0"))
    zero = F.lit(0)
    out = both.groupBy(*keys).agg(
        F.count_if(pair).alias("n"),
        F.count_if(F.col("__b0").isNull()).alias("only_a"),
        F.count_if(F.col("__a0").isNull()).alias("only_b"),
        F.count_if((value & (x == y)) | (choice & ~flip)).alias("equal"),
        F.count_if(flip).alias("flips"),
        F.coalesce(F.max(F.when(flip, F.abs(F.col("__a0") - F.col("__b0")))), zero).cast("long").alias("worst_flip"),
        F.coalesce(F.max(F.when(value, F.abs(float32_place(x) - float32_place(y)))), zero).alias("worst_ulps"),
        F.coalesce(F.max(rel), F.lit(0.0)).alias("worst_rel"),
        F.count_if(rel > limit).alias("beyond"),
    )
    return out.withColumn("same", (F.col("only_a") == 0) & (F.col("only_b") == 0) & (F.col("beyond") == 0))


def model_values(fitted: DataFrame) -> DataFrame:
    """Rows of ``plans.fit.fit`` as ``compare_models`` reads them: a row per number."""
    kinds = ("weights", "bias", "lo0", "hi0", "lo1", "hi1")

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for r in pdf.itertuples(index=False):
                v = np.frombuffer(bytes(r.data), "<f8" if r.part in kinds else "<i8")
                yield pd.DataFrame({"material_id": r.material_id, "part": r.part, "plane": r.plane, "at": np.arange(len(v)), "kind": "value" if r.part in kinds else "choice", "v": v.astype(float)})

    return fitted.mapInPandas(rows, "material_id string, part string, plane int, at long, kind string, v double")
