"""Exact order statistics of any number of values by histograms that narrow.

A pass counts, for every wanted rank, the values that still can hold it in BINS bins between
the least and the largest of them.  Counts of bins add up, so tasks send at most BINS rows a
rank and group however many values they hold.  The bin that the rank falls into gives the next
pass its least and largest value, which exist in it, so every pass splits the values further, and a
rank is found when both are equal.  Values that are one bin apart in any pass never meet
again: a billion continuous values take three or four passes, whole numbers of 12 bits one or two.

No window runs over values, only over the bins of one rank.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions.scalar import lit
from rasterloom.session import forget, stored

BINS = 4096


def order_statistics(values: DataFrame, group: Sequence[str], value: str, shares: dict[str, float], bins: int = BINS) -> DataFrame:
    """``group`` and a column for each of ``shares``: the value at index floor(share * last + 0.5) in ascending order, not interpolated.

    Null and NaN values take no part; a group without others has no row. Negative zero counts as
    zero. ``values`` is read once a pass, so store what is costly to make; the result is stored.
    """
    if bins < 2:
        raise ValueError("two bins at least")
    names = list(shares)
    v = F.col(value).cast("double") + lit(0)
    rows = values.select(*group, v.alias("__v")).filter(F.col("__v").isNotNull() & ~F.isnan("__v"))
    wanted = F.array(*[F.struct(F.lit(n).alias("name"), F.floor(lit(q) * (F.col("__all") - 1).cast("double") + lit(0.5)).alias("rank")) for n, q in shares.items()])
    first = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("__all"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    state = stored(first.select(*group, "__lo", "__hi", F.explode(wanted).alias("w")).select(*group, "w.name", "w.rank", "__lo", "__hi"), "ranks")
    found: list[DataFrame] = []
    while True:  # every pass parts the least value from the largest, so this ends
        found.append(stored(state.filter(F.col("__lo") == F.col("__hi")).select(*group, "name", F.col("__lo").alias("__v")), "ranks-found"))
        open_ = state.filter(F.col("__lo") < F.col("__hi"))
        if open_.isEmpty():
            break
        new = stored(_narrowed(rows, open_, group, bins), "ranks")
        forget(state)
        state = new
    forget(state)
    every = reduce(DataFrame.unionByName, found)
    out = stored(every.groupBy(*group).agg(*[F.max(F.when(F.col("name") == n, F.col("__v"))).alias(n) for n in names]), "order-statistics")
    forget(*found)
    return out


def _narrowed(rows: DataFrame, state: DataFrame, group: Sequence[str], bins: int) -> DataFrame:
    """``state`` with the ends of the bin that each rank falls into, and its rank within it."""
    keys = [*group, "name"]
    # Groups may be null: they meet as equals.
    same = [F.col(f"s.{g}").eqNullSafe(F.col(f"r.{g}")) for g in group]
    within = (F.col("r.__v") >= F.col("s.__lo")) & (F.col("r.__v") <= F.col("s.__hi"))
    meet = reduce(lambda a, b: a & b, [*same, within])
    # Halves, so that the span of the largest doubles is finite; rounding keeps the order.
    part = (F.col("r.__v") / 2 - F.col("s.__lo") / 2) / (F.col("s.__hi") / 2 - F.col("s.__lo") / 2)
    at = F.least(F.floor(part * lit(bins)).cast("int"), F.lit(bins - 1))
    both = rows.alias("r").join(state.alias("s"), meet)
    counted = both.select(*[F.col(f"s.{k}").alias(k) for k in keys], F.col("s.rank").alias("rank"), at.alias("bin"), F.col("r.__v").alias("v"))
    counted = counted.groupBy(*keys, "rank", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("__lo"), F.max("v").alias("__hi"))
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("bin"))
    hit = counted.withColumn("upto", upto).filter((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank")))
    return hit.select(*keys, (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rank"), "__lo", "__hi")
