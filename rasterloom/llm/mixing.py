"""Mixing sources to target weights by a time-varying curriculum.

Every source has a weight and a schedule: how its share of the stream changes
with training time t in [0, 1].  The demand of a source up to t is its target
times the integral of its schedule up to t, and a document whose words lie at
offset c of its source's own (hash-shuffled) word axis is trained at the t for
which that demand reaches c.  So the whole plan is: targets by water-filling,
one offset per document, one inverse of a piecewise quadratic, one range sort by
position.  Only DataFrame functions run.

Targets: sources in code-point order (null last) weigh ``weights`` in rotation
and share ``share`` of all words; no target exceeds ``cap`` times its source's
words, and what a capped source leaves is dealt again by weight until no target
is above.  That fixed point is ``least(cap * size, level * weight)`` with one
``level``; sorted by ``cap * size / weight`` the capped sources come first, so
the level follows from running sums.

Offsets: documents of a source stand in the order of md5(doc_id).  A running
sum over a hot source must not meet in one task, so it is taken within hash
buckets (the digest's first digits) and shifted by the sums of the earlier
buckets.

Defined cases: a null text has no words; documents without words are never
taken; repeated rows stand next to each other and are laid out one by one; a
null source is a source of its own, after all others; the copy in which a target
is reached is taken in part (``taken`` counts its words up to the target);
positions of 1 and beyond lie past the end of training; an empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import stage

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
#: Of each weight in rotation: knots (t, relative weight), straight in between.
#: Heavy sources lead and fade out, light ones grow.
SCHEDULES = (
    ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
)
#: Hex digits of a source's hash buckets: 4,096 of them.
BUCKET_DIGITS = 3
#: A word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _integral(knots: Sequence[tuple[float, float]]) -> list[tuple[float, float, float, float, float]]:
    """Of each piece: t0, t1, share of the whole before it, normed weights at t0 and t1."""
    if len(knots) < 2 or knots[0][0] != 0 or knots[-1][0] != 1 or any(w <= 0 for _, w in knots) or any(a[0] >= b[0] for a, b in zip(knots, knots[1:], strict=False)):
        raise ValueError("knots go from t = 0 to t = 1, rising, with positive weights")
    whole = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))
    out, before = [], 0.0
    for (t0, a), (t1, b) in zip(knots, knots[1:], strict=False):
        out.append((t0, t1, before, a / whole, b / whole))
        before += (t1 - t0) * (a + b) / 2 / whole
    return out


def invert_demand(x: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The t at which a share ``x`` of the target has been asked for; beyond 1, x itself."""
    pieces = _integral(knots)
    out = None
    for i, (t0, t1, before, a, b) in enumerate(pieces):
        slope = (b - a) / (t1 - t0)
        rest = x - F.lit(before)
        # a*s + slope*s*s/2 = rest, in the form that keeps its digits for small slopes
        root = F.sqrt(F.greatest(F.lit(0.0), F.lit(a * a) + F.lit(2 * slope) * rest))
        value = F.lit(t0) + F.lit(2.0) * rest / (F.lit(a) + root)
        upper = pieces[i + 1][2] if i + 1 < len(pieces) else 1.0
        out = F.when(x < upper, value) if out is None else out.when(x < upper, value)
    return out.otherwise(x)


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Columns g, source_size, target and slot of each source; ``sizes`` has g, source, source_size.

    The windows here run over one row per source.
    """
    every = Window.partitionBy()
    rank = Window.orderBy(F.col("source").isNull(), F.col("source"))
    rows = sizes.withColumn("slot", (F.row_number().over(rank) - 1) % len(weights))
    rows = rows.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("slot") + 1))
    rows = rows.withColumn("most", F.lit(float(cap)) * F.col("source_size")).withColumn("total", F.sum("source_size").over(every))
    asked = F.lit(float(share)) * F.col("total")
    order = Window.orderBy(F.col("most") / F.col("w"), F.col("slot"), F.col("g"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumn("level", (asked - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(after))
    # The first source in this order that isn't capped gives the level of all; later ones give lower levels.
    rows = rows.withColumn("level", F.max(F.when(F.col("w") * F.col("level") <= F.col("most"), F.col("level"))).over(every))
    return rows.select("g", "source_size", F.coalesce(F.least(F.col("most"), F.col("level") * F.col("w")), F.col("most")).alias("target"), "slot")


def lay_out(documents: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES) -> DataFrame:
    """``documents`` with size, source_size, target, taken and the positions of its copies.

    ``cap`` is the most copies of a document.  Columns added: ``__size``,
    ``__source_size``, ``__target``, ``__taken`` and ``__copies``, an array of
    (position, words) with an entry for every copy, taken or not.
    """
    if len(schedules) != len(weights):
        raise ValueError("a schedule for every weight")
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    rows = documents.withColumns(
        {
            "__size": n_words(F.col("text")),
            "__g": F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")),
            "__digest": digest,
            "__tie": F.xxhash64("text"),
            "__bucket": F.conv(F.substring(digest, 1, BUCKET_DIGITS), 16, 10).cast("int"),
        }
    )
    # Read three times below; a row per source and bucket.
    sums = stage(rows.groupBy("__g", "__bucket").agg(F.first("source").alias("source"), F.sum("__size").alias("__n")), "mixing-sums")
    source = sums.groupBy(F.col("__g").alias("g")).agg(F.first("source").alias("source"), F.sum("__n").alias("source_size"))
    before = Window.partitionBy("__g").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sums.select("__g", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    plan = firsts.join(targets(source, weights, share, cap), F.col("__g") == F.col("g")).select(
        "__g", "__bucket", "__first", F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("slot").alias("__slot")
    )
    within = Window.partitionBy("__g", "__bucket").orderBy("__digest", "doc_id", "__size", "__tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(plan, ["__g", "__bucket"]).withColumn("__start", F.col("__first") + F.coalesce(F.sum("__size").over(within), F.lit(0)))
    most = F.floor("__target")
    copies = []
    for k in range(int(-(-cap // 1))):
        start = F.col("__start") + F.lit(k) * F.col("__source_size")
        words = F.greatest(F.lit(0), F.least(F.col("__size"), most - start))
        x = F.when(F.col("__target") > 0, start / F.col("__target")).otherwise(F.lit(1.0) + F.col("__bucket") / F.lit(float(16**BUCKET_DIGITS)))
        position = F.when(F.col("__slot") == 0, invert_demand(x, schedules[0]))
        for i, knots in enumerate(schedules[1:], 1):
            position = position.when(F.col("__slot") == i, invert_demand(x, knots))
        copies.append(F.struct(position.alias("position"), words.cast("long").alias("words")))
    return placed.withColumn("__copies", F.array(*copies)).withColumn("__taken", F.aggregate("__copies", F.lit(0).cast("long"), lambda a, c: a + c["words"]))


def mix(documents: DataFrame, **options) -> DataFrame:
    """The digest of the mix, range-sorted by the first copy's position."""
    placed = lay_out(documents.select("doc_id", "text", "source"), **options)
    return placed.select(
        "doc_id",
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        F.col("__taken").alias("taken"),
        F.round(F.col("__copies")[0]["position"], 9).alias("position"),
    ).orderBy("position", "doc_id")


def training_order(documents: DataFrame, **options) -> DataFrame:
    """The columns of ``documents``, a row for every copy taken, in training order.

    The copy in which a target is reached stays if at least half of it is taken.
    """
    columns = documents.columns
    placed = lay_out(documents, **options)
    copies = placed.withColumn("__copy", F.explode(F.filter("__copies", lambda c: (c["words"] > 0)))).filter(F.col("__copy")["words"] * 2 >= F.col("__size"))
    return copies.orderBy(F.col("__copy")["position"], "__digest").select(*columns)
