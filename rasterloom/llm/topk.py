"""Exact top-k inner-product search by a three-phase uniform threshold.

A vector's score against a query is the sum of ``m`` lists: the partial inner
products over ``m`` blocks of dimensions.  Every executor task is a node that
holds a shard of the vectors, and so a shard of each list.

1. *Gather.*  Each node takes the best ``k`` entries of each of its lists, looks
   up their other lists, and sends the exact scores of the best ``k`` of them.
   The k-th best of all that was sent is a safe cutoff: k real rows reach it.
2. *Broadcast and collect.*  With a cutoff T a row can only matter if one of its
   ``m`` partial scores is at least T / m (else their sum is below T).  Each node
   goes through its lists one by one and collects the entries that can still get
   there: what the lists so far give, plus the most that the others can give
   (the products of the two vectors' lengths in them), must reach T, and by the
   last list some entry must have reached T / m.  Entries that can't are left
   before their further lists are scored.
3. *Resolve.*  What was collected has all its lists summed exactly; rows at or
   above T are ranked by (score down, id up) and merged.  A node sends its best
   ``k`` of them, which is all that a global top k can take from one node.

The queries are a stated set, taken in blocks of ``QUERY_BLOCK`` rows: what is
broadcast is bounded by that block however long the table is, and every block's
result is staged, so the plan stays the same size.

Defined cases: a row whose vec_id is null, or whose vector is null or holds a
null, NaN or infinite component, takes no part; vectors of different lengths never meet (a candidate of another
length than the query is no candidate of it); rows that share a query's id are
that query's own rows and no candidates of it, and of several query rows with
one id the first in vector order asks; ties go to the smaller id and repeated
candidate rows count one by one; an empty table, or one without queries, gives
an empty result.  Vectors of any finite size are ranked by their exact whole-number products
(Python integers where doubles don't hold them); a score beyond 38 digits counts as one of 38
nines, and ``as_long`` ends at a long's ends, so ranks may differ where such scores look equal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import stage, staged_path, tidy

#: Queries that are broadcast at once: 4,096 x 64 dimensions are 2 MB.
QUERY_BLOCK = 4096
#: Dimension blocks, the lists of the threshold.
LISTS = 4
#: Rows of a node that are scored at once, at most, and the pairs with queries that this makes at most.
ROW_BLOCK, PAIR_BLOCK = 2048, 1 << 20
#: Share of a block's pairs below which the collected ones are scored one by one, not as a product of matrices.
SPARSE = 0.02
#: Above this, products of components no longer sum exactly in a double.
EXACT = float(2**53)
SCALE = 256.0
#: Result rows of a file.
RESULT_ROWS = 10_000

LARGEST = float(np.finfo(float).max)
#: Scores are whole numbers of 38 digits; beyond them they end there.
MOST_SCORE = 10**38 - 1

_FOUND = "query_id long, vec_id long, score decimal(38,0)"


def quantise(embedding: Column) -> Column:
    """floor(256 * x) of every component, as doubles that hold integers; beyond the largest double, that one."""

    def whole(x: Column) -> Column:
        y = F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), x.cast("double") * F.lit(SCALE)))
        # From 2 ** 53 on every double is an integer, and floor would end at a long's ends.
        return F.when(F.abs(y) < F.lit(EXACT), F.floor(y).cast("double")).otherwise(y)

    return F.transform(embedding, whole)


def _usable(column: str) -> Column:
    return F.col(column).isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def _product(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return a @ b.T
    whole = np.array([[int(x) for x in row] for row in a], dtype=object), np.array([[int(x) for x in row] for row in b], dtype=object)
    return whole[0].reshape(a.shape) @ whole[1].reshape(b.shape).T


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of rows of one length, ``most`` at a time."""
    for batch in batches:
        ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
        lists = batch.column("v")
        starts = lists.offsets.to_numpy()
        lengths, flat = np.diff(starts), lists.values.to_numpy(zero_copy_only=False)
        for d in np.unique(lengths):
            rows = np.flatnonzero(lengths == d)
            for at in range(0, len(rows), most):
                part = rows[at : at + most]
                yield ids[part], flat[starts[part][:, None] + np.arange(d)[None, :]].reshape(len(part), int(d))


class _Best:
    """The best k (score, id) of each query of one node."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.kept = k, [([], []) for _ in range(n)]

    def add(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        old_scores, old_ids = self.kept[q]
        pairs = sorted(zip((-int(x) for x in (*old_scores, *scores)), (int(x) for x in (*old_ids, *ids)), strict=True))[: self.k]
        self.kept[q] = ([-p[0] for p in pairs], [p[1] for p in pairs])

    def batches(self, query_ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows = [(int(query_ids[q]), i, s) for q, (scores, ids) in enumerate(self.kept) for s, i in zip(scores, ids, strict=True)]
        if rows:
            q, i, s = zip(*rows, strict=True)
            sent = [Decimal(max(-MOST_SCORE, min(MOST_SCORE, x))) for x in s]
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(sent, pa.decimal128(38, 0))], names=["query_id", "vec_id", "score"])


def gather(partial: list[np.ndarray], own: np.ndarray, k: int) -> np.ndarray:
    """Phase 1: which (query, row) pairs are among the ``k`` best entries of some list of the query."""
    taken = np.zeros(own.shape, bool)
    for scores in partial:
        held = np.where(own, -np.inf, scores.astype(float))
        top = np.argpartition(held, -k, axis=1)[:, -k:] if own.shape[1] > k else np.arange(own.shape[1])[None, :].repeat(len(own), 0)
        np.put_along_axis(taken, top, True, axis=1)
    return taken & ~own


def collect(queries: np.ndarray, rows: np.ndarray, cuts: np.ndarray, cutoffs: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Phases 2 and 3: query, row and score of the pairs that reach the cutoff, and how many list entries were scored.

    For vectors whose products sum exactly in doubles.
    """
    blocks = list(zip(cuts, cuts[1:], strict=False))
    length = lambda x: np.stack([np.sqrt((x[:, a:b] ** 2).sum(1)) for a, b in blocks], 1)
    ql, rl = length(queries), length(rows)
    need = cutoffs[:, None] - 1e-6 * (1.0 + np.abs(np.where(np.isfinite(cutoffs), cutoffs, 0.0)))[:, None]  # lengths are rounded
    total, most = np.zeros(own.shape), np.full(own.shape, -np.inf)
    alive, scored = ~own, 0
    for j, (a, b) in enumerate(blocks):
        part = queries[:, a:b] @ rows[:, a:b].T
        scored += part.size
        total += part
        np.maximum(most, part, out=most)
        if j + 1 < len(blocks):
            alive &= total + ql[:, j + 1 :] @ rl[:, j + 1 :].T >= need
            if alive.sum() <= SPARSE * alive.size:
                q, r = np.nonzero(alive)
                rest, best = total[q, r], most[q, r]
                for c, d in blocks[j + 1 :]:
                    part = np.einsum("ij,ij->i", queries[q, c:d], rows[r, c:d])
                    scored += len(part)
                    rest, best = rest + part, np.maximum(best, part)
                good = (best * len(blocks) >= cutoffs[q]) & (rest >= cutoffs[q])
                return q[good], r[good], rest[good], scored
    q, r = np.nonzero(alive & (most * len(blocks) >= cutoffs[:, None]) & (total >= cutoffs[:, None]))
    return q, r, total[q, r], scored


def _node(query_ids: np.ndarray, queries: np.ndarray, cutoffs: np.ndarray | None, k: int, lists: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One pass of a node: phase 1 without cutoffs, phases 2 and 3 with them."""
    d = queries.shape[1]
    cuts = np.linspace(0, d, min(lists, max(d, 1)) + 1).astype(int)
    largest = float(np.abs(queries).max(initial=0.0))
    most = max(1, min(ROW_BLOCK, PAIR_BLOCK // max(1, len(query_ids))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(len(query_ids), k)
        for ids, rows in _blocks(batches, most):
            if rows.shape[1] != d:
                continue
            # Squares as well, for the lengths.
            peak = max(largest, float(np.abs(rows).max(initial=0.0)))
            exact = peak * peak * max(d, 1) < EXACT
            own = query_ids[:, None] == ids[None, :]
            if exact and cutoffs is not None:
                q, r, total, _ = collect(queries, rows, cuts, cutoffs, own)
            else:
                partial = [_product(queries[:, a:b], rows[:, a:b], exact) for a, b in zip(cuts, cuts[1:], strict=False)]
                # Beyond doubles no entry is left out before it is summed as a whole number.
                taken = gather(partial, own, k) if cutoffs is None and exact else ~own
                q, r = np.nonzero(taken)
                total = sum(scores[q, r] for scores in partial)
                if cutoffs is not None:
                    enough = total >= cutoffs[q]
                    q, r, total = q[enough], r[enough], total[enough]
            for at in np.split(np.arange(len(q)), np.flatnonzero(np.diff(q)) + 1):
                if len(at):
                    if exact and len(at) > k:  # best of the block: score down, id up
                        at = at[np.lexsort((ids[r[at]], -total[at]))[:k]]
                    best.add(int(q[at[0]]), total[at], ids[r[at]])
        yield from best.batches(query_ids)

    return run


def _search_block(vectors: DataFrame, query_ids: np.ndarray, queries: np.ndarray, k: int, lists: int, tasks: int) -> DataFrame:
    """Top k of one block of queries of one length, staged."""
    sent = vectors.mapInArrow(tidy(_node(query_ids, queries, None, k, lists)), _FOUND)
    down = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # A row per query of the block: bounded by QUERY_BLOCK.
    found = sent.withColumn("rank", F.row_number().over(down)).filter(F.col("rank") == k).select("query_id", "score").collect()
    cutoff = {r["query_id"]: r["score"] for r in found}
    cutoffs = np.array([float(cutoff[q]) if q in cutoff else -np.inf for q in query_ids.tolist()])
    cutoffs = np.where(np.abs(cutoffs) < EXACT, cutoffs, np.nextafter(cutoffs, -np.inf))
    kept = vectors.mapInArrow(tidy(_node(query_ids, queries, cutoffs, k, lists)), _FOUND)
    best = kept.withColumn("rank", F.row_number().over(down)).filter(F.col("rank") <= k)
    return stage(best.select("query_id", "rank", "vec_id", "score"), "topk", tasks=tasks)


def search(embeddings: DataFrame, is_query: Column, k: int = 5, lists: int = LISTS) -> DataFrame:
    """query_id, rank, vec_id and score (decimal(38,0)) of the k best rows of every query."""
    usable = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & _usable("embedding"))
    vectors = usable.select("vec_id", quantise(F.col("embedding")).alias("v"))
    first = Window.partitionBy("vec_id").orderBy("v")
    asked = vectors.filter(is_query).withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")
    spark = embeddings.sparkSession
    tasks = -(-QUERY_BLOCK * k // RESULT_ROWS)
    paths = [staged_path(_search_block(vectors, query_ids, queries, k, lists, tasks)) for query_ids, queries in _query_blocks(asked)]
    schema = "query_id long, rank int, vec_id long, score decimal(38,0)"
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _query_blocks(asked: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of queries of one length; the driver holds one partition of them at a time."""
    held: dict[int, list[tuple[int, list[float]]]] = {}
    for row in asked.toLocalIterator():
        block = held.setdefault(len(row["v"]), [])
        block.append((row["vec_id"], row["v"]))
        if len(block) == QUERY_BLOCK:
            yield _packed(block)
            block.clear()
    for block in held.values():
        if block:
            yield _packed(block)


def _packed(block: list[tuple[int, list[float]]]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([x[0] for x in block], np.int64), np.array([x[1] for x in block], float).reshape(len(block), -1)


def as_long(score: Column) -> Column:
    """A score as a long; one beyond 64 bits is the long's end."""
    return F.greatest(F.lit(Decimal(-(2**63))), F.least(F.lit(Decimal(2**63 - 1)), score)).cast("long")
