"""Importance resampling towards a target distribution, drawn by merging sorted runs.

Every document and every text of the target is a bag of hashed word runs.  A
bucket's gain is the logarithm of how much commoner it is in the target; a
document's weight is the sum of its buckets' gains, and the draw without
replacement takes the highest sums of weight and Gumbel noise (which is a draw
in proportion to the weights' exponentials, one document after another).

1. *Buckets.*  Texts are cut once; a document's buckets are written as an array
   of 16-bit (or 32-bit) numbers, which both later passes read.
2. *Gains.*  Each task adds its documents up in one array of ``buckets``
   counters; the arrays are summed by bucket.  A gain table has ``buckets``
   entries however many documents there are.
3. *Scores.*  A document's weight is the sum of the gains at its buckets, by array
   lookup.  Eligible rows are sorted within their partition and written: each
   partition is a run.  A row's place (partition, position) ends all ties.
4. *Draw.*  Every SAMPLE_STEP-th entry of every run is sorted, and every so many
   of them give the borders of ranges.  Counts by range tell at which range the draw
   ends.  A task merges the pieces of all runs that lie in one range by a
   tournament tree; ranks continue from the counts of the ranges before it, and it
   stops at the exact number of draws.  Ranges beyond never leave their runs.

A range holds ``RANGE_ROWS`` entries, more only where there would be more than
``MAX_RANGES`` of them, and at most SAMPLE_STEP more for every run.  Equal scores, and
rows equal in everything, are split between ranges like others, since places differ.

Defined cases: a null or wordless text has no features, weight 0, and isn't
eligible; a null doc_id draws noise like the text ``null`` and comes last among equal
scores; of rows equal in score and doc_id the earlier place ranks first (which of
them that is can't be seen in the result); an empty corpus or target counts 0
everywhere; fewer eligible documents than give one draw give none; columns other
than doc_id and text aren't read, so their names can't clash.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import drop, slices, stage, tidy

SAMPLE_STEP = 64
RANGE_ROWS = 4096
MAX_RANGES = 16384
ROWS, BYTES = 1024, 8 << 20

_UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Bytes of words: digits, lower-case letters and everything beyond ASCII.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


@dataclass(frozen=True)
class Spec:
    """Runs of 1 to ``longest`` words, ``buckets`` of them, ``percent`` of the documents of at least ``least`` words."""

    longest: int = 1
    buckets: int = 10_000
    least: int = 20
    percent: int = 10
    seed: int = 2024


def words(raw: bytes) -> list[bytes]:
    """Words of a text's UTF-8 bytes: only A to Z are lower-cased."""
    return _WORD.findall(raw.translate(_UPPER))


def features(tokens: list[bytes], spec: Spec) -> np.ndarray:
    """The buckets of all runs of 1 to ``longest`` words, repeats counted."""
    out = [zlib.crc32(w) for w in tokens]
    for n in range(2, spec.longest + 1):
        out += [zlib.crc32(b" ".join(tokens[i : i + n])) for i in range(len(tokens) - n + 1)]
    return np.array(out, np.uint32) % np.uint32(spec.buckets)


def _kind(spec: Spec) -> type:
    return np.uint16 if spec.buckets <= 1 << 16 else np.uint32


def cut(table: DataFrame, key: str | None, spec: Spec) -> DataFrame:
    """doc_id, words, n_features and the array of buckets of every row."""
    kind = _kind(spec)
    fields, names = [pa.int64(), pa.int64(), pa.int64(), pa.binary()], ["doc_id", "words", "n_features", "buckets"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, ROWS, BYTES):
                rows = []
                for raw in batch.column("text").cast(pa.binary()):
                    tokens = words(raw.as_py() or b"")
                    found = features(tokens, spec)
                    rows.append((len(tokens), len(found), found.astype(kind).tobytes()))
                columns = list(zip(*rows, strict=True)) if rows else [(), (), ()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, fields[1:], strict=True)]], names)

    doc_id = F.col(key).cast("long") if key else F.lit(None).cast("long")
    return table.select(doc_id.alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(work), "doc_id long, words long, n_features long, buckets binary")


def counts(cut_rows: DataFrame, spec: Spec) -> np.ndarray:
    """Features by bucket over all rows: one array a task, added up by bucket."""
    kind, n = _kind(spec), spec.buckets

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for batch in batches:
            for raw in batch.column("buckets"):
                total += np.bincount(np.frombuffer(raw.as_py(), kind), minlength=n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    out = np.zeros(n, np.int64)
    for row in cut_rows.select("buckets").mapInArrow(work, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of every bucket."""
    n = len(source)
    s_all, t_all = float(int(source.sum()) + n), float(int(target.sum()) + n)
    return np.array([math.floor(1000.0 * math.log((float(t) + 1.0) * s_all / ((float(s) + 1.0) * t_all))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(seed: int, doc_id: int | None) -> int:
    """floor(1000 Gumbel) of a document."""
    h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000.0 * math.log(-math.log((h + 0.5) / 4294967296.0)))


def score(cut_rows: DataFrame, gain: np.ndarray, spec: Spec) -> DataFrame:
    """doc_id, n_features, weight, score and eligible of every cut row."""
    kind = _kind(spec)
    names = ["doc_id", "n_features", "weight", "score", "eligible"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            weight = np.array([int(gain[np.frombuffer(x.as_py(), kind)].sum()) for x in batch.column("buckets")], np.int64)
            total = weight + np.array([noise(spec.seed, d) for d in ids], np.int64)
            eligible = np.asarray(batch.column("words")) >= spec.least
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_features"), pa.array(weight), pa.array(total), pa.array(eligible)], names)

    return cut_rows.mapInArrow(tidy(work), "doc_id long, n_features long, weight long, score long, eligible boolean")


_RUN_BITS = 33  # of a place, as monotonically_increasing_id gives them: partition, then position


def _order() -> list[Column]:
    return [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]


def runs(scored: DataFrame) -> DataFrame:
    """The staged runs: eligible rows sorted within each partition, with their place."""
    return stage(scored.sortWithinPartitions(F.col("eligible").desc(), *_order()).withColumn("place", F.monotonically_increasing_id()), "importance-runs")


Key = tuple[int, bool, int, int]


def _keys(batch: pa.RecordBatch) -> list[Key]:
    """What rows are ordered by: the score down, the id up with null last, the place."""
    columns = (batch.column(c).to_pylist() for c in ("score", "doc_id", "place"))
    return [(-s, d is None, 0 if d is None else d, p) for s, d, p in zip(*columns, strict=True)]


def borders(eligible: DataFrame, rows_per_range: int) -> list[Key]:
    """The first keys of all ranges but the first."""
    every = max(1, rows_per_range // SAMPLE_STEP)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            at = np.arange(-seen % every, batch.num_rows, every)
            seen += batch.num_rows
            yield batch.take(pa.array(at))

    schema = "score long, doc_id long, place long"
    sample = eligible.filter(F.col("place") % SAMPLE_STEP == SAMPLE_STEP - 1).select("score", "doc_id", "place")
    chosen = sample.orderBy(*_order(), "place").mapInArrow(work, schema).toArrow()
    return sorted(key for batch in chosen.to_batches() for key in _keys(batch))


def ranged(eligible: DataFrame, cuts: list[Key]) -> DataFrame:
    """``eligible`` with the range of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [bisect.bisect_right(cuts, k) for k in _keys(batch)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32())], [*batch.schema.names, "range"])

    return eligible.select("doc_id", "n_features", "weight", "score", "place").mapInArrow(work, "doc_id long, n_features long, weight long, score long, place long, range int")


class Tournament:
    """A tree of losers over sorted lists: the winner is the least head, and only its path is played again."""

    def __init__(self, lists: list[list[Key]]) -> None:
        self.lists, self.at = lists, [0] * len(lists)
        self.size = 1 << max(0, len(lists) - 1).bit_length()
        self.losers = [-1] * self.size
        winners = [-1] * self.size + [i if i < len(lists) and lists[i] else -1 for i in range(self.size)]
        for node in range(self.size - 1, 0, -1):
            winners[node], self.losers[node] = self._play(winners[2 * node], winners[2 * node + 1])
        self.winner = winners[1]

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """The winner and the loser of two lists; -1 is a list at its end."""
        if b < 0 or (a >= 0 and self.lists[a][self.at[a]] <= self.lists[b][self.at[b]]):
            return a, b
        return b, a

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(list, position) of all entries, in order."""
        while self.winner >= 0:
            i = self.winner
            yield i, self.at[i]
            self.at[i] += 1
            now, node = (i if self.at[i] < len(self.lists[i]) else -1), (self.size + i) >> 1
            while node:
                now, self.losers[node] = self._play(now, self.losers[node])
                node >>= 1
            self.winner = now


def _merged(part: pa.Table, before: int, most: int) -> pa.Table:
    """A range's rows with their ranks: its runs lie one after another, each in order; ``before`` rows rank before it, ``most`` are drawn."""
    keys = [k for batch in part.to_batches() for k in _keys(batch)]
    run = np.asarray(part.column("place")) >> _RUN_BITS
    first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])).tolist()
    rank: list[int | None] = [None] * len(keys)
    tree = Tournament([keys[a:b] for a, b in zip(first, [*first[1:], len(keys)], strict=True)])
    for r, (i, j) in enumerate(tree, before + 1):
        if r > most:
            break
        rank[first[i] + j] = r
    return part.select(["doc_id", "n_features", "weight", "score"]).append_column("rank", pa.array(rank, pa.int64()))


def draw(staged_runs: DataFrame, spec: Spec) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row; null for those that aren't drawn."""
    eligible = staged_runs.filter("eligible")
    n = eligible.count()
    most = spec.percent * n // 100
    none = F.lit(None).cast("long").alias("rank")
    plain = ["doc_id", "n_features", "weight", "score"]
    if most == 0:
        return staged_runs.select(*plain, none)
    cuts = borders(eligible, max(RANGE_ROWS, -(-n // MAX_RANGES)))
    rows = ranged(eligible, cuts)
    sizes = {r["range"]: r["count"] for r in rows.groupBy("range").count().toLocalIterator()}
    before: dict[int, int] = {}
    reached = 0
    for k in sorted(sizes):
        if reached >= most:
            break
        before[k], reached = reached, reached + sizes[k]
    last = max(before)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                part = pa.Table.from_batches(held)
                yield from _merged(part, before[part.column("range")[0].as_py()], most).to_batches()
                held.clear()

        for batch in batches:
            k = np.asarray(batch.column("range"))
            first = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(first, first[1:], strict=False):
                if held and held[0].column("range")[0].as_py() != int(k[a]):
                    yield from done()
                held.append(batch.slice(a, b - a))
        yield from done()

    top = rows.filter(F.col("range") <= last).repartition("range").sortWithinPartitions("range", "place")
    drawn = top.mapInArrow(tidy(work), "doc_id long, n_features long, weight long, score long, rank long")
    beyond = rows.filter(F.col("range") > last).select(*plain, none)
    return drawn.unionByName(beyond).unionByName(staged_runs.filter("not eligible").select(*plain, none))


def resample(documents: DataFrame, target: DataFrame, spec: Spec | None = None) -> DataFrame:
    """doc_id, n_features, weight, score and rank (of those drawn) of every document."""
    spec = spec or Spec()
    rows = stage(cut(documents, "doc_id", spec), "importance-buckets")
    gain = gains(counts(rows, spec), counts(cut(target, None, spec), spec))
    sorted_runs = runs(score(rows, gain, spec))
    drop(rows)
    return draw(sorted_runs, spec)
