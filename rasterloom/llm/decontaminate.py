"""Benchmark decontamination with suffix arrays of the training text.

Every task builds suffix arrays over the words of its shard of documents, up to a
million words (and 1,024 documents) at a time, and binary-searches every suffix of every benchmark item
in them: first for the window that counts as contamination (ten words, or the
whole of a shorter item), then word by word further while anything matches, which
gives the longest verbatim match and its place: for every document (the longest run of
an item's words in it that holds a window) and, by one aggregation of all shards, for
every item suffix.  Documents that are hit are removed where they are read, without a
shuffle.

The array holds only suffixes whose first word occurs in the benchmark: no other
can match.  Words are numbered by the benchmark's vocabulary (0: any other word),
and no comparison goes past a 0 or a document's end.  Suffixes are ordered by
their first four words and then by prefix doubling within the ties, up to the
longest item.

The benchmark is a stated query set: it is sent in blocks of ``BLOCK_WORDS`` words, one
at a time, so what the driver holds and broadcasts stays bounded however long it grows; with more than one
block the hit ranges of a document are united by a join on (doc_id, text hash).

Defined cases: words are runs of ASCII letters (lower-cased), digits and all
non-ASCII characters; a null or wordless text has no words and is never hit; an
item without words matches nothing; a null item_id is the empty string; equal items are
hit together; without a hit ``longest`` is 0 and ``longest_at`` -1, of several longest
matches the first place counts; repeated documents are judged one by one; an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import TEXT_ROWS, drop, slices, stage, tidy

WINDOW = 10
#: Benchmark words that are sent to the tasks at once: some 44 bytes each, as their arrays and vocabulary take.
BLOCK_WORDS = 1 << 20
#: Words of one suffix array, at most but for a longer document, and the bytes of text that are cut at once (TEXT_ROWS documents end it too).
ARRAY_WORDS, ARRAY_BYTES = 1 << 20, 8 << 20

# Word bytes keep their (lower-cased) value, all others become a space.
_TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | str | None) -> list[bytes]:
    if text is None:
        return []
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    return raw.translate(_TABLE).split()


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Positions with a known first word, ordered by their first ``depth`` words (0 ends a suffix)."""
    n = len(ids)
    start = np.flatnonzero(ids)
    if not len(start):
        return start
    padded = np.concatenate([ids, np.zeros(4, ids.dtype)]).astype(np.int64)
    bits = int(ids.max()).bit_length()
    step = max(1, min(4, 62 // bits))
    key, alive = np.zeros(len(start), np.int64), np.ones(len(start), bool)
    for k in range(step):
        word = padded[start + k]
        alive &= word > 0
        key = (key << bits) | np.where(alive, word, 0)
    order = np.argsort(key, kind="stable")
    array, key = start[order], key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.zeros(n + depth + 1, np.int64)  # 0: no suffix starts here
    group = np.maximum.accumulate(np.where(new, np.arange(len(array)), 0))
    rank[array] = group + 1
    reach = step
    while reach < depth:
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(array)))
        tied = np.flatnonzero(np.repeat(sizes > 1, sizes))
        if not len(tied):
            break
        sub = array[tied]
        pair = rank[sub] * (n + 2) + rank[np.minimum(sub + reach, n)]
        order = np.argsort(pair, kind="stable")
        array[tied], pair = sub[order], pair[order]
        new[tied] = np.concatenate([[True], pair[1:] != pair[:-1]])
        group = np.maximum.accumulate(np.where(new, np.arange(len(array)), 0))
        rank[array] = group + 1
        reach *= 2
    return array


@dataclass(frozen=True)
class Benchmark:
    """A block of items, with every suffix that a search starts from."""

    items: tuple[str, ...]
    words: dict[bytes, int]
    ids: np.ndarray  # all items' words, each item closed by a 0
    starts: np.ndarray  # suffixes, by position in ids
    item: np.ndarray  # the item of each suffix
    offset: np.ndarray  # its first word within the item
    length: np.ndarray  # words to the item's end
    window: np.ndarray  # words that must match to count, 0: this suffix starts no window

    @staticmethod
    def of(items: list[tuple[str, bytes | str | None]], window: int = WINDOW) -> Benchmark:
        words: dict[bytes, int] = {}
        ids, starts, item, offset, length, needed = [], [], [], [], [], []
        for k, (_, text) in enumerate(items):
            own = [words.setdefault(w, len(words) + 1) for w in words_of(text)]
            for j in range(len(own)):
                starts.append(len(ids) + j)
                item.append(k)
                offset.append(j)
                length.append(len(own) - j)
                needed.append(window if len(own) - j >= window else len(own) if j == 0 else 0)
            ids += [*own, 0]
        as_array = lambda x, t=np.int64: np.array(x, t)
        return Benchmark(tuple(i for i, _ in items), words, as_array([*ids, 0], np.int32), as_array(starts), as_array(item), as_array(offset), as_array(length), as_array(needed))

    @property
    def depth(self) -> int:
        return int(self.length.max(initial=0))


def _bound(ids: np.ndarray, array: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: np.ndarray | int, word: np.ndarray, upper: bool) -> np.ndarray:
    """Binary search in each [lo, hi) for where the k-th words reach (or pass) ``word``."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) // 2
        here = ids[np.minimum(array[np.minimum(mid, len(array) - 1)] + k, len(ids) - 1)]
        right = ((here <= word) if upper else (here < word)) & open_
        lo = np.where(right, mid + 1, lo)
        hi = np.where(open_ & ~right, mid, hi)


def search(ids: np.ndarray, array: np.ndarray, bench: Benchmark) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every item suffix: [lo, hi) of its window's occurrences, longest match in words, a place of it.

    And for every word of the text the most words of an item that match from there, if they hold a window.
    """
    n = len(bench.starts)
    lo, hi = np.zeros(n, np.int64), np.full(n, len(array), np.int64)
    found_lo, found_hi = np.zeros(n, np.int64), np.zeros(n, np.int64)
    longest, place = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    reach = np.zeros(len(ids), np.int64)
    active = np.arange(n) if len(array) else np.zeros(0, np.int64)
    k = 0
    while len(active):
        word = bench.ids[bench.starts[active] + k]
        a = _bound(ids, array, lo[active], hi[active], k, word, False)
        b = _bound(ids, array, a, hi[active], k, word, True)
        kept = (a < b) & (word > 0)
        active, a, b = active[kept], a[kept], b[kept]
        lo[active], hi[active] = a, b
        k += 1
        longest[active], place[active] = k, array[a]
        whole = active[bench.window[active] == k]
        found_lo[whole], found_hi[whole] = lo[whole], hi[whole]
        counts = active[(bench.window[active] > 0) & (bench.window[active] <= k)]
        for a, b in set(zip(lo[counts].tolist(), hi[counts].tolist(), strict=True)):
            reach[array[a:b]] = k  # k rises, so this is the most
        active = active[bench.length[active] > k]
    return found_lo, found_hi, longest, place, reach


@dataclass
class Shard:
    """A suffix array's worth of documents and what the benchmark hits in them."""

    n_words: np.ndarray
    first: np.ndarray  # first word position of each document
    covered: np.ndarray  # per word: inside an occurrence
    pairs: np.ndarray  # distinct (document, item) rows
    longest: np.ndarray
    place: np.ndarray
    reach: np.ndarray  # per word: the most words of an item that match from there

    @staticmethod
    def of(documents: list[list[bytes]], bench: Benchmark) -> Shard:
        get = bench.words.get
        n_words = np.array([len(d) for d in documents], np.int64)
        first = np.concatenate([[0], np.cumsum(n_words + 1)])[:-1].astype(np.int64)
        ids = np.zeros(int((n_words + 1).sum()) + 1, np.int32)
        for at, words in zip(first.tolist(), documents, strict=True):
            if words:
                ids[at : at + len(words)] = np.fromiter(map(get, words, repeat(0)), np.int32, len(words))
        array = suffix_array(ids, bench.depth)
        lo, hi, longest, place, reach = search(ids, array, bench)
        hit = np.flatnonzero(hi > lo)
        edges = np.zeros(len(ids) + 1, np.int64)
        pairs = []
        marked: set[tuple[int, int, int]] = set()
        for s in hit.tolist():
            at = array[lo[s] : hi[s]]
            span = (int(lo[s]), int(hi[s]), int(bench.window[s]))
            if span not in marked:  # equal windows mark the same words
                marked.add(span)
                np.add.at(edges, at, 1)
                np.add.at(edges, at + bench.window[s], -1)
            docs = np.unique(np.searchsorted(first, at, "right") - 1)
            pairs.append(np.stack([docs, np.full(len(docs), bench.item[s])], 1))
        covered = np.cumsum(edges)[: len(ids)] > 0
        distinct = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
        return Shard(n_words, first, covered, distinct, longest, place, reach)

    def hits(self) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(self.covered)])
        return total[self.first + self.n_words] - total[self.first]

    def run(self, d: int) -> tuple[int, int]:
        """The most words of an item that a document has in a row, and the first place of that."""
        own = self.reach[self.first[d] : self.first[d] + self.n_words[d]]
        at = int(own.argmax())
        return int(own[at]), at

    def spans(self, d: int) -> list[list[int]]:
        own = np.concatenate([[0], self.covered[self.first[d] : self.first[d] + self.n_words[d]].astype(np.int8), [0]])
        edge = np.flatnonzero(np.diff(own))
        return edge.reshape(-1, 2).tolist()


def _shards(batches: Iterator[pa.RecordBatch], bench: Benchmark) -> Iterator[tuple[pa.RecordBatch, Shard]]:
    """Batches cut to about ARRAY_WORDS words (and TEXT_ROWS rows), with their arrays searched."""
    for batch in (piece for whole in batches for piece in slices(whole, TEXT_ROWS, ARRAY_BYTES)):
        texts, at, begin, words = batch.column("text").cast(pa.binary()), 0, 0, 0
        held: list[list[bytes]] = []
        for at in range(batch.num_rows):
            own = words_of(texts[at].as_py())
            held.append(own)
            words += len(own)
            if words >= ARRAY_WORDS:
                yield batch.slice(begin, len(held)), Shard.of(held, bench)
                begin, words, held = at + 1, 0, []
        if held:
            yield batch.slice(begin, len(held)), Shard.of(held, bench)


def blocks(benchmark: DataFrame, window: int = WINDOW) -> Iterator[Benchmark]:
    """The benchmark in blocks of BLOCK_WORDS words, one at a time; one item is never cut. At least one, if empty."""
    held: list[tuple[str, bytes | None]] = []
    size, given = 0, False
    for row in benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("binary").alias("text")).orderBy("item_id", "text").toLocalIterator():
        text = bytes(row["text"]) if row["text"] is not None else None
        more = len(words_of(text))
        if held and size + more > BLOCK_WORDS:
            yield Benchmark.of(held, window)
            held, size, given = [], 0, True
        held.append((row["item_id"] or "", text))
        size += more
    if held or not given:
        yield Benchmark.of(held, window)


_MATCHES = "n_words long, n_hit long, longest long, longest_at long, spans array<array<long>>, items array<string>"


def _annotate(bench: Benchmark, keys: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, shard in _shards(batches, bench):
            hits = shard.hits()
            items: list[list[str]] = [[] for _ in hits]
            for d, i in shard.pairs.tolist():
                items[d].append(bench.items[i])
            spans = [shard.spans(d) if hits[d] else [] for d in range(len(hits))]
            runs = [shard.run(d) if hits[d] else (0, -1) for d in range(len(hits))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keys), pa.array(shard.n_words), pa.array(hits), *(pa.array([r[i] for r in runs], pa.int64()) for i in (0, 1)), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array([sorted(set(x)) for x in items], pa.list_(pa.string()))],
                names=[*keys, "n_words", "n_hit", "longest", "longest_at", "spans", "items"],
            )

    return run


def annotate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, longest and longest_at (the longest verbatim match with a window, and its first word), spans (word ranges that are hit) and items of every document."""
    rows = documents.select("doc_id", "text")
    parts = blocks(benchmark, window)
    kind = dict(rows.dtypes)["doc_id"]
    first, second = next(parts), next(parts, None)
    if second is None:
        return stage(rows.mapInArrow(tidy(_annotate(first, ["doc_id"])), f"doc_id {kind}, {_MATCHES}"), "decontaminate", rows=TEXT_ROWS)
    several = itertools.chain([first, second], parts)
    del first, second
    keyed = rows.withColumn("h", F.xxhash64("text"))
    hit = None
    for b in several:  # one pass each, staged, so the plan doesn't grow with the benchmark
        found = stage(keyed.mapInArrow(tidy(_annotate(b, ["doc_id", "h"])), f"doc_id {kind}, h long, {_MATCHES}").filter("n_hit > 0").drop("n_words"), "decontaminate-block", rows=TEXT_ROWS)
        hit = found if hit is None else hit.unionByName(found)
    # Equal rows are found once for each copy in each block; a copy is enough.
    hit = hit.withColumn("first", F.struct("longest", (-F.col("longest_at")).alias("at")))
    united = hit.groupBy(F.col("doc_id").alias("__d"), F.col("h").alias("__h")).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("spans")))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.max("first").alias("first")
    )
    join = lambda lists, s: F.when((F.size(lists) > 0) & (F.element_at(lists, -1)[1] >= s[0]), F.concat(F.slice(lists, 1, F.size(lists) - 1), F.array(F.array(F.element_at(lists, -1)[0], F.greatest(F.element_at(lists, -1)[1], s[1]))))).otherwise(F.concat(lists, F.array(s)))
    united = united.withColumn("spans", F.aggregate("spans", F.array().cast("array<array<long>>"), join))
    united = united.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0]))
    empty = Benchmark.of([], window)
    base = stage(keyed.mapInArrow(tidy(_annotate(empty, ["doc_id", "h"])), f"doc_id {kind}, h long, {_MATCHES}").select("doc_id", "h", "n_words"), "decontaminate-words", rows=TEXT_ROWS)
    return base.join(united, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("h") == F.col("__h")), "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("first.longest", F.lit(0).cast("long")).alias("longest"), F.coalesce(-F.col("first.at"), F.lit(-1).cast("long")).alias("longest_at"), F.coalesce("spans", F.array().cast("array<array<long>>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


def digest(annotated: DataFrame) -> DataFrame:
    return annotated.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "longest", "longest_at"
    )


def _longest(bench: Benchmark) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, shard in _shards(batches, bench):
            at = np.flatnonzero(shard.longest)
            doc = np.searchsorted(shard.first, shard.place[at], "right") - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([bench.items[i] for i in bench.item[at]], pa.string()), pa.array(bench.offset[at]), pa.array(shard.longest[at]), batch.column("doc_id").take(pa.array(doc)), pa.array(shard.place[at] - shard.first[doc])],
                names=["item_id", "item_word", "words", "doc_id", "doc_word"],
            )

    return run


def longest_matches(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """For every item suffix that occurs at all: its longest verbatim match and one place of it."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for bench in blocks(benchmark):
        part = rows.mapInArrow(tidy(_longest(bench)), "item_id string, item_word long, words long, doc_id long, doc_word long")
        out = part if out is None else out.unionByName(part)
    best = out.groupBy("item_id", "item_word").agg(F.max(F.struct("words", (-F.col("doc_id")).alias("d"), (-F.col("doc_word")).alias("w"))).alias("b"))
    return best.select("item_id", "item_word", F.col("b.words").alias("words"), (-F.col("b.d")).alias("doc_id"), (-F.col("b.w")).alias("doc_word"))


def _clean(bench: Benchmark) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, shard in _shards(batches, bench):
            yield batch.filter(pa.array(shard.hits() == 0))

    return run


def remove(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that no window of the benchmark occurs in, all columns kept.

    One pass per block of the benchmark: a document that any block hits is gone.
    """
    out, before = documents, None
    for n, bench in enumerate(blocks(benchmark, window)):
        if n:  # what is left after a block is written, so the plan holds one block
            left = stage(out, "decontaminate-left")
            if before is not None:
                drop(before)
            out = before = left
        out = out.mapInArrow(tidy(_clean(bench)), documents.schema)
    return out


def items_digest(items: list[str]) -> str:
    """What ``digest`` gives for a list of items; for tests."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
