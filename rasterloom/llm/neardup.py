"""Near-duplicate groups by an LSH forest over MinHash signatures.

1. *Signatures.*  One pass over the texts: the set of five-word shingles (as 64-bit
   hashes), its size, a 128-bit fingerprint of the whole set and 128 MinHash values
   of 16 bits.  Documents with equal fingerprints have equal sets; they become one
   class, represented by its smallest doc_id, before anything is compared.
2. *Forest.*  TREES sorted orders of the classes: tree t sorts by the signature
   rotated to start at its own values, so neighbours are those with the longest
   common prefix.  Rows that share a prefix form a region, and each region has its own
   depth: it is cut at MIN_DEPTH values where that leaves at most CROWD members, at the
   next value where it doesn't, and so on to DEPTH values, which always hold.  Sparse
   places thus get more candidates than DEPTH alone gives and crowded ones no more,
   whatever the size of the table.  The order is a range partitioning of all trees at
   once: a crowded region is cut over many tasks, and the cuts (also those between the
   pieces that a task looks at) are closed at depth DEPTH by their border rows.
3. *Links.*  Neighbours are confirmed on their full sets (100 * common >= 75 *
   union), and confirmed links are contracted to components.
4. *Rest.*  A region whose members lie in one component has nothing more to give.
   In every other region all pairs across components are candidates: members
   outside the region's largest component meet all members, block by block, with
   no limit on their number.  Sets of up to SMALL shingles are compared in full on
   the spot, as a product of a block's incidence matrices, so only links leave the
   task; of larger sets come counts of shingles by hash bucket, whose common minima are
   an upper bound of the intersection: pairs that the bound excludes are no links, all
   others are confirmed as in step 3.  The first FIRST_TREES trees go first, which joins
   the copies around a common original; then all trees, where components are still
   apart.  So all pairs that share a region in any tree are decided exactly, without
   ever emitting all pairs of a crowded one.
5. *Components.*  Links are contracted by large-star and small-star steps, staged
   round by round in the shared folder, until they stay the same.

A fingerprint that holds a large share of all rows is joined by broadcast (there are
at most HOT_KEYS of these), all others by a shuffle; regions likewise.

A pair of similarity s shares a region with probability 1 - (1 - s**4)**32 at least:
0.999995 at 0.75.

Defined cases: a text with fewer than five words is one shingle, its whole
sequence; a null or wordless text has an empty set and is linked with nothing (its
component is its own id); rows with one doc_id are one node, linked by what any of
them links; a row without a doc_id is its own group and kept; an empty table gives
an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import drop, join_hot, scratch, stage, tidy

SHINGLE = 5
VALUES = 128
#: A region's common prefix: at most DEPTH values, at least MIN_DEPTH, as many as leave CROWD members.
MIN_DEPTH, DEPTH, CROWD = 2, 4, 8
TREES = VALUES // DEPTH
#: Rows of a sorted partition that are looked at together.
RUN_ROWS = 1 << 18
#: Sets of up to SMALL shingles are compared in full where members of a region meet; larger ones by half of every hash.
SMALL = 512
#: A key that holds more than this part of all rows is joined by broadcast: fewer keys than that.
HOT_KEYS = 4096
#: Rows that one task writes, at least, where there are more partitions.
TASK_ROWS = 5000
#: Trees whose regions are searched before those of all trees.
FIRST_TREES = 4
#: Members of a region that meet in one task unit, at most, and the bytes of their sets that are aimed at.
MEET, MEET_BYTES = 128, 16 << 20
#: Edges that one task contracts, at most.
EDGES = 100_000
#: Rows in a Python worker's batch: texts, pairs of whole sets, members with small sets.
TEXT_ROWS, PAIR_ROWS, MEET_ROWS = 512, 128, 1024
#: Columns of an incidence matrix that are multiplied at once.
COLUMNS = 4096
#: Shingles whose MinHash products are held at once.
CHUNK = 2048
#: Up to so many candidate ids are sent to the tasks as a filter (16 MB); beyond, they are joined.
SENT_IDS = 1_000_000

_RNG = np.random.default_rng(20240229)
_XOR = _RNG.integers(0, 2**63, VALUES, dtype=np.uint64)
_MUL = _RNG.integers(0, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _K[k]
    return h ^ (h >> np.uint64(29))


def shingles(text: bytes | str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    from xxhash import xxh3_64_intdigest

    if text is None:
        return np.zeros(0, np.uint64)
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    words = raw.lower().split()  # bytes: A-Z alone are lower-cased, ASCII white space alone splits
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - SHINGLE + 1)
    total = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(h))):
        total = _mixed(total + h[k : k + n] * _K[k], k)
    if len(h) < SHINGLE:
        total = _mixed(total + np.uint64(len(h)), 4)
    return np.unique(total)


def signature(own: np.ndarray) -> np.ndarray:
    """VALUES 16-bit MinHash values as TREES packed groups of DEPTH."""
    least = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), CHUNK):
        np.minimum(least, ((own[at : at + CHUNK, None] ^ _XOR) * _MUL).min(0), out=least)
    return (_mixed(least, 0) >> np.uint64(48)).astype("<u2").view("<i8")


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        n, f1, f2 = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
        signs = np.zeros((batch.num_rows, TREES), np.int64)
        for i in range(batch.num_rows):
            own = shingles(texts[i].as_py())
            n[i] = len(own)
            if len(own):
                f1[i], f2[i] = (_mixed(own, k).sum(dtype=np.uint64).view(np.int64) for k in (1, 2))
                signs[i] = signature(own)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * TREES), pa.array(signs.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(f1), pa.array(f2), lists], names=["doc_id", "n", "f1", "f2", "sig"])


_RUN = "kind int, part int, tree int, depth int, prefix long, rid long, prev long"


def depths(tree: np.ndarray, k1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted rows: each one's depth, and whether it shares that many values with the row before.

    ``k1`` packs the first DEPTH values, the leading one in its highest bits.  Runs at either end may
    go on elsewhere, so their size isn't known: they are cut at DEPTH.
    """
    n = len(tree)
    depth, joins = np.full(n, DEPTH, np.int32), np.zeros(n, bool)
    undecided = np.ones(n, bool)
    for d in range(MIN_DEPTH, DEPTH + 1):
        prefix = k1 >> (16 * (DEPTH - d))
        same = np.concatenate([[False], (tree[1:] == tree[:-1]) & (prefix[1:] == prefix[:-1])])
        starts = np.flatnonzero(~same)
        sizes = np.diff(np.append(starts, n))
        small = sizes <= CROWD
        small[[0, -1]] = False
        here = undecided & (np.repeat(small, sizes) if d < DEPTH else True)
        depth[here], joins[here] = d, same[here]
        undecided &= ~here
    return depth, joins


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (tree, k1, rid): members of regions with their neighbour before, and the partition's border rows."""
    part = TaskContext.get().partitionId()

    def out(kind: int, tree: np.ndarray, depth: np.ndarray, k1: np.ndarray, rid: np.ndarray, prev: np.ndarray | None) -> pa.RecordBatch:
        n = len(rid)
        before = pa.nulls(n, pa.int64()) if prev is None else pa.array(prev[0], mask=prev[1])
        prefix = k1 >> (16 * (DEPTH - depth.astype(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, part, np.int32)), pa.array(tree.astype(np.int32)), pa.array(depth.astype(np.int32)), pa.array(prefix), pa.array(rid), before], names=["kind", "part", "tree", "depth", "prefix", "rid", "prev"])

    def runs() -> Iterator[tuple[np.ndarray, ...]]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= RUN_ROWS:
                yield tuple(np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("tree", "k1", "rid"))
                held = []
        if sum(b.num_rows for b in held):
            yield tuple(np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("tree", "k1", "rid"))

    full = np.array([DEPTH])
    last: tuple[int, int, int, bool] | None = None  # tree, k1, rid of the row before, and whether it was sent
    for tree, k1, rid in runs():
        depth, joins = depths(tree, k1)
        if last is None:
            yield out(1, tree[:1], full, k1[:1], rid[:1], None)
        else:
            joins[0] = tree[0] == last[0] and k1[0] == last[1]  # both rows are at an end, so at DEPTH
            if joins[0] and not last[3]:
                yield out(0, np.array([last[0]]), full, np.array([last[1]]), np.array([last[2]]), None)
        followed = np.concatenate([joins[1:], [False]])
        use = np.flatnonzero(joins | followed)
        if len(use):
            before = np.concatenate([[last[2] if last else 0], rid[:-1]])
            yield out(0, tree[use], depth[use], k1[use], rid[use], (before[use], ~joins[use]))
        last = (int(tree[-1]), int(k1[-1]), int(rid[-1]), bool(joins[-1]))
    if last is not None:
        yield out(2, np.array([last[0]]), full, np.array([last[1]]), np.array([last[2]]), None)


REGION = ["tree", "depth", "prefix"]


def forest(classes: DataFrame) -> DataFrame:
    """(tree, depth, prefix, rid, prev) of all members of regions; ``prev`` is the neighbour before, if any."""
    at = lambda j: F.element_at("sig", (F.col("tree") + j) % TREES + 1)
    rows = classes.select("rid", "sig", F.posexplode("sig").alias("tree", "k1")).select("tree", "k1", at(1).alias("k2"), at(2).alias("k3"), "rid")
    ordered = rows.repartitionByRange("tree", "k1", "k2", "k3", "rid").sortWithinPartitions("tree", "k1", "k2", "k3", "rid")
    found = stage(ordered.select("tree", "k1", "rid").mapInArrow(tidy(_scan), _RUN), "neardup-regions")
    inner = found.filter("kind = 0").select(*REGION, "rid", "prev")
    # Two rows per partition: a region cut between partitions goes on from the last row before to the first row after.
    border = Window.orderBy("part", "kind")
    edges = found.filter("kind > 0").select(
        "kind", *REGION, "rid", F.lag("kind").over(border).alias("bk"), F.lag("tree").over(border).alias("bt"), F.lag("prefix").over(border).alias("bp"), F.lag("rid").over(border).alias("br")
    )
    cut = edges.filter((F.col("kind") == 1) & (F.col("bk") == 2) & (F.col("tree") == F.col("bt")) & (F.col("prefix") == F.col("bp")))
    return inner.unionByName(cut.select(*REGION, "rid", F.col("br").alias("prev"))).unionByName(cut.select(*REGION, F.col("br").alias("rid"), F.lit(None).cast("long").alias("prev")))


def _pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def low_halves(own: np.ndarray) -> bytes:
    """The distinct low halves of a set's hashes: all of it but for the chance of two hashes with one half."""
    return np.unique(own.astype(np.uint32)).tobytes()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for i in range(batch.num_rows):
            own = shingles(texts[i].as_py())
            # A partner of a set beyond SMALL has 0.75 of its size at least.
            low = low_halves(own) if 4 * len(own) > 3 * SMALL else None
            small = own.tobytes() if len(own) <= SMALL else None
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, 1), *(pa.array([x], t) for x, t in ((len(own), pa.int64()), (own.tobytes(), pa.binary()), (small, pa.binary()), (low, pa.binary())))], names=["id", "n", "own", "small", "low"])


def full_sets(documents: DataFrame, ids: DataFrame, tasks: int) -> DataFrame:
    """The shingle sets of the documents in ``ids``: whole (own), whole if small, and by low halves if not."""
    wanted = ids.select(F.col("rid").alias("doc_id")).distinct()
    few = wanted.limit(SENT_IDS + 1).count() <= SENT_IDS
    rows = documents.select("doc_id", "text").join(F.broadcast(wanted) if few else wanted, "doc_id", "left_semi")
    return stage(rows.mapInArrow(tidy(_sets), "id long, n long, own binary, small binary, low binary"), "neardup-sets", rows=TEXT_ROWS, tasks=tasks)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sa, sb = batch.column("sa"), batch.column("sb")
        good = np.zeros(batch.num_rows, bool)
        for i in range(batch.num_rows):
            x, y = (np.frombuffer(s[i].as_buffer(), np.uint64) for s in (sa, sb))
            if 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)):
                common = len(np.intersect1d(x, y, assume_unique=True))
                good[i] = 100 * common >= 75 * (len(x) + len(y) - common)
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(good)) for c in ("a", "b")], names=["a", "b"])


def confirm(pairs: DataFrame, sets: DataFrame, tasks: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("own").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("own").alias("sb"))
    return stage(pairs.join(left, "a").join(right, "b").mapInArrow(tidy(_confirm), "a long, b long"), "neardup-links", rows=PAIR_ROWS, tasks=tasks)


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every node of ``edges`` (a, b) but the roots themselves."""
    tasks = 2 * edges.sparkSession.sparkContext.defaultParallelism
    now = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "neardup-stars", tasks=max(tasks, edges.count() // EDGES))
    state = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = state(now)
    while seen[0]:
        # Stars have no more edges than there were: tasks and files by that number, not by the session's partitions.
        few = lambda df: df.coalesce(seen[0] // EDGES + 2)  # noqa: B023, E731
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = stage(few(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()), "neardup-stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = stage(few(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()), "neardup-stars")
        drop(now)
        drop(large)
        now, before, seen = new, seen, state(new)
        if seen == before:
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("root"))


def _common(small: list[bytes], other: list[bytes], kind: type = np.uint64) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, as a product of incidence matrices."""
    sets = [np.frombuffer(x, kind) for x in (*small, *other)]
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    shared = np.bincount(column, minlength=len(values)) > 1
    at = np.cumsum(shared) - 1
    use = shared[column]
    row, column = row[use], at[column[use]]
    total = np.zeros((len(small), len(other)), np.float32)
    for begin in range(0, int(shared.sum()), COLUMNS):  # a slice of the incidence matrix at a time
        part = (column >= begin) & (column < begin + COLUMNS)
        incidence = np.zeros((len(sets), COLUMNS), np.float32)
        incidence[row[part], column[part] - begin] = 1
        total += incidence[: len(small)] @ incidence[len(small) :].T
    return total.astype(np.int64)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by unit: within a unit, every asking row against every other of another component.

    Gives (a, b, sure): links of small sets, and pairs of larger ones that are links unless halves of hashes collide.
    """

    def pairs(rows: pa.Table) -> np.ndarray:
        asks = rows.column("asks").to_numpy()
        rid, comp, n = (rows.column(c).to_numpy() for c in ("rid", "comp", "n"))
        small, low = (rows.column(c).to_pylist() for c in ("small", "low"))
        found = []
        for sure in (True, False):
            has = n <= SMALL if sure else 4 * n > 3 * SMALL
            q, c = np.flatnonzero(asks & has), np.flatnonzero(~asks & has)
            if not len(q) or not len(c):
                continue
            nq, nc = n[q][:, None], n[c][None, :]
            good = (comp[q][:, None] != comp[c][None, :]) & (4 * np.minimum(nq, nc) >= 3 * np.maximum(nq, nc))
            if not sure:
                good &= np.maximum(nq, nc) > SMALL
            if not good.any():
                continue
            if sure:
                common = _common([small[i] for i in q], [small[i] for i in c])
            else:
                # Elements with one half count once: a set's own missing ones may all be common.
                held = [np.array([len(low[i]) // 4 for i in side]) for side in (q, c)]
                common = _common([low[i] for i in q], [low[i] for i in c], np.uint32)
                common = np.minimum(common + np.minimum(nq - held[0][:, None], nc - held[1][None, :]), np.minimum(nq, nc))
            good &= 100 * common >= 75 * (nq + nc - common)
            i, j = np.nonzero(good)
            found.append(np.stack([rid[q[i]], rid[c[j]], np.full(len(i), sure)], 1))
        return np.concatenate(found) if found else np.zeros((0, 3), np.int64)

    def out(found: list[np.ndarray]) -> pa.RecordBatch:
        x = np.concatenate(found)
        distinct = np.unique(np.stack([np.minimum(x[:, 0], x[:, 1]), np.maximum(x[:, 0], x[:, 1]), x[:, 2]], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(distinct[:, 0]), pa.array(distinct[:, 1]), pa.array(distinct[:, 2] > 0)], names=["a", "b", "sure"])

    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        units = [table.column(c).to_numpy() for c in (*REGION, "i", "j")]
        cuts = np.flatnonzero(np.any([u[1:] != u[:-1] for u in units], axis=0)) + 1
        found = [pairs(table.slice(a, b - a)) for a, b in zip([0, *cuts.tolist()], cuts.tolist(), strict=False)]
        held = table.slice(int(cuts[-1]) if len(cuts) else 0)
        if found:
            yield out(found)
    if held is not None and held.num_rows:
        yield out([pairs(held)])


def open_pairs(members: DataFrame, labels: DataFrame, sets: DataFrame, tasks: int) -> DataFrame:
    """(a, b, sure): links, and pairs still to be confirmed, across the components of a region."""
    named = members.select(*REGION, "rid").distinct().join(labels, F.col("rid") == F.col("id"), "left").select(*REGION, "rid", F.coalesce("root", "rid").alias("comp"))
    named = stage(named.join(sets.select(F.col("id").alias("rid"), "n"), "rid"), "neardup-members", tasks=tasks)
    size = F.when(F.col("n") > SMALL, F.col("n") * 4).otherwise(F.col("n") * 8)
    parts = named.groupBy(*REGION, "comp").agg(F.count(F.lit(1)).alias("c"), F.sum(size).alias("bytes"))
    # Regions of two were decided by their neighbours.
    whole = parts.groupBy(*REGION).agg(F.sum("c").alias("total"), F.sum("bytes").alias("bytes"), F.max(F.struct("c", "comp")).alias("big"), F.count(F.lit(1)).alias("comps")).filter("comps > 1 and total > 2")
    # Fewer members meet at once where they are long.
    meet = F.greatest(F.lit(4.0), F.least(F.lit(float(MEET)), F.lit(float(MEET_BYTES)) * F.col("total") / (2 * F.col("bytes"))))
    blocks = lambda c: F.ceil(c / meet).cast("int")
    plan = stage(whole.select(*REGION, "total", F.col("big.comp").alias("big"), blocks(F.col("total")).alias("all_blocks"), blocks(F.col("total") - F.col("big.c")).alias("rest_blocks")), "neardup-plan", tasks=tasks)
    rows = join_hot(named, plan, REGION, F.col("total") > named.count() / HOT_KEYS).join(sets.select(F.col("id").alias("rid"), "small", "low"), "rid")
    block = lambda salt, n: F.pmod(F.xxhash64("rid", F.lit(salt)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    carried = [*REGION, "rid", "comp", "n", "small", "low"]
    asking = rows.filter("comp <> big").select(*carried, F.lit(True).alias("asks"), block(1, F.col("rest_blocks")).alias("j"), every(F.col("all_blocks")).alias("i"))
    answering = rows.select(*carried, F.lit(False).alias("asks"), block(2, F.col("all_blocks")).alias("i"), every(F.col("rest_blocks")).alias("j"))
    unit = [*REGION, "i", "j"]
    met = asking.unionByName(answering).repartition(*unit).sortWithinPartitions(*unit).mapInArrow(tidy(_meet), "a long, b long, sure boolean")
    return met.filter("a <> b").distinct()


def joined_labels(labels: DataFrame, links: DataFrame, tasks: int) -> DataFrame:
    """(id, root) after more links: the links are named by their components and contracted among these."""
    if links.isEmpty():
        return labels
    name = lambda df, c: df.join(labels.select(F.col("id").alias(c), F.col("root").alias(f"{c}_root")), c, "left").withColumn(c, F.coalesce(f"{c}_root", c)).drop(f"{c}_root")
    again = components(name(name(links, "a"), "b"))
    onward = again.select(F.col("id").alias("root"), F.col("root").alias("top"))
    moved = labels.join(onward, "root", "left").select("id", F.coalesce("top", "root").alias("root"))
    return stage(moved.unionByName(again.join(labels.select("id"), "id", "left_anti").select("id", "root")), "neardup-labels", tasks=tasks)


def group(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = rows.count()
    tasks = max(2 * documents.sparkSession.sparkContext.defaultParallelism, total // TASK_ROWS)
    signed = stage(rows.mapInArrow(tidy(_sign), "doc_id long, n long, f1 long, f2 long, sig array<long>"), "neardup-signed", rows=TEXT_ROWS, tasks=tasks)
    key = ["n", "f1", "f2"]
    known = signed.filter("n > 0 and doc_id is not null")
    classes = stage(known.groupBy(*key).agg(F.min("doc_id").alias("rid"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("c")), "neardup-classes", tasks=tasks)
    named = classes.select(*key, "rid", (F.col("c") > total / HOT_KEYS).alias("hot"))
    members = stage(join_hot(known.select("doc_id", *key), named, key, F.col("hot")).select("doc_id", "rid", "hot"), "neardup-rows", tasks=tasks)
    regions = stage(forest(classes), "neardup-forest", tasks=tasks)
    size = classes.select("rid", "n")
    near = regions.filter("prev is not null and prev <> rid").select(*_pair(F.col("rid"), F.col("prev"))).distinct()
    near = near.join(size.select(F.col("rid").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("rid").alias("b"), F.col("n").alias("nb")), "b")
    near = stage(near.filter("4 * least(na, nb) >= 3 * greatest(na, nb)").select("a", "b").distinct(), "neardup-pairs", tasks=tasks)
    sets = full_sets(rows, regions.select("rid"), tasks)
    links = confirm(near, sets, tasks)
    # Rows with one doc_id in several classes tie these together.
    repeated = members.groupBy("doc_id").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi")).filter("lo < hi").select("doc_id")
    ties = members.join(repeated, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rid").alias("b")).distinct()
    labels = components(links.unionByName(ties))
    tried = near
    for trees in (FIRST_TREES, TREES):
        met = stage(open_pairs(regions.filter(F.col("tree") < trees), labels, sets, tasks), "neardup-met", rows=MEET_ROWS, tasks=tasks)
        late = stage(met.filter(~F.col("sure")).select("a", "b").join(tried, ["a", "b"], "left_anti"), "neardup-pairs", tasks=tasks)
        labels = joined_labels(labels, stage(met.filter("sure").select("a", "b").unionByName(confirm(late, sets, tasks)), "neardup-links", tasks=tasks), tasks)
        tried = tried.unionByName(late)
    roots = labels.select(F.col("id").alias("rid"), "root")
    few = roots.join(F.broadcast(classes.filter(F.col("c") > total / HOT_KEYS).select("rid")), "rid", "left_semi")
    grouped = members.filter("hot").join(F.broadcast(few), "rid", "left").unionByName(members.filter("not hot").join(roots, "rid", "left")).select("doc_id", F.coalesce("root", "rid").alias("component_id"))
    own = grouped.groupBy(F.col("doc_id").alias("__id")).agg(F.min("component_id").alias("component_id"))
    found = signed.select("doc_id", F.col("n").alias("n_shingles"))
    # Rows without an id have no partner and stay where they are.
    joined = found.filter("doc_id is not null").join(own, F.col("doc_id") == F.col("__id"), "left").unionByName(found.filter("doc_id is null").withColumns({"__id": F.col("doc_id"), "component_id": F.col("doc_id")}))
    return joined.select(
        "doc_id",
        "n_shingles",
        F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"),
    )


def remove(documents: DataFrame) -> DataFrame:
    """One row of every group of similar texts, all columns kept.

    Rows are judged by their texts: of rows that share a doc_id, or have none, those with different texts are
    different documents here, and of rows with one text one stays. Rows without words all stay.
    """
    spark, columns = documents.sparkSession, documents.columns
    repeated = stage(documents.groupBy("doc_id").count().filter("count > 1 or doc_id is null").select("doc_id"), "neardup-repeated")
    n = repeated.limit(SENT_IDS + 1).count()
    own = F.col("doc_id").cast("long")
    if n:
        known = repeated.filter("doc_id is not null").select("doc_id", F.lit(True).alias("__again"))
        marked = documents.join(F.broadcast(known) if n <= SENT_IDS else known, "doc_id", "left").select(*columns, F.coalesce("__again", F.col("doc_id").isNull()).alias("__again"))
        # Ids of their own by what they hold; two seeds leave no likely clash with given ids or each other.
        marked = marked.withColumn("__id", F.when(F.col("__again"), F.xxhash64(F.lit("row"), "doc_id", "text")).otherwise(own))
    else:
        marked = documents.withColumns({"__again": F.lit(False), "__id": own})
    with scratch(spark) as kept_tables:
        grouped = stage(group(marked.select(F.col("__id").alias("doc_id"), "text")), "neardup-groups")
        kept_tables.append(grouped)
    gone = grouped.filter(~F.col("kept")).select(F.col("doc_id").alias("__id")).distinct()
    kept = marked.join(gone, "__id", "left_anti")
    if not n:
        return kept.select(*columns)
    # Equal rows are one node: one row of each stays, found by partial aggregation; those without words are alike to nothing.
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    again = kept.filter(F.col("__again") & worded).dropDuplicates(["__id"])
    return kept.filter(~(F.col("__again") & worded)).select(*columns).unionByName(again.select(*columns))
