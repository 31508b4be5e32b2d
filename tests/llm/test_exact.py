"""Operators whose results are exact, against brute force on a small, awkward table."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rasterloom.llm import chat, decontaminate, mixing, neardup, sharding, tokens, topk
from rasterloom.llm.queries import tokenizer_path

from .conftest import BENCH, rows

ROWS = rows()


def table(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


# ---- sharding


def draw(key: str, name: str, weight: float) -> float:
    u = (int(hashlib.md5(f"{key}:{name}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
    return -math.log(u) / weight


def descend(key: str, topology: sharding.Topology) -> int:
    tree = topology.tree()
    weigh = lambda racks: sum(sum(x.values()) for x in racks.values())
    one = lambda options: options[0][1] if len(options) == 1 else min(options, key=lambda o: draw(key, o[0], o[2]))[1]
    g = one([(f"region {g}", g, weigh(r)) for g, r in sorted(tree.items())])
    k = one([(f"rack {g}/{k}", k, sum(x.values())) for k, x in sorted(tree[g].items())])
    return one([(f"shard {s}", s, w) for s, w in sorted(tree[g][k].items())])


def test_sharding(spark, documents, nothing):
    topology = sharding.Topology.even(16)
    got = sharding.shard_documents(documents, topology, topology.grow()).collect()
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), descend("null" if d is None else str(d), topology)) for d, t, *_ in ROWS)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"]) for r in got) == want
    assert all(r["grown_shard"] in (r["shard"], 16) for r in got)
    for shard, group in itertools.groupby(sorted(got, key=lambda r: (r["shard"], r["slot"])), lambda r: r["shard"]):
        assert [r["slot"] for r in group] == list(range(sum(r["shard"] == shard for r in got)))
    assert sharding.shard_documents(nothing, topology, topology.grow()).count() == 0


def test_changed_weights_move_only_their_subtree(spark):
    keys = spark.range(4000).select(F.col("id").alias("doc_id"))
    topology = sharding.Topology.even(16)
    heavier = topology.reweigh(5, 2.0)
    grown = topology
    for _ in range(3):
        before, grown = grown, grown.grow()
        moved = sharding.assign(keys, "doc_id", before, grown).filter("shard <> grown_shard").select("grown_shard").distinct().collect()
        assert [r[0] for r in moved] == [len(before.leaves)]
    moved = sharding.assign(keys, "doc_id", topology, heavier).filter("shard <> grown_shard").collect()
    assert moved and all(r["grown_shard"] // 8 == 0 for r in moved)  # into the region whose weight grew
    assert all(r["grown_shard"] == 5 for r in moved if r["shard"] // 4 == 1)  # within its rack, into the shard alone
    counts = Counter(r[0] for r in sharding.assign(keys, "doc_id", topology).select("shard").collect())
    assert len(counts) == 16 and max(counts.values()) < 2 * min(counts.values())


# ---- decontamination


def brute_hits(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, items, runs = set(), set(), [(0, 1)]
    for item, body in BENCH:
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), body or ""))
        n = min(10, len(own))
        for i in range(max(0, len(own) - n + 1) if n else 0):
            for j in range(len(words) - n + 1):
                if words[j : j + n] == own[i : i + n]:
                    hit |= set(range(j, j + n))
                    items.add(str(item))
                    k = n
                    while words[j : j + k + 1] == own[i : i + k + 1] and i + k < len(own):
                        k += 1
                    runs.append((k, -j))
    best = max(runs)
    return len(words), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit), best[0], -best[1]


def test_decontamination(spark, documents, benchmark, nothing, monkeypatch):
    want = Counter((d, *brute_hits(t)) for d, t, *_ in ROWS)
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest", "longest_at")
    assert table(decontaminate.digest(decontaminate.annotate(documents, benchmark)), *columns) == want
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 8)
    assert len(list(decontaminate.blocks(benchmark))) > 1
    assert table(decontaminate.digest(decontaminate.annotate(documents, benchmark)), *columns) == want
    clean = decontaminate.remove(documents, benchmark)
    assert clean.columns == documents.columns
    assert Counter(r["doc_id"] for r in clean.collect()) == Counter(d for d, t, *_ in ROWS if not brute_hits(t)[1])
    nameless = benchmark.select(F.lit(None).cast("string").alias("item_id"), "text")
    assert {r["items"][0] for r in decontaminate.annotate(documents, nameless).filter("n_hit > 0").collect()} == {""}
    empty = benchmark.limit(0)
    assert decontaminate.annotate(documents, empty).filter("n_hit > 0").count() == 0
    assert decontaminate.annotate(nothing, benchmark).count() == 0


def test_longest_match(spark, documents, benchmark):
    split = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    texts = [(d, split(t)) for d, t, *_ in ROWS if d is not None]
    want = {}
    for item, body in BENCH:
        own = split(body)
        for at in range(len(own)):
            best = (0, 0, 0)
            for d, words in texts:
                for j in range(len(words)):
                    k = 0
                    while at + k < len(own) and j + k < len(words) and own[at + k] == words[j + k]:
                        k += 1
                    best = max(best, (k, -d, -j))
            if best[0]:
                want[str(item), at] = (best[0], -best[1], -best[2])
    got = {(r["item_id"], r["item_word"]): (r["words"], r["doc_id"], r["doc_word"]) for r in decontaminate.longest_matches(documents.filter("doc_id is not null"), benchmark).collect()}
    assert got["1", 0] == (12, 11, 2) and got.keys() == want.keys()
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 12))
def test_suffix_array_order(words, depth):
    ids = np.array([*words, 0], np.int32)
    array = decontaminate.suffix_array(ids, depth)

    def prefix(p):
        out = []
        for x in ids[p : p + depth]:
            if x == 0:
                break
            out.append(int(x))
        return out

    assert sorted(array.tolist()) == [i for i, x in enumerate(ids) if x]
    assert [prefix(p) for p in array] == sorted(prefix(p) for p in array)


# ---- mixing


def test_mixing(spark, documents, nothing):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = defaultdict(int)
    for _, t, _, s in ROWS:
        total[s] += size(t)
    names = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, 1.5 * sum(total.values()), list(names)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * total[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
            open_.remove(s)
    got = mixing.mix(documents).collect()
    assert Counter((r["doc_id"], r["size"], r["source_size"]) for r in got) == Counter((d, size(t), total[s]) for d, t, _, s in ROWS)
    by_doc = {d: s for d, _, _, s in ROWS if d is not None}
    taken = defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        if r["doc_id"] is not None:
            assert r["target"] == pytest.approx(target[by_doc[r["doc_id"]]])
            taken[by_doc[r["doc_id"]]] += r["taken"]
    for s in names:
        if s not in ("a", None):  # these two also have rows without an id
            assert taken[s] == math.floor(target[s] + 1e-9)
    positions = [r["position"] for r in got]
    assert positions == sorted(positions)
    again = mixing.mix(documents.repartition(7))
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, got))
    assert mixing.mix(nothing).count() == 0


def test_training_order_has_a_row_per_copy(spark, documents):
    got = mixing.training_order(documents)
    assert got.columns == documents.columns
    copies = Counter(r["doc_id"] for r in got.collect())
    for r in mixing.mix(documents).filter("doc_id is not null").collect():
        whole, rest = divmod(r["taken"], r["size"]) if r["size"] else (0, 0)
        if r["doc_id"] != 14:  # two rows
            assert copies[r["doc_id"]] == whole + (2 * rest >= r["size"] and rest > 0)


@pytest.mark.parametrize("knots", mixing.SCHEDULES)
def test_positions_invert_the_demand(spark, knots):
    shares = [i / 50 for i in range(51)]
    df = spark.createDataFrame([(x,) for x in shares], "x double").select("x", mixing.invert_demand(F.col("x"), knots).alias("t"))

    def demand(t):
        grid = np.linspace(0, t, 20001)
        weight = np.interp(grid, [k[0] for k in knots], [k[1] for k in knots])
        whole = np.trapezoid(np.interp(np.linspace(0, 1, 20001), [k[0] for k in knots], [k[1] for k in knots]), np.linspace(0, 1, 20001))
        return np.trapezoid(weight, grid) / whole

    for r in df.collect():
        assert demand(r["t"]) == pytest.approx(r["x"], abs=1e-6)


# ---- near duplicates


def brute_groups(items):
    sets = []
    for d, t in items:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((d, {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())))
    root = {d: d for d, _ in sets if d is not None}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for (a, x), (b, y) in itertools.combinations([s for s in sets if s[0] is not None], 2):
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return Counter((d, len(x), None if d is None else find(d), True if d is None else find(d) == d) for d, x in sets)


COLUMNS5 = ("doc_id", "n_shingles", "component_id", "kept")


def test_near_duplicates(spark, documents, nothing):
    assert table(neardup.group(documents), *COLUMNS5) == brute_groups([(d, t) for d, t, *_ in ROWS])
    assert neardup.group(nothing).count() == 0
    kept = neardup.remove(documents)
    assert kept.columns == documents.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({r[0] for r in brute_groups([(d, t) for d, t, *_ in ROWS]) if r[0] is not None and r[3]})
    assert ids.count(None) == 2


def test_rows_are_removed_by_their_texts(spark):
    """One doc_id, or none, on several texts: different ones stay, equal and similar ones are a group."""
    one, other, third = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    near = one.replace("a39", "z")
    rows = [(1, one, "p"), (1, other, "q"), (1, other, "r"), (2, near, "s"), (None, third, "t"), (None, third, "t"), (None, None, "u"), (None, None, "u"), (3, "", "v"), (3, "", "v"), (4, None, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __again string").repartition(3).withColumnRenamed("__again", "again")
    left = neardup.remove(df)
    assert left.columns == df.columns
    got = Counter((r["doc_id"], r["text"]) for r in left.collect())
    assert sum(got[x] for x in ((1, one), (2, near))) == 1
    assert got[1, other] == 1 and got[None, third] == 1 and got[None, None] == 2 and got[3, ""] == 2 and got[4, None] == 1


def test_crowded_regions(spark, monkeypatch):
    """Copies around originals that differ from each other too much, in blocks smaller than the crowd."""
    rnd = random.Random(4)
    items = []
    for hub in range(3):
        base = [f"h{hub}w{i}" for i in range(120)]
        items.append((hub * 1000, " ".join(base)))
        for k in range(60):
            words = list(base)
            for at in rnd.sample(range(120), 3):
                words[at] = f"n{hub}x{k}x{at}"
            items.append((hub * 1000 + k + 1, " ".join(words)))
    long = [f"l{i}" for i in range(1500)]
    for k in range(12):
        words = list(long)
        for at in rnd.sample(range(1500), 40):
            words[at] = f"m{k}x{at}"
        items.append((9000 + k, " ".join(words)))
    df = spark.createDataFrame(items, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(neardup, "MEET", 16)
    assert table(neardup.group(df), *COLUMNS5) == brute_groups(items)


def packed(*values):
    """Sorted rows of the leading signature values, as the forest packs them."""
    out = 0
    for v in (*values, 0, 0, 0, 0)[: neardup.DEPTH]:
        out = out << 16 | v
    return out


def test_depth_of_regions_adapts_to_their_crowd():
    crowd = neardup.CROWD
    rows = [(1, packed(1, 1, 1, 1))]  # an end
    rows += [(1, packed(2, 2, 10 + i, i)) for i in range(crowd)]  # as many as fit: one region of two values
    rows += [(1, packed(3, 3, 3, 10 + i)) for i in range(crowd)] + [(1, packed(3, 3, 4, 9))] * 2  # too many: two of three values
    rows += [(1, packed(4, 4, 4, 4))] * (crowd + 1) + [(1, packed(4, 4, 4, 5))]  # too many there too: four values
    rows += [(2, packed(4, 4, 4, 5)), (2, packed(5, 5, 5, 5))]
    tree, k1 = (np.array(x) for x in zip(*rows, strict=True))
    depth, joins = neardup.depths(tree, k1)
    assert depth.tolist() == [4] + [2] * crowd + [3] * (crowd + 2) + [4] * (crowd + 2) + [2, 4]
    starts = np.flatnonzero(~joins).tolist()
    assert np.diff([*starts, len(rows)]).tolist() == [1, crowd, crowd, 2, crowd + 1, 1, 1, 1]


@pytest.mark.parametrize("cut", [1, 3, 50])
def test_no_pair_of_full_depth_is_lost_where_a_task_cuts(spark, monkeypatch, cut):
    """Rows that share DEPTH values in a tree are in one region of it, however the sorted rows are cut."""
    monkeypatch.setattr(neardup, "RUN_ROWS", cut)
    rng = np.random.default_rng(cut)
    rows = sorted((int(t), packed(*rng.integers(0, 2, 4).tolist()), i) for i, t in enumerate(rng.integers(0, 2, 120)))
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[at : at + 7], strict=True)], names=["tree", "k1", "rid"]) for at in range(0, len(rows), 7)]
    monkeypatch.setattr(neardup, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("P", (), {"partitionId": staticmethod(lambda: 0)})())}))
    found = [r for b in neardup._scan(iter(batches)) for r in b.to_pylist() if r["kind"] == 0]
    regions = defaultdict(set)
    for r in found:
        regions[r["tree"], r["depth"], r["prefix"]].add(r["rid"])
    for a, b in itertools.combinations(rows, 2):
        if a[:2] == b[:2]:
            assert any(a[2] in x and b[2] in x for x in regions.values())


def test_low_halves_bound_the_intersection():
    """Where halves of hashes collide, within a set or between two, no link is lost."""
    rng = np.random.default_rng(5)
    pool = np.unique(rng.integers(0, 2**63, 900, dtype=np.uint64))
    pool = np.concatenate([pool, pool[:200] ^ np.uint64(1 << 50)])  # 200 halves stand for two hashes each
    sets = [np.sort(rng.choice(pool, n, replace=False)) for n in (700, 800, 1000, 1090)]
    low = [neardup.low_halves(x) for x in sets]
    common = neardup._common(low, low, np.uint32)
    for i, j in itertools.product(range(4), repeat=2):
        missing = min(len(sets[i]) - len(low[i]) // 4, len(sets[j]) - len(low[j]) // 4)
        assert len(np.intersect1d(sets[i], sets[j])) <= common[i, j] + missing


def test_long_texts_of_a_region_send_links_alone(spark):
    """300 long texts, half alike: they meet in regions, but no pair of them leaves."""
    rnd = random.Random(8)
    base = [f"b{i}" for i in range(6000)]
    items = []
    for k in range(300):
        words = base[:]
        at = rnd.randrange(2900)
        words[at : at + 2000] = [f"o{k}x{i}" for i in range(2000)]
        items.append((k, " ".join(words)))
    items.append((300, items[0][1] + " more words"))
    df = spark.createDataFrame(items, "doc_id long, text string").repartition(8)
    sets = neardup.full_sets(df, df.select(F.col("doc_id").alias("rid")), 8)
    one = df.select(F.lit(0).alias("tree"), F.lit(2).alias("depth"), F.lit(0).cast("long").alias("prefix"), F.col("doc_id").alias("rid"))
    labels = spark.createDataFrame([], "id long, root long")
    pairs = [(r["a"], r["b"], r["sure"]) for r in neardup.open_pairs(one, labels, sets, 8).collect()]
    assert pairs == [(0, 300, False)]


def test_chains_contract(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (300, 200), (7, 100)]
    got = {r["id"]: r["root"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in [*range(1, 41), 100, 200, 300]}


# ---- tokens


def test_tokens(spark, documents, nothing, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    got = sorted(tokens.round_trip(documents, tokenizer_path()).collect(), key=lambda r: r["start"])
    assert len(got) == len(order)
    at = 0
    for (d, t, *_), r in zip(order, got, strict=True):
        if d is not None:
            ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
            assert (r["doc_id"], r["n_tokens"]) == (d, len(ids))
            assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert r["start"] == at
        at += r["n_tokens"]
    assert tokens.round_trip(nothing, tokenizer_path()).count() == 0


def test_token_files(spark, documents, tmp_path):
    import pyarrow.parquet as pq

    tokens.write_tokens(documents, f"file:{tmp_path}/t", tokenizer_path())
    files = [pq.ParquetFile(p) for p in tmp_path.glob("t/*.parquet")]
    group = files[0].metadata.row_group(0)
    kinds = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    assert any("DELTA" in e for e in kinds["local_start"].encodings)
    assert all(c.has_offset_index and c.has_column_index for name, c in kinds.items())
    assert "RLE_DICTIONARY" in next(c for n, c in kinds.items() if n.startswith("ids")).encodings
    plan = tokens.read_tokens(spark, f"file:{tmp_path}/t").select("doc_id", "start")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1].split("\n")[0]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abcXYZ 's'd0129²\t\n\r!?.,-_‘’…éß×ªº¿\xa0\xad\x0b日😀<|endoftext|>"), max_size=60))
def test_encoder_equals_the_library(text):
    encoder = tokens.encoder(tokenizer_path())
    assert encoder([text, text + " x"]) == encoder.library([text, text + " x"])


def test_long_texts_are_cut_safely(monkeypatch):
    monkeypatch.setattr(tokens, "BATCH_BYTES", 64)
    encoder = tokens.encoder(tokenizer_path())
    rnd = random.Random(2)
    texts = ["".join(rnd.choice("ab, .\n\t  éX9") for _ in range(2000)) for _ in range(20)]
    assert encoder(texts) == encoder.library(texts)


def thue_morse(k: int) -> str:
    word = "a"
    for _ in range(k):
        word += word.translate(str.maketrans("ab", "ba"))
    return word


@pytest.mark.parametrize("k", [4, 10, 11, 12])
def test_pieces_that_polynomial_hashes_mix_up(k):
    word = thue_morse(k)
    other = word.translate(str.maketrans("ab", "ba"))
    for texts in ([word, other], [other, word], [f"{word} {other} x", other]):
        encoder = tokens.Encoder(tokenizer_path())
        for _ in range(2):  # the second time from the store
            assert encoder(texts) == encoder.library(texts)


def test_colliding_keys_are_told_apart(monkeypatch):
    monkeypatch.setattr(tokens, "_mixed", lambda a, b: (a ^ b) % np.uint64(3))
    monkeypatch.setattr(tokens, "LATE_PIECES", 4)
    monkeypatch.setattr(tokens, "LONG_PIECES", 2)
    encoder = tokens.Encoder(tokenizer_path())
    texts = [" ".join(f"{'w' * (i % 40)}{(i * k) % 97}" for i in range(50)) for k in range(1, 9)]
    for _ in range(2):
        assert encoder(texts) == encoder.library(texts)


def test_recurring_pieces_are_asked_once(monkeypatch):
    monkeypatch.setattr(tokens, "PLACES", 1 << 14, raising=False)
    encoder = tokens.Encoder(tokenizer_path())
    asked, tokenize = Counter(), encoder.tokenize
    encoder.tokenize = lambda text: (asked.update([text]), tokenize(text))[1]
    words = ["".join(w) for w in itertools.product("abcdefg", repeat=3)]
    for at in range(0, 640_000, 20_000):  # far more pieces that don't recur than a worker remembers
        encoder([" " + " ".join([*words, *map(str, range(10**6 + at, 10**6 + at + 20_000))])])
    again = [n for text, n in asked.items() if text[1:] in words]
    assert len(again) == len(words) and sum(again) <= 1.1 * len(words)


# ---- search


def brute_top(vectors, k=5):
    usable = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, x in {i: v for i, v in sorted(usable, key=lambda r: r[1], reverse=True) if i % 50 == 0}.items():
        found = sorted((-sum(a * b for a, b in zip(x, v, strict=True)), i) for i, v in usable if i != q and len(v) == len(x))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return Counter(out)


@pytest.mark.parametrize("block", [4096, 2])
def test_search(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "QUERY_BLOCK", block)
    rng = np.random.default_rng(0)
    vectors = [(i, rng.normal(size=6).round(2).tolist()) for i in range(230)]
    vectors += [(300, None), (350, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0]), (400, [None, 1.0, 0.0, 0.0, 0.0, 0.0]), (450, [float("inf")] * 6), (500, [1.0, 2.0])]
    vectors += [(i, vectors[7][1]) for i in range(600, 640)] + [(7, vectors[7][1])]  # ties and a repeated row
    vectors += [(None, vectors[0][1]), (None, None), (2**60 + 1, vectors[0][1]), (2**60 + 3, vectors[0][1])]  # no id; ids that doubles mix up
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in vectors], "vec_id long, embedding array<float>, label int, score string").repartition(5)
    got = topk.search(df, F.col("vec_id") % 50 == 0)
    assert table(got, "query_id", "rank", "vec_id", "score") == brute_top(vectors)
    assert topk.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_search_among_huge_components(spark):
    """Products beyond 64 bits, of whatever finite doubles: exact ranks, scores as far as 38 digits."""
    rng = np.random.default_rng(6)
    vectors = [(i, (rng.normal(size=3) * 10.0 ** rng.integers(0, 16)).tolist()) for i in range(120)]
    vectors += [(200, [1e12, 1e12, 0.0]), (201, [1e16, -1e16, 1.0]), (250, [1e16, 1e16, 1e16]), (251, [2.0**53, 1.0, 2.0**50])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)

    def brute(vectors):
        whole = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors]
        out = []
        for q, x in whole:
            if q % 50 == 0:
                found = sorted((-sum(a * b for a, b in zip(x, v, strict=True)), i) for i, v in whole if i != q)[:5]
                out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
        return Counter(out)

    got = topk.search(df, F.col("vec_id") % 50 == 0)
    assert Counter((r["query_id"], r["rank"], r["vec_id"], int(r["score"])) for r in got.collect()) == brute(vectors)
    longs = got.select(topk.as_long(F.col("score")).alias("s"), "score").collect()
    assert all(r["s"] == max(-(2**63), min(2**63 - 1, int(r["score"]))) for r in longs) and any(abs(int(r["score"])) >= 2**63 for r in longs)
    extreme = spark.createDataFrame([(0, [1e308, -1.0]), (1, [1e308, 0.0]), (2, [-1e308, 0.0]), (3, [1e300, 0.0])], "vec_id long, embedding array<double>")
    ranked = [(r["vec_id"], int(r["score"])) for r in topk.search(extreme, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert ranked == [(1, topk.MOST_SCORE), (3, topk.MOST_SCORE), (2, -topk.MOST_SCORE)]


def test_the_cutoff_leaves_entries_unscored():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 64))
    x = np.floor(256 * (centres[rng.integers(0, 20, 2000)] + 0.2 * rng.normal(size=(2000, 64))))
    q, cuts = x[:40], np.linspace(0, 64, 5).astype(int)
    own = np.arange(40)[:, None] == np.arange(2000)[None, :]
    full = np.where(own, -np.inf, q @ x.T)
    cutoffs = np.sort(full, axis=1)[:, -5]
    a, b, scores, scored = topk.collect(q, x, cuts, cutoffs, own)
    assert sorted(zip(a, b, scores, strict=True)) == sorted(zip(*np.nonzero(full >= cutoffs[:, None]), full[full >= cutoffs[:, None]], strict=True))
    assert scored < 0.6 * own.size * 4
    # With no cutoff nothing may be left out.
    assert len(topk.collect(q, x, cuts, np.full(40, -np.inf), own)[0]) == own.size - 40


def test_first_entries_of_every_list_are_gathered():
    rng = np.random.default_rng(2)
    partial = [rng.integers(-9, 9, (3, 30)).astype(float) for _ in range(4)]
    own = np.arange(3)[:, None] == np.arange(30)[None, :]
    taken = topk.gather(partial, own, 5)
    for i in range(3):
        for p in partial:
            others = np.delete(p[i], i)
            assert (p[i][taken[i]] >= np.sort(others)[-5]).sum() >= 5
    assert taken.sum() <= 3 * 4 * 5 and not (taken & own).any()


# ---- chat


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "tool\\\n", "<|im_end|>"]), st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<", "[", "\\", "|", "x", "\n", "é", "/s>", "INST]"]), max_size=12).map("".join)), max_size=4))
def test_format_round_trip(turns):
    text, spans = chat.render(turns)
    assert chat.parse(text) == turns
    assert "".join(chat.unescape(text[a:b]) for a, b in spans) == "".join(t for r, t in turns if r == "assistant")
    assert text.count(chat.OPEN) == len(turns) == text.count(chat.CLOSE)


def test_conversations(spark):
    data = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, None, None), (None, 3, "user", "n"), (3, None, "assistant", "</s>[INST]"), (3, 0, "user", "x" * 50_000)]
    data += [(4, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(150)]
    df = spark.createDataFrame([(*r, "extra") for r in data], "conv_id long, turn long, role string, text string, tree string")
    got = {r["conv_id"]: r for r in chat.round_trip(chat.probe(df)).collect()}
    data += [(-1, 0, "user", chat.PROBE), (-1, 1, "assistant", chat.PROBE)]
    low = lambda v: (v is not None, v if v is not None else 0)
    text = lambda v: (v is not None, v or "")
    for conv in {r[0] for r in data}:
        turns = [(r or "", t or "") for _, _, r, t in sorted((x for x in data if x[0] == conv), key=lambda x: (low(x[1]), text(x[2]), text(x[3])))]
        learned = "".join(t for r, t in turns if r == "assistant")
        want = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(chat.render(turns)[0]))
        assert tuple(got[conv])[1:] == want
    assert len(got) == 6
    assert [r["conv_id"] for r in chat.round_trip(chat.probe(df.limit(0))).collect()] == [-1]
    assert chat.round_trip(df.limit(0)).count() == 0


def test_reply_trees(spark):
    rows_ = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "good", 3.0), ("t", 3, 1, "assistant", "bad", 1.0), ("t", 4, 2, "user", "thanks", 2.0), ("u", 1, 99, "user", "orphan", 0.0)]
    messages = spark.createDataFrame([(t, None, i, p, r, x, s) for t, i, p, r, x, s in rows_], "tree string, conv_id long, id long, parent long, role string, text string, score double")
    got = sorted((r["tree"], r["branch"], [t for _, t in chat.parse(r["formatted"])]) for r in chat.format_trees(messages).collect())
    assert got == [("t", 1, ["q", "good", "thanks"]), ("t", 2, ["q", "bad"]), ("u", 1, ["orphan"])]
    assert chat.format_trees(messages, best=1).count() == 2


def test_replies_in_circles_and_repeated_messages(spark):
    circle = [("c", 1, 3, "user", "a", 0.0), ("c", 2, 1, "user", "b", 0.0), ("c", 3, 2, "user", "c", 0.0), ("c", 4, 3, "user", "d", 0.0), ("c", 5, 4, "user", "e", 0.0), ("c", 6, 6, "user", "self", 0.0)]
    other = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "user", "x", 0.0), ("t", 2, 1, "user", "r", 0.0), ("t", 2, 1, "user", "x", 0.0), ("t", None, 1, "user", "lost", 0.0), (None, 7, None, "user", "lost", 0.0)]
    messages = spark.createDataFrame([(t, None, i, p, r, x, s) for t, i, p, r, x, s in circle + other], "tree string, conv_id long, id long, parent long, role string, text string, score double")
    got = sorted((r["tree"], [t for _, t in chat.parse(r["formatted"])]) for r in chat.format_trees(messages).collect())
    assert got == [("c", ["a"]), ("c", ["b"]), ("c", ["c", "d", "e"]), ("c", ["self"]), ("t", ["q", "r"])]
    assert chat.format_trees(messages.limit(0)).count() == 0
