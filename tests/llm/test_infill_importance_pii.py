"""Fill-in-the-middle, importance draws and sanitisation, each against a plain version."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rasterloom.llm import importance, infill, pii

# ---- fill in the middle


def plain_infill(doc_id, text, unit=r"[^\n]*\n|[^\n]+"):
    t = text or ""
    units = re.findall(unit, t)
    h = hashlib.sha256(f"7:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")):
        return (doc_id, n, "plain", None, None, t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 50:
        return (doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


TEXTS = [None, "", "\n", "\n\n\n", "a", "a\n", "a\nb", "é\n☕ x\n\U0001f600", "has <P> inside\nx", "<S>", "<M", "x<\ny<P\nz<", ">\n<S\n>P>", "ab\r\nc\x0bd e\n", "q\n" * 3000, "no line end " * 5000, "<\n" * 50]


def test_infill_and_restore(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS * 4)] + [(None, "a\nb\nc\n", "y"), (None, "a\nb\nc\n", "y"), (-3, "k\nl\n", "z")]
    table = spark.createDataFrame(rows, "doc_id long, text string, output string").repartition(3)
    out = infill.transform(table)
    got = sorted(map(tuple, out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()), key=str)
    assert got == sorted((plain_infill(d, t) for d, t, _ in rows), key=str)
    assert {r[2] for r in got} == set(infill.FORMS)
    back = out.select("doc_id", infill.restore(F.col("output"), F.col("form")).alias("t")).collect()
    assert Counter(map(tuple, back)) == Counter((d, t or "") for d, t, _ in rows)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    digests = {(r["doc_id"], r["output_sha256"], r["restored_sha256"]) for r in infill.digest(out).collect()}
    assert digests == {(d, sha(plain_infill(d, t)[5]), sha(t or "")) for d, t, _ in rows}
    assert infill.transform(table.limit(0)).count() == 0


def test_bit_masks_find_units_as_patterns_do():
    draw = random.Random(5)
    for _ in range(300):
        text = "".join(draw.choice("ab \t\né☕\U0001f600") for _ in range(draw.randrange(40)))
        raw = text.encode()
        for unit, pattern in (("lines", r"[^\n]*\n|[^\n]+"), ("chars", r"(?s:.)"), ("words", r"[ \t\n]*[^ \t\n]+(?:[ \t\n]+\Z)?|\A[ \t\n]+\Z")):
            want, at = [], 0
            for piece in re.findall(pattern, text):
                want.append(at)
                at += len(piece.encode())
            marks = infill.starts(raw, unit)
            assert marks.bit_count() == len(want)
            assert [infill.select(marks, r) for r in range(len(want))] == want


def test_infill_options(spark):
    table = spark.createDataFrame([(i, "one two  three four\n") for i in range(60)], "doc_id long, text string")
    spec = infill.Spec(seed=1, unit="words", rate=50, spm=0, prefix="[pre]", suffix="[suf]", middle="[mid]")
    rows = infill.transform(table, spec).withColumn("back", infill.restore(F.col("output"), F.col("form"), spec)).collect()
    assert {r["form"] for r in rows} == {"plain", "psm"}
    assert all(r["n"] == 4 and r["back"] == "one two  three four\n" for r in rows)
    for wrong in ({"unit": "pages"}, {"prefix": "<S>"}, {"prefix": "P"}, {"prefix": "<<>"}, {"prefix": "<S"}, {"prefix": "(P)"}):
        with pytest.raises(ValueError):
            infill.Spec(**wrong)


# ---- importance resampling


def plain_importance(rows, target, spec=importance.Spec()):
    def bag(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        runs = [" ".join(words[i : i + n]) for n in range(1, spec.longest + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(r.encode()) % spec.buckets for r in runs]

    own, other = [bag(t) for _, t in rows], [bag(t) for t in target]
    s, t = Counter(x for _, b in own for x in b), Counter(x for _, b in other for x in b)
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + spec.buckets) / ((s[b] + 1) * (t_all + spec.buckets))))
    out = []
    for (d, _), (n, b) in zip(rows, own, strict=True):
        weight = sum(map(gain, b))
        h = int(hashlib.sha256(f"{spec.seed}:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    eligible = sorted((r for r in out if r[5] >= spec.least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(eligible[: spec.percent * len(eligible) // 100], 1):
        r[4] = k
    return Counter(tuple(r[:5]) for r in out)


def corpus(n, seed):
    draw = random.Random(seed)
    rows = [(i, " ".join(f"w{min(draw.randrange(400), draw.randrange(400))}" for _ in range(draw.randrange(45)))) for i in range(n)]
    hot = "Same TEXT for many documents " + " ".join(f"h{i}" for i in range(20))
    rows += [(10_000 + i, hot) for i in range(n // 2)] + [(None, hot)] * (n // 4) + [(7, hot)] * 30
    return [*rows, (20_000, None), (20_001, ""), (20_002, "... !!"), (20_003, "Éa l'été 日本 " * 30), (None, None)]


@pytest.mark.parametrize(("spec", "size"), [(importance.Spec(), 600), (importance.Spec(longest=2, buckets=97, least=5, percent=37, seed=3), 200), (importance.Spec(buckets=1 << 17, percent=100), 60)])
def test_importance_ranks(spark, monkeypatch, spec, size):
    monkeypatch.setattr(importance, "RANGE_ROWS", 64)
    monkeypatch.setattr(importance, "SAMPLE_STEP", 8)
    rows, target = corpus(size, 1), ["w1 w2 w3 w5 w8 h3", None, "", "w13 same 日本 w1"]
    documents = spark.createDataFrame([(d, t, "r") for d, t in rows], "doc_id long, text string, rank string").repartition(5)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(documents, bench, spec).collect()
    assert Counter(map(tuple, got)) == plain_importance(rows, target, spec)
    ranks = sorted(r["rank"] for r in got if r["rank"] is not None)
    assert ranks == list(range(1, len(ranks) + 1))


def test_importance_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert importance.resample(none, none).count() == 0
    assert Counter(map(tuple, importance.resample(some, none).collect())) == plain_importance([(1, "a b"), (2, None)], [])


def test_tournament_merges_any_lists():
    draw = random.Random(2)
    for k in (1, 2, 3, 7, 16, 33):
        lists = [sorted((draw.randrange(50), i) for _ in range(draw.randrange(20))) for i in range(k)]
        assert [lists[i][j] for i, j in importance.Tournament(lists)] == sorted(x for one in lists for x in one)


def test_ranges_split_equal_rows(spark, monkeypatch):
    """A third of all rows with one score and one id still lie in many ranges."""
    monkeypatch.setattr(importance, "SAMPLE_STEP", 8)
    rows = [(None, "the very same words " * 6)] * 900 + [(i, "other words entirely " * 7) for i in range(300)]
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    spec = importance.Spec()
    cut = importance.cut(documents, "doc_id", spec)
    runs = importance.runs(importance.score(cut, importance.gains(importance.counts(cut, spec), importance.counts(cut, spec)), spec))
    cuts = importance.borders(runs.filter("eligible"), 64)
    sizes = [r["count"] for r in importance.ranged(runs.filter("eligible"), cuts).groupBy("range").count().collect()]
    assert sum(sizes) == 1200 and len(sizes) >= 12 and max(sizes) <= 200


# ---- personal data

BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def plain_base(text):
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for k, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (kind == "card" and 14 <= len(d) <= 19 and luhn(d)) or (kind == "phone" and 10 <= len(d) <= 15):
                out.append((m.start(), k, m.end(), m[0]))
    return sorted(out)


def plain_disclosing(texts):
    """(row, start, end) of all terms, by loops over positions."""
    word = re.compile(r"[A-Za-z\x80-\U0010FFFF]+")
    vocabulary = Counter(w.lower() for t in texts for w in word.findall(t or ""))
    positions = {}
    for r, t in enumerate(texts):
        t = t or ""
        by_kind = defaultdict(list)
        for k, (_, pattern) in enumerate(BASE):
            by_kind[k] = [m.span() for m in re.finditer(pattern, t)]
        for s, k, e, value in plain_base(t):
            spans = by_kind[k]
            i = spans.index((s, e))
            low = spans[i - 1][1] if i else 0
            high = spans[i + 1][0] if i + 1 < len(spans) else len(t)
            entity = (k, value.lower() if k == 0 else value if k == 1 else re.sub("[^0-9]", "", value))
            near = [m for m in word.finditer(t, low, s) if m.start() >= s - 64] + [m for m in word.finditer(t, e, high) if m.end() <= e + 64]
            hashes = sorted(hashlib.md5(m[0].lower().encode()).hexdigest() for m in near)
            context = hashes[0] + hashes[-1] if hashes else None
            for m in near:
                key = (r, entity, m.start())
                positions[key] = (m[0].lower(), m.end(), min(context, positions.get(key, ("", 0, "~"))[2]))
    n_te, contexts, n_e = Counter(), defaultdict(set), Counter()
    for (_, entity, _), (term, _, context) in positions.items():
        n_te[entity, term] += 1
        n_e[entity] += 1
        contexts[entity, term].add(context)
    n_all, out = sum(vocabulary.values()), set()
    for (r, entity, s), (term, e, _) in positions.items():
        ic = math.log2(n_all / n_e[entity])
        if len(contexts[entity, term]) >= pii.SUPPORT and ic > 0 and math.log2(n_te[entity, term] / vocabulary[term] / (n_e[entity] / n_all)) / ic >= pii.THRESHOLD:
            if not any(b < e and s < x for b, _, x, _ in plain_base(texts[r])):
                out.add((r, s, e))
    return out


PERSONAL = [
    None,
    "",
    "no data here at all",
    "a@b.c_x@d.e, a.b@c, @x.y, x@y..z, u%v+w-1@h-1.io. tail@",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.2.3 9.9.9.9.",
    "4111 1111 1111 1111, 4111-1111-1111-1112 and 4111111111111111 4111111111111111 5500005555555559",
    "+1 (743) 555-3824, +12, +1 2 3, +49 30 1234567890123456, +44-20-7946-0958. ++1 (555) 010-9999",
    "é☕\U0001f600 mail é@x.de me@x.de\n10.0.0.1 日本語 +1 (743) 555-3824 " * 3,
    "9" * 30_000 + " " + "1 " * 20_000,
    "a" * 50_000 + "@" + "b." * 20_000 + "c",
    "x." * 40_000,
    "+" + "1(" * 30_000,
]


def test_base_spans(spark):
    rows = [(i, t, "s") for i, t in enumerate(PERSONAL)] + [(None, PERSONAL[5], "s"), (3, PERSONAL[3], "s")]
    table = spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(3)
    got = pii.find(table).collect()
    want = Counter((d, tuple((s, k, e) for s, k, e, _ in plain_base(t))) for d, t, _ in rows)
    assert Counter((r["doc_id"], tuple((s["start"], s["kind"], s["end"]) for s in r["spans"])) for r in got) == want
    for r in pii.digest(pii.find(table)).collect():
        spans = plain_base(dict((d, t) for d, t, _ in rows)[r["doc_id"]])
        text = ",".join(f"{BASE[k][0]}:{s}:{e}" for s, k, e, _ in spans)
        assert (r["spans"], r["base_sha256"]) == (text, hashlib.sha256(text.encode()).hexdigest())
        assert [r[f"n_{name}"] for name, _ in BASE] == [sum(k == i for _, k, _, _ in spans) for i in range(4)]
    assert pii.find(table.limit(0)).count() == 0


def disclosed_texts():
    """A nickname that stands beside one address alone, in contexts that differ; a common word beside it; copies of one passage."""
    draw = random.Random(3)
    filler = lambda n: " ".join(f"{draw.choice('bcdfgklm')}{draw.choice('aeiou')}{draw.choice('nrst')}{draw.choice('aeiou')}" for _ in range(n))
    texts = [f"{filler(40)} write to Zorblatt {filler(1)} at zed{1}@mail.example.com or Brückmann {filler(12)}" for _ in range(12)]
    texts += [f"{filler(30)} write to {filler(3)} at other{i}@mail.example.com soon" for i in range(12)]
    texts += [f"once Copyword stands by +1 (743) 555-3824 in a passage {'' if i else 'x'}" for i in range(9)]
    return [*texts, *(f"write {filler(60)} brackets brink" for _ in range(20)), None, "mail zed1@mail.example.com", "ZED1@mail.example.com zorblatt; Zorblatt far away " + filler(30)]


def test_terms_that_disclose(spark):
    texts = disclosed_texts()
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {(r["doc_id"], s["start"], s["end"]) for r in pii.find(table).collect() for s in r["spans"] if s["kind"] == pii.TERM}
    assert got == plain_disclosing(texts)
    said = {texts[d][a:b] for d, a, b in got}
    assert {"Zorblatt", "Brückmann", "zorblatt"} <= said and not said & {"Copyword", "write", "at"}


def test_sanitised_texts(spark):
    texts = [*disclosed_texts(), "4111 1111 1111 1111 +1 (743) 555-3824é", "x +378282246310005 y"]
    table = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, row string").repartition(3)
    out = pii.sanitise(table)
    assert out.columns == table.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert len(got) == len(texts)
    for d, t in enumerate(texts):
        if not plain_base(t):
            assert got[d] == t
    assert "<EMAIL>" in got[0] and "Zorblatt" not in got[0] and "@" not in got[0]
    assert "write to" in got[0] and got[len(texts) - 2] == "<CARD> <PHONE>é"
    assert got[len(texts) - 1] == "x <PHONE> y"
    assert got[texts.index(next(t for t in texts if t and "far away" in t))].startswith("<EMAIL> ;  far away")
    none = spark.createDataFrame([], "doc_id long, text string, row string")
    assert pii.sanitise(none).count() == 0
