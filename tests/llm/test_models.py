"""Trained operators: held-out accuracy, what they may look at, awkward rows."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from rasterloom.llm import language, quality, toxicity
from rasterloom.llm.common import held_out_remainder, table

SF = DATA / "sf0.1"
needs_data = pytest.mark.skipif(not SF.exists(), reason="test tables are missing")


@pytest.fixture(scope="module")
def labels(spark):
    return table(spark, str(SF), "labels") if SF.exists() else None


@pytest.fixture(scope="module")
def labelled(spark):
    return table(spark, str(SF), "documents") if SF.exists() else None


def confusion(scored, labels, label):
    rows = scored.filter("held_out").join(labels, "doc_id").groupBy(label, "predicted").count().collect()
    return {(r[label], r["predicted"]): r["count"] for r in rows}


@needs_data
def test_toxicity_on_held_out_rows(labelled, labels):
    scored = toxicity.score(labelled, labels)
    c = confusion(scored, labels, "toxic")
    hit, missed, false = c.get((1, 1), 0), c.get((1, 0), 0), c.get((0, 1), 0)
    assert hit / (hit + missed) > 0.85 and false <= 0.05 * hit
    assert scored.filter("score < 0 or score > 1 or score is null").count() == 0


def test_toxicity_learns_from_labels_past_twelve_thousand(spark):
    own = spark.range(22_000).select(F.col("id").alias("doc_id")).withColumn("held", held_out_remainder(toxicity.FOLDS) == toxicity.HELD_OUT)
    ids = [r["doc_id"] for r in own.filter("not held").orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    assert 15_000 < len(ids) <= toxicity.SAMPLE
    rows = [(i, "plain words", 0) for i in ids[:12_000]] + [(i, "late words", 1) for i in ids[12_000:]]
    table_ = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {r["text"]: r["predicted"] for r in toxicity.score(table_, table_).join(table_, "doc_id").select("text", "predicted").distinct().collect()}
    assert got == {"plain words": 0, "late words": 1}


@needs_data
def test_quality_on_held_out_rows(labelled, labels):
    c = confusion(quality.score(labelled, labels), labels, "quality")
    assert (c.get((0, 0), 0) + c.get((1, 1), 0)) / sum(c.values()) > 0.98
    assert c.get((1, 0), 0) <= 0.01 * c[1, 1]


@needs_data
def test_language_on_held_out_rows(labelled):
    got = language.identify(labelled).filter("held_out").join(labelled.select("doc_id", "lang"), "doc_id")
    assert got.filter(F.col("lang") == F.col("lang_pred")).count() / got.count() > 0.97


@pytest.mark.parametrize("score", [toxicity.score, quality.score])
def test_awkward_rows(spark, documents, nothing, score):
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(20, 50)] + [(20, 1, 1), (21, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = score(documents, labels).collect()
    assert len(got) == documents.count()
    mod, fold = (5, 0) if score is toxicity.score else (4, 2)
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % mod == fold)
        assert 0 <= r["score"] <= 1 and r["predicted"] in (0, 1)
    assert sorted(map(str, score(documents.repartition(5), labels).collect())) == sorted(map(str, got))
    assert score(nothing, labels).count() == 0
    assert score(documents, labels.limit(0)).count() == documents.count()


@pytest.mark.parametrize("operator", ["toxicity", "quality", "language"])
def test_texts_that_share_a_doc_id_are_learnt_in_a_fixed_order(spark, documents, operator):
    """Reruns agree however the table is cut, with hundreds of texts under one id and with equal rows."""
    extra = [(7, " ".join(f"{w}{(i * k) % 11}" for k, w in enumerate(("good", "bad", "fine", "poor", "worse")))) for i in range(300)] + [(7, "again and again")] * 50
    many = documents.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(extra, "doc_id long, text string").withColumn("lang", F.lit("en")))
    labels = spark.createDataFrame([(7, 1, 0)] + [(i, i % 2, (i + 1) % 2) for i in range(20, 50)], "doc_id long, quality int, toxic int")
    run = (lambda df: language.identify(df)) if operator == "language" else (lambda df: {"toxicity": toxicity, "quality": quality}[operator].score(df, labels))
    assert sorted(map(str, run(many.repartition(7)).collect())) == sorted(map(str, run(many.coalesce(1)).collect()))


def test_quality_of_a_text_does_not_depend_on_its_block():
    texts = [f"clean text number {i} about {'many ' * (i % 7)}things" for i in range(60)] + [f"BAD!! {i}!! SHOUTING!! " * (1 + i % 5) for i in range(60)] + [""]
    y = np.array([1.0] * 60 + [0.0] * 61)
    model = quality.Model.fit(quality.counts(texts), y)
    together = model.scores(texts)
    assert [model.scores([t])[0] for t in texts] == together.tolist()
    assert model.scores(texts[::-1]).tolist() == together.tolist()[::-1]


def test_sample_bounds_texts(spark):
    rows = spark.createDataFrame([(1, f"text number {i}", i % 2) for i in range(40)], "doc_id long, text string, toxic int")
    seen = []
    fit = toxicity._fit(10, 16)
    parts = [rows.select(F.lit(0).alias("o"), F.col("toxic").alias("y"), "text").toPandas()] * 2
    monkey = toxicity.feature_slots
    try:
        toxicity.feature_slots = lambda texts, bits: (seen.extend(texts), monkey(texts, bits))[1]
        list(fit(iter(parts)))
    finally:
        toxicity.feature_slots = monkey
    assert len(seen) == 16


def test_letters_are_letters():
    assert language.letters("\u00b2 \u00bd \u2460 \u2163 12 _ \u0663") == []
    assert language.letters("ab\u00b2cd \u02b0 \u4e00") == ["ab", "cd", "\u02b0", "\u4e00"]
    long = "\u65e5\u672c\u8a9e" * 9 + "donaudampfschifffahrtsgesellschaftskapit\u00e4n"
    assert "".join(language.letters(long)) == long and all(len(w.encode()) <= language.WIDTH for w in language.letters(long))


def test_scores_do_not_read_other_columns(spark, documents):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(20, 50)], "doc_id long, quality int, toxic int")
    changed = documents.withColumns({"lang": F.lit("zz"), "source": F.lit("zz")})
    for score in (toxicity.score, quality.score):
        assert sorted(map(str, score(documents, labels).collect())) == sorted(map(str, score(changed, labels).collect()))


def test_toxicity_removal_keeps_columns(spark, documents):
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(20, 50)], "doc_id long, toxic int")
    kept = toxicity.remove(documents, labels)
    assert kept.columns == documents.columns
    assert kept.count() == toxicity.score(documents, labels).filter("predicted = 0").count()


def test_language_awkward_rows(spark, documents, nothing):
    got = {r["doc_id"]: r for r in language.identify(documents).collect()}
    assert got[2]["lang_pred"] == got[3]["lang_pred"] == got[6]["lang_pred"] == "und" and got[1]["score"] == 0
    assert got[13]["lang_pred"] != "und" and all(0 <= r["score"] <= 1 for r in got.values())
    assert language.identify(nothing).count() == 0
    assert {r["lang_pred"] for r in language.identify(documents.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_posteriors_are_exact():
    rng = np.random.default_rng(0)
    lengths = np.array([1, 5, 32, 33, 70, 200])
    e, t, s = rng.normal(size=(lengths.sum(), 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    posterior, expected = language.forward_backward(e, lengths, t, s)
    lse = lambda x, axis: np.log(np.exp(x - x.max(axis, keepdims=True)).sum(axis)) + x.max(axis)
    at, want = 0, np.zeros((3, 3))
    for n in lengths:
        own = e[at : at + n]
        a, b = np.zeros((n, 3)), np.zeros((n, 3))
        a[0] = s + own[0]
        for i in range(1, n):
            a[i] = lse(a[i - 1][:, None] + t, 0) + own[i]
        for i in range(n - 2, -1, -1):
            b[i] = lse(t + (own[i + 1] + b[i + 1])[None], 1)
        z = lse(a[-1], 0)
        assert np.abs(np.exp(a + b - z) - posterior[at : at + n]).max() < 1e-9
        for i in range(1, n):
            want += np.exp(a[i - 1][:, None] + t + (own[i] + b[i])[None] - z)
        at += n
    assert np.abs(want - expected).max() < 1e-8


def test_words_switch_language():
    left, right = ["alpha beta gamma delta " * 12] * 30, ["uno dos tres cuatro " * 12] * 30
    model = language.Crf.fit(left + right, ["en"] * 30 + ["es"] * 30)
    words, posterior, _ = model.label(["alpha beta gamma delta beta uno dos tres cuatro dos"])
    assert [model.languages[p.argmax()] for p in posterior] == ["en"] * 5 + ["es"] * 5


def test_ftrl_is_sparse():
    model = toxicity.Ftrl(bits=10)
    rng = np.random.default_rng(1)
    for _ in range(400):
        slots = np.unique(rng.integers(0, 1000, 20))
        label = float(rng.random() < 0.3)
        model.learn(np.unique(np.append(slots, 1010)) if label else slots, label)
    w = model.weights()
    assert w[1010] > 1 and (w != 0).mean() < 0.2


def test_neighbours_are_exact():
    texts = [f"clean text number {i} about things" for i in range(20)] + [f"BAD!! TEXT!! {i}!! SHOUTING!!" for i in range(20)]
    y = np.array([1.0] * 20 + [0.0] * 20)
    counts = quality.counts(texts)
    model = quality.Model.fit(counts, y)
    latent = model.latent(quality.counts(["another clean text of words", "LOUD!! BAD!! WORDS!!", ""]))
    got = model.vote(latent)
    assert got[0] > 0.9 and got[1] < 0.1 and got[2] == model.prior
    cosine = np.rint(latent[:2] @ model.vectors.T / quality.UNIT) / quality.UNIT
    for row, score in zip(cosine, got[:2], strict=True):
        near = sorted(range(40), key=lambda i: (-row[i], i))[: quality.NEIGHBOURS]
        weight = np.maximum(0, row[near]) ** quality.POWER
        assert score == pytest.approx(float((weight * y[near]).sum() / weight.sum()))


def test_words_keep_their_marks():
    assert language.letters("हिन्दी में 3 किताबें।") == ["हिन्दी", "में", "किताबें"]
    assert language.letters("தமிழ் மொழி") == ["தமிழ்", "மொழி"]
    assert language.letters("ที่นี่ กำลัง") == ["ที่นี่", "กำลัง"]
    assert language.letters("café ́ ẍy می‌خواهم") == ["café", "ẍy", "می‌خواهم"]
    assert language.letters("́ ‍ 12") == []
    assert language.letters("\U00011013\U0001103a\U00011022 x\U0001d165y") == ["\U00011013\U0001103a\U00011022", "x\U0001d165y"]
    long = "กำลั" * 60
    assert "".join(language.letters(long)) == long and all(len(w.encode()) <= language.WIDTH for w in language.letters(long))


def test_every_word_gets_a_label(spark):
    hindi = ["यह एक छोटी कहानी है", "हम घर में बैठे हैं", "पानी बहुत ठंडा है", "वह किताब पढ़ती है"] * 8
    english = ["this is a short story", "we are sitting in the house", "the water is very cold", "she reads the book"] * 8
    rows = [(i, t, lang) for i, (t, lang) in enumerate([(t, "hi") for t in hindi] + [(t, "en") for t in english])]
    rows += [(1000, "वह किताब है the water is cold", None), (1001, None, None), (1002, "12 !", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r["doc_id"]: r["words"] for r in language.label_words(df).collect()}
    assert len(got) == len(rows) and got[1001] == [] and got[1002] == []
    mixed = got[1000]
    assert [w["word"] for w in mixed] == language.letters(rows[-3][1])
    assert [w["lang"] for w in mixed] == ["hi"] * 3 + ["en"] * 4 and all(0.5 <= w["p"] <= 1 for w in mixed)
