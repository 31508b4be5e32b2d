"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams.

Features of a text are presence bits: its words, word pairs, skip-grams (a word
and the next but one) and word heads (the first HEAD letters, for inflected
forms), hashed into ``2 ** bits`` slots.  FTRL-proximal keeps a gradient sum and a
squared-gradient sum per slot, so every coordinate has its own learning rate, and
its L1 term leaves only the slots with steady evidence: the weights that are
broadcast are a few thousand (slot, weight) pairs, and never more than there are slots.

Fitting takes a bounded sample: the ``SAMPLE`` labelled documents outside the
held-out fold whose hashed ids are smallest, read whole.  It runs in one task on
an executor (bounded input, repeated if the executor is lost), in the order of the
hash, then of the text's hash, so reruns agree however the tables are cut.  Scoring is one pass over all documents without a shuffle.

Defined cases: a null or wordless text has no features and scores the bias;
several labels of one document: toxic if any says so; null labels are left out;
repeated documents are scored one by one; a doc_id with several texts teaches each of
them, equal rows once, and ``SAMPLE`` bounds the texts too; with no labels at all every score is
the prior 0.5 less a hair, so nothing is called toxic; a null doc_id is in no
sample and not held out (its fold is unknown), and is scored like any other.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import TEXT_ROWS, arrow_rows, held_out_remainder, sampled, slices, stage, tidy
from rasterloom.llm.decontaminate import words_of

#: Labelled documents that a model is fitted on, at most.
SAMPLE = 20_000
BITS = 20
HEAD = 5
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 5.0, 0.0
FOLDS, HELD_OUT = 5, 0
#: Rows, and bytes of text, whose features are made at once in scoring; rows in fitting.
ROWS_AT_ONCE, BYTES_AT_ONCE, FIT_ROWS = 256, 1 << 20, 128

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def _slots(h: np.ndarray, bits: int) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    return ((h * _MIX[0]) >> np.uint64(64 - bits)).astype(np.int64)


def feature_slots(texts: list[bytes | str | None], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of every feature occurrence in the texts."""
    lists = [words_of(t) for t in texts]
    lengths = np.array([len(x) for x in lists], np.int64)
    flat = [w for x in lists for w in x]
    words = np.fromiter(map(zlib.crc32, flat), np.uint64, len(flat))
    heads = np.fromiter(map(zlib.crc32, [w[:HEAD] for w in flat]), np.uint64, len(flat))
    row = np.repeat(np.arange(len(lists)), lengths)
    parts = [(row, _slots(words * _MIX[1], bits)), (row, _slots((heads + np.uint64(1)) * _MIX[5], bits))]
    for gap, (a, b) in ((1, (2, 3)), (2, (3, 4))):
        if len(flat) > gap:
            same = row[gap:] == row[:-gap]
            mixed = words[:-gap] * _MIX[a] + (words[gap:] ^ np.uint64(gap)) * _MIX[b]
            parts.append((row[:-gap][same], _slots(mixed[same], bits)))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


class Ftrl:
    """FTRL-proximal with one state per slot and an unpenalised bias."""

    def __init__(self, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> None:
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.bias, self.bias_n = 0.0, 0.0

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[at]
        rate = (self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / rate)

    def learn(self, slots: np.ndarray, label: float) -> None:
        w = self.weights(slots)
        p = sigmoid(self.bias + w.sum())
        g = p - label
        root = np.sqrt(self.n[slots])
        self.n[slots] += g * g
        self.z[slots] += g - (np.sqrt(self.n[slots]) - root) / self.alpha * w
        self.bias_n += g * g
        self.bias -= self.alpha / (self.beta + self.bias_n**0.5) * g


def sigmoid(x: float) -> float:
    return float(1.0 / (1.0 + np.exp(-np.clip(x, -40.0, 40.0))))


def _fit(bits: int, sample: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Features of a chunk of rows are one array: 4 bytes each, and all that is held of the texts.
        learnt: list[tuple[np.ndarray, np.ndarray, list[float]]] = []  # features, first feature of each row, labels
        left = sample
        for pdf in parts:
            for at in range(0, min(len(pdf), left), FIT_ROWS):
                piece = pdf.iloc[at : min(at + FIT_ROWS, left)]
                row, slot = feature_slots(piece["text"].tolist(), bits)
                code = np.unique(row * (1 << bits) + slot)
                cuts = np.searchsorted(code, np.arange(len(piece) + 1) * (1 << bits))
                learnt.append(((code & ((1 << bits) - 1)).astype(np.int32), cuts, piece["y"].astype(float).tolist()))
            left = max(0, left - len(pdf))
        model = Ftrl(bits)
        for _ in range(EPOCHS):
            for features, cuts, labels in learnt:
                for b, e, label in zip(cuts.tolist(), cuts[1:].tolist(), labels, strict=False):
                    model.learn(features[b:e], label)
        w = model.weights()
        kept = np.flatnonzero(w)
        yield pd.DataFrame({"slot": np.concatenate([[-1], kept]), "w": np.concatenate([[model.bias if learnt else -1e-6], w[kept]])})

    return run


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, bits: int = BITS) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, slots and weights, from labelled documents outside the held-out fold."""
    own = labels.select("doc_id", label).filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (held_out_remainder(FOLDS) != HELD_OUT))
    chosen = own.groupBy("doc_id").agg(F.max(label).alias("y")).withColumn("o", F.xxhash64("doc_id")).orderBy("o", "doc_id").limit(sample)
    with arrow_rows(documents.sparkSession, FIT_ROWS):
        got = sampled(documents.select("doc_id", "text"), chosen, ["y"]).mapInPandas(tidy(_fit(bits, sample)), "slot long, w double").toPandas()
    bias = float(got.loc[got["slot"] < 0, "w"].iloc[0]) if len(got) else -1e-6
    got = got[got["slot"] >= 0].sort_values("slot")
    return bias, got["slot"].to_numpy(np.int64), got["w"].to_numpy(float)


def scores(texts: list[bytes | str | None], bias: float, dense: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Scores of texts; ``dense`` has a weight for every slot."""
    row, slot = feature_slots(texts, bits)
    used = dense[slot] != 0
    code = np.unique(row[used] * (1 << bits) + slot[used])
    total = np.bincount(code >> bits, weights=dense[code & ((1 << bits) - 1)], minlength=len(texts)) + bias
    return 1.0 / (1.0 + np.exp(-np.clip(total, -40.0, 40.0)))


def _score(bias: float, slots: np.ndarray, weights: np.ndarray, bits: int, append: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(1 << bits)
        dense[slots] = weights
        for batch in batches:
            for piece in slices(batch, ROWS_AT_ONCE, BYTES_AT_ONCE):
                p = scores(piece.column("text").cast(pa.binary()).to_pylist(), bias, dense, bits)
                if append:
                    yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(p)], names=["doc_id", "score"])
                else:
                    yield piece.filter(pa.array(p < 0.5))

    return run


def score(documents: DataFrame, labels: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    bias, slots, weights = fit(documents, labels, bits=bits)
    rows = documents.select("doc_id", "text")
    kind = dict(rows.dtypes)["doc_id"]
    scored = stage(rows.mapInArrow(tidy(_score(bias, slots, weights, bits, True)), f"doc_id {kind}, score double"), "toxicity-scores", rows=TEXT_ROWS)
    return scored.select("doc_id", F.coalesce(held_out_remainder(FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def remove(documents: DataFrame, labels: DataFrame, bits: int = BITS) -> DataFrame:
    """The documents that aren't predicted toxic, all columns kept."""
    bias, slots, weights = fit(documents, labels, bits=bits)
    return documents.mapInArrow(tidy(_score(bias, slots, weights, bits, False)), documents.schema)
