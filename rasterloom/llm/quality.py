"""Quality by nearest-neighbour voting in a latent-semantic space.

A text's terms are its words, its immediately repeated words, and the trigrams of
its character shapes (upper, lower, digit, space, every sign for itself), hashed
into TERMS slots and weighted by log(1 + count) * idf.  A truncated singular value
decomposition of the labelled sample gives RANK latent directions; a labelled
document is its unit vector there.  Those vectors - ``SAMPLE * RANK`` numbers, a
fixed bound - go to every task, which multiplies them with its documents' vectors
in blocks (exact cosines with all labelled vectors, no index), takes the NEIGHBOURS
nearest and lets them vote with similarity ** POWER.

Scores don't depend on how the table is cut: terms, directions and vectors are
rounded to multiples of 1 / UNIT before they are multiplied, so every product is a
sum of whole numbers below 2 ** 53, exact in any order of summation.

The sample is the SAMPLE labelled documents outside the held-out fold whose
hashed ids are smallest, read whole; fitting runs in one executor task.

Defined cases: an empty, null or direction-less text gets the sample's share of
label 1; several labels of one document: the lowest counts; null labels are left
out; equal similarities prefer the earlier labelled document (by the hash of its id,
then of its text); repeated documents are scored one by one; a doc_id with several
texts teaches each of them, equal rows once, and ``SAMPLE`` bounds the texts too; with no labels every score is 0.5; a null doc_id is in no
sample and not held out.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import TEXT_ROWS, arrow_rows, held_out_remainder, sampled, slices, stage, tidy

#: Labelled documents that a model is fitted on, at most.
SAMPLE = 4096
WORD_TERMS, SHAPE_TERMS, REPEAT_TERMS = 2048, 2048, 64
TERMS = WORD_TERMS + SHAPE_TERMS + REPEAT_TERMS
RANK = 48
NEIGHBOURS = 15
POWER = 4
POWER_ITERATIONS = 4
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
#: Documents whose products with all labelled vectors are held at once.
BLOCK = 128
#: Bytes of text whose terms are counted at once.
BYTES_AT_ONCE = 1 << 21
#: What vectors are rounded to; a product of two unit vectors is at most UNIT ** 2 = 2 ** 40 in these.
UNIT = float(1 << 20)
#: What weighted terms are rounded to before their length is taken.
TERM_UNIT = float(1 << 10)

_MIX = np.uint64(0x9E3779B97F4A7C15)
# log(1 + count), from one table for all blocks: the same digits wherever a count stands.
_LOG = np.log1p(np.arange(1 << 16))


def _shapes() -> bytes:
    out = []
    for b in range(256):
        if 65 <= b <= 90:
            out.append(1)
        elif 97 <= b <= 122:
            out.append(2)
        elif 48 <= b <= 57:
            out.append(3)
        elif b >= 128:
            out.append(4)
        elif b in (9, 11, 12, 13, 32):
            out.append(5)
        else:
            out.append(b if b >= 6 else 6)  # every sign for itself
    return bytes(out)


_SHAPE = _shapes()


def _slot(h: np.ndarray, slots: int) -> np.ndarray:
    h = h * _MIX
    return ((h ^ (h >> np.uint64(29))) * _MIX >> np.uint64(40)).astype(np.int64) % slots


def counts(texts: list[bytes | str | None]) -> np.ndarray:
    """Term counts, a row per text."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") if isinstance(t, str) else t for t in texts]
    out = np.zeros((len(raw), TERMS), np.float32)
    words = [t.lower().split() for t in raw]
    lengths = np.array([len(w) for w in words], np.int64)
    flat = [w for x in words for w in x]
    row = np.repeat(np.arange(len(raw)), lengths)
    h = np.fromiter(map(zlib.crc32, flat), np.uint64, len(flat))
    code = row * TERMS + _slot(h, WORD_TERMS)
    if len(flat) > 1:
        same = np.flatnonzero((h[1:] == h[:-1]) & (row[1:] == row[:-1]))
        code = np.concatenate([code, row[same] * TERMS + WORD_TERMS + SHAPE_TERMS + _slot(h[same], REPEAT_TERMS)])
    out += np.bincount(code, minlength=out.size).reshape(out.shape)
    for i, t in enumerate(raw):
        if len(t) > 2:
            s = np.frombuffer(t.translate(_SHAPE), np.uint8).astype(np.uint64)
            tri = (s[:-2] << np.uint64(16)) | (s[1:-1] << np.uint64(8)) | s[2:]
            out[i, WORD_TERMS : WORD_TERMS + SHAPE_TERMS] += np.bincount(_slot(tri, SHAPE_TERMS), minlength=SHAPE_TERMS)
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 1e-9)


def _whole_unit(x: np.ndarray) -> np.ndarray:
    """Rows of whole numbers, at length 1, in whole multiples of 1 / UNIT."""
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]  # whole numbers: exact
    return np.rint(np.divide(x * UNIT, norm, out=np.zeros_like(x), where=norm > 0))


class Model:
    """idf, latent directions, labelled vectors and their labels."""

    def __init__(self, idf: np.ndarray, directions: np.ndarray, vectors: np.ndarray, labels: np.ndarray) -> None:
        self.idf, self.directions, self.vectors, self.labels = idf.astype(float), directions.astype(float), vectors.astype(float), labels.astype(float)
        self.prior = float(labels.mean()) if len(labels) else 0.5

    @staticmethod
    def fit(term_counts: np.ndarray, labels: np.ndarray) -> Model:
        n = len(labels)
        idf = np.log((1.0 + n) / (1.0 + (term_counts > 0).sum(0))).astype(np.float32) + np.float32(1)
        x = _unit(np.log1p(term_counts) * idf)
        rank = min(RANK, n, x.shape[1])
        basis = np.linalg.qr(x.T @ (x @ np.random.default_rng(7).standard_normal((x.shape[1], rank)).astype(np.float32)))[0]
        for _ in range(POWER_ITERATIONS):
            basis = np.linalg.qr(x.T @ (x @ basis))[0]
        u, s, v = np.linalg.svd(x @ basis, full_matrices=False)
        model = Model(idf, np.rint((basis @ v.T).astype(float) * UNIT), np.zeros((0, rank)), labels)
        model.vectors = np.concatenate([model.latent(term_counts[at : at + BLOCK]) for at in range(0, n, BLOCK)])
        return model

    def latent(self, term_counts: np.ndarray) -> np.ndarray:
        """Unit vectors in whole multiples of 1 / UNIT."""
        damped = _LOG[np.minimum(term_counts, len(_LOG) - 1).astype(np.int64)]
        large = np.nonzero(term_counts >= len(_LOG))
        damped[large] = [math.log1p(x) for x in term_counts[large].tolist()]
        terms = _whole_unit(np.rint(damped * (self.idf * TERM_UNIT)))
        return _whole_unit(np.rint(terms @ self.directions / UNIT))

    def vote(self, latent: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest labelled vectors."""
        n = len(self.labels)
        out = np.full(len(latent), self.prior)
        k = min(NEIGHBOURS, n)
        if not k:
            return out
        cosine = np.rint(latent @ self.vectors.T / UNIT).astype(np.int64)
        # Rounded similarities with the index below them: ties go to the earlier vector.
        key = cosine * n + (n - 1 - np.arange(n))
        top = np.partition(key, n - k, axis=1)[:, n - k :]
        top.sort(axis=1)
        near, similarity = n - 1 - top % n, np.maximum(0, top // n) / float(1 << 20)
        weight = similarity**POWER
        total = weight.sum(1)
        voted = total > 0
        out[voted] = (weight * self.labels[near]).sum(1)[voted] / total[voted]
        return np.clip(out, 0.0, 1.0)

    def scores(self, texts: list[bytes | str | None]) -> np.ndarray:
        parts = [self.vote(self.latent(counts(texts[at : at + BLOCK]))) for at in range(0, len(texts), BLOCK)]
        return np.concatenate(parts) if parts else np.zeros(0)


def _fit(sample: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labels: list[float] = []
        terms: list[np.ndarray] = []
        for pdf in parts:
            pdf = pdf.iloc[: sample - len(labels)]
            labels += pdf["y"].astype(float).tolist()
            terms += [counts(pdf["text"].iloc[at : at + BLOCK].tolist()) for at in range(0, len(pdf), BLOCK)]
        if not labels:
            return
        m = Model.fit(np.concatenate(terms), np.array(labels))
        for name, a in (("idf", m.idf), ("directions", m.directions), ("vectors", m.vectors), ("labels", m.labels)):
            a = a.reshape(len(a), -1).astype("<f8")
            yield pd.DataFrame({"name": name, "cols": a.shape[1], "data": [a.tobytes()]})

    return run


def fit(documents: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    own = labels.select("doc_id", label).filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (held_out_remainder(FOLDS) != HELD_OUT))
    chosen = own.groupBy("doc_id").agg(F.min(label).alias("y")).withColumn("o", F.xxhash64("doc_id")).orderBy("o", "doc_id").limit(sample)
    with arrow_rows(documents.sparkSession, BLOCK):
        parts = sampled(documents.select("doc_id", "text"), chosen, ["y"]).mapInPandas(tidy(_fit(sample)), "name string, cols int, data binary").collect()
    got = {r["name"]: np.frombuffer(bytes(r["data"]), "<f8").reshape(-1, r["cols"]) for r in parts}
    if not got:
        return Model(np.zeros(TERMS, float), np.zeros((TERMS, 1), float), np.zeros((0, 1), float), np.zeros(0, float))
    return Model(got["idf"][:, 0], got["directions"], got["vectors"], got["labels"][:, 0])


def _score(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, BLOCK, BYTES_AT_ONCE):
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(model.scores(piece.column("text").cast(pa.binary()).to_pylist()))], names=["doc_id", "score"])

    return run


def score(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = fit(documents, labels)
    rows = documents.select("doc_id", "text")
    kind = dict(rows.dtypes)["doc_id"]
    scored = stage(rows.mapInArrow(tidy(_score(model)), f"doc_id {kind}, score double"), "quality-scores", rows=TEXT_ROWS)
    return scored.select("doc_id", F.coalesce(held_out_remainder(FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
