"""Language ID by a linear-chain conditional random field over words.

Every word of a text gets a language: its features are the word itself (the
lexicon), its first and last 1 to 3 bytes (affixes) and all its byte trigrams, hashed
into SLOTS rows of one weight per language; neighbouring words are tied by learned
transition weights.  Forward-backward gives each word's exact posterior, so text
that switches languages is labelled piece by piece, and the document's language is
the one with most posterior mass over its letters; ``score`` is that share.

Training text must switch too, or the transitions never learn to: the sampled
documents are cut into spans of SPAN words, the spans are shuffled, and sequences
of several spans - each labelled with its own document's language - are what the
likelihood is maximised on (AdaGrad, gradients by the same forward-backward).

Forward-backward over long texts is cut into blocks of STEP words: products of
the block's transition matrices first (all blocks at once), then one pass over
the blocks of a document, then all blocks again from their known ends.  That is
the exact result, vectorised over blocks instead of words.

The sample is the SAMPLE documents outside the held-out fold whose hashed ids are
smallest among those with a language, read whole; fitting runs in one executor
task.  What is broadcast is SLOTS * languages weights.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; a
null lang teaches nothing; runs of letters longer than WIDTH bytes, as scripts without
blanks have them, are labelled in pieces of that length, so a switch inside is seen;
letters are those of Unicode (not figures such as superscripts, fractions or circled
numbers); a doc_id with several texts teaches each of them, equal rows once, and
``SAMPLE`` bounds the texts too; with a single learned language everything with letters is that language; with none everything
is ``und``; ties go to the first language in code-point order; repeated
documents are labelled one by one; a null doc_id is in no sample and not held out.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import TEXT_ROWS, arrow_rows, held_out_remainder, sampled, slices, stage, tidy

#: Documents that a model is fitted on, at most.
SAMPLE = 3000
FOLDS, HELD_OUT = 4, 2
SLOTS = 1 << 16
WIDTH = 32
STEP = 32
SPAN = (8, 48)
SEQUENCE = 128
BATCH = 256
EPOCHS = 2
RATE = 0.2
L2 = 1e-6
#: Words whose weights a worker remembers; when full it starts anew.
CACHE_WORDS = 300_000
#: Documents that are labelled at once, and the words at which a batch closes earlier.
TEXTS_AT_ONCE, WORDS_AT_ONCE = 256, 200_000

# Letters, and letter-like numbers, superscripts and fractions, which are taken out of the few words that have any.
_WORD = re.compile(r"[^\W\d_]+")
# Combining marks (vowel signs, tones) and joiners belong to the letters before them; none comes before U+0300.
# Two classes, as one within the first 65,536 characters is a table and one beyond is searched range by range.
_MARKS, _FAR_MARKS = ("[" + re.escape("".join(c for c in map(chr, range(*span)) if unicodedata.category(c)[0] == "M") + more) + "]" for span, more in (((128, 0x10000), "\u200c\u200d"), ((0x10000, 0x110000), "")))
_LATER, _FAR = re.compile("[\u0300-\U0010ffff]"), re.compile("[\U00010000-\U0010ffff]")
_MARK, _FAR_MARK = re.compile(_MARKS), re.compile(_FAR_MARKS)
_MARKED, _FAR_MARKED = re.compile(rf"(?:[^\W\d_]+{_MARKS}*)+"), re.compile(rf"(?:[^\W\d_]+(?:{_MARKS}|{_FAR_MARKS})*)+")
_FIGURE = re.compile("[" + re.escape("".join(c for c in map(chr, range(128, 0x110000)) if c.isalnum() and not c.isalpha() and not c.isdecimal())) + "]")
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _pattern(text: str) -> re.Pattern[str]:
    """The pattern of words, with marks only where the text has some."""
    if text.isascii() or not _LATER.search(text):
        return _WORD
    if _FAR.search(text) and _FAR_MARK.search(text):
        return _FAR_MARKED
    return _MARKED if _MARK.search(text) else _WORD


def letters(text: str | bytes | None) -> list[str]:
    if text is None:
        return []
    if isinstance(text, bytes):
        text = text.decode("utf-8", "replace")
    text = text.lower()
    words = _pattern(text).findall(text)
    joined = "".join(words)
    if not joined:
        return []
    if not joined.isalpha():
        words = [part for word in words for part in ([word] if word.isalpha() else _FIGURE.sub(" ", word).split())]
        joined = "".join(words)
    if not words or max(map(len, words)) <= WIDTH // _bytes_each(joined):
        return words
    return [part for word in words for part in ([word] if len(word) <= WIDTH // 4 else _cut(word))]


def _bytes_each(word: str) -> int:
    """The most UTF-8 bytes of a character."""
    return 1 if word.isascii() else len(max(word).encode("utf-8", "surrogatepass"))


def _cut(word: str) -> list[str]:
    most = WIDTH // _bytes_each(word)
    return [word[at : at + most] for at in range(0, len(word), most)]


def word_features(words: list[str]) -> np.ndarray:
    """Slots of each word's features, a row per word of up to WIDTH bytes; 0 is no feature."""
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    lexicon = np.fromiter(map(zlib.crc32, raw), np.uint64, len(raw))
    size = np.array([len(w) for w in raw], np.int64)
    grid = np.frombuffer(b"".join(w.ljust(WIDTH, b"\0") for w in raw), np.uint8).reshape(len(raw), WIDTH).astype(np.uint64)

    def slot(kind: int, value: np.ndarray, there: np.ndarray) -> np.ndarray:
        h = (value + np.uint64(kind)) * _M[0]
        h = (h ^ (h >> np.uint64(32)) ^ np.uint64(kind)) * _M[1]
        return np.where(there, (h >> np.uint64(40)).astype(np.int64) % (SLOTS - 1) + 1, 0)

    out = [slot(1, lexicon * _M[2], np.ones(len(raw), bool))]
    at = np.arange(len(raw))
    head, tail = np.zeros(len(raw), np.uint64), np.zeros(len(raw), np.uint64)
    for k in range(1, 4):
        head = (head << np.uint64(8)) | grid[:, k - 1]
        tail = tail | (grid[at, np.maximum(size - k, 0)] << np.uint64(8 * (k - 1)))
        out += [slot(10 + k, head, size >= k), slot(20 + k, tail, size >= k)]
    longest = int(size.max(initial=0))
    for j in range(max(0, longest - 2)):
        tri = (grid[:, j] << np.uint64(16)) | (grid[:, j + 1] << np.uint64(8)) | grid[:, j + 2]
        out.append(slot(30, tri, size >= j + 3))
    return np.stack(out, 1) if len(raw) else np.zeros((0, 7), np.int64)


def forward_backward(emission: np.ndarray, lengths: np.ndarray, transition: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of every word, and expected transitions summed over all of them.

    ``emission`` has the log weights of all sequences' words one after another.
    """
    n, k = emission.shape
    lengths = lengths[lengths > 0]
    if not n:
        return np.zeros((0, k)), np.zeros((k, k))
    e = np.exp(emission - emission.max(1, keepdims=True)) + 1e-30
    t = np.exp(transition - transition.max())
    blocks = -(-lengths // STEP)
    first_block = np.concatenate([[0], np.cumsum(blocks)])[:-1]
    first_word = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    n_blocks = int(blocks.sum())
    sequence = np.repeat(np.arange(len(lengths)), blocks)
    order = np.arange(n_blocks) - first_block[sequence]
    begin = first_word[sequence] + order * STEP
    size = np.minimum(STEP, lengths[sequence] - order * STEP)
    # The first word of a sequence has no transition: it is multiplied in at its start.
    opens = order == 0
    product = np.broadcast_to(np.eye(k), (n_blocks, k, k)).copy()
    for j in range(STEP):
        use = np.flatnonzero((size > j) & ~(opens & (j == 0)))
        if len(use):
            p = (product[use].reshape(-1, k) @ t).reshape(-1, k, k) * e[begin[use] + j][:, None, :]
            product[use] = p / p.max(axis=(1, 2), keepdims=True)
    # alpha before the first word of each block (after the first word, for opening blocks), beta after its last.
    alpha_in, beta_out = np.ones((n_blocks, k)), np.ones((n_blocks, k))
    state = np.exp(start - start.max()) * e[first_word]
    by_length = np.argsort(-blocks, kind="stable")
    counted = np.sort(blocks)
    for b in range(int(blocks.max())):
        live = by_length[: len(blocks) - np.searchsorted(counted, b, "right")]
        at = first_block[live] + b
        alpha_in[at] = state[live]
        s = np.einsum("ni,nij->nj", state[live], product[at])
        state[live] = s / s.max(1, keepdims=True)
    back = np.ones((len(lengths), k))
    for b in range(int(blocks.max())):
        live = by_length[: len(blocks) - np.searchsorted(counted, b, "right")]
        at = first_block[live] + blocks[live] - 1 - b
        beta_out[at] = back[live]
        s = np.einsum("nij,nj->ni", product[at], back[live])
        back[live] = s / s.max(1, keepdims=True)
    alpha = np.empty((n, k))
    run = alpha_in.copy()
    before = np.empty((n, k))  # alpha of the word before, for expected transitions
    for j in range(STEP):
        use = np.flatnonzero(size > j)
        if not len(use):
            break
        at = begin[use] + j
        stay = opens[use] & (j == 0)
        a = np.where(stay[:, None], run[use], (run[use] @ t) * e[at])
        before[at] = run[use]
        run[use] = alpha[at] = a / a.max(1, keepdims=True)
    posterior = np.empty((n, k))
    expected = np.zeros((k, k))
    run = beta_out.copy()
    for j in range(STEP - 1, -1, -1):
        use = np.flatnonzero(size > j)
        if not len(use):
            continue
        at = begin[use] + j
        p = alpha[at] * run[use]
        posterior[at] = p / p.sum(1, keepdims=True)
        stepped = ~(opens[use] & (j == 0))
        forward = e[at] * run[use]
        if stepped.any():
            pair = before[at][stepped][:, :, None] * t[None] * forward[stepped][:, None, :]
            expected += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(0)
        b = forward @ t.T
        run[use] = b / b.max(1, keepdims=True)
    return posterior, expected


class Crf:
    def __init__(self, languages: list[str], weights: np.ndarray, transition: np.ndarray, start: np.ndarray) -> None:
        self.languages, self.weights, self.transition, self.start = languages, weights, transition, start
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, len(languages)))

    @staticmethod
    def fit(texts: list[str], labels: list[str]) -> Crf:
        languages = sorted(set(labels))
        k = len(languages)
        model = Crf(languages, np.zeros((SLOTS, k)), np.zeros((k, k)), np.zeros(k))
        rng = np.random.default_rng(11)
        vocabulary: dict[str, int] = {}
        spans: list[tuple[list[int], int]] = []
        for text, label in zip(texts, labels, strict=True):
            ids = [vocabulary.setdefault(w, len(vocabulary)) for w in letters(text)]
            at = 0
            while at < len(ids):
                n = int(rng.integers(*SPAN))
                spans.append((ids[at : at + n], languages.index(label)))
                at += n
        if not spans or k < 2:
            return model
        features = word_features(list(vocabulary))
        g_w, g_t, g_s = np.full((SLOTS, k), 1e-8), np.full((k, k), 1e-8), np.full(k, 1e-8)
        for _ in range(EPOCHS):
            sequences: list[tuple[list[int], list[int]]] = [([], [])]
            for i in rng.permutation(len(spans)):
                ids, y = spans[i]
                if len(sequences[-1][0]) >= SEQUENCE:
                    sequences.append(([], []))
                sequences[-1][0].extend(ids)
                sequences[-1][1].extend([y] * len(ids))
            for at in range(0, len(sequences), BATCH):
                part = [s for s in sequences[at : at + BATCH] if s[0]]
                words = np.array([w for s in part for w in s[0]])
                gold = np.array([y for s in part for y in s[1]])
                lengths = np.array([len(s[0]) for s in part])
                distinct, inverse = np.unique(words, return_inverse=True)
                slots = features[distinct]
                emission = (model.weights[slots] * (slots > 0)[:, :, None]).sum(1)
                posterior, expected = forward_backward(emission[inverse], lengths, model.transition, model.start)
                first = np.concatenate([[0], np.cumsum(lengths)])[:-1]
                residual = -posterior
                residual[np.arange(len(gold)), gold] += 1
                by_word = np.stack([np.bincount(inverse, residual[:, c], len(distinct)) for c in range(k)], 1)
                rows, counts = slots.ravel(), slots.shape[1]
                gradient = np.stack([np.bincount(rows, np.repeat(by_word[:, c], counts), SLOTS) for c in range(k)], 1)
                gradient[0] = 0
                observed = np.zeros((k, k))
                inner = np.ones(len(gold), bool)
                inner[first] = False
                np.add.at(observed, (gold[np.flatnonzero(inner) - 1], gold[inner]), 1)
                for value, total, g in ((model.weights, g_w, gradient - L2 * model.weights), (model.transition, g_t, observed - expected), (model.start, g_s, residual[first].sum(0))):
                    total += g * g
                    value += RATE * g / np.sqrt(total)
        return model

    def emissions(self, words: list[str]) -> np.ndarray:
        if len(self.known) > CACHE_WORDS:
            self.known, self.rows = {}, np.zeros((0, len(self.languages)))
        new = list(dict.fromkeys(w for w in words if w not in self.known))
        if new:
            made = []
            for at in range(0, len(new), 20_000):
                slots = word_features(new[at : at + 20_000])
                total = np.zeros((len(slots), len(self.languages)))
                for column in slots.T:
                    total += self.weights[column] * (column > 0)[:, None]
                made.append(total)
            self.known.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
            self.rows = np.concatenate([self.rows, *made])
        return self.rows[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]

    def label(self, texts: list[str | bytes | None]) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
        """Words of each text, their posteriors one after another, and the number of words."""
        lists = [letters(t) for t in texts]
        lengths = np.array([len(x) for x in lists], np.int64)
        flat = [w for x in lists for w in x]
        if not self.languages or not flat:
            return lists, np.zeros((0, len(self.languages))), lengths
        return lists, forward_backward(self.emissions(flat), lengths, self.transition, self.start)[0], lengths

    def predict(self, texts: list[str | bytes | None]) -> tuple[list[str], np.ndarray]:
        lists, posterior, lengths = self.label(texts)
        if not len(posterior):
            return ["und"] * len(texts), np.zeros(len(texts))
        row = np.repeat(np.arange(len(texts)), lengths)
        weight = np.array([len(w) for x in lists for w in x], float)
        mass = np.stack([np.bincount(row, posterior[:, c] * weight, len(texts)) for c in range(posterior.shape[1])], 1)
        total = mass.sum(1)
        best = mass.argmax(1)
        share = np.divide(mass.max(1), total, out=np.zeros(len(texts)), where=total > 0)
        return [self.languages[b] if t > 0 else "und" for b, t in zip(best, total, strict=True)], np.clip(share, 0.0, 1.0)


def _fit(sample: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts: list[str] = []
        langs: list[str] = []
        for pdf in parts:
            pdf = pdf.iloc[: sample - len(texts)]
            texts += pdf["text"].tolist()
            langs += pdf["lang"].tolist()
        m = Crf.fit(texts, langs)
        for i, lang in enumerate(m.languages):
            kept = np.flatnonzero(m.weights[:, i]).astype("<i4")
            yield pd.DataFrame({"lang": lang, "slots": [kept.tobytes()], "weights": [m.weights[kept, i].astype("<f8").tobytes()], "arrive": [m.transition[:, i].astype("<f8").tobytes()], "start": m.start[i]})

    return run


def fit(documents: DataFrame, sample: int = SAMPLE) -> Crf:
    own = documents.select("doc_id", "text", "lang").filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & (held_out_remainder(FOLDS) != HELD_OUT))
    chosen = own.select("doc_id").distinct().withColumn("o", F.xxhash64("doc_id")).orderBy("o", "doc_id").limit(sample)
    with arrow_rows(documents.sparkSession, TEXTS_AT_ONCE):
        parts = sampled(own, chosen, ["lang"]).mapInPandas(tidy(_fit(sample)), "lang string, slots binary, weights binary, arrive binary, start double").collect()
    got = sorted(parts, key=lambda r: r["lang"])
    k = len(got)
    weights, transition = np.zeros((SLOTS, k)), np.zeros((k, k))
    for i, r in enumerate(got):
        weights[np.frombuffer(bytes(r["slots"]), "<i4"), i] = np.frombuffer(bytes(r["weights"]), "<f8")
        transition[:, i] = np.frombuffer(bytes(r["arrive"]), "<f8")
    return Crf([r["lang"] for r in got], weights, transition, np.array([r["start"] for r in got]))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A word takes about six bytes."""
    for batch in batches:
        yield from slices(batch, TEXTS_AT_ONCE, 6 * WORDS_AT_ONCE)


def _predict(model: Crf) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            languages, share = model.predict(piece.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(languages, pa.string()), pa.array(share)], names=["doc_id", "lang_pred", "score"])

    return run


def identify(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    model = fit(documents)
    rows = documents.select("doc_id", "text")
    kind = dict(rows.dtypes)["doc_id"]
    done = stage(rows.mapInArrow(tidy(_predict(model)), f"doc_id {kind}, lang_pred string, score double"), "language", rows=TEXT_ROWS)
    return done.select("doc_id", F.coalesce(held_out_remainder(FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score")


def label_words(documents: DataFrame) -> DataFrame:
    """Every document's words in order, each with its most likely language and posterior."""
    model = fit(documents)
    rows = documents.select("doc_id", "text")
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            lists, posterior, _ = model.label(piece.column("text").to_pylist())
            out, at = [], 0
            for words in lists:
                p = posterior[at : at + len(words)]
                at += len(words)
                out.append([{"word": w, "lang": model.languages[int(x.argmax())], "p": float(x.max())} for w, x in zip(words, p, strict=True)] if len(p) else [])
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(out, pa.list_(pa.struct([("word", pa.string()), ("lang", pa.string()), ("p", pa.float64())])))], names=["doc_id", "words"])

    return rows.mapInArrow(run, f"doc_id {kind}, words array<struct<word:string,lang:string,p:double>>")
