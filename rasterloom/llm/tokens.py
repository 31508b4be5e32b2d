"""Token-ID output: Parquet list columns that allow selective reads.

Texts are range-partitioned by doc_id and sorted, encoded where they lie, and
written as Parquet with one row per document: ``doc_id``, ``part`` (the range),
``local_start`` (ids before it in its range), ``n_tokens`` and ``ids``.  The file
format is what makes partial reads cheap: row groups of ``ROW_GROUP_BYTES``, small
pages, page indexes on every column (a predicate on doc_id or local_start skips
pages), dictionary encoding where values repeat and delta encoding for the
rising counters.  Positions need no scan of the ids: the global start of a
document is its range's first id plus its ``local_start``, and ranges are added
up from the two narrow columns.

Encoding: a byte-level BPE never merges across the pieces of its splitting
pattern, so texts of plain Latin-1 characters are cut by that pattern and every
distinct piece goes through the library's model once, then comes from a bounded
cache; a text with any other character, with an apostrophe (the pattern's
contractions) or with a special token's string goes to the library whole, as does
every text of any other kind of tokenizer.  Both give the library's ids.

Defined cases: a null text is empty (the end id alone); documents are ordered by
doc_id (null first), repeated ids by the text's hash; an empty table writes an
empty table.
"""

from __future__ import annotations

import codecs
import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import arrow_rows, new_path, tidy

END_ID = 0
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2000
#: Bytes and ids of a piece that the store holds at most, and its places (35 bytes each, 51 if an id needs more than two).
WIDE, MANY = 16, 8
PLACES = 1 << 20
#: Pieces that are asked of the model at once.
LATE_PIECES = 20_000
#: Pieces that the store can't hold and a worker remembers at most, and the longest of them.
LONG_PIECES, LONG_BYTES = 20_000, 256
#: Text that is cut and looked up at once.
BATCH_BYTES = 1 << 18
#: Texts a worker encodes at once.
TEXTS_AT_ONCE = 1024
SCHEMA = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"
# Character classes of the splitting pattern within Latin-1: letters, numbers, signs, white space; 0 ends a text.
_LETTER, _NUMBER, _SIGN, _SPACE, _END = range(5)
_KIND = bytes(
    _END if b == 0 else _SPACE if b in b"\t\n\r " else _LETTER if chr(b).isalpha() else _NUMBER if chr(b).isnumeric() else _SIGN
    for b in range(256)
)
#: Controls, other white space and the soft hyphen aren't in these classes.
_STRANGE = re.compile(rb"[^\t\n\r -~\xa1-\xac\xae-\xff]")
_SAFE = re.compile(rb"[^\t\n\r ](?= )")


def byte_alphabet() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class Store:
    """ids by piece of up to WIDE bytes and MANY ids: a fixed number of places in arrays.

    A mixed 64-bit key gives a piece two places, and a place holds its piece's bytes themselves (two
    words), so pieces that meet there are told apart.  A new piece takes a free place, else one whose piece
    wasn't met since the last that asked for its place, else none: what recurs stays, however many pass.
    """

    def __init__(self, id_type: type[np.unsignedinteger]) -> None:
        self.a, self.b = (np.zeros(PLACES, np.uint64) for _ in range(2))
        self.n, self.met = np.zeros(PLACES, np.uint8), np.zeros(PLACES, bool)
        self.ids = np.zeros((PLACES, MANY), id_type)

    @staticmethod
    def _places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (keys % np.uint64(PLACES)).astype(np.int64), ((keys >> np.uint64(32)) % np.uint64(PLACES)).astype(np.int64)

    def find(self, keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of every piece, -1 if it has none."""
        place, second = self._places(keys)
        other = np.flatnonzero((self.a[place] != a) | (self.b[place] != b))
        second = second[other]
        place[other] = np.where((self.a[second] == a[other]) & (self.b[second] == b[other]), second, -1)
        self.met[place[place >= 0]] = True
        return place

    def take(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces at these places one after another, and their numbers."""
        n = self.n[place].astype(np.int64)
        return self.ids.reshape(-1)[_ranges(place * MANY, n)], n

    def keep(self, keys: np.ndarray, a: np.ndarray, b: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        """Distinct new pieces and their ids, as ``take`` gives them."""
        rows = np.zeros((len(keys), MANY), self.ids.dtype)
        rows[np.arange(MANY) < n[:, None]] = ids
        one, two = self._places(keys)
        full = (self.n[one] > 0) & (self.n[two] > 0)
        place = np.where(full & self.met[one] & self.met[two], -1, np.where((self.n[one] == 0) | (full & ~self.met[one]), one, two))
        at, which = np.unique(place, return_index=True)
        at, which = at[at >= 0], which[at >= 0]
        self.met[one[full]] = self.met[two[full]] = False
        self.a[at], self.b[at], self.n[at], self.met[at], self.ids[at] = a[which], b[which], n[which], False, rows[which]


def _ranges(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ..., then begin[1], ...: n of each."""
    ends = np.cumsum(n)
    return np.repeat(begin - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)


class Encoder:
    """ids of texts as little-endian 32-bit bytes; one per worker process.

    Plain texts go through ``_plain``: a batch is one byte array, the pattern's cuts
    are found from character classes, pieces are looked up by their bytes (two words of
    8 for most), and of those that the store lacks each distinct one is asked of the model.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        config = json.loads(self.tokenizer.to_str())
        splitter = config["pre_tokenizer"] or {}
        self.by_piece = config["normalizer"] is None and config["model"]["type"] == "BPE" and not config["model"].get("dropout") and splitter.get("type") == "ByteLevel" and splitter["use_regex"] and not splitter["add_prefix_space"]
        letters = byte_alphabet()
        self.tokenize = self.tokenizer.model.tokenize
        self.alphabet = "\0" + "".join(letters[b] for b in range(1, 256))
        self.store = Store(np.uint16 if max(self.tokenizer.get_vocab().values()) < 1 << 16 else np.uint32)
        self.long: dict[bytes, bytes] = {}
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, specials)) or r"(?!)")

    def library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def model(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The model's ids of pieces of Latin-1 characters one after another, and their numbers, without the library's bookkeeping for whole texts."""
        ids, n = array("I"), []
        for at in range(0, len(pieces), LATE_PIECES):
            some = pieces[at : at + LATE_PIECES]
            written = codecs.charmap_decode(b"\0".join(some).decode("latin-1").encode(), "strict", self.alphabet)[0].split("\0")
            for piece, text in zip(some, written, strict=True):
                known = self.long.get(piece)
                if known is not None:
                    ids.frombytes(known)
                    n.append(len(known) // 4)
                    continue
                own = [t.id for t in self.tokenize(text)]
                ids.extend(own)
                n.append(len(own))
                if (len(piece) > WIDE or len(own) > MANY) and len(piece) <= LONG_BYTES:
                    if len(self.long) >= LONG_PIECES:
                        self.long.clear()
                    self.long[piece] = array("I", own).tobytes()
        return np.array(ids, "<u4"), np.array(n, np.int64)

    def __call__(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        held: list[bytes] = []
        owner: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal size
            for i, ids in zip(owner, self._plain(held), strict=True):
                out[i] += ids
            held.clear()
            owner.clear()
            size = 0

        for i, text in enumerate(texts):
            raw = self._latin(text)
            if raw is None:
                out[i] = self.library([text])[0]
                continue
            for part in _parts(raw):
                held.append(part)
                owner.append(i)
                size += len(part)
                if size >= BATCH_BYTES:
                    flush()
        flush()
        return out

    def _latin(self, text: str) -> bytes | None:
        """The text as Latin-1 if the class table is the pattern for it, else nothing."""
        if not self.by_piece or "'" in text or ("<" in text and self.special.search(text)):
            return None
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        return None if _STRANGE.search(raw) else raw

    def _plain(self, texts: list[bytes]) -> list[bytes]:
        if not texts:
            return []
        data = b"\0".join(texts) + b"\0"
        chars = np.frombuffer(data, np.uint8)
        kind = np.frombuffer(data.translate(_KIND), np.uint8)
        cut = np.empty(len(kind), bool)
        cut[0] = True
        np.not_equal(kind[1:], kind[:-1], out=cut[1:])
        run = np.flatnonzero(cut[1:] & (kind[1:] < _SPACE)) + 1  # words, numbers and signs that follow something else
        cut[run[chars[run - 1] == 32]] = False  # one blank before them is theirs,
        cut[run[kind[run - 1] == _SPACE] - 1] = True  # and white space gives up its last character
        cut |= kind == _END
        start = np.flatnonzero(cut)
        length = np.diff(np.append(start, len(kind)))
        real = kind[start] != _END
        start, length, text = start[real], length[real], np.cumsum(~real)[real]
        first, second = _words_at(data, start, length)
        code = _mixed(first, second)
        place = self.store.find(code, first, second)
        place[length > WIDE] = -1
        held = place >= 0
        lost = np.flatnonzero(~held)
        new: dict[bytes, int] = {}
        begin = start[lost]
        which = np.array([new.setdefault(data[i:j], len(new)) for i, j in zip(begin.tolist(), (begin + length[lost]).tolist(), strict=True)], np.int64)
        pool, n = self.model(list(new))
        opens = np.cumsum(n) - n
        old, many = self.store.take(place[held])
        numbers = np.empty(len(start), np.int64)
        numbers[held], numbers[lost] = many, n[which]
        ends = np.cumsum(numbers)
        known = np.repeat(held, numbers)
        out = np.empty(len(known), "<u4")
        out[known], out[~known] = old, pool[_ranges(opens[which], n[which])]
        flat = out.tobytes()
        first_of = lost[np.unique(which, return_index=True)[1]]
        fits = (length[first_of] <= WIDE) & (n <= MANY)
        at = first_of[fits]
        self.store.keep(code[at], first[at], second[at], pool[np.repeat(fits, n)], n[fits])
        # The last piece of every text gives its end.
        upto = np.concatenate([np.zeros(1, np.int64), ends])[np.searchsorted(text, np.arange(len(texts) + 1))] * 4
        return [flat[a:b] for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)]


# The lowest 0 .. 8 bytes of a word.
_LOW = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
# Fixed odd multipliers.
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _words_at(data: bytes, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first 8 and the next 8 bytes of every piece; no piece holds a 0, so its own end shows."""
    padded = data + bytes(WIDE)
    words = np.ndarray(len(data) + 8, "<u8", padded, strides=(1,))  # a word at every byte
    return words[start] & _LOW[np.minimum(length, 8)], words[start + 8] & _LOW[np.clip(length - 8, 0, 8)]


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a ^ (a >> np.uint64(29))) * _MIX[0] + (b ^ (b >> np.uint64(31))) * _MIX[1]
    return (h ^ (h >> np.uint64(32))) * _MIX[2]


def _parts(raw: bytes) -> Iterator[bytes]:
    """A long text cut before blanks that follow a visible character: no piece crosses such a place."""
    at = 0
    while len(raw) - at > 2 * BATCH_BYTES:
        m = _SAFE.search(raw, at + BATCH_BYTES)
        if m is None:
            break
        yield raw[at : m.start() + 1]
        at = m.start() + 1
    yield raw[at:] if at else raw


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _encode(path: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, start = encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                piece = batch.slice(at, TEXTS_AT_ONCE)
                ids = [x + end for x in encode([t or "" for t in piece.column("text").to_pylist()])]
                lengths = np.array([len(x) // 4 for x in ids], np.int64)
                ends = np.cumsum(lengths)
                flat = np.frombuffer(b"".join(ids), "<i4")
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(np.full(len(ids), part, np.int32)), pa.array(start + ends - lengths), pa.array(lengths), lists],
                    names=["doc_id", "part", "local_start", "n_tokens", "ids"],
                )
                start += int(ends[-1])

    return run


def encode_documents(documents: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """The rows of the token files, in doc_id order."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return ordered.mapInArrow(tidy(_encode(tokenizer, end_id)), SCHEMA)


def write_tokens(documents: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encode and write; the format's settings are in the module's docstring."""
    options = {
        "parquet.block.size": str(ROW_GROUP_BYTES),
        "parquet.page.size": str(PAGE_BYTES),
        "parquet.page.row.count.limit": str(PAGE_ROWS),
        "parquet.writer.version": "PARQUET_2_0",  # delta encoding where no dictionary is kept
        "parquet.enable.dictionary": "true",
        "parquet.enable.dictionary#doc_id": "false",
        "parquet.enable.dictionary#local_start": "false",
        "parquet.enable.dictionary#ids.list.element": "true",
        "compression": "zstd",
    }
    with arrow_rows(documents.sparkSession, TEXTS_AT_ONCE):
        encode_documents(documents, tokenizer, end_id).write.options(**options).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids; a plan that leaves ``ids`` out doesn't read them."""
    files = spark.read.schema(SCHEMA).parquet(path)
    ranges = files.groupBy("part").agg(F.max(F.col("local_start") + F.col("n_tokens")).alias("__n"))
    # One row per range, that is per file of ROW_GROUP_BYTES and more: two numbers each, 16 MB for a million files.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = ranges.select("part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    return files.join(F.broadcast(firsts), "part").select("doc_id", (F.col("__first") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        offsets, values = lists.offsets.to_numpy(), np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")
        crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digest(tokens: DataFrame) -> DataFrame:
    return tokens.mapInArrow(tidy(_crc), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(documents: DataFrame, tokenizer: str) -> DataFrame:
    """Write the token files to the shared folder and give their digest, read back."""
    spark = documents.sparkSession
    path = new_path(spark, "tokens")
    write_tokens(documents, path, tokenizer)
    return token_digest(read_tokens(spark, path))
