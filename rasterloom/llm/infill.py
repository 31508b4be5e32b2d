"""Fill-in-the-middle transformation by bit-parallel big integers.

A text's UTF-8 bytes become one integer per class: ``bytes.translate`` maps every
byte to ``0`` or ``1`` and ``int(..., 2)`` reads them as bits, byte i as bit i.
Shifted boolean operations on these masks mark where units begin: a line after a
newline, a word where a word byte follows another, a character at its lead byte.
``bit_count`` of the marks is the number n of units, and the byte at which a
unit begins is the select of a ranked bit, found by halving the mask again and
again (the halves' sizes sum to the mask's, so a cut costs one pass).

Two draws of a hash of (seed, doc_id) choose two ranks; the text is cut there into
prefix, middle and suffix, and a third and fourth draw choose whether and in which
order the parts are written behind their sentinels.  ``restore`` undoes it from the
output and the form alone: a text that contains a sentinel stays plain, so parts
hold none, and no sentinel can arise across a border as none begins inside another.

No shuffle: rows are transformed where they lie, a bounded batch at a time.

Defined cases: a null or empty text is plain, empty and has no units; a text that
holds a sentinel stays plain; a null doc_id draws like the text ``null``; repeated
rows give repeated results; a text is one value in one task whatever its length
(some bits per byte beside it); columns other than doc_id and text are not read, so
their names can't clash; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import slices, tidy

#: Rows and bytes of text that are worked on at once.
ROWS, BYTES = 1024, 8 << 20
UNITS = ("lines", "words", "chars")
FORMS = ("plain", "psm", "spm")


@dataclass(frozen=True)
class Spec:
    """``rate`` and ``spm`` are percentages: of texts to transform, and of these to write suffix first."""

    seed: int = 7
    unit: str = "lines"
    rate: int = 100
    spm: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        if self.unit not in UNITS:
            raise ValueError(f"unit is one of {', '.join(UNITS)}")
        marks = self.sentinels
        if len(set(marks)) < 3 or any(len(m) < 2 or m[0] in m[1:] or m[0] != marks[0][0] for m in marks):
            raise ValueError("three different sentinels of at least two characters, all beginning with one that none holds again")
        if any(a != b and b.startswith(a) for a in marks for b in marks):
            raise ValueError("no sentinel begins another")

    @property
    def sentinels(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def _class(holds) -> bytes:
    """A translation of every byte to the digit 1 if ``holds``, else 0."""
    return bytes(49 if holds(b) else 48 for b in range(256))


_NEWLINE = _class(lambda b: b == 10)
_BLANK = _class(lambda b: b == 32 or 9 <= b <= 13)
_LEAD = _class(lambda b: b & 0xC0 != 0x80)


def mask(raw: bytes, table: bytes) -> int:
    """Bit i is set if byte i is in the class."""
    return int(raw.translate(table)[::-1] or b"0", 2)


def starts(raw: bytes, unit: str) -> int:
    """Bit i is set if a unit begins at byte i.

    Lines end with their newline; words take the blanks before them along (blanks at
    the end belong to the last word, or are one unit alone); characters are code points.
    """
    if not raw:
        return 0
    full = (1 << len(raw)) - 1
    if unit == "lines":
        return (mask(raw, _NEWLINE) << 1 | 1) & full
    if unit == "chars":
        return mask(raw, _LEAD)
    blank = mask(raw, _BLANK)
    word = ~blank & full
    first = word & ~(word << 1)  # the first byte of every word
    ends = word & ~(word >> 1)  # the last
    behind = ends << 1 & full
    if not first:
        return 1
    last = 1 << (ends.bit_length() - 1)
    return (behind & (last - 1)) | 1


def select(bits: int, rank: int) -> int:
    """The place of the set bit of this rank (from 0), by halving."""
    at, width = 0, bits.bit_length()
    while width > 1:
        half = width >> 1
        low = bits & ((1 << half) - 1)
        n = low.bit_count()
        if rank < n:
            bits, width = low, half
        else:
            bits, rank, at, width = bits >> half, rank - n, at + half, width - half
    return at


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """The four draws of a document."""
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[8 * i : 8 * i + 8], 16) for i in range(4))


def cut(raw: bytes, doc_id: int | None, spec: Spec) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, characters of prefix and middle (None if plain) and the output of one text."""
    marks = starts(raw, spec.unit)
    n = marks.bit_count()
    h1, h2, h3, h4 = draws(spec.seed, doc_id)
    p, s, m = (x.encode() for x in spec.sentinels)
    if not raw or p in raw or s in raw or m in raw or h3 % 100 >= spec.rate:
        return n, "plain", None, None, raw
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    one, two = (len(raw) if r == n else select(marks, r) for r in (a, b))
    leads = mask(raw, _LEAD)
    chars = lambda end: (leads & ((1 << end) - 1)).bit_count()
    before, within = chars(one), chars(two)
    prefix, middle, suffix = raw[:one], raw[one:two], raw[two:]
    if h4 % 100 < spec.spm:
        return n, "spm", before, within - before, s + suffix + p + prefix + m + middle
    return n, "psm", before, within - before, p + prefix + s + suffix + m + middle


_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def transform(documents: DataFrame, spec: Spec | None = None) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every document."""
    spec = spec or Spec()
    fields = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, ROWS, BYTES):
                ids = batch.column("doc_id").to_pylist()
                texts = batch.column("text").cast(pa.binary()).to_pylist()
                rows = [(d, *cut(t or b"", d, spec)) for d, t in zip(ids, texts, strict=True)]
                columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
                columns[5] = [x.decode() for x in columns[5]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, fields, strict=True)], names)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(work), _SCHEMA)


def _literal(text: str) -> str:
    """``text`` as a regular expression for itself, whatever it holds."""
    return "".join(f"\\x{{{ord(c):x}}}" for c in text)


def restore(output: Column, form: Column, spec: Spec | None = None) -> Column:
    """The exact text, from the output and its form alone."""
    spec = spec or Spec()
    parts = F.split(output, "|".join(_literal(m) for m in spec.sentinels), -1)
    part = lambda i: F.get(parts, F.lit(i))
    psm, spm = F.concat(part(1), part(3), part(2)), F.concat(part(2), part(3), part(1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest(transformed: DataFrame, spec: Spec | None = None) -> DataFrame:
    """The outputs and the texts restored from them, as hashes."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return transformed.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"), spec)).alias("restored_sha256")
    )
