r"""Information-theoretic sanitisation of personal data, by DataFrame functions only.

*Protected entities* are the e-mail addresses, IP addresses, card and phone numbers
that patterns find in whole texts.  Masking them isn't enough if a word beside them
gives them away, so the corpus itself tells how much a word reveals:

* The event space is the word positions of all documents.  An entity's *windows* are the
  positions within CONTEXT characters of its occurrences (up to the next match of the
  same kind); p(e) is the windows' share of all positions and IC(e) = -log2 p(e).
* p(e|t) is the share of a term's occurrences, counted over the whole corpus, that lie in
  windows of e, and PMI(e; t) = log2(p(e|t) / p(e)) is what t tells about e.
* A term *discloses* e if PMI(e; t) >= THRESHOLD * IC(e), and if at least SUPPORT different
  contexts of e hold it.  Contexts are told apart by the least and the largest hash of their words,
  so that copies of a passage, and near copies but for the chance of a change in these two words, are one.

A disclosing term is *generalised* to its first HEAD letters if the class of words that
begin so doesn't disclose e in turn, else *removed*; only where it lies in a window of
that e.  It is a span of kind ``term``, beside the base spans, which all stay.

Patterns are cut from the text by ``split`` and ``regexp_extract_all`` in step, so lengths
of the pieces give places.  They are written with possessive loops and starts after
``\G`` or a foreign character: the same matches as the plain patterns', found in linear time
and without recursion on texts of any length.

Hot cases: a document's matches are rows of their own; counts of (entity, term, context)
and of terms are aggregated before they are shuffled; the join of windows with disclosing
terms sends terms that hold more than a thousandth of all window positions (so, at
most a thousand) to all tasks and shuffles the others.

Defined cases: a null text is empty; empty texts, and texts without matches, have no
spans; matches that fail their check (parts over 255, too few or many digits, Luhn) are
dropped and not tried again; spans of different kinds may overlap, and a term that overlaps a base span is no span;
repeated rows and repeated or null ids are rows of their own throughout;
columns other than doc_id and text are carried by ``sanitise`` and not read by ``find``;
an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.llm.common import join_hot, stage

KINDS = ("email", "ip", "card", "phone", "term")
TERM = len(KINDS) - 1
#: What stands in the text for a span of each base kind.
TAGS = ("<EMAIL>", "<IP>", "<CARD>", "<PHONE>")
CONTEXT = 64
THRESHOLD = 0.9
SUPPORT = 3
HEAD = 3

_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = (
    rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: What a text must hold to be searched for a kind at all.
_NEEDED = (r"@", r"[0-9]\.[0-9]", r"[0-9][\x20-]?[0-9]", r"\+[0-9]")
_PART = r"0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
#: A term: a run of ASCII letters and of whatever lies beyond ASCII.
WORD = r"[A-Za-z\x{80}-\x{10FFFF}]+"
_FOUND = "array<struct<kind:int,i:int,before:long,bytes_before:long,value:string,left:string,right:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether 14 to 19 digits pass: every second one from the right counts doubled, less 9 beyond 9."""
    d = F.lpad(digits, 20, "0")
    doubled = F.translate(d, "0123456789", "0246813579")
    total = F.lit(0)
    for i in range(1, 21):
        total = total + F.substring(doubled if i % 2 else d, i, 1).cast("int")
    return total % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    digits = _digits(value)
    n = F.length(digits)
    return (
        F.when(kind == 0, F.lit(True))
        .when(kind == 1, value.rlike(rf"^(?:{_PART}\.){{3}}{_PART}$"))
        .when(kind == 2, F.when(n.between(14, 19), _luhn(digits)).otherwise(F.lit(False)))
        .otherwise(n.between(10, 15))
    )


def _entity(kind: Column, value: Column) -> Column:
    """The protected value however it is written: its kind, then lower case or digits alone."""
    plain = F.when(kind == 0, F.lower(value)).when(kind == 1, value).otherwise(_digits(value))
    return F.concat(kind.cast("string"), F.lit(":"), plain)


def _located(kind: int) -> Callable[[Column, Column], Column]:
    """A match and what lies around it, from the pieces that ``split`` left."""

    def one(value: Column, i: Column) -> Column:
        left, right = F.get(f"p{kind}", i), F.get(f"p{kind}", i + 1)
        return F.struct(
            F.lit(kind).alias("kind"),
            i.alias("i"),
            F.length(left).cast("long").alias("before"),
            F.octet_length(left).cast("long").alias("bytes_before"),
            value.alias("value"),
            F.right(left, F.lit(CONTEXT + 1)).alias("left"),
            F.left(right, F.lit(CONTEXT + 1)).alias("right"),
        )

    return one


def matches(documents: DataFrame) -> DataFrame:
    """A row for every match of every document, and one with a null kind for documents without; staged.

    ``documents`` has row, doc_id and text. before and bytes_before are the lengths of what lies
    between a match and the one before it; left and right its contexts, of CONTEXT + 1 characters at most.
    """
    rows = documents
    for k, (pattern, needed) in enumerate(zip(PATTERNS, _NEEDED, strict=True)):
        has = F.col("text").rlike(needed)
        rows = rows.withColumn(f"m{k}", F.when(has, F.regexp_extract_all("text", F.lit(pattern), 0)))
        rows = rows.withColumn(f"p{k}", F.when(F.size(f"m{k}") > 0, F.split("text", pattern, -1)))
    lists = [F.when(F.size(f"m{k}") > 0, F.transform(f"m{k}", _located(k))).otherwise(F.array().cast(_FOUND)) for k in range(len(PATTERNS))]
    return stage(rows.select("row", "doc_id", F.explode_outer(F.concat(*lists)).alias("m")).select("row", "doc_id", "m.*"), "pii-matches")


def base_spans(found: DataFrame) -> DataFrame:
    """``found``'s matches that pass their check, with start, end, byte_start, byte_end and entity."""
    upto = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    length, octets = F.length("value").cast("long"), F.octet_length("value").cast("long")
    placed = found.filter(F.col("kind").isNotNull()).withColumns({"end": F.sum(F.col("before") + length).over(upto), "byte_end": F.sum(F.col("bytes_before") + octets).over(upto)})
    placed = placed.withColumns({"start": F.col("end") - length, "byte_start": F.col("byte_end") - octets})
    return placed.filter(_valid(F.col("kind"), F.col("value"))).withColumn("entity", _entity(F.col("kind"), F.col("value")))


def _words(text: Column) -> Column:
    """Array of (word, at, bytes_at) of a short text."""
    found, pieces = F.regexp_extract_all(text, F.lit(WORD), 0), F.split(text, WORD, -1)

    def at(i: Column, length) -> Column:
        both = lambda a, n: F.aggregate(F.slice(a, F.lit(1), n), F.lit(0).cast("long"), lambda acc, x: acc + length(x).cast("long"))
        return both(pieces, i + 1) + both(found, i)

    return F.transform(found, lambda w, i: F.struct(w.alias("word"), at(i, F.length).alias("at"), at(i, F.octet_length).alias("bytes_at")))


def windows(spans: DataFrame) -> DataFrame:
    """row, entity, term, start, end, byte_start, byte_end and context of every word in a window, each position once an entity."""
    left = F.filter(_words(F.col("left")), lambda w: (w["at"] > 0) | (F.length("left") <= CONTEXT))
    right = F.filter(_words(F.col("right")), lambda w: (w["at"] + F.length(w["word"]) <= CONTEXT) | (F.length("right") <= CONTEXT))
    moved = lambda words, by, octets: F.transform(words, lambda w: F.struct(w["word"].alias("word"), (by + w["at"]).alias("at"), (octets + w["bytes_at"]).alias("bytes_at")))
    every = F.concat(moved(left, F.col("start") - F.length("left"), F.col("byte_start") - F.octet_length("left")), moved(right, F.col("end"), F.col("byte_end")))
    hashes = F.transform("every", lambda w: F.md5(F.lower(w["word"]).cast("binary")))
    ends = F.concat(F.array_min("hashes"), F.array_max("hashes"))
    rows = spans.withColumn("every", every).withColumn("hashes", hashes).select("row", "doc_id", "entity", ends.alias("context"), F.explode("every").alias("w"))
    rows = rows.select("row", "doc_id", "entity", "context", F.lower(F.col("w")["word"]).alias("term"), F.col("w")["word"].alias("word"), F.col("w")["at"].alias("start"), F.col("w")["bytes_at"].alias("byte_start"))
    once = rows.groupBy("row", "entity", "start").agg(*[F.first(c).alias(c) for c in ("doc_id", "term", "word", "byte_start")], F.min("context").alias("context"))
    return once.withColumns({"end": F.col("start") + F.length("word"), "byte_end": F.col("byte_start") + F.octet_length("word")}).drop("word")


def vocabulary(documents: DataFrame) -> DataFrame:
    """term and its occurrences n in all texts; staged."""
    words = documents.select(F.explode(F.regexp_extract_all(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD), 0)).alias("word"))
    # As they are written first: far fewer rows remain to be lower-cased.
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return stage(counted.groupBy(F.lower("word").alias("term")).agg(F.sum("n").alias("n")), "pii-terms")


def _head(term: Column) -> Column:
    return F.substring(term, 1, HEAD)


def disclosing(window: DataFrame, terms: DataFrame, threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """entity, term, n_te, n_t, disclosure (PMI over IC) and general, what replaces the term (empty: nothing); staged.

    Entities and terms with ``support`` different contexts at least are candidates, all are counted.
    """
    by_context = window.groupBy("entity", "term", "context").agg(F.count(F.lit(1)).alias("n"))
    pairs = by_context.groupBy("entity", "term").agg(F.sum("n").alias("n_te"), F.count(F.lit(1)).alias("contexts"))
    pairs = stage(pairs, "pii-pairs")
    entities = pairs.groupBy("entity").agg(F.sum("n_te").alias("n_e"), F.max("contexts").alias("most")).filter(F.col("most") >= support).drop("most")
    all_positions = F.broadcast(terms.agg(F.sum("n").cast("double").alias("n_all")))
    told = lambda n_te, n_t: F.log2(F.col(n_te) / F.col(n_t) / (F.col("n_e") / F.col("n_all"))) / F.log2(F.col("n_all") / F.col("n_e"))
    candidates = pairs.filter(F.col("contexts") >= support)
    joined = candidates.join(terms.select("term", F.col("n").alias("n_t")), "term").join(entities, "entity").crossJoin(all_positions)
    risky = joined.withColumn("disclosure", told("n_te", "n_t")).filter((F.col("n_all") > F.col("n_e")) & (F.col("disclosure") >= threshold))
    risky = risky.select("entity", "term", "n_te", "n_t", "n_e", "n_all", "disclosure", _head(F.col("term")).alias("head"))
    # The class of words of one head: its positions in windows of the entity, and in all texts.
    keys = risky.select("entity", "head").distinct()
    in_windows = pairs.withColumn("head", _head(F.col("term"))).join(keys, ["entity", "head"], "left_semi").groupBy("entity", "head").agg(F.sum("n_te").alias("h_te"))
    in_all = terms.groupBy(_head(F.col("term")).alias("head")).agg(F.sum("n").alias("h_t"))
    out = risky.join(in_windows, ["entity", "head"]).join(in_all, "head").withColumn("general_disclosure", told("h_te", "h_t"))
    general = F.when((F.col("general_disclosure") < threshold) & (F.length("term") > HEAD), F.concat("head", F.lit("…"))).otherwise(F.lit(""))
    return stage(out.select("entity", "term", "n_te", "n_t", "disclosure", general.alias("general")), "pii-disclosing")


def term_spans(window: DataFrame, risky: DataFrame, positions: int) -> DataFrame:
    """The windows' positions that hold a disclosing term of their entity; a position once, the shortest replacement counts."""
    hot = F.col("n_te") * 1000 >= positions
    rows = join_hot(window, risky.select("entity", "term", "n_te", "general"), ["entity", "term"], hot)
    return rows.groupBy("row", "start").agg(*[F.first(c).alias(c) for c in ("doc_id", "end", "byte_start", "byte_end")], F.min("general").alias("tag"))


_SPAN = ["row", "doc_id", "kind", "start", "end", "byte_start", "byte_end", "tag"]


def all_spans(spans: DataFrame, terms: DataFrame) -> DataFrame:
    """Base spans and those terms that overlap none, in long form."""
    tag = F.element_at(F.array(*[F.lit(t) for t in TAGS]), F.col("kind") + 1)
    both = spans.withColumn("tag", tag).select(*_SPAN).unionByName(terms.withColumn("kind", F.lit(TERM)).select(*_SPAN))
    order = Window.partitionBy("row").orderBy("start", "kind")
    base = F.col("kind") < TERM
    both = both.withColumns(
        {
            "reached": F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
            "next": F.min(F.when(base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing)),
        }
    )
    free = (F.coalesce(F.col("reached"), F.lit(0)) <= F.col("start")) & (F.coalesce(F.col("next"), F.col("end")) >= F.col("end"))
    return both.filter(base | free).drop("reached", "next")


def _numbered(documents: DataFrame) -> DataFrame:
    """row, doc_id and text; the number holds within one run of a plan, so it is staged with what is found."""
    return documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _spans_of(found: DataFrame, documents: DataFrame, threshold: float, support: int) -> DataFrame:
    spans = base_spans(found)
    window = stage(windows(spans), "pii-windows")
    risky = disclosing(window, vocabulary(documents), threshold, support)
    return all_spans(spans, term_spans(window, risky, window.count()))


def find(documents: DataFrame, threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """doc_id and spans (kind, start, end in code points, in order) of every document."""
    found = matches(_numbered(documents))
    spans = _spans_of(found, documents, threshold, support)
    listed = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    # Documents without a match never leave their place.
    held = found.filter(F.col("kind").isNotNull()).groupBy("row").agg(F.first("doc_id").alias("doc_id")).join(listed, "row", "left")
    empty = F.array().cast("array<struct<start:long,kind:int,end:long>>")
    none = found.filter(F.col("kind").isNull()).select("doc_id", empty.alias("spans"))
    return held.select("doc_id", F.coalesce("spans", empty).alias("spans")).unionByName(none)


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind, the hash of the base spans, and all spans as text."""
    name = F.array(*[F.lit(k) for k in KINDS])
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] < TERM)
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *[n(k) for k in range(TERM)], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def sanitise(documents: DataFrame, threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """``documents`` with its columns, base spans replaced by TAGS and disclosing terms generalised or removed.

    Only documents with spans are joined again; where spans overlap the first one's tag stands for all.
    """
    columns = documents.columns
    work = stage(documents.withColumn("__row", F.monotonically_increasing_id()), "pii-documents")
    plain = work.select(F.col("__row").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spans = _spans_of(matches(plain), documents, threshold, support)
    before = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    cut = spans.withColumn("done", F.coalesce(F.max("byte_end").over(before), F.lit(0)))
    piece = F.struct(F.col("start"), F.col("kind"), F.col("done"), F.col("byte_start"), F.when(F.col("done") > F.col("byte_start"), F.lit("")).otherwise(F.col("tag")).alias("tag"))
    listed = cut.groupBy(F.col("row").alias("__row")).agg(F.sort_array(F.collect_list(piece)).alias("__cuts"), F.max("byte_end").alias("__end"))
    raw = F.col("text").cast("binary")
    middle = lambda a, b: F.substring(raw, (a + 1).cast("int"), F.greatest(F.lit(0), b - a).cast("int")).cast("string")
    text = F.concat(
        F.array_join(F.transform("__cuts", lambda c: F.concat(middle(c["done"], c["byte_start"]), c["tag"])), ""),
        middle(F.col("__end"), F.octet_length(raw)),
    )
    return work.join(listed, "__row", "left").select(*[F.when(F.col("__cuts").isNotNull(), text).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in columns])
