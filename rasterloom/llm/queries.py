"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import chat, decontaminate, importance, infill, language, mixing, neardup, pii, quality, sharding, tokens, topk, toxicity
from rasterloom.llm.common import table

SHARDS = 16


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    topology = sharding.Topology.even(SHARDS)
    return sharding.shard_documents(table(spark, sf_dir, "documents"), topology, topology.grow())


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.annotate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.group(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0).withColumn("score", topk.as_long(F.col("score")))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.round_trip(chat.probe(table(spark, sf_dir, "conversations")))


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digest(infill.transform(table(spark, sf_dir, "documents")))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": op1_sharding,
        "op2_decontamination": op2_decontamination,
        "op3_toxicity": op3_toxicity,
        "op4_mixing": op4_mixing,
        "op5_neardup": op5_neardup,
        "op6_quality": op6_quality,
        "op7_language": op7_language,
        "op8_tokens": op8_tokens,
        "op9_topk": op9_topk,
        "op10_chat": op10_chat,
        "op11_infill": op11_infill,
        "op12_importance": op12_importance,
        "op13_pii": op13_pii,
    }


def _draw_sql(key: str, name: str, weight: float) -> str:
    return f"-ln((('0x' || substr(md5({key} || ':{name}'), 1, {sharding.DRAW_DIGITS}))::bigint::double + 0.5) / {float(16**sharding.DRAW_DIGITS)!r}::double) / {float(weight)!r}::double"


def _shard_sql(key: str, topology: sharding.Topology) -> str:
    """The descent of the tree as nested comparisons of draws."""

    def pick(options: list[tuple[str, float, str]]) -> str:
        if len(options) == 1:
            return options[0][2]
        draws = [(_draw_sql(key, name, weight), then) for name, weight, then in options]
        least = "least(" + ", ".join(d for d, _ in draws) + ")"
        return "CASE " + least + " " + " ".join(f"WHEN {d} THEN {then}" for d, then in draws) + " END"

    regions = []
    for g, racks in sorted(topology.tree().items()):
        in_region = []
        for k, shards in sorted(racks.items()):
            in_region.append((f"rack {g}/{k}", sum(shards.values()), pick([(f"shard {s}", w, str(s)) for s, w in sorted(shards.items())])))
        regions.append((f"region {g}", sum(x[1] for x in in_region), pick(in_region)))
    return pick(regions)


def _op1_sql() -> str:
    topology = sharding.Topology.even(SHARDS)
    return f"""
WITH RECURSIVE crc(i, k, v) AS (
  SELECT i, 0, i::bigint FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(3988292384::bigint, v >> 1) ELSE v >> 1 END FROM crc WHERE k < 8
),
crc_table AS (SELECT list(v ORDER BY i) AS c FROM crc WHERE k = 8),
hashed AS (
  SELECT doc_id, strlen(coalesce(text, ''))::bigint + 1 AS size, coalesce(doc_id::varchar, 'null') AS key,
    xor(4294967295::bigint, list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::bigint),
      lambda a, b: xor(a >> 8, c[(xor(a, b) & 255) + 1]), 4294967295::bigint)) AS text_crc32
  FROM documents, crc_table
),
placed AS (
  SELECT *, ({_shard_sql('key', topology)})::int AS shard, ({_shard_sql('key', topology.grow())})::int AS grown_shard,
    ('0x' || substr(md5(key || ':slot'), 1, {sharding.SLOT_DIGITS}))::int AS bucket
  FROM hashed
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
  (row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, size, text_crc32) - 1)::bigint AS slot, grown_shard
FROM placed
"""


# RE2 counts code points, as the operator's byte classes do for valid UTF-8.
_OP2_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
),
items AS (
  SELECT row_number() OVER () AS item, coalesce(item_id::varchar, '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
),
windows AS (
  SELECT item, item_id, i AS j, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)
),
spots AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows)),
grams AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM spots),
found AS (SELECT r, item, item_id, i, j, n FROM grams JOIN windows USING (n, g)),
-- Windows that follow each other in an item and in a document are one match.
steps AS (SELECT r, i, n, i - row_number() OVER (PARTITION BY r, item, n, i - j ORDER BY i) AS island, item, i - j AS diagonal FROM found),
matches AS (SELECT r, min(i) AS i, max(i) - min(i) + any_value(n) AS words FROM steps GROUP BY r, item, n, diagonal, island),
longest AS (SELECT r, max(words) AS words, first(i ORDER BY words DESC, i) AS i FROM matches GROUP BY r),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r),
listed AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  coalesce(words, 0)::bigint AS longest, coalesce(longest.i - 1, -1)::bigint AS longest_at
FROM docs LEFT JOIN hit USING (r) LEFT JOIN listed USING (r) LEFT JOIN longest USING (r)
"""


# Shingles are compared as text; pairs come from an inverted list of all shingles.
_OP5_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s
  FROM docs
),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
grams AS (SELECT doc_id, unnest(s) AS g FROM sets),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN sizes sa ON sa.doc_id = a JOIN sizes sb ON sb.doc_id = b WHERE 100 * c >= 75 * (sa.n + sb.n - c)
),
reach(doc_id, root) AS (
  SELECT doc_id, doc_id FROM docs
  UNION
  SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.doc_id
)
SELECT doc_id, n::bigint AS n_shingles, component_id, doc_id = component_id AS kept
FROM sizes JOIN (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""


def _position_sql(x: str) -> str:
    out = "CASE slot"
    for i, knots in enumerate(mixing.SCHEDULES):
        pieces = mixing._integral(knots)
        out += f" WHEN {i} THEN CASE"
        for j, (t0, t1, before, a, b) in enumerate(pieces):
            slope = (b - a) / (t1 - t0)
            upper = pieces[j + 1][2] if j + 1 < len(pieces) else 1.0
            rest = f"({x} - {before!r}::double)"
            out += f" WHEN {x} < {upper!r}::double THEN {t0!r}::double + 2.0::double * {rest} / ({a!r}::double + sqrt(greatest(0.0::double, {a * a!r}::double + {2 * slope!r}::double * {rest})))"
        out += f" ELSE {x} END"
    return out + " END"


def _op4_sql() -> str:
    weights = ", ".join(f"{w!r}::double" for w in mixing.WEIGHTS)
    return rf"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint AS size, md5(coalesce(doc_id::varchar, 'null')) AS h, coalesce(text, '') AS t FROM documents
),
sources AS (
  SELECT source, sum(size)::bigint AS source_size, [{weights}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1)::int] AS w,
    ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)})::int AS slot
  FROM docs GROUP BY source
),
leveled AS (
  SELECT *, {mixing.CAP!r}::double * source_size AS most,
    ({mixing.SHARE!r}::double * (sum(source_size) OVER ())::double - coalesce(sum({mixing.CAP!r}::double * source_size) OVER (ORDER BY {mixing.CAP!r}::double * source_size / w, slot, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::double))
      / sum(w) OVER (ORDER BY {mixing.CAP!r}::double * source_size / w, slot, source NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own_level
  FROM sources
),
targets AS (
  SELECT source, source_size, slot, least(most, w * max(CASE WHEN w * own_level <= most THEN own_level END) OVER ()) AS target FROM leveled
),
starts AS (
  SELECT doc_id, size, source_size, target, slot, h,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS c
  FROM docs d JOIN targets t2 ON d.source IS NOT DISTINCT FROM t2.source
),
laid AS (
  SELECT *, CASE WHEN target > 0 THEN c / target ELSE 1.0::double + ('0x' || substr(h, 1, {mixing.BUCKET_DIGITS}))::int / {float(16**mixing.BUCKET_DIGITS)!r}::double END AS x FROM starts
)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(size, floor(target)::bigint - c)) + greatest(0, least(size, floor(target)::bigint - c - source_size)))::bigint AS taken,
  round({_position_sql('x')}, 9) AS position
FROM laid
"""


_OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::bigint AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, rank::int AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""


def _op10_sql() -> str:
    body = "|".join(c[1:].replace("\\", "\\\\").replace("|", r"\|").replace("[", r"\[").replace("]", r"\]") for c in chat.CONTROLS)
    escaped = lambda x: rf"regexp_replace({x}, '([<\[])(\\*)({body})', '\1\\\2\3', 'g')"
    role = r"replace(replace(role, '\', '\\'), chr(10), '\n')"
    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS t FROM conversations
  UNION ALL
  SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '{chat.PROBE}', unnest(['user', 'assistant']), '{chat.PROBE}'
)
SELECT conv_id, count(*)::bigint AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length({escaped(role)}) + length({escaped('text')}) + {len(chat.OPEN) + len(chat.CLOSE) + 2})::bigint AS formatted_chars
FROM turns GROUP BY conv_id
"""


# Lines are told apart by a list of matches, not by positions.
_OP11_SQL = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::varchar, 'null')) AS h FROM documents
),
cut AS (
  SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, ('0x' || h[1:8])::bigint AS h1, ('0x' || h[9:16])::bigint AS h2, ('0x' || h[25:32])::bigint AS h4 FROM drawn
),
ranked AS (
  SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM cut
),
parts AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1 : b], '') AS m, array_to_string(u[b + 1 : n], '') AS s FROM ranked)
SELECT doc_id, n::bigint AS n, form, CASE WHEN form <> 'plain' THEN length(p)::bigint END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::bigint END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts
"""


_OP12_SQL = r"""
WITH RECURSIVE crc(i, k, v) AS (
  SELECT i, 0, i::bigint FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(3988292384::bigint, v >> 1) ELSE v >> 1 END FROM crc WHERE k < 8
),
crc_table AS (SELECT list(v ORDER BY i) AS c FROM crc WHERE k = 8),
texts AS (
  SELECT row_number() OVER () AS r, doc_id, true AS own, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT NULL, NULL, false, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
),
bags AS (SELECT r, own, word, count(*) AS n FROM (SELECT r, own, unnest(w) AS word FROM texts) GROUP BY ALL),
buckets AS (
  SELECT word, xor(4294967295::bigint, list_reduce(list_transform(regexp_extract_all(hex(encode(word)), '..'), lambda h: ('0x' || h)::bigint),
      lambda a, b: xor(a >> 8, c[(xor(a, b) & 255) + 1]), 4294967295::bigint)) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM bags), crc_table
),
counted AS (SELECT bucket, coalesce(sum(n) FILTER (own), 0)::double AS s, coalesce(sum(n) FILTER (NOT own), 0)::double AS t FROM bags JOIN buckets USING (word) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000.0::double * ln((t + 1) * ((SELECT coalesce(sum(s), 0) FROM counted) + 10000) / ((s + 1) * ((SELECT coalesce(sum(t), 0) FROM counted) + 10000))))::bigint AS gain FROM counted
),
weights AS (SELECT r, sum(n * gain)::bigint AS weight FROM bags JOIN buckets USING (word) JOIN gains USING (bucket) WHERE own GROUP BY r),
scored AS (
  SELECT doc_id, len(w)::bigint AS n_features, coalesce(weight, 0)::bigint AS weight,
    coalesce(weight, 0)::bigint + floor(-1000.0::double * ln(-ln((('0x' || sha256('2024:' || coalesce(doc_id::varchar, 'null'))[1:8])::bigint + 0.5::double) / 4294967296.0::double)))::bigint AS score
  FROM texts LEFT JOIN weights USING (r) WHERE own
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS k, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND k <= 10 * n // 100 THEN k END AS rank FROM ranked
"""


def _op13_sql() -> str:
    word = r"[A-Za-z\x{80}-\x{10FFFF}]+"
    bases = (
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        r"[0-9](?:[\x20-]?[0-9])+",
        r"\+[0-9][\x20().0-9-]+[0-9]",
    )
    cut = " UNION ALL ".join(f"SELECT r, doc_id, {k} AS kind, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS p FROM docs" for k, p in enumerate(bases))
    c = pii.CONTEXT
    side = lambda name, value, at: f"SELECT r, kind, i, '{name}' AS side, entity, {value} AS x, {at} AS base, regexp_extract_all({value}, '{word}') AS w, string_split_regex({value}, '{word}') AS p FROM spans"
    told = lambda n_te, n_t: f"log2({n_te}::double / {n_t} / (n_e / n_all)) / log2(n_all / n_e)"
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
cut AS ({cut}),
found AS (SELECT r, kind, generate_subscripts(m, 1) AS i, unnest(m) AS v, unnest(p[1 : len(m)]) AS a, unnest(p[2 :]) AS b FROM cut WHERE len(m) > 0),
placed AS (SELECT *, sum(length(a) + length(v)) OVER (PARTITION BY r, kind ORDER BY i)::bigint AS e, regexp_replace(v, '[^0-9]', '', 'g') AS d FROM found),
spans AS (
  SELECT r, kind, i, e - length(v) AS s, e, right(a, {c + 1}) AS l, left(b, {c + 1}) AS n, kind || ':' || CASE kind WHEN 0 THEN lower(v) WHEN 1 THEN v ELSE d END AS entity
  FROM placed
  WHERE CASE kind WHEN 0 THEN true
    WHEN 1 THEN len(list_filter(string_split(v, '.'), lambda x: CASE WHEN length(ltrim(x, '0')) > 3 THEN true ELSE ('0' || ltrim(x, '0'))::int > 255 END)) = 0
    WHEN 2 THEN length(d) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda j: CASE WHEN (length(d) - j) % 2 = 0 THEN d[j]::int ELSE d[j]::int * 2 - CASE WHEN d[j]::int > 4 THEN 9 ELSE 0 END END)) % 10 = 0
    ELSE length(d) BETWEEN 10 AND 15 END
),
sides AS ({side('l', 'l', 's - length(l)')} UNION ALL {side('n', 'n', 'e')}),
told AS (SELECT *, generate_subscripts(w, 1) AS j, unnest(w) AS word, unnest(p[1 : len(w)]) AS gap FROM sides WHERE len(w) > 0),
words AS (SELECT *, sum(length(gap) + length(word)) OVER (PARTITION BY r, kind, i, side ORDER BY j)::bigint AS upto FROM told),
inside AS (
  SELECT *, min(md5(lower(word))) OVER (PARTITION BY r, kind, i) || max(md5(lower(word))) OVER (PARTITION BY r, kind, i) AS context
  FROM words WHERE length(x) <= {c} OR CASE side WHEN 'l' THEN upto > length(word) ELSE upto <= {c} END
),
positions AS (SELECT r, entity, base + upto - length(word) AS s, any_value(lower(word)) AS term, any_value(length(word)) AS n, min(context) AS context FROM inside GROUP BY ALL),
terms AS (SELECT lower(word) AS term, count(*) AS n_t FROM (SELECT unnest(regexp_extract_all(t, '{word}')) AS word FROM docs) GROUP BY 1),
pairs AS (SELECT entity, term, left(term, {pii.HEAD}) AS head, count(*) AS n_te, count(DISTINCT context) AS contexts FROM positions GROUP BY ALL),
entities AS (SELECT entity, sum(n_te)::double AS n_e, (SELECT sum(n_t)::double FROM terms) AS n_all FROM pairs GROUP BY ALL),
risky AS (
  SELECT entity, term FROM pairs JOIN terms USING (term) JOIN entities USING (entity)
  WHERE contexts >= {pii.SUPPORT} AND n_all > n_e AND {told('n_te', 'n_t')} >= {pii.THRESHOLD}
),
revealing AS (SELECT DISTINCT r, s, s + n AS e FROM positions JOIN risky USING (entity, term)),
every AS (
  SELECT r, kind, s, e FROM spans
  UNION ALL
  SELECT r, 4, s, e FROM revealing x WHERE NOT EXISTS (SELECT 1 FROM spans b WHERE b.r = x.r AND b.s < x.e AND b.e > x.s)
),
listed AS (
  SELECT r, string_agg(x, ',' ORDER BY s, kind) AS spans, string_agg(x, ',' ORDER BY s, kind) FILTER (kind < 4) AS base,
    {', '.join(f"count(*) FILTER (kind = {k}) AS n_{pii.KINDS[k]}" for k in range(4))}
  FROM (SELECT *, {list(pii.KINDS)}[kind + 1] || ':' || s || ':' || e AS x FROM every) GROUP BY r
)
SELECT doc_id, {', '.join(f"coalesce(n_{pii.KINDS[k]}, 0)::bigint AS n_{pii.KINDS[k]}" for k in range(4))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN listed USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_sharding": _op1_sql(),
        "op2_decontamination": _OP2_SQL,
        "op4_mixing": _op4_sql(),
        "op5_neardup": _OP5_SQL,
        "op9_topk": _OP9_SQL,
        "op10_chat": _op10_sql(),
        "op11_infill": _OP11_SQL,
        "op12_importance": _OP12_SQL,
        "op13_pii": _op13_sql(),
    }
