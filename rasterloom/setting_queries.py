"""Registered queries of scalars, parsing and settings over the rows of given tables, with their SQL."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom import fixtures
from rasterloom.functions import config as C
from rasterloom.functions import scalar as S

DXGI = (28, 49, 61, 80, 83, 71)
PATHS = ("plain.dds", "a/b.dds", "a\\b\\c.dds", "dir/", "")
ENERGY = (0.75, (0.5, -0.25), ((2.0, 0.5), (0.5, 1.0)))


def _pick(values, index):
    """The ``index``-th (from 0) of literal values."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def q66(spark: SparkSession, d: str) -> DataFrame:
    """Index, format, name and palette scalars of every part's key."""
    k = F.col("p_partkey")
    rows = fixtures.table(spark, d, "part").select(k.alias("k"), (k * 7 % 256).cast("int").alias("r0"), (k * 13 % 256).cast("int").alias("r1"), (k % 8).cast("int").alias("s"), _pick(DXGI, k % 6).alias("dxgi"), _pick(PATHS, k % 5).alias("path"))
    k = F.col("k")
    r0, r1, s, dxgi, path = (F.col(c) for c in ("r0", "r1", "s", "dxgi", "path"))
    a0, a1, a2 = ENERGY
    x = [r0 / 255.0, r1 / 255.0]
    sides = [(c0, c1) for c0 in range(1, 5) for c1 in range(1, 5)]
    side = k % 16
    mono = S.monomials(x)
    return rows.select(
        "k",
        F.round(S.relative(r0.cast("double"), r1.cast("double")), 9).alias("relative"),
        S.clamp_index((k % 200 - 100).cast("int"), 50).alias("clamped"),
        F.round(S.bc4_weight(s), 9).alias("weight8"),
        S.byte_value(F.lit(-1.5), F.lit(1.25), r0.cast("double")).alias("byte_value"),
        F.round(S.search_energy(S.lit(a0), [S.lit(v) for v in a1], [[S.lit(v) for v in row] for row in a2], x), 9).alias("energy"),
        F.round(sum(mono[1:], mono[0]), 9).alias("monomials"),
        _pick([S.monomial_count(c0) for c0, _ in sides], side).alias("n_monomials"),
        _pick([S.feature_count(*c) for c in sides], side).alias("n_features"),
        _pick([S.level0_files(c0) for c0, _ in sides], side).alias("files"),
        _pick([S.level0_file_channels(c0, S.level0_files(c0) - 1) for c0, _ in sides], side).alias("last_channels"),
        _pick([C.layout_text(c0) for c0, _ in sides], side).alias("layout"),
        _pick([C.uniform([float(c0), float(c1)]) for c0, c1 in sides], side).alias("uniform"),
        S.format_name(dxgi).alias("format"),
        S.format_short_name(dxgi).alias("short"),
        S.level_bytes(dxgi, (k % 97 + 1).cast("int"), (k % 61 + 1).cast("int")).alias("bytes"),
        S.base_name(path).alias("base"),
        S.has_separator(path).alias("separated"),
        S.level_image_name(F.concat(F.lit("p"), k.cast("string")), "recon", 2, (k % 2).cast("int"), (k % 3).cast("int")).alias("image"),
        S.all_finite(F.array(r0.cast("double"), F.when(k % 4 == 0, F.lit(float("inf"))).when(k % 4 == 1, F.lit(float("nan"))).otherwise(F.lit(1.0)))).alias("finite"),
    )


def _text(k, price):
    """A number as it is written, and what people write in its place."""
    whole, cents = F.floor(price).cast("string"), (price * 100 % 100).cast("int").cast("string")
    forms = [whole, F.concat(whole, F.lit("x"), cents), F.concat(whole, F.lit(".5")), F.concat(F.lit("-"), whole, F.lit(",7")), F.concat(whole, F.lit("e999")), F.concat(F.lit(" "), whole), F.concat(F.lit("0x"), cents), F.lit(""), F.concat(F.lit("."), cents, F.lit("e1,+3")), F.concat(whole, F.lit(",,1"))]
    out = F.when(k % 10 == 0, forms[0])
    for i, f in enumerate(forms[1:], 1):
        out = out.when(k % 10 == i, f)
    return out


def q67(spark: SparkSession, d: str) -> DataFrame:
    """Every order's price as a text, parsed as each kind of setting."""
    orders = fixtures.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), _text(F.col("o_orderkey"), F.floor("o_totalprice")).alias("text"))
    t = F.col("text")
    ints, doubles, words = (C.parse_list(t, kind) for kind in ("int", "double", "string"))
    return orders.select(
        "k",
        C.parse_int(t).alias("as_int"),
        C.parse_double(t).alias("as_double"),
        F.when(ints.isNotNull(), F.array_join(F.transform(ints, lambda v: v.cast("string")), "|")).alias("as_ints"),
        F.when(doubles.isNotNull(), F.aggregate(doubles, F.lit(0.0), lambda a, v: a + v)).alias("sum_doubles"),
        F.size(words).alias("n_words"),
        C.parse_pair(t, "x")["a"].alias("first"),
        C.parse_pair(t, "x")["b"].alias("second"),
        C.parse_size(t)["b"].alias("height"),
        C.list_count_ok(ints, 2).alias("two"),
    )


def q68(spark: SparkSession, d: str) -> DataFrame:
    """A texture's settings for every part: file, command line and defaults merged, with the rules they break."""
    k = F.col("p_partkey")
    parts = fixtures.table(spark, d, "part")
    textures = parts.select(
        k.alias("t"),
        _pick(("mitchell", "box", "cubic", None), k % 4).alias("filter"),
        F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("srgb"),
        _pick(("wrap", "clamp", "mirror", None), F.floor(k / 4) % 4).alias("edge"),
        F.when(k % 5 == 0, True).alias("normal_map"),
        F.when(k % 7 > 0, (k % 7 - 2) * 100.0).alias("weight"),
    )
    given = parts.filter("p_partkey % 6 = 1").select(k.alias("t"), F.when(k % 12 == 1, "catmullrom").alias("filter"), F.when(k % 9 > 3, (k % 9) / 2.0).alias("weight"))
    merged = C.merge_settings(textures, given)
    broken = C.setting_errors(merged).groupBy("t").agg(F.array_join(F.sort_array(F.collect_list("error")), "; ").alias("errors"))
    return merged.join(broken, "t", "left")


def q75(spark: SparkSession, d: str) -> DataFrame:
    """A material's text for every nation, as it should be and broken in four ways; those that are right are read from files as well."""
    from rasterloom.session import shared_path
    from rasterloom.sources import dds, material

    customers = fixtures.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    forms = [
        '[{"file": "n%s.png", "weight": %s, "srgb": true}]',
        '[{"file": "n%s.png", "wieght": %s}]',
        '[{"file": "n%s.png", "weight": 1, "weight": %s}]',
        '[{"file": "n%s.png", "weight": "%s"}]',
        '[{"file": "n%s.png", "weight": %s, "normal_map": true, "srgb": true}]',
        '[{"file": "n%s.png"}, {"file": "/all/%s.png", "filter": "mitchell", "edge": "wrap"}]',
    ]
    text = F.format_string(forms[0], "k", "n")
    for i, form in enumerate(forms[1:], 1):
        text = F.when(F.col("k") % 6 == i, F.format_string(form, "k", "n")).otherwise(text)
    texts = customers.select("k", text.alias("text")).withColumn("m", material.parse(F.col("text")))
    told = texts.select("k", F.col("m.error").alias("error"), F.coalesce(F.size("m.textures"), F.lit(0)).alias("textures"))
    told = told.withColumn("textures", F.greatest(F.lit(0), F.col("textures")))
    root = shared_path(spark, "materials")
    good = texts.filter("m.error is null")
    dds.save_files(good.select(F.format_string("n%s.json", "k").alias("path"), F.encode("text", "UTF-8").alias("content")), root)
    read = material.read(spark, f"{root}/*.json").select(F.regexp_extract("material_id", r"n(\d+)\.json$", 1).cast("int").alias("k"), "t", "file", "filter", "edge", "srgb", "weight", S.base_name(F.col("source")).alias("base"), F.col("source").startswith("/all/").alias("absolute"))
    return told.join(read, "k", "left").filter(F.col("t").isNull() | (F.col("t") == F.col("textures") - 1)).drop("t")


def q76(spark: SparkSession, d: str) -> DataFrame:
    """A descriptor for every nation, some broken, some not one: found, judged, summed up, and its files resolved."""
    from rasterloom.session import shared_path
    from rasterloom.sources import dds, descriptor

    customers = fixtures.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))

    def text_of(k: int, n: int) -> str:
        w, h = 8 * (1 + n % 8), 8 * (1 + k % 5)

        def latent(i: int, dxgi: int, a: int, b: int) -> dict:
            return {"file": f"n{k}_{i}.dds", "mip_count": 2, "mip_sizes": [[a, b], [a // 2, b // 2]], "dxgi_format_id": dxgi, "dxgi_format": f"F{dxgi}", "dequantise": {"lo": [-1.0], "hi": [1.0]}}

        value = json.loads(descriptor.build(w, h, 1, 1, 1, [[1.0, 2.0, 3.0]] * 3, [0.0] * 3, [latent(0, 80, w, h), latent(1, 61, w // 4, h // 4)]))
        if k % 4 == 1:
            value["decoder"]["nin"] = 4
        if k % 4 == 2:
            value["textures"][1]["mip_count"] = 1
        return json.dumps({"hello": k} if k % 7 == 3 else value)

    def build(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame([(f"n{k}.json", text_of(int(k), int(n)).encode()) for k, n in zip(pdf["k"], pdf["n"], strict=True)], columns=["path", "content"])

    root = shared_path(spark, "descriptors")
    dds.save_files(customers.mapInPandas(build, "path string, content binary"), root)
    found = descriptor.find(descriptor.read(spark, root))
    files = customers.filter("k % 3 > 0").select(F.explode(F.array(*[F.format_string(f"n%s_{i}.dds", "k") for i in (0, 1)])).alias("file"))
    states = descriptor.resolve(descriptor.named_files(found), files).groupBy("name").agg(F.count_if(F.col("state") == "have").alias("have"), F.count_if(F.col("state") == "missing").alias("missing"))
    wrong = descriptor.violations(found).groupBy("name").agg(F.array_join(F.sort_array(F.collect_list("error")), "; ").alias("errors"))
    rows = descriptor.summary(found).join(states, "name").join(wrong, "name", "left")
    return rows.withColumn("prefix", descriptor.prefix_of(F.col("name")))


NAMES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "q66_part_scalars": q66,
    "q67_order_texts": q67,
    "q68_part_settings": q68,
    "q75_nation_materials": q75,
    "q76_nation_descriptors": q76,
}

_MATERIALS = """WITH c AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1)
SELECT k, CASE k % 6 WHEN 1 THEN 'texture 0: unknown key ''wieght''' WHEN 2 THEN 'key ''weight'' is given twice' WHEN 3 THEN 'texture 0: ''weight'' has the wrong kind of value' WHEN 4 THEN 'texture 0: a normal map isn''t srgb' END AS error,
  CASE k % 6 WHEN 0 THEN 1 WHEN 5 THEN 2 ELSE 0 END AS textures, CASE k % 6 WHEN 0 THEN 'n' || k || '.png' WHEN 5 THEN '/all/' || n || '.png' END AS file,
  CASE WHEN k % 6 = 5 THEN 'mitchell' END AS filter, CASE WHEN k % 6 = 5 THEN 'wrap' END AS edge, CASE WHEN k % 6 = 0 THEN true END AS srgb, CASE WHEN k % 6 = 0 THEN n::double END AS weight,
  CASE k % 6 WHEN 0 THEN 'n' || k || '.png' WHEN 5 THEN n || '.png' END AS base, CASE k % 6 WHEN 0 THEN false WHEN 5 THEN true END AS absolute FROM c"""
_DESCRIPTORS = """WITH c AS (SELECT c_nationkey AS k, 8 * (1 + count(*) % 8) AS w, 8 * (1 + c_nationkey % 5) AS h FROM customer GROUP BY 1)
SELECT 'n' || k || '.json' AS name, w::int AS width, h::int AS height, 1 AS textures, 'F80' AS level0, ((w // 4) * (h // 4) * 8 + ((w // 2 + 3) // 4) * ((h // 2 + 3) // 4) * 8 + (w // 4) * (h // 4) + (w // 8) * (h // 8))::bigint AS bytes,
  CASE WHEN k % 3 > 0 THEN 2 ELSE 0 END::bigint AS have, CASE WHEN k % 3 > 0 THEN 0 ELSE 2 END::bigint AS missing,
  CASE k % 4 WHEN 1 THEN 'as many weights as nin times nout; nin is C1 + C0 + C0 * C1' WHEN 2 THEN 'a size for every mip; equal mip counts' END AS errors, 'n' || k AS prefix FROM c WHERE k % 7 <> 3"""


def oracle_sql() -> dict[str, str]:
    a0, a1, a2 = ENERGY
    listed = lambda values: "[" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() for v in values) + "]"
    sides = [(c0, c1) for c0 in range(1, 5) for c1 in range(1, 5)]
    x = ["(r0 / 255.0::double)", "(r1 / 255.0::double)"]
    energy = " + ".join([f"{a0!r}::double", *[f"2 * {x[i]} * {a1[i]!r}::double" for i in range(2)], *[f"{x[i]} * {a2[i][j]!r}::double * {x[j]}" for i in range(2) for j in range(2)]])
    texts = ["w", "w || 'x' || c", "w || '.5'", "'-' || w || ',7'", "w || 'e999'", "' ' || w", "'0x' || c", "''", "'.' || c || 'e1,+3'", "w || ',,1'"]
    whole, real = "'^[+-]?[0-9]+$'", "'^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$'"
    as_int = lambda t: f"CASE WHEN regexp_matches({t}, {whole}) THEN try_cast({t} AS int) END"
    as_double = lambda t: f"CASE WHEN regexp_matches({t}, {real}) AND isfinite(coalesce(try_cast({t} AS double), 'inf'::double)) THEN try_cast({t} AS double) END"
    pair = "'^(-?[0-9]+)x(-?[0-9]+)$'"
    part = lambda i: f"CASE WHEN regexp_matches(text, {pair}) THEN regexp_extract(text, {pair}, {i})::int END"
    return {
        "q75_nation_materials": _MATERIALS,
        "q76_nation_descriptors": _DESCRIPTORS,
        "q66_part_scalars": f"""WITH p AS (SELECT p_partkey AS k, (p_partkey * 7 % 256)::int AS r0, (p_partkey * 13 % 256)::int AS r1, (p_partkey % 8)::int AS s, {listed(DXGI)}[p_partkey % 6 + 1] AS dxgi, {listed(PATHS)}[p_partkey % 5 + 1] AS path, p_partkey % 16 + 1 AS side, (p_partkey % 97 + 1) AS w, (p_partkey % 61 + 1) AS h FROM part)
SELECT k, round(CASE WHEN greatest(r0, r1) > 0 THEN abs(r0 - r1)::double / greatest(r0, r1) ELSE 0 END, 9) AS relative, greatest(0, least(k % 200 - 100, 49))::int AS clamped,
  round(CASE s WHEN 0 THEN 1.0::double WHEN 1 THEN 0 ELSE (8 - s)::double / 7 END, 9) AS weight8, (-1.5::double + r0::double / 255 * 2.75)::float::double AS byte_value,
  round({energy}, 9) AS energy, round(1 + {x[0]} + {x[1]} + {x[0]} * {x[0]} + {x[0]} * {x[1]} + {x[1]} * {x[1]}, 9) AS monomials,
  {listed([1 + a + a * (a + 1) // 2 for a, _ in sides])}[side] AS n_monomials, {listed([a + b + a * b for a, b in sides])}[side] AS n_features, {listed([1 if a < 3 else 2 for a, _ in sides])}[side] AS files, {listed([a if a < 3 else a - 2 for a, _ in sides])}[side] AS last_channels,
  CASE (side - 1) // 4 WHEN 0 THEN 'one channel in one file' WHEN 1 THEN 'two channels in one file' WHEN 2 THEN 'three channels in two files' ELSE 'four channels in two files' END AS layout, {listed([a == b for a, b in sides])}[side] AS uniform,
  'DXGI_FORMAT_' || CASE dxgi WHEN 28 THEN 'R8G8B8A8_UNORM' WHEN 49 THEN 'R8G8_UNORM' WHEN 61 THEN 'R8_UNORM' WHEN 80 THEN 'BC4_UNORM' WHEN 83 THEN 'BC5_UNORM' ELSE dxgi::varchar END AS format,
  CASE dxgi WHEN 28 THEN 'rgba8' WHEN 49 THEN 'rg8' WHEN 61 THEN 'r8' WHEN 80 THEN 'bc4' WHEN 83 THEN 'bc5' ELSE dxgi::varchar END AS short,
  CASE WHEN dxgi IN (80, 83) THEN ((w + 3) // 4) * ((h + 3) // 4) * 8 * CASE dxgi WHEN 80 THEN 1 ELSE 2 END ELSE w * h * CASE dxgi WHEN 28 THEN 4 WHEN 49 THEN 2 WHEN 61 THEN 1 END END AS bytes,
  CASE k % 5 WHEN 0 THEN 'plain.dds' WHEN 1 THEN 'b.dds' WHEN 2 THEN 'c.dds' ELSE '' END AS base, k % 5 BETWEEN 1 AND 3 AS separated,
  'p' || k || '_recon_t' || k % 2 || CASE WHEN k % 3 > 0 THEN '_M' || k % 3 ELSE '' END || '.png' AS image, k % 4 > 1 AS finite
FROM p""",
        "q67_order_texts": f"""WITH n AS (SELECT o_orderkey AS k, floor(o_totalprice)::bigint::varchar AS w, (floor(o_totalprice) * 100 % 100)::int::varchar AS c FROM orders),
t AS (SELECT k, CASE k % 10 {' '.join(f'WHEN {i} THEN {e}' for i, e in enumerate(texts))} END AS text FROM n),
v AS (SELECT *, list_transform(string_split(text, ','), lambda p: {as_int('p')}) AS ints, list_transform(string_split(text, ','), lambda p: {as_double('p')}) AS doubles FROM t),
u AS (SELECT *, len(list_filter(ints, lambda p: p IS NULL)) = 0 AS whole, len(list_filter(doubles, lambda p: p IS NULL)) = 0 AS real FROM v)
SELECT k, {as_int('text')} AS as_int, {as_double('text')} AS as_double, CASE WHEN whole THEN array_to_string(ints, '|') END AS as_ints, CASE WHEN real THEN list_sum(doubles) END AS sum_doubles, len(string_split(text, ','))::int AS n_words,
  {part(1)} AS first, {part(2)} AS second, CASE WHEN {part(1)} > 0 AND {part(2)} > 0 THEN {part(2)} END AS height, CASE WHEN whole THEN len(ints) = 2 ELSE true END AS two FROM u""",
        "q68_part_settings": """WITH f AS (
  SELECT p_partkey AS t, ['mitchell', 'box', 'cubic', NULL][p_partkey % 4 + 1] AS filter, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS srgb, ['wrap', 'clamp', 'mirror', NULL][p_partkey // 4 % 4 + 1] AS edge,
    CASE WHEN p_partkey % 5 = 0 THEN true END AS normal_map, CASE WHEN p_partkey % 7 > 0 THEN (p_partkey % 7 - 2) * 100.0::double END AS weight FROM part),
g AS (SELECT p_partkey AS t, CASE WHEN p_partkey % 12 = 1 THEN 'catmullrom' END AS gf, CASE WHEN p_partkey % 9 > 3 THEN (p_partkey % 9) / 2.0::double END AS gw FROM part WHERE p_partkey % 6 = 1),
j AS (SELECT *, coalesce(srgb, false) OR coalesce(edge, 'clamp') = 'wrap' OR coalesce(normal_map, false) AS implied, coalesce(gw, weight, 1.0::double) AS raw FROM f LEFT JOIN g USING (t)),
m AS (
  SELECT t, CASE WHEN coalesce(gf, filter) IS NULL AND implied THEN 'box' ELSE coalesce(gf, filter, 'default') END AS filter,
    CASE WHEN gf IS NOT NULL THEN 'command line' WHEN filter IS NOT NULL THEN 'file' WHEN implied THEN 'implied' ELSE 'default' END AS filter_from,
    coalesce(srgb, false) AS srgb, coalesce(edge, 'clamp') AS edge, coalesce(normal_map, false) AS normal_map,
    CASE WHEN raw <= 0 THEN 0.0::double ELSE greatest(1e-6::double, least(128.0::double, raw)) END AS weight,
    CASE WHEN gw IS NOT NULL THEN 'command line' WHEN weight IS NOT NULL THEN 'file' ELSE 'default' END AS weight_from FROM j)
SELECT *, nullif(array_to_string(list_sort(list_filter([CASE WHEN srgb AND normal_map THEN 'a normal map isn''t srgb' END, CASE WHEN edge NOT IN ('clamp', 'wrap') THEN 'unknown edge' END, CASE WHEN filter NOT IN ('default', 'box', 'mitchell', 'catmullrom') THEN 'unknown filter' END], lambda x: x IS NOT NULL)), '; '), '') AS errors FROM m""",
    }
