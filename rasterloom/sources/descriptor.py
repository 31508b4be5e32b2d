"""Asset descriptors: reading and checking the JSON, catalogues, file resolution, and writing it."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.functions.scalar import base_name, feature_count, has_separator, level_bytes
from rasterloom.schema import DESCRIPTOR

#: The format name that this engine writes; readers take any.
FORMAT = "latent-pair"


def parse(text: Column) -> Column:
    """The descriptor as a struct, null if the text isn't one. Unknown keys are ignored."""
    schema = T._parse_datatype_string(DESCRIPTOR)
    return F.when(F.get_json_object(text, "$.decoder").isNotNull() & F.get_json_object(text, "$.textures").isNotNull(), F.from_json(text, schema))


def is_descriptor(text: Column) -> Column:
    d = parse(text)
    return d.isNotNull() & d["format"].isNotNull() & (F.size(d["textures"]) == 2)


def violations(parsed: DataFrame) -> DataFrame:
    """(name, error) for every rule a descriptor ``d`` breaks; the fallbacks of missing fields are the defaults."""
    d = F.col("d")
    c0, c1 = d["decoder"]["C0"], d["decoder"]["C1"]
    layer = F.element_at(d["decoder"]["layers"], -1)
    rules = [
        (F.size(d["textures"]) != 2, "two latents"),
        (~c0.between(1, 4) | ~c1.between(1, 4), "1 to 4 channels per latent"),
        (d["decoder"]["nin"] != c1 + c0 + c0 * c1, "nin is C1 + C0 + C0 * C1"),
        (d["decoder"]["nout"] != d["decode"]["textures_out"] * 3, "three outputs per texture"),
        (F.size(layer["weights"]) != d["decoder"]["nin"] * d["decoder"]["nout"], "as many weights as nin times nout"),
        (F.size(layer["bias"]) != d["decoder"]["nout"], "as many biases as outputs"),
        (F.exists(layer["weights"], lambda x: F.isnan(x) | (F.abs(x) == F.lit(math.inf))), "finite weights"),
        (F.coalesce(d["block"], F.lit(4)) != 4, "a block ratio of 4"),
        (~F.coalesce(d["lod_bias_level1"], F.lit(2)).between(0, 8), "a level-1 shift in 0 to 8"),
        (d["textures"][0]["mip_count"] != d["textures"][1]["mip_count"], "equal mip counts"),
        (F.exists(d["textures"], lambda t: F.size(t["mip_sizes"]) != t["mip_count"]), "a size for every mip"),
    ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(text)) for bad, text in rules]))
    return parsed.select("name", F.explode(found).alias("error"))


def named_files(parsed: DataFrame) -> DataFrame:
    """(name, file) of every file a descriptor names, in ``file`` or ``files`` as strings or objects."""
    texture = parsed.select("name", F.explode("d.textures").alias("t"))
    each = F.transform(F.coalesce(F.col("t.files"), F.array()), lambda f: F.coalesce(F.get_json_object(f, "$.file"), f))
    return texture.select("name", F.explode(F.when(F.size(each) > 0, each).otherwise(F.array("t.file"))).alias("file")).filter("file is not null")


def resolve(needed: DataFrame, available: DataFrame) -> DataFrame:
    """(name, file, state): have, missing, or unresolvable (a path, not a name)."""
    flat = needed.filter(~has_separator(F.col("file")))
    have = flat.join(available.select("file"), "file", "left_semi").withColumn("state", F.lit("have"))
    missing = flat.join(available.select("file"), "file", "left_anti").withColumn("state", F.lit("missing"))
    bad = needed.filter(has_separator(F.col("file"))).withColumn("state", F.lit("unresolvable"))
    return have.select("name", "file", "state").unionByName(missing.select("name", "file", "state")).unionByName(bad.select("name", "file", "state"))


def merge_sets(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Two file sets (path, stamp, ...) by base name; the newer wins, the extra on ties."""
    both = base.withColumn("__o", F.lit(0)).unionByName(extra.withColumn("__o", F.lit(1))).withColumn("file", base_name(F.col("path")))
    newest = Window.partitionBy("file").orderBy(F.desc("stamp"), F.desc("__o"))
    return both.withColumn("__n", F.row_number().over(newest)).filter("__n = 1").drop("__n", "__o")


def fill_from(needed: DataFrame, have: DataFrame, listing: DataFrame) -> DataFrame:
    """Rows of ``listing`` (file, ...) for needed names that ``have`` lacks."""
    return listing.join(needed.select("file").distinct().join(have.select("file"), "file", "left_anti"), "file", "left_semi")


def find(files: DataFrame) -> DataFrame:
    """The descriptors among (name, text) rows, parsed, by name."""
    return files.filter(is_descriptor(F.col("text"))).select("name", parse(F.col("text")).alias("d"), F.octet_length("text").alias("bytes")).orderBy("name")


def summary(parsed: DataFrame) -> DataFrame:
    """A catalogue row per descriptor: sources' extent, outputs, level-0 format, bytes of both chains."""
    texture = parsed.select("name", F.posexplode("d.textures").alias("i", "t"), "d")
    level = texture.select("name", "i", "d", F.explode("t.mip_sizes").alias("s"), F.col("t.dxgi_format_id").alias("dxgi"), F.col("t.dxgi_format").alias("kind"))
    return level.groupBy("name").agg(
        F.first("d.decode.width").alias("width"), F.first("d.decode.height").alias("height"), F.first("d.decode.textures_out").alias("textures"), F.max(F.when(F.col("i") == 0, F.col("kind"))).alias("level0"), F.sum(level_bytes(F.col("dxgi"), F.col("s")[0], F.col("s")[1])).alias("bytes")
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of the JSON files of a folder."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.json")
    return files.select(base_name(F.col("_metadata.file_path")).alias("name"), F.col("value").alias("text"))


def prefix_of(name: Column, ending: str = "") -> Column:
    """A descriptor name or prefix without ``ending`` and .json."""
    return F.regexp_replace(name, rf"({ending})?\.json$", "")


def number(x: float) -> str:
    """The shortest text of a finite number; others are refused."""
    if not math.isfinite(x):
        raise ValueError("a descriptor holds finite numbers only")
    return repr(int(x)) if float(x).is_integer() and abs(x) < 1e15 else repr(float(x))


def build(width: int, height: int, textures_out: int, c0: int, c1: int, weights: Sequence[Sequence[float]], bias: Sequence[float], latents: Sequence[dict], inputs: Sequence[dict] = (), name: str = FORMAT) -> str:
    """The descriptor text of an asset; ``latents`` are the two levels' file entries."""
    flat = [float(x) for row in weights for x in row]
    for x in (*flat, *map(float, bias), *(float(v) for t in latents for v in (*t.get("dequantise", {}).get("lo", ()), *t.get("dequantise", {}).get("hi", ())))):
        number(x)
    nin = feature_count(c0, c1)
    value = {
        "format": name,
        "source": {"width": width, "height": height, "inputs": list(inputs)},
        "decode": {"width": width, "height": height, "textures_out": textures_out},
        "block": 4,
        "lod_bias_level1": 2,
        "textures": list(latents),
        "decoder": {"type": "affine", "terms": "a b sc", "C0": c0, "C1": c1, "nin": nin, "nout": len(bias), "layers": [{"rows": len(bias), "cols": nin, "weights": flat, "bias": list(map(float, bias))}]},
    }
    return json.dumps(value, indent=1)
