"""Material files: a JSON array of 1 to 6 textures, strictly read."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.functions.config import EDGES, FILTERS
from rasterloom.schema import MAX_TEXTURES, TEXTURE

_KINDS = {"file": str, "type": str, "filter": str, "srgb": bool, "edge": str, "normal_map": bool, "weight": (int, float), "rgb_weights": list}
RESULT = T.StructType([T.StructField("textures", T.ArrayType(TEXTURE)), T.StructField("error", T.StringType())])


def parse_text(text: str) -> tuple[list[dict] | None, str | None]:
    """The textures of one material text, or what is wrong and where."""

    def unique(pairs: list[tuple[str, object]]) -> dict:
        names = [k for k, _ in pairs]
        twice = [k for k in names if names.count(k) > 1]
        if twice:
            raise ValueError(f"key {twice[0]!r} is given twice")
        return dict(pairs)

    try:
        value = json.loads(text.removeprefix("﻿"), object_pairs_hook=unique)
    except json.JSONDecodeError as e:
        return None, f"line {e.lineno}, column {e.colno}: {e.msg}"
    except ValueError as e:
        return None, str(e)
    if not isinstance(value, list) or not 1 <= len(value) <= MAX_TEXTURES:
        return None, f"a material is a list of 1 to {MAX_TEXTURES} textures"
    for t, own in enumerate(value):
        if not isinstance(own, dict):
            return None, f"texture {t} isn't an object"
        for key, v in own.items():
            if key not in _KINDS:
                return None, f"texture {t}: unknown key {key!r}"
            if not isinstance(v, _KINDS[key]) or (isinstance(v, bool) and _KINDS[key] is not bool):
                return None, f"texture {t}: {key!r} has the wrong kind of value"
        if "file" not in own:
            return None, f"texture {t}: no file"
        if own.get("filter", "default") not in FILTERS or own.get("edge", "clamp") not in EDGES:
            return None, f"texture {t}: unknown filter or edge"
        if own.get("normal_map") and own.get("srgb"):
            return None, f"texture {t}: a normal map isn't srgb"
        if "rgb_weights" in own and (len(own["rgb_weights"]) != 3 or not all(isinstance(x, (int, float)) for x in own["rgb_weights"])):
            return None, f"texture {t}: rgb_weights are three numbers"
    rows = [{k: own.get(k) for k in _KINDS} for own in value]
    for r in rows:
        r["weight"] = None if r["weight"] is None else float(r["weight"])
        r["rgb_weights"] = None if r["rgb_weights"] is None else [float(x) for x in r["rgb_weights"]]
    return rows, None


def parse(text: Column) -> Column:
    """struct(textures, error): one of them is null. Strictness about keys needs the text, which from_json loses."""
    run = F.udf(lambda s: None if s is None else parse_text(s), RESULT)
    return run(text)


def read(spark: SparkSession, path: str) -> DataFrame:
    """material_id (the file), t, the settings, and ``source``: the texture's path resolved against the file's folder."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("material_id"), parse(F.col("value")).alias("m"))
    ok = files.filter(F.assert_true(F.col("m.error").isNull(), F.concat(F.col("material_id"), F.lit(": "), F.col("m.error"))).isNull())
    rows = ok.select("material_id", F.posexplode("m.textures").alias("t", "s")).select("material_id", "t", "s.*")
    folder = F.regexp_replace("material_id", r"[^/]*$", "")
    return rows.withColumn("source", F.when(F.col("file").rlike(r"^([a-z][a-z0-9+.-]*:)?/"), F.col("file")).otherwise(F.concat(folder, F.col("file"))))
