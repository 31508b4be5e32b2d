"""A folder of assets over time: versioned snapshots of its files, tombstones, and damaged files as rows.

A snapshot is a table of what a folder held at a version; a file that is gone later is a *tombstone*, so that a
merge of snapshots in any order says what holds now and what held before.  ``examine`` looks at every
file (the first bytes of containers and pictures, all of a descriptor) and never fails for
one: what can't be read is a row with its reason, the quarantine, and the others go on.

Defined cases: of equal versions the larger (size, digest) of a name wins, and a file beats a tombstone; names keep their
folders; Spark's binary source leaves empty files out, so they aren't in a snapshot (and are damaged if named); a descriptor that names a file which is missing, damaged
or a path is listed with that; an empty folder gives empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.sources import dds, descriptor, images

SNAPSHOT = "name string, version int, size long, digest string, deleted boolean"
EXAMINED = "name string, kind string, width int, height int, levels int, reason string"
#: Bytes of a picture that are looked at.
HEAD = 1 << 16
_PICTURES = ("png", "bmp", "tga", "psd", "hdr", "pic", "ppm", "pgm", "pnm", "jpg", "jpeg", "gif")


def _below(path: Column, root: str) -> Column:
    """A path's part below ``root``, whatever scheme Spark puts before it."""
    at = root.split("://")[-1].removeprefix("file:").rstrip("/").lstrip("/") + "/"
    return F.element_at(F.split(path, f"\\Q{at}\\E", 2), -1)


def snapshot(spark: SparkSession, root: str, version: int) -> DataFrame:
    """``SNAPSHOT`` rows of all files under ``root``, by content: equal files have equal digests."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(_below(F.col("path"), root).alias("name"), F.lit(version).alias("version"), F.col("length").alias("size"), F.sha2("content", 256).alias("digest"), F.lit(False).alias("deleted"))


def tombstones(names: DataFrame, version: int) -> DataFrame:
    """``SNAPSHOT`` rows that say ``names`` (name) are gone from ``version`` on."""
    return names.select("name", F.lit(version).alias("version"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("string").alias("digest"), F.lit(True).alias("deleted"))


def merge(*snapshots: DataFrame) -> DataFrame:
    """The latest row of every name, tombstones included: one aggregation, in whatever order the snapshots come."""
    rows = snapshots[0]
    for other in snapshots[1:]:
        rows = rows.unionByName(other)
    newest = F.max(F.struct("version", (~F.col("deleted")).alias("there"), "size", "digest")).alias("m")
    return rows.groupBy("name").agg(newest).select("name", "m.version", "m.size", "m.digest", (~F.col("m.there")).alias("deleted"))


def as_of(history: DataFrame, version: int) -> DataFrame:
    """What was there at a version: merged up to it, without what was gone."""
    return merge(history.filter(F.col("version") <= version)).filter("not deleted")


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(name, change) between two merged snapshots: added, removed, changed."""
    there = lambda df, n: df.filter("not deleted").select("name", F.col("digest").alias(n))
    both = there(before, "a").join(there(after, "b"), "name", "full")
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return both.select("name", kind.alias("change")).filter("change is not null")


def _look(name: str, head: bytes, size: int) -> tuple:
    """(kind, width, height, levels, reason) of one file by its first bytes."""
    ending = name.rsplit(".", 1)[-1].lower()
    try:
        if not size:
            raise ValueError("the file is empty")
        if ending == "dds":
            w, h, dxgi, mips = dds.parse_header(head[: dds.HEADER])
            if size != dds.whole_size(w, h, dxgi, mips):
                raise ValueError(f"length is {size}, not {dds.whole_size(w, h, dxgi, mips)}")
            return "container", w, h, mips, None
        if ending in _PICTURES:
            found = images.dimensions(head)
            if found is None:
                raise ValueError("not a picture that is known")
            return "picture", *found, 1, None
        return "other", None, None, None, None
    except Exception as e:  # whatever a damaged file does to a parser, it is a row
        return {"dds": "container"}.get(ending, "picture" if ending in _PICTURES else "other"), None, None, None, str(e) or type(e).__name__


def examine(spark: SparkSession, root: str, names: DataFrame) -> DataFrame:
    """``EXAMINED`` rows of the files ``names`` (name, size) under ``root``; ``reason`` is null for those that can be read.

    Of containers and pictures the first bytes are read, where the row is; descriptors are parsed as tables.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = dds._store(root.rstrip("/"))
        for pdf in parts:
            rows = []
            for name, size in zip(pdf["name"], pdf["size"], strict=True):
                try:
                    with store.open_input_file(f"{base}/{name}") as f:
                        head = f.read(HEAD)
                except OSError as e:
                    rows.append((name, "other", None, None, None, type(e).__name__))
                    continue
                rows.append((name, *_look(name, head, int(size))))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in EXAMINED.split(", ")]).astype({c: "Int32" for c in ("width", "height", "levels")})

    binary = names.filter("lower(name) not like '%.json'").select("name", "size").mapInPandas(run, EXAMINED)
    texts = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(root, wholetext=True)
    texts = texts.select(_below(F.col("_metadata.file_path"), root).alias("name"), F.col("value").alias("text")).join(names.select("name"), "name", "left_semi")
    parsed = texts.select("name", descriptor.parse(F.col("text")).alias("d"), descriptor.is_descriptor(F.col("text")).alias("is"))
    wrong = descriptor.violations(parsed.filter("is")).groupBy("name").agg(F.array_join(F.sort_array(F.collect_list("error")), "; ").alias("broken"))
    told = parsed.join(wrong, "name", "left")
    reason = F.when(~F.coalesce(F.col("is"), F.lit(False)), F.lit("not a descriptor")).otherwise(F.col("broken"))
    rows = told.select("name", F.lit("descriptor").alias("kind"), F.col("d.decode.width").cast("int").alias("width"), F.col("d.decode.height").cast("int").alias("height"), F.element_at("d.textures", 1)["mip_count"].cast("int").alias("levels"), reason.alias("reason"))
    return binary.unionByName(rows)


def listing(live: DataFrame, examined: DataFrame) -> DataFrame:
    """name, version, size, kind, width, height, levels, state and reason: ok, or damaged with what is wrong."""
    rows = live.filter("not deleted").select("name", "version", "size").join(examined, "name", "left")
    state = F.when(F.col("kind").isNull(), "unseen").when(F.col("reason").isNull(), "ok").otherwise("damaged")
    return rows.select("name", "version", "size", "kind", "width", "height", "levels", state.alias("state"), "reason")


def quarantine(listed: DataFrame) -> DataFrame:
    """(name, reason) of what can't be read."""
    return listed.filter("state = 'damaged'").select("name", "reason")
