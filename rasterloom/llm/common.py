"""Helpers shared by the training-data operators.

Intermediate results that are read more than once are written as Parquet into
the folder named by ``spark.checkpoint.dir``: a written table survives the loss
of any executor, and it cuts the lineage.  Only when the session names no such
folder *and* runs in a single process (tests) is a default used.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only by a local master without spark.checkpoint.dir.
LOCAL_DEFAULT = "file:/tmp/checkpoints"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return LOCAL_DEFAULT


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody else uses."""
    return f"{shared_root(spark)}/rasterloom/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """While a job runs inside, Python workers get batches of at most ``rows`` rows: wide rows in bounded memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if rows is None:
        yield
        return
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Rows of a batch that carries whole texts to a Python worker.
TEXT_ROWS = 1024


def slices(batch: pa.RecordBatch, rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and about ``size`` bytes of text (one row at least)."""
    lengths = pc.fill_null(pc.binary_length(batch.column("text").cast(pa.binary())), 0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1
        end = min(batch.num_rows, at + rows, max(at + 1, end))
        yield batch.slice(at, end - at)
        at = end


def tidy(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` for a Python worker that gives freed memory back to the system when its task ends.

    Workers are used again by later tasks; without this each keeps the largest footprint it ever had.
    """

    def run(parts: Iterator) -> Iterator:
        try:
            yield from work(parts)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # glibc only
                ctypes.CDLL(None).malloc_trim(0)

    return run


def stage(df: DataFrame, name: str, rows: int | None = None, tasks: int | None = None, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back; ``rows`` as in ``arrow_rows``.

    ``tasks`` is the most tasks, and so files, of the last step: for results that are small beside the number of partitions.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with arrow_rows(spark, rows):
        (df if tasks is None else df.coalesce(tasks)).write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    if _SCOPES:
        _SCOPES[-1].append(out)
    return out


#: Tables staged inside ``scratch``, of the innermost one last.
_SCOPES: list[list[DataFrame]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes, at its end, all tables staged inside but those that the caller appends to the list it gives."""
    kept: list[DataFrame] = []
    _SCOPES.append([])
    try:
        yield kept
    finally:
        paths = {staged_path(k) for k in kept}
        for df in _SCOPES.pop():
            if staged_path(df) not in paths:
                drop(df)
        if _SCOPES:
            _SCOPES[-1].extend(kept)


def staged_path(df: DataFrame) -> str | None:
    return getattr(df, "_staged_path", None)


def drop(df: DataFrame) -> None:
    """Delete a staged table that no later plan reads."""
    path = staged_path(df)
    if path is None:
        return
    spark = df.sparkSession
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], hot: Column) -> DataFrame:
    """Inner join with a row per key, where keys that hold many of the ``rows`` may not meet in one task.

    ``hot`` tells these from the table's columns, by their share of all rows, so that there are few:
    their rows stay where they are and the table's are broadcast.  All other keys are shuffled.
    """
    few = F.broadcast(table.filter(hot))
    rest = rows.join(F.broadcast(table.filter(hot).select(*keys)), keys, "left_anti")
    return rows.join(few, keys).unionByName(rest.join(table.filter(~hot), keys))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of(key: Column, salt: str, digits: int) -> Column:
    """Bucket 0 .. 16**digits - 1 from an md5 draw; reproducible in any SQL."""
    return F.conv(F.substring(F.md5(F.concat_ws("", key, F.lit(salt))), 1, digits), 16, 10).cast("int")


def held_out_remainder(modulus: int) -> Column:
    """crc32 of doc_id's decimal text, modulo; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % F.lit(modulus)


def sampled(documents: DataFrame, chosen: DataFrame, columns: list[str]) -> DataFrame:
    """The texts of the ``chosen`` documents (doc_id, o, ...) as one partition, in the order of o, doc_id, the other ``columns`` and the text's hash.

    Equal rows count once, so copies of a row neither weigh more nor meet in the one task.  Spark
    sorts (and spills) there; whoever reads the rows takes as many as it has bounds for, in that order.
    """
    rows = documents.join(F.broadcast(chosen), "doc_id").select("o", "doc_id", *columns, "text", F.xxhash64("text").alias("h"))
    once = rows.groupBy("o", "doc_id", *columns, "h").agg(F.first("text").alias("text"))
    return once.repartition(1).sortWithinPartitions("o", "doc_id", *columns, "h")
