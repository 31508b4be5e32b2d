"""Texture container: levels as rows, and by slabs for files of any size.

*Slabs* (``read_slabs``, ``save_slabs``) are runs of rows of one level.  Reading plans a partition per (file,
level, slab) from the headers alone and reads that range of the file and no more; levels, rows and names that
aren't asked for are left out in planning.
Writing streams the slabs of a file in order, a batch at a time, into a hidden folder; files appear
under their names when all of the job's are whole, and none if it fails.

*Whole levels*: ``read_levels`` starts from the ``binaryFile`` source, so any store that Spark
reaches works, and parses in the executors.  ``write_levels`` packs a file's levels in one task and returns the
bytes as rows, which ``save_files`` puts into the target from the executors.
"""

from __future__ import annotations

import contextlib
import fnmatch
import struct
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from rasterloom.functions.scalar import BLOCK_FORMATS, FORMATS
from rasterloom.schema import DDS_LEVEL, MAX_EXTENT

# The container's layout (a magic, 31 header words, 5 extension words).
MAGIC, HEADER = b"DDS ", 148
_FLAGS, _MIPS, _PITCH, _LINEAR = 0x1007, 0x20000, 0x8, 0x80000
_CAPS_TEXTURE, _CAPS_COMPLEX, _CAPS_MIPMAP = 0x1000, 0x8, 0x400000
_FORMATS_READ = (28, 49, 61, 80, 83)


def level_size(dxgi: int, w: int, h: int) -> int:
    per = FORMATS[dxgi][2]
    return -(-w // 4) * -(-h // 4) * 8 * per if dxgi in BLOCK_FORMATS else w * h * per


def pack(w: int, h: int, dxgi: int, levels: list[bytes]) -> bytes:
    """A whole file from its levels, largest first."""
    return pack_header(w, h, dxgi, len(levels)) + b"".join(levels)


def pack_header(w: int, h: int, dxgi: int, mips: int) -> bytes:
    block = dxgi in BLOCK_FORMATS
    flags = _FLAGS | (_MIPS if mips > 1 else 0) | (_LINEAR if block else _PITCH)
    pitch = level_size(dxgi, w, h) if block else w * FORMATS[dxgi][2]
    caps = _CAPS_TEXTURE | (_CAPS_COMPLEX | _CAPS_MIPMAP if mips > 1 else 0)
    words = [124, flags, h, w, pitch, 0, mips, *[0] * 11, 32, 4, int.from_bytes(b"DX10", "little"), 0, 0, 0, 0, 0, caps, 0, 0, 0, 0, dxgi, 3, 0, 1, 0]
    return MAGIC + struct.pack("<36I", *words)


def parse_header(data: bytes, strict: bool = False) -> tuple[int, int, int, int]:
    """width, height, dxgi and the number of levels of a file that begins so; ValueError says what is wrong.

    ``strict`` also refuses what no viewer takes: extents beyond ``MAX_EXTENT``, which is what a graphics card holds, not
    the format.
    """
    if len(data) < HEADER or data[:4] != MAGIC:
        raise ValueError("not a texture container")
    words = struct.unpack("<36I", data[4:HEADER])
    size, flags, h, w, pitch, depth, mips = words[:7]
    caps, dxgi, dimension, misc, array = words[26], words[31], words[32], words[33], words[34]
    if size != 124 or words[18] != 32 or words[20] != int.from_bytes(b"DX10", "little"):
        raise ValueError("no extended header")
    if dimension != 3 or array != 1:
        raise ValueError("not one two-dimensional texture")
    most = MAX_EXTENT if strict else (1 << 31) - 1
    if not (1 <= w <= most and 1 <= h <= most):
        raise ValueError(f"extent {w} x {h} is out of range")
    if dxgi not in _FORMATS_READ:
        raise ValueError(f"format {dxgi} isn't read")
    mips = max(1, mips)
    if mips > max(w, h).bit_length():
        raise ValueError(f"{mips} levels are too many for {w} x {h}")
    if strict:
        expected = level_size(dxgi, w, h) if dxgi in BLOCK_FORMATS else w * FORMATS[dxgi][2]
        if flags & _FLAGS != _FLAGS or not caps & _CAPS_TEXTURE or pitch != expected or depth or misc:
            raise ValueError("header fields don't agree")
    return w, h, dxgi, mips


def layout(w: int, h: int, dxgi: int, mips: int) -> list[tuple[int, int, int, int, int, int]]:
    """(level, width, height, offset, bytes of a row, rows) of every level; a row is one of texels or of blocks."""
    out, at = [], HEADER
    for level in range(mips):
        rows = -(-h // 4) if dxgi in BLOCK_FORMATS else h
        stride = level_size(dxgi, w, h) // rows
        out.append((level, w, h, at, stride, rows))
        at, w, h = at + stride * rows, max(1, w // 2), max(1, h // 2)
    return out


def whole_size(w: int, h: int, dxgi: int, mips: int) -> int:
    _, _, _, offset, stride, rows = layout(w, h, dxgi, mips)[-1]
    return offset + stride * rows


def unpack(data: bytes, strict: bool = False) -> list[tuple[int, int, int, int, int, bytes]]:
    """(level, width, height, dxgi, channels, bytes) of every level; ValueError says what is wrong."""
    w, h, dxgi, mips = parse_header(data, strict)
    if whole_size(w, h, dxgi, mips) != len(data):
        raise ValueError(f"length is {len(data)}, not {whole_size(w, h, dxgi, mips)}")
    return [(level, lw, lh, dxgi, FORMATS[dxgi][2], data[at : at + stride * rows]) for level, lw, lh, at, stride, rows in layout(w, h, dxgi, mips)]


def read_levels(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Rows of every level of the files under ``path``; a file that isn't a container fails the query."""

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = [(name, *level) for name, content in zip(pdf["path"], pdf["content"], strict=True) for level in unpack(bytes(content), strict)]
            yield pd.DataFrame(rows, columns=["path", "level", "width", "height", "dxgi", "channels", "bytes"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.dds").load(path)
    return files.select("path", "content").mapInPandas(parse, DDS_LEVEL)


def write_levels(levels: DataFrame) -> DataFrame:
    """(path, content) of whole files from level rows."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values("level")
        first = own.iloc[0]
        return pd.DataFrame({"path": [first["path"]], "content": [pack(int(first["width"]), int(first["height"]), int(first["dxgi"]), [bytes(x) for x in own["bytes"]])]})

    return levels.groupBy("path").applyInPandas(build, "path string, content binary")


def _store(root: str):
    """The file system of a URI or path, and the path in it."""
    from pyarrow import fs

    if root.startswith("file:"):
        return fs.LocalFileSystem(), "/" + root[5:].lstrip("/")
    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)


def save_files(files: DataFrame, root: str) -> None:
    """Write (path, content) rows below ``root``, one file each, from the executors.

    ``root`` is a folder that all machines reach: file, hdfs, s3, gs, abfs.  A file appears under its name when it is
    whole, and a task that runs twice writes the same bytes.
    """

    def put(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _store(root.rstrip("/"))
        for pdf in parts:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                target = f"{base}/{path}"
                store.create_dir(target.rsplit("/", 1)[0], recursive=True)
                part = f"{target}.{uuid.uuid4().hex}.part"
                with store.open_output_stream(part) as out:
                    out.write(bytes(content))
                store.move(part, target)
            yield pd.DataFrame({"n": [len(pdf)]})

    files.select("path", "content").mapInPandas(put, "n long").agg(F.sum("n")).collect()


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class DdsReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.strict = options["path"], options.get("strict", "false") == "true"

    def partitions(self) -> list[InputPartition]:
        root = Path(self.root)
        return [_File(str(p)) for p in (sorted(root.glob("**/*.dds")) if root.is_dir() else [root])]

    def read(self, partition: _File):
        for level in unpack(Path(partition.path).read_bytes(), self.strict):
            yield (partition.path, *level)


class _Written(WriterCommitMessage):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class DdsWriter(DataSourceWriter):
    """Level rows, already together by path, to files of a mounted folder."""

    def __init__(self, options: dict) -> None:
        self.root = Path(options["path"])

    def write(self, rows) -> _Written:
        held: dict[str, list] = {}
        for r in rows:
            held.setdefault(r["path"], []).append(r)
        for path, levels in held.items():
            levels.sort(key=lambda r: r["level"])
            target = self.root / path
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_bytes(pack(levels[0]["width"], levels[0]["height"], levels[0]["dxgi"], [bytes(r["bytes"]) for r in levels]))
        return _Written(list(held))


class DdsSource(DataSource):
    """``spark.read.format("dds")`` and ``write.format("dds")`` for folders that every machine mounts."""

    @classmethod
    def name(cls) -> str:
        return "dds"

    def schema(self) -> str:
        return DDS_LEVEL

    def reader(self, schema) -> DataSourceReader:
        return DdsReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return DdsWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DdsSource)


SLAB = "path string, level int, width int, height int, dxgi int, channels int, levels int, row int, rows int, bytes binary"
SLAB_BYTES = 4 << 20
@dataclass
class _Slab(InputPartition):
    told: tuple
    offset: int
    length: int


class SlabReader(DataSourceReader):
    """A partition per (file, level, slab) of those that the options ask for.

    What to read is asked by options, not by ``pushFilters``: Spark 4.1.2 keeps a pushed filter with the table, so that a
    later query of the same DataFrame without it would miss rows (seen here: 3 rows, then 1).
    """

    def __init__(self, options: dict) -> None:
        self.root, self.strict, self.most = options["path"], options.get("strict", "false") == "true", int(options.get("slabBytes", SLAB_BYTES))
        self.levels = {int(v) for v in options["levels"].split(",")} if options.get("levels") else None
        self.rows = tuple(int(v) for v in options["rows"].split(":")) if options.get("rows") else None
        self.glob = options.get("pathGlobFilter")

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, base = _store(self.root)
        info = store.get_file_info(base)
        files = [info] if info.type == fs.FileType.File else [f for f in store.get_file_info(fs.FileSelector(base, recursive=True)) if f.type == fs.FileType.File and f.path.endswith(".dds") and not any(part.startswith(("_", ".")) for part in f.path[len(base) :].split("/"))]
        out: list[InputPartition] = []
        for f in sorted(files, key=lambda f: f.path):
            if self.glob and not fnmatch.fnmatchcase(f.path.rsplit("/", 1)[-1], self.glob):
                continue
            with store.open_input_file(f.path) as data:
                w, h, dxgi, mips = parse_header(data.read(HEADER), self.strict)
            if f.size != whole_size(w, h, dxgi, mips):
                raise ValueError(f"{f.path}: length is {f.size}, not {whole_size(w, h, dxgi, mips)}")
            for level, lw, lh, offset, stride, rows in layout(w, h, dxgi, mips):
                if self.levels is not None and level not in self.levels:
                    continue
                first, end = (max(0, self.rows[0]), min(rows, self.rows[1])) if self.rows else (0, rows)
                per = max(1, self.most // stride)
                for row in range(first, end, per):
                    n = min(per, end - row)
                    out.append(_Slab((f.path, level, lw, lh, dxgi, FORMATS[dxgi][2], mips, row, n), offset + row * stride, n * stride))
        return out

    def read(self, partition: _Slab) -> Iterator[tuple]:
        store, _ = _store(self.root)
        with store.open_input_file(partition.told[0]) as data:
            data.seek(partition.offset)
            yield (*partition.told, data.read(partition.length))


@dataclass
class _Moves(WriterCommitMessage):
    moves: list[tuple[str, str]]


class SlabWriter(DataSourceWriter):
    """Slabs, together by path and in order of level and row, as one stream per file; two phases."""

    def __init__(self, options: dict) -> None:
        self.root, self.job = options["path"], f"_slabs-{uuid.uuid4().hex}"

    def write(self, iterator) -> _Moves:
        store, base = _store(self.root.rstrip("/"))
        moves: list[tuple[str, str]] = []
        out, head, at, due = None, None, 0, []

        def close() -> None:
            if out is not None:
                out.close()
                if due:
                    raise ValueError(f"{head[0]}: level {due[0][0]} lacks rows from {due[0][1]} on")

        try:
            for r in iterator:
                if head is None or r["path"] != head[0]:
                    close()
                    head = (r["path"], r["width"], r["height"], r["dxgi"], r["levels"])
                    if r["level"] != 0 or r["row"] != 0:
                        raise ValueError(f"{head[0]} doesn't begin with its first row")
                    part = f"{base}/{self.job}/{uuid.uuid4().hex}/{head[0]}"
                    store.create_dir(part.rsplit("/", 1)[0], recursive=True)
                    out = store.open_output_stream(part)
                    out.write(pack_header(*head[1:]))
                    moves.append((part, f"{base}/{head[0]}"))
                    due = [[level, 0, rows, stride] for level, _, _, _, stride, rows in layout(*head[1:])]
                data = bytes(r["bytes"])
                if not due or (r["level"], r["row"]) != (due[0][0], due[0][1]) or len(data) % due[0][3] or r["row"] + len(data) // due[0][3] > due[0][2]:
                    raise ValueError(f"{head[0]}: row {r['row']} of level {r['level']} is out of place")
                out.write(data)
                due[0][1] += len(data) // due[0][3]
                if due[0][1] == due[0][2]:
                    due.pop(0)
            close()
        finally:
            if out is not None and not out.closed:
                out.close()
        return _Moves(moves)

    def _gone(self) -> None:
        store, base = _store(self.root.rstrip("/"))
        with contextlib.suppress(FileNotFoundError):
            store.delete_dir(f"{base}/{self.job}")

    def commit(self, messages) -> None:
        store, _ = _store(self.root.rstrip("/"))
        moves = [move for m in messages if m is not None for move in m.moves]
        if len({to for _, to in moves}) < len(moves):
            self._gone()
            raise ValueError("slabs of one file lie in several partitions")
        for part, to in moves:
            store.create_dir(to.rsplit("/", 1)[0], recursive=True)
            store.move(part, to)
        self._gone()

    def abort(self, messages) -> None:
        self._gone()


class SlabSource(DataSource):
    """``spark.read.format("texture_slabs")`` and ``write.format("texture_slabs")``."""

    @classmethod
    def name(cls) -> str:
        return "texture_slabs"

    def schema(self) -> str:
        return SLAB

    def reader(self, schema) -> DataSourceReader:
        return SlabReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return SlabWriter(self.options)


def read_slabs(spark: SparkSession, path: str, levels: Sequence[int] | None = None, rows: tuple[int, int] | None = None, names: str | None = None, strict: bool = False, slab_bytes: int = SLAB_BYTES) -> DataFrame:
    """Rows (``SLAB``) of runs of rows of every level of the files under ``path``, about ``slab_bytes`` each; hidden files are left out.

    ``levels``, ``rows`` (from, and up to but without) and ``names`` (a pattern of file names) leave out what isn't asked
    for before a byte of it is read; of files of other names not even the header.
    """
    spark.dataSource.register(SlabSource)
    read = spark.read.format("texture_slabs").option("strict", str(strict).lower()).option("slabBytes", str(slab_bytes))
    for key, value in (("levels", levels is not None and ",".join(str(v) for v in levels)), ("rows", rows and f"{rows[0]}:{rows[1]}"), ("pathGlobFilter", names)):
        read = read.option(key, value) if value else read
    return read.load(path)


def save_slabs(slabs: DataFrame, root: str) -> None:
    """Write slabs (``SLAB``; path below ``root``, rows counted by the bytes) as whole files: all of them, or none."""
    spark = slabs.sparkSession
    spark.dataSource.register(SlabSource)
    names = [f.split()[0] for f in SLAB.split(", ")]
    slabs.select(*names).repartition("path").sortWithinPartitions("path", "level", "row").write.format("texture_slabs").mode("append").save(root)


def join_files(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two files of one latent side by side: per level, both byte strings; unequal level sizes fail the query."""
    a, b = (df.select("level", "width", "height", F.col("dxgi").alias(f"dxgi{i}"), F.col("channels").alias(f"channels{i}"), F.col("bytes").alias(f"bytes{i}")) for i, df in enumerate((first, second)))
    both = a.join(b.withColumnsRenamed({"width": "w1", "height": "h1"}), "level", "full")
    same = (F.col("width") == F.col("w1")) & (F.col("height") == F.col("h1"))
    return both.filter(F.assert_true(F.coalesce(same, F.lit(False)), F.lit("the files' levels differ")).isNull()).drop("w1", "h1")
