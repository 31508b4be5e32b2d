"""Images as pixel planes: header scans, PNG, BMP, ``formats`` and those of Spark's image source; PNG and BMP out."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.sources import formats

PIXELS = "path string, y int, x int, c0 double, c1 double, c2 double, alpha_ignored boolean"
_PNG = b"\x89PNG\r\n\x1a\n"
STRIP = 1 << 20  # pixels that a reader hands on at once
SENT = 1 << 18  # pixels of a picture that are sent from task to task at once
_RUN = "path string, run int, w int, h int, per int, last boolean, length long, adler long, bytes binary"


def dimensions(head: bytes) -> tuple[int, int] | None:
    """Width and height from a file's first bytes, without decoding; PNG, BMP, GIF, JPEG and those of ``formats``."""
    if head[:8] == _PNG and len(head) >= 24:
        return struct.unpack(">II", head[16:24])
    if head[:2] == b"BM" and len(head) >= 26:
        w, h = struct.unpack("<ii", head[18:26])
        return w, abs(h)
    if head[:3] == b"GIF" and len(head) >= 10:
        return struct.unpack("<HH", head[6:10])
    if head[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(head) and head[at] == 0xFF:
            if 0xC0 <= head[at + 1] <= 0xCF and head[at + 1] not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", head[at + 5 : at + 9])
                return w, h
            at += 2 + struct.unpack(">H", head[at + 2 : at + 4])[0]
        return None
    return formats.dimensions(head)


# The seven passes of an interlaced PNG as (first x, first y, step x, step y).
_PER = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}  # samples a pixel by colour type
_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _unfiltered(raw: np.ndarray, unit: int, before: np.ndarray | None = None) -> np.ndarray:
    """Rows of a PNG (filter byte, then data) with their filters undone; ``unit`` is a whole pixel's bytes, 1 at least, ``before`` the row above the first."""
    out = np.zeros((raw.shape[0], raw.shape[1] - 1), np.uint8)
    above = np.zeros(out.shape[1], np.uint8) if before is None else before
    if not raw[:, 0].any():
        out[:] = raw[:, 1:]
        return out
    for y, (kind, line) in enumerate(zip(raw[:, 0].tolist(), raw[:, 1:], strict=True)):
        if kind == 1:  # the left neighbour's value is a running sum
            width = -(-len(line) // unit)
            sums = np.cumsum(np.pad(line, (0, width * unit - len(line))).reshape(width, unit), 0, dtype=np.uint64)
            out[y] = (sums & 255).astype(np.uint8).ravel()[: len(line)]
        elif kind == 2:
            out[y] = line + above
        elif kind in (3, 4):  # each value needs the one before it
            got, up = line.tolist(), above.tolist()
            for i in range(len(got)):
                left, corner = (got[i - unit], up[i - unit]) if i >= unit else (0, 0)
                if kind == 3:
                    guess = (left + up[i]) // 2
                else:
                    d = (abs(up[i] - corner), abs(left - corner), abs(left + up[i] - 2 * corner))
                    guess = left if d[0] <= d[1] and d[0] <= d[2] else up[i] if d[1] <= d[2] else corner
                got[i] = (got[i] + guess) & 255
            out[y] = got
        else:
            out[y] = line
        above = out[y]
    return out


def _samples(rows: np.ndarray, w: int, per: int, depth: int, grey: bool) -> np.ndarray:
    """(h, w, per) bytes of unfiltered rows: the top byte of 16 bits, grey of fewer bits stretched."""
    h = len(rows)
    if depth == 16:
        rows = rows.reshape(h, w * per, 2)[:, :, 0]
    elif depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(h, -1, depth)[:, : w * per]
        rows = bits @ (1 << np.arange(depth - 1, -1, -1)) * (255 // ((1 << depth) - 1) if grey else 1)
    return rows.reshape(h, w, per).astype(np.uint8)


def _png_strips(f: BinaryIO) -> Iterator[np.ndarray]:
    """Rows of a PNG as it is stored (``decode_png``), some ``STRIP`` pixels at a time, out of a stream that is never held whole; an interlaced one is one strip."""
    if f.read(8) != _PNG:
        raise ValueError("not a PNG")
    inflate, held, above, done = zlib.decompressobj(), bytearray(), None, 0
    w = h = per = depth = colour = stride = 0
    plte, trns = b"", b""
    while True:
        head = f.read(8)
        if len(head) < 8:
            raise ValueError("a PNG that ends too soon")
        n, kind = struct.unpack(">I4s", head)
        if kind == b"IEND":
            break
        left = n
        while kind == b"IDAT" and left:
            part = f.read(min(left, STRIP))
            if not part:
                raise ValueError("a PNG that ends too soon")
            left -= len(part)
            while part:
                held += inflate.decompress(part, STRIP)
                part = inflate.unconsumed_tail
                rows = min(len(held) // stride, h - done)
                if rows and (done + rows == h or rows * w >= STRIP):
                    raw = np.frombuffer(bytes(held[: rows * stride]), np.uint8).reshape(rows, stride)
                    del held[: rows * stride]
                    plain = _unfiltered(raw, max(1, per * depth // 8), above)
                    above, done = plain[-1], done + rows
                    yield _resolved(_samples(plain, w, per, depth, colour == 0), colour, plte, trns)
        body = f.read(left)
        f.read(4)
        if kind == b"IHDR":
            w, h, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
            per = _PER[colour]
            stride = -(-w * per * depth // 8) + 1
            if interlace:
                f.seek(0)
                yield decode_png(f.read())
                return
        elif kind == b"PLTE":
            plte = body
        elif kind == b"tRNS":
            trns = body
    if done < h or not inflate.eof:
        raise ValueError("a PNG that ends too soon")


def _resolved(image: np.ndarray, colour: int, plte: bytes, trns: bytes) -> np.ndarray:
    """Palette indices as the colours they name; other pictures as they are."""
    if colour != 3:
        return image
    table, index = np.frombuffer(plte, np.uint8).reshape(-1, 3), image[..., 0]
    image = table[index]
    if trns:
        alpha = np.concatenate([np.frombuffer(trns, np.uint8), np.full(256 - len(trns), 255, np.uint8)])
        image = np.concatenate([image, alpha[index][..., None]], 2)
    return image


def decode_png(data: bytes) -> np.ndarray:
    """(h, w, channels) as stored, 8 or 16 bits reduced to the top byte; palettes resolved, interlacing undone."""
    if data[:8] != _PNG:
        raise ValueError("not a PNG")
    at, idat, plte, trns = 8, [], b"", b""
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        at += 12 + n
        if kind == b"IHDR":
            w, h, depth, colour, _, _, interlace = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            plte = body
        elif kind == b"tRNS":
            trns = body
        elif kind == b"IDAT":
            idat.append(body)
    per = _PER[colour]
    raw, start = np.frombuffer(zlib.decompress(b"".join(idat)), np.uint8), 0
    image = np.zeros((h, w, per), np.uint8)
    for x0, y0, dx, dy in _PASSES if interlace else ((0, 0, 1, 1),):
        pw, ph = -(-(w - x0) // dx), -(-(h - y0) // dy)
        if pw <= 0 or ph <= 0:
            continue
        stride = -(-pw * per * depth // 8) + 1
        rows = _unfiltered(raw[start : start + ph * stride].reshape(ph, stride), max(1, per * depth // 8))
        start += ph * stride
        image[y0::dy, x0::dx] = _samples(rows, pw, per, depth, colour == 0)
    return _resolved(image, colour, plte, trns)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _png_head(w: int, h: int, n: int) -> bytes:
    return _PNG + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[n], 0, 0, 0))


def encode_png(image: np.ndarray) -> bytes:
    """An 8-bit picture of (h, w, channels): grey, grey and alpha, RGB, or RGB and alpha."""
    h, w, n = image.shape
    return _png_head(w, h, n) + _chunk(b"IDAT", zlib.compress(_png_rows(image), 6)) + _chunk(b"IEND", b"")


def _png_rows(image: np.ndarray) -> bytes:
    h, w, n = image.shape
    return np.concatenate([np.zeros((h, 1), np.uint8), image.astype(np.uint8).reshape(h, w * n)], 1).tobytes()


def _adler(first: int, second: int, length: int) -> int:
    """The Adler-32 of two byte strings from theirs; ``length`` is the second's."""
    base = 65521
    a1, b1, a2, b2 = first & 0xFFFF, first >> 16, second & 0xFFFF, second >> 16
    return (b1 + b2 + length * (a1 - 1)) % base << 16 | (a1 + a2 - 1) % base


def _deflated(raw: bytes, last: bool) -> bytes:
    """A run of rows that can be put behind another one's in one stream."""
    pack = zlib.compressobj(6, zlib.DEFLATED, -15)
    return pack.compress(raw) + pack.flush(zlib.Z_FINISH if last else zlib.Z_FULL_FLUSH)


def decode_bmp(data: bytes) -> np.ndarray:
    """A 24-bit uncompressed bitmap as (h, w, 3) RGB, top row first."""
    if data[:2] != b"BM":
        raise ValueError("not a bitmap")
    start, size, w, h, planes, bits, packing = struct.unpack("<I I i i H H I", data[10:34])
    if size < 40 or planes != 1 or bits != 24 or packing != 0:
        raise ValueError("not a plain 24-bit bitmap")
    stride = -(-w * 3 // 4) * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(h), start).reshape(abs(h), stride)[:, : w * 3].reshape(abs(h), w, 3)
    return rows[:: -1 if h > 0 else 1, :, ::-1]


def _bmp_head(w: int, h: int) -> bytes:
    n = -(-w * 3 // 4) * 4 * h
    return b"BM" + struct.pack("<IHHI", 54 + n, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, n, 2835, 2835, 0, 0)


def _bmp_rows(rgb: np.ndarray) -> bytes:
    h, w = rgb.shape[:2]
    rows = np.zeros((h, -(-w * 3 // 4) * 4), np.uint8)
    rows[:, : w * 3] = rgb[::-1, :, ::-1].reshape(h, w * 3)
    return rows.tobytes()


def encode_bmp(rgb: np.ndarray) -> bytes:
    h, w = rgb.shape[:2]
    return _bmp_head(w, h) + _bmp_rows(rgb)


def to_rgb(image: np.ndarray) -> tuple[np.ndarray, bool]:
    """RGB bytes (grey repeated, alpha dropped) and whether a visible alpha was dropped."""
    n = image.shape[2]
    alpha = bool(n in (2, 4) and (image[..., -1] != 255).any())
    rgb = image[..., :1].repeat(3, 2) if n <= 2 else image[..., :3]
    return rgb, alpha


def _pixels(name: str, image: np.ndarray, top: int = 0, alpha: bool | None = None) -> Iterator[pd.DataFrame]:
    """Rows of ``PIXELS`` of a decoded picture, or of its part from row ``top`` on, strip by strip."""
    rgb, own = to_rgb(image)
    h, w = rgb.shape[:2]
    step = max(1, STRIP // max(1, w))
    for first in range(0, h, step):
        part = rgb[first : first + step]
        y, x = np.indices(part.shape[:2], dtype=np.int32)
        flat = part.reshape(-1, 3) / 255.0
        yield pd.DataFrame({"path": name, "y": top + first + y.ravel(), "x": x.ravel(), "c0": flat[:, 0], "c1": flat[:, 1], "c2": flat[:, 2], "alpha_ignored": own if alpha is None else alpha})


def strips(path: str) -> Iterator[np.ndarray]:
    """(rows, w, channels) bytes of a picture from its first row on; PNGs and bitmaps are read as a stream, others whole."""
    from rasterloom.sources.dds import _store

    store, at = _store(path)
    with store.open_input_file(at) as f:
        head = f.read(54)
        f.seek(0)
        if head[:8] == _PNG:
            yield from _png_strips(f)
        elif head[:2] == b"BM":
            yield from _bmp_strips(f, head)
        else:
            yield formats.decode(f.read())


def _bmp_strips(f: BinaryIO, head: bytes) -> Iterator[np.ndarray]:
    if len(head) < 34:
        raise ValueError("not a plain 24-bit bitmap")
    start, w, h = struct.unpack("<I4xii", head[10:26])
    size, _, _, planes, bits, packing = struct.unpack("<IiiHHI", head[14:34])
    if size < 40 or planes != 1 or bits != 24 or packing != 0:
        raise ValueError("not a plain 24-bit bitmap")
    stride, step = -(-w * 3 // 4) * 4, max(1, STRIP // max(1, w))
    for top in range(0, abs(h), step):
        n = min(step, abs(h) - top)
        f.seek(start + stride * (top if h < 0 else h - top - n))
        rows = np.frombuffer(f.read(n * stride), np.uint8).reshape(n, stride)[:, : w * 3].reshape(n, w, 3)
        yield rows[:: -1 if h > 0 else 1, :, ::-1]


def decode(data: bytes) -> np.ndarray:
    """(h, w, channels) bytes of a PNG, a bitmap or a picture of ``formats``."""
    return decode_png(data) if data[:8] == _PNG else decode_bmp(data) if data[:2] == b"BM" else formats.decode(data)


def sizes(files: DataFrame) -> DataFrame:
    """path, width, height from the headers of a ``binaryFile`` table; nulls for unknown formats."""
    @F.pandas_udf("width int, height int")
    def found(heads: pd.Series) -> pd.DataFrame:
        got = [dimensions(bytes(h)) if h is not None else None for h in heads]
        return pd.DataFrame([g or (None, None) for g in got], columns=["width", "height"]).astype("Int32")

    return files.select("path", found(F.substring("content", 1, 65536)).alias("s")).select("path", "s.width", "s.height")


def read(spark: SparkSession, path: str, pattern: str = "*.{png,bmp,tga,psd,hdr,pic,pgm,ppm,pnm}") -> DataFrame:
    """A row per pixel of every matching file under ``path``: path, y, x, c0, c1, c2 as byte / 255. Fails on a file that it can't decode."""

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for name in pdf["path"]:
                try:
                    alpha, top = None, 0
                    for image in strips(name):
                        h, w, n = image.shape
                        if alpha is None:  # what is said of every row is known only after a look at all of them
                            alpha = n in (2, 4) and any(to_rgb(part)[1] for part in strips(name))
                        step = max(1, SENT // max(1, w))
                        for first in range(0, h, step):
                            part = to_rgb(image[first : first + step])[0]
                            yield pd.DataFrame({"path": [name], "top": [top + first], "width": [w], "alpha": [alpha], "bytes": [part.tobytes()]})
                        top += h
                except Exception as e:
                    raise ValueError(f"{name} can't be decoded: {e}") from e

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for r in pdf.itertuples(index=False):
                yield from _pixels(r.path, np.frombuffer(r.bytes, np.uint8).reshape(-1, r.width, 3), r.top, r.alpha)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path")
    cores = spark.sparkContext.defaultParallelism
    parts = files.repartition(cores).mapInPandas(parse, "path string, top int, width int, alpha boolean, bytes binary")
    return parts.repartition(4 * cores).mapInPandas(rows, PIXELS)


def read_checked(spark: SparkSession, path: str, pattern: str = "*.{png,bmp,tga,psd,hdr,pic,pgm,ppm,pnm}") -> tuple[DataFrame, DataFrame]:
    """The pixels of the files that can be decoded, and (path, reason) of the others; each is a scan of its own."""

    def parse(wanted: bool):
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                for name, content in zip(pdf["path"], pdf["content"], strict=True):
                    try:
                        image = decode(bytes(content))
                    except Exception as e:  # whatever a damaged file does to a decoder, it is a row
                        if not wanted:
                            yield pd.DataFrame({"path": [name], "reason": [str(e) or type(e).__name__]})
                        continue
                    if wanted:
                        yield from _pixels(name, image)

        return run

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    return files.mapInPandas(parse(True), PIXELS), files.mapInPandas(parse(False), "path string, reason string")


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """The same rows through Spark's image source (JPEG, GIF and more), whose bytes are BGR and bottom-free. Fails on a file that it can't decode."""
    rows = spark.read.format("image").option("dropInvalid", "false").load(path).select("image.*")
    n, w = F.col("nChannels"), F.col("width")

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for name, h, wd, c, data in zip(pdf["origin"], pdf["height"], pdf["width"], pdf["nChannels"], pdf["data"], strict=True):
                if h < 0:
                    raise ValueError(f"{name} can't be decoded")
                a = np.frombuffer(bytes(data), np.uint8).reshape(int(h), int(wd), int(c))
                a = a if c == 1 else np.concatenate([a[..., 2::-1], a[..., 3:]], 2)
                yield from _pixels(name, a)

    return rows.select("origin", "height", w, n, "data").mapInPandas(parse, PIXELS)


def encode(planes: DataFrame, kind: str = "png") -> DataFrame:
    """(path, content) of pictures; ``planes`` has path, x, y and byte columns c0, c1, c2. A picture is one group; ``save`` takes those of any size."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        rgb = np.zeros((int(pdf["y"].max()) + 1, int(pdf["x"].max()) + 1, 3), np.uint8)
        rgb[pdf["y"].to_numpy(), pdf["x"].to_numpy()] = pdf[["c0", "c1", "c2"]].to_numpy(np.uint8)
        return pd.DataFrame({"path": [pdf["path"].iloc[0]], "content": [(encode_png if kind == "png" else encode_bmp)(rgb)]})

    return planes.groupBy("path").applyInPandas(build, "path string, content binary")


def _put(root: str, kind: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Runs (``_RUN``), together by path and in order, as one stream per file; a file appears under its name when it is whole."""
    from rasterloom.sources.dds import _store

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _store(root.rstrip("/"))
        out, part, due, adler, n = None, "", 0, 1, 0

        def add(run: int, data: bytes, last: bool, own: int, length: int) -> None:
            nonlocal due, adler
            due, adler = run + 1, _adler(adler, own, length)
            if kind == "png":
                data = _chunk(b"IDAT", (b"\x78\x9c" if run == 0 else b"") + data + (struct.pack(">I", adler) if last else b""))
            out.write(data)

        for pdf in parts:
            for r in pdf.itertuples(index=False):
                if r.run == 0 or out is None:
                    target = f"{base}/{r.path}"
                    store.create_dir(target.rsplit("/", 1)[0], recursive=True)
                    part, due, adler = f"{target}.{uuid.uuid4().hex}.part", 0, 1
                    out = store.open_output_stream(part)
                    out.write(_png_head(r.w, r.h, 3) if kind == "png" else _bmp_head(r.w, r.h))
                while due < r.run:  # a run without a pixel is black
                    raw = (_png_rows if kind == "png" else _bmp_rows)(np.zeros((r.per, r.w, 3), np.uint8))
                    add(due, _deflated(raw, False) if kind == "png" else raw, False, zlib.adler32(raw), len(raw))
                add(r.run, r.bytes, r.last, r.adler, r.length)
                if r.last:
                    if kind == "png":
                        out.write(_chunk(b"IEND", b""))
                    out.close()
                    store.move(part, f"{base}/{r.path}")
                    out, n = None, n + 1
        yield pd.DataFrame({"n": [n]})

    return work


def save(planes: DataFrame, root: str, kind: str = "png", pixels: int = SENT, keep: bool = True) -> None:
    """The pictures of ``encode`` written below ``root``: runs of rows are encoded side by side, and streamed into their file in order.

    No task holds more of a picture than a run of some ``pixels`` pixels (a row at least).  ``planes`` are read twice:
    ``keep`` writes them out before.
    """
    from rasterloom.session import forget, stored

    kept = planes.select("path", "x", "y", *[F.col(c).cast("short").alias(c) for c in ("c0", "c1", "c2")])
    kept = stored(kept, "picture-pixels") if keep else kept
    extents = stored(kept.groupBy("path").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h")), "picture-extents")
    # Run 0 is the file's first: a bitmap begins with its last row.
    run = F.floor((F.col("y") if kind == "png" else F.col("h") - 1 - F.col("y")) / F.col("per")).cast("int")
    cut = kept.join(extents.withColumn("per", F.greatest(F.lit(1), F.floor(F.lit(pixels) / F.col("w"))).cast("int")), "path").withColumn("run", run)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        w, h, per, at = int(r["w"]), int(r["h"]), int(r["per"]), int(r["run"])
        n = min(per, h - at * per)
        rgb = np.zeros((n, w, 3), np.uint8)
        rgb[pdf["y"].to_numpy() - (at * per if kind == "png" else h - at * per - n), pdf["x"].to_numpy()] = pdf[["c0", "c1", "c2"]].to_numpy(np.uint8)
        raw = _png_rows(rgb) if kind == "png" else _bmp_rows(rgb)
        last = (at + 1) * per >= h
        data = _deflated(raw, last) if kind == "png" else raw
        return pd.DataFrame({"path": [r["path"]], "run": [at], "w": [w], "h": [h], "per": [per], "last": [last], "length": [len(raw)], "adler": [zlib.adler32(raw)], "bytes": [data]})

    made = stored(cut.groupBy("path", "run").applyInPandas(build, _RUN), "picture-runs")
    made.repartition("path").sortWithinPartitions("path", "run").mapInPandas(_put(root, kind), "n long").agg(F.sum("n")).collect()
    forget(kept, extents, made)
