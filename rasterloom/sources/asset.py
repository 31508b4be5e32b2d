"""Assets as files: both latents' level chains and the descriptor, written from planes or fits, read back as planes.

Writing is one ordered aggregation (texels or blocks to rows) and a stream of those rows per file; reading
starts from ranges of a file (``dds.read_slabs``) and is projections from there on, so no task
ever holds a level.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions.config import Options
from rasterloom.functions.scalar import BLOCK_FORMATS, FORMATS, bc4_entry, grid_index, grid_value, level0_file_channels, level0_files, level_image_name, lit, replicate_index, to_byte
from rasterloom.operators import aggregate as A
from rasterloom.operators import blocks as B
from rasterloom.operators import resample as R
from rasterloom.operators import sampling
from rasterloom.operators.verify import grid_violations
from rasterloom.schema import BLOCK, channels
from rasterloom.sources import dds, descriptor, images

# The formats of 1 to 4 stored bytes a texel, and of 1 or 2 channels of blocks.
PLAIN = {1: 61, 2: 49, 3: 28, 4: 28}
BLOCKED = {1: 80, 2: 83}
_FILE = "path string, content binary"


@dataclass
class Asset:
    """Planes (plane, x, y, channels as values), extents and the decoder; ``record`` is the parsed descriptor."""

    level0: DataFrame
    level1: DataFrame
    size: DataFrame
    weights: list[list[float]]
    bias: list[float]
    record: dict

    def decode(self) -> DataFrame:
        return sampling.decode(self.level0, self.level1, self.size, self.weights, self.bias)

    def sample(self, points: DataFrame, **how) -> DataFrame:
        return sampling.sample(points, self.level0, self.level1, self.size, self.weights, self.bias, **how)


def _joined(pieces: Column) -> Column:
    """Ordered (at ..., hex) structs of a group as one byte string."""
    return F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list(pieces)), lambda p: p["hex"]), ""))


def _slab_rows(rows: DataFrame, size: DataFrame, path: str, dxgi: int, w: str, h: str) -> DataFrame:
    """Container slabs (``dds.SLAB``) of ``rows`` (plane, y, bytes: one row of texels or blocks each)."""
    sized = R.with_extent(rows, size, {"width": w, "height": h})
    levels = R.deepest(size) + 1
    told = [F.lit(path).alias("path"), F.col("plane").alias("level"), "width", "height", F.lit(dxgi).alias("dxgi"), F.lit(FORMATS[dxgi][2]).alias("channels"), F.lit(levels).alias("levels")]
    return sized.select(*told, F.col("y").alias("row"), F.lit(1).alias("rows"), "bytes")


def plain_levels(stored: DataFrame, size: DataFrame, path: str, w: str = "w1", h: str = "h1") -> DataFrame:
    """Slabs of one to four byte channels a texel; a stored channel that isn't used holds 255."""
    own = channels(stored)
    dxgi = PLAIN[len(own)]
    texel = F.concat(*[F.lpad(F.hex(F.col(c).cast("long")), 2, "0") for c in own], *[F.lit("FF")] * (FORMATS[dxgi][2] - len(own)))
    rows = stored.select("plane", "x", "y", texel.alias("hex")).groupBy("plane", "y").agg(_joined(F.struct("x", "hex")).alias("bytes"))
    return _slab_rows(rows, size, path, dxgi, w, h)


def block_levels(blocks: DataFrame, size: DataFrame, path: str, n: int) -> DataFrame:
    """Slabs of ``n`` (one or two) channels of encoded blocks (plane, ch, bx, by, r0, r1, sel), the channels of a block side by side."""
    packed = B.pack(blocks, "__b").select("plane", "bx", F.col("by").alias("y"), "ch", F.hex("__b").alias("hex"))
    rows = packed.groupBy("plane", "y").agg(_joined(F.struct("bx", "ch", "hex")).alias("bytes"))
    return _slab_rows(rows, size, path, BLOCKED[n], "w0", "h0")


def gather_levels(indices: DataFrame, size: DataFrame) -> DataFrame:
    """``blocks.gather`` for a whole chain: long indices (plane, ch, x, y, v) by block, each level's edge texels repeated."""
    sized = R.with_extent(indices, size, {"__w": "w0", "__h": "h0"})
    for c, n in (("x", F.col("__w")), ("y", F.col("__h"))):
        last = F.when(F.col(c) == n - 1, F.sequence(n - 1, (F.ceil(n / lit(BLOCK)) * BLOCK - 1).cast("int"))).otherwise(F.array(F.col(c)))
        sized = sized.withColumn(c, F.explode(last))
    x, y = F.col("x"), F.col("y")
    own = ["plane", "ch", F.floor(x / BLOCK).cast("int").alias("bx"), F.floor(y / BLOCK).cast("int").alias("by")]
    return sized.groupBy(*own).agg(B.sixteen(x, y, F.col("v")).alias("v"))


def closed_bytes(indices: DataFrame, lo: Sequence[float], hi: Sequence[float], bits: int) -> DataFrame:
    """Level-1 indices as stored bytes; an index that doesn't quantise back to itself fails the query."""
    out = indices
    for c, a, b in zip(channels(indices), lo, hi, strict=True):
        k = F.col(c)
        back = grid_index(lit(a), lit(b), bits, grid_value(lit(a), lit(b), bits, k))
        out = out.withColumn(c, F.when(back == k, replicate_index(k, bits)).otherwise(F.raise_error(F.lit("a level-1 index isn't closed on its grid")).cast("int")))
    return out


def _entry(files: Sequence[str], level: int, sizes: Sequence[tuple[int, int]], dxgi: Sequence[int], used: int, lo: Sequence[float], hi: Sequence[float], bits: Sequence[int]) -> dict:
    """One latent of the descriptor."""
    named = {"file": files[0]} if len(files) == 1 else {"files": list(files)}
    return named | {
        "level": level,
        "width": sizes[0][0],
        "height": sizes[0][1],
        "dxgi_format": FORMATS[dxgi[0]][0],
        "dxgi_format_id": dxgi[0],
        "channels_used": used,
        "channels_stored": sum(FORMATS[d][2] for d in dxgi),
        "bits_per_channel": list(bits),
        "mip_count": len(sizes),
        "mip_sizes": [list(s) for s in sizes],
        "dequantise": {"kind": "range", "lo": [float(v) for v in lo], "hi": [float(v) for v in hi]},
    }


def _level0_names(name: str, c0: int) -> list[str]:
    return [f"{name}_level0.dds"] if level0_files(c0) == 1 else [f"{name}_level0_{i}.dds" for i in range(2)]


def write(level0: DataFrame, level1: DataFrame, size: DataFrame, weights: Sequence[Sequence[float]], bias: Sequence[float], grid0: tuple[Sequence[float], Sequence[float]], grid1: tuple[Sequence[float], Sequence[float]], root: str, name: str, bits1: int = 8, packed: bool = True) -> None:
    """The asset ``name`` below ``root``: the containers first, the descriptor last.

    ``level0`` holds 8-bit indices, packed as blocks or stored as bytes, ``level1`` indices of ``bits1`` bits; the grids
    are (lows, highs) by channel.  Numbers that aren't finite and indices that aren't closed are refused.
    """
    c0, c1 = len(channels(level0)), len(channels(level1))
    extents = sorted((r["plane"], r["w0"], r["h0"], r["w1"], r["h1"]) for r in size.collect())  # a row per level: 13 at most
    sizes0, sizes1 = [r[1:3] for r in extents], [r[3:5] for r in extents]
    names, counts = _level0_names(name, c0), [level0_file_channels(c0, i) for i in range(level0_files(c0))]
    if packed:
        dxgi0 = [BLOCKED[n] for n in counts]
        blocks = B.encode(gather_levels(R.to_long(level0), size), 8)
        first = [block_levels(blocks.filter(f"ch between {sum(counts[:i])} and {sum(counts[: i + 1]) - 1}"), size, f, counts[i]) for i, f in enumerate(names)]
    else:
        names, dxgi0 = [f"{name}_level0.dds"], [PLAIN[c0]]
        first = [plain_levels(level0, size, names[0], "w0", "h0")]
    second = plain_levels(closed_bytes(level1, *grid1, bits1), size, f"{name}_level1.dds")
    latents = [_entry(names, 0, sizes0, dxgi0, c0, *grid0, [8] * c0), _entry([f"{name}_level1.dds"], 1, sizes1, [PLAIN[c1]], c1, *grid1, [bits1] * c1)]
    text = descriptor.build(*sizes0[0], len(bias) // 3, c0, c1, weights, bias, latents)
    levels = second
    for one in first:
        levels = levels.unionByName(one)
    dds.save_slabs(levels, root)
    spark = level0.sparkSession
    dds.save_files(spark.createDataFrame([(f"{name}.json", bytearray(text.encode()))], _FILE), root)


def _lines(slabs: DataFrame) -> DataFrame:
    """A row per row of texels or blocks of every slab: plane, width, height, y, slab; where the slab was read."""
    stride = (F.octet_length("bytes") / F.col("rows")).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda i: F.struct((F.col("row") + i).alias("y"), F.substring(F.col("bytes"), i * stride + 1, stride).alias("slab")))
    rows = slabs.select(F.col("level").alias("plane"), "width", "height", F.explode(parts).alias("p"))
    return rows.select("plane", "width", "height", "p.y", "p.slab")


def _byte(piece: Column, at: int) -> Column:
    return F.conv(F.hex(F.substring(piece, at, 1)), 16, 10).cast("int")


def texels(slabs: DataFrame, dxgi: int) -> DataFrame:
    """Byte values (plane, x, y, c0, ...) of one file's slabs, all of the format ``dxgi``; without a shuffle."""
    stored, block = FORMATS[dxgi][2], dxgi in BLOCK_FORMATS
    unit = stored * 8 if block else stored
    piece = lambda i: F.substring(F.col("slab"), i * unit + 1, F.lit(unit))
    count = (F.octet_length("slab") / unit).cast("int")
    cut = _lines(slabs).select("plane", "width", "height", "y", F.posexplode(F.transform(F.sequence(F.lit(0), count - 1), piece)).alias("x", "piece"))
    if not block:
        return cut.select("plane", "x", "y", *[_byte(F.col("piece"), 1 + c).cast("double").alias(f"c{c}") for c in range(stored)])
    rows = cut
    for c in range(stored):
        own = B.unpack(rows.withColumn("__b", F.substring("piece", 8 * c + 1, 8)), "__b").drop("__b")
        rows = own.withColumnsRenamed({n: f"__{n}{c}" for n in ("r0", "r1", "sel")})
    rows = rows.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(BLOCK * BLOCK - 1))))
    x, y = F.col("x") * BLOCK + F.pmod(F.col("t"), F.lit(BLOCK)), F.col("y") * BLOCK + F.floor(F.col("t") / BLOCK).cast("int")
    values = [bc4_entry(F.col(f"__r0{c}"), F.col(f"__r1{c}"), F.element_at(f"__sel{c}", F.col("t") + 1)).alias(f"c{c}") for c in range(stored)]
    return rows.select("plane", x.alias("x"), y.alias("y"), "width", "height", *values).filter("x < width and y < height").drop("width", "height")


def _read_latent(spark: SparkSession, root: str, latent: dict) -> DataFrame:
    """A latent's stored bytes, its one or two files side by side, channels that aren't used left out."""
    files = latent["files"] or [latent["file"]]
    files = [json.loads(f)["file"] if f.startswith("{") else f for f in files]
    used, out, have = latent["channels_used"], None, 0
    expected = F.array(*[F.array(*[F.lit(int(v)) for v in s]) for s in latent["mip_sizes"]])
    for file in files:
        slabs = dds.read_slabs(spark, f"{root.rstrip('/')}/{file}")
        head = dds.read_slabs(spark, f"{root.rstrip('/')}/{file}", levels=[0], rows=(0, 1)).select("dxgi").first()["dxgi"]
        same = (F.col("levels") == latent["mip_count"]) & (F.array("width", "height") == F.element_at(expected, F.col("level") + 1))
        # In a projection, not a filter: a reader's own filter on the level must not be folded into the check.
        checked = slabs.withColumn("bytes", F.when(same, F.col("bytes")).otherwise(F.raise_error(F.lit(f"{file} has other levels than its descriptor says")).cast("binary")))
        own = texels(checked, head)
        n = min(FORMATS[head][2], used - have)
        own = own.select("plane", "x", "y", *[F.col(f"c{i}").alias(f"c{have + i}") for i in range(n)])
        out, have = own if out is None else out.join(own, ["plane", "x", "y"]), have + n
    return out


def load(spark: SparkSession, root: str, name: str) -> Asset:
    """The asset ``name`` (with or without .json) below ``root``; a descriptor that breaks a rule or lacks a file is refused.

    The driver sees the descriptor alone: a few hundred numbers.
    """
    name = name.removesuffix(".json")
    text = spark.read.text(f"{root.rstrip('/')}/{name}.json", wholetext=True).select(F.lit(name).alias("name"), F.col("value").alias("text"))
    found = descriptor.find(text)
    rows = found.select(F.to_json("d").alias("d")).collect()
    if not rows:
        raise ValueError(f"{name} isn't an asset's descriptor")
    broken = [r["error"] for r in descriptor.violations(found).collect()]
    if broken:
        raise ValueError(f"{name}: " + "; ".join(sorted(broken)))
    flat = [r["file"] for r in descriptor.named_files(found).collect()]
    if any("/" in f or "\\" in f for f in flat):
        raise ValueError(f"{name}: its files are paths, not names")
    here = {r["path"].rsplit("/", 1)[-1] for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.dds").load(root).select("path").collect() if r["path"].rsplit("/", 1)[-1] in flat}
    if set(flat) - here:
        raise ValueError(f"{name}: files are missing: {', '.join(sorted(set(flat) - here))}")
    d = json.loads(rows[0]["d"])
    for t in d["textures"]:
        t.setdefault("files", None)
        t["channels_used"] = t.get("channels_used") or len(t["dequantise"]["lo"])
    planes = [sampling.dequantise(_read_latent(spark, root, t), t["dequantise"]["lo"], t["dequantise"]["hi"]) for t in d["textures"]]
    sizes = [(m, *a, *b) for m, (a, b) in enumerate(zip(d["textures"][0]["mip_sizes"], d["textures"][1]["mip_sizes"], strict=True))]
    layer, nin = d["decoder"]["layers"][-1], d["decoder"]["nin"]
    weights = [layer["weights"][i : i + nin] for i in range(0, len(layer["weights"]), nin)]
    return Asset(*planes, R.geometry_table(spark, sizes), weights, layer["bias"], d)


def quality(asset: Asset, source: DataFrame) -> DataFrame:
    """Per level and texture: squared byte error and decibels against the source chain, and (texture -1) the worst texture's."""
    by = A.psnr(A.byte_errors(source, asset.decode()))
    worst = A.worst_texture(by).select("plane", F.lit(-1).alias("texture"), F.lit(None).cast("double").alias("mse"), "psnr")
    return by.unionByName(worst)


def closure(asset: Asset) -> DataFrame:
    """Per level and channel of level 1: values off their grid and indices that don't quantise to themselves."""
    t = asset.record["textures"][1]
    bits, out = t["bits_per_channel"], None
    for c, (lo, hi) in enumerate(zip(t["dequantise"]["lo"], t["dequantise"]["hi"], strict=True)):
        own = asset.level1.select("plane", F.lit(c).alias("ch"), F.col(f"c{c}").alias("v")).withColumn("k", grid_index(lit(lo), lit(hi), bits[c], F.col("v")))
        rows = grid_violations(own, lo, hi, bits[c])
        out = rows if out is None else out.unionByName(rows)
    return out


def level_pixels(planes: DataFrame, prefix: str, kind: str) -> DataFrame:
    """A picture per level and texture of ``planes`` (channels in [0, 1]) as ``images.save`` takes it; ``kind`` is recon or src."""
    n = len(channels(planes)) // 3
    out = None
    for t in range(n):
        own = planes.select(level_image_name(F.lit(prefix), kind, n, F.lit(t), F.col("plane")).alias("path"), "x", "y", *[to_byte(F.col(f"c{3 * t + i}")).alias(f"c{i}") for i in range(3)])
        out = own if out is None else out.unionByName(own)
    return out


def level_pictures(planes: DataFrame, prefix: str, kind: str) -> DataFrame:
    """(path, content) of their PNGs, a picture whole in one row."""
    return images.encode(level_pixels(planes, prefix, kind))


def _block_bytes(r0: np.ndarray, r1: np.ndarray, sel: np.ndarray) -> bytes:
    """(rows, columns, channels) endpoints and (..., 16) selectors as the container's bytes."""
    bits = (sel.astype(np.uint64) << (3 * np.arange(16, dtype=np.uint64))).sum(-1)
    low = bits.astype("<u8")[..., None].view(np.uint8)[..., :6]
    return np.concatenate([r0[..., None].astype(np.uint8), r1[..., None].astype(np.uint8), low], -1).tobytes()


def fitted_files(fitted: DataFrame, options: Options | None = None) -> DataFrame:
    """(path, content) of every file of fitted materials (rows of ``plans.fit.fit``); a material, as in its fit, is one group."""
    o = options or Options()

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf["material_id"].iloc[0]
        parts: dict[tuple[str, int], np.ndarray] = {}
        for r in pdf.itertuples():
            kind = "<f8" if r.part in ("weights", "bias", "lo0", "hi0", "lo1", "hi1") else "<i8"
            parts[r.part, r.plane] = np.frombuffer(bytes(r.data), kind).reshape(r.height, r.width, r.channels)
        levels = 1 + max(plane for _, plane in parts)
        get = lambda part, plane=-1: parts[part, plane]
        size0, size1 = ([get(p, m).shape[1::-1] for m in range(levels)] for p in ("level0", "level1"))
        c0, c1 = get("level0", 0).shape[2], get("level1", 0).shape[2]
        repeated = lambda k, bits: sum((k << s if s >= 0 else k >> -s) for s in range(8 - bits, -bits, -bits)) & 255
        lo1, hi1 = get("lo1").ravel(), get("hi1").ravel()
        files, stored1 = [], FORMATS[PLAIN[c1]][2]
        plain = []
        for m in range(levels):
            k = get("level1", m)
            if not ((k >= 0) & (k < 1 << o.bits1)).all():
                raise ValueError(f"{name}: a level-1 index isn't closed on its grid")
            plain.append(np.concatenate([repeated(k, o.bits1), np.full((*k.shape[:2], stored1 - c1), 255)], 2).astype(np.uint8).tobytes())
        files.append((f"{name}_level1.dds", dds.pack(*size1[0], PLAIN[c1], plain)))
        if ("r0", 0) in parts:
            lo0, hi0, names, counts = get("lo0").ravel(), get("hi0").ravel(), _level0_names(name, c0), [level0_file_channels(c0, i) for i in range(level0_files(c0))]
            dxgi0, bits0 = [BLOCKED[n] for n in counts], [8] * c0
            for i, file in enumerate(names):
                own = slice(sum(counts[:i]), sum(counts[: i + 1]))
                chain = [_block_bytes(get("r0", m)[..., own], get("r1", m)[..., own], get("sel", m).reshape(*get("r0", m).shape, 16)[..., own, :]) for m in range(levels)]
                files.append((file, dds.pack(*size0[0], dxgi0[i], chain)))
        else:
            lo0, hi0, names, dxgi0, bits0 = [-1.0] * c0, [1.0] * c0, [f"{name}_level0.dds"], [PLAIN[c0]], list(o.palette_bits)
            stored = FORMATS[PLAIN[c0]][2]
            chain = [np.concatenate([np.stack([repeated(get("level0", m)[..., c], bits0[c]) for c in range(c0)], 2), np.full((*get("level0", m).shape[:2], stored - c0), 255)], 2).astype(np.uint8).tobytes() for m in range(levels)]
            files.append((names[0], dds.pack(*size0[0], PLAIN[c0], chain)))
        bias = get("bias").ravel()
        latents = [_entry(names, 0, size0, dxgi0, c0, lo0, hi0, bits0), _entry([f"{name}_level1.dds"], 1, size1, [PLAIN[c1]], c1, lo1, hi1, [o.bits1] * c1)]
        files.append((f"{name}.json", descriptor.build(*size0[0], len(bias) // 3, c0, c1, get("weights").reshape(len(bias), -1), bias, latents).encode()))
        return pd.DataFrame(files, columns=["path", "content"])

    return fitted.groupBy("material_id").applyInPandas(build, _FILE)


def encoded_slabs(encoded, sizes: Sequence[tuple[int, int, int, int, int]], options: Options, edge: int) -> DataFrame:
    """Container slabs (``dds.SLAB``) of tiles that ``plans.encode`` gave: every tile's part of a row, put together by row.

    A level-1 value that isn't on its grid, or an index that isn't closed, fails.
    """
    from rasterloom.operators import latents as L
    from rasterloom.plans import packing as Q
    from rasterloom.plans import tiles as T

    c0, c1, bits1, bits0, packed = options.c0, options.c1, options.bits1, list(options.palette_bits), options.l0 == "bc8"
    counts = [level0_file_channels(c0, i) for i in range(level0_files(c0))]
    stored1, mips = FORMATS[PLAIN[c1]][2], len(sizes)
    schema = "path string, level int, width int, height int, dxgi int, channels int, row int, tx int, bytes binary"

    def plain(k: np.ndarray, bits: Sequence[int], stored: int) -> np.ndarray:
        own = np.stack([L.replicate(k[..., c], bits[c]) for c in range(k.shape[2])], 2)
        return np.concatenate([own, np.full((*k.shape[:2], stored - k.shape[2]), 255)], 2).astype(np.uint8)

    def rows_of(r) -> list[tuple]:
        own0, own1 = T.Grid(r.h0, r.w0, r.h1, r.w1, edge).own(r.ty, r.tx)
        lo1, hi1 = np.asarray(r.lo1, float), np.asarray(r.hi1, float)
        v1 = T._array(r.v1, own1)
        k1 = L.grid_index(lo1, hi1, bits1, v1)
        if not (L.grid_value(lo1, hi1, bits1, k1) == v1).all():
            raise ValueError(f"{r.material_id}: a level-1 value isn't on its grid")
        out, name = [], r.material_id
        data = plain(k1, [bits1] * c1, stored1)
        out += [(f"{name}_level1.dds", r.plane, r.w1, r.h1, PLAIN[c1], stored1, own1[0] + y, r.tx, data[y].tobytes()) for y in range(own1[2])]
        if packed:
            r0, r1, sel = Q._blocks_of(r, own0, c0)
            for i, file in enumerate(_level0_names(name, c0)):
                part = slice(sum(counts[:i]), sum(counts[: i + 1]))
                dxgi = BLOCKED[counts[i]]
                out += [(file, r.plane, r.w0, r.h0, dxgi, FORMATS[dxgi][2], own0[0] // BLOCK + y, r.tx, _block_bytes(r0[y : y + 1, :, part], r1[y : y + 1, :, part], sel[y : y + 1, :, part])) for y in range(len(r0))]
        else:
            v0, stored0 = T._array(r.v0, own0), FORMATS[PLAIN[c0]][2]
            tables = [L.grid_value(np.array(-1.0), np.array(1.0), b, np.arange(1 << b)) for b in bits0]
            k0 = np.stack([np.abs(v0[..., c, None] - t).argmin(-1) for c, t in enumerate(tables)], 2)
            data = plain(k0, bits0, stored0)
            out += [(f"{name}_level0.dds", r.plane, r.w0, r.h0, PLAIN[c0], stored0, own0[0] + y, r.tx, data[y].tobytes()) for y in range(own0[2])]
        return out

    def work(parts):
        for pdf in parts:
            for r in pdf.itertuples(index=False):
                yield pd.DataFrame(rows_of(r), columns=[c.split()[0] for c in schema.split(", ")])

    pieces = encoded.tiles.join(encoded.grids, "material_id").mapInPandas(work, schema).withColumn("hex", F.hex("bytes"))
    rows = pieces.groupBy("path", "level", "row").agg(*[F.first(c).alias(c) for c in ("width", "height", "dxgi", "channels")], _joined(F.struct("tx", "hex")).alias("bytes"))
    return rows.select("path", "level", "width", "height", "dxgi", "channels", F.lit(mips).alias("levels"), "row", F.lit(1).alias("rows"), "bytes")


def write_encoded(encoded, sizes: Sequence[tuple[int, int, int, int, int]], root: str, options: Options | None = None, edge: int = 256) -> None:
    """The assets of all materials that ``plans.encode`` gave, by slabs: containers first, descriptors last.

    The driver sees a row per material: its decoder and its grids.
    """
    o = options or Options()
    dds.save_slabs(encoded_slabs(encoded, sizes, o, edge), root)
    packed = o.l0 == "bc8"
    counts = [level0_file_channels(o.c0, i) for i in range(level0_files(o.c0))]
    sizes0, sizes1 = [s[1:3] for s in sorted(sizes)], [s[3:5] for s in sorted(sizes)]
    texts = []
    for r in encoded.models.select("material_id", "w", "b").join(encoded.grids, "material_id").toLocalIterator():
        bias = np.frombuffer(bytes(r["b"]), "<f8")
        weights = np.frombuffer(bytes(r["w"]), "<f8").reshape(len(bias), -1)
        names = _level0_names(r["material_id"], o.c0) if packed else [f"{r['material_id']}_level0.dds"]
        dxgi0 = [BLOCKED[n] for n in counts] if packed else [PLAIN[o.c0]]
        first = _entry(names, 0, sizes0, dxgi0, o.c0, r["lo0"], r["hi0"], [8] * o.c0 if packed else list(o.palette_bits))
        second = _entry([f"{r['material_id']}_level1.dds"], 1, sizes1, [PLAIN[o.c1]], o.c1, r["lo1"], r["hi1"], [o.bits1] * o.c1)
        text = descriptor.build(*sizes0[0], len(bias) // 3, o.c0, o.c1, weights.tolist(), bias.tolist(), [first, second])
        texts.append((f"{r['material_id']}.json", bytearray(text.encode())))
    dds.save_files(encoded.tiles.sparkSession.createDataFrame(texts, _FILE), root)


def write_fitted(materials: DataFrame, root: str, options: Options | None = None, most: int | None = None) -> None:
    """Materials (material_id, plane, x, y, channels) fitted and written as assets: a task each up to ``most`` pixels, larger ones by tiles and slabs."""
    from rasterloom.plans import encode as E
    from rasterloom.plans import fit as P

    o = options or Options()
    _, cw = P._checked(materials, o)
    small, large = P.parted(materials, P.GROUP_PIXELS if most is None else most)
    if small is not None:
        dds.save_files(fitted_files(P.fit(small, o), o), root)
    if large:
        chains = E.chains_of(materials, large, o)
        got = E.encode_chains(chains, cw, o)
        names = [n for part in large.values() for n in part]
        for name, (_, sizes) in zip(names, chains, strict=True):
            mine = E.Encoded(*[df.filter(F.col("material_id") == name) for df in (got.tiles, got.models, got.report, got.grids)])
            write_encoded(mine, sizes, root, o, E.EDGE)
