"""Per-row functions: index grids, colour transfer, features, block palettes.

All are built-in expressions on Columns.  Values are computed in double; where the
format stores floats, the caller rounds with ``as_float``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterloom.schema import BLOCK, MAX_MIPS


def lit(x: float) -> Column:
    return F.lit(float(x))


def as_float(x: Column) -> Column:
    """Rounded once to single precision, back in double."""
    return x.cast("float").cast("double")


def replicate_index(k: Column, bits: int) -> Column:
    """An index of ``bits`` bits repeated from the top of a byte down."""
    out, shift = None, 8 - bits
    while shift > -bits:
        part = F.shiftleft(k, shift) if shift >= 0 else F.shiftright(k, -shift)
        out = part if out is None else out.bitwiseOR(part)
        shift -= bits
    return out.bitwiseAND(F.lit(255))


def grid_value(lo: Column, hi: Column, bits: int, k: Column) -> Column:
    """lo + replicated(k) / 255 * (hi - lo), as stored: rounded to single precision."""
    return as_float(lo + replicate_index(k, bits).cast("double") / lit(255) * (hi - lo))


def grid_index(lo: Column, hi: Column, bits: int, value: Column) -> Column:
    """The index whose grid value is nearest; the lower one on ties; 0 on an empty range."""
    levels = (1 << bits) - 1
    span = hi - lo
    x = F.greatest(lit(0), F.least(lit(levels), (value - lo) / span * lit(levels)))
    guess = F.floor(x + lit(0.5)).cast("int")
    at = [F.greatest(F.lit(0), F.least(F.lit(levels), guess + d)) for d in (-1, 0, 1)]
    nearest = F.array_min(F.array(*[F.struct(F.abs(value - grid_value(lo, hi, bits, k)).alias("d"), k.alias("k")) for k in at]))["k"]
    return F.when(span > 0, nearest).otherwise(0).cast("int")


def palette_value(bits: int, k: Column, block: bool) -> Column:
    """Level-0 palette value on [-1, 1], as block format or as plain bytes store it."""
    share = k.cast("double") / lit((1 << bits) - 1) if block else replicate_index(k, bits).cast("double") / lit(255)
    return as_float(lit(-1) + lit(2) * share)


def palette(bits: int, block: bool) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit((1 << bits) - 1)), lambda k: palette_value(bits, k, block))


def feature_count(c0: int, c1: int) -> int:
    return c1 + c0 + c0 * c1


def halved(n: Column | int) -> Column | int:
    return max(1, n // 2) if isinstance(n, int) else F.greatest(F.lit(1), F.floor(n / 2).cast("int"))


def mip_count(w: int, h: int, least: int) -> int:
    """Further levels while both halves stay at ``least`` or more."""
    n = 0
    while n < MAX_MIPS and w // 2 >= least and h // 2 >= least:
        w, h, n = w // 2, h // 2, n + 1
    return n


def clamp01(c: Column) -> Column:
    """To [0, 1]; NaN becomes 0 (Spark sorts NaN above all numbers, so it is asked first)."""
    return F.when(F.isnan(c), lit(0)).otherwise(F.greatest(lit(0), F.least(lit(1), c)))


def srgb_to_linear(c: Column) -> Column:
    return F.when(c <= 0.04045, c / lit(12.92)).otherwise(F.pow((c + lit(0.055)) / lit(1.055), lit(2.4)))


def linear_to_srgb(c: Column) -> Column:
    return F.when(c <= 0.0031308, c * lit(12.92)).when(c >= 1, lit(1)).otherwise(lit(1.055) * F.pow(c, lit(1 / 2.4)) - lit(0.055))


def to_byte(c: Column) -> Column:
    """floor(255 * clamped + 0.5), with sums' last digits taken off first so that halves always go up."""
    return F.floor(F.round(clamp01(c) * lit(255), 9) + lit(0.5)).cast("int")


def renormalised(rgb: Sequence[Column]) -> list[Column]:
    """A tangent-space normal at unit length; other texels stay as they are."""
    n = [c * lit(2) - lit(1) for c in rgb]
    length = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    use = (length > 0.5) & (n[2] > 0)
    return [F.when(use, clamp01(v / length * lit(0.5) + lit(0.5))).otherwise(c) for v, c in zip(n, rgb, strict=True)]


def mse_to_db(mse: Column, peak: float = 1.0) -> Column:
    return F.when(mse > 0, lit(10) * F.log10(lit(peak * peak) / mse)).otherwise(lit(100))


def relative(a: Column, b: Column) -> Column:
    top = F.greatest(F.abs(a), F.abs(b))
    return F.when(top > 0, F.abs(a - b) / top).otherwise(lit(0))


def clamp_index(i: Column, n: Column | int) -> Column:
    return F.greatest(F.lit(0), F.least(i, (n if isinstance(n, Column) else F.lit(n)) - 1))


def features(s: Sequence[Column], c: Sequence[Column], terms: int = 7) -> list[Column]:
    """[c_j][s_i][s_i * c_j], i outside j: the decoder's input; ``terms`` keeps groups (1, 2 and 4, added up)."""
    groups = (list(c), list(s), [a * b for a in s for b in c])
    return [f for k, group in enumerate(groups) if terms >> k & 1 for f in group]


def monomials(s: Sequence[Column]) -> list[Column]:
    """1, s_i, s_i * s_j for i <= j."""
    return [lit(1), *s, *[s[i] * s[j] for i in range(len(s)) for j in range(i, len(s))]]


def monomial_count(c0: int) -> int:
    return 1 + c0 + c0 * (c0 + 1) // 2


def affine(weights: Sequence[Sequence[float]], bias: Sequence[float], phi: Sequence[Column]) -> list[Column]:
    """W . phi + b with literal weights, summed left to right."""
    out = []
    for row, b in zip(weights, bias, strict=True):
        total = lit(b)
        for w, p in zip(row, phi, strict=True):
            total = total + lit(w) * p
        out.append(total)
    return out


def bc4_entry(r0: Column, r1: Column, sel: Column) -> Column:
    """One palette entry of a block: eight interpolated values, or six with 0 and 255."""
    eight = F.when(sel == 0, r0.cast("double")).when(sel == 1, r1.cast("double")).otherwise(as_float(((F.lit(8) - sel) * r0 + (sel - 1) * r1).cast("double") / lit(7)))
    six = F.when(sel == 0, r0.cast("double")).when(sel == 1, r1.cast("double")).when(sel == 6, lit(0)).when(sel == 7, lit(255)).otherwise(as_float(((F.lit(6) - sel) * r0 + (sel - 1) * r1).cast("double") / lit(5)))
    return F.when(r0 > r1, eight).otherwise(six)


def bc4_palette(r0: Column, r1: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda s: bc4_entry(r0, r1, s))


def bc4_weight(sel: Column) -> Column:
    """Share of the high endpoint in each of the eight values."""
    return F.when(sel == 0, lit(1)).when(sel == 1, lit(0)).otherwise((F.lit(8) - sel).cast("double") / lit(7))


def byte_value(lo: Column, hi: Column, byte: Column) -> Column:
    return as_float(lo + byte / lit(255) * (hi - lo))


def level0_files(channels: int) -> int:
    return 1 if channels <= 2 else 2


def level0_file_channels(channels: int, file: int) -> int:
    return (1 if channels == 1 else 2) if file == 0 else channels - 2


def search_energy(a0: Column, a1: Sequence[Column], a2: Sequence[Sequence[Column]], x: Sequence[Column]) -> Column:
    """a0 + 2 x.a1 + x.a2.x"""
    total = a0
    for i, xi in enumerate(x):
        total = total + lit(2) * xi * a1[i]
        for j, xj in enumerate(x):
            total = total + xi * a2[i][j] * xj
    return total


# The texture formats that the files use, by their public identifiers.
FORMATS = {28: ("DXGI_FORMAT_R8G8B8A8_UNORM", "rgba8", 4), 49: ("DXGI_FORMAT_R8G8_UNORM", "rg8", 2), 61: ("DXGI_FORMAT_R8_UNORM", "r8", 1), 80: ("DXGI_FORMAT_BC4_UNORM", "bc4", 1), 83: ("DXGI_FORMAT_BC5_UNORM", "bc5", 2)}
BLOCK_FORMATS = (80, 83)


def _by_format(dxgi: Column, field: int) -> Column:
    out = None
    for key, value in FORMATS.items():
        out = F.when(dxgi == key, F.lit(value[field])) if out is None else out.when(dxgi == key, F.lit(value[field]))
    return out


def format_name(dxgi: Column) -> Column:
    return F.coalesce(_by_format(dxgi, 0), F.concat(F.lit("DXGI_FORMAT_"), dxgi.cast("string")))


def format_short_name(dxgi: Column) -> Column:
    return F.coalesce(_by_format(dxgi, 1), dxgi.cast("string"))


def format_channels(dxgi: Column) -> Column:
    return _by_format(dxgi, 2)


def level_bytes(dxgi: Column, w: Column, h: Column) -> Column:
    """Bytes of one level: whole 4x4 blocks in the block formats."""
    blocks = F.ceil(w / lit(BLOCK)).cast("long") * F.ceil(h / lit(BLOCK)).cast("long")
    return F.when(dxgi.isin(*BLOCK_FORMATS), blocks * format_channels(dxgi) * 8).otherwise(w.cast("long") * h * format_channels(dxgi))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def has_separator(path: Column) -> Column:
    return path.rlike(r"[/\\]")


def all_finite(values: Column) -> Column:
    return F.forall(values, lambda x: ~F.isnan(x) & (F.abs(x) < lit(math.inf)))


def level_image_name(prefix: Column, kind: str, textures: int, texture: Column, level: Column) -> Column:
    """<prefix>_<kind>[_t<n>][_M<m>].png"""
    t = F.when(F.lit(textures) > 1, F.concat(F.lit("_t"), texture.cast("string"))).otherwise(F.lit(""))
    m = F.when(level > 0, F.concat(F.lit("_M"), level.cast("string"))).otherwise(F.lit(""))
    return F.concat(prefix, F.lit(f"_{kind}"), t, m, F.lit(".png"))
