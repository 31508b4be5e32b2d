"""The read side: decoding planes and sampling assets at arbitrary positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions.scalar import affine, byte_value, clamp01, features, renormalised
from rasterloom.operators import resample as R
from rasterloom.schema import KEYS, channels


def decode(level0: DataFrame, level1: DataFrame, size: DataFrame, weights: Sequence[Sequence[float]], bias: Sequence[float], keys: Sequence[str] = KEYS) -> DataFrame:
    """Every plane at its texel centres: level 0 as stored, level 1 blended, features, affine map, clamped to [0, 1]."""
    s = channels(level0)
    texels = level0.select(*keys, "x", "y", *[F.col(c).alias(f"s{i}") for i, c in enumerate(s)])
    z = [f"z{i}" for i in range(len(channels(level1)))]
    read = R.read_level1(texels, level1, size, z, keys)
    out = affine(weights, bias, features([F.col(f"s{i}") for i in range(len(s))], [F.col(c) for c in z]))
    return read.select(*keys, "x", "y", *[clamp01(o).alias(f"c{i}") for i, o in enumerate(out)])


def dequantise(plane: DataFrame, lo: Sequence[float], hi: Sequence[float]) -> DataFrame:
    """Stored bytes to values, lo + byte / 255 * (hi - lo)."""
    own = channels(plane)
    return plane.withColumns({c: byte_value(F.lit(float(a)), F.lit(float(b)), F.col(c).cast("double")) for c, a, b in zip(own, lo, hi, strict=True)})


def _read_level(points: DataFrame, plane: DataFrame, size: DataFrame, names: Sequence[str], mode: str) -> DataFrame:
    """``points`` with one level's values at (u, v, lod); ``size`` holds that level's extents as w0, h0."""
    if mode == "trilinear":
        return R.trilinear(points, plane, size, names)
    if mode == "bilinear":
        return R.bilinear_of_level(points, plane, size, names)
    whole = points.withColumn("__own", F.struct(*points.columns)).withColumn("lod", F.floor(F.col("lod") + F.lit(0.5)))
    level = F.least(F.greatest(F.lit(0), F.col("lod").cast("int")), F.lit(R.deepest(size)))
    at = R.with_extent(whole.withColumn("plane", level), size, {"__w": "w0", "__h": "h0"})
    cell = lambda p, n: F.greatest(F.lit(0), F.least(F.floor(p * F.col(n)).cast("int"), F.col(n) - 1))
    texels = plane.select("plane", F.col("x").alias("__x"), F.col("y").alias("__y"), *[F.col(c).alias(n) for c, n in zip(channels(plane), names, strict=True)])
    return at.withColumns({"__x": cell(F.col("u"), "__w"), "__y": cell(F.col("v"), "__h")}).join(texels, ["plane", "__x", "__y"]).select("__own.*", *names)


def _shown(read: DataFrame, kept: Sequence[str], names0: Sequence[str], names1: Sequence[str], weights, bias, terms: int, texture: int | None, renorm: bool, raw: int | None) -> DataFrame:
    """What a reader sees of the two levels' values: a level as stored, or the decoder's outputs."""
    if raw is not None:
        return read.select(*kept, *(names1 if raw else names0))
    out: list[Column] = [clamp01(o) for o in affine(weights, bias, features([F.col(c) for c in names0], [F.col(c) for c in names1], terms))]
    if texture is not None:
        out = out[3 * texture : 3 * texture + 3]
        out = renormalised(out) if renorm else out
    return read.select(*kept, *[o.alias(f"c{i}") for i, o in enumerate(out)])


def sample(points: DataFrame, level0: DataFrame, level1: DataFrame, size: DataFrame, weights: Sequence[Sequence[float]], bias: Sequence[float], mode: str = "bilinear", mips: bool = True, texture: int | None = None, renorm: bool = False, raw: int | None = None, terms: int = 7) -> DataFrame:
    """An asset at points (u, v, lod and id columns).

    ``mode`` is point, bilinear or trilinear; without ``mips`` the base is read. Both
    levels are read from the same mip, whatever their extents. ``texture`` keeps one
    texture's outputs, ``renorm`` re-lengthens them, ``raw`` returns a level's own
    channels, ``terms`` are the groups of features that the weights have.
    """
    points = points if mips else points.withColumn("lod", F.lit(0.0))
    points = points if mode == "trilinear" else points.withColumn("lod", F.floor(F.col("lod") + F.lit(0.5)).cast("double"))
    names0, names1 = [f"s{i}" for i in range(len(channels(level0)))], [f"z{i}" for i in range(len(channels(level1)))]
    read = _read_level(_read_level(points, level0, size, names0, mode), level1, R.level1_extents(size), names1, mode)
    return _shown(read, points.columns, names0, names1, weights, bias, terms, texture, renorm, raw)


GRADIENTS = ("dudx", "dvdx", "dudy", "dvdy")


def quad_gradients(pixels: DataFrame, fine: bool = False, keys: Sequence[str] = ()) -> DataFrame:
    """``pixels`` (keys, px, py, u, v and any columns) with their ``GRADIENTS``: differences within quads of 2 x 2 pixels.

    A quad is the four pixels of equal halves of px and py, as a rasteriser shades them. Coarse gradients are the
    quad's upper row's and left column's for all four, fine ones each pixel's own row's and column's. Where a pixel
    of a difference is missing, at the edge of what was drawn, the quad's other row or column gives it; without
    that it is 0. One shuffle by quad; rows at one pixel share its gradients (of the largest u and v there).
    """
    if set(GRADIENTS) & set(pixels.columns):
        raise ValueError("the pixels have gradients already")
    odd = lambda c: F.pmod(F.col(c), F.lit(2))
    half = lambda c: F.floor(F.col(c) / 2)
    quad = Window.partitionBy(*keys, half("px"), half("py"))
    lane = lambda c, i: F.max(F.when((odd("px") == i % 2) & (odd("py") == i // 2), F.col(c))).over(quad)
    held = pixels.withColumns({f"__{c}{i}": lane(c, i) for c in ("u", "v") for i in range(4)})
    across = lambda c, y: F.col(f"__{c}{2 * y + 1}") - F.col(f"__{c}{2 * y}")
    down = lambda c, x: F.col(f"__{c}{2 + x}") - F.col(f"__{c}{x}")

    def pick(one: Column, other: Column, at: Column) -> Column:
        own = F.when(at == 1, F.coalesce(other, one)).otherwise(F.coalesce(one, other)) if fine else F.coalesce(one, other)
        return F.coalesce(own, F.lit(0.0))

    found = {f"d{c}dx": pick(across(c, 0), across(c, 1), odd("py")) for c in ("u", "v")} | {f"d{c}dy": pick(down(c, 0), down(c, 1), odd("px")) for c in ("u", "v")}
    return held.select(*pixels.columns, *[g.alias(n) for n, g in found.items()])


def footprints(points: DataFrame, size: DataFrame, scale: float = 1.0, most: int = 1) -> DataFrame:
    """``points`` with what a pixel's gradients cover in a texture: __lod, __probes and the longer axis __du, __dv.

    ``size`` holds the texture's extents as w0, h0; the gradients are multiplied by
    ``scale`` first. A footprint longer than wide takes as many probes along its longer
    axis as it is times longer (``most`` at most), each of a level that much finer.
    Without any gradient the level is 0; a null one counts as 0.
    """
    gx, gy = ([F.coalesce(F.col(g), F.lit(0.0)) * F.lit(float(scale)) for g in own] for own in (GRADIENTS[:2], GRADIENTS[2:]))
    at = R.with_extent(points.withColumn("plane", F.lit(0)), size, {"__w": "w0", "__h": "h0"})
    length = lambda g: F.sqrt(g[0] * F.col("__w") * (g[0] * F.col("__w")) + g[1] * F.col("__h") * (g[1] * F.col("__h")))
    at = at.withColumns({"__across": length(gx), "__down": length(gy)})
    at = at.withColumns({"__long": F.greatest("__across", "__down"), "__short": F.least("__across", "__down")})
    times = F.when(F.col("__long") <= F.col("__short"), F.lit(1.0)).when(F.col("__short") == 0, F.lit(float(most))).otherwise(F.ceil(F.col("__long") / F.col("__short")).cast("double"))
    at = at.withColumn("__probes", F.least(times, F.lit(float(most))))
    lod = F.when(F.col("__long") > 0, F.log2(F.col("__long") / F.col("__probes"))).otherwise(F.lit(0.0))
    axis = [F.when(F.col("__across") >= F.col("__down"), a).otherwise(b) for a, b in zip(gx, gy, strict=True)]
    return at.select(*points.columns, lod.alias("__lod"), F.col("__probes").cast("int").alias("__probes"), axis[0].alias("__du"), axis[1].alias("__dv"))


def sample_gradients(points: DataFrame, level0: DataFrame, level1: DataFrame, size: DataFrame, weights: Sequence[Sequence[float]], bias: Sequence[float], mode: str = "trilinear", mips: bool = True, level1_scale: float = 4.0, most: int = 8, texture: int | None = None, renorm: bool = False, raw: int | None = None, terms: int = 7) -> DataFrame:
    """An asset at points (u, v, ``GRADIENTS`` and id columns) whose level of detail follows from their gradients.

    ``mode`` is one of ``sample`` or anisotropic: the mean of up to ``most`` trilinear
    probes along the footprint's longer axis. Level 1 is a quarter of level 0 a side, so
    its gradients are multiplied by ``level1_scale`` to read the same mip; 1 reads its own.
    Equal rows are read once and come back as often as they were; columns named lod stay.
    """
    kept, probing = points.columns, mode == "anisotropic"
    names0, names1 = [f"s{i}" for i in range(len(channels(level0)))], [f"z{i}" for i in range(len(channels(level1)))]
    read = points.groupBy(F.struct(*kept).alias("__point")).agg(F.count(F.lit(1)).alias("__copies")) if probing else points.select(F.struct(*kept).alias("__point"), F.lit(1).alias("__copies"))
    for plane, extents, names, scale in ((level0, size, names0, 1.0), (level1, R.level1_extents(size), names1, level1_scale)):
        own = read.select(F.struct(*read.columns).alias("__all"), *[F.col("__point")[c].alias(c) for c in ("u", "v", *GRADIENTS)])
        at = footprints(own, extents, scale, most if probing else 1)
        at = at.withColumn("lod", F.col("__lod") if mips else F.lit(0.0))
        if probing:
            at = at.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__probes"))))
            along = F.col("__i") / (F.col("__probes") + 1) - F.lit(0.5)
            at = at.withColumns({"u": F.col("u") + F.col("__du") * along, "v": F.col("v") + F.col("__dv") * along})
        got = _read_level(at.select("__all", "u", "v", "lod"), plane, extents, names, "trilinear" if probing else mode)
        got = got.groupBy("__all").agg(*[F.avg(n).alias(n) for n in names]) if probing else got
        read = got.select("__all.*", *names)
    read = read.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))) if probing else read
    return _shown(read.select("__point.*", *names0, *names1), kept, names0, names1, weights, bias, terms, texture, renorm, raw)


def shown_channel(plane: DataFrame, which: int) -> DataFrame:
    """One channel as grey; a negative number shows the plane as it is."""
    own = channels(plane)
    return plane if which < 0 else plane.withColumns({c: F.col(own[which]) for c in own})
