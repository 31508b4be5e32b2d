"""Reshaping and resampling of planes.

Positional access is the engine's join, and most of it can be had without one.
Extents come from a table of a row per plane, 13 for a chain, and are put into the
plan as an expression.  Sites lie within half a texel of their pixel, so all that
they read is in the pixel's own 3 x 3 neighbourhood: two window passes bring it into
the pixel's row (``neighbourhood``), level 1 joins once per pixel, and the sites are
made inside the row.  Points anywhere are read through *cells*: a cell is the square
between four neighbouring texels, with its four clamped corners as columns, built by
one aggregation of the plane that is read, and a point then needs a single equi-join
on (keys, cell) instead of one per tap.  No broadcast is forced here but of extents
that are counted first.

Planes are dense: a row for every texel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom.functions.scalar import clamp01, lit, linear_to_srgb, mip_count, renormalised, srgb_to_linear
from rasterloom.schema import BLOCK, GEOMETRY, KEYS, channels

# The sub-texel offsets of a pixel, before rotation.
OFFSETS = {0: (), 1: ((0.25, 0.25),), 2: ((-0.25, 0.25), (0.25, -0.25)), 4: ((-0.375, -0.125), (-0.125, 0.375), (0.125, -0.375), (0.375, 0.125))}
# The directions of the nine-point stencil that a texel owns; the others are transposes.
STENCIL = ((0, 0), (1, 0), (-1, 1), (0, 1), (1, 1))
#: Planes whose extents are written into a plan; up to SENT rows of them are broadcast, more are joined by a shuffle.
CASES, SENT = 64, 100_000


def geometry(w: int, h: int, levels: int | None = None, least: int = 8) -> list[tuple[int, int, int, int, int]]:
    """(plane, w0, h0, w1, h1) of every level: both latents' sizes are halved on their own."""
    levels = mip_count(w, h, least) if levels is None else levels
    out = [(0, w, h, w // BLOCK, h // BLOCK)]
    for m in range(1, levels + 1):
        out.append((m, *(max(1, n // 2) for n in out[-1][1:])))
    return out


def geometry_table(spark: SparkSession, sizes: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """The levels as a table; few of them are remembered with it, so that nothing is read to plan with them."""
    out = spark.createDataFrame(sizes, GEOMETRY)
    names = [field.split()[0] for field in GEOMETRY.split(", ")]
    out._few = [dict(zip(names, row, strict=True)) for row in sizes] if len(sizes) <= CASES else None
    return out


def _few_rows(size: DataFrame) -> list[dict] | None:
    """The rows of a table of extents if there are CASES at most."""
    if not hasattr(size, "_few"):
        rows = size.limit(CASES + 1).collect()
        size._few = [r.asDict() for r in rows] if len(rows) <= CASES else None
    return size._few


def with_extent(df: DataFrame, size: DataFrame, names: dict[str, str], keys: Sequence[str] = KEYS) -> DataFrame:
    """``df`` with its plane's columns of ``size``, as new: old name in ``names``; rows of planes that it lacks go.

    ``size`` has a row per plane: one expression if they are few, else a join (of a counted broadcast up to SENT rows).
    """
    rows = _few_rows(size)
    if rows is None:
        own = size.select(*keys, *[F.col(old).alias(new) for new, old in names.items()])
        return df.join(F.broadcast(own) if own.count() <= SENT else own, list(keys))

    def pick(old: str) -> Column:
        out = F.lit(None).cast("int")
        for row in reversed(rows):
            here = F.lit(True)
            for key in keys:
                here = here & (F.col(key) == F.lit(row[key]))
            out = F.when(here, F.lit(row[old])).otherwise(out)
        return out

    out = df.withColumns({new: pick(old) for new, old in names.items()})
    return out.filter(F.col(next(iter(names))).isNotNull())


def deepest(size: DataFrame) -> int:
    """The last plane of a chain."""
    rows = _few_rows(size)
    found = size.agg(F.max("plane")).first()[0] if rows is None else max((r["plane"] for r in rows), default=None)
    return -1 if found is None else found


def level1_extents(size: DataFrame) -> DataFrame:
    """The extents of level 1 in the place of level 0's."""
    out = size.select("plane", F.col("w1").alias("w0"), F.col("h1").alias("h0"), "w1", "h1")
    rows = _few_rows(size)
    out._few = None if rows is None else [r | {"w0": r["w1"], "h0": r["h1"]} for r in rows]
    return out


# ---- textures and channels


def pack(textures: Sequence[DataFrame], keys: Sequence[str] = KEYS) -> DataFrame:
    """T planes of three channels as one plane of 3T: texture t becomes channels 3t to 3t + 2."""
    at = [*keys, "x", "y"]
    out = None
    for t, texture in enumerate(textures):
        own = texture.select(*at, *[F.col(c).alias(f"c{3 * t + i}") for i, c in enumerate(channels(texture))])
        out = own if out is None else out.join(own, at)
    return out


def extract(plane: DataFrame, texture: int, keys: Sequence[str] = KEYS) -> DataFrame:
    return plane.select(*keys, "x", "y", *[F.col(f"c{3 * texture + i}").alias(f"c{i}") for i in range(3)])


def insert(plane: DataFrame, texture: int, rgb: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``plane`` with one texture's channels replaced."""
    at = [*keys, "x", "y"]
    new = rgb.select(*at, *[F.col(f"c{i}").alias(f"__n{i}") for i in range(3)])
    kept = [F.col(f"__n{int(c[1:]) - 3 * texture}").alias(c) if 3 * texture <= int(c[1:]) < 3 * texture + 3 else F.col(c) for c in channels(plane)]
    return plane.join(new, at).select(*at, *kept)


def to_long(plane: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """A row per value: keys, x, y, ch, v."""
    own = channels(plane)
    return plane.select(*keys, "x", "y", F.posexplode(F.array(*own)).alias("ch", "v"))


def to_wide(long: DataFrame, n: int, keys: Sequence[str] = KEYS) -> DataFrame:
    return long.groupBy(*keys, "x", "y").agg(*[F.max(F.when(F.col("ch") == i, F.col("v"))).alias(f"c{i}") for i in range(n)])


# ---- crop, pad, fit


def pad(plane: DataFrame, w: int, h: int, multiple: int = BLOCK) -> tuple[DataFrame, int, int]:
    """Last column and row repeated up to a multiple. No join: border texels are exploded."""
    wp, hp = -(-w // multiple) * multiple, -(-h // multiple) * multiple
    return expand(plane, w, h, wp, hp), wp, hp


def expand(plane: DataFrame, w: int, h: int, wp: int, hp: int) -> DataFrame:
    out = plane
    for c, n, to in (("x", w, wp), ("y", h, hp)):
        if to > n:
            last = F.when(F.col(c) == n - 1, F.sequence(F.lit(n - 1), F.lit(to - 1))).otherwise(F.array(F.col(c)))
            out = out.withColumn(c, F.explode(last))
    return out


def fit_axis(n: int, target: int, anchor: str = "center", offset: int = 0) -> tuple[int, int]:
    """Where a crop starts on one axis, and how many source texels it takes; the rest repeats the edge."""
    if n <= target:
        return 0, n
    start = (n - target) // 2 if anchor == "center" else 0
    return max(0, min(n - target, start + offset)), target


def fit(plane: DataFrame, w: int, h: int, tw: int, th: int, anchor: str = "center", offset: tuple[int, int] = (0, 0)) -> DataFrame:
    """Cropped or edge-expanded to tw x th."""
    (x0, nw), (y0, nh) = fit_axis(w, tw, anchor, offset[0]), fit_axis(h, th, anchor, offset[1])
    cut = plane.filter(F.col("x").between(x0, x0 + nw - 1) & F.col("y").between(y0, y0 + nh - 1))
    cut = cut.withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0})
    return expand(cut, nw, nh, tw, th)


# ---- the source chain


def box(plane: DataFrame, w: int, h: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """2 x 2 means with floor halving: an odd last column or row is dropped, a single one repeats."""
    inside = (F.col("x") < max(1, w // 2) * 2) & (F.col("y") < max(1, h // 2) * 2)
    cell = [*keys, F.floor(F.col("x") / 2).cast("int").alias("x"), F.floor(F.col("y") / 2).cast("int").alias("y")]
    return plane.filter(inside).groupBy(*cell).agg(*[F.avg(c).alias(c) for c in channels(plane)])


def box_chain(plane: DataFrame, w: int, h: int, levels: int) -> DataFrame:
    """Planes 0 to ``levels`` by repeated box halving.

    A level's box of boxes is the mean over 2**m texels as long as no odd size was
    halved on the way, so every such level comes straight from the base in one
    aggregation; levels below an odd size come from the level above them.
    """
    out, above = plane, plane
    aligned = True
    for m in range(1, levels + 1):
        aligned = aligned and w % 2 == 0 and h % 2 == 0
        above = box(above, w, h).withColumn("plane", F.lit(m)) if not aligned else _direct_box(plane, m)
        w, h = max(1, w // 2), max(1, h // 2)
        out = out.unionByName(above)
    return out


def _direct_box(plane: DataFrame, m: int) -> DataFrame:
    side = 1 << m
    cell = [F.lit(m).alias("plane"), F.floor(F.col("x") / side).cast("int").alias("x"), F.floor(F.col("y") / side).cast("int").alias("y")]
    return plane.groupBy(*cell).agg(*[F.avg(c).alias(c) for c in channels(plane)])


def _kernel(name: str, x: float, scale: float) -> float:
    x = abs(x)
    if name == "box":  # a trapezoid: flat, with ramps as wide as the scale
        half, flat = 0.5 + scale / 2, 0.5 - scale / 2
        return 0.0 if x >= half else 1.0 if x <= flat else (half - x) / scale
    b, c = (1 / 3, 1 / 3) if name == "mitchell" else (0.0, 0.5)
    if x < 1:
        return ((12 - 9 * b - 6 * c) * x**3 + (-18 + 12 * b + 6 * c) * x**2 + (6 - 2 * b)) / 6
    if x < 2:
        return ((-b - 6 * c) * x**3 + (6 * b + 30 * c) * x**2 + (-12 * b - 48 * c) * x + (8 * b + 24 * c)) / 6
    return 0.0


def axis_weights(n: int, out: int, kernel: str, edge: str = "clamp") -> list[tuple[int, int, float]]:
    """(output, input, weight) of a direct resize of one axis; weights of an output sum to 1."""
    scale = out / n
    support = (0.5 + scale / 2 if kernel == "box" else 2.0) / min(1.0, scale)
    rows = []
    for i in range(out):
        centre = (i + 0.5) / scale
        own: dict[int, float] = {}
        for j in range(int(centre - support) - 1, int(centre + support) + 2):
            w = _kernel(kernel, (j + 0.5 - centre) * min(1.0, scale), scale)
            if w:
                at = j % n if edge == "wrap" else min(n - 1, max(0, j))
                own[at] = own.get(at, 0.0) + w
        total = sum(own.values())
        rows += [(i, j, w / total) for j, w in sorted(own.items())]
    return rows


def resize(plane: DataFrame, w: int, h: int, ow: int, oh: int, kernel: str = "mitchell", edge: str = "clamp", keys: Sequence[str] = KEYS) -> DataFrame:
    """Separable resize by weight-table joins, x then y. A table has a few rows per texel of one axis.

    Sums lose their last digits (beyond 12), so that one that lies halfway is rounded alike whatever the order it was summed in.
    """
    spark, own = plane.sparkSession, channels(plane)
    wx = spark.createDataFrame(axis_weights(w, ow, kernel, edge), "ox int, x int, wx double")
    wy = spark.createDataFrame(axis_weights(h, oh, kernel, edge), "oy int, y int, wy double")
    across = plane.join(F.broadcast(wx), "x").groupBy(*keys, "ox", "y").agg(*[F.sum(F.col(c) * F.col("wx")).alias(c) for c in own])
    down = across.join(F.broadcast(wy), "y").groupBy(*keys, "ox", "oy").agg(*[F.round(F.sum(F.col(c) * F.col("wy")), 12).alias(c) for c in own])
    return down.select(*keys, F.col("ox").alias("x"), F.col("oy").alias("y"), *own)


def source_chain(plane: DataFrame, w: int, h: int, levels: int, settings: Sequence[dict] | None = None) -> DataFrame:
    """Every texture's pyramid under its own settings: filter, edge, srgb, normal_map.

    The default filter halves level by level; a named one resizes each level from the
    base, in linear light if asked, clamped, and re-lengthened for normal maps.
    """
    count = len(channels(plane)) // 3
    settings = list(settings or [{}] * count)
    if all(s.get("filter", "default") == "default" for s in settings):
        return box_chain(plane, w, h, levels)
    chains = []
    for t, s in enumerate(settings):
        rgb = extract(plane, t)
        if s.get("filter", "default") == "default":
            chains.append(box_chain(rgb, w, h, levels))
            continue
        base = rgb.withColumns({c: srgb_to_linear(F.col(c)) for c in channels(rgb)}) if s.get("srgb") else rgb
        chain, cw, ch = rgb, w, h
        for m in range(1, levels + 1):
            cw, ch = max(1, cw // 2), max(1, ch // 2)
            level = resize(base, w, h, cw, ch, s["filter"], s.get("edge", "clamp"))
            level = level.withColumns({c: clamp01(F.col(c)) for c in channels(rgb)})
            if s.get("srgb"):
                level = level.withColumns({c: clamp01(linear_to_srgb(F.col(c))) for c in channels(rgb)})
            if s.get("normal_map"):
                level = level.withColumns(dict(zip(channels(rgb), renormalised([F.col(c) for c in channels(rgb)]), strict=True)))
            chain = chain.unionByName(level.withColumn("plane", F.lit(m)))
        chains.append(chain)
    return pack(chains)


# ---- sites and bilinear reads


def offsets(k: int, j: int, tx: Column, ty: Column) -> tuple[Column, Column]:
    """Sub-texel offset j (0-based) of K: turned a quarter per parity of the texel, but for K = 2."""
    dx, dy = OFFSETS[k][j]
    if k == 2:
        return lit(dx), lit(dy)
    turns = F.pmod(ty, F.lit(2)) * 2 + F.pmod(tx, F.lit(2))
    turned = [(dx, dy), (-dy, dx), (-dx, -dy), (dy, -dx)]
    pick = lambda axis: F.when(turns == 0, lit(turned[0][axis])).when(turns == 1, lit(turned[1][axis])).when(turns == 2, lit(turned[2][axis])).otherwise(lit(turned[3][axis]))
    return pick(0), pick(1)


def sites(pixels: DataFrame, k: int) -> DataFrame:
    """A row per site: j = 0 is the pixel centre, 1 to K the fractional ones; dx, dy from the centre."""
    x, y = F.col("x"), F.col("y")
    all_ = [F.struct(F.lit(0).alias("j"), lit(0).alias("dx"), lit(0).alias("dy"))]
    for j in range(k):
        dx, dy = offsets(k, j, x, y)
        all_.append(F.struct(F.lit(j + 1).alias("j"), dx.alias("dx"), dy.alias("dy")))
    return pixels.withColumn("__s", F.explode(F.array(*all_))).select(*pixels.columns, "__s.j", "__s.dx", "__s.dy")


def tap_position(p: Column, d: Column, n0: Column, n: Column) -> Column:
    """Where a site of an n0-wide plane lies in an n-wide one, in texels."""
    return F.when(n == n0, p + d).otherwise((p + lit(0.5) + d) * n / n0 - lit(0.5))


def cells(plane: DataFrame, size: DataFrame, w: str, h: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, qx, qy and for every channel its corners ``<c>_00 _10 _01 _11``; qx runs from -1 to w - 1.

    ``size`` has the keys and the plane's extent in columns ``w`` and ``h``.
    """
    own = channels(plane)
    sized = with_extent(plane, size, {"__w": w, "__h": h}, keys)

    def sides(p: str, n: str) -> Column:
        # (cell, corner) pairs of one axis; the first texel is both corners of cell -1, the last of cell n - 1.
        first = F.when(F.col(p) == 0, F.array(F.struct(F.lit(-1).alias("q"), F.lit(0).alias("s")))).otherwise(F.array().cast("array<struct<q:int,s:int>>"))
        last = F.when(F.col(p) == F.col(n) - 1, F.array(F.struct(F.col(p).alias("q"), F.lit(1).alias("s")))).otherwise(F.array().cast("array<struct<q:int,s:int>>"))
        return F.concat(first, F.array(F.struct((F.col(p) - 1).alias("q"), F.lit(1).alias("s")), F.struct(F.col(p).alias("q"), F.lit(0).alias("s"))), last)

    rows = sized.withColumn("__a", F.explode(sides("x", "__w"))).withColumn("__b", F.explode(sides("y", "__h")))
    corner = lambda a, b: (F.col("__a.s") == a) & (F.col("__b.s") == b)
    return rows.groupBy(*keys, F.col("__a.q").alias("qx"), F.col("__b.q").alias("qy")).agg(
        *[F.max(F.when(corner(a, b), F.col(c))).alias(f"{c}_{a}{b}") for c in own for a in (0, 1) for b in (0, 1)]
    )


def blend(c: str, fx: Column, fy: Column) -> Column:
    one = lit(1)
    return (one - fx) * (one - fy) * F.col(f"{c}_00") + fx * (one - fy) * F.col(f"{c}_10") + (one - fx) * fy * F.col(f"{c}_01") + fx * fy * F.col(f"{c}_11")


def read_bilinear(points: DataFrame, plane: DataFrame, size: DataFrame, px: Column, py: Column, names: Sequence[str], w: str = "w1", h: str = "h1", keys: Sequence[str] = KEYS) -> DataFrame:
    """``points`` with the plane read at texel positions (px, py), clamped to the edge, as ``names``."""
    own = channels(plane)
    corners = cells(plane, size, w, h, keys)
    at = with_extent(points, size, {"__w": w, "__h": h}, keys).withColumns({"__px": px, "__py": py})
    # Beyond the outermost cells both corners are the edge texel.
    at = at.withColumns({"qx": F.greatest(F.lit(-1), F.least(F.floor("__px").cast("int"), F.col("__w") - 1)), "qy": F.greatest(F.lit(-1), F.least(F.floor("__py").cast("int"), F.col("__h") - 1))})
    at = at.withColumns({"__fx": F.col("__px") - F.floor("__px"), "__fy": F.col("__py") - F.floor("__py")})
    read = at.join(corners, [*keys, "qx", "qy"])
    return read.select(*points.columns, *[blend(c, F.col("__fx"), F.col("__fy")).alias(n) for c, n in zip(own, names, strict=True)])


def neighbourhood(plane: DataFrame, keys: Sequence[str] = KEYS, prefix: str = "") -> DataFrame:
    """Every texel with its neighbours, clamped to the edge: ``<prefix><c>_<a><b>`` is a steps right and b down of the first of 3 x 3."""

    def beside(rows: DataFrame, names: Sequence[str], line: str, along: str) -> DataFrame:
        order = Window.partitionBy(*keys, line).orderBy(along)
        three = lambda c: ((0, F.coalesce(F.lag(c).over(order), F.col(c))), (1, F.col(c)), (2, F.coalesce(F.lead(c).over(order), F.col(c))))
        return rows.select(*keys, "x", "y", *[value.alias(f"{c}{i}") for c in names for i, value in three(c)])

    own = channels(plane)
    rows = plane.select(*keys, "x", "y", *[F.col(c).alias(f"{prefix}{c}_") for c in own])
    return beside(beside(rows, [f"{prefix}{c}_" for c in own], "y", "x"), [f"{prefix}{c}_{a}" for c in own for a in range(3)], "x", "y")


def _within(name: str, left: Column, up: Column, fx: Column, fy: Column) -> Column:
    """A bilinear read in a neighbourhood: the cell left of (or right of) its middle texel, and above (or below) it."""
    corner = lambda a, b: F.when(left & up, F.col(f"{name}_{a}{b}")).when(left, F.col(f"{name}_{a}{b + 1}")).when(up, F.col(f"{name}_{a + 1}{b}")).otherwise(F.col(f"{name}_{a + 1}{b + 1}"))
    one = lit(1)
    return (one - fx) * (one - fy) * corner(0, 0) + fx * (one - fy) * corner(1, 0) + (one - fx) * fy * corner(0, 1) + fx * fy * corner(1, 1)


_EXTENTS = {"__w0": "w0", "__h0": "h0", "__w1": "w1", "__h1": "h1"}


def _beside_level1(pixels: DataFrame, level1: DataFrame, size: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``pixels`` with the extents, the level-1 texel (__bx, __by) they lie over and its neighbourhood, columns ``__z<c>_<a><b>``."""
    over = lambda p, n0, n1: F.floor(((F.col(p) * 2 + 1).cast("long") * F.col(n1)) / (F.col(n0) * 2)).cast("int")
    at = with_extent(pixels, size, _EXTENTS, keys).withColumns({"__bx": over("x", "__w0", "__w1"), "__by": over("y", "__h0", "__h1")})
    near = neighbourhood(level1, keys, "__z").withColumnsRenamed({"x": "__bx", "y": "__by"})
    return at.join(near, [*keys, "__bx", "__by"])


def _level1_values(level1: DataFrame, names: Sequence[str], dx: Column, dy: Column) -> list[Column]:
    """Level 1 at (x + dx, y + dy), at most half a pixel away: within the neighbourhood that ``_beside_level1`` gave."""
    px, py = tap_position(F.col("x"), dx, F.col("__w0"), F.col("__w1")), tap_position(F.col("y"), dy, F.col("__h0"), F.col("__h1"))
    left, up = F.floor(px) < F.col("__bx"), F.floor(py) < F.col("__by")
    return [_within(f"__z{c}", left, up, px - F.floor(px), py - F.floor(py)).alias(n) for c, n in zip(channels(level1), names, strict=True)]


def read_level1(pixels: DataFrame, level1: DataFrame, size: DataFrame, names: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Level 1, no larger than level 0, at the pixels (x, y) or at sites (dx, dy) half a pixel away at most."""
    dx, dy = (F.col("dx"), F.col("dy")) if "dx" in pixels.columns else (lit(0), lit(0))
    return _beside_level1(pixels, level1, size, keys).select(*pixels.columns, *_level1_values(level1, names, dx, dy))


def site_rows(level0: DataFrame, level1: DataFrame, source: DataFrame, size: DataFrame, k: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys, x, y, j and every site's level-0 sample s*, level-1 sample z* and target t*.

    All that a pixel's sites read is in its row: its neighbourhood in level 0 and the
    source, and that of the level-1 texel it lies over.  The centre site reads at
    offset 0, which is the texel itself.
    """
    n0, n1, nt = len(channels(level0)), len(channels(level1)), len(channels(source))
    both = level0.join(source.select(*keys, "x", "y", *[F.col(c).alias(f"c{n0 + i}") for i, c in enumerate(channels(source))]), [*keys, "x", "y"])
    near = _beside_level1(neighbourhood(both, keys, "__f"), level1, size, keys)
    at = sites(near, k)
    left, up = F.col("dx") < 0, F.col("dy") < 0
    fx, fy = F.when(left, F.col("dx") + lit(1)).otherwise(F.col("dx")), F.when(up, F.col("dy") + lit(1)).otherwise(F.col("dy"))
    full = [_within(f"__fc{i}", left, up, fx, fy).alias(n) for i, n in enumerate([f"s{i}" for i in range(n0)] + [f"t{i}" for i in range(nt)])]
    return at.select(*keys, "x", "y", "j", *full, *_level1_values(level1, [f"z{i}" for i in range(n1)], F.col("dx"), F.col("dy")))


def nearest(points: DataFrame, plane: DataFrame, u: Column, v: Column, w: int, h: int, names: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Point sampling at (u, v) in [0, 1]."""
    own = channels(plane)
    at = points.withColumns({"__x": F.greatest(F.lit(0), F.least(F.floor(u * w).cast("int"), F.lit(w - 1))), "__y": F.greatest(F.lit(0), F.least(F.floor(v * h).cast("int"), F.lit(h - 1)))})
    texels = plane.select(*keys, F.col("x").alias("__x"), F.col("y").alias("__y"), *[F.col(c).alias(n) for c, n in zip(own, names, strict=True)])
    return at.join(texels, [*keys, "__x", "__y"]).drop("__x", "__y")


def trilinear(points: DataFrame, chain: DataFrame, size: DataFrame, names: Sequence[str]) -> DataFrame:
    """``points`` (u, v, lod and any id columns, repeated or not) read from a chain: two levels, four taps each.

    The two levels are read one after the other from one table of cells, so every row stays itself.
    """
    top = deepest(size)
    lod = F.greatest(lit(0), F.least(F.col("lod"), F.lit(float(top))))
    rows = points.withColumn("__lod", lod).withColumn("__floor", F.floor("__lod").cast("int"))
    rows = rows.withColumns({"__part": F.col("__lod") - F.col("__floor"), "__next": F.least(F.col("__floor") + 1, F.lit(top))})
    low, high = [f"__a{i}" for i in range(len(names))], [f"__b{i}" for i in range(len(names))]
    for level, read in (("__floor", low), ("__next", high)):
        at = with_extent(rows.withColumn("plane", F.col(level)), size, {"__w0": "w0", "__h0": "h0"})
        rows = read_bilinear(at, chain, size, F.col("u") * F.col("__w0") - lit(0.5), F.col("v") * F.col("__h0") - lit(0.5), read, "w0", "h0").drop("plane", "__w0", "__h0")
    part = F.col("__part")
    return rows.select(*points.columns, *[(F.col(a) * (lit(1) - part) + F.col(b) * part).alias(n) for a, b, n in zip(low, high, names, strict=True)])


def bilinear_of_level(points: DataFrame, chain: DataFrame, size: DataFrame, names: Sequence[str]) -> DataFrame:
    """``points`` (u, v, lod and any columns) read from the level nearest to their lod, halves upwards: one level, one join."""
    level = F.least(F.greatest(lit(0), F.floor(F.col("lod") + lit(0.5))), F.lit(float(deepest(size)))).cast("int")
    at = with_extent(points.select(F.struct(*points.columns).alias("__own"), "u", "v", level.alias("plane")), size, {"__w0": "w0", "__h0": "h0"})
    read = read_bilinear(at, chain, size, F.col("u") * F.col("__w0") - lit(0.5), F.col("v") * F.col("__h0") - lit(0.5), names, "w0", "h0")
    return read.select("__own.*", *names)


# ---- footprints


def footprint_cell(x: Column, y: Column, w0: Column, h0: Column, w1: Column, h1: Column) -> list[Column]:
    """The level-1 texel whose footprint a pixel lies in: floor((x + 1) * w1 - 1 over w0) tiles the plane exactly."""
    at = lambda p, n0, n1: F.least(F.floor(((p + 1).cast("long") * n1 - 1) / n0).cast("int"), n1 - 1)
    return [at(x, w0, w1), at(y, h0, h1)]


def duplicate_channels(plane: DataFrame) -> DataFrame:
    """Pairs of channels (a < b) that are equal in every texel of every plane."""
    own = channels(plane)
    pairs = [(a, b) for i, a in enumerate(own) for b in own[i + 1 :]]
    flags = plane.agg(*[F.bool_and(F.col(a) == F.col(b)).alias(f"{a}_{b}") for a, b in pairs])
    listed = F.array(*[F.struct(F.lit(int(a[1:])).alias("a"), F.lit(int(b[1:])).alias("b"), F.col(f"{a}_{b}").alias("same")) for a, b in pairs])
    return flags.select(F.explode(listed).alias("p")).select("p.a", "p.b", "p.same")


def distinct_first(order: int, duplicates: list[tuple[int, int]]) -> list[int]:
    """Channel order with exact copies moved behind the distinct ones."""
    copies = {b for _, b in duplicates}
    return [c for c in range(order) if c not in copies] + [c for c in range(order) if c in copies]


def rank_pick(values: DataFrame, group: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Order statistics by index floor(q * last + 0.5), not interpolated.

    Values are counted first, so the ordered rows are distinct values, and the
    running counts run over groups of them, never over all rows.
    """
    counts = values.groupBy(*group, value).agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.partitionBy(*group).orderBy(value)
    ranked = counts.withColumns({"__upto": F.sum("__n").over(upto), "__all": F.sum("__n").over(Window.partitionBy(*group))})
    index = lambda q: F.floor(lit(q) * (F.col("__all") - 1).cast("double") + lit(0.5))
    return ranked.groupBy(*group).agg(*[F.min(F.when(F.col("__upto") > index(q), F.col(value))).alias(n) for n, q in shares.items()])
