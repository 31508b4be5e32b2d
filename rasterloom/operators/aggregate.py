"""Objective, statistics and rates: everything that reduces planes to numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions.scalar import affine, features, level_bytes, lit, mse_to_db, to_byte
from rasterloom.operators.resample import footprint_cell, rank_pick, with_extent
from rasterloom.schema import KEYS, channels


def output_weights(weights: Sequence[float], rgb_weights: Sequence[Sequence[float]]) -> list[float]:
    """cw of every output: texture weight times its colour weight, normed to mean 1 within the texture."""
    return [w * c * 3 / sum(rgb) for w, rgb in zip(weights, rgb_weights, strict=True) for c in rgb]


def mip_weights(size: DataFrame, kind: str = "pixels", mix: float = 0.5, k: int = 4) -> DataFrame:
    """plane, share, per_site. The windows run over one row per level (13 at most)."""
    every = Window.partitionBy()
    pixels = (F.col("w0") * F.col("h0")).cast("double")
    raw = {"uniform": lit(1), "sqrt": F.sqrt(pixels), "pixels": pixels}[kind]
    rows = size.select("plane", pixels.alias("pixels"), F.when(F.col("plane") > 0, raw).otherwise(lit(0)).alias("r"))
    rows = rows.withColumns({"n": F.count(F.lit(1)).over(every), "total": F.sum("r").over(every)})
    share = F.when(F.col("n") == 1, lit(1)).when(F.col("plane") == 0, lit(1 - mix)).otherwise(F.when(F.col("total") > 0, lit(mix) * F.col("r") / F.col("total")).otherwise(lit(0)))
    per_site = F.when(F.col("n") == 1, lit(1)).otherwise(share / (F.col("pixels") * lit(1 + k)))
    return rows.select("plane", share.alias("share"), per_site.alias("per_site"))


def squared_errors(rows: DataFrame, weights: Sequence[Sequence[float]], bias: Sequence[float], cw: Sequence[float]) -> DataFrame:
    """Site rows with their weighted and plain squared error under a literal decoder."""
    count = lambda p: len([c for c in rows.columns if c[:1] == p and c[1:].isdigit()])
    phi = features([F.col(f"s{i}") for i in range(count("s"))], [F.col(f"z{i}") for i in range(count("z"))])
    out = affine(weights, bias, phi)
    diffs = [o - F.col(f"t{i}") for i, o in enumerate(out)]
    total = lambda parts: sum(parts[1:], parts[0])
    return rows.withColumns({"weighted": total([lit(c) * d * d for c, d in zip(cw, diffs, strict=True)]), "plain": total([d * d for d in diffs])})


def objective_sums(errors: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per plane: weighted sum over all sites, plain sums over centre and fractional sites."""
    return errors.groupBy(*keys).agg(
        F.sum("weighted").alias("weighted"), F.sum(F.when(F.col("j") == 0, F.col("plain")).otherwise(lit(0))).alias("centre"), F.sum(F.when(F.col("j") > 0, F.col("plain")).otherwise(lit(0))).alias("fractional")
    )


def objective(sums: DataFrame, size: DataFrame, weights: DataFrame, cw: Sequence[float], k: int) -> DataFrame:
    """One row: e, centre_mse and sampled_mse (of the base), from the planes' sums."""
    nout, sites = len(cw), (F.col("w0") * F.col("h0")).cast("double")
    rows = sums.join(size, "plane").join(weights, "plane").select("*", sites.alias("px"))
    base = lambda c: F.sum(F.when(F.col("plane") == 0, c))
    return rows.agg(
        (F.sum(F.col("per_site") * F.col("weighted")) / (lit(sum(cw)) * F.sum(F.col("per_site") * F.col("px") * lit(1 + k)))).alias("e"),
        base(F.col("centre") / (F.col("px") * lit(nout))).alias("centre_mse"),
        (base(F.col("fractional") / (F.col("px") * lit(nout * k))) if k else lit(0)).alias("sampled_mse"),
    )


def plane_objective(sums: DataFrame, size: DataFrame, cw: Sequence[float], k: int) -> DataFrame:
    px = (F.col("w0") * F.col("h0")).cast("double")
    return sums.join(size, "plane").select("plane", (F.col("weighted") / (lit(sum(cw)) * px * lit(1 + k))).alias("e"), (F.col("centre") / (px * lit(len(cw)))).alias("centre_mse"))


def block_means(plane: DataFrame, size: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Means over each level-1 texel's footprint."""
    sized = with_extent(plane, size, {f"__{n}": n for n in ("w0", "h0", "w1", "h1")}, keys)
    x, y = footprint_cell(F.col("x"), F.col("y"), F.col("__w0"), F.col("__h0"), F.col("__w1"), F.col("__h1"))
    return sized.groupBy(*keys, x.alias("x"), y.alias("y")).agg(*[F.avg(c).alias(c) for c in channels(plane)])


def covariance(plane: DataFrame, weight: Column | None = None) -> DataFrame:
    """(i, j, mean_i, mean_j, cov) of all channel pairs: one aggregation of sums and products."""
    own, w = channels(plane), weight if weight is not None else lit(1)
    pairs = [(a, b) for a in own for b in own]
    sums = plane.agg(F.sum(w).alias("n"), *[F.sum(w * F.col(c)).alias(f"m_{c}") for c in own], *[F.sum(w * F.col(a) * F.col(b)).alias(f"p_{a}_{b}") for a, b in pairs if a <= b])
    cell = lambda a, b: F.col(f"p_{min(a, b)}_{max(a, b)}") / F.col("n") - F.col(f"m_{a}") / F.col("n") * F.col(f"m_{b}") / F.col("n")
    rows = F.array(*[F.struct(F.lit(int(a[1:])).alias("i"), F.lit(int(b[1:])).alias("j"), (F.col(f"m_{a}") / F.col("n")).alias("mean_i"), cell(a, b).alias("cov")) for a, b in pairs])
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def value_range(long: DataFrame, policy: str = "pct", keys: Sequence[str] = ("ch",)) -> DataFrame:
    """lo and hi of every channel over all planes: the extremes, or the 0.1 % and 99.9 % order statistics; [-1, 1] if flat."""
    if policy == "minmax":
        found = long.groupBy(*keys).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    else:
        found = rank_pick(long, keys, "v", {"lo": 0.001, "hi": 0.999})
    flat = ~(F.col("hi") > F.col("lo"))
    return found.select(*keys, F.when(flat, lit(-1)).otherwise(F.col("lo")).alias("lo"), F.when(flat, lit(1)).otherwise(F.col("hi")).alias("hi"))


def projection(plane: DataFrame, direction: Sequence[float], mean: Sequence[float]) -> Column:
    total = lit(0)
    for c, e, m in zip(channels(plane), direction, mean, strict=True):
        total = total + lit(e) * (F.col(c) - lit(m))
    return total


def projection_histogram(projected: DataFrame, value: str, bins: int = 4096) -> DataFrame:
    """(bin, n, upto, total, peak) of |value| / peak; the ordered rows are bins."""
    peak = projected.agg(F.max(F.abs(value)).alias("peak"))
    rows = projected.crossJoin(peak)  # one row
    bin_ = F.least(F.lit(bins - 1), F.floor(F.abs(value) / F.col("peak") * lit(bins)).cast("int"))
    counts = rows.filter("peak > 0").groupBy(bin_.alias("bin"), "peak").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumns({"upto": F.sum("n").over(Window.orderBy("bin")), "total": F.sum("n").over(Window.partitionBy())})


def histogram_percentile(histogram: DataFrame, share: float = 0.99, bins: int = 4096) -> DataFrame:
    """The upper edge of the first bin that ``share`` of the values lie at or below."""
    hit = histogram.filter(F.col("upto") >= F.floor(lit(share) * F.col("total")))
    return hit.agg(F.min("bin").alias("bin"), F.first("peak").alias("peak")).select("bin", (F.col("peak") * (F.col("bin") + 1).cast("double") / lit(bins)).alias("divisor"))


def byte_errors(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, x, y, ch, d): 8-bit differences of two planes."""
    at, own = [*keys, "x", "y"], channels(a)
    joined = a.join(b.select(*at, *[F.col(c).alias(f"__{c}") for c in own]), at)
    return joined.select(*at, F.posexplode(F.array(*[to_byte(F.col(c)) - to_byte(F.col(f"__{c}")) for c in own])).alias("ch", "d"))


def psnr(errors: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per plane and texture: mse in byte units and decibels."""
    mse = F.avg((F.col("d") * F.col("d")).cast("double"))
    return errors.groupBy(*keys, F.floor(F.col("ch") / 3).cast("int").alias("texture")).agg(mse.alias("mse")).withColumn("psnr", mse_to_db(F.col("mse"), 255.0))


def worst_texture(by_texture: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return by_texture.groupBy(*keys).agg(F.min("psnr").alias("psnr"), F.min_by("texture", F.struct("psnr", "texture")).alias("texture"))


def worst_case(errors: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per plane: order statistics of the largest channel error of a pixel, and the per cent above 8."""
    peak = errors.groupBy(*keys, "x", "y").agg(F.max(F.abs("d")).alias("peak"))
    picked = rank_pick(peak, keys, "peak", {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    rest = peak.groupBy(*keys).agg(F.max("peak").alias("max"), (lit(100) * F.avg(F.when(F.col("peak") > 8, 1.0).otherwise(0.0))).alias("above8"))
    return picked.join(rest, list(keys))


def channel_stats(long: DataFrame, grid: DataFrame, keys: Sequence[str] = ("plane", "ch")) -> DataFrame:
    """mean, sd, min, max and the per cent of values on an end of the grid (ch, lo, hi)."""
    rows = long.join(grid, "ch")
    tol = lit(1e-6) * (F.abs(F.col("hi") - F.col("lo")) + lit(1))
    end = (F.abs(F.col("v") - F.col("lo")) <= tol) | (F.abs(F.col("v") - F.col("hi")) <= tol)
    return rows.groupBy(*keys).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.min("v").alias("least"), F.max("v").alias("most"), (lit(100) * F.avg(F.when(end, 1.0).otherwise(0.0))).alias("ends"))


def frame_diff(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per plane and channel: largest and mean difference, mse and decibels of two frames."""
    return byte_errors(a, b, keys).groupBy(*keys, "ch").agg(F.max(F.abs("d")).alias("max_diff"), F.avg(F.abs("d")).alias("mean_diff"), F.avg((F.col("d") * F.col("d")).cast("double")).alias("mse")).withColumn("psnr", mse_to_db(F.col("mse"), 255.0))


def rates(levels: DataFrame, textures: int) -> DataFrame:
    """Bytes and bits per pixel of a stored asset; ``levels`` has level, dxgi, width, height of every file level and the base w, h."""
    size = level_bytes(F.col("dxgi"), F.col("width"), F.col("height"))
    total, base = F.sum(size), F.sum(F.when(F.col("level") == 0, size).otherwise(0))
    px = F.max(F.col("w").cast("double") * F.col("h"))
    return levels.agg(total.alias("bytes"), (base * 8 / px).alias("bpp_base"), (total * 8 / px).alias("bpp_chain"), (total * 8 / px / lit(textures)).alias("bpp_texture"))


def movement(before: DataFrame, after: DataFrame, grid: DataFrame, levels: int) -> DataFrame:
    """Values that moved by more than half a grid step, and the squared norms of the move and of the plane; both tables long."""
    at = ["plane", "x", "y", "ch"]
    rows = after.join(before.select(*at, F.col("v").alias("__old")), at).join(grid, "ch").withColumn("__d", F.col("v") - F.col("__old"))
    return rows.groupBy("plane").agg(
        F.sum(F.when(F.abs("__d") > (F.col("hi") - F.col("lo")) / lit(2 * levels), 1).otherwise(0)).alias("moved"), F.sum(F.col("__d") * F.col("__d")).alias("delta2"), F.sum(F.col("v") * F.col("v")).alias("plane2")
    )


def lean(weights: Sequence[Sequence[float]], c0: int, c1: int) -> list[tuple[int, str, int, float]]:
    """Root-mean-square weight of every texture on every latent channel; the decoder itself is a dozen numbers."""
    out = []
    for t in range(len(weights) // 3):
        for k in range(c1 + c0):
            own = [weights[3 * t + i][k] for i in range(3)]
            out.append((t, "level1" if k < c1 else "level0", k if k < c1 else k - c1, (sum(v * v for v in own) / 3) ** 0.5))
    return out
