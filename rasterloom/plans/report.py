"""The account of a fit: its decibels, worst cases, objective, weights and size as one table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.scalar import mse_to_db
from rasterloom.operators import aggregate as A
from rasterloom.operators.sampling import decode
from rasterloom.operators.sites import tiled_site_rows


def _listed(df: DataFrame, values: dict[str, Column], plane: Column | None = None, texture: Column | None = None) -> DataFrame:
    """A row for each of ``values`` of every row of ``df``."""
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), v.cast("double").alias("value")) for n, v in values.items()])
    at = [(F.lit(-1) if c is None else c).cast("int").alias(n) for n, c in (("plane", plane), ("texture", texture))]
    return df.select(*at, F.explode(pairs).alias("p")).select("p.name", "plane", "texture", "p.value")


def report(level0: DataFrame, level1: DataFrame, source: DataFrame, size: DataFrame, weights: Sequence[Sequence[float]], bias: Sequence[float], cw: Sequence[float], files: DataFrame, extent: tuple[int, int], k: int = 4, kind: str = "pixels", mix: float = 0.5) -> DataFrame:
    """(name, plane, texture, value) of planes fitted to the chain ``source``.

    ``extent`` (width, height) is the picture without padding, within which the base is
    measured in bytes; the objective and the decibels of its sites are those of all
    outputs over the padded planes. ``files`` holds the stored levels as ``rates`` takes
    them. Plane or texture -1: the row is of no single one; a level's worst texture
    stands for it above the base.
    """
    w, h = extent
    errors = A.byte_errors(source, decode(level0, level1, size, weights, bias)).filter((F.col("plane") > 0) | ((F.col("x") < w) & (F.col("y") < h)))
    by, plane = A.psnr(errors), F.col("plane")
    shares = A.mip_weights(size, kind, mix, k)
    sums = A.objective_sums(A.squared_errors(tiled_site_rows(level0, level1, source, size, k), weights, bias, cw))
    sites = {"e": F.col("e"), "centre psnr": mse_to_db(F.col("centre_mse"))} | ({"sampled psnr": mse_to_db(F.col("sampled_mse"))} if k else {})
    parts = [
        _listed(by.filter("plane = 0"), {"psnr": F.col("psnr")}, plane, F.col("texture")),
        _listed(A.worst_texture(by.filter("plane > 0")), {"mip psnr": F.col("psnr")}, plane),
        _listed(A.worst_case(errors.filter("plane = 0")), {f"worst case {c}": F.col(c) for c in ("p50", "p90", "p99", "max", "above8")}, plane),
        _listed(shares, {"weight": F.col("share")}, plane),
        _listed(A.objective(sums, size, shares, cw, k), sites),
        _listed(A.rates(files, len(bias) // 3), {c: F.col(c) for c in ("bytes", "bpp_base", "bpp_chain", "bpp_texture")}),
    ]
    return reduce(DataFrame.unionByName, parts)
