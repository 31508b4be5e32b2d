"""All sites of dense planes with one shuffle: pixels go once to their tile, border texels to those beside it as well.

``resample.site_rows`` says the same by two window passes and a join, and takes planes with holes; here a
tile makes its pixels' sites in arrays and hands them on as Arrow batches, in double precision.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.operators import latents as L
from rasterloom.operators.resample import with_extent
from rasterloom.schema import KEYS, channels

EDGE = 128


def _tiles(low: Column, high: Column, n: str, edge: int) -> Column:
    """Numbers of the tiles that reach from ``low`` to ``high`` within an axis of ``n``."""
    at = lambda p: F.floor(F.greatest(F.lit(0), F.least(p, F.col(n) - 1)) / edge).cast("int")
    return F.sequence(at(low), at(high))


def tiled_site_rows(level0: DataFrame, level1: DataFrame, source: DataFrame, size: DataFrame, k: int, keys: Sequence[str] = KEYS, edge: int = EDGE) -> DataFrame:
    """The rows of ``resample.site_rows``: keys, x, y, j and every site's s*, t* and z*, for pixels that both level 0 and the source have.

    Texels that a site reads and that are missing count as 0.
    """
    n0, n1, nt = len(channels(level0)), len(channels(level1)), len(channels(source))
    widest, rows = max(n0, n1, nt), []
    for part, t in enumerate((level0, source, level1)):
        own = channels(t)
        at = with_extent(t, size, {f"__{n}": n for n in ("h0", "w0", "h1", "w1")}, keys)
        for name, p, n, m in (("__ty", "y", "__h0", "__h1"), ("__tx", "x", "__w0", "__w1")):
            if part < 2:
                low, high = F.col(p) - 1, F.col(p) + 1
            else:  # the pixels whose sites can read a texel of level 1, a pixel to spare
                ratio = F.col(n) / F.col(m)
                low, high = F.floor((F.col(p) - 0.5) * ratio) - 2, F.ceil((F.col(p) + 1.5) * ratio) + 1
            at = at.withColumn(name, F.explode(_tiles(low, high, n, edge)))
        values = [(F.col(own[i]).cast("double") if i < len(own) else F.lit(0.0)).alias(f"__c{i}") for i in range(widest)]
        rows.append(at.select(*keys, "__ty", "__tx", "__h0", "__w0", "__h1", "__w1", F.lit(part).alias("__part"), "x", "y", *values))
    names = [*[f"s{i}" for i in range(n0)], *[f"t{i}" for i in range(nt)], *[f"z{i}" for i in range(n1)]]
    given = dict(level0.dtypes)
    schema = ", ".join([*[f"{c} {given[c]}" for c in keys], "x int", "y int", "j int", *[f"{c} double" for c in names]])
    keys = list(keys)

    def make(table: pa.Table) -> pa.Table:
        first = table.slice(0, 1).to_pylist()[0]
        h0, w0, h1, w1, ty, tx = (first[c] for c in ("__h0", "__w0", "__h1", "__w1", "__ty", "__tx"))
        part = table.column("__part").to_numpy()
        xs, ys = table.column("x").to_numpy(), table.column("y").to_numpy()
        values = np.stack([table.column(f"__c{i}").to_numpy() for i in range(widest)], 1)
        y0, x0, y1, x1 = ty * edge, tx * edge, min(h0, (ty + 1) * edge), min(w0, (tx + 1) * edge)
        top, left = max(0, y0 - 1), max(0, x0 - 1)
        shape = (min(h0, y1 + 1) - top, min(w0, x1 + 1) - left)

        def filled(which: int, n: int, at: tuple[int, int], size: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
            mine = part == which
            a, there = np.zeros((*size, n)), np.zeros(size, bool)
            place = (ys[mine] - at[0], xs[mine] - at[1])
            a[place], there[place] = values[mine][:, :n], True
            return a, there

        v0, has0 = filled(0, n0, (top, left), shape)
        src, has1 = filled(1, nt, (top, left), shape)
        below = part == 2
        at1 = (int(ys[below].min()), int(xs[below].min())) if below.any() else (0, 0)
        size1 = (int(ys[below].max()) - at1[0] + 1, int(xs[below].max()) - at1[1] + 1) if below.any() else (h1, w1)
        v1, _ = filled(2, n1, at1, size1)
        core = (y0, x0, y1 - y0, x1 - x0)
        p = L.Plane(v0, v1, src, window=L.Window((h0, w0), (h1, w1), (top, left), at1, core, core, core))
        use = (has0 & has1)[y0 - top : y1 - top, x0 - left : x1 - left].ravel()
        py, px = (a.ravel()[use] for a in np.indices((y1 - y0, x1 - x0)))
        n = int(use.sum())
        parts: list[list[np.ndarray]] = []
        for j, t0, t1, target in L.sites(p, k):
            parts.append([px + x0, py + y0, np.full(n, j), *t0.read(v0)[use].T, *target[use].T, *t1.read(v1)[use].T])
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        total = len(columns[0])
        kept = [pa.array([first[c]] * total, table.schema.field(c).type) for c in keys]
        whole = [pa.array(c.astype(np.int32)) for c in columns[:3]] + [pa.array(c) for c in columns[3:]]
        return pa.table([*kept, *whole], names=[*keys, "x", "y", "j", *names])

    every = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return every.groupBy(*keys, "__ty", "__tx").applyInArrow(make, schema)
