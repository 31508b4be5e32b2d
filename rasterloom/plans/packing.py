"""Packing level 0 of tiled planes into 4 x 4 blocks, and refining endpoints and selectors across tiles.

Blocks of one colour (of four, by the parity of their place in the *plane*) share no site, so
they can move at once wherever they lie; tiles end where blocks do, and a block keeps its
colour whichever tile holds it.  A pass takes the colours in turn: every tile refines its blocks
of that colour with all else held, and sends the ring of its texels' moves to the eight tiles
around it before the next colour.  So the result is that of the whole plane in one piece, texel by
texel, and the error only falls.

The state is a table with a row per tile: both endpoints and sixteen selectors of every block
and channel, and the decoded plane.  Every colour writes a new version and leaves the old one to
its reader, so going back is to read the version before (``Versions``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.config import Options
from rasterloom.operators import latents as L
from rasterloom.plans import krylov as K
from rasterloom.plans import tiles as T
from rasterloom.session import forget, stored

#: The range of level 0 of every material: its grid's ends, an entry per channel.
GRIDS = "material_id string, lo array<double>, hi array<double>"
PACKED = f"{T.TILE}, r0 binary, r1 binary, sel binary"
_STATE = "material_id string, plane int, ty int, tx int, d binary, r0 binary, r1 binary, sel binary, improved long, blocks long, delta_e double"
_PIECE = "material_id string, plane int, ty int, tx int, rect array<int>, d binary, r0 binary, r1 binary, sel binary"


def _blocks_of(r, own: L.Rect, c: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    by, bx = -(-own[2] // 4), -(-own[3] // 4)
    ends = [np.frombuffer(v, np.uint8).reshape(by, bx, c).astype(int) for v in (r.r0, r.r1)]
    return *ends, np.frombuffer(r.sel, np.uint8).reshape(by, bx, c, 16).astype(int)


def _bytes_of(blocks: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[bytes]:
    return [T._bytes(a, "u1") for a in blocks]


def seed(tiles: DataFrame, grids: DataFrame, edge: int = T.EDGE) -> DataFrame:
    """Tiles (``PACKED``) with their level 0 snapped to 256 values, packed and decoded: blocks take their extremes as ends."""
    if edge % 4:
        raise ValueError(f"tiles of {edge} pixels end within blocks")

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for r in pdf.itertuples(index=False):
                own, (lo, hi) = T.Grid(r.h0, r.w0, r.h1, r.w1, edge).own(r.ty, r.tx)[0], (np.asarray(r.lo, float), np.asarray(r.hi, float))
                blocks = L.seed_blocks(L.grid_index(lo, hi, 8, T._array(r.v0, own)))
                yield pd.DataFrame([(*r[: len(T._names(T.TILE)) - 3], T._bytes(L.block_values(blocks, own[2], own[3], lo, hi)), r.v1, r.src, *_bytes_of(blocks))], columns=T._names(PACKED))

    return stored(tiles.select(*T._names(T.TILE)).join(grids, "material_id").mapInPandas(work, PACKED), "packed")


def packed(tiles: DataFrame, found: DataFrame, cw: Sequence[float], options: Options | None = None, passes: int = 4, edge: int = T.EDGE, most: int = T.GROUPED) -> DataFrame:
    """``seed`` and ``refine`` at once: a group of tiles packs and refines all that its own blocks' refinement may depend on, and keeps its own.

    The grids are those of the decoders (``found``). A colour's moves reach a block further, so a halo of as many blocks
    as there are turns gives what the whole plane would.
    """
    if edge % 4:
        raise ValueError(f"tiles of {edge} pixels end within blocks")
    o, weights = options or Options(), np.asarray(cw, float)
    halo = 16 * passes + 8

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p, grid, gy, gx = T._assembled(pdf, edge, False, halo, most=most)
        c = p.v0.shape[2]
        lo, hi = T.grids_of(np.frombuffer(pdf["g"].iloc[0], "<f8"), c)[:2]
        p.blocks = L.seed_blocks(L.grid_index(lo, hi, 8, p.v0))
        p.v0 = L.block_values(p.blocks, *p.size0, lo, hi)
        if passes:
            s, prev = L.assemble_all(p, *T._decoder_of(pdf, len(weights)), weights, o.k, True), p.v0.copy()
            at = p.window.at0
            for _ in range(passes):
                turns = [L.refine_window(p, s, prev, (0, 0, *p.size0), (at[0] // 4, at[1] // 4), colour, lo, hi) for colour in range(4)]
                if not any(t.improved for t in turns):
                    break
        far0, out = grid.reach(gy, gx)[0], []
        for ty, tx, (_, v1, src) in T.parted(p, grid, gy, gx):
            own0 = grid.single.own(ty, tx)[0]
            within = np.s_[(own0[0] - far0[0]) // 4 : -(-(own0[0] + own0[2] - far0[0]) // 4), (own0[1] - far0[1]) // 4 : -(-(own0[1] + own0[3] - far0[1]) // 4)]
            blocks = tuple(a[within] for a in p.blocks)
            v0 = L.block_values(blocks, own0[2], own0[3], lo, hi)
            out.append((pdf["material_id"].iloc[0], int(pdf["plane"].iloc[0]), ty, tx, grid.h0, grid.w0, grid.h1, grid.w1, T._bytes(v0), v1, src, *_bytes_of(blocks)))
        return pd.DataFrame(out, columns=T._names(PACKED))

    return stored(T._met(T._pieces(tiles.select(*T._names(T.TILE)), found, edge, None, halo, most)).applyInPandas(run, PACKED), "packed")


def _give(rows: DataFrame, edge: int) -> DataFrame:
    """Every tile's moves to its neighbours, and its own state to itself."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for r in pdf.itertuples(index=False):
                out, tile = [], K._Tile(r, edge, True)
                d = K._vector(r.d, tile.own)
                for ty, tx, part in tile.neighbours():
                    out.append((r.material_id, r.plane, ty, tx, list(part), T._bytes(T._part(d, tile.own, part), "<f8"), None, None, None))
                out.append((r.material_id, r.plane, r.ty, r.tx, list(tile.own), r.d, r.r0, r.r1, r.sel))
                yield pd.DataFrame(out, columns=T._names(_PIECE))

    return rows.mapInPandas(work, _PIECE)


def _turn(rows: DataFrame, colour: int, edge: int) -> DataFrame:
    """Tiles with their rows of the system, planes, blocks and pieces: the state after the blocks of a colour have moved."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for r in pdf.itertuples(index=False):
                tile = K._Tile(r, edge, True)
                own, ring = tile.own, tile.ring
                rows_ = K._system_of(r, tile)
                c = rows_.shape[4]
                shape = (ring[2], ring[3], c)
                prev, moves, gradient = np.zeros(shape), np.zeros(shape), np.zeros(shape)
                T._part(prev, ring, own)[:] = T._array(r.v0, own)
                T._part(gradient, ring, own)[:] = K._vector(r.gradient, own)
                for piece in r.pieces:
                    rect = tuple(piece["rect"])
                    T._part(moves, ring, rect)[:] = K._vector(piece["d"], rect)
                within = (own[0] - ring[0], own[1] - ring[1], own[2], own[3])
                p = L.Plane(prev + moves, np.zeros((1, 1, 1)), np.zeros((1, 1, 1)), blocks=_blocks_of(r, own, c))
                # Moves of the ring are exact differences, so that what is held stays held.
                report = L.refine_window(p, L.Stencil(rows_, gradient), prev, within, (own[0] // 4, own[1] // 4), colour, np.asarray(r.lo, float), np.asarray(r.hi, float))
                d = T._part(p.v0, ring, own) - T._part(prev, ring, own)
                yield pd.DataFrame([(r.material_id, r.plane, r.ty, r.tx, T._bytes(d, "<f8"), *_bytes_of(p.blocks), report.improved, report.blocks, report.delta_e)], columns=T._names(_STATE))

    return rows.mapInPandas(work, _STATE)


def refine(packed: DataFrame, found: DataFrame, grids: DataFrame, cw: Sequence[float], options: Options | None = None, passes: int = 4, edge: int = T.EDGE) -> tuple[DataFrame, DataFrame]:
    """Packed tiles with refined blocks, and (material_id, pass, improved, blocks, delta_e).

    Materials in which a pass improves nothing are left as they are from then on.
    """
    rows, table = K._bucketed(K.systems(packed.select(*T._names(T.TILE)), found, True, cw, options, edge), "packing_rows")
    try:
        return _refined(packed, rows, grids, passes, edge)
    finally:
        packed.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
        forget(rows)


def _refined(packed: DataFrame, rows: DataFrame, grids: DataFrame, passes: int, edge: int) -> tuple[DataFrame, DataFrame]:
    keys = T._KEYS
    fixed = packed.select(*keys, "v0").join(grids, "material_id")
    extents = packed.select(*keys, "h0", "w0", "h1", "w1")
    zero = F.lit(0).cast("long")

    def still(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            pdf["d"] = [b"\0" * (2 * len(v)) for v in pdf["v0"]]
            yield pdf[["material_id", "plane", "ty", "tx", "d", "r0", "r1", "sel"]]

    begin = packed.select(*keys, "v0", "r0", "r1", "sel").mapInPandas(still, ", ".join(_STATE.split(", ")[:8]))
    state = stored(begin.withColumns({"improved": zero, "blocks": zero, "delta_e": F.lit(0.0)}), "packing-state")
    done: list[DataFrame] = []
    told: list[DataFrame] = []
    for n in range(1, passes + 1):
        versions = [state]
        for colour in range(4):
            pieces = _give(versions[-1].join(extents, keys), edge)
            first = lambda c: F.first(c, ignorenulls=True).alias(c)
            met = pieces.groupBy(*keys).agg(F.collect_list(F.struct("rect", "d")).alias("pieces"), first("r0"), first("r1"), first("sel"))
            versions.append(stored(_turn(rows.join(met, keys).join(fixed, keys), colour, edge), "packing-state"))
        every = reduce(DataFrame.unionByName, versions[1:])
        told.append(stored(every.groupBy("material_id").agg(F.lit(n).alias("pass"), *[F.sum(c).alias(c) for c in ("improved", "blocks", "delta_e")]), "packing-report"))
        forget(*versions[:-1])
        state = versions[-1]
        quiet = told[-1].filter("improved = 0").select("material_id")
        if n == passes:
            done.append(state)
        elif not quiet.isEmpty():
            done.append(stored(state.join(quiet, "material_id"), "packing-state"))
            state = stored(state.join(quiet, "material_id", "left_anti"), "packing-state")
            if state.isEmpty():
                break
    last = reduce(DataFrame.unionByName, done)

    def decoded(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            values = []
            for r in pdf.itertuples(index=False):
                own = T.Grid(r.h0, r.w0, r.h1, r.w1, edge).own(r.ty, r.tx)[0]
                c = len(r.lo)
                values.append(T._bytes(L.block_values(_blocks_of(r, own, c), own[2], own[3], np.asarray(r.lo, float), np.asarray(r.hi, float))))
            pdf["v0"] = values
            yield pdf[T._names(PACKED)]

    kept = packed.drop("r0", "r1", "sel").join(last.drop("d", "improved", "blocks", "delta_e"), keys).join(grids, "material_id")
    out = stored(kept.mapInPandas(decoded, PACKED), "packed")
    forget(*done)
    return out, reduce(DataFrame.unionByName, told).select("material_id", "pass", "improved", "blocks", "delta_e")


class Versions:
    """Stored states of packed tiles: ``save`` keeps one, ``accept`` takes a newer one for some materials and goes back for the others."""

    def __init__(self, first: DataFrame) -> None:
        self.tables = [first]

    @property
    def latest(self) -> DataFrame:
        return self.tables[-1]

    def save(self, state: DataFrame) -> None:
        self.tables.append(state)

    def accept(self, newer: DataFrame, materials: DataFrame) -> DataFrame:
        """``newer`` for ``materials`` (material_id), the latest version for all others; becomes the latest."""
        mixed = newer.join(materials, "material_id").unionByName(self.latest.join(materials, "material_id", "left_anti"))
        self.save(stored(mixed.select(*newer.columns), "packed"))
        return self.latest

    def restore(self, back: int = 1) -> DataFrame:
        """The version so many steps before the latest; later ones are deleted."""
        for table in self.tables[len(self.tables) - back :]:
            forget(table)
        del self.tables[len(self.tables) - back :]
        return self.latest
