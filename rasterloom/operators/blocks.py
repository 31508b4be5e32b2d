"""4 x 4 block codec: one endpoint pair and sixteen three-bit selectors per block and channel.

A block is one row with its sixteen values as an array, so packing is a single
aggregation (gathering a block) and everything after it is a projection.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.scalar import bc4_entry, bc4_palette, lit
from rasterloom.operators.resample import expand
from rasterloom.schema import BLOCK, KEYS


def gather(texels: DataFrame, w: int, h: int, keys: Sequence[str] = (*KEYS, "ch")) -> DataFrame:
    """keys, bx, by and the sixteen values ``v`` of every block, row-major; edge texels repeat.

    ``texels`` is long: keys, x, y, v.
    """
    full = expand(texels, w, h, -(-w // BLOCK) * BLOCK, -(-h // BLOCK) * BLOCK)
    x, y = F.col("x"), F.col("y")
    cell = [*keys, F.floor(x / BLOCK).cast("int").alias("bx"), F.floor(y / BLOCK).cast("int").alias("by")]
    return full.groupBy(*cell).agg(sixteen(x, y, F.col("v")).alias("v"))


def sixteen(x: Column, y: Column, v: Column) -> Column:
    """A block's values in order as an array: one aggregate for every place, so partial sums are flat rows."""
    at = F.pmod(y, F.lit(BLOCK)) * BLOCK + F.pmod(x, F.lit(BLOCK))
    return F.array(*[F.max(F.when(at == t, v)) for t in range(BLOCK * BLOCK)])


def selector(palette: Column, target: Column) -> Column:
    """The palette entry nearest to ``target``, the lowest on ties."""
    near = F.transform(palette, lambda p, i: F.struct(F.abs(p - target).cast("float").alias("d"), i.alias("i")))
    return F.array_min(near)["i"]


def encode(blocks: DataFrame, bits: int) -> DataFrame:
    """``blocks`` of indices (0 .. 2**bits - 1) with r0, r1, sel and the squared error ``se`` in byte units.

    One to three bits are relabelled without loss; above that the endpoints are the
    block's largest and smallest value and every texel takes the nearest entry.
    """
    v = F.col("v")
    if bits <= 3:
        ends = {1: (0, 255), 2: (85, 170), 3: (255, 0)}[bits]
        label = {1: [6, 7], 2: [6, 0, 1, 7], 3: [1, 7, 6, 5, 4, 3, 2, 0]}[bits]
        table = F.array(*[F.lit(x) for x in label])
        return blocks.select(*[c for c in blocks.columns], F.lit(ends[0]).alias("r0"), F.lit(ends[1]).alias("r1"), F.transform(v, lambda k: F.element_at(table, k.cast("int") + 1)).alias("sel"), lit(0).alias("se"))
    levels = (1 << bits) - 1
    end = lambda k: F.floor(k.cast("double") * lit(255) / lit(levels) + lit(0.5)).cast("int")
    found = blocks.withColumns({"r0": end(F.array_max("v")), "r1": end(F.array_min("v"))}).withColumn("__p", bc4_palette(F.col("r0"), F.col("r1")))
    target = lambda k: (k.cast("double") * lit(255) / lit(levels)).cast("float").cast("double")
    found = found.withColumn("sel", F.when(F.col("r0") == F.col("r1"), F.transform(v, lambda k: F.lit(0))).otherwise(F.transform(v, lambda k: selector(F.col("__p"), target(k)))))
    error = F.aggregate(F.zip_with("v", "sel", lambda k, s: F.pow(F.element_at(F.col("__p"), s + 1) - target(k), lit(2))), lit(0), lambda a, d: a + d)
    return found.withColumn("se", F.when(F.col("r0") == F.col("r1"), lit(0)).otherwise(error)).drop("__p")


def selector_bits(sel: Column) -> Column:
    """Sixteen selectors as one 48-bit number, the first in the lowest bits."""
    return F.aggregate(F.transform(sel, lambda s, i: s.cast("long") * F.pow(lit(8), i.cast("double")).cast("long")), F.lit(0).cast("long"), lambda a, s: a + s)


def pack(blocks: DataFrame, name: str) -> DataFrame:
    """``blocks`` with their eight bytes as ``name``: endpoints, then the selector bits, low byte first."""
    rows = blocks.withColumn("__hex", F.lpad(F.hex(selector_bits(F.col("sel"))), 12, "0"))
    ends = [F.lpad(F.hex(F.col(r).cast("long")), 2, "0") for r in ("r0", "r1")]
    return rows.withColumn(name, F.unhex(F.concat(*ends, *[F.substring("__hex", i, 2) for i in range(11, 0, -2)]))).drop("__hex")


def unpack(blocks: DataFrame, column: str) -> DataFrame:
    """``blocks`` with r0, r1 and sel from eight bytes."""
    number = lambda at: F.conv(F.hex(F.substring(F.col(column), at, 1)), 16, 10).cast("int")
    # Selectors sit in a low-byte-first 48-bit number: its bytes backwards are its hex digits.
    bits = F.conv(F.concat(*[F.hex(F.substring(F.col(column), i, 1)) for i in range(8, 2, -1)]), 16, 2)
    rows = blocks.withColumns({"r0": number(1), "r1": number(2), "__bits": F.lpad(bits, 48, "0")})
    sel = F.array(*[F.conv(F.substring("__bits", 46 - 3 * t, 3), 2, 10).cast("int") for t in range(16)])
    return rows.withColumn("sel", sel).drop("__bits")


def decode(blocks: DataFrame, w: int, h: int, keys: Sequence[str] = (*KEYS, "ch")) -> DataFrame:
    """Texels (keys, x, y, v) of blocks with r0, r1, sel; texels past the edge are left out."""
    rows = blocks.select(*keys, "bx", "by", "r0", "r1", F.posexplode("sel").alias("t", "s"))
    x, y = F.col("bx") * BLOCK + F.pmod(F.col("t"), F.lit(BLOCK)), F.col("by") * BLOCK + F.floor(F.col("t") / BLOCK).cast("int")
    texels = rows.select(*keys, x.alias("x"), y.alias("y"), bc4_entry(F.col("r0"), F.col("r1"), F.col("s")).alias("v"))
    return texels.filter((F.col("x") < w) & (F.col("y") < h))


def decode_exact(packed: DataFrame, column: str, w: int, h: int, keys: Sequence[str] = (*KEYS, "ch")) -> DataFrame:
    """Texels (keys, x, y, num, den) of eight-byte blocks by another way than ``decode``: the value is num / den, in whole numbers.

    The 48 bits are one number, selectors are its shifts, and an entry is the sum of both ends with whole weights
    over their total (7, 5, or 1 for the ends themselves and the two fixed entries of the shorter palette).
    """
    byte = lambda i: F.conv(F.hex(F.substring(F.col(column), i, 1)), 16, 10).cast("long")
    bits = F.lit(0).cast("long")
    for i in range(6):
        bits = bits + F.shiftleft(byte(3 + i), 8 * i)
    rows = packed.select(*keys, "bx", "by", byte(1).alias("a"), byte(2).alias("b"), bits.alias("bits"))
    rows = rows.select("*", F.posexplode(F.array(*[F.shiftright(F.col("bits"), 3 * t).bitwiseAND(F.lit(7)) for t in range(BLOCK * BLOCK)])).alias("t", "s"))
    a, b, s = F.col("a"), F.col("b"), F.col("s")
    long_ = a > b
    num = F.when(s == 0, a).when(s == 1, b).when(long_, (8 - s) * a + (s - 1) * b).when(s == 6, F.lit(0)).when(s == 7, F.lit(255)).otherwise((6 - s) * a + (s - 1) * b)
    den = F.when(s <= 1, F.lit(1)).when(long_, F.lit(7)).when(s >= 6, F.lit(1)).otherwise(F.lit(5))
    x, y = F.col("bx") * BLOCK + F.pmod(F.col("t"), F.lit(BLOCK)), F.col("by") * BLOCK + F.floor(F.col("t") / BLOCK).cast("int")
    return rows.select(*keys, x.alias("x"), y.alias("y"), num.cast("long").alias("num"), den.cast("long").alias("den")).filter((F.col("x") < w) & (F.col("y") < h))


def decoders_agree(packed: DataFrame, column: str, w: int, h: int, keys: Sequence[str] = (*KEYS, "ch")) -> DataFrame:
    """Per key: texels, how many both decoders give differently as float32, the largest difference, texels that one lacks, and the sum of all exact values in 1/35."""
    at = [*keys, "x", "y"]
    both = decode(unpack(packed, column), w, h, keys).withColumnRenamed("v", "__v").join(decode_exact(packed, column, w, h, keys), at, "full")
    exact = (F.col("num").cast("double") / F.col("den").cast("double")).cast("float")
    apart = F.abs(F.col("__v").cast("double") - exact.cast("double"))
    return both.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(apart != 0).alias("differ"), F.max(apart).alias("worst"), F.count_if(F.col("__v").isNull() | F.col("num").isNull()).alias("lacking"), F.sum(F.col("num") * (F.lit(35) / F.col("den")).cast("long")).alias("total35")
    )


def packing_error(blocks: DataFrame, texels: DataFrame, w: int, h: int, bits: int, keys: Sequence[str] = (*KEYS, "ch")) -> DataFrame:
    """Squared byte error of decoded blocks against exact indices, texels inside the plane only."""
    exact = F.col("v").cast("double") * lit(255) / lit((1 << bits) - 1)
    at = [*keys, "x", "y"]
    both = decode(blocks, w, h, keys).withColumnRenamed("v", "__d").join(texels.select(*at, exact.alias("__e")), at)
    return both.groupBy(*keys).agg(F.sum(F.pow(F.col("__d") - F.col("__e"), lit(2))).alias("se"), F.count(F.lit(1)).alias("n"))


def block_count(w: int, h: int) -> int:
    return -(-w // BLOCK) * -(-h // BLOCK)


def stored_byte(k: Column, bits: int) -> Column:
    """The byte an index is stored as, uncompressed."""
    from rasterloom.functions.scalar import replicate_index

    return replicate_index(k, bits)


def exact_byte(k: Column, bits: int) -> Column:
    return k.cast("double") * lit(255) / lit((1 << bits) - 1)
