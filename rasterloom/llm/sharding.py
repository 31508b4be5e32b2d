"""Sharding by a hierarchical weighted hash tree.

A topology is a tree region -> rack -> shard with weights at the leaves; an
inner node weighs what its leaves weigh.  A row descends it from the root: at
each node every child draws ``-ln(u) / weight`` with ``u`` from a hash of (key,
child's name), and the smallest draw wins.  A child's draw depends on nothing
but the key, its own name and its own weight, so a changed weight moves rows
only into or out of the child that changed, at every level: movement is
confined to the subtrees whose weights change.

``Topology.grow`` adds capacity as a region of its own.  All other weights stay,
so the only draw that is new is that of the new region, and rows move into the
new shard alone - the ``key`` law.

Nothing is shuffled to assign shards: the tree is a literal in the plan, the
draws are built-in expressions.  Slots (positions within a shard) are dealt by
hash buckets: rows are numbered within (shard, bucket) and shifted by the rows
of the shard's earlier buckets, so no task ever holds one whole shard.

Defined cases: a null key draws like the text ``null``; a null text has size 1
and crc32 0; repeated rows are numbered separately, in any order among equals;
an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of a draw: 52 bits fit a double exactly.
DRAW_DIGITS = 13
#: Hash buckets a shard is numbered in: 16 ** SLOT_DIGITS.
SLOT_DIGITS = 2


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


@dataclass(frozen=True)
class Topology:
    leaves: tuple[Leaf, ...]

    @staticmethod
    def even(shards: int, per_rack: int = 4, racks_per_region: int = 2) -> Topology:
        """Shards of weight 1 in racks and regions of fixed sizes."""
        return Topology(tuple(Leaf(f"g{s // (per_rack * racks_per_region)}", f"k{s // per_rack}", s) for s in range(shards)))

    def grow(self, weight: float = 1.0) -> Topology:
        """One more shard, in a region of its own: it takes rows only into itself."""
        n = 1 + max((x.shard for x in self.leaves), default=-1)
        return Topology((*self.leaves, Leaf(f"grown{n}", f"grown{n}", n, weight)))

    def reweigh(self, shard: int, weight: float) -> Topology:
        return Topology(tuple(Leaf(x.region, x.rack, x.shard, weight if x.shard == shard else x.weight) for x in self.leaves))

    def tree(self) -> dict[str, dict[str, dict[int, float]]]:
        out: dict[str, dict[str, dict[int, float]]] = {}
        for x in self.leaves:
            if x.weight < 0:
                raise ValueError("weights are not negative")
            if x.weight > 0:
                out.setdefault(x.region, {}).setdefault(x.rack, {})[x.shard] = x.weight
        if not out:
            raise ValueError("a topology needs a shard of positive weight")
        return out


def _draw(key: Column, name: str, weight: float) -> Column:
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(":" + name))), 1, DRAW_DIGITS), 16, 10).cast("double")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(16**DRAW_DIGITS))) / F.lit(float(weight))


def shard_of(key: Column, topology: Topology) -> Column:
    """The shard of a key: three weighted draws, region, rack, shard."""
    key = F.coalesce(key.cast("string"), F.lit("null"))

    def pick(children: list[tuple[str, float]]) -> Column:
        if len(children) == 1:
            return F.lit(children[0][0])
        draws = [F.struct(_draw(key, name, weight).alias("d"), F.lit(name).alias("n")) for name, weight in children]
        return F.array_min(F.array(*draws))["n"]

    tree = topology.tree()
    weigh = lambda racks: sum(sum(x.values()) for x in racks.values())
    region = pick([(f"region {g}", weigh(racks)) for g, racks in sorted(tree.items())])

    def within(chosen: Column, options: list[tuple[str, Column]]) -> Column:
        out = F.when(chosen == options[0][0], options[0][1])
        for name, value in options[1:]:
            out = out.when(chosen == name, value)
        return out

    racks_of = [(f"region {g}", pick([(f"rack {g}/{k}", sum(x.values())) for k, x in sorted(racks.items())])) for g, racks in sorted(tree.items())]
    rack = within(region, racks_of)
    shards_of = [(f"rack {g}/{k}", pick([(f"shard {s}", w) for s, w in sorted(x.items())])) for g, racks in sorted(tree.items()) for k, x in sorted(racks.items())]
    return F.substring_index(within(rack, shards_of), " ", -1).cast("int")


def assign(df: DataFrame, key: str, topology: Topology, grown: Topology | None = None) -> DataFrame:
    """``df`` with ``shard``, and ``grown_shard`` under a second topology."""
    out = df.withColumn("shard", shard_of(F.col(key), topology))
    return out.withColumn("grown_shard", shard_of(F.col(key), grown)) if grown is not None else out


def with_slots(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Gapless positions 0.. within each shard.

    Two light passes: a count by (shard, bucket) - pre-aggregated, a fixed number
    of rows - whose running sums are each bucket's first slot, and a numbering
    within (shard, bucket).  The joined table has shards * 256 rows at most.
    """
    text_key = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    bucket = F.conv(F.substring(F.md5(F.concat(text_key, F.lit(":slot"))), 1, SLOT_DIGITS), 16, 10).cast("int")
    keyed = df.withColumn("__bucket", bucket)
    counts = keyed.groupBy("shard", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    within = Window.partitionBy("shard", "__bucket").orderBy(*order)
    return (
        keyed.withColumn("__rank", F.row_number().over(within))
        .join(F.broadcast(first), ["shard", "__bucket"])
        .withColumn("slot", F.col("__first") + F.col("__rank") - 1)
        .drop("__bucket", "__rank", "__first")
    )


def shard_documents(documents: DataFrame, topology: Topology, grown: Topology) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select("doc_id", "text").select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = with_slots(assign(rows, "doc_id", topology, grown), "doc_id", ["doc_id", "size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
