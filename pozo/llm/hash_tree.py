"""Sharding by a hierarchical weighted hash tree (DataFrame functions only).

Shards hang in racks and racks in regions; a node weighs what its shards weigh
together. A row descends: the regions draw, the winner's racks draw, the
winning rack's shards draw, and no other node is looked at. A node's draw is an
exponential arrival time from the row's key and the node's own number, divided
by its weight, and the earliest wins: a weighted choice among siblings.

A draw depends on the node and its weight alone. Raising a weight makes the
draws on the path to that shard earlier, lowering it later, and no others: rows
move only into, out of or within the subtrees whose weight changed. A shard
added as a subtree of its own takes rows only into itself.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pozo.llm.frames import cut_lineage, shuffle_tasks


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def uniform_tree(shards: int, per_rack: int = 4, racks_per_region: int = 2) -> list[Shard]:
    """``shards`` equal shards. They fill racks and regions in order; those that do not
    make up a whole region stand alone, each a region and rack of its own, so that the
    tree of n + 1 shards is the tree of n and one more subtree, until a region is whole."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    size = per_rack * racks_per_region
    whole = shards - shards % size
    out = [Shard(s // size, s // per_rack, s) for s in range(whole)]
    return out + [Shard(whole // size + i, whole // per_rack + i, whole + i) for i in range(shards - whole)]


def grown_tree(tree: Sequence[Shard], weight: float = 1.0) -> list[Shard]:
    """``tree`` and one more shard in a region and rack of its own."""
    new = (1 + max(getattr(n, x) for n in tree) for x in LEVELS)
    return [*tree, Shard(*new, weight)]


LEVELS = ("region", "rack", "shard")


def _earliest(key: Sequence[Column], level: int, seed: int, children: Column) -> Column:
    """The child struct (t, id, at) with the earliest draw; equal draws go to the smaller number."""
    def draw(c: Column) -> Column:
        # 53 hash bits as a number strictly between 0 and 1
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(level), c["id"], *key), 11)
        u = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
        return F.struct((-F.log(u) / c["weight"]).alias("t"), c["id"].alias("id"), c["at"].alias("at"))
    return F.array_min(F.transform(children, draw))


def descend(key: Sequence[Column], tree: Sequence[Shard], seed: int = 0) -> Column:
    """struct(region, rack, shard) a row's key descends to (weight 0: never).

    The children of every node are one literal array; each level draws among the
    children of the node that won the level above.
    """
    live = [n for n in tree if n.weight > 0]
    if not live or len({n.shard for n in live}) < len(live):
        raise ValueError("a tree needs a shard of positive weight and distinct shard numbers")
    lists: list[Column] = []

    def add(nodes: Sequence[Shard], level: int) -> int:
        """Lists the children of a node; returns where its list stands."""
        place = len(lists)
        lists.append(F.lit(0))
        children = []
        for i in sorted({getattr(n, LEVELS[level]) for n in nodes}):
            below = [n for n in nodes if getattr(n, LEVELS[level]) == i]
            at = add(below, level + 1) if level < 2 else -1
            children.append(F.struct(F.lit(at).alias("at"), F.lit(i).alias("id"),
                                     F.lit(float(sum(n.weight for n in below))).alias("weight")))
        lists[place] = F.array(*children)
        return place

    add(live, 0)
    table = F.array(*lists)
    # Nested one-element transforms name each winner once for the level below.
    path = F.transform(F.array(_earliest(key, 0, seed, lists[0])), lambda region: F.element_at(F.transform(
        F.array(_earliest(key, 1, seed, F.get(table, region["at"]))), lambda rack: F.struct(
            region["id"].alias("region"), rack["id"].alias("rack"),
            _earliest(key, 2, seed, F.get(table, rack["at"]))["id"].alias("shard"))), 1))
    return F.element_at(path, 1)


def shard_rows(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text",
               seed: int = 0, tree: Sequence[Shard] | None = None,
               grown: Sequence[Shard] | None = None) -> DataFrame:
    """Shard every row by its id: (id, size, text_crc32, law, shard, slot, grown_shard, region, rack).

    ``size`` is the text's UTF-8 bytes plus 16, ``slot`` numbers a shard's rows
    from 0 without gaps (by id), ``grown_shard`` is the shard in the tree with one
    more shard (:func:`grown_tree`, or ``grown``). Law ``key``: id, seed and tree
    decide alone, and the added shard takes rows only into itself.

    A null id is a key like any other; repeated ids share a shard and get
    slots of their own; a null text has size 16 and the checksum of no bytes;
    an empty table gives an empty result; other columns are ignored.

    Slots need no task to hold a whole shard: rows are range-partitioned on
    (shard, id, ..., row hash), so a shard (or an id that a third of the rows
    carry) spans many partitions, written once to the checkpoint folder, and
    numbered within (partition, shard) plus the row count of earlier partitions.
    """
    tree = list(tree or uniform_tree(shards))
    grown = list(grown or grown_tree(tree))
    key = [F.col("_id")]
    slim = docs.select(
        F.col(id_col).alias("_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col).cast("binary"), F.lit("").cast("binary"))).alias("text_crc32"))
    slim = (slim.withColumn("_p", descend(key, tree, seed)).withColumn("_g", descend(key, grown, seed)["shard"])
            .select("_id", "size", "text_crc32", "_p.region", "_p.rack", "_p.shard",
                    F.col("_g").alias("grown_shard"), F.monotonically_increasing_id().alias("_row")))
    tasks = shuffle_tasks(docs.sparkSession)
    ranged = cut_lineage(
        slim.repartitionByRange(tasks, "shard", "_id", "size", "text_crc32", F.xxhash64("_row"))
        .withColumn("_part", F.spark_partition_id()))
    # At most partitions x shards rows: each (partition, shard) starts where the earlier ones end.
    counts = ranged.groupBy("_part", "shard").agg(F.count("*").alias("n"))
    start = counts.select("_part", "shard", F.coalesce(F.sum("n").over(
        Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("_start"))
    numbered = ranged.withColumn("_n", F.row_number().over(
        Window.partitionBy("_part", "shard").orderBy("_id", "size", "text_crc32", "_row")))
    return (numbered.join(start, ["_part", "shard"])
            .select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"),
                    "shard", (F.col("_start") + F.col("_n") - 1).cast("long").alias("slot"),
                    "grown_shard", "region", "rack"))
