"""Large regions of a Jaccard join, divided by pivots in Spark rounds.

A region too large for one task is dealt out in blocks, and every block gets
copies of the region's pivots, a few sets that lie far apart in a bounded sample.
Every set goes to the Voronoi cell of its nearest pivot and, by the triangle
inequality, to each cell whose pivot is no farther than that distance plus twice
the link distance: two linked sets meet in the nearest pivot's cell of either.
Cells that are still too large are divided the same way. Sets found linked to a
pivot are connected at once.

A cell that pivots cannot divide (near copies of one another) is mostly
connected by then: its sets are blocked by what they are connected to, and
blocks of one component never meet.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pozo.llm.frames import connected, cut_lineage

PIVOTS = 8            # cells a region is divided into at a time
SAMPLE = 64           # sets that pivots are chosen from, about
SHRINK = 0.7          # a cell that keeps more than this share of its parent is not divided again
_U = np.uint64


def node_name():
    """A set's name: its 128-bit key in hex."""
    return F.lower(F.concat(F.lpad(F.hex("s1"), 16, "0"), F.lpad(F.hex("s2"), 16, "0")))


def names(s1: list[int], s2: list[int]) -> list[str]:
    return [f"{a & (2 ** 64 - 1):016x}{b & (2 ** 64 - 1):016x}" for a, b in zip(s1, s2)]


def distances(pivot: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(intersection size, size of both together) of a sorted set with each of ``sets``."""
    size = np.array([len(s) for s in sets], np.int64)
    inter = np.zeros(len(sets), np.int64)
    for i, s in enumerate(sets):
        at = np.searchsorted(pivot, s)
        at[at == len(pivot)] = 0
        inter[i] = int((pivot[at] == s).sum()) if len(pivot) else 0
    return inter, size + len(pivot)


def _sets(table: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), _U) for x in table.column("elements")]


def _pick(table: pa.Table) -> pa.Table:
    """Pivots of one cell: the first by key, then always the set farthest from all before."""
    s1, s2 = table.column("s1").to_pylist(), table.column("s2").to_pylist()
    sets = _sets(table)
    picks = [min(range(len(sets)), key=lambda i: (s1[i], s2[i]))]
    near = np.full(len(sets), np.inf)
    while len(picks) < PIVOTS:
        inter, total = distances(sets[picks[-1]], sets)
        near = np.minimum(near, 1 - inter / (total - inter))
        far = int(np.argmax(near))
        if near[far] <= 0:
            break
        picks.append(far)
    return table.select(["cell", "s1", "s2", "elements"]).take(pa.array(picks)).append_column("p", pa.array(range(len(picks)), pa.int32()))


ASSIGNED = "parent bigint, p int, s1 bigint, s2 bigint, elements binary, a string, b string"


def _assign(rule):
    """Cells of a block's sets (rows with elements), and links to pivots (rows with a and b)."""
    def run(table: pa.Table) -> pa.Table:
        kind = np.asarray(table.column("p"))
        pivots, rows = table.filter(pa.array(kind >= 0)), table.filter(pa.array(kind < 0))
        pivots = pivots.take(np.argsort(np.asarray(pivots.column("p"))))
        sets = _sets(rows)
        own, to = names(rows.column("s1").to_pylist(), rows.column("s2").to_pylist()), names(
            pivots.column("s1").to_pylist(), pivots.column("s2").to_pylist())
        far = np.empty((pivots.num_rows, len(sets)))
        a, b = [], []
        for k, pivot in enumerate(_sets(pivots)):
            inter, total = distances(pivot, sets)
            far[k] = 1 - inter / (total - inter)
            linked = [i for i in np.flatnonzero(rule.linked(inter, total)).tolist() if own[i] != to[k]]
            a += [to[k]] * len(linked)
            b += [own[i] for i in linked]
        near = far.min(axis=0)
        cell, who = np.nonzero(far <= near + 2 * rule.distance + 1e-9)
        parent = table.column("cell")[0].as_py()
        n = len(a)
        moved = pa.table({"parent": pa.array([parent] * len(who), pa.int64()), "p": pa.array(cell, pa.int32()),
                          **{c: rows.column(c).take(pa.array(who)) for c in ("s1", "s2", "elements")},
                          "a": pa.nulls(len(who), pa.string()), "b": pa.nulls(len(who), pa.string())})
        links = pa.table({"parent": pa.array([parent] * n, pa.int64()), "p": pa.nulls(n, pa.int32()), "s1": pa.nulls(n, pa.int64()),
                          "s2": pa.nulls(n, pa.int64()), "elements": pa.nulls(n, moved.schema.field("elements").type),
                          "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string())})
        return pa.concat_tables([moved, links])
    return run


def _sizes(work: DataFrame, block: int, block_bytes: int) -> DataFrame:
    """(cell, c, blocks) of the cells that are too large for one task."""
    blocks = F.ceil(F.greatest(F.count("*") / block, F.sum(F.octet_length("elements")) / block_bytes)).cast("int")
    return work.groupBy("cell").agg(F.count("*").alias("c"), blocks.alias("blocks")).where("blocks > 1")


def divide(sets: DataFrame, rule, block: int, block_bytes: int) -> tuple[DataFrame, DataFrame | None]:
    """Groups of sets (cell, _i, _j, s1, s2, elements, root) to be joined each in one task, and links already found.

    ``sets`` has (region, s1, s2, elements). Every two linked sets are in one group or
    connected by the links found. ``root`` names what a set is connected to already.
    """
    work = sets.select(F.col("region").alias("cell"), "s1", "s2", "elements")
    large = cut_lineage(_sizes(work, block, block_bytes))
    whole, flat, links = [work.join(large, "cell", "left_anti")], [], []
    work = work.join(large, "cell", "left_semi")
    depth = 0
    while not large.isEmpty():
        depth += 1
        even = F.xxhash64(F.lit(depth), "s1", "s2").bitwiseAND(F.lit((1 << 62) - 1)) / F.lit(float(1 << 62))
        pivots = cut_lineage(work.join(large, "cell").where(even <= 1.5 * SAMPLE / F.col("c"))
                             .select("cell", "s1", "s2", "elements").groupBy("cell")
                             .applyInArrow(_pick, "cell bigint, s1 bigint, s2 bigint, elements binary, p int"))
        # A cell of which no set was sampled is left as it is.
        flat.append(work.join(pivots.select("cell").distinct(), "cell", "left_anti"))
        with_pivots = cut_lineage(large.join(pivots.select("cell").distinct(), "cell", "left_semi"))
        rows = work.join(with_pivots, "cell").select(
            "cell", F.pmod(F.xxhash64("s1", "s2"), F.col("blocks")).cast("int").alias("_b"), F.lit(-1).alias("p"), "s1", "s2", "elements")
        spread = pivots.join(with_pivots, "cell").select(
            "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_b"), "p", "s1", "s2", "elements")
        made = cut_lineage(rows.unionByName(spread).groupBy("cell", "_b").applyInArrow(_assign(rule), ASSIGNED))
        links.append(made.where("a is not null").select("a", "b"))
        moved = made.where("elements is not null").select(
            F.xxhash64(F.lit(depth), "parent", "p").alias("cell"), "parent", "s1", "s2", "elements")
        parents = with_pivots.select(F.col("cell").alias("parent"), F.col("c").alias("_of"))
        of = moved.select("cell", "parent").distinct().join(parents, "parent").select("cell", "_of")
        sizes = cut_lineage(_sizes(moved, block, block_bytes).join(of, "cell"))
        work = moved.drop("parent")
        whole.append(work.join(sizes, "cell", "left_anti"))
        flat.append(work.join(sizes.where(F.col("c") > SHRINK * F.col("_of")), "cell", "left_semi"))
        large = cut_lineage(sizes.where(F.col("c") <= SHRINK * F.col("_of")).drop("_of"))
        work = work.join(large, "cell", "left_semi")
    none = F.lit(None).cast("string")
    groups = reduce(DataFrame.unionByName, whole).select("cell", F.lit("").alias("_i"), F.lit("").alias("_j"), "s1", "s2", "elements", none.alias("root"))
    if not links:
        return groups, None
    found = cut_lineage(reduce(DataFrame.unionByName, links).distinct())
    return groups.unionByName(_blocks(reduce(DataFrame.unionByName, flat), connected(found), block, block_bytes)), found


def _blocks(rows: DataFrame, roots: DataFrame, block: int, block_bytes: int) -> DataFrame:
    """Pairs of blocks of undivided cells. Large components of a cell have blocks of their
    own, which meet all others but each other's; the rest share mixed blocks."""
    named = cut_lineage(rows.withColumn("node", node_name()).join(roots, "node", "left")
                        .withColumn("root", F.coalesce("root", "node")).drop("node"))
    of = lambda: F.greatest(F.count("*") / block, F.sum(F.octet_length("elements")) / block_bytes)
    per = named.groupBy("cell", "root").agg(of().alias("w")).where("w > 0.5")
    per = cut_lineage(per.select("cell", "root", F.ceil("w").cast("int").alias("_own")))
    split = named.join(per, ["cell", "root"], "left")
    mixed = cut_lineage(split.where("_own is null").groupBy("cell").agg(F.ceil(of()).cast("int").alias("_mix")))
    split = split.join(mixed, "cell", "left")
    at = F.pmod(F.xxhash64("s1", "s2"), F.coalesce("_own", "_mix")).cast("string")
    split = cut_lineage(split.withColumn("pure", F.when(F.col("_own").isNotNull(), F.col("root")).otherwise(""))
                        .withColumn("blk", F.concat("pure", F.lit(":"), at)).drop("_own", "_mix"))
    blocks = cut_lineage(split.select("cell", "pure", "blk").distinct())
    other = blocks.select("cell", F.col("pure").alias("pure2"), F.col("blk").alias("blk2"))
    meet = blocks.join(other, "cell").where("blk <= blk2 and (pure = '' or pure <> pure2)")
    sides = meet.select("cell", F.col("blk").alias("_i"), F.col("blk2").alias("_j"),
                        F.explode(F.array_distinct(F.array("blk", "blk2"))).alias("blk"))
    return split.join(cut_lineage(sides), ["cell", "blk"]).select("cell", "_i", "_j", "s1", "s2", "elements", "root")
