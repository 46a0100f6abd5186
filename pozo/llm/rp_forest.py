"""Near-duplicate vectors by a random-projection tree forest with spill.

Every tree splits unit vectors along one random direction per level, at the
emptiest place around the middle; vectors within a margin of the split go to
both sides. Vectors of one leaf and label are compared exactly. A linked pair
is counted once, in the first leaf that both share, so links need no list of
all pairs; each leaf passes on only a forest of its links for the components.

Trees grow in Spark rounds: leaves are counted, each one that is still too large
gets a subtree fitted on a bounded sample of its own vectors, and its vectors
are routed on. So leaves stay small at every size of the table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pozo.llm.frames import connected, cut_lineage

TREES = 6
LEAF = 64             # vectors of a label per leaf aimed at
SPILL = 0.35          # margin, in spreads of a pair at the threshold along a random direction
SAMPLE = 4096         # vectors a subtree is fitted on, about; fewer if they are long
SAMPLE_BYTES = 32 << 20
ROUND = 7             # levels grown in one round, at most
DEPTH = 46            # levels of a tree, at most (a leaf's number has 48 bits)
FEW = 10_000          # leaves whose subtrees, half a KB each, may be broadcast
BLOCK = 1024          # vectors of a leaf and label compared in one task (two blocks at most)


def directions(dim: int, tree: int, level: int, levels: int, seed: int) -> np.ndarray:
    """dim x levels: the unit directions of a tree from ``level`` on, the same for all its nodes."""
    out = np.stack([np.random.default_rng([seed, dim, tree, level + i]).standard_normal(dim) for i in range(levels)], axis=1)
    return out / np.linalg.norm(out, axis=0)


def grow(place: np.ndarray, margin: float) -> np.ndarray:
    """Thresholds of a subtree over a sample, given as places along each level's direction.

    Heap order (children of i are 2i + 1 and 2i + 2), NaN where a leaf stays: few
    sampled vectors, or most of them in the margin of every threshold.
    """
    levels = place.shape[1]
    cuts = np.full((1 << levels) - 1, np.nan, np.float32)
    todo = [(0, 0, np.arange(len(place)))]
    while todo:
        at, level, rows = todo.pop()
        if level == levels or len(rows) < 16:
            continue
        v = np.sort(place[rows, level])
        options = v[np.linspace(0.3 * (len(v) - 1), 0.7 * (len(v) - 1), 41).astype(int)].astype(np.float32)
        inside = np.searchsorted(v, options + margin, side="right") - np.searchsorted(v, options - margin)
        best = int(np.lexsort((np.abs(np.arange(41) - 20), inside))[0])
        if inside[best] > 0.5 * len(v):
            continue
        cuts[at] = options[best]
        x = place[rows, level]
        todo += [(2 * at + 1, level + 1, rows[x <= options[best]]), (2 * at + 2, level + 1, rows[x > options[best]])]
    return cuts


def route(place: np.ndarray, cuts: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, levels gone down, place among the nodes of that level) for every leaf each row reaches.

    ``cuts`` holds a row's own subtree per row.
    """
    found = []
    rows, at, side = np.arange(len(place)), np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    for level in range(place.shape[1] + 1):
        t = cuts[rows, at] if level < place.shape[1] else np.full(len(rows), np.nan)
        inner = ~np.isnan(t)
        found.append((rows[~inner], np.full((~inner).sum(), level), side[~inner]))
        if not inner.any():
            break
        rows, at, side, t = rows[inner], at[inner], side[inner], t[inner]
        v = place[rows, level]
        left, right = v <= t + margin, v > t - margin
        rows = np.r_[rows[left], rows[right]]
        at, side = np.r_[2 * at[left] + 1, 2 * at[right] + 2], np.r_[2 * side[left], 2 * side[right] + 1]
    return tuple(np.concatenate(x) for x in zip(*found))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of ``dim`` numbers, packed as bytes of floats or doubles, as doubles."""
    rows = column.to_pylist()
    if not rows:
        return np.empty((0, dim))
    kind = np.float32 if len(rows[0]) == 4 * dim else np.float64
    return np.stack([np.frombuffer(v, kind) for v in rows]).astype(np.float64)


def _pack(kind: type = np.float64):
    """Vectors as bytes of ``kind``; rows whose vector is null, zero or not finite have null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column("vector")
            n = np.asarray(col.value_lengths().fill_null(0))
            flat = col.flatten()
            holes = np.asarray(flat.is_null())
            values = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(kind)
            bad = holes | ~np.isfinite(values)
            out, at = [], 0
            for size in n.tolist():
                v = values[at:at + size]
                out.append(v.tobytes() if size and not bad[at:at + size].any() and v.any() else None)
                at += size
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(n, pa.int32()), pa.array(out, pa.binary())],
                                             names=["id", "label", "dim", "packed"])
    return run


def unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(axis=1, keepdims=True)      # no overflow or underflow of squares
    x = x / big
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _spread(least: float, dim: int) -> float:
    return SPILL * math.sqrt(max(0.0, 2 - 2 * least) / dim)


def _levels(count: int, leaf: int) -> int:
    return max(1, min(ROUND, math.ceil(math.log2(count / leaf))))


def _split_code(code: int) -> tuple[int, int, int]:
    """(tree, node, level) of a leaf's number: the tree, then the node in heap order from 1."""
    node = code & ((1 << 48) - 1)
    return code >> 48, node, node.bit_length() - 1


def _fit(leaf: int, least: float, seed: int):
    """One leaf's subtree, from the sample of its vectors."""
    def run(table: pa.Table) -> pa.Table:
        code, dim = table.column("code")[0].as_py(), table.column("dim")[0].as_py()
        tree, _, level = _split_code(code)
        levels = min(_levels(table.column("c")[0].as_py(), leaf), DEPTH - level)
        cuts = np.empty(0, np.float32)
        if levels > 0:
            x = unit(_matrix(table.column("packed").combine_chunks(), dim))
            cuts = grow(x @ directions(dim, tree, level, levels, seed), _spread(least, dim))
        if not len(cuts) or np.isnan(cuts[0]):
            cuts = np.empty(0, np.float32)
        return pa.table({"label": table.column("label").slice(0, 1), "dim": pa.array([dim], pa.int32()),
                         "code": pa.array([code], pa.int64()), "cuts": pa.array([cuts.tobytes()], pa.binary())})
    return run


def _router(least: float, seed: int):
    """The leaves a vector reaches below the one it was in."""
    known: dict[tuple, np.ndarray] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                batch = whole.slice(lo, 2048)
                codes, dims = batch.column("code").to_pylist(), batch.column("dim").to_pylist()
                cuts = batch.column("cuts").to_pylist()
                below: list[list[int]] = [[] for _ in codes]
                alike: dict[tuple, list[int]] = {}
                for i, (code, dim, cut) in enumerate(zip(codes, dims, cuts)):
                    tree, _, level = _split_code(code)
                    alike.setdefault((dim, tree, level, len(cut) // 4), []).append(i)
                for (dim, tree, level, size), rows in alike.items():
                    key = (dim, tree, level, (size + 1).bit_length() - 1)
                    if key not in known:
                        known[key] = directions(*key, seed)
                    x = unit(_matrix(batch.column("packed").take(pa.array(rows)), dim))
                    own = np.stack([np.frombuffer(cuts[i], np.float32) for i in rows])
                    for r, down, side in zip(*(a.tolist() for a in route(x @ known[key], own, _spread(least, dim)))):
                        below[rows[r]].append(((codes[rows[r]] & ((1 << 48) - 1)) << down) + side | tree << 48)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in ("k1", "k2", "code")], pa.array(below, pa.list_(pa.int64()))],
                    names=["k1", "k2", "old", "new"])
    return run


GROUP = ["label", "dim", "code"]


def _few(df: DataFrame, rows: int) -> DataFrame:
    """``df`` for a join: broadcast if its number of rows is small, else left to the planner."""
    return F.broadcast(df) if rows <= FEW else df


def forest(nodes: DataFrame, least: float, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE,
           seed: int = 0) -> DataFrame:
    """``nodes`` (label, dim, k1, k2, packed, ...) with ``codes``, the leaves of all trees each reaches.

    Per round, leaves of more than 2 * ``leaf`` vectors of a label are split further, down
    to about ``leaf`` in one round if their sample allows it. A leaf that cannot be
    split (its vectors lie within the margin) stays as it is. Joins of vectors with
    their leaves read the leaves from a checkpoint, so Spark splits a large one.
    """
    label = nodes.schema["label"].dataType.simpleString()
    out = cut_lineage(nodes.withColumn("codes", F.array(*[F.lit((t << 48) + 1).cast("long") for t in range(trees)])))
    done = None
    while True:
        at = out.select("label", "dim", "k1", "k2", "packed", F.explode("codes").alias("code"))
        large = at.groupBy(*GROUP).agg(F.count("*").alias("c")).where(F.col("c") > 2 * leaf)
        if done is not None:
            large = large.join(done, GROUP, "left_anti")
        most = F.least(F.lit(sample), F.lit(SAMPLE_BYTES) / (8 * F.col("dim")))
        large = cut_lineage(large.withColumn("_most", F.least(F.lit(1.0), most / F.col("c"))))
        n = large.count()
        if not n:
            break
        # Hashes of distinct vectors are even: about `sample` of a leaf are below the bound.
        even = F.col("k1").bitwiseAND(F.lit((1 << 63) - 1)) / F.lit(float(1 << 63))
        subtrees = cut_lineage(at.join(_few(large, n), GROUP).where(even <= F.col("_most")).drop("_most", "k1", "k2")
                               .groupBy(*GROUP).applyInArrow(_fit(leaf, least, seed), f"label {label}, dim int, code bigint, cuts binary"))
        flat = subtrees.where("length(cuts) = 0").select(*GROUP)
        done = flat if done is None else done.unionByName(flat)
        moved = (at.join(_few(subtrees.where("length(cuts) > 0"), n), GROUP).select("k1", "k2", "code", "dim", "packed", "cuts")
                 .mapInArrow(_router(least, seed), "k1 bigint, k2 bigint, old bigint, new array<bigint>"))
        moved = moved.groupBy("k1", "k2").agg(F.collect_list("old").alias("_old"), F.flatten(F.collect_list("new")).alias("_new"))
        # A leaf without a sampled vector is left for the next round, which samples it anew or finds it done.
        unseen = large.select(*GROUP).join(subtrees.select(*GROUP), GROUP, "left_anti")
        done = cut_lineage(done.unionByName(unseen))
        out = cut_lineage(out.join(moved, ["k1", "k2"], "left").withColumn(
            "codes", F.when(F.col("_new").isNull(), F.col("codes")).otherwise(
                F.concat(F.array_except("codes", "_old"), "_new"))).drop("_old", "_new"))
    # Trees that split nothing have one and the same leaf: the first of them is enough.
    root = lambda c: c.bitwiseAND(F.lit((1 << 48) - 1)) == 1
    return out.withColumn("codes", F.concat(F.slice(F.array_sort(F.filter("codes", root)), 1, 1), F.filter("codes", lambda c: ~root(c))))


def _compare(least: float):
    def run(table: pa.Table) -> pa.Table:
        own, i, j = (np.asarray(table.column(c)) for c in ("_b", "_i", "_j"))
        x = unit(_matrix(table.column("packed").combine_chunks(), table.column("dim")[0].as_py()))
        times = np.asarray(table.column("times"))
        n = len(x)
        across = i[0] != j[0]
        # 1 where a row is in a leaf that comes before this one
        lists = table.column("codes").combine_chunks()
        earlier, at = np.unique(np.asarray(lists.flatten()), return_inverse=True)
        before = np.zeros((n, max(1, len(earlier))), np.float32)
        before[np.repeat(np.arange(n), np.asarray(lists.value_lengths())), at] = 1
        near = np.zeros((n, n), bool)
        links = np.zeros(n, np.int64)
        for a in range(0, n, 512):
            b = min(n, a + 512)
            close = x[a:b] @ x.T >= least
            close[np.arange(b - a), np.arange(a, b)] = False
            if across:
                close &= own[a:b, None] != own[None, :]
            near[a:b] = close
            if close.any():
                links[a:b] = ((close & (before[a:b] @ before.T == 0)) * times[None, :]).sum(axis=1)
        root = np.arange(n)
        some = near.any(axis=1)
        while some.any():
            low = np.where(near, root[None, :], n).min(axis=1)
            new = np.minimum(root, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        names = [f"{a & (2 ** 64 - 1):016x}{b & (2 ** 64 - 1):016x}"
                 for a, b in zip(table.column("k1").to_pylist(), table.column("k2").to_pylist())]
        rows = [(names[r], None, int(links[r])) for r in np.flatnonzero(links).tolist()]
        rows += [(names[r], names[root[r]], 0) for r in np.flatnonzero(root != np.arange(n)).tolist()]
        a, b, c = zip(*rows) if rows else ((), (), ())
        return pa.table({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "links": pa.array(c, pa.int64())})
    return run


def near_duplicates(vectors: DataFrame, least: float = 0.93, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE,
                    block: int = BLOCK, seed: int = 0, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    Two vectors link when their labels are equal and not null and their cosine,
    in double precision, is at least ``least``. Vectors that are null, empty,
    zero or hold null or non-finite numbers link with nothing, nor do vectors
    of different lengths. ``n_links`` counts other rows linked directly,
    ``component_id`` is the smallest id reachable (a null id only where all
    are null), ``kept`` whether it is the row's own. Equal vectors of a label
    are one node with a multiplicity, so copies are never paired; repeated ids
    are separate rows; other columns are ignored; empty tables give none.

    Links are never wrong, but a pair that no tree brings into one leaf is
    missed. A subtree is fitted on about ``sample`` vectors of its leaf, those of
    smallest hash. A leaf of more than ``block`` vectors that cannot be split is
    dealt to several tasks of two blocks each: nothing is cut off.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    lab = vectors.schema[label_col].dataType.simpleString()
    element = vectors.schema[vector_col].dataType
    if not isinstance(element, T.ArrayType):
        raise TypeError(f"{vector_col} must be an array")
    rows = cut_lineage(
        vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
        .mapInArrow(_pack(np.float32 if isinstance(element.elementType, T.FloatType) else np.float64),
                    f"id {kind}, label {lab}, dim int, packed binary")
        .withColumn("k1", F.xxhash64("label", "dim", "packed")).withColumn("k2", F.xxhash64(F.lit(7), "packed", "dim", "label")))
    usable = rows.where("label is not null and packed is not null")
    nodes = usable.groupBy("label", "dim", "k1", "k2", "packed").agg(F.count("*").alias("times"), F.min("id").alias("low"))
    routed = forest(nodes, least, trees, leaf, sample, seed)
    nodes = routed.select("k1", "k2", "times", "low")
    routed = routed.drop("low")
    at = routed.withColumn("code", F.explode("codes"))
    sizes = at.groupBy(*GROUP).agg(F.count("*").alias("c")).where("c > 1")
    sizes = cut_lineage(sizes.select(*GROUP, F.ceil(F.col("c") / block).cast("int").alias("blocks")))
    dealt = at.join(sizes, GROUP).withColumn("_b", F.pmod(F.xxhash64("k1", "k2"), F.col("blocks")).cast("int"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_o")).select(
        "label", "dim", "code", F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"), "_b",
        "k1", "k2", "times", "packed", F.filter("codes", lambda c: c < F.col("code")).alias("codes"))
    found = cut_lineage(dealt.groupBy("label", "dim", "code", "_i", "_j").applyInArrow(
        _compare(least), "a string, b string, links bigint"))
    node = F.lower(F.concat(F.lpad(F.hex("k1"), 16, "0"), F.lpad(F.hex("k2"), 16, "0")))
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = connected(found.where("b is not null").select("a", "b"))
    named = nodes.select(node.alias("node"), "k1", "k2", "times", "low")
    named = named.join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = cut_lineage(named)
    lows = cut_lineage(named.groupBy("root").agg(F.min("low").alias("component")))
    facts = cut_lineage(named.join(lows, "root").select(
        "k1", "k2", "component", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links")))
    alone = F.col("label").isNull() | F.col("packed").isNull()
    out = rows.join(facts, ["k1", "k2"], "left")
    component = F.when(alone, F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias(id_col), F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
                      component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
