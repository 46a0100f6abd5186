"""A Merkle manifest of a dataset whose parents keep the SHA-256 state before every child slot.

Digests are hashed as hex text: 64 bytes, exactly one SHA-256 block. So the
state of a parent's hash after any number of children is eight 32-bit words. A
manifest row is a parent: its children's digests and a copy of the running
state before each child slot. To fold a changed child into its parent, the
state of that slot is resumed with the replacement and the siblings to its
right; the siblings to its left are not read.

Per group (language) the leaves are numbered in order, without a task holding
a group. Aligned chunks of ``FANOUT ** LEVELS`` nodes become subtrees, one task
each, and the chunks' tops are the next round's nodes; a table of n leaves
takes log(n) / log(4096) rounds. Subroots, in group order, form the top tree
the same way. Going back down, every chunk gets the path from its top to the
root, and one more pass folds its leaves through chunk and path.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pozo.llm.frames import cut_lineage, shuffle_tasks

FANOUT, LEVELS = 8, 4

# -- SHA-256 on rows of states ------------------------------------------------
# Fixed values of the hash: the first 32 bits of the fractional parts of the
# cube roots and square roots of the first primes, worked out below.
_PRIMES = [p for p in range(2, 312) if all(p % d for d in range(2, int(p ** 0.5) + 1))]


def _root_bits(n: int, power: int) -> int:
    """First 32 fractional bits of the ``power``-th root of n."""
    shifted, lo, hi = n << (32 * power), 0, n << 32
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if mid ** power <= shifted else (lo, mid - 1)
    return lo & 0xFFFFFFFF


_K = np.array([_root_bits(p, 3) for p in _PRIMES], np.uint32)
START = np.array([_root_bits(p, 2) for p in _PRIMES[:8]], np.uint32)
_HEX = np.array([list(f"{b:02x}".encode()) for b in range(256)], np.uint8)


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def absorb(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """States (n, 8) after one 64-byte block each, given as (n or 1, 16) big-endian words."""
    w = [block[:, i] for i in range(16)]
    a, b, c, d, e, f, g, h = (state[:, i] for i in range(8))
    with np.errstate(over="ignore"):
        for i in range(64):
            if i >= 16:
                s0 = _turn(w[i - 15], 7) ^ _turn(w[i - 15], 18) ^ (w[i - 15] >> np.uint32(3))
                s1 = _turn(w[i - 2], 17) ^ _turn(w[i - 2], 19) ^ (w[i - 2] >> np.uint32(10))
                w.append(w[i - 16] + s0 + w[i - 7] + s1)
            t1 = h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + ((e & f) ^ (~e & g)) + _K[i] + w[i]
            t2 = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) ^ (a & c) ^ (b & c))
            a, b, c, d, e, f, g, h = t1 + t2, a, b, c, d + t1, e, f, g
        return state + np.stack([a, b, c, d, e, f, g, h], axis=1)


def hex_block(digest: np.ndarray) -> np.ndarray:
    """The hex text of digests (n, 32 bytes) as one block each."""
    return _HEX[digest].reshape(len(digest), 64).view(">u4").astype(np.uint32)


def finish(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests (n, 32 bytes) of messages of ``blocks`` whole blocks each."""
    tail = np.zeros((len(state), 16), np.uint32)
    tail[:, 0] = 0x80000000
    bits = np.broadcast_to(np.asarray(blocks, np.int64), len(state)) * 512
    tail[:, 14], tail[:, 15] = bits >> 32, bits & 0xFFFFFFFF
    return absorb(state, tail).astype(">u4").view(np.uint8).reshape(len(state), 32)


def _begin(n: int) -> np.ndarray:
    return np.repeat(START[None], n, axis=0)


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of equally many bytes as a binary column."""
    n, width = rows.shape
    data = np.ascontiguousarray(rows)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(width)),
                                                  pa.py_buffer(data)])


def _bytes(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def levels_of(n):
    """Levels above ``n`` nodes until one is left."""
    k = 0
    while n > 1:
        n, k = -(-n // FANOUT), k + 1
    return k


# -- going up -------------------------------------------------------------------

class Parents:
    """Parents of one level inside a chunk: children (p, FANOUT, 32 bytes), how many, and states (p, FANOUT, 8)."""

    def __init__(self, children: np.ndarray, count: np.ndarray, states: np.ndarray):
        self.children, self.count, self.states = children, count, states

    @classmethod
    def above(cls, digests: np.ndarray) -> tuple["Parents", np.ndarray]:
        """Parents of consecutive nodes, and the parents' digests."""
        n = len(digests)
        p = -(-n // FANOUT)
        children = np.zeros((p * FANOUT, 32), np.uint8)
        children[:n] = digests
        children = children.reshape(p, FANOUT, 32)
        count = np.full(p, FANOUT)
        count[-1] = n - FANOUT * (p - 1)
        state, states = _begin(p), np.zeros((p, FANOUT, 8), np.uint32)
        for s in range(FANOUT):
            states[:, s] = state
            has = count > s
            state[has] = absorb(state[has], hex_block(children[has, s]))
        return cls(children, count, states), finish(state, count)

    def fold(self, at: np.ndarray, digest: np.ndarray) -> np.ndarray:
        """Digests of the parents of nodes ``at`` when each node alone is replaced by ``digest``."""
        p, slot = at // FANOUT, at % FANOUT
        state = absorb(self.states[p, slot], hex_block(digest))
        for right in range(1, FANOUT):
            has = np.flatnonzero(slot + right < self.count[p])
            state[has] = absorb(state[has], hex_block(self.children[p[has], slot[has] + right]))
        return finish(state, self.count[p])

    def siblings(self, at: np.ndarray, state: np.ndarray, blocks: np.ndarray) -> None:
        """Hash the siblings of nodes ``at``, left to right, into running states, in place."""
        p, slot = at // FANOUT, at % FANOUT
        for s in range(FANOUT):
            has = np.flatnonzero((slot != s) & (s < self.count[p]))
            state[has] = absorb(state[has], hex_block(self.children[p[has], s]))
            blocks[has] += 1


_NODE = "g bigint, level int, pos bigint, n bigint, digest binary, children array<binary>, states array<binary>"
_STATES, _CHILDREN = pa.list_(pa.binary()), pa.list_(pa.binary())


def _climb(round_: int, levels: int):
    """Parents of one chunk, all of its levels."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        g, chunk = (k.as_py() for k in key)
        order = np.argsort(table.column("pos").to_numpy())
        n = table.column("n")[0].as_py()
        digests = _bytes(table.column("digest"), 32)[order]
        base, out = chunk * FANOUT ** levels, []
        for k in range(min(levels, levels_of(n))):
            parents, digests = Parents.above(digests)
            base, n = base // FANOUT, -(-n // FANOUT)
            p = len(digests)
            ends = np.concatenate([[0], np.cumsum(parents.count)]).astype(np.int32)
            have = (np.arange(FANOUT) < parents.count[:, None]).ravel()
            child = _binary(parents.children.reshape(-1, 32)[have])
            state = _binary(parents.states.reshape(-1, 8)[have].astype(">u4").view(np.uint8).reshape(-1, 32))
            out.append(pa.table([
                pa.array([g] * p, pa.int64()), pa.array([round_ * levels + k + 1] * p, pa.int32()),
                pa.array(base + np.arange(p), pa.int64()), pa.array([n] * p, pa.int64()), _binary(digests),
                pa.ListArray.from_arrays(ends, child), pa.ListArray.from_arrays(ends, state)],
                names=["g", "level", "pos", "n", "digest", "children", "states"]))
        if not out:     # a lone node has no parent
            none = pa.array([], pa.int64())
            out = [pa.table([none, pa.array([], pa.int32()), none, none, pa.array([], pa.binary()),
                             pa.array([], _CHILDREN), pa.array([], _STATES)],
                            names=["g", "level", "pos", "n", "digest", "children", "states"])]
        return pa.concat_tables(out)
    return run


def _chunk(levels: int) -> Column:
    return F.call_function("div", F.col("pos"), F.lit(FANOUT ** levels)).alias("chunk")


def build(nodes: DataFrame, levels: int = LEVELS) -> list[tuple[DataFrame, DataFrame]]:
    """Trees over nodes (g, pos from 0 without gaps, n of the group, digest binary).

    Returns per round its nodes and the manifest rows made of them; a manifest
    row is a parent (g, level, pos, n of its level, digest, children, states). A
    group of one node has no parent.
    """
    rounds = []
    while True:
        k = len(rounds)
        grown = nodes.where("n > 1")
        if grown.isEmpty():
            return rounds
        made = cut_lineage(grown.select("g", "pos", "n", "digest", _chunk(levels))
                           .groupBy("g", "chunk").applyInArrow(_climb(k, levels), _NODE))
        rounds.append((grown, made))
        # A chunk's top is its only node ``levels`` levels up; smaller groups are done.
        nodes = made.where(F.col("level") == (k + 1) * levels).select("g", "pos", "n", "digest")


def roots(nodes: DataFrame, rounds: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(g, digest): the last node of every group."""
    out = nodes.where("n = 1").select("g", "digest")
    for _, made in rounds:
        out = out.unionByName(made.where("n = 1").select("g", "digest"))
    return out


# -- going down -------------------------------------------------------------------

_STEP = pa.struct([("slot", pa.int32()), ("state", pa.binary()), ("children", _CHILDREN)])
_PATH = "path array<struct<slot: int, state: binary, children: array<binary>>>"


def _parents_of(made: pa.Table) -> list[Parents]:
    """The levels of one chunk from its manifest rows."""
    out = []
    level = made.column("level").to_numpy()
    for k in sorted(set(level.tolist())):
        rows = made.filter(pa.array(level == k))
        rows = rows.take(np.argsort(rows.column("pos").to_numpy()))
        lists = rows.column("children").combine_chunks()
        count = np.diff(lists.offsets.to_numpy())
        p = len(count)
        have = (np.arange(FANOUT) < count[:, None]).ravel()
        children, states = np.zeros((p * FANOUT, 32), np.uint8), np.zeros((p * FANOUT, 8), np.uint32)
        children[have] = _bytes(lists.values, 32)
        states[have] = _bytes(rows.column("states").combine_chunks().values, 32).view(">u4")
        out.append(Parents(children.reshape(p, FANOUT, 32), count, states.reshape(p, FANOUT, 8)))
    return out


def _split(above: pa.Table) -> tuple[list[Parents], list[dict]]:
    """A chunk's own parents and the path from its top to the root."""
    made = above.filter(above.column("path").is_null())
    path = above.filter(above.column("path").is_valid())
    return _parents_of(made), path.column("path")[0].as_py() if path.num_rows else []


def _descend(levels: int):
    """The path of every node of a chunk: its own steps, then those of the chunk's top."""
    def run(key: tuple, nodes: pa.Table, above: pa.Table) -> pa.Table:
        parents, path = _split(above)
        out = []
        for pos in nodes.column("pos").to_pylist():
            steps, at = [], pos - key[1].as_py() * FANOUT ** levels
            for level in parents:
                p, slot = divmod(at, FANOUT)
                steps.append({"slot": slot, "state": level.states[p, slot].astype(">u4").tobytes(),
                              "children": [c.tobytes() for c in level.children[p, :level.count[p]]]})
                at = p
            out.append(steps + path)
        return pa.table([nodes.column("g"), nodes.column("pos"), pa.array(out, pa.list_(_STEP))], names=["g", "pos", "path"])
    return run


def _prove(levels: int):
    """Root digests with each leaf replaced, and the hash of its siblings up to the root."""
    def run(key: tuple, nodes: pa.Table, above: pa.Table) -> pa.Table:
        parents, path = _split(above)
        at = nodes.column("pos").to_numpy() - key[1].as_py() * FANOUT ** levels
        digest = _bytes(nodes.column("replacement"), 32)
        proof, blocks = _begin(len(at)), np.zeros(len(at), np.int64)
        for level in parents:
            digest = level.fold(at, digest)
            level.siblings(at, proof, blocks)
            at = at // FANOUT
        for step in path:       # one way for the whole chunk
            slot, children = step["slot"], [hex_block(np.frombuffer(c, np.uint8)[None]) for c in step["children"]]
            kept = np.frombuffer(step["state"], ">u4").astype(np.uint32)[None]
            state = absorb(np.repeat(kept, len(at), axis=0), hex_block(digest))
            for c in children[slot + 1:]:
                state = absorb(state, c)
            digest = finish(state, len(children))
            for c in children[:slot] + children[slot + 1:]:
                proof = absorb(proof, c)
            blocks += len(children) - 1
        return pa.table([nodes.column("row"), _binary(finish(proof, blocks)), _binary(digest)], names=["row", "proof", "folded"])
    return run


def _above(made: DataFrame, paths: DataFrame, round_: int, levels: int) -> DataFrame:
    """Manifest rows and the top's path (if any), keyed by the chunk they belong to."""
    width = F.pow(F.lit(FANOUT), F.lit((round_ + 1) * levels) - F.col("level")).cast("long")
    empty = F.lit(None).cast(_PATH.split(" ", 1)[1])
    rows = made.select("g", F.call_function("div", F.col("pos"), width).alias("chunk"), "level", "pos", "children", "states",
                       empty.alias("path"))
    nothing = F.lit(None).cast("array<binary>")
    return rows.unionByName(paths.select("g", F.col("pos").alias("chunk"), F.lit(0).alias("level"), "pos",
                                         nothing.alias("children"), nothing.alias("states"), "path"))


def paths(rounds: list[tuple[DataFrame, DataFrame]], top: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """Per round (g, pos of a chunk, path from that chunk's top to the root), the
    last entry for the groups' roots: ``top`` (g, pos 0, path beyond the root)."""
    out = [top]
    for k in reversed(range(1, len(rounds))):
        nodes, made = rounds[k]
        got = (nodes.select("g", "pos", _chunk(levels)).groupBy("g", "chunk")
               .cogroup(_above(made, out[0], k, levels).groupBy("g", "chunk")).applyInArrow(_descend(levels), f"g bigint, pos bigint, {_PATH}"))
        # Groups whose tree ended in an earlier round keep the path beyond their root.
        lone = out[0].join(nodes.select("g").distinct(), "g", "left_anti")
        out.insert(0, cut_lineage(got.unionByName(lone)))
    return out


def prove(leaves: DataFrame, rounds: list[tuple[DataFrame, DataFrame]], top: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(row, proof, folded): of every leaf (row, g, pos, replacement) the hash of its
    siblings up to the root and the root with ``replacement`` in its place."""
    below = paths(rounds, top, levels)[0]
    cast = F.lit(None).cast("array<binary>")
    made = _above(rounds[0][1], below, 0, levels) if rounds else below.select(
        "g", F.col("pos").alias("chunk"), F.lit(0).alias("level"), "pos", cast.alias("children"), cast.alias("states"), "path")
    # Leaves without a chunk of their own tree (groups of one) meet their path alone.
    return (leaves.select("row", "g", "pos", "replacement", _chunk(levels)).groupBy("g", "chunk")
            .cogroup(made.groupBy("g", "chunk")).applyInArrow(_prove(levels), "row bigint, proof binary, folded binary"))


# -- numbering ----------------------------------------------------------------------

def _numbered(df: DataFrame, group: str | None, order: list[str]) -> DataFrame:
    """``df`` with pos (from 0 in ``order`` within the group), n (rows of the group) and row (a key).

    Rows are range-partitioned on group and order, so a group spans many tasks,
    sorted there and checkpointed; a row's place is its place in the partition
    plus the rows of its group in earlier partitions, a table of at most one row
    per partition and group.
    """
    cols = ([group] if group else []) + order
    # Fully equal rows are interchangeable, so any tie-break may part them.
    tied = df.withColumn("_tie", F.xxhash64(F.monotonically_increasing_id()))
    ranged = cut_lineage(tied.repartitionByRange(shuffle_tasks(df.sparkSession), *cols, "_tie")
                         .sortWithinPartitions(*cols, "_tie").drop("_tie")
                         .withColumn("row", F.monotonically_increasing_id()))
    part = F.shiftright("row", 33)
    keys = [group] if group else []
    seg = ranged.groupBy(part.alias("_p"), *keys).agg(F.min("row").alias("_first"), F.count("*").alias("_n"))
    over = Window.partitionBy(*keys)
    seg = seg.select("_p", *[F.col(k).alias("_g") for k in keys], "_first",
                     F.coalesce(F.sum("_n").over(over.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)),
                                F.lit(0)).alias("_start"), F.sum("_n").over(over).alias("n"))
    on = [part == F.col("_p")] + [F.col(k).eqNullSafe(F.col("_g")) for k in keys]
    return (ranged.join(seg, on).withColumn("pos", F.col("_start") + F.col("row") - F.col("_first"))
            .drop("_p", "_first", "_start", *(["_g"] if keys else [])))


# -- documents ------------------------------------------------------------------------

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _part(c: Column) -> Column:
    value = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 (binary) of the fields, each "-" if null, else its UTF-8 bytes' number, ":" and the value."""
    return F.unhex(F.sha2(F.concat(*[_part(c) for c in fields]).cast("binary"), 256))


class Manifest:
    """The trees over a table: ``leaves`` (every row's place), ``rounds`` of nodes and
    parents per language, ``top`` of both over the subroots.

    ``table()`` is the manifest: a row per parent. ``verify()`` folds ``replacement``, or
    the leaf itself where that is null, into every leaf's place.
    """

    def __init__(self, docs: DataFrame, replacement: Column | None = None, id_col: str = "doc_id",
                 fields: tuple[str, ...] = FIELDS, group_col: str = "lang", levels: int = LEVELS):
        self.levels = levels
        leaf = leaf_digest([F.col(c) for c in fields])
        other = F.lit(None).cast("binary") if replacement is None else replacement
        # Written once, so texts are read and hashed in one pass: numbering samples its rows, then deals them.
        slim = cut_lineage(docs.select(F.col(id_col).alias("id"), F.col(group_col).alias("lang"), leaf.alias("digest"),
                                       other.alias("replacement"))).withColumn("replacement", F.coalesce("replacement", "digest"))
        # Equal ids of one language are ordered by their digests.
        numbered = _numbered(slim, "lang", ["id", "digest"])
        langs = _numbered(numbered.select("lang").distinct(), None, ["lang"]).select(
            F.col("lang").alias("_l"), F.col("pos").alias("g"))
        self.leaves = cut_lineage(numbered.join(langs, F.col("lang").eqNullSafe(F.col("_l"))).drop("_l"))
        self.rounds = build(self.leaves, levels)
        subroots = roots(self.leaves, self.rounds)
        groups = subroots.count()
        # All languages are one group above: number g of a language is its place there.
        self.subroots = cut_lineage(subroots.select(
            F.lit(0).cast("long").alias("g"), F.col("g").alias("pos"), F.lit(groups).cast("long").alias("n"), "digest"))
        self.top_rounds = build(self.subroots, levels)
        self.root = roots(self.subroots, self.top_rounds).select("digest")

    def table(self) -> DataFrame:
        """(tree, g, level, pos, n, digest, children, states): every parent of both kinds of tree."""
        out = self.leaves.sparkSession.createDataFrame([], f"tree string, {_NODE}")
        for tree, rounds in (("lang", self.rounds), ("top", self.top_rounds)):
            for _, made in rounds:
                out = out.unionByName(made.select(F.lit(tree).alias("tree"), "*"))
        return out

    def verify(self) -> DataFrame:
        """(id, lang, leaf, subroot, root, proof_sha256, folded_root), digests as hex, by row of the table."""
        none = F.array().cast(_PATH.split(" ", 1)[1])
        levels = self.levels
        beyond = self.subroots.select("g", "pos", _chunk(levels))
        start = self.leaves.sparkSession.range(1).select(F.col("id").alias("g"), F.col("id").alias("pos"), none.alias("path"))
        if self.top_rounds:
            below = paths(self.top_rounds, start, levels)[0]
            made = _above(self.top_rounds[0][1], below, 0, levels)
            up = beyond.groupBy("g", "chunk").cogroup(made.groupBy("g", "chunk")).applyInArrow(
                _descend(levels), f"g bigint, pos bigint, {_PATH}")
        else:
            up = beyond.select("g", "pos", none.alias("path"))
        top = cut_lineage(up.select(F.col("pos").alias("g"), F.lit(0).cast("long").alias("pos"), "path"))
        got = prove(self.leaves, self.rounds, top, levels)
        hexa = lambda c: F.lower(F.hex(c))
        subroots = self.subroots.select(F.col("pos").alias("g"), hexa("digest").alias("subroot"))
        return (self.leaves.join(got, "row").join(subroots, "g")
                .select("id", "lang", hexa("digest").alias("leaf"), "subroot",
                        self.root.select(hexa("digest")).scalar().alias("root"),
                        hexa("proof").alias("proof_sha256"), hexa("folded").alias("folded_root")))


def verify_tampered(docs: DataFrame, every: int = 3, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    Rows whose id's CRC-32 ``every`` divides are tampered with: A-Z of the text
    become lower case. ``folded_root`` is the root with the row's leaf recomputed
    so (else the original leaf) and the original siblings; ``verified`` whether it
    is the true root, which also holds for a tampered text without A-Z.

    A null field counts as "-"; a null id comes first and is never tampered with;
    a null language is the first tree. Equal ids of one language are ordered by
    leaf digest, fully equal rows are neighbours with equal leaves. A lone leaf is
    its subroot, a lone subroot the root; without siblings the proof is the hash
    of nothing. An empty table gives an empty result; other columns are not read.
    """
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    chosen = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0, F.lit(False))
    changed = F.when(chosen, leaf_digest([lower if c == "text" else F.col(c) for c in FIELDS]))
    out = Manifest(docs, changed, levels=levels).verify()
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root",
                      (F.col("folded_root") == F.col("root")).alias("verified"))
