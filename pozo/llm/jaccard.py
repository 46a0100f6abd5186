"""Exact Jaccard join of word-shingle sets, by metric-space regions.

Jaccard distance is a metric, but unrelated texts are all at distance 1 of each
other, where pivots alone cannot part them. So regions are formed in two steps.

1. Meeting places. The hash range is cut into more parts than two linked sets
   can differ in elements. Each part gives a pseudo-metric (elements of the
   symmetric difference that fall into it); these add up to the whole
   difference, so linked sets are at distance 0 in some part: they have the
   same content there. Sets meet where a part's content is equal. (Small sets
   meet on their rarest elements instead: linked sets share one of those.) Of the sets that
   meet, sizes and parity sketches part most that are not linked; neither ever
   exceeds the true difference. What is left, directly or through others,
   forms a region; no link leaves it.
2. In a region, pivots create Voronoi cells. A set goes to its nearest pivot's
   cell, and by the triangle inequality also to every cell whose pivot is no
   farther than that distance plus twice the link distance. Regions too large
   for one task are divided so in Spark rounds (:mod:`pozo.llm.regions`), the
   others in their task. Cells are joined the same way again, until they are
   small or stop shrinking; then pairs are bounded by size and by parity sketches
   (both never exceed the true difference) and the rest compared exactly.

Sets already connected need no comparison, so a group of near copies costs
about one pivot, not all its pairs. Sets are stored once for all equal texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pozo.llm.frames import connected, cut_lineage, row_key, shuffle_tasks
from pozo.llm.regions import divide, names, node_name
from pozo.llm.textgrams import BLANKS, Words, gram_hashes, mix, pieces

SMALL = 30            # sets up to this size meet on their rarest elements
GROWTH = 1.25         # width of a size class
BLOCK = 3000          # sets of a region or cell in one block; a task compares two
BLOCK_BYTES = 64 << 20    # elements of a region in one block, on average
GATHER = 1 << 20      # elements compared with a pivot at a time, besides one set
LONG = 200_000        # rows of one meeting place held together
SEEN = 50_000         # set keys a worker remembers, so that copies meet once per task
_U = np.uint64


class Rule:
    """Linked: 100 * intersection >= percent * union."""

    def __init__(self, percent: int):
        if not 50 <= percent <= 100:
            raise ValueError("percent must be 50 to 100")
        self.percent = percent

    def linked(self, inter, total):
        return 100 * inter >= self.percent * (total - inter)

    def least(self, n: int) -> int:
        """Smallest size that can be linked with size n."""
        return -(-self.percent * n // 100)

    def most(self, n: int) -> int:
        return 100 * n // self.percent

    def apart(self, total):
        """Most elements two linked sets of ``total`` elements together can differ in."""
        return (100 - self.percent) * total // (100 + self.percent)

    @property
    def distance(self) -> float:
        return 1 - self.percent / 100


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts in a row, and offsets (n + 1).

    Texts of fewer than k words have their whole sequence as one shingle.
    """
    words = Words(texts, BLANKS, lower=True)
    counts = words.counts()
    starts, per_text = words.gram_starts(k)
    h = words.hashes()
    g = gram_hashes(h, k)[starts] if len(starts) else np.empty(0, _U)
    text = np.repeat(np.arange(len(per_text)), per_text)
    for n in range(1, k):
        short = np.flatnonzero(counts == n)
        if len(short):
            g = np.r_[g, gram_hashes(h, n, seed=n)[words.first[:-1][short]]]
            text = np.r_[text, short]
    order = np.lexsort((g, text))
    g, text = g[order], text[order]
    new = np.r_[True, (g[1:] != g[:-1]) | (text[1:] != text[:-1])] if len(g) else np.empty(0, bool)
    g, text = g[new], text[new]
    return g, np.searchsorted(text, np.arange(len(counts) + 1))


def _set_keys(g: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit key of every set (its size mixed in); 0, 0 for the empty set."""
    size = np.diff(offs)
    out = []
    with np.errstate(over="ignore"):
        for salt in (0x8CB92BA72F3D8DD7, 0xD6E8FEB86659FD93):
            run = np.r_[_U(0), np.cumsum(mix(g ^ _U(salt)))]
            key = mix((run[offs[1:]] - run[offs[:-1]]) + size.astype(_U) * _U(0x9E3779B97F4A7C15))
            out.append(np.where(size > 0, key, _U(0)).view(np.int64))
    return out[0], out[1]


def size_classes(rule: Rule, top: int) -> list[tuple[int, int, int]]:
    """(smallest size, parts, spare parts) of the classes above ``SMALL`` that reach ``top``."""
    out, low = [], SMALL + 1
    while low <= top:
        high = max(low, int(low * GROWTH))
        need = int(rule.apart(2 * high)) + 1
        spare = math.ceil(0.01 * need + 6 * math.sqrt(0.01 * need))
        out.append((low, need + spare, spare))
        low = high + 1
    return out


def meeting_places(g: np.ndarray, offs: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """(place, set) for every place each set above ``SMALL`` goes to."""
    size = np.diff(offs)
    places, owner = [], []
    with np.errstate(over="ignore"):
        top = int(size.max(initial=0))
        for low, parts, spare in size_classes(rule, rule.most(top)):
            high = max(low, int(low * GROWTH))
            # Larger sets of this class, and smaller ones that reach up into it.
            mine = np.flatnonzero((size >= max(SMALL + 1, rule.least(low))) & (size <= high))
            if not len(mine):
                continue
            n = size[mine]
            begin = np.cumsum(n) - n
            at = np.repeat(offs[mine] - begin, n) + np.arange(n.sum())
            e = g[at]
            part = ((e >> _U(32)) * _U(parts)) >> _U(32)           # grows with e: sorted within a set
            who = np.repeat(np.arange(len(mine)), n)
            edge = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (who[1:] != who[:-1])])
            content = np.add.reduceat(mix(e + _U(0x632BE59BD9B4E019)), edge)
            salt = _U(low) * _U(0xC2B2AE3D27D4EB4F)
            places.append(mix(content ^ mix(part[edge] + salt)))
            owner.append(mine[who[edge]])
            # A pair may agree on empty parts only where both have more of them than are spare.
            filled = np.bincount(who[edge], minlength=len(mine))
            for i in np.flatnonzero(parts - filled > spare).tolist():
                empty = np.setdiff1d(np.arange(parts, dtype=_U), part[edge][who[edge] == i])
                places.append(mix(mix(empty + salt) ^ _U(0x1B873593CC9E2D51)))
                owner.append(np.full(len(empty), mine[i]))
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(places).view(np.int64), np.concatenate(owner)


def _describe(k: int, rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                g, offs = shingle_sets(part.column("text"), k)
                s1, s2 = _set_keys(g, offs)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), part.column("_k1"), part.column("_k2"), pa.array(np.diff(offs), pa.int64()),
                     pa.array(s1), pa.array(s2),
                     pa.array([sketch(g[a:b], sketch_bits(b - a)).tobytes() if b > a else None
                               for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())], pa.binary()),
                     pa.array([g[a:b].tobytes() if a < b <= a + rule.most(SMALL) else None
                               for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())], pa.binary())],
                    names=["_id", "_k1", "_k2", "n", "s1", "s2", "sketch", "few"])
    return run


def _meet(k: int, rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            for part in pieces(batch, "text"):
                g, offs = shingle_sets(part.column("text"), k)
                s1, s2 = _set_keys(g, offs)
                # Copies of a set this task has already sent go to the same places.
                fresh = np.zeros(len(s1), bool)
                for i, key in enumerate(zip(s1.tolist(), s2.tolist())):
                    if key not in seen:
                        seen.add(key)
                        fresh[i] = True
                if len(seen) > SEEN:
                    seen.clear()
                keep = np.repeat(fresh, np.diff(offs))
                size = np.where(fresh, np.diff(offs), 0)
                place, who = meeting_places(g[keep], np.r_[0, np.cumsum(size)], rule)
                if len(place):
                    yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(s1[who])], names=["place", "s1"])
    return run


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            g = [np.frombuffer(x, np.int64) for x in part.column("few").to_pylist()]
            of = np.repeat(np.arange(len(g)), [len(x) for x in g])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(g)), *[part.column(c).take(pa.array(of)) for c in ("s1", "s2", "n")]],
                names=["element", "s1", "s2", "n"])


def small_places(slim: DataFrame, rule: Rule) -> DataFrame:
    """(place, s1) for sets up to ``rule.most(SMALL)`` elements: their rarest ones.

    Of two linked sets, of n elements and more, the first n - least(n) + 1 in
    any one order have an element in common. Ordered by the number of sets that
    have it, a line many texts quote is hardly ever among those.
    """
    few = slim.where("few is not null").groupBy("s1", "s2").agg(F.max(F.struct("n", "few")).alias("x")).select("s1", "s2", "x.n", "x.few")
    held = cut_lineage(few.mapInArrow(_elements, "element bigint, s1 bigint, s2 bigint, n bigint"))
    # Both sides are read from checkpoints, so Spark splits an element that very many sets have.
    often = cut_lineage(held.groupBy("element").agg(F.count("*").alias("f")).where("f > 1"))
    held = held.join(often, "element", "left").withColumn("f", F.coalesce("f", F.lit(1)))
    ranked = (held.groupBy("s1", "s2", "n")
              .agg(F.array_sort(F.collect_list(F.struct("f", "element"))).alias("e")))
    first = F.col("n") - F.ceil(rule.percent * F.col("n") / 100) + 1
    return (ranked.select("s1", F.explode(F.slice("e", F.lit(1), first.cast("int"))).alias("e")).where("e.f > 1")
            .select(F.xxhash64(F.lit(0x2545F491), "e.element").alias("place"), "s1"))


def deal(rows: DataFrame, by: str, members: list[str], block: int) -> DataFrame:
    """``rows`` with the pairs of blocks (``_i``, ``_j``) of their group that they go to.

    A group of more than ``block`` rows has several blocks, and every two rows of a
    group meet under some pair. The groups' sizes are read from a checkpoint.
    """
    large = cut_lineage(rows.groupBy(by).agg(F.ceil(F.count("*") / block).cast("int").alias("_n")).where("_n > 1"))
    rows_ = rows.join(large, by, "left").withColumn("_n", F.coalesce("_n", F.lit(1)))
    rows_ = rows_.withColumn("_b", F.pmod(F.xxhash64(*members), F.col("_n")).cast("int"))
    dealt = rows_.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return dealt.select(*rows.columns, F.least("_b", "_o").alias("_i"), F.greatest("_b", "_o").alias("_j"))


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (place, s1): the sets of every place where at least two meet.

    A cell is named by its members, so that the many places where the same sets
    meet are one cell. Of a place with over ``LONG`` rows the name is the place.
    """
    held: list[np.ndarray] = []
    place = None
    long = False
    seen: set = set()

    def close() -> list[tuple[int, np.ndarray]]:
        members = np.unique(np.concatenate(held)) if held else np.empty(0, np.int64)
        if long:
            return [(int(place), members)] if len(members) else []
        if len(members) < 2:
            return []
        with np.errstate(over="ignore"):
            name = int(mix(mix(members.view(_U)).sum(keepdims=True) + _U(len(members))).view(np.int64)[0])
        if name in seen:
            return []
        seen.add(name)
        if len(seen) > SEEN:
            seen.clear()
        return [(name, members)]

    def rows(found: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([np.full(len(m), c, np.int64) for c, m in found])),
             pa.array(np.concatenate([m for _, m in found]))], names=["cell", "s1"])

    for batch in batches:
        p, s = np.asarray(batch.column("place")), np.asarray(batch.column("s1"))
        found = []
        if not len(p):
            continue
        begin = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        end = np.r_[begin[1:], len(p)]
        # Places of one row inside the batch hold one set: nothing meets there.
        some = (end - begin > 1) | (begin == 0) | (end == len(p))
        for a, b in zip(begin[some].tolist(), end[some].tolist()):
            if p[a] != place:
                found += close()
                held, place, long = [], p[a], False
            held.append(s[a:b])
            if sum(map(len, held)) > LONG:
                found.append((int(place), np.unique(np.concatenate(held))))
                held, long = [], True
        if found:
            yield rows(found)
    found = close()
    if found:
        yield rows(found)


def sketch(g: np.ndarray, bits: int) -> np.ndarray:
    """Parities of a set's elements over ``bits`` hash classes. The differing bits of two
    sketches never exceed the sets' symmetric difference; halves add up to a shorter one."""
    return np.packbits((np.bincount((g & _U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little")


def sketch_bits(n: int) -> int:
    return 1 << min(13, max(6, int(n).bit_length()))


def _fold(s: np.ndarray, size: int) -> np.ndarray:
    while len(s) > size:
        s = s[:len(s) // 2] ^ s[len(s) // 2:]
    return s


def _near(sizes: np.ndarray, sketches: list[np.ndarray], rule: Rule) -> list[tuple[int, int]]:
    """A forest of the pairs of a cell that sizes and sketches allow to be linked."""
    order = np.argsort(sizes, kind="stable")
    sizes = sizes[order]
    root = np.arange(len(order))
    edges = []
    widths = np.array([len(sketches[i]) for i in order])
    folded: dict[int, np.ndarray] = {}
    for i in range(len(order) - 1):
        to = int(np.searchsorted(sizes, rule.most(int(sizes[i])), side="right"))
        w = int(widths[i])
        at = np.arange(i + 1, to)
        at = at[root[at] != root[i]]
        if not len(at):
            continue
        if w not in folded:
            # sets from here on are at least as large, so their sketches are as wide
            folded[w] = np.zeros((len(order), w // 8), _U)
            for j in np.flatnonzero(widths >= w).tolist():
                folded[w][j] = _fold(sketches[order[j]], w).view(_U)
        gap = np.bitwise_count(folded[w][at] ^ folded[w][i]).sum(axis=1)
        for j in at[gap <= rule.apart(sizes[i] + sizes[at])].tolist():
            if root[i] != root[j]:
                root[root == root[j]] = root[i]
                edges.append((int(order[i]), int(order[j])))
    return edges


def _candidates(rule: Rule):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by cell and blocks, with sketches: pairs that may be linked."""
        held: list[tuple] = []
        cell = None

        def close() -> tuple[list[int], list[int]]:
            if len(held) < 2:
                return [], []
            pairs = _near(np.array([h[1] for h in held]), [np.frombuffer(h[2], np.uint8) for h in held], rule)
            return [held[a][0] for a, _ in pairs], [held[b][0] for _, b in pairs]

        for batch in batches:
            out_a, out_b = [], []
            for *c, s, n, bits in zip(*(batch.column(x).to_pylist() for x in ("cell", "_i", "_j", "s1", "n", "sketch"))):
                if c != cell:
                    a, b = close()
                    out_a += a
                    out_b += b
                    held, cell = [], c
                held.append((s, n, bits))
            if out_a:
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])
        a, b = close()
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
    return run


def _store(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                g, offs = shingle_sets(part.column("text"), k)
                yield pa.RecordBatch.from_arrays(
                    [part.column("s1"), part.column("s2"), part.column("region"),
                     pa.array([g[a:b].tobytes() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())], pa.binary())],
                    names=["s1", "s2", "region", "elements"])
    return run


class Region:
    """Exact links among sets, as a forest: enough edges to connect what is linked."""

    def __init__(self, sets: list[np.ndarray], rule: Rule, known: list[str] | None = None):
        """``known`` names what each set is connected to already: equal names need no comparison."""
        self.sets, self.rule = sets, rule
        self.size = np.array([len(s) for s in sets])
        self.root = np.arange(len(sets)) if known is None else np.unique(known, return_inverse=True)[1].astype(np.int64)
        self.edges: list[tuple[int, int]] = []
        self._sketch = None

    def _link(self, a: int, b: int) -> None:
        ra, rb = self.root[a], self.root[b]
        if ra != rb:
            self.root[self.root == rb] = ra
            self.edges.append((a, b))

    def shared(self, p: int, others: np.ndarray) -> np.ndarray:
        """Intersection size of set p with each of ``others``."""
        pivot = self.sets[p]
        piece = np.cumsum(self.size[others]) // GATHER
        found = []
        for some in np.split(others, np.flatnonzero(piece[1:] != piece[:-1]) + 1):
            flat = np.concatenate([self.sets[i] for i in some])
            at = np.searchsorted(pivot, flat)
            at[at == len(pivot)] = 0
            ends = np.cumsum(self.size[some])
            run = np.r_[0, np.cumsum(pivot[at] == flat)]
            found.append(run[ends] - run[ends - self.size[some]])
        return np.concatenate(found)

    def _compare(self, p: int, others: np.ndarray) -> np.ndarray:
        """Link p with those of ``others`` that it must link with; their distances."""
        inter = self.shared(p, others)
        total = self.size[p] + self.size[others]
        for o in others[self.rule.linked(inter, total)].tolist():
            if o != p:
                self._link(p, o)
        return 1 - inter / (total - inter)

    def sketches(self) -> np.ndarray:
        if self._sketch is None:
            bits = 1 << min(12, max(9, int(4 * self.size.mean()).bit_length()))
            out = np.zeros((len(self.sets), bits), np.uint8)
            for i, s in enumerate(self.sets):
                out[i] = np.bincount((s & _U(bits - 1)).astype(np.int64), minlength=bits) & 1
            self._sketch = np.packbits(out, axis=1).view(_U)
        return self._sketch

    def join(self, limit: int = 3, pivots: int = 6) -> list[tuple[int, int]]:
        todo = [np.arange(len(self.sets))]
        while todo:
            cell = todo.pop()
            if len(cell) < 2 or (self.root[cell] == self.root[cell[0]]).all():
                continue
            if len(cell) <= limit:
                self._pairs(cell)
                continue
            picks, rows = [int(cell[0])], []
            while True:
                rows.append(self._compare(picks[-1], cell))
                if (self.root[cell] == self.root[cell[0]]).all():
                    break
                near = np.min(rows, axis=0)
                far = int(np.argmax(near))
                if len(rows) == pivots or near[far] <= 0:
                    break
                picks.append(int(cell[far]))
            if (self.root[cell] == self.root[cell[0]]).all():
                continue
            near = np.min(rows, axis=0)
            cells = [cell[d <= near + 2 * self.rule.distance + 1e-9] for d in rows]
            if len(cells) < 2 or sum(len(c) ** 2 for c in cells) > 0.7 * len(cell) ** 2:
                self._pairs(cell)
            else:
                todo.extend(cells)
        return self.edges

    def _pairs(self, cell: np.ndarray) -> None:
        """All pairs of a cell that sizes and sketches leave, skipping what is connected."""
        cell = cell[np.argsort(self.size[cell], kind="stable")]
        size = self.size[cell]
        sketch = self.sketches() if len(cell) > 4 else None
        for i in range(len(cell) - 1):
            to = int(np.searchsorted(size, self.rule.most(int(size[i])), side="right"))
            others = cell[i + 1:to]
            at = np.arange(i + 1, to)
            open_ = self.root[others] != self.root[cell[i]]
            others, at = others[open_], at[open_]
            if sketch is not None and len(others):
                gap = np.bitwise_count(sketch[others] ^ sketch[cell[i]]).sum(axis=1)
                others = others[gap <= self.rule.apart(size[i] + size[at])]
            if len(others):
                self._compare(int(cell[i]), others)


def _join_region(rule: Rule):
    def run(table: pa.Table) -> pa.Table:
        s1, s2, known = (table.column(c).to_pylist() for c in ("s1", "s2", "root"))
        order = sorted(range(len(s1)), key=lambda i: (s1[i], s2[i]))
        elements = table.column("elements")
        own = names(s1, s2)
        edges = Region([np.frombuffer(elements[i].as_buffer(), _U) for i in order], rule,
                       [known[i] or own[i] for i in order]).join()
        return pa.table({"a": pa.array([own[order[a]] for a, _ in edges], pa.string()),
                         "b": pa.array([own[order[b]] for _, b in edges], pa.string())})
    return run


def classes(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
            block: int = BLOCK) -> DataFrame:
    """(id, n_shingles, component_id, _k1, _k2) for every row of ``docs``.

    A row's set are the distinct k-word shingles of its text (A-Z lower-cased,
    words split at ASCII white space; fewer than k words are one shingle). Rows
    link when their sets' Jaccard similarity is at least ``percent`` / 100;
    ``component_id`` is the smallest id reachable over links. Exact: no link is
    lost and none added, up to equal 64-bit hashes of different shingles. (Sets that
    share a 64-bit key of the two they have are only looked at together.)

    Null texts and texts without words have no shingles and link with nothing;
    equal texts link whatever their number; null ids are not smaller than
    others (a class of null ids has null); repeated ids are separate rows;
    other columns are ignored; an empty table gives an empty result.

    Equal sets are one node from the start, and a worker sends a set's copies to
    the meeting places once. A cell of more than ``block`` sets is dealt to several
    tasks, each with the sketches of two blocks of it, so that all pairs still meet;
    a region of more than ``block`` sets or ``BLOCK_BYTES`` of them is divided by pivots.
    """
    rule = Rule(percent)
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    base = base.select("_id", *row_key("_id", "text"), "text")
    kind = docs.schema[id_col].dataType.simpleString()
    slim = cut_lineage(base.mapInArrow(
        _describe(k, rule), f"_id {kind}, _k1 bigint, _k2 bigint, n bigint, s1 bigint, s2 bigint, sketch binary, few binary"))
    met = base.where("text is not null").select("text").mapInArrow(_meet(k, rule), "place bigint, s1 bigint")
    met = met.unionByName(small_places(slim, rule))
    cells = cut_lineage(met.repartition(shuffle_tasks(spark), "place").sortWithinPartitions("place", "s1")
                        .mapInArrow(_cells, "cell bigint, s1 bigint").distinct())
    # Sets that meet by chance (a passage many texts quote) are parted by their sketches.
    bits = cut_lineage(slim.where("n > 0").groupBy("s1", "s2").agg(F.max(F.struct("n", "sketch")).alias("x"))
                       .select("s1", "x.n", "x.sketch"))
    near = (deal(cells, "cell", ["s1"], block).join(bits, "s1").select("cell", "_i", "_j", "s1", "n", "sketch")
            .repartition(shuffle_tasks(spark), "cell", "_i", "_j").sortWithinPartitions("cell", "_i", "_j")
            .mapInArrow(_candidates(rule), "a bigint, b bigint"))
    regions = connected(near.distinct()).select(F.col("node").alias("s1"), F.col("root").alias("region"))
    # One text per set of a region.
    one = slim.where("n > 0").groupBy("s1", "s2").agg(F.min(F.struct("_k1", "_k2")).alias("_k")).join(regions, "s1")
    one = one.select(F.col("_k._k1").alias("_k1"), F.col("_k._k2").alias("_k2"), "s1", "s2", "region")
    texts = base.select("_k1", "_k2", "text").where("text is not null")
    sets = cut_lineage(texts.join(one, ["_k1", "_k2"]).select("s1", "s2", "region", "text")
                       .mapInArrow(_store(k), "s1 bigint, s2 bigint, region bigint, elements binary"))
    groups, links = divide(sets, rule, block, BLOCK_BYTES)
    edges = groups.groupBy("cell", "_i", "_j").applyInArrow(_join_region(rule), "a string, b string")
    roots = connected(edges if links is None else edges.unionByName(links))
    nodes = slim.where("n > 0").groupBy("s1", "s2").agg(F.min("_id").alias("low")).select(node_name().alias("node"), "s1", "s2", "low")
    nodes = cut_lineage(nodes.join(roots, "node", "left").select("s1", "s2", "low", F.coalesce("root", "node").alias("root")))
    lows = cut_lineage(nodes.groupBy("root").agg(F.min("low").alias("component")))
    named = cut_lineage(nodes.join(lows, "root").select("s1", "s2", "component"))
    out = slim.join(named, ["s1", "s2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("_id"))
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), "_k1", "_k2")


def one_per_class(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, one of each class of linked rows: the one with the
    smallest id (of rows that share it, one). Rows without words are all kept."""
    found = classes(docs, k, percent, id_col, text_col)
    keep = (found.where((F.col("n_shingles") > 0) & F.col(id_col).eqNullSafe(F.col("component_id")))
            .groupBy("component_id").agg(F.min(F.struct("_k1", "_k2")).alias("_k"))
            .select(F.struct(F.col("_k._k1").alias("_k1"), F.col("_k._k2").alias("_k2")).alias("_pz_key")))
    worded = F.coalesce(F.col(text_col).rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    keyed = docs.where(worded).withColumn("_pz_key", F.struct(*row_key(id_col, text_col)))
    # Equal rows share a key: they are the same document, of which one stays.
    kept = keyed.join(keep, "_pz_key", "left_semi").dropDuplicates(["_pz_key"]).select(docs.columns)
    return kept.unionByName(docs.where(~worded))
