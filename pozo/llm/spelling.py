"""Spelling variants: words one edit apart, found by dynamic programming down a sorted vocabulary.

The vocabulary is range-partitioned into sorted blocks. In a block, a query
word goes down the list with one edit-matrix row per prefix, of which only the
three cells around the diagonal can stay at one edit. Adjacent longest common
prefixes say how far a row serves the following words as well: a row is worked
out once for a range of words that share a prefix and handed to all of them,
and a range whose shared prefix is already two edits away is skipped whole.
All queries of a block walk together, one letter of depth at a time.

Two words one edit apart share the first half or the last half of their
letters. So the list is scanned twice: sorted by word for pairs that share the
first half, where a query starts at the range of its own first half, and sorted
by reversed word for the others. A query goes to every block that its range
reaches (the same rows against the shared prefix of a block skip blocks too).
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pozo.llm.frames import cut_lineage, shuffle_tasks

LETTERS = "A-Za-zÀ-ÿ"
BLOCK = 8_000         # words per block aimed at
MAX_BLOCKS = 10_000   # beyond BLOCK * MAX_BLOCKS words blocks grow: the fences stay a bounded table
FENCE = 64            # letters of a block's first and last word that are kept
QUERIES = 4096        # queries walked together
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

FOUND = "word string, n_near bigint, form_n bigint, form string"


# -- the words ---------------------------------------------------------------

def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 7,
               min_count: int = 2, typo_every: int = 31) -> DataFrame:
    """(word, n): distinct words of all whole texts with their number of occurrences.

    A word is a maximal run of letters (A-Z, a-z, U+00C0 to U+00FF), only A-Z
    lower-cased. Where ``typo_every`` divides the CRC-32 h of "<id>:<run>", the
    run's code point h % length is deleted first (0: never). Words shorter than
    ``min_chars`` or rarer than ``min_count`` are not listed. Null and empty
    texts have no words; a null id is written as nothing. Counts are partial
    aggregates before the shuffle, so a frequent word is a row per task.
    """
    # A run shorter than min_chars cannot become longer.
    run = F.explode(F.regexp_extract_all(F.translate(F.col(text_col), _UPPER, _LOWER),
                                         F.lit(f"[{LETTERS}]{{{min_chars},}}"), F.lit(0)))
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), run.alias("_run"))
    word: Column = F.col("_run")
    if typo_every:
        runs = runs.withColumn("_h", F.crc32(F.concat("_id", F.lit(":"), "_run").cast("binary")))
        at = (F.col("_h") % F.char_length("_run")).cast("int")
        cut = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.char_length("_run")))
        word = F.when(F.col("_h") % typo_every == 0, cut).otherwise(F.col("_run"))
    words = runs.select(word.alias("word")).where(F.char_length("word") >= min_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


# -- one block -----------------------------------------------------------------

def _cut(length):
    """Letters at either end of a word that a partner shares, at that end or the other."""
    return (length - 1) // 2


def _prefixes(flat: np.ndarray, off: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Letters each word of a sorted list shares with the word before it (the first: -1)."""
    lcp = np.zeros(len(size), np.int64)
    lcp[:1] = -1
    alive = np.arange(1, len(size))
    d = 0
    while len(alive):
        alive = alive[(size[alive] > d) & (size[alive - 1] > d)]
        alive = alive[flat[off[alive] + d] == flat[off[alive - 1] + d]]
        lcp[alive] += 1
        d += 1
    return lcp


def near_pairs(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of a sorted list without repeats: positions (query, word) of pairs one edit
    apart that share the query's first ``_cut`` letters; both directions."""
    m = len(words)
    size = np.fromiter(map(len, words), np.int64, m)
    off = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
    flat = np.frombuffer(b"".join(words) + b"\0", np.uint8)
    lcp = _prefixes(flat, off, size)

    def letter(q: np.ndarray, at: int) -> np.ndarray:
        ok = (size[q] > at) & (at >= 0)
        return np.where(ok, flat[np.where(ok, off[q] + at, 0)], 0)

    for start in range(0, m, QUERIES):
        asked = np.arange(start, min(m, start + QUERIES))
        enters = _cut(size[asked])
        depth, last = int(enters.min()), int(enters.max())
        head = end = q = np.empty(0, np.int64)
        row = np.empty((3, 0), np.int8)     # edits at query prefixes of depth - 1, depth, depth + 1 letters
        heads = np.flatnonzero(lcp < depth)
        while len(q) or depth <= last:
            new = asked[enters == depth]
            if len(new):
                k = np.searchsorted(heads, new, "right")
                head = np.concatenate([head, heads[k - 1]])
                end = np.concatenate([end, np.append(heads, m)[k]])
                q = np.concatenate([q, new])
                row = np.concatenate([row, np.repeat(np.array([[1], [0], [1]], np.int8), len(new), axis=1)], axis=1)
            # A word that ends here is the first of its range.
            over = size[head] == depth
            gap = size[q] - depth
            hit = over & (np.abs(gap) <= 1)
            hit[hit] = row[gap[hit] + 1, np.flatnonzero(hit)] == 1
            if hit.any():
                yield q[hit], head[hit]
            # Each range falls apart at the next letter; its row serves all parts.
            heads = np.flatnonzero(lcp <= depth)
            a, b = np.searchsorted(heads, head), np.searchsorted(heads, end)
            parts = b - a
            k = np.repeat(a - np.concatenate([[0], np.cumsum(parts)[:-1]]), parts) + np.arange(parts.sum())
            up = np.repeat(np.arange(len(q)), parts)
            head, end, q = heads[k], np.append(heads, m)[k + 1], q[up]
            go = size[head] > depth
            head, end, q, up = head[go], end[go], q[go], up[go]
            x = flat[off[head] + depth]
            low = np.minimum(row[0][up] + (letter(q, depth - 1) != x), row[1][up] + 1)
            mid = np.minimum(np.minimum(row[1][up] + (letter(q, depth) != x), row[2][up] + 1), low + 1)
            high = np.minimum(row[2][up] + (letter(q, depth + 1) != x), mid + 1)
            row = np.minimum(np.stack([low, mid, high]), 2).astype(np.int8)
            near = row.min(axis=0) <= 1
            head, end, q, row = head[near], end[near], q[near], row[:, near]
            depth += 1


def _block(back: bool):
    """Near words of every word within its block: how many, and the one of largest n."""
    def run(table: pa.Table) -> pa.Table:
        text = table.column("key").to_pylist()
        rows = sorted(zip((t.encode("latin-1") for t in text), table.column("n").to_pylist(),
                          table.column("home").to_pylist()))
        words = [r[0] for r in rows]
        n = np.array([r[1] for r in rows], np.int64)
        home = np.array([r[2] for r in rows], bool)
        plain = [w[::-1] for w in words] if back else words
        rank = np.empty(len(words), np.int64)      # code-point order of the words themselves
        rank[sorted(range(len(words)), key=plain.__getitem__)] = np.arange(len(words))
        asked, found = [], []
        for q, b in near_pairs(words):
            keep = home[b]
            q, b = q[keep], b[keep]
            if back:    # pairs that share the first half come from the other list
                keep = np.fromiter((plain[i][:_cut(len(plain[i]))] != plain[j][:_cut(len(plain[i]))]
                                    for i, j in zip(q, b)), bool, len(q))
                q, b = q[keep], b[keep]
            asked.append(q)
            found.append(b)
        q, b = (np.concatenate(x or [np.empty(0, np.int64)]) for x in (asked, found))
        order = np.lexsort((rank[b], -n[b], q))
        q, b = q[order], b[order]
        which, first, count = np.unique(q, return_index=True, return_counts=True)
        name = lambda i: plain[i].decode("latin-1")
        return pa.table({"word": pa.array([name(i) for i in which], pa.string()),
                         "n_near": pa.array(count, pa.int64()),
                         "form_n": pa.array(n[b[first]], pa.int64()),
                         "form": pa.array([name(i) for i in b[first]], pa.string())})
    return run


# -- all blocks ------------------------------------------------------------------

def _reaches(shared: str, q: str) -> bool:
    """Whether a word that begins with ``shared`` can be within one edit of ``q``."""
    row = (9, 0, 1)
    for d, x in enumerate(shared):
        at = lambda i: q[i] if 0 <= i < len(q) else ""
        low = min(row[0] + (at(d - 1) != x), row[1] + 1)
        mid = min(row[1] + (at(d) != x), row[2] + 1, low + 1)
        row = (low, mid, min(row[2] + (at(d + 1) != x), mid + 1))
        if min(row) > 1:
            return False
    return True


def _deal(fences: list[tuple[int, str, str]]):
    """Copies of the words for other blocks that hold words with the same first half."""
    ids, lows, highs = ([f[i] for f in fences] for i in range(3))
    shared = [commonprefix([a, b]) for a, b in zip(lows, highs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for block, key, n in zip(*(batch.column(c).to_pylist() for c in ("block", "key", "n"))):
                out.append((block, key, n, True))
                half = key[:min(_cut(len(key)), FENCE)]
                a, b = bisect_left(highs, half), bisect_right(lows, half + "￿")
                out += [(ids[i], key, n, False) for i in range(a, b) if ids[i] != block and _reaches(shared[i], key)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 4,
                                                (pa.int64(), pa.string(), pa.int64(), pa.bool_()))],
                names=["block", "key", "n", "home"])
    return run


def _scan(words: DataFrame, blocks: int, back: bool) -> DataFrame:
    key = F.reverse("word") if back else F.col("word")
    ranged = cut_lineage(words.select(key.alias("key"), "n").repartitionByRange(blocks, "key")
                         .withColumn("block", F.spark_partition_id().cast("long")))
    # At most one row per block.
    fences = [tuple(r) for r in ranged.groupBy("block").agg(
        F.min("key").substr(1, FENCE), F.max("key").substr(1, FENCE)).collect()]
    dealt = cut_lineage(ranged.mapInArrow(_deal(sorted(fences, key=lambda f: (f[1], f[2]))),
                                          "block bigint, key string, n bigint, home boolean"))
    # Blocks in a row go to one task, by their rows: tasks are of one size.
    dealt = dealt.repartitionByRange(min(blocks, shuffle_tasks(words.sparkSession)), "block")
    return dealt.groupBy("block").applyInArrow(_block(back), FOUND)


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, form_n, form): for every word with a word one edit away in ``words``
    (word, n; distinct words of letters up to U+00FF), how many there are and the one
    of largest n (ties: smallest in code-point order).

    A task holds one block of the sorted list and the few queries that reach
    into it. How many blocks a query can reach grows with the alphabet and the
    depth at which blocks part, not with the number of words sharing its prefix.
    """
    blocks = max(1, min(-(-words.count() // block), MAX_BLOCKS))
    got = _scan(words, blocks, False).unionByName(_scan(words, blocks, True))
    best = F.min(F.struct((-F.col("form_n")).alias("m"), "form"))
    return (got.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_b"))
            .select("word", "n_near", (-F.col("_b.m")).alias("form_n"), F.col("_b.form").alias("form")))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = 10,
             block: int = BLOCK, **options) -> DataFrame:
    """Words of ``docs`` with their spelling form: (word, form, root, n, n_near, form_n).

    ``form`` is the near word (one code point inserted, deleted or replaced) of
    largest n, ties the smallest in code-point order, if that n is at least
    ``ratio`` times the word's own; else null, as ``form_n``. ``root`` is reached by
    following forms to the last; a word without form is its own root.
    ``options`` go to :func:`vocabulary`, which states what null, empty and very
    long texts give; repeated rows count again; other columns are not read.
    An empty table gives an empty result.

    A form is at least ``ratio`` times as frequent, so chains are short: the
    pointers are doubled until none moves, each round a checkpointed join. Many
    words may share one form; both sides of that join are read from checkpoints,
    so Spark splits such a key.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more: forms would run in circles")
    words = cut_lineage(vocabulary(docs, id_col, text_col, **options))
    near = cut_lineage(near_words(words, block))
    ok = F.col("form_n") >= ratio * F.col("n")
    out = cut_lineage(words.join(near, "word", "left").select(
        "word", F.when(ok, F.col("form")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(ok, F.col("form_n")).alias("form_n")))
    step = out.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        step = cut_lineage(step)
        onward = step.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        if step.join(onward, "root", "left_semi").isEmpty():
            break
        step = step.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"))
    return out.join(step, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
