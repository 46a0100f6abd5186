"""Removal of repeated word windows by super-k-mer partitioning.

Each window of ``window`` words has a minimiser, its smallest m-word gram hash.
Consecutive windows of a text that share one travel together, as one packed
string (a super-k-mer), to the bucket of that minimiser. Equal windows have
equal minimisers, so they meet in one bucket, where the windows are sorted and
counted exactly. Minimisers that occur once in the corpus cannot hold a
repeated window; they are counted first, and their super-k-mers do not travel.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pozo.llm.frames import Kept, cut_lineage, join_counted, row_key, shuffle_tasks
from pozo.llm.textgrams import BLANKS, Words, gram_hashes, mix, pieces, sliding_min

WINDOW, MINIMISER = 35, 8
HOT = 20_000        # super-k-mers per minimiser above which its windows travel one by one


def _super_kmers(words: Words, window: int, m: int):
    """(text, first word of the text's run, windows in the run, minimiser) of every run."""
    starts, per_text = words.gram_starts(window)
    if not len(starts):
        return None
    g = gram_hashes(words.hashes(), m)
    place = sliding_min(g, window - m + 1)[starts]
    text = np.repeat(np.arange(len(per_text)), per_text)
    begin = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])])
    size = np.diff(np.r_[begin, len(starts)])
    text = text[begin]
    return text, starts[begin] - words.first[text], size, g[place[begin]].view(np.int64)


def _minimisers(window: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                got = _super_kmers(Words(part.column("text"), BLANKS, lower=False), window, m)
                if got is not None:
                    text, at, size, mini = got
                    take = pa.array(text)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("_k1").take(take), part.column("_k2").take(take), pa.array(at.astype(np.int32)),
                         pa.array(size.astype(np.int32)), pa.array(mini)], names=["_k1", "_k2", "at", "n", "mini"])
    return run


def _flat(spans: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Row of every element of an array of structs, and the struct's fields."""
    n = np.asarray(spans.value_lengths().fill_null(0))
    values = spans.flatten()
    return np.repeat(np.arange(len(spans)), n), [np.asarray(values.field(i)) for i in range(values.type.num_fields)]


def _packer(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cut the asked-for super-k-mers out of each text."""
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                row, (at, n, mini, hot) = _flat(part.column("spans"))
                split = [(t or "").encode().split() for t in part.column("text").to_pylist()]
                packed = [b" ".join(split[r][a:a + c + window - 1]).decode() for r, a, c in zip(row.tolist(), at.tolist(), n.tolist())]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column("_k1").take(take), part.column("_k2").take(take), pa.array(at, pa.int32()),
                     pa.array(mini, pa.int64()), pa.array(hot, pa.bool_()), pa.array(packed, pa.string())],
                    names=["_k1", "_k2", "at", "mini", "hot", "packed"])
    return run


def _window_keys(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """128-bit key of every window, its text, and its first word in the text."""
    starts, per_text = words.gram_starts(window)
    text = np.repeat(np.arange(len(per_text)), per_text)
    h = words.hashes()
    one = gram_hashes(h, window, 1)
    two = gram_hashes(mix(h ^ np.uint64(0xD6E8FEB86659FD93)), window, 2)
    return one[starts] if len(starts) else one[:0], two[starts] if len(starts) else two[:0], text, starts - words.first[text]


def _ranges(text: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive windows of a text as ranges of words (text, lo, hi)."""
    begin = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (at[1:] != at[:-1] + 1)])
    last = np.r_[begin[1:], len(at)] - 1
    return text[begin], at[begin], at[last] + window


def _bucket(window: int):
    def settle(group: pa.Table) -> pa.RecordBatch | None:
        group = group.combine_chunks()
        packed = group.column("packed").combine_chunks() if isinstance(group.column("packed"), pa.ChunkedArray) else group.column("packed")
        if isinstance(packed, pa.ChunkedArray):
            packed = pa.concat_arrays(packed.chunks)
        one, two, text, at = _window_keys(Words(packed, BLANKS, lower=False), window)
        order = np.lexsort((two, one))
        new = np.r_[True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])]
        begin = np.flatnonzero(new)
        size = np.diff(np.r_[begin, len(order)])
        again = np.zeros(len(order), bool)
        again[order] = np.repeat(size > 1, size)
        text, at = text[again], at[again]
        if not len(text):
            return None
        text, lo, hi = _ranges(text, at, window)
        base = np.asarray(group.column("at"))[text]
        take = pa.array(text)
        return pa.RecordBatch.from_arrays(
            [*[pa.array(np.asarray(group.column(c))[text]) for c in ("_k1", "_k2")],
             pa.array((base + lo).astype(np.int32)), pa.array((base + hi).astype(np.int32))], names=["_k1", "_k2", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by minimiser: whole minimisers are settled, a piece at a time."""
        held: list[pa.RecordBatch] = []
        held_bytes = 0
        for batch in batches:
            for part in pieces(batch, "packed"):
                mini = np.asarray(part.column("mini"))
                if held and held_bytes > (1 << 21):
                    # everything before the last minimiser of what is held is complete
                    last = held[-1].column("mini")[-1].as_py()
                    cut = int(np.argmax(mini != last)) if (mini != last).any() else len(mini)
                    if cut < len(mini):
                        out = settle(pa.Table.from_batches([*held, part.slice(0, cut)]))
                        if out is not None:
                            yield out
                        held, held_bytes, part = [], 0, part.slice(cut)
                held.append(part)
                held_bytes += part.nbytes
        if held:
            out = settle(pa.Table.from_batches(held))
            if out is not None:
                yield out
    return run


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every window of packed strings as a row of its own."""
        for batch in batches:
            for part in pieces(batch, "packed"):
                one, two, text, at = _window_keys(Words(part.column("packed"), BLANKS, lower=False), window)
                base = np.asarray(part.column("at"))[text]
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(np.asarray(part.column(c))[text]) for c in ("_k1", "_k2")], pa.array((base + at).astype(np.int32)),
                     pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], names=["_k1", "_k2", "lo", "w1", "w2"])
    return run


def _remover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text"):
            row, fields = _flat(part.column("spans"))
            edge = np.searchsorted(row, np.arange(part.num_rows + 1))
            n_words, n_removed, digest, kept_text = [], [], [], []
            for i, text in enumerate(part.column("text").to_pylist()):
                words = (text or "").encode().split()
                n = len(words)
                if edge[i] < edge[i + 1]:
                    change = np.zeros(n + 1, np.int32)
                    np.add.at(change, fields[0][edge[i]:edge[i + 1]], 1)
                    np.add.at(change, fields[1][edge[i]:edge[i + 1]], -1)
                    gone = np.cumsum(change[:-1]) > 0
                    words = [words[j] for j in np.flatnonzero(~gone).tolist()]
                kept = b" ".join(words)
                n_words.append(n), n_removed.append(n - len(words))
                digest.append(hashlib.sha256(kept).hexdigest()), kept_text.append(kept.decode())
            yield pa.RecordBatch.from_arrays(
                [part.column("_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string()),
                 pa.array(kept_text, pa.string())], names=["_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def repeated_spans(docs: DataFrame, window: int = WINDOW, m: int = MINIMISER, hot: int = HOT) -> DataFrame:
    """(_k1, _k2, lo, hi): word ranges of windows that start more than once in the corpus.

    ``docs`` has (_k1, _k2, _id, text), one row per text, equal rows included.
    Minimisers are counted by partial aggregation and join their super-k-mers
    without one task for a frequent one. Those of more than ``hot``
    super-k-mers (a passage that a large part of all documents shares) are not
    brought to one bucket: their windows are counted by a partial aggregation
    over the windows themselves, which join their counts in the same way. Both
    ways give the same ranges. The texts are cut once, into a table of the shared
    folder that both ways read and that is deleted at the end.
    """
    spark = docs.sparkSession
    kept = Kept(spark, "super-k-mers")
    runs = docs.select("_k1", "_k2", "text").mapInArrow(_minimisers(window, m), "_k1 bigint, _k2 bigint, at int, n int, mini bigint")
    often = runs.groupBy("mini").agg(F.count("*").alias("c")).where("c > 1")
    wanted = (join_counted(runs, often, ["mini"]).groupBy("_k1", "_k2")
              .agg(F.collect_set(F.struct("at", "n", "mini", (F.col("c") > hot).alias("hot"))).alias("spans")))
    packed = kept.write(docs.join(wanted, ["_k1", "_k2"]).select("_k1", "_k2", "text", "spans").mapInArrow(
        _packer(window), "_k1 bigint, _k2 bigint, at int, mini bigint, hot boolean, packed string"))
    cold = (packed.where("not hot").drop("hot").repartition(shuffle_tasks(spark), "mini").sortWithinPartitions("mini")
            .mapInArrow(_bucket(window), "_k1 bigint, _k2 bigint, lo int, hi int"))
    windows = packed.where("hot").mapInArrow(_windows(window), "_k1 bigint, _k2 bigint, lo int, w1 bigint, w2 bigint")
    counted = windows.groupBy("w1", "w2").agg(F.count("*").alias("c")).where("c > 1")
    warm = join_counted(windows, counted, ["w1", "w2"]).select("_k1", "_k2", "lo", (F.col("lo") + window).alias("hi"))
    spans = cut_lineage(cold.unionByName(warm))
    kept.drop()
    return spans


def drop_repeats(docs: DataFrame, window: int = WINDOW, m: int = MINIMISER, hot: int = HOT,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, kept_text) for every row.

    Every word that lies in a window of ``window`` words whose sequence also
    starts elsewhere, in the same text or another, is removed; all windows are
    judged on the input. Words are runs of bytes other than ASCII white space,
    unchanged; ``kept_text`` joins the kept ones by one space. Null and empty
    texts have no words; shorter texts than a window keep everything; fully
    equal rows repeat each other; ids may be null or repeat; other columns are
    ignored; an empty table gives an empty result.
    """
    if not 0 < m <= window:
        raise ValueError("a minimiser has between 1 and `window` words")
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    base = base.select(*row_key("_id", "text"), "_id", "text")
    spans = (repeated_spans(base, window, m, hot).groupBy("_k1", "_k2")
             .agg(F.collect_set(F.struct("lo", "hi")).alias("spans")))
    kind = docs.schema[id_col].dataType.simpleString()
    out = (base.join(spans, ["_k1", "_k2"], "left").select("_id", "_k1", "_k2", "text", "spans")
           .mapInArrow(_remover, f"_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string"))
    return out.withColumnRenamed("_id", id_col)
