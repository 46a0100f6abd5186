"""Benchmark decontamination by winnowed fingerprints.

In every window of ``window`` words, on both sides, the smallest hash of its
k-word grams is kept (the rightmost on ties). A window that stands in a document
and in an item therefore has the same kept gram at the same place in both:
joining kept grams finds every shared window. Each joined gram carries the few
words around it that a window through it can reach; the hit is extended over
them word by word, and counts when a whole window is equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pozo.llm.frames import cut_lineage, row_key
from pozo.llm.textgrams import ALNUM, Words, gram_hashes, pieces, sliding_min

WINDOW, GRAM = 10, 6
BITS = 22
FINGERPRINTS = "_k1 bigint, _k2 bigint, fp bigint, len int, pos int, lead int, around string"


def _emit(part: pa.RecordBatch, lengths: tuple[int, ...], bits: np.ndarray | None, whole_short: bool,
          window: int, gram: int) -> pa.RecordBatch | None:
    words = Words(part.column("text"), ALNUM, lower=True)
    h = words.hashes()
    counts = words.counts()
    first = words.first
    found = []          # (length, word index, fingerprint)

    def add(length: int, at: np.ndarray, fp: np.ndarray) -> None:
        if bits is not None:
            ok = bits[(fp >> np.uint64(64 - BITS)).astype(np.int64)]
            at, fp = at[ok], fp[ok]
        found.append((length, at, fp))

    starts, _ = words.gram_starts(window)
    if len(starts):
        g = gram_hashes(h, gram)
        at = np.unique(sliding_min(g, window - gram + 1)[starts])
        add(window, at, g[at])
    for n in lengths:
        if whole_short:                       # an item of n words is one window
            at = first[:-1][counts == n]
        else:
            at, _ = words.gram_starts(n)
        if len(at):
            add(n, at, gram_hashes(h, n, seed=n)[at])
    rows = []
    reach = window - gram
    for length, at, fp in found:
        doc = np.searchsorted(first, at, side="right") - 1
        for i, d, f in zip(at.tolist(), doc.tolist(), fp.view(np.int64).tolist()):
            lo, hi = i, i + length
            if length == window:
                lo, hi = max(int(first[d]), i - reach), min(int(first[d + 1]), i + window)
            around = b" ".join([words.data[a:b].tobytes() for a, b in zip(words.start[lo:hi].tolist(), words.end[lo:hi].tolist())])
            rows.append((d, f, length, i - int(first[d]), i - lo, around.decode()))
    if not rows:
        return None
    d, f, length, pos, lead, around = zip(*rows)
    take = pa.array(d)
    return pa.RecordBatch.from_arrays(
        [part.column("_k1").take(take), part.column("_k2").take(take), pa.array(f, pa.int64()), pa.array(length, pa.int32()),
         pa.array(pos, pa.int32()), pa.array(lead, pa.int32()), pa.array(around, pa.string())],
        names=["_k1", "_k2", "fp", "len", "pos", "lead", "around"])


def _fingerprinter(lengths: tuple[int, ...], packed: bytes | None, whole_short: bool, window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if packed is None else np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
        for batch in batches:
            for part in pieces(batch, "text"):
                out = _emit(part, lengths, bits, whole_short, window, gram)
                if out is not None:
                    yield out
    return run


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of words per row; the text goes no further."""
    for batch in batches:
        for part in pieces(batch, "_text"):
            n = Words(part.column("_text"), ALNUM, lower=True).counts()
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c) for c in ("_id", "_k1", "_k2")], pa.array(n, pa.int64())],
                names=["_id", "_k1", "_k2", "n_words"])


def _extender(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Equal words around each joined gram: the span of a document's words, where it holds a window."""
        for batch in batches:
            rows = batch.to_pydict()
            keep, lo, hi = [], [], []
            for i, (n, pos, lead, mine, lead2, theirs) in enumerate(zip(
                    rows["len"], rows["pos"], rows["lead"], rows["around"], rows["_lead"], rows["_around"])):
                if n < window:
                    if mine == theirs:
                        keep.append(i), lo.append(pos), hi.append(pos + n)
                    continue
                a, b = mine.split(" "), theirs.split(" ")
                if a[lead:lead + gram] != b[lead2:lead2 + gram]:
                    continue
                left, right = 0, gram
                while left < lead and left < lead2 and a[lead - left - 1] == b[lead2 - left - 1]:
                    left += 1
                while lead + right < len(a) and lead2 + right < len(b) and a[lead + right] == b[lead2 + right]:
                    right += 1
                if left + right >= window:
                    keep.append(i), lo.append(pos - left), hi.append(pos + right)
            if keep:
                at = pa.array(keep)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_k1").take(at), batch.column("_k2").take(at), batch.column("item").take(at),
                     pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], names=["_k1", "_k2", "item", "lo", "hi"])
    return run


def covered(spans: Column) -> Column:
    """Number of places that an array of half-open (lo, hi) spans covers."""
    done = F.aggregate(
        F.array_sort(spans), F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")),
        lambda s, x: F.struct((s["n"] + F.greatest(x["hi"] - F.greatest(x["lo"], s["to"]), F.lit(0))).alias("n"),
                              F.greatest(s["to"], x["hi"]).alias("to")))
    return done["n"].cast("long")


def find_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM,
               text_col: str = "text", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(_k1, _k2, item, lo, hi): words lo..hi-1 of a row that stand in an item's windows.

    ``docs`` must carry the row key ``_k1``, ``_k2``. A fixed-size bitmap of the
    items' fingerprints (512 KB, whatever their number) lets most document
    fingerprints go before the join; a bit set by another fingerprint only lets
    a row through to the join, so nothing is lost.
    """
    short = tuple(range(1, window))
    side = (items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text"))
            .where("text is not null"))
    keyed = cut_lineage(side.select("item", "text", *row_key("item", "text")).distinct())
    prints = keyed.select("_k1", "_k2", "text").mapInArrow(_fingerprinter(short, None, True, window, gram), FINGERPRINTS)
    theirs = cut_lineage(keyed.select("_k1", "_k2", "item").join(prints, ["_k1", "_k2"])
                         .select("fp", "len", "item", F.col("lead").alias("_lead"), F.col("around").alias("_around")))
    lengths = tuple(sorted(r["len"] for r in theirs.where(F.col("len") < window).select("len").distinct().collect()))
    bits = np.zeros(1 << BITS, bool)
    for r in theirs.select(F.shiftrightunsigned("fp", 64 - BITS).cast("int").alias("b")).distinct().toLocalIterator():
        bits[r["b"]] = True
    mine = docs.select("_k1", "_k2", F.col(text_col).alias("text")).where("text is not null").mapInArrow(
        _fingerprinter(lengths, np.packbits(bits).tobytes(), False, window, gram), FINGERPRINTS)
    both = mine.join(theirs, ["fp", "len"]).select("_k1", "_k2", "item", "len", "pos", "lead", "around", "_lead", "_around")
    return both.mapInArrow(_extender(window, gram), "_k1 bigint, _k2 bigint, item string, lo int, hi int")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM,
                  id_col: str = "doc_id", text_col: str = "text", **item_columns: str) -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated, spans, items) for every row.

    A word is hit when it lies in an occurrence of ``window`` consecutive words
    of an item (an item of fewer words is one window). ``spans`` are the hit
    ranges, ``items`` the ids found, as strings, sorted. Null texts have no
    words; an item without id hits words but is in no list; items that share
    an id or a text are each compared; repeated rows and null ids get rows of
    their own; empty tables hit nothing; other columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    base = base.select("*", *row_key("_id", "_text"))
    spans = find_spans(base, items, window, gram, text_col="_text", **item_columns)
    hits = spans.groupBy("_k1", "_k2").agg(
        F.collect_set(F.struct("lo", "hi")).alias("spans"), F.collect_set("item").alias("items"))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = (base.select("_id", "_k1", "_k2", "_text")
            .mapInArrow(_counter, f"_id {kind}, _k1 bigint, _k2 bigint, n_words bigint"))
    out = rows.join(hits, ["_k1", "_k2"], "left")
    items_ = F.array_sort(F.coalesce("items", F.array().cast("array<string>")))
    n_hit = F.when(F.col("spans").isNull(), F.lit(0)).otherwise(covered(F.col("spans"))).cast("long")
    return out.select(
        F.col("_id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size(items_).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items_), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
        F.array_sort("spans").alias("spans"), items_.alias("items"))


def clean_rows(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, unchanged, that no item's window stands in."""
    keyed = docs.withColumn("_pz_key", F.struct(*[c.alias(f"_k{i}") for i, c in enumerate(
        (F.xxhash64(text_col), F.xxhash64(F.lit(1), F.col(text_col))), 1)]))
    side = docs.select(F.col(text_col).alias("_text"), F.xxhash64(text_col).alias("_k1"),
                       F.xxhash64(F.lit(1), F.col(text_col)).alias("_k2"))
    bad = find_spans(side, items, text_col="_text", **options).select(F.struct("_k1", "_k2").alias("_pz_key")).distinct()
    return keyed.join(bad, "_pz_key", "left_anti").select(docs.columns)
