"""Language identification by nearest centroid.

A text is its vector of UTF-8 byte 1- to 3-grams (ASCII lower-cased, runs of
other ASCII characters as one blank), hashed into a fixed number of dimensions,
dampened, weighted by inverse document frequency and normalised. Every language
has several centroids, clustered from its sample; a text takes the language of
the nearest one by cosine, and is rejected when even that one is far. How far
hangs on the language and on the length, since a short text shares few grams
with any centroid: the bound is fitted on labelled rows and on pieces of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pozo.llm.textgrams import pieces, text_bytes

DIMS = 4096
ROWS = 512                     # texts vectorised at a time
FIT_ROWS = 64                  # the same on the driver
UNDETERMINED = "und"
HEAD = 2048                    # characters of a sampled text that pieces are cut from
PIECE_CHARS = [1 << i for i in range(2, 11)]
LOW, MARGIN = 0.005, 0.8       # the least cosine: this quantile of clean pieces, times the margin
OWN, FEW = 200, 20             # pieces for a bound of a language's own; for any bound
CLASSES = DIMS.bit_length()    # length classes: powers of two of distinct grams
_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_LETTER = regex.compile(r"\p{L}")


def gram_counts(texts: pa.Array) -> np.ndarray:
    """Hashed 1- to 3-gram counts, one row per text."""
    data, offs = text_bytes(texts)
    n = len(offs) - 1
    own = np.repeat(np.arange(n), np.diff(offs))
    b = _FOLD[data]
    if len(b):
        keep = np.ones(len(b), bool)
        keep[1:] = (b[1:] != 32) | (b[:-1] != 32) | (own[1:] != own[:-1])
        b, own = b[keep].astype(np.uint32), own[keep]
    else:
        b = b.astype(np.uint32)
    keys = []
    code = np.zeros(len(b), np.uint32)
    for k in range(3):
        if len(b) <= k:
            break
        with np.errstate(over="ignore"):
            code = code[:len(b) - k] * np.uint32(257) + b[k:] + np.uint32(k + 1)
            slot = ((code * np.uint32(0x9E3779B1)) >> np.uint32(20)).astype(np.int64)
        whole = own[:len(b) - k] == own[k:]
        keys.append((own[:len(b) - k] * DIMS + slot)[whole])
    flat = np.bincount(np.concatenate(keys), minlength=n * DIMS) if keys else np.zeros(n * DIMS, np.int64)
    return flat.reshape(n, DIMS)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text"):
            for at in range(0, part.num_rows, ROWS):
                yield part.slice(at, ROWS)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(DIMS, np.int64)
    for part in _blocks(batches):
        total += (gram_counts(part.column("text")) > 0).sum(axis=0)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["dim", "n"])


def _weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts).astype(np.float32) * idf
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm > 0, norm, 1)


def _vectors(idf: np.ndarray):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _blocks(batches):
            v = _weigh(gram_counts(part.column("text")), idf)
            at = [np.flatnonzero(row).astype(np.uint16) for row in v]
            yield pa.RecordBatch.from_arrays(
                [part.column("lang"), part.column("_h"), pa.array([i.tobytes() for i in at], pa.binary()),
                 pa.array([row[i].tobytes() for row, i in zip(v, at)], pa.binary()),
                 pc.utf8_slice_codeunits(part.column("text"), 0, HEAD)],
                names=["lang", "_h", "at", "v", "head"])
    return emit


def _dense(at: list[bytes], values: list[bytes]) -> np.ndarray:
    out = np.zeros((len(at), DIMS), np.float32)
    for row, i, x in zip(out, at, values):
        row[np.frombuffer(i, np.uint16)] = np.frombuffer(x, np.float32)
    return out


def cluster(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """At most ``k`` unit centroids (spherical k-means, farthest-first start; deterministic)."""
    mean = vectors.mean(axis=0)
    picks = [int(np.argmax(vectors @ mean))]
    near = vectors @ vectors[picks[0]]
    while len(picks) < min(k, len(vectors)):
        picks.append(int(np.argmin(near)))
        near = np.maximum(near, vectors @ vectors[picks[-1]])
    centres = vectors[picks].copy()
    for _ in range(rounds):
        own = np.argmax(vectors @ centres.T, axis=1)
        for c in range(len(centres)):
            got = vectors[own == c]
            if len(got):
                m = got.sum(axis=0)
                centres[c] = m / max(np.linalg.norm(m), 1e-12)
    return centres


def length_class(vectors: np.ndarray) -> np.ndarray:
    """Logarithm of the number of distinct grams: repeating a text makes it no longer."""
    return np.log2(np.maximum((vectors > 0).sum(axis=1), 1)).astype(np.int64)


def _pieces_of(heads: list[str]) -> list[str]:
    """Beginnings and ends of texts, of every length of ``PIECE_CHARS``, that have a letter."""
    out = []
    for head in heads:
        for n in PIECE_CHARS:
            if len(head) >= n:
                out += {head[:n], head[-n:]} if len(head) >= 2 * n else [head[:n]]
    return sorted(x for x in out if _LETTER.search(x))


def _clean_cosines(vectors: np.ndarray, heads: list[str], idf: np.ndarray, k: int) -> list[np.ndarray]:
    """Per length class, cosines of texts and their pieces to the nearest centroid of a fit without them.

    The sample is halved; each half is scored by the centroids of the other.
    """
    found: list[list[np.ndarray]] = [[] for _ in range(CLASSES)]
    for half in (0, 1) if len(vectors) > 1 else ():
        centres = cluster(vectors[1 - half::2], k)
        texts = _pieces_of(heads[half::2])
        parts = (_weigh(gram_counts(pa.array(texts[at:at + FIT_ROWS], pa.string())), idf) for at in range(0, len(texts), FIT_ROWS))
        for v in [vectors[half::2], *parts]:
            best, size = (v @ centres.T).max(axis=1), length_class(v)
            for c in np.unique(size).tolist():
                found[c].append(best[size == c])
    return [np.concatenate(x) if x else np.empty(0, np.float32) for x in found]


def _least_cosines(clean: list[list[np.ndarray]]) -> np.ndarray:
    """The least cosine per language and length class.

    A low quantile of the language's own pieces less a margin; of few pieces,
    that of all languages' where it is lower. A class that has hardly any piece
    takes the next shorter one's bound; without one nothing is far.
    """
    least = np.zeros((len(clean), CLASSES))
    for c in range(CLASSES):
        every = np.concatenate([x[c] for x in clean])
        for i, x in enumerate(clean):
            if len(every) < FEW:
                least[i, c] = least[i, c - 1] if c else 0
                continue
            bounds = [np.quantile(x[c], LOW)] if len(x[c]) else []
            if len(x[c]) < OWN:
                bounds.append(np.quantile(every, LOW))
            least[i, c] = MARGIN * min(bounds)
    return least


@dataclass(frozen=True)
class LanguageModel:
    """Inverse document frequencies, unit centroids, and each one's language and
    least cosine of a text that is not far, by length class."""
    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    least: np.ndarray


def learn(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          centroids: int = 6, sample: int = 2400, max_languages: int = 600) -> LanguageModel | None:
    """Fit on labelled rows; None where no row has a language and a letter.

    Document frequencies count every labelled row. The clusters are fitted on
    a bounded sample: about ``sample`` rows, split evenly among the languages,
    those with the smallest hash of id and text. Vectors of the sample come to
    the driver (their non-zero places, 24 KB each at most) with the texts' first ``HEAD`` characters, on which
    the least cosines are fitted. Rows with a null text or language teach nothing.
    """
    rows = (train.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"),
                         F.xxhash64(F.col(id_col), F.col(text_col)).alias("_h"))
            .where("lang is not null and text is not null").where(F.col("text").rlike("\\p{L}")))
    n = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(max_languages + 1).collect()}
    if not n:
        return None
    if len(n) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    freq = np.zeros(DIMS)
    for r in rows.select("text").mapInArrow(_frequencies, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect():
        freq[r["dim"]] = r["n"]
    idf = (np.log((1 + sum(n.values())) / (1 + freq)) + 0.2).astype(np.float32)
    each = max(1, sample // len(n))
    # A hash below this passes about `each` rows of the language; the limit is a firm bound.
    below = [(lang, int((1 << 63) * min(1.0, 1.3 * each / c + 20 / c))) for lang, c in n.items()]
    part = rows.sparkSession.createDataFrame([(a, min(b, (1 << 63) - 1)) for a, b in below], "lang string, _most long")
    few = (rows.join(F.broadcast(part), "lang").where(F.col("_h").bitwiseAND(F.lit((1 << 63) - 1)) <= F.col("_most"))
           # Equal rows teach once, so which rows the bound lets through hangs on hashes alone.
           .select("lang", "text", "_h").dropDuplicates(["lang", "_h"]).mapInArrow(_vectors(idf), "lang string, _h long, at binary, v binary, head string")
           .limit(4 * sample + 100 * len(n))).toArrow()
    lang_of = few.column("lang").to_pylist()
    hashes = [h & ((1 << 63) - 1) for h in few.column("_h").to_pylist()]
    centres, names, clean = [], [], []
    for lang in sorted(set(lang_of)):
        mine = sorted((i for i, x in enumerate(lang_of) if x == lang), key=lambda i: hashes[i])[:each]
        rows = few.take(pa.array(mine))
        v = _dense(rows.column("at").to_pylist(), rows.column("v").to_pylist())
        c = cluster(v, centroids)
        centres.append(c)
        names += [lang] * len(c)
        clean.append(_clean_cosines(v, rows.column("head").to_pylist(), idf, centroids))
    least = np.repeat(_least_cosines(clean), [len(c) for c in centres], axis=0)
    return LanguageModel(idf, np.concatenate(centres).astype(np.float32), names, least)


def _predictor(model: LanguageModel | None):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _blocks(batches):
            texts = part.column("text")
            letters = np.array([t is not None and _LETTER.search(t) is not None for t in texts.to_pylist()], bool)
            lang, score, least = [UNDETERMINED] * part.num_rows, np.zeros(part.num_rows), np.zeros(part.num_rows)
            if model is not None and letters.any():
                v = _weigh(gram_counts(texts), model.idf)
                cos = v @ model.centroids.T
                best = np.argmax(cos, axis=1)
                least = model.least[best, length_class(v)]
                score = np.where(letters, np.clip(cos[np.arange(len(best)), best], 0, 1), 0).astype(float)
                lang = [model.languages[b] if ok else UNDETERMINED for b, ok in zip(best, letters)]
            yield pa.RecordBatch.from_arrays(
                [*[c for c, name in zip(part.columns, part.schema.names) if name != "text"], pa.array(lang),
                 pa.array(score), pa.array(least)],
                names=[*[x for x in part.schema.names if x != "text"], "lang_pred", "score", "_least"])
    return predict


def identify(docs: DataFrame, model: LanguageModel | None, keep: list[Column] | None = None,
             text_col: str = "text", max_distance: float | None = None) -> DataFrame:
    """(kept columns, lang_pred, score, rejected) for every row, whole texts.

    ``keep`` are the columns carried along (default: none). ``lang_pred`` is a
    learned language, or ``und`` for a null text or one without a letter (or
    without a model), with score 0. ``score`` is the cosine to the nearest
    centroid, 0 to 1. ``rejected``: undetermined, or farther from the nearest
    centroid than the model's bound for its language and a text of that length
    (with ``max_distance``, than that, as 1 - cosine). A few letters may pass
    as any language. Ties go to the first language by name. Repeated rows and
    ids give repeated results.
    """
    cols = [c.alias(f"_c{i}") for i, c in enumerate(keep or [])]
    slim = docs.select(*cols, F.col(text_col).alias("text"))
    fields = [f for f in slim.schema.fields if f.name != "text"]
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                           T.StructField("_least", T.DoubleType())])
    out = slim.mapInArrow(_predictor(model), schema)
    names = [docs.select(c).columns[0] for c in keep or []]
    far = F.col("score") < F.col("_least") if max_distance is None else 1 - F.col("score") > max_distance
    return out.select(*[F.col(f.name).alias(n) for f, n in zip(fields, names)], "lang_pred", "score",
                      ((F.col("lang_pred") == UNDETERMINED) | far).alias("rejected"))


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the id's text modulo 3 is 1; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
