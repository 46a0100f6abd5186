"""Words and their hashes for whole Arrow batches of texts, in numpy.

Every function works on one bounded piece of a batch at a time: memory follows
``PIECE_BYTES`` or the longest single text, never the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 19
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15          # odd, so it has an inverse modulo 2**64
_INV = pow(_BASE, -1, 1 << 64)
_POW = {}


def separator_table(word_chars: bytes | None = None, separators: bytes | None = None) -> np.ndarray:
    """256 booleans, True where a byte separates words (bytes from 0x80 never do)."""
    table = np.zeros(256, bool)
    if separators is not None:
        table[list(separators)] = True
    else:
        table[:128] = True
        table[list(word_chars)] = False
    return table


# Words [^\x20\x09-\x0D]+
BLANKS = separator_table(separators=b" \t\n\x0b\x0c\r")
# Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of text whose A-Z are lower-cased first
ALNUM = separator_table(word_chars=b"0123456789abcdefghijklmnopqrstuvwxyz")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(base: int, n: int) -> np.ndarray:
    """``base**0 .. base**(n-1)`` modulo 2**64 (kept, grown when needed)."""
    have = _POW.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.empty(size, _U)
        have[0] = 1
        with np.errstate(over="ignore"):
            have[1:] = _U(base)
            np.multiply.accumulate(have, out=have)
        if size <= 8 * PIECE_BYTES:
            _POW[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> _U(30))
        h *= _U(0xBF58476D1CE4E5B9)
        h ^= h >> _U(27)
        h *= _U(0x94D049BB133111EB)
        h ^= h >> _U(31)
    return h


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``limit`` bytes of ``column`` (at least one row each)."""
    if not batch.num_rows:
        return
    _, offs = text_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and each text's offset (n + 1 of them); null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if not len(texts) or offsets is None:
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1]
    offs = offs.astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0]:offs[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, offs - offs[0]


class Words:
    """The words of a piece: ``start``/``end`` byte positions, ``first[d]`` the
    index of text d's first word (n + 1 values), ``data`` the (lower-cased) bytes."""

    def __init__(self, texts: pa.Array, separators: np.ndarray, lower: bool):
        data, offs = text_bytes(texts)
        self.data = LOWER[data] if lower else data
        self.offs = offs
        n = len(data)
        if not n:
            self.start = self.end = np.empty(0, np.int64)
            self.first = np.zeros(len(offs), np.int64)
            return
        inside = ~separators[self.data]
        edge = np.zeros(n + 1, bool)
        edge[offs] = True            # a word never runs on into the next text
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.empty(n, bool)
        after[-1] = False
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offs)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """One 64-bit hash per word: equal words, equal hashes."""
        out = np.empty(len(self.start), _U)
        at, words = 0, len(self.start)
        with np.errstate(over="ignore"):
            base = (_BASE + 2 * seed * 0xD1342543DE82EF95) % (1 << 64)
            inv = _INV if not seed else pow(base, -1, 1 << 64)
            while at < words:
                lo = self.start[at]
                to = max(at + 1, int(np.searchsorted(self.end, lo + PIECE_BYTES, side="right")))
                span = self.data[lo:self.end[to - 1]]
                run = np.empty(len(span) + 1, _U)
                run[0] = 0
                np.cumsum((span.astype(_U) + _U(1)) * powers(base, len(span)), out=run[1:])
                s, e = self.start[at:to] - lo, self.end[at:to] - lo
                h = (run[e] - run[s]) * powers(inv, len(span))[s]
                out[at:to] = mix(h + (e - s).astype(_U) * _U(0xA0761D6478BD642F))
                at = to
        return out

    def gram_starts(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Word index of every k-word window that lies in one text, and windows per text."""
        n = np.maximum(self.counts() - k + 1, 0)
        ends = np.cumsum(n)
        within = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)
        return np.repeat(self.first[:-1], n) + within, n


def gram_hashes(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of words[i:i+k] for every i (len - k + 1 of them; order matters)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, _U)
    base = (0xE7037ED1A0B428DB + 2 * seed * 0x8EBC6AF09C88C6E3) % (1 << 64) | 1
    out = np.zeros(n, _U)
    with np.errstate(over="ignore"):
        for j in range(k):
            out += words[j:j + n] * _U(pow(base, j + 1, 1 << 64))
    return mix(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the smallest value in every window of ``width`` (the rightmost on ties)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best = np.arange(len(values))
    reach = 1
    while reach * 2 <= width:
        left, right = best[:len(best) - reach], best[reach:]
        best = np.where(values[right] <= values[left], right, left)
        reach *= 2
    left, right = best[:n], best[width - reach:width - reach + n]
    return np.where(values[right] <= values[left], right, left)
