"""Token counts of whole texts: byte-pair merges applied rank by rank on arrays.

The pre-tokens of a batch are held as one flat numpy array of symbol ids with
an owner per symbol (a ragged array). In every step each unfinished sequence
finds its lowest-rank adjacent pair, and all sequences apply theirs at the same
time; a sequence without a mergeable pair is finished, and the symbols left in
it are its token count. Equal pre-tokens of a batch are merged once.

A long pre-token (an unbroken blob or minified line) has too many steps to pass
over all its symbols in each. Its places are kept by rank, and a step touches
only those of the lowest rank and their neighbours.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pozo.llm.textgrams import pieces

# Fixed value: the byte-level pre-token pattern of this vocabulary family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMORY = 1_000_000       # pre-tokens whose counts a worker keeps between batches
MEMORY_LENGTH = 64      # longer pre-tokens are not kept
LONG = 512              # bytes from which a pre-token's places are kept by rank


def byte_symbols() -> dict[str, int]:
    """Printable character of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _slot(key: np.ndarray, shift: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(shift)).astype(np.int64)


def _hash_table(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Open addressing with linear probing: key -> position in ``keys``."""
    bits = max(10, int(len(keys) * 4).bit_length())
    slots, value = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
    left = np.arange(len(keys))
    at = _slot(keys, 64 - bits)
    while len(left):
        free = slots[at] < 0
        _, first = np.unique(at, return_index=True)
        put = np.zeros(len(left), bool)
        put[first] = True
        put &= free
        slots[at[put]], value[at[put]] = keys[left[put]], left[put]
        left, at = left[~put], (at[~put] + 1) & (len(slots) - 1)
    return slots, value, 64 - bits


class RankMerger:
    """Counts the tokens of byte strings under a byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        pre = spec.get("pre_tokenizer") or {}
        if (model.get("type", "BPE") != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel"
                or pre.get("add_prefix_space") or not pre.get("use_regex", True)):
            raise ValueError(f"{path}: not a plain byte-level BPE vocabulary")
        vocab = model["vocab"]
        self.byte_id = np.zeros(256, np.int64)
        for ch, b in byte_symbols().items():
            self.byte_id[b] = vocab[ch]
        self.size = max(vocab.values()) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.slots, self.slot_rank, self.shift = _hash_table(keys)
        self.none = len(keys)
        special = [t["content"] for t in spec.get("added_tokens", []) if t["content"]]
        special.sort(key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.split = regex.compile(PATTERN)
        self.known: dict[str, int] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of every pair; ``self.none`` where the pair is no merge."""
        key = left * self.size + right
        at = _slot(key, self.shift)
        found = self.slots[at]
        out = np.where(found == key, self.slot_rank[at], self.none)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.slots) - 1)
            found = self.slots[at[open_]]
            good = found == key[open_]
            out[open_[good]] = self.slot_rank[at[open_[good]]]
            open_ = open_[~good & (found >= 0)]
        return out

    def merge(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols left in every byte string."""
        length = np.fromiter(map(len, tokens), np.int64, len(tokens))
        out = np.zeros(len(tokens), np.int64)
        sym = self.byte_id[np.frombuffer(b"".join(tokens), np.uint8)]
        own = np.repeat(np.arange(len(tokens)), length)
        rank = np.full(len(sym), self.none)
        fresh = np.flatnonzero(own[1:] == own[:-1])
        while len(sym):
            rank[fresh] = self._ranks(sym[fresh], sym[fresh + 1])
            begin = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            size = np.diff(np.r_[begin, len(sym)])
            low = np.minimum.reduceat(rank, begin)
            done = low == self.none
            out[own[begin[done]]] = size[done]
            place = np.flatnonzero((rank == np.repeat(low, size)) & (rank < self.none))
            if len(place):
                # In a run of one repeated pair (aaa) every second place counts, from the left.
                run = np.flatnonzero(np.r_[True, np.diff(place) != 1])
                odd = (np.arange(len(place)) - np.repeat(run, np.diff(np.r_[run, len(place)]))) & 1
                place = place[odd == 0]
            sym[place] = self.made[rank[place]]
            rank[place] = self.none
            keep = np.repeat(~done, size)
            keep[place + 1] = False
            moved = np.cumsum(keep) - 1
            sym, own, rank = sym[keep], own[keep], rank[keep]
            # Only pairs that touch a new symbol have a new rank.
            at = moved[place]
            fresh = np.unique(np.r_[at, at[at > 0] - 1])
            fresh = fresh[fresh + 1 < len(sym)]
            last = own[fresh] != own[fresh + 1]
            rank[at[at + 1 >= len(sym)]] = self.none
            rank[fresh[last]] = self.none
            fresh = fresh[~last]
        return out

    def merge_long(self, token: bytes) -> int:
        """Symbols left in one byte string: lowest rank first, all its places at once."""
        n = len(token)
        sym = self.byte_id[np.frombuffer(token, np.uint8)]
        # The neighbours of every symbol; n is the end.
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.full(n + 1, self.none)
        places: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []
        left = n

        def hold(at: np.ndarray) -> None:
            """Work out the ranks of the pairs that begin at these places and keep them."""
            rank[at] = self.none
            at = at[after[at] < n]
            if not len(at):
                return
            rank[at] = self._ranks(sym[at], sym[after[at]])
            at = at[rank[at] < self.none]
            order = np.argsort(rank[at], kind="stable")
            at = at[order]
            found, first = np.unique(rank[at], return_index=True)
            for r, some in zip(found.tolist(), np.split(at, first[1:])):
                if r not in places:
                    places[r] = []
                    heapq.heappush(queue, r)
                places[r].append(some)

        hold(np.arange(n))
        while queue:
            r = heapq.heappop(queue)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[rank[at] == r]          # merged or changed since
            if not len(at):
                continue
            # In a run of one repeated pair (aaa) every second place counts, from the left.
            run = np.flatnonzero(np.r_[True, after[at[:-1]] != at[1:]])
            odd = (np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))) & 1
            at = at[odd == 0]
            gone = after[at]
            sym[at] = self.made[r]
            rank[gone] = self.none
            after[at] = after[gone]
            inner = at[after[at] < n]
            before[after[inner]] = inner
            left -= len(at)
            # Only pairs that touch a new symbol have a new rank.
            back = before[at]
            hold(np.unique(np.r_[at, back[back >= 0]]))
        return left

    def learn(self, tokens: set[str]) -> dict[str, int]:
        """Counts of all given pre-tokens; those already kept are not merged again."""
        if len(self.known) > MEMORY:
            self.known.clear()
        fresh = [t for t in tokens if t not in self.known]
        found = {}
        step = 1 << 16
        for at in range(0, len(fresh), step):
            part = [(t, t.encode()) for t in fresh[at:at + step]]
            short = [(t, b) for t, b in part if len(b) < LONG]
            found.update(zip([t for t, _ in short], self.merge([b for _, b in short]).tolist()))
            found.update((t, self.merge_long(b)) for t, b in part if len(b) >= LONG)
        if len(found) < MEMORY:
            self.known.update((t, n) for t, n in found.items() if len(t) <= MEMORY_LENGTH)
        return found

    def count(self, texts: list[str]) -> list[int]:
        """Token count of every text; special strings in a text count as one token each."""
        extra = [0] * len(texts)
        split = []
        for i, text in enumerate(texts):
            if self.special is not None and self.special.search(text):
                extra[i] = len(self.special.findall(text))
                split.append([t for part in self.special.split(text) for t in self.split.findall(part)])
            else:
                split.append(self.split.findall(text))
        fresh = self.learn(set().union(*split))
        known = self.known
        both = fresh if not known else None
        out = []
        for n, tokens in zip(extra, split):
            if both is None:
                out.append(n + sum([known[t] if t in known else fresh[t] for t in tokens]))
            else:
                out.append(n + sum(map(both.__getitem__, tokens)))
        return out


_MERGERS: dict[str, RankMerger] = {}


def _counter(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = _MERGERS.get(path)
        if merger is None:
            merger = _MERGERS[path] = RankMerger(path)
        for batch in batches:
            for part in pieces(batch, "text"):
                n = merger.count([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column("n_bytes"), pa.array(n, pa.int64())],
                    names=[part.schema.names[0], "n_bytes", "n_tokens"])
    return count


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row of ``docs``.

    ``vocabulary`` is the path of a byte-level BPE file in the tokenizers
    format, present on every executor. A null text counts as empty (0 bytes,
    0 tokens); null or repeated ids and repeated rows are kept as they are;
    other columns are ignored, whatever their names; an empty table gives an
    empty result. Texts are never cut.
    """
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"),
                       F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    kind = docs.schema[id_col].dataType.simpleString()
    out = slim.mapInArrow(_counter(vocabulary), f"_id {kind}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("_id").alias(id_col), "n_bytes", "n_tokens",
                      (F.col("n_tokens") > limit).alias("over_limit"))
