"""Byte-level BPE over a whole corpus, with a public vocabulary.

Two tiers: a minimal perfect hash over the vocabulary resolves pre-tokens that are entries themselves; the others are
merged with a heap over linked bytes. Each distinct pre-token of a batch is resolved once, in whole arrays.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from . import codepoints as C

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMORY = 200_000


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def byte_hashes(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte string, by polynomial sums over the array of all bytes."""
    base = 0x9E3779B97F4A7C15
    lengths = at[1:] - at[:-1]
    longest = int(lengths.max(initial=1))
    power = np.ones(1, np.uint64)
    while len(power) <= longest:
        power = np.concatenate([power, power * np.uint64(pow(base, len(power), 1 << 64))])
    from_end = np.repeat(at[1:], lengths) - 1 - np.arange(len(raw))
    return _mix(C.per_row((raw.astype(np.uint64) + np.uint64(1)) * power[from_end], at) ^ (lengths.astype(np.uint64) << np.uint64(40)))


class PerfectHash:
    """A minimal perfect hash by displacement: keys fall into buckets, and each bucket, largest first, has the
    smallest displacement that sends its keys to slots still free. Lookups compare the bytes of the slot's key."""

    def __init__(self, keys: list[bytes]) -> None:
        n = self.n = len(keys)
        lengths = np.fromiter(map(len, keys), np.int64, n)
        raw, at = np.frombuffer(b"".join(keys), np.uint8), np.concatenate([[0], np.cumsum(lengths)])
        h = byte_hashes(raw, at)
        if len(np.unique(h)) < n:
            raise ValueError("two vocabulary entries share a hash")
        self.buckets = max(1, n // 4)
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=self.buckets)
        starts = np.cumsum(sizes) - sizes
        self.shift, slot_of = np.zeros(self.buckets, np.uint64), np.zeros(n, np.int64)
        free = np.ones(n, bool)
        for b in np.argsort(-sizes, kind="stable"):
            mine = order[starts[b] : starts[b] + sizes[b]]
            if not len(mine):
                break
            d = 0
            while True:
                tries = np.arange(d, d + 64, dtype=np.uint64)
                slots = (_mix(h[mine][None, :] + tries[:, None] * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)).astype(np.int64)
                good = free[slots].all(axis=1)
                if len(mine) > 1:
                    s = np.sort(slots, axis=1)
                    good &= (s[:, 1:] != s[:, :-1]).all(axis=1)
                if good.any():
                    k = int(good.argmax())
                    self.shift[b], slot_of[mine] = tries[k], slots[k]
                    free[slots[k]] = False
                    break
                d += 64
        self.key_of = np.zeros(n, np.int64)
        self.key_of[slot_of] = np.arange(n)
        self.hash_of = np.zeros(n, np.uint64)
        self.hash_of[slot_of] = h
        self.raw, self.at = raw, at

    def find(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The number of each byte string among the keys, -1 if it is none."""
        if not self.n or len(at) < 2:
            return np.full(len(at) - 1, -1, np.int64)
        h = byte_hashes(raw, at)
        slot = (_mix(h + self.shift[(h % np.uint64(self.buckets)).astype(np.int64)] * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.n)).astype(np.int64)
        key = self.key_of[slot]
        lengths = at[1:] - at[:-1]
        maybe = np.flatnonzero((self.hash_of[slot] == h) & (self.at[key + 1] - self.at[key] == lengths))
        k, n = key[maybe], lengths[maybe]
        same = raw[C.spread(at[:-1][maybe], n)] == self.raw[C.spread(self.at[k], n)]
        bad = C.per_row((~same).astype(np.int64), np.concatenate([[0], np.cumsum(n)])) > 0
        out = np.full(len(lengths), -1, np.int64)
        out[maybe[~bad]] = k[~bad]
        return out


class Vocabulary:
    """A byte-level BPE given as `base64 rank` lines, the rank being the id as well as the order of merges."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            pairs = [line.split() for line in f.read().splitlines() if line]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        keys = list(self.ranks)
        self.hash, self.ids = PerfectHash(keys), np.fromiter(self.ranks.values(), np.int64, len(keys))
        self.split = regex.compile(PATTERN)
        self.known: dict[bytes, list[int]] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token: the lowest-ranked pair of neighbours first, the leftmost of equals."""
        ranks, n = self.ranks, len(word)
        end, before = list(range(1, n + 1)), list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue
            end[i], alive[j] = stop, False
            if stop < n:
                before[stop] = i
                if (r := ranks.get(word[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := ranks.get(word[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = end[i]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts; NULL and '' have none."""
        split, counts, words = self.split.findall, [], []
        for t in texts.to_pylist():
            found = split(t) if t else []
            counts.append(len(found))
            words += found
        coded = pa.array(words, pa.string()).dictionary_encode()
        distinct, codes = coded.dictionary, np.asarray(coded.indices).astype(np.int64)
        raw, at = C.utf8(distinct)
        whole = self.hash.find(raw, at)
        lengths = np.ones(len(whole), np.int64)
        starts = np.arange(len(whole), dtype=np.int64)
        flat = [np.where(whole >= 0, self.ids[whole.clip(min=0)], 0) if len(whole) else np.zeros(0, np.int64)]
        total, data = len(whole), raw.tobytes()
        if len(self.known) > MEMORY:
            self.known.clear()
        for i in np.flatnonzero(whole < 0).tolist():
            word = data[at[i] : at[i + 1]]
            ids = self.known.get(word)
            if ids is None:
                ids = self.merge(word)
                if len(word) < 64:
                    self.known[word] = ids
            starts[i], lengths[i] = total, len(ids)
            flat.append(np.array(ids, np.int64))
            total += len(ids)
        each = lengths[codes]
        ids = np.concatenate(flat)[C.spread(starts[codes], each)]
        upto = np.concatenate([[0], np.cumsum(each)])
        return ids, upto[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


#: A batch of texts is encoded in slices of so many bytes, which bounds what a worker holds besides the batch.
SLICE_BYTES = 4 << 20


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    size = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64))])
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(size, size[i] + SLICE_BYTES, side="right")) - 1)
        yield texts.slice(i, j - i)
        i = j


def token_ids(col: Column, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Column:
    """Ids of a text as array<int>, without special tokens; their strings in a text are ordinary text.

    '' and NULL give an empty array. Texts of any length are encoded whole.
    """
    path = os.path.join(folder, f"{name}.tiktoken")

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        parts = []
        for piece in _slices(C.flat(texts)):
            ids, at = vocabulary(path).encode(piece)
            parts.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32))))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return encode(col)


def token_counts(col: Column, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Column:
    """How many ids token_ids gives, without shipping them."""
    path = os.path.join(folder, f"{name}.tiktoken")

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        parts = [np.diff(vocabulary(path).encode(piece)[1]) for piece in _slices(C.flat(texts))]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64))

    # else a filter on the count would be pushed below it and the texts encoded twice
    return count.asNondeterministic()(col)


def encode_corpus(df: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids) of every row, repeated rows and NULL keys included. A map over Arrow batches; no shuffle."""
    ship(df.sparkSession)
    return df.select(F.col(f"`{key}`"), token_ids(F.col(f"`{text}`"), name, folder).alias("ids"))
