"""Byte-level BPE with two tiers: a minimal perfect hash for whole words, a heap over linked bytes for the rest.

Vocabulary file: lines of base64 token and rank. Every pre-token that is itself in the vocabulary
is one lookup; any other is merged from its bytes, always the pair of the lowest rank, leftmost
first. Pre-tokens met before are remembered in a dictionary of bounded size.

Defined results: null and empty texts give no ids; a text is encoded whole however long; equal rows
give equal results; other columns of the input are left alone.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from loomgraph.llm.common import extended
from loomgraph.llm.memory import Memory, groups

#: Remembered pre-tokens per Python worker; older ones are forgotten, results do not depend on it.
REMEMBERED = 800_000


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash over 64-bit keys: cascaded bit arrays, and ranks by population count.

    Level k holds a bit for each key that no other key of that level meets; the others go on to
    level k + 1. A key's number is the count of set bits before its own.
    """

    def __init__(self, keys: np.ndarray, gamma: float = 2.0):
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two keys share a 64-bit hash")
        self.sizes: list[int] = []
        self.bits: list[np.ndarray] = []
        self.first: list[np.ndarray] = []
        left, before = keys, 0
        while len(left):
            size = max(64, int(gamma * len(left)))
            at = (_mix(left, len(self.sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            self.sizes.append(size)
            self.bits.append(alone)
            self.first.append(before + np.cumsum(alone) - alone)
            before += int(alone.sum())
            left = left[~alone[at]]
        self.n = before

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; for a key never put in, some number or -1."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = (_mix(keys[todo], level) % np.uint64(size)).astype(np.int64)
            hit = self.bits[level][at]
            out[todo[hit]] = self.first[level][at[hit]]
            todo = todo[~hit]
        return out


class Codec:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(t): int(r) for t, r in pairs}
        self.tokens: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for t, r in self.ranks.items():
            self.tokens[r] = t
        self.split = regex.compile(pattern).findall
        self.decimal = [str(i) for i in range(len(self.tokens))]
        words = list(self.ranks)
        keys = self._keys(words)
        self.hash = PerfectHash(keys)
        at = self.hash.lookup(keys)
        self.word_at: list[bytes] = [b""] * len(words)
        self.rank_at: list[int] = [0] * len(words)
        for w, i in zip(words, at.tolist(), strict=True):
            self.word_at[i] = w
            self.rank_at[i] = self.ranks[w]
        self.known = Memory(REMEMBERED)
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.pair: dict[int, int] = {}

    @staticmethod
    def _keys(words: list[bytes]) -> np.ndarray:
        digest = xxhash.xxh3_64_intdigest
        return np.fromiter((digest(w) for w in words), np.uint64, len(words))

    def _merge(self, left: int, right: int) -> int:
        """The id of the two tokens joined, or -1; remembered, as at most vocabulary-many pairs can merge often."""
        key = left << 32 | right
        got = self.pair.get(key)
        if got is None:
            if len(self.pair) > REMEMBERED:
                self.pair.clear()
            got = self.pair[key] = self.ranks.get(self.tokens[left] + self.tokens[right], -1)
        return got

    def merge_bytes(self, word: bytes) -> list[int]:
        """BPE of one pre-token: a heap of candidate merges over a doubly linked list of byte positions."""
        ids = [self.single[b] for b in word]
        n = len(ids)
        merge, known = self._merge, self.pair.get
        ahead = [-1] * n  # what the token at a position makes with the next one
        heap = []
        for i in range(n - 1):
            r = known(ids[i] << 32 | ids[i + 1])
            if r is None:
                r = merge(ids[i], ids[i + 1])
            if r >= 0:
                ahead[i] = r
                heap.append(r << 32 | i)
        if not heap:
            return ids
        heapq.heapify(heap)
        push, pop = heapq.heappush, heapq.heappop
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        while heap:
            x = pop(heap)
            r, i = x >> 32, x & 0xFFFFFFFF
            if ahead[i] != r:  # one of the two was merged elsewhere meanwhile
                continue
            j = after[i]
            k = after[i] = after[j]
            ids[i], ids[j], ahead[i], ahead[j] = r, -1, -1, -1
            if k < n:
                before[k] = i
                m = known(r << 32 | ids[k])
                if m is None:
                    m = merge(r, ids[k])
                if m >= 0:
                    ahead[i] = m
                    push(heap, m << 32 | i)
            h = before[i]
            if h >= 0:
                m = known(ids[h] << 32 | r)
                if m is None:
                    m = merge(ids[h], r)
                ahead[h] = m
                if m >= 0:
                    push(heap, m << 32 | h)
        return [t for t in ids if t >= 0]

    def learn(self, names: list[str]) -> dict[str, bytes]:
        """Ids of pre-tokens: whole words by the perfect hash, all others by merging."""
        words = [p.encode("utf-8", "surrogatepass") for p in names]
        at = self.hash.lookup(self._keys(words)).tolist()
        out = {}
        for name, word, i in zip(names, words, at, strict=True):
            ids = [self.rank_at[i]] if i >= 0 and self.word_at[i] == word else self.merge_bytes(word)
            out[name] = array("I", ids).tobytes()
        return out

    def encode_all(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text as unsigned 32-bit integers."""
        for part in groups(texts):
            split = [self.split(t) if t else [] for t in part]
            ids = self.known.fetch(set().union(*split), self.learn).__getitem__
            for x in split:
                yield np.frombuffer(b"".join(map(ids, x)), np.uint32)

    def encode(self, text: str | None) -> np.ndarray:
        return next(self.encode_all([text]))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec per Python process and vocabulary."""
    return Codec(path, pattern)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df and a column `out` of token ids (array of int); a null text gives an empty array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            ids = list(c.encode_all(b.column(text).to_pylist()))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate([*ids, np.empty(0, np.uint32)]).astype(np.int32)
            col = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*b.columns, col], names=[*b.schema.names, out])

    if out in df.columns:
        raise ValueError(f"column {out} exists; choose another name for the ids")
    return df.mapInArrow(run, extended(df.schema, **{out: "array<int>"}))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df and a binary column `out`: the bytes that the ids stand for; null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            col = pa.array([c.decode(x or []) for x in b.column(ids).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, col], names=[*b.schema.names, out])

    if out in df.columns:
        raise ValueError(f"column {out} exists; choose another name for the bytes")
    return df.mapInArrow(run, extended(df.schema, **{out: "binary"}))


def digests(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_tokens, sha256 of the decimal ids joined by commas, sha256 of the decoded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            n, of_ids, of_bytes = [], [], []
            for x in c.encode_all(b.column(1).to_pylist()):
                ids = x.tolist()
                n.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(c.decimal.__getitem__, ids)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_bytes)], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(df.dtypes)[key]
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
