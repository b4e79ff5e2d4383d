"""Substring deduplication over bytes by column-wise construction of a Burrows-Wheeler transform.

Passages that may hold a repeated window (contexts of shared anchors, see passages.py) are laid out in
columns, each anchor in the same one. Going from the last column to the first, every round puts one more
symbol before each passage of the block: the symbols, in the order of what follows them, are the column's
segment of the transform; sorting the segment stably gives the order of the next column, and the common prefixes of
neighbours follow from the least of those between two equal symbols. Each round reads the segment, the order and the
prefixes front to back and writes the next ones; these sequential files are held as arrays,
since a block has a fixed size, and an executor's own disk is never used. Passages stand in blocks with their documents'
own bytes, so a repeat shows in the transform and nowhere else. Equal windows have their anchor at the
same offset, so comparing suffixes within a column loses nothing, and a round costs as much as there
are passages. A window is repeated if its suffix shares `width` symbols with a neighbour's.

Defined results: a byte is removed if a `width`-byte string that covers it starts anywhere else too, in the
same document or another; strings are judged on the input and never cross documents. Null texts have no bytes;
texts of any length are read in parts that overlap by a window; rows with a null id take no part and stay whole; repeated
rows are documents of their own, whether their texts are equal or not; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomgraph.llm import passages

WIDTH, RUN = 200, 64
#: A 64-bit code for each byte value, from a fixed seed.
_CODES = np.random.default_rng(20240229).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FAR = np.int32(1 << 30)


def _codes(data: bytes) -> np.ndarray:
    return _CODES[np.frombuffer(data, np.uint8)]


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def units(width: int, run: int) -> passages.Units:
    return passages.Units(lambda t: _codes(_bytes(t)), _cut, _codes, lambda s, a, b: s[a:b], width, run)


def _cut(text: str, spans: list[tuple[int, int]]) -> list[bytes]:
    data = _bytes(text)
    return [data[a:b] for a, b in spans]


class ColumnTransform:
    """The transform of a collection of texts laid out in columns, one symbol per text and round.

    columns[c] holds the symbols of column c; text i fills columns begin[i] to end[i]. step() writes the transform's
    segment of a column: the symbols before its suffixes, in their order. A segment says where each
    suffix goes when its symbol is put before it (equal symbols keep their order), so the order of the next
    column, and the common prefixes, follow from it. After step(), `order` has the texts of the current column, sorted by
    their suffixes from there on, `common` how many symbols each shares with the one before, and `segments`
    the whole transform so far.
    """

    def __init__(self, columns: np.ndarray, begin: np.ndarray, end: np.ndarray):
        self.columns, self.begin = columns, begin
        self.column = len(columns)
        self.order, self.common = np.empty(0, np.int64), np.empty(0, np.int32)
        self.segments: list[np.ndarray] = []
        by_end = np.argsort(-end, kind="stable")
        cuts = np.searchsorted(-end[by_end], -np.arange(len(columns), 0, -1), side="left")
        self.entering = {int(c): by_end[a:b] for c, a, b in zip(range(len(columns) - 1, -1, -1), cuts, [*cuts[1:], len(by_end)], strict=True) if b > a}

    def _close(self, c: int) -> None:
        """Takes out texts that begin right of column c, and lets in those that end there."""
        keep = np.flatnonzero(self.begin[self.order] <= c)
        if len(keep) < len(self.order):
            # what two neighbours share is the least over those that stood between them
            if len(keep):
                least = np.minimum.reduceat(self.common[: keep[-1] + 1], np.concatenate([[0], keep[:-1] + 1]))
                least[0] = 0
            else:
                least = self.common[:0]
            self.order, self.common = self.order[keep], least
        new = self.entering.get(c)
        if new is not None:  # an empty suffix comes before all others
            self.order = np.concatenate([new, self.order])
            self.common = np.concatenate([np.zeros(len(new), np.int32), self.common])

    def step(self) -> None:
        self.column -= 1
        self._close(self.column)
        self.segments.append(self.columns[self.column][self.order])
        segment = self.segments[-1]
        if len(segment):
            to = np.argsort(segment, kind="stable")
            least = np.minimum.reduceat(np.append(self.common[1:], _FAR), to)
            equal = segment[to[1:]] == segment[to[:-1]]
            self.common = np.concatenate([np.zeros(1, np.int32), np.where(equal, least[:-1] + 1, 0).astype(np.int32)])
            self.order = self.order[to]


def repeated_windows(columns: np.ndarray, begin: np.ndarray, end: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text the first and last column where a window starts whose symbols another text has in the same columns; first > last if there is none."""
    first, last = np.full(len(begin), len(columns)), np.full(len(begin), -1)
    transform = ColumnTransform(columns, begin, end)
    for _ in range(len(columns)):
        transform.step()
        long = transform.common >= width
        if long.any():
            both = transform.order[long | np.append(long[1:], False)]
            first[both] = transform.column
            last[both] = np.maximum(last[both], transform.column)
    return first, last


def _block(table: pa.Table, width: int) -> pa.Table:
    """The stretch of each passage of a block that others repeat."""
    spans = table.column("span").to_pylist()
    at = table.column("at").to_numpy()
    size = np.array([len(s) for s in spans])
    begin = at.max() - at
    end = begin + size
    columns = np.zeros((int(end.max()), len(spans)), np.uint8)
    flat = np.frombuffer(b"".join(spans), np.uint8)
    text = np.repeat(np.arange(len(spans)), size)
    columns[np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + begin[text], text] = flat
    first, last = repeated_windows(columns, begin, end, width)
    hit = np.flatnonzero(first <= last)
    cols = [table.column(c).take(pa.array(hit)) for c in passages.FOUND]
    a, b = (pa.array((x[hit] - begin[hit] + more).astype(np.int32)) for x, more in ((first, 0), (last, width)))
    return pa.table([*cols, a, b], names=[*passages.FOUND, "first", "last"])


def duplicate_spans(docs: DataFrame, width: int = WIDTH, run: int = RUN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans (_key, _row, start, end) in bytes that start somewhere else, too; _row is the hash of the row's text."""
    return passages.found_again(docs, units(width, run), lambda t: _block(t, width), key, text, across=False)


def _kept(text: str | None, spans: list[tuple[int, int]]) -> tuple[int, int, int, bytes]:
    data = _bytes(text) if text else b""
    kept, at = [], 0
    for a, b in spans:
        kept.append(data[at:a])
        at = b
    return len(data), sum(b - a for a, b in spans), len(spans), b"".join([*kept, data[at:]])


def deduplicated(docs: DataFrame, width: int = WIDTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, n_bytes, n_removed, n_spans and `kept`: the bytes that stay (cuts may split characters)."""
    names = ["n_bytes", "n_removed", "n_spans", "kept"]
    return passages.with_removals(docs, duplicate_spans(docs, width, key=key, text=text), key, text, "n_bytes long, n_removed long, n_spans long, kept binary", names, _kept)


def digests(docs: DataFrame, width: int = WIDTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """deduplicated() with the hash of the kept bytes in their place."""

    def row(t, spans):
        n, removed, runs, kept = _kept(t, spans)
        return n, removed, runs, hashlib.sha256(kept).hexdigest()

    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return passages.with_removals(docs, duplicate_spans(docs, width, key=key, text=text), key, text, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", names, row)
