"""Substring deduplication over words by relative Lempel-Ziv parsing.

Reference blocks hold the passages (contexts of shared anchors, see passages.py) of all documents in
the order of their ids; each block is indexed by the hashes of its windows. A document is factored
against every block that the index of anchors names for it; no other block holds a factor of `width` words. Its
passages are factored greedily against the part of the block that belongs to smaller ids: the longest match from the
current word becomes a factor. Parsing goes on within the last window of a factor, so that a window that
crosses factor boundaries is checked on its own. Factors of `width` words or more are duplicate spans, and nothing
else is. Every document is factored by its own words.

Defined results: a word is removed if a window of `width` words that covers it starts in a document
with a smaller id, too; windows are judged on the input. Null texts have no words; texts shorter than a
window stay whole; texts of any length are read in parts that overlap by a window; rows with a null id take no part and stay
whole; rows of one id, with one text or several, do not count against each other, and each is cut by its own words; an
empty table gives an empty one. cleaned() passes other columns on, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import passages

WIDTH, RUN = 50, 16
_WORD = re.compile(r"[^\x20\x09-\x0D]+").finditer


def _codes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _split(data: bytes) -> list[bytes]:
    """Words of UTF-8 bytes: bytes.split() breaks at space and 9 to 13, exactly the word breaks."""
    return data.split()


def units(width: int, run: int) -> passages.Units:
    return passages.Units(lambda t: _codes(_split(t.encode("utf-8", "surrogatepass"))), _cut, lambda s: _codes(_split(s)), lambda s, a, b: b" ".join(_split(s)[a:b]), width, run)


def _cut(text: str, spans: list[tuple[int, int]]) -> list[bytes]:
    words = _split(text.encode("utf-8", "surrogatepass"))
    return [b" ".join(words[a:b]) for a, b in spans]


def factors(codes: np.ndarray, starts: np.ndarray, owner: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Greedy factors (text, first word, end) of texts against the texts of smaller owners.

    codes holds the texts one after another, in the order of owner; starts has where each begins, and the
    end of the last. Every returned factor has at least `width` words.
    """
    n = len(starts) - 1
    if len(codes) < width:
        return []
    h = passages.RollingHash(codes).windows(width)
    text = np.repeat(np.arange(n), np.diff(starts))[: len(h)]
    ok = np.flatnonzero(np.arange(len(h)) + width <= starts[text + 1])
    _, first, back = np.unique(h[ok], return_index=True, return_inverse=True)
    source = ok[first][back]  # the first window with this hash: texts are in the order of their owners
    hit = owner[text[source]] < owner[text[ok]]
    at, source = ok[hit], source[hit]
    out, k, free = [], 0, -1
    lengths = starts[1:]
    while k < len(at):
        i, j = int(at[k]), int(source[k])
        if i < free:
            k = int(np.searchsorted(at, free))
            continue
        t, r = int(text[i]), int(text[j])
        room = int(min(lengths[t] - i, lengths[r] - j))
        same = codes[i : i + room] == codes[j : j + room]
        length = room if same.all() else int(np.argmin(same))
        if length < width:  # two windows share a hash: look at this one by itself
            length = 0
            k += 1
            continue
        out.append((t, i - int(starts[t]), i + length - int(starts[t])))
        free = i + length - width + 1
    return out


def _block(table: pa.Table, width: int) -> pa.Table:
    """The stretch that factors cover of each passage of a block."""
    table = table.sort_by([("_key", "ascending"), ("anchor", "ascending"), ("start", "ascending"), ("context", "ascending")])
    words = [_codes(_split(s)) for s in table.column("span").to_pylist()]
    ids = table.column("_key").to_pylist()
    rank = {v: i for i, v in enumerate(dict.fromkeys(ids))}
    starts = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    first, last = np.full(len(words), np.iinfo(np.int32).max, np.int32), np.zeros(len(words), np.int32)
    for t, a, b in factors(np.concatenate(words), starts, np.array([rank[i] for i in ids]), width):
        first[t], last[t] = min(first[t], a), max(last[t], b)
    hit = np.flatnonzero(last)
    cols = [table.column(c).take(pa.array(hit)) for c in passages.FOUND]
    return pa.table([*cols, pa.array(first[hit]), pa.array(last[hit])], names=[*passages.FOUND, "first", "last"])


def duplicate_spans(docs: DataFrame, width: int = WIDTH, run: int = RUN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans (_key, _row, start, end) in words that occur in a document with a smaller key; _row is the hash of the row's text."""
    return passages.found_again(docs, units(width, run), lambda t: _block(t, width), key, text, across=True)


def _kept(text: str | None, spans: list[tuple[int, int]]) -> tuple[int, int, list[bytes]]:
    words = _split(text.encode("utf-8", "surrogatepass")) if text else []
    kept, at, removed = [], 0, 0
    for a, b in spans:
        kept += words[at:a]
        removed += b - a
        at = b
    return len(words), removed, kept + words[at:]


def deduplicated(docs: DataFrame, width: int = WIDTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, n_words, n_removed, and `kept`: the words that stay, joined by one space."""

    def row(t, spans):
        n, removed, words = _kept(t, spans)
        return n, removed, b" ".join(words).decode("utf-8", "surrogatepass")

    return passages.with_removals(docs, duplicate_spans(docs, width, key=key, text=text), key, text, "n_words long, n_removed long, kept string", ["n_words", "n_removed", "kept"], row)


def digests(docs: DataFrame, width: int = WIDTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """deduplicated() with the hash of the kept text in its place."""
    return deduplicated(docs, width, key, text).withColumn("kept_sha256", F.sha2(F.col("kept"), 256)).drop("kept")


def cleaned(docs: DataFrame, width: int = WIDTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with duplicate spans cut out of its text; what stays keeps its white space, and texts without a span stay as they are."""
    joined = passages.beside(docs, duplicate_spans(docs, width, key=key, text=text), key, text)
    at = docs.columns.index(text)

    def cut(t: str | None, cuts) -> str | None:
        if not cuts or not t:
            return t
        places = [m.span() for m in _WORD(t)]
        kept, word = [], 0
        for a, b in passages.merged([(x["start"], x["end"]) for x in cuts]):
            if a > word:
                kept.append(t[places[word][0] : places[a - 1][1]])
            word = b
        if word < len(places):
            kept.append(t[places[word][0] : places[-1][1]])
        return " ".join(kept)

    def go(batches):
        for b in batches:
            texts = [cut(t.as_py(), s.as_py()) for t, s in zip(b.column(at), b.column(b.num_columns - 1), strict=True)]
            cols = [pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names[:-1])

    return joined.mapInArrow(go, docs.schema)
