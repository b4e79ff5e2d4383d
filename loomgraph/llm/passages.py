"""Repeated windows of documents, found by anchors: what the two substring operators share.

A window of `width` units (words or bytes) is named by its smallest-hashed run of `run` units, its
anchor; ties go to the leftmost. The choice depends on the window's content alone, so equal windows have
equal anchors at equal offsets. Consecutive windows with one anchor form an occurrence, whose span
is hashed as its context. Hashes only say which passages have to meet: the operator's own method compares units in
blocks, and what no block finds is not removed.

A passage is an anchor and context within one document, with that document's own units (of its first place). The
passages of the first document that has a context stand for the context: they meet those of the other contexts of
their anchor, in the anchor's block. Every other document's passage of the context meets that first one: in the same block,
or, where an anchor has more than SPLIT passages, in blocks of at most about COPIES of them, each with the first
one. A document that holds a context several times follows its passage at all those places; where no other document holds the context, its
last place is a passage, too.

Blocks have a bounded size. An anchor with more than SPLIT contexts has no block; it is split by a deeper anchor, the
whole window: windows that several of its first passages hold become passages of their own, named by the window's 128-bit
hash, and meet in the same way, each document with its own units.

All windows of a passage hold its anchor, so those found again cover one stretch of it.

A document is a key and the hash of its text, so rows that repeat a key with other texts keep their spans apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import written

#: Units handled at once; a longer document is cut into parts that overlap by a window.
BATCH = 1 << 20
#: Passages per block of the comparison, the most of one anchor in a block, and those of one context in a further block.
BLOCK, SPLIT, COPIES = 24_000, 4_000, 4_000
#: What blocks are made of: level 0 has passages of anchors, level 1 single windows of split anchors.
PASSAGE = "level int, anchor long, context long, split boolean, rep boolean, blocks array<int>, start int, at int, span binary"
_NAMES = [x.split(" ")[0] for x in PASSAGE.split(", ")] + ["_key", "_row"]
#: What names a passage in the results of a block.
FOUND = ["level", "anchor", "context", "_key", "_row"]

_U = np.uint64
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_LOW = _U((1 << 24) - 1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), _U)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(32))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class RollingHash:
    """Hashes of any stretch of a sequence of 64-bit codes, by prefix sums of a polynomial."""

    def __init__(self, codes: np.ndarray, which: int = 0):
        base = _MULTIPLIERS[which]
        n = len(codes) + 1
        self.back = _powers(pow(base, -1, 2**64), n)
        self.sums = np.zeros(n, _U)
        np.cumsum(codes * _powers(base, n)[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.back[start])

    def windows(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return _mixed((self.sums[width:] - self.sums[:n]) * self.back[:n])


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def occurrences(codes: np.ndarray, ends: np.ndarray, width: int, run: int) -> tuple[np.ndarray, ...]:
    """(anchor, context, text, start, windows, offset of the anchor) of the texts that codes hold one after another.

    ends: where each text ends. start counts from the text's beginning.
    """
    if len(codes) < width:
        return tuple(np.empty(0, np.int64) for _ in range(6))
    rolling = RollingHash(codes)
    h = rolling.windows(run)
    smallest = sliding_minimum((h & ~_LOW) | np.arange(len(h), dtype=_U), width - run + 1)
    text = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[: len(smallest)]
    s = np.flatnonzero(np.arange(len(smallest)) + width <= ends[text])
    if not len(s):
        return tuple(np.empty(0, np.int64) for _ in range(6))
    at, text = (smallest[s] & _LOW).astype(np.int64), text[s]
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])]))
    last = np.concatenate([first[1:], [len(s)]]) - 1
    a, b, t = s[first], s[last], text[first]
    begins = ends - np.diff(ends, prepend=0)
    return h[at[first]].view(np.int64), RollingHash(codes, 1).of(a, b + width).view(np.int64), t, a - begins[t], b - a + 1, at[first] - a


@dataclass(frozen=True)
class Units:
    """How texts are read: encode gives the codes of a text's units, cut stretches of it as bytes; codes and cut_bytes do so for such bytes."""

    encode: Callable[[str], np.ndarray]
    cut: Callable[[str, list[tuple[int, int]]], list[bytes]]
    codes: Callable[[bytes], np.ndarray]
    cut_bytes: Callable[[bytes, int, int], bytes]
    width: int
    run: int


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(_key, _row, _text) of the rows that have a key; _row is the hash of the text."""
    return docs.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.xxhash64(text).alias("_row"), F.col(text).alias("_text"))


def owner(across: bool) -> list[str]:
    """What tells documents apart: if across, rows of one key are one document."""
    return ["_key"] if across else ["_key", "_row"]


def anchor_rows(docs: DataFrame, units: Units) -> DataFrame:
    """Every occurrence in keyed() documents: anchor, context, _key, _row, start, windows, at."""
    width, run, encode = units.width, units.run, units.encode

    def parts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
        for i, t in enumerate(batch.column(2)):
            t = t.as_py()
            if t:
                codes = encode(t)
                for s in range(0, max(0, len(codes) - width + 1), BATCH):
                    yield i, s, codes[s : s + BATCH + width - 1]

    def rows(held: list[tuple[int, int, np.ndarray]], batch: pa.RecordBatch) -> pa.RecordBatch:
        ends = np.cumsum([len(c) for _, _, c in held])
        anchor, context, t, start, n, at = occurrences(np.concatenate([c for _, _, c in held]), ends, width, run)
        row, first = np.array([i for i, _, _ in held]), np.array([s for _, s, _ in held])
        of = pa.array(row[t])
        cols = [pa.array(anchor), pa.array(context), batch.column(0).take(of), batch.column(1).take(of), *(pa.array(x.astype(np.int32)) for x in (start + first[t], n, at))]
        return pa.RecordBatch.from_arrays(cols, names=["anchor", "context", "_key", "_row", "start", "windows", "at"])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, size = [], 0
            for p in parts(b):
                held.append(p)
                size += len(p[2])
                if size >= BATCH:
                    yield rows(held, b)
                    held, size = [], 0
            if held:
                yield rows(held, b)

    return docs.mapInArrow(go, f"anchor long, context long, _key {dict(docs.dtypes)['_key']}, _row long, start int, windows int, at int")


def shared_occurrences(docs: DataFrame, units: Units, across: bool) -> DataFrame:
    """Occurrences whose anchor occurs at least twice; if across, in at least two documents. A written table."""
    found = written(anchor_rows(docs, units), "anchors")
    several = F.min("_key") < F.max("_key") if across else F.count(F.lit(1)) > 1
    # written, so that the join has plain exchanges on both sides and Spark can split a frequent anchor's rows
    shared = written(found.groupBy("anchor").agg(several.alias("_several")).where("_several").select("anchor"), "anchor-names")
    return written(found.join(shared, "anchor"), "shared-anchors", discard=[found, shared])


def _wanted(rows: DataFrame, names: list[str], place: list[str], across: bool, deep: bool) -> DataFrame:
    """The passages that enter blocks: names, _key, place, rep (it stands for its context), split, and the blocks of its anchor or context that it enters.

    rows: every place of a passage, called by names (anchor and context, or a window's two hashes if deep); place tells
    where it is. If deep, only what several documents hold is wanted, and there is no block of the anchor.
    """
    own = owner(across)
    per = written(rows.groupBy(*names, *own).agg(F.min(F.struct(*place)).alias("lo"), F.max(F.struct(*place)).alias("hi"), F.count(F.lit(1)).alias("_n")), "passages")
    again = F.min("_key") < F.max("_key") if across else F.sum("_n") > 1
    each = per.groupBy(*names).agg(again.alias("again"), F.min(F.struct(*own)).alias("first"), F.count(F.lit(1)).alias("docs"))
    old = [per]
    if deep:
        each = each.where("again").select("*", F.lit(True).alias("split"), F.lit(True).alias("wide"))
    else:
        each = written(each, "contexts")
        crowd = each.groupBy(names[0]).agg((F.count(F.lit(1)) > SPLIT).alias("split"), (F.sum("docs") > SPLIT).alias("wide"))
        crowd = written(crowd.where("split or wide"), "crowded-anchors")
        old += [each, crowd]
        # written, so that the join has plain sides: few crowded anchors go to every task, rows of a frequent one can be split
        each = each.join(crowd, names[0], "left").select(*each.columns, *(F.coalesce(c, F.lit(False)).alias(c) for c in ("split", "wide")))
    each = written(each, "contexts", discard=old[1:])
    none, chunks = F.array().cast("array<int>"), F.greatest(F.lit(1), F.ceil(F.col("docs") / COPIES).cast("int"))
    chunk = F.array(F.when(F.col("wide"), F.pmod(F.xxhash64(*own), chunks).cast("int") + 1).otherwise(0))
    everywhere = F.concat(F.when(F.col("split"), none).otherwise(F.array(F.lit(0))), F.when(F.col("again") & F.col("wide"), F.sequence(F.lit(1), chunks)).otherwise(none))
    rep = F.struct(*own) == F.col("first")
    lo = F.struct("lo.*", rep.alias("rep"), F.when(rep, everywhere).otherwise(chunk).alias("blocks"))
    hi = F.struct("hi.*", F.lit(False).alias("rep"), chunk.alias("blocks"))
    alone = F.lit(not across) & rep & F.col("again") & (F.col("docs") == 1) & (F.col("hi") != F.col("lo"))
    joined = per.join(each, names).where(rep | F.col("again"))
    joined = joined.select(*names, "_key", "split", F.explode(F.when(alone, F.array(lo, hi)).otherwise(F.array(lo))).alias("_w"))
    return written(joined.select(*names, "_key", "split", "_w.*"), "wanted", discard=[per, each])


def with_spans(docs: DataFrame, wanted: DataFrame, units: Units) -> DataFrame:
    """Passages of level 0 with their units, as bytes, each cut from its own document."""
    fields = ["anchor", "context", "split", "rep", "blocks", "start", "at"]
    lists = wanted.groupBy("_key", "_row").agg(F.collect_list(F.struct(*fields, "windows")).alias("_wanted"))
    joined = docs.join(lists.hint("shuffle_hash"), ["_key", "_row"]).select("_key", "_row", "_text", "_wanted")
    width, cut = units.width, units.cut

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in enumerate(b.column(2)):
                w = b.column(3)[i].values
                start = w.field("start").to_pylist()
                spans = cut(t.as_py(), [(s, s + k + width - 1) for s, k in zip(start, w.field("windows").to_pylist(), strict=True)])
                at = pa.array(np.full(len(spans), i))
                cols = {x: w.field(x) for x in fields} | {"level": pa.array(np.zeros(len(spans), np.int32)), "span": pa.array(spans, pa.binary())}
                yield pa.RecordBatch.from_arrays([*(cols[x] for x in _NAMES[:-2]), b.column(0).take(at), b.column(1).take(at)], names=_NAMES)

    return joined.mapInArrow(go, f"{PASSAGE}, _key {dict(docs.dtypes)['_key']}, _row long")


def split_windows(spans: DataFrame, units: Units) -> DataFrame:
    """(_key, _row, anchor, context, at, h1, h2) of each window of the first passages of split anchors; at counts from the passage's beginning."""
    codes, width = units.codes, units.width

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in range(0, b.num_rows, 1000):
                some = b.slice(part, 1000)
                rows, at, h1, h2 = [], [], [], []
                for i, s in enumerate(some.column(4)):
                    c = codes(s.as_py())
                    h1.append(RollingHash(c).windows(width))
                    h2.append(RollingHash(c, 1).windows(width))
                    at.append(np.arange(len(h1[-1]), dtype=np.int32))
                    rows.append(np.full(len(h1[-1]), i))
                of = pa.array(np.concatenate(rows))
                cols = [*(some.column(k).take(of) for k in range(4)), pa.array(np.concatenate(at)), *(pa.array(np.concatenate(h).view(np.int64)) for h in (h1, h2))]
                yield pa.RecordBatch.from_arrays(cols, names=["_key", "_row", "anchor", "context", "at", "h1", "h2"])

    first = spans.where("split and rep").select("_key", "_row", "anchor", "context", "span")
    return first.mapInArrow(go, f"_key {dict(spans.dtypes)['_key']}, _row long, anchor long, context long, at int, h1 long, h2 long")


def window_passages(spans: DataFrame, windows: DataFrame, units: Units, across: bool) -> DataFrame:
    """Passages of level 1: windows that several first passages of split anchors hold, each document's with its own units."""
    wanted = _wanted(windows, ["h1", "h2"], ["_row", "anchor", "context", "at"], across, deep=True)
    passage = ["_key", "_row", "anchor", "context"]
    lists = wanted.groupBy(*passage).agg(F.collect_list(F.struct("h1", "h2", "rep", "blocks", "at")).alias("_w"))  # at most a passage's windows
    joined = lists.join(spans.where("split and rep").select(*passage, "span"), passage).select("_key", "_row", "span", "_w")
    width, cut = units.width, units.cut_bytes

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w, counts = b.column(3).flatten(), b.column(3).value_lengths().to_numpy()
            row = np.repeat(np.arange(b.num_rows), counts)
            held = b.column(2).to_pylist()
            span = [cut(held[i], f, f + width) for i, f in zip(row.tolist(), w.field("at").to_pylist(), strict=True)]
            n, of = len(row), pa.array(row)
            zero, yes = pa.array(np.zeros(n, np.int32)), pa.array(np.ones(n, bool))
            cols = [pa.array(np.ones(n, np.int32)), w.field("h1"), w.field("h2"), yes, w.field("rep"), w.field("blocks"), zero, zero, pa.array(span, pa.binary()), b.column(0).take(of), b.column(1).take(of)]
            yield pa.RecordBatch.from_arrays(cols, names=_NAMES)

    return written(joined.mapInArrow(go, f"{PASSAGE}, _key {dict(spans.dtypes)['_key']}, _row long"), "window-passages", discard=[wanted])


def in_blocks(passages: DataFrame, compare: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """compare() over blocks of passages, a block at a time."""
    rows = passages.agg(F.sum(F.size("blocks"))).first()[0] or 0
    n = max(1, -(-rows // BLOCK))
    dealt = passages.select(*(c for c in passages.columns if c not in ("blocks", "split", "rep")), F.explode("blocks").alias("_chunk"))
    name = F.xxhash64("level", "anchor", F.when(F.col("_chunk") > 0, F.col("context")), "_chunk")
    return dealt.groupBy(F.pmod(name, F.lit(n)).alias("block")).applyInArrow(lambda t: compare(t), schema)


def found_again(docs: DataFrame, units: Units, compare: Callable[[pa.Table], pa.Table], key: str, text: str, across: bool) -> DataFrame:
    """Spans (_key, _row, start, end) of the stretches that compare() finds in blocks, at every place of their passages.

    compare() gives (level, anchor, context, _key, _row, first, last) for the passages of a block that it finds again.
    """
    docs, own = keyed(docs, key, text), owner(across)
    shared = shared_occurrences(docs, units, across)
    wanted = _wanted(shared, ["anchor", "context"], ["_row", "start", "windows", "at"], across, deep=False)
    spans = written(with_spans(docs, wanted, units), "spans", discard=[wanted])
    old, every, windows = [shared, spans], spans, None
    if not spans.where("split").isEmpty():
        windows = written(split_windows(spans, units), "split-windows")
        deeper = window_passages(spans, windows, units, across)
        old += [windows, deeper]
        every = spans.unionByName(deeper)
    found = written(in_blocks(every, compare, f"level int, anchor long, context long, _key {dict(docs.dtypes)['_key']}, _row long, first int, last int"), "found")
    old.append(found)
    per = found.where("level = 0").select("anchor", "context", *own, "first", "last")
    if windows is not None:
        one = found.where("level = 1").groupBy(F.col("anchor").alias("h1"), F.col("context").alias("h2"), *own).agg(F.max("last").alias("last"))
        deep = windows.join(one, ["h1", "h2", *own]).select("anchor", "context", *own, F.col("at").alias("first"), (F.col("at") + F.col("last")).alias("last"))
        per = per.unionByName(deep)
    per = written(per.groupBy("anchor", "context", *own).agg(F.min("first").alias("first"), F.max("last").alias("last")), "found-in-passages")
    at = shared.join(per, ["anchor", "context", *own])
    at = at.select("_key", "_row", (F.col("start") + F.col("first")).alias("start"), (F.col("start") + F.col("last")).alias("end"))
    return written(at, "duplicate-spans", discard=[*old, per])


def beside(docs: DataFrame, spans: DataFrame, key: str, text: str) -> DataFrame:
    """docs and, as their last column, the spans of each: a sorted array, null if there are none. A document has at most one for each of its own positions."""
    k, row, out = (_free(docs, c) for c in ("_key", "_row", "_spans"))
    per = spans.groupBy(F.col("_key").alias(k), F.col("_row").alias(row)).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias(out))
    joined = docs.withColumns({k: F.col(key), row: F.xxhash64(text)}).join(per.hint("shuffle_hash"), [k, row], "left")
    return joined.select(*docs.columns, out)


def _free(docs: DataFrame, name: str) -> str:
    """name, with underscores before it until docs has no such column."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans joined where they touch."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def with_removals(docs: DataFrame, spans: DataFrame, key: str, text: str, schema: str, names: list[str], row: Callable[[str | None, list[tuple[int, int]]], tuple]) -> DataFrame:
    """docs' keys and row(text, merged spans) of every document."""
    joined = beside(docs.select(key, text), spans, key, text)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, s in zip(b.column(1), b.column(2), strict=True):
                out.append(row(t.as_py(), merged([(x["start"], x["end"]) for x in s.as_py() or []])))
            cols = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), wanted, strict=True)] if out else [pa.array([], f.type) for f in wanted]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=[key, *names])

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    wanted = to_arrow_schema(StructType.fromDDL(schema))
    kind = dict(docs.dtypes)[key]
    return joined.mapInArrow(go, f"`{key}` {kind}, {schema}")
