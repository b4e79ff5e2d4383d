"""Packing token sequences by shortest-pack-first over the histogram of lengths.

Lengths are placed longest first. A length with count c goes to the packing pattern that has most
room left; of a pattern that stands for m packs, min(c, m) packs get it and become a new pattern,
the other packs keep the old one; where no pattern has room, as many new packs are opened as the
pieces need by themselves. Only counts are
touched, so the driver's work depends on the number of different lengths (the capacity bounds it),
never on the number of documents. Patterns then go back to documents by rank: the r-th piece of a
length takes the r-th place that the patterns hold for this length.

Documents longer than the capacity are cut into full sequences and a rest. Every document has at
least its end id, so empty and null texts make one piece of length 1. Texts are never shortened, whatever their
length. Repeated rows and ids are packed one by one, and pieces of equal length and id are interchangeable; other
columns are not read; an empty table gives an empty one.
"""

from __future__ import annotations

import gc
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import written
from loomgraph.llm.memory import Memory, groups

CAPACITY = 4096
#: Id that ends every document.
END_ID = 2
#: Remembered words per Python worker; results do not depend on it. Fewer take less memory and more time.
REMEMBERED = 1_200_000
#: Salts per length when pieces are ranked, so that a frequent length is ranked by many tasks: this many, and more where a salt would get more than RANKED pieces.
SALTS, RANKED = 64, 200_000
#: Places of patterns up to which they go to every task.
FEW_PLACES = 200_000


class WordTokenizer:
    """Ids of a text as the concatenated ids of its chunks between ASCII white space.

    The tokenizer file drops white space before it merges, so no token crosses a chunk. Texts of ASCII and
    Latin letters, which are their own normal form, are lower-cased whole and split here; the pieces of
    chunks not met before go to the file's merge model. The library encodes the chunks of all other texts.
    """

    LATIN = re.compile(r"[\t-\r -~\u00a1-\u024f]*").fullmatch
    #: Fixed value: the pattern of the tokenizer file.
    SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.merge = self.whole.model.tokenize
        # the visible character that stands for each byte: itself if visible in Latin-1, else the next free one from 256 on
        visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [b for b in range(256) if b not in visible]
        self.stands_for = {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.known, self.pieces, self.others = Memory(remembered), Memory(remembered // 4), Memory(remembered // 8)

    def learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of lower-case Latin chunks. Chunks of letters, with one mark behind or without, need no pattern."""
        out, several, merge = {}, {}, self._merged
        for w in words:
            x = w.decode()
            if x.isalpha():
                out[w] = merge(x)
            elif x[-1] in ".,;:!?" and x[:-1].isalpha():
                several[w] = (x[:-1], x[-1])
            else:
                several[w] = self.SPLIT(x)
        if several:
            ids = self.pieces.fetch(set().union(*several.values()), lambda new: {p: merge(p) for p in new}).__getitem__
            for w, parts in several.items():
                out[w] = b"".join(map(ids, parts))
        return out

    def _merged(self, piece: str) -> bytes:
        seen = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.stands_for)
        return array("I", [t.id for t in self.merge(seen)]).tobytes()

    def learn_others(self, words: list[bytes]) -> dict[bytes, bytes]:
        return {w: array("I", self.whole.encode_batch_fast([w.decode()], add_special_tokens=False)[0].ids).tobytes() for w in words}

    def encode_all(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        for part in groups(texts, 4_000_000):
            # bytes split at ASCII white space only
            latin = [not t or self.LATIN(t) is not None for t in part]
            split = [(t.lower() if ok else t).encode().split() if t else [] for t, ok in zip(part, latin, strict=True)]
            ids = self.known.fetch(set().union(*(x for x, ok in zip(split, latin, strict=True) if ok)), self.learn)
            others = {} if all(latin) else self.others.fetch(set().union(*(x for x, ok in zip(split, latin, strict=True) if not ok)), self.learn_others)
            for x, ok in zip(split, latin, strict=True):
                yield b"".join(map((ids if ok else others).__getitem__, x))


@lru_cache(maxsize=1)
def tokenizer(path: str, remembered: int = REMEMBERED) -> WordTokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordTokenizer(path, remembered)


def pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """Tokenised documents cut at multiples of the capacity: key, start, length, ids_crc32, doc_tokens, and ids if asked for."""
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # nothing here makes cycles, and the remembered words are costly to walk
        try:
            t = tokenizer(path, remembered)
            for b in batches:
                yield cut(t, b)
        finally:
            gc.enable()

    def cut(t: WordTokenizer, b: pa.RecordBatch) -> pa.RecordBatch:
        row, start, length, crc, total, ids = [], [], [], [], [], []
        for i, x in enumerate(t.encode_all(b.column(1).to_pylist())):
            data = x + end
            n = len(data) // 4
            for s in range(0, n, capacity):
                part = data[4 * s : 4 * (s + capacity)]
                row.append(i)
                start.append(s)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
                total.append(n)
                if with_ids:
                    ids.append(np.frombuffer(part, "<u4").astype(np.int32))
        cols = [b.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
        names = [key, "start", "length", "ids_crc32", "doc_tokens"]
        if with_ids:
            cols.append(pa.array(ids, pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(cols, names=names)

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids)


def shortest_pack_first(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Packing patterns as (number of packs, ((length, times), ...)), longest length first within a pattern."""
    room: dict[int, dict[tuple, int]] = defaultdict(lambda: defaultdict(int))  # space left -> pattern -> packs
    spaces: set[int] = set()
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if length > capacity or length < 1:
            raise ValueError(f"length {length} is not in 1..{capacity}")
        while left:
            space = max(spaces, default=0)
            if space < length:
                # no more new packs than these pieces need by themselves; each gets one piece now, the others follow in turn
                fresh = -(-left // (capacity // length))
                room[capacity - length][((length, 1),)] += fresh
                spaces.add(capacity - length)
                left -= fresh
                continue
            pattern, packs = room[space].popitem()
            take = min(left, packs)
            if take < packs:
                room[space][pattern] = packs - take
            if not room[space]:
                del room[space]
                spaces.discard(space)
            last, times = pattern[-1]
            grown = (*pattern[:-1], (last, times + 1)) if last == length else (*pattern, (length, 1))
            room[space - length][grown] += take
            spaces.add(space - length)
            left -= take
    return [(packs, pattern) for at in sorted(room) for pattern, packs in sorted(room[at].items())]


def places(patterns: list[tuple[int, tuple[tuple[int, int], ...]]]) -> list[tuple[int, int, int, int, int, int]]:
    """Per pattern and length: (length, first rank, rank after the last, times, first sequence, offset).

    Rank r of the length stands in sequence first + (r - first rank) // times, at offset + length * ((r - first rank) % times).
    """
    out, used, first = [], defaultdict(int), 0
    for packs, pattern in patterns:
        offset = 0
        for length, times in pattern:
            out.append((length, used[length], used[length] + packs * times, times, first, offset))
            used[length] += packs * times
            offset += length * times
        first += packs
    return out


def ranked(df: DataFrame, length: str, order: list[str], salts: int = SALTS) -> DataFrame:
    """df with rank: 0, 1, ... within equal lengths. Ranks are given within salted groups and shifted by the sizes of those before."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    sizes = salted.groupBy(length, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(length).orderBy("_salt")) - F.col("_n")).drop("_n")
    own = Window.partitionBy(length, "_salt").orderBy(*order)
    return salted.withColumn("_own", F.row_number().over(own) - 1).join(before, [length, "_salt"]).withColumn("rank", F.col("_before") + F.col("_own")).drop("_salt", "_before", "_own")


def pack(parts: DataFrame, order: list[str], length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """parts with sequence_id and offset. `parts` is read three times, so hand in a written table.

    What is collected is the histogram: at most `capacity` rows. What is broadcast are the places of the
    patterns: their number follows the number of different lengths, not the number of pieces.
    """
    spark = parts.sparkSession
    histogram = {r[0]: r[1] for r in parts.groupBy(length).count().collect()}
    rows = places(shortest_pack_first(histogram, capacity))
    schema = "_length long, _first long, _end long, _times long, _sequence long, _offset long"
    where = spark.createDataFrame(rows, schema)
    if len(rows) <= FEW_PLACES:
        where = F.broadcast(where)
    r = F.col("rank") - F.col("_first")
    return (
        ranked(parts, length, order, max(SALTS, -(-max(histogram.values(), default=0) // RANKED)))
        .join(where, (F.col(length) == F.col("_length")) & (F.col("rank") >= F.col("_first")) & (F.col("rank") < F.col("_end")))
        .withColumn("sequence_id", F.col("_sequence") + F.expr("(rank - _first) div _times"))
        .withColumn("offset", F.col("_offset") + F.col(length) * (r % F.col("_times")))
        .drop("rank", "_length", "_first", "_end", "_times", "_sequence", "_offset")
    )


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """Pieces of all documents with their places. Tokenising is done once, into a written table."""
    parts = written(pieces(docs, path, capacity=capacity, with_ids=with_ids, remembered=remembered), "pieces")
    return pack(parts, ["doc_id", "start", "ids_crc32"], capacity=capacity)


def padding(lengths: list[int], capacity: int = CAPACITY) -> int:
    """Ids of padding when sequences are filled up to the capacity, except those whose length is a power of two."""
    return sum(0 if n & (n - 1) == 0 else capacity - n for n in lengths)


def gaps(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Places in a sequence that (offset, length) spans leave open before their end; used by tests."""
    spans = sorted(spans)
    return [(a + n, b) for (a, n), (b, _) in pairwise([(0, 0), *spans]) if a + n != b]
