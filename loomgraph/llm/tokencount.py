"""Token counts of whole texts, huge ones encoded in overlapping chunks that are spliced where their tokens agree.

A text of at most `chunk` characters is encoded by itself. A longer one is cut into chunks, each of which starts `overlap`
characters early, and the chunks become rows of their own, so that one document is the work of many tasks. Every chunk
gives the tokens of its first and last overlap with their offsets. Two neighbours are spliced at a token that
both have at the same place of their common overlap; where they have none, the document is cut anew
with overlaps and chunks eight times as long, until one chunk holds it all.

Why a common token is a proven boundary: pieces merge in the order of (score, place), and what happens within a stretch that no
merge leaves depends on that stretch alone. So a sequence of tokens is the encoding of its text exactly if every two
neighbours in it are the encoding of their own text. Left of the common token, and with it, neighbours are those of the
first chunk's encoding; from it on, those of the second's. Hence the spliced sequence is the encoding of the whole.

The same argument lets short texts be encoded by their segments (the white space before a word, and the word), as long as
no piece of the vocabulary joins a character with white space behind it; the vocabulary is checked for that.

Null and empty texts have no tokens; texts of any length are counted whole. Repeated rows are counted one by one, copies of
a huge text are encoded once; a null id is an id like others. Other columns are not read, so that their names can't
clash; an empty table gives an empty one. Only models whose proof holds are taken, see Pieces.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from loomgraph.llm.common import written
from loomgraph.llm.memory import Memory, groups

#: Characters of a chunk, and by how many a chunk starts early.
CHUNK, OVERLAP = 16_384, 256
#: By what both grow for documents whose chunks don't agree.
WIDER = 8
#: Remembered segments per Python worker, and their longest; results do not depend on either.
REMEMBERED, SHORT = 400_000, 48
#: The mark that stands for a space.
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


class Pieces:
    """A byte-pair model of sentencepiece, given as the content of its file.

    Models with a normalisation of their own, without byte fallback, with user-defined or unused pieces, or not built by merging are refused:
    offsets or the proof of boundaries would not hold.
    """

    def __init__(self, model: bytes, remembered: int = REMEMBERED):
        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        spec, train = proto.normalizer_spec, proto.trainer_spec
        fit = train.model_type == train.BPE and train.byte_fallback and not train.treat_whitespace_as_suffix and not spec.precompiled_charsmap
        fit = fit and spec.add_dummy_prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces
        if not fit or {p.type for p in proto.pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only byte-pair models with byte fallback and without a normalisation of their own can be spliced")
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        #: Bytes of the normal form that a token stands for.
        self.bytes = np.array([1 if p.type == BYTE else len(p.piece.encode()) for p in proto.pieces], np.int64)
        #: Whether text can be cut before any white space: no piece holds another character before a mark.
        self.apart = not any(re.search(f"[^{MARK}]{MARK}", p.piece) for p in proto.pieces if p.type == NORMAL)
        #: The tokens of a mark that stands alone, which the library gives for no text.
        self.mark = self.ids("a ")[len(self.ids("a")) :]
        self.known = Memory(remembered)

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)

    @staticmethod
    def normal(text: str | None) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def tokens(self, piece: str, before: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of their first bytes) of a stretch of normal form that starts at byte `before`.

        The library puts a mark before what it encodes. Where the stretch has none, the first offset is before its start.
        """
        own = piece.startswith(MARK)
        ids = np.array(self.ids(piece[1:] if own else piece) if piece != MARK else self.mark, np.int64)
        ends = np.cumsum(self.bytes[ids])
        if len(ids) and ends[-1] != len(piece.encode()) + (0 if own else len(MARK.encode())):
            raise ValueError("tokens do not cover the text")
        return ids, ends - self.bytes[ids] + before - (0 if own else len(MARK.encode()))

    def learn(self, segments: list[str]) -> dict[str, int]:
        """Tokens of segments, each a run of marks and what follows it: encoded in one go, as nothing merges across their starts."""
        inner = [s for s in segments if s[-1] != MARK]
        out = {s: len(self.tokens(s)[0]) for s in segments if s[-1] == MARK}
        if inner:
            _, starts = self.tokens("".join(inner))
            borders = np.cumsum([len(s.encode()) for s in inner])
            at = np.searchsorted(starts, np.concatenate([[0], borders]))
            out.update(zip(inner, np.diff(at).tolist(), strict=True))
        return out

    def counts(self, texts: list[str | None]) -> Iterator[int]:
        for part in groups(texts):
            if not self.apart:
                yield from (len(self.ids(t)) if t else 0 for t in part)
                continue
            split = [Counter(re.findall(f"{MARK}+[^{MARK}]*", self.normal(t))) for t in part]
            every = set().union(*split)
            size = dict(self.known.fetch({s for s in every if len(s) <= SHORT}, self.learn))
            size.update(self.learn([s for s in every if len(s) > SHORT]))
            for c in split:
                yield sum(size[s] * n for s, n in c.items())


@lru_cache(maxsize=2)
def pieces(model: bytes) -> Pieces:
    return Pieces(model)


def cut(text: str, chunk: int, overlap: int) -> Iterator[tuple[int, int, int, int, str]]:
    """(number, first byte, bytes where the chunk's own part starts, bytes where the next one's overlap starts, stretch) of the normal form.

    The own part of the last chunk ends with the text; the number of bytes there stands for the next overlap.
    """
    at = np.arange(0, max(len(text), 1), chunk).tolist()
    size = lambda a, b: len(text[a:b].encode())
    begun = 0  # bytes before the own part
    for i, a in enumerate(at):
        first, end = max(0, a - overlap), min(a + chunk, len(text))
        own = size(a, end)
        late = size(a, end - overlap) if i + 1 < len(at) else own
        yield i, begun - size(first, a), begun, begun + late, text[first:end]
        begun += own


def chunked(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(key, i, last, first, own, late, part): chunks of the normal forms of docs (key, text), once for each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, text in zip(b.column(0), b.column(1), strict=True):
                # the columns of one document at a time, whatever the batch
                rows = list(cut(Pieces.normal(text.as_py()), chunk, overlap))
                i, first, own, late, part = zip(*rows, strict=True)
                n = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * n), pa.array(i, pa.int32()), pa.array([n - 1] * n, pa.int32()), *(pa.array(c, pa.int64()) for c in (first, own, late)), pa.array(part)], names=["key", "i", "last", "first", "own", "late", "part"])

    rows = docs.select("key", "text").mapInArrow(run, "key string, i int, last int, first long, own long, late long, part string")
    return rows.dropDuplicates(["key", "i"])


_ENDS = "head_ids array<int>, head_starts array<long>, tail_ids array<int>, tail_starts array<long>, tail_place array<int>, n int"


def encoded(chunks: DataFrame, model: bytes) -> DataFrame:
    """(key, i, last, ENDS): the tokens of each chunk's first overlap, those of its last one with their places, and the number of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for first, own, late, part in zip(*(b.column(i) for i in range(3, 7)), strict=True):
                ids, starts = p.tokens(part.as_py(), first.as_py())
                ends = starts + p.bytes[ids]
                head = int(np.searchsorted(ends, own.as_py(), "right"))  # a prefix of the tokens, with the artefact at the start
                tail = int(np.searchsorted(starts, late.as_py()))
                for c, v in zip(out, (ids[:head], starts[:head], ids[tail:], starts[tail:], np.arange(tail, len(ids)), len(ids)), strict=True):
                    c.append(v)
            kinds = (pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32())
            made = [pa.array([x.astype(k.value_type.to_pandas_dtype()) for x in c] if pa.types.is_list(k) else c, k) for c, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *made], names=["key", "i", "last", *(d.split()[0] for d in _ENDS.split(", "))])

    return chunks.select("key", "i", "last", "first", "own", "late", "part").mapInArrow(run, f"key string, i int, last int, {_ENDS}")


def common_token(tail: tuple, head: tuple) -> tuple[int, int] | None:
    """Places in (ids, starts) of the tail of a chunk and of the head of the next of their first common token; None if they have none."""
    both, a, b = np.intersect1d(tail[1], head[1], return_indices=True)
    same = np.flatnonzero(np.asarray(tail[0])[a] == np.asarray(head[0])[b])
    return (int(a[same[0]]), int(b[same[0]])) if len(same) else None


def spliced(parts: DataFrame) -> DataFrame:
    """(key, n_tokens): the tokens of a document from those of its chunks, which are read in order as a stream; null where two do not agree."""

    def count(rows) -> int | None:
        n, before = 0, None
        for last, head_ids, head_starts, tail_ids, tail_starts, tail_place, size in rows:
            start = 0
            if before is not None:
                found = common_token(before[:2], (head_ids, head_starts))
                if found is None:
                    for _ in rows:  # the rest of the document
                        pass
                    return None
                # up to the common token the tokens of the chunk before count, from there on this one's
                n += int(before[2][found[0]]) - before[3]
                start = found[1]
            before = (tail_ids, tail_starts, tail_place, start, size)
        return n + before[4] - before[3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((r["key"].as_py(), (r["last"].as_py(), *(r[k].values.to_numpy(zero_copy_only=False) for k in ("head_ids", "head_starts", "tail_ids", "tail_starts", "tail_place")), r["n"].as_py())) for b in batches for r in ({k: b.column(k)[i] for k in b.schema.names} for i in range(b.num_rows)))
        for key, mine in groupby(rows, lambda r: r[0]):
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([count(r[1] for r in mine)], pa.int64())], names=["key", "n_tokens"])

    return parts.repartition("key").sortWithinPartitions("key", "i").mapInArrow(run, "key string, n_tokens long")


def huge_counts(docs: DataFrame, model: bytes, chunk: int, overlap: int) -> DataFrame:
    """(key, n_tokens) of docs (key, text). Rounds end: the last has a document in one chunk, which needs no splice."""
    done: list[DataFrame] = []
    while True:
        got = written(spliced(encoded(chunked(docs, chunk, overlap), model)), "spliced", clean=False)
        done.append(got.where("n_tokens is not null"))
        if got.where("n_tokens is null").isEmpty():
            break
        docs = docs.join(got.where("n_tokens is null").select("key"), "key", "left_semi")
        chunk, overlap = chunk * WIDER, overlap * WIDER
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def counted(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", limit: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per row of docs: key, n_bytes (UTF-8), n_tokens as the library encodes the whole text, over_limit.

    model_path is a file on the driver; its content goes to the tasks.
    """
    if not 0 < 2 * overlap <= chunk:
        raise ValueError("a chunk must be at least two overlaps long")
    with open(model_path, "rb") as f:
        model = f.read()
    Pieces(model)  # refuses models that can't be spliced
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    huge = F.coalesce(F.length("text") >= chunk, F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for b in batches:
            n = pa.array(p.counts(b.column(2).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n], names=["id", "n_bytes", "n_tokens"])

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    short = rows.where(~huge).select("id", size, "text").mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    # copies of a text share its digest, so its chunks are encoded once
    long = rows.where(huge).select("id", size, F.sha2("text", 256).alias("key"), "text")
    found = huge_counts(long.select("key", "text"), model, chunk, overlap)
    both = short.unionByName(long.drop("text").join(found, "key").drop("key"))
    return both.select(F.col("id").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
