"""Codes of vectors: each of four consecutive parts is named by the nearest entry of its codebook, which Lloyd's rounds have fitted.

Components are whole numbers, floor(1024 * x), so distances, sums and ties are exact. Every vector keeps, for each part,
an upper bound of the distance to its entry and a lower bound of that to any other one (Hamerly's bounds). After a round the bounds
are moved by as much as entries have moved, and rounded outwards. Where the upper bound is strictly below the lower one, or below
half of the entry's distance to its nearest fellow, the entry is the only nearest one and stays; else its distance is
worked out, and where that does not decide either, all entries are looked at, and of equally near ones the first is taken.

A round is one pass that writes vectors, entries and bounds anew and deletes the table before, and one pass of sums per entry, added up in
tasks first. Only codebooks reach the driver and go to the tasks: 256 entries of a vector's length, whatever the number of rows.

Rows whose vector is null, or holds a null, NaN or infinity, are left out. The length of the smallest remaining vec_id's vector that
four divides, and that is not 0, is that of the codebooks; rows of other lengths have a null code and error. Repeated vec_ids are coded
row by row, and start codebooks by vec_id, then vector, null ids last; fewer than 256 vectors make fewer entries. A null label is a
label of its own. Components too large for 64-bit distances are an error. Other columns are not read. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import dropped, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024.0


def _up(x):
    return np.nextafter(x, np.inf)


def _down(x):
    return np.nextafter(x, -np.inf)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows x (n, d) to entries c (k, d), as whole numbers; by floating products where these are exact, too."""
    most = int(max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)))
    bound = 4 * most * most * max(1, x.shape[1])
    if bound < 2**53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    if bound >= 2**63:
        raise ValueError("components are too large for 64-bit distances")
    return np.stack([((x - e) ** 2).sum(1) for e in c], 1)


def own_squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to the entry beside each."""
    if 4 * int(max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))) ** 2 * max(1, x.shape[1]) >= 2**63:
        raise ValueError("components are too large for 64-bit distances")
    return ((x - c) ** 2).sum(1)


class Codebook:
    """The entries of one part, how far they moved, and half of the distance from each to its nearest fellow (a lower bound)."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None):
        self.entries = entries
        apart = squared(entries, entries).astype(np.float64)
        np.fill_diagonal(apart, np.inf)
        self.half = _down(_down(np.sqrt(apart.min(1))) / 2)
        moved = np.zeros(len(entries)) if before is None else _up(np.sqrt(own_squared(entries, before).astype(np.float64)))
        moved[(entries == before).all(1) if before is not None else slice(0)] = 0.0
        self.moved = moved
        # the farthest that any entry but this one has moved
        order = np.argsort(-moved, kind="stable")
        self.others = np.full(len(entries), moved[order[0]])
        self.others[order[0]] = moved[order[1]] if len(entries) > 1 else 0.0

    def scan(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nearest entry, the first of equally near ones; upper bound; lower bound to any other)."""
        d = squared(x, self.entries)
        a = d.argmin(1)
        rows = np.arange(len(x))
        upper = _up(np.sqrt(d[rows, a].astype(np.float64)))
        if len(self.entries) == 1:
            return a, upper, np.full(len(x), np.inf)
        d[rows, a] = np.iinfo(np.int64).max
        return a, upper, np.maximum(_down(np.sqrt(d.min(1).astype(np.float64))), 0.0)

    def assign(self, x: np.ndarray, a: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same after entries have moved, and the rows that had to look at all entries."""
        upper, lower = _up(upper + self.moved[a]), _down(lower - self.others[a])
        limit = np.maximum(lower, self.half[a])
        open_ = np.flatnonzero(~(upper < limit))
        upper[open_] = _up(np.sqrt(own_squared(x[open_], self.entries[a[open_]]).astype(np.float64)))
        open_ = open_[~(upper[open_] < limit[open_])]
        a = a.copy()
        if len(open_):
            a[open_], upper[open_], lower[open_] = self.scan(x[open_])
        return a, upper, lower, open_


def _matrix(column: pa.Array, kind) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, k = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k), pa.int32()), pa.array(rows.ravel(), kind))


STATE = "v array<int>, entry array<int>, upper array<double>, lower array<double>, scans int"


def assigned(rows: DataFrame, books: list[Codebook]) -> DataFrame:
    """rows (vec_id, label, v, and after the first round entry, upper, lower) with STATE by the present codebooks; scans counts a row's parts that looked at all entries."""
    first = "entry" not in rows.columns
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = _matrix(b.column(2), np.int64)
            n, wide = len(v), v.shape[1] // PARTS
            entry, upper, lower, scanned = np.zeros((n, PARTS), np.int64), np.zeros((n, PARTS)), np.zeros((n, PARTS)), np.zeros(n, np.int32)
            old = None if first else [_matrix(b.column(3), np.int64), _matrix(b.column(4), np.float64), _matrix(b.column(5), np.float64)]
            for j, book in enumerate(books):
                x = v[:, j * wide : (j + 1) * wide]
                if first:
                    entry[:, j], upper[:, j], lower[:, j] = book.scan(x)
                    scanned += 1
                else:
                    entry[:, j], upper[:, j], lower[:, j], whole = book.assign(x, *(o[:, j] for o in old))
                    scanned[whole] += 1
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), _lists(entry, pa.int32()), _lists(upper, pa.float64()), _lists(lower, pa.float64()), pa.array(scanned)], names=["vec_id", "label", *(d.split()[0] for d in STATE.split(", "))])

    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, {STATE}")


def entry_sums(state: DataFrame) -> DataFrame:
    """(part, entry, at, total, n): sums of the parts of each entry by component, first within tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = count = None
        for b in batches:
            if not b.num_rows:
                continue
            v, a = _matrix(b.column(0), np.int64), _matrix(b.column(1), np.int64)
            wide = v.shape[1] // PARTS
            if total is None:
                total, count = np.zeros((PARTS, ENTRIES, wide), np.int64), np.zeros((PARTS, ENTRIES), np.int64)
            for j in range(PARTS):
                np.add.at(total[j], a[:, j], v[:, j * wide : (j + 1) * wide])
                count[j] += np.bincount(a[:, j], minlength=ENTRIES)
        if total is not None:
            j, e = np.nonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(j.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[j, e]), _lists(total[j, e], pa.int64())], names=["part", "entry", "n", "totals"])

    rows = state.select("v", "entry").mapInArrow(run, "part int, entry int, n long, totals array<long>")
    return rows.select("part", "entry", "n", F.posexplode("totals").alias("at", "total")).groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, v): vectors of finite components as whole numbers."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    small = F.forall(x, lambda c: F.abs(c) < 2.0**20)
    whole = F.col("embedding").isNotNull() & finite
    rows = embeddings.where(whole)
    # the condition stands here again: filters on v may be worked out before the one above
    v = F.when(whole & small, F.transform(x, lambda c: F.floor(c * SCALE).cast("int"))).when(whole, F.raise_error(F.lit("components are too large for 64-bit distances")))
    return rows.select("vec_id", "label", v.alias("v"))


def vector_codes(embeddings: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of embeddings (vec_id, label, embedding); at most 256 entries a codebook."""
    if not 1 <= entries <= ENTRIES:
        raise ValueError(f"codebooks have 1 to {ENTRIES} entries")
    rows = whole_vectors(embeddings)
    order = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    lead = rows.where(f"size(v) > 0 and size(v) % {PARTS} = 0").orderBy(*order).select("v").first()
    size = len(lead["v"]) if lead else 0
    fit = rows.where(F.size("v") == size) if size else rows.limit(0)
    # the first entries: as many rows as a codebook has
    start = [r["v"] for r in fit.orderBy(*order).select("v").limit(entries).collect()]
    wide = size // PARTS
    points = np.array(start, np.int64).reshape(len(start), size)
    values = [points[:, j * wide : (j + 1) * wide] for j in range(PARTS)]
    digest, state = hashlib.sha256(), None
    if size:
        books = [Codebook(v) for v in values]
        for k in range(rounds + 1):
            state = written(assigned(fit if state is None else state.drop("scans"), books), "codes", discard=[state] if state is not None else [], clean=False)
            if k < rounds:
                new = [v.copy() for v in values]
                for r in entry_sums(state).collect():  # at most 256 entries of a vector's length
                    new[r["part"]][r["entry"], r["at"]] = r["total"] // r["n"]
                books = [Codebook(v, old) for v, old in zip(new, values, strict=True)]
                values = new
        digest.update(",".join(str(x) for v in values for x in v.ravel().tolist()).encode())
    coded = _coded(state, values) if size else rows.limit(0).select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    other = rows.where(F.size("v") != size) if size else rows
    every = coded.unionByName(other.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")))
    by_label = every.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    out = every.join(by_label, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest.hexdigest()).alias("codebooks_sha256"))


def _coded(state: DataFrame, values: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code, error) of assigned vectors."""
    kinds = dict(state.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v, a = _matrix(b.column(2), np.int64), _matrix(b.column(3), np.int64)
            wide = v.shape[1] // PARTS
            error = sum(own_squared(v[:, j * wide : (j + 1) * wide], values[j][a[:, j]]) for j in range(PARTS))
            codes = [bytes(r).hex() for r in a.astype(np.uint8).tolist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(codes), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return state.select("vec_id", "label", "v", "entry").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")
