"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of TABLES tables hashes a unit vector by HASHES functions floor((a . v + b) / WIDTH) with Gaussian a.
A query visits its own bucket and then perturbed ones (a hash value one lower or higher) in the order of
their estimated success, which is the sum of squared distances to the crossed borders. Candidates of all
tables are merged, and ranked by the exact cosine of the original vectors in double precision.

A query whose buckets leave it fewer than k neighbours, or whose dimension has at most FEW entries, is compared
with all entries of its dimension in blocks instead, so it gets all others where there are fewer than k.

Equal vectors are one entry with its smallest ids, so a vector that many rows repeat is hashed and compared once.
Buckets are spread over groups of about GROUP rows, large ones over several shards. Parameters are fixed and
do not depend on the data; recall on the sf0.01 table is measured in tests/llm.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, as
rows with a null id; vectors of different dimensions are never compared; ties go to the smaller id; repeated rows
of an id count once; vectors of any length are read whole; an empty table gives an empty result; other columns are not
read, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import written

TABLES, HASHES, WIDTH, PROBES = 16, 6, 1.5, 40
GROUP = 16_384
#: Up to so many entries of a dimension, hashing spares nothing.
FEW = 64
SEED = 31


def functions(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The directions (TABLES, HASHES, dim) and offsets of all tables for vectors of a dimension."""
    rng = np.random.default_rng((SEED, dim))
    return rng.normal(size=(TABLES, HASHES, dim)), rng.random((TABLES, HASHES)) * WIDTH


def bucket_ids(values: np.ndarray) -> np.ndarray:
    """A 64-bit number for each row of hash values."""
    h = np.zeros(values.shape[:-1], np.uint64)
    for k in range(values.shape[-1]):
        h = (h ^ values[..., k].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def perturbations(low: np.ndarray, probes: int) -> list[list[tuple[int, int]]]:
    """Sets of (hash, -1 or +1), most likely first; low: distance of the query to each hash's lower border, from 0 to WIDTH."""
    m = len(low)
    moves = sorted([(low[i] ** 2, i, -1) for i in range(m)] + [((WIDTH - low[i]) ** 2, i, 1) for i in range(m)])
    cost = [x[0] for x in moves]
    out: list[list[tuple[int, int]]] = [[]]
    heap = [(cost[0], (0,))]
    while heap and len(out) < probes:
        total, chosen = heapq.heappop(heap)
        last = chosen[-1]
        if last + 1 < 2 * m:  # the last move replaced by the next, or the next one added
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*chosen, last + 1)))
        hashes = [moves[k][1] for k in chosen]
        if len(set(hashes)) == len(hashes):  # a hash does not move both ways
            out.append([(moves[k][1], moves[k][2]) for k in chosen])
    return out


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): rows that take part, vectors as doubles."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    some = F.exists(v, lambda x: x != 0)
    # -0.0 becomes 0.0, so that equal vectors are equal as keys
    return rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & finite & some).select(F.col(key).alias("id"), F.transform(v, lambda x: x + 0.0).alias("v")).distinct()


def _unit(vectors: list) -> np.ndarray:
    x = np.stack([v.values.to_numpy() for v in vectors])
    x = x / np.abs(x).max(1)[:, None]  # else squares of very small or large numbers are lost
    return x / np.sqrt((x * x).sum(1))[:, None]


def _by_dim(batch: pa.RecordBatch, at: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) of each dimension in a batch."""
    vectors = list(batch.column(at))
    dims = np.array([len(v.values) for v in vectors])
    for d in np.unique(dims):
        rows = np.flatnonzero(dims == d)
        yield rows, _unit([vectors[i] for i in rows])


def indexed(entries: DataFrame, vectors: str | None = None) -> DataFrame:
    """Each entry (rep, v) once for every table: dim, table, bucket, rep, and v with elements of the type `vectors`, if given. float is exact for what was read as float."""
    n_columns = 5 if vectors else 4
    sent = pa.list_(pa.float32() if vectors == "float" else pa.float64())

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, x in _by_dim(b, 1):
                a, offset = functions(x.shape[1])
                for t in range(TABLES):
                    bucket = bucket_ids(np.floor((x @ a[t].T + offset[t]) / WIDTH))
                    part = b.take(pa.array(rows))
                    n = len(rows)
                    cols = [pa.array(np.full(n, x.shape[1], np.int32)), pa.array(np.full(n, t, np.int32)), pa.array(bucket), part.column(0), part.column(1).cast(sent)]
                    yield pa.RecordBatch.from_arrays(cols[:n_columns], names=["dim", "table", "bucket", "rep", "v"][:n_columns])

    return entries.select("rep", "v").mapInArrow(go, f"dim int, table int, bucket long, rep {dict(entries.dtypes)['rep']}" + (f", v array<{vectors}>" if vectors else ""))


def probed(queries: DataFrame, groups: int) -> DataFrame:
    """For each query entry, table and group: the buckets to visit there."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, x in _by_dim(b, 1):
                a, offset = functions(x.shape[1])
                for t in range(TABLES):
                    f = (x @ a[t].T + offset[t]) / WIDTH
                    home = np.floor(f)
                    at, group, buckets = [], [], []
                    for i, row in enumerate(rows):
                        values = np.repeat(home[i][None], PROBES, 0)
                        moves = perturbations((f[i] - home[i]) * WIDTH, PROBES)
                        for p, chosen in enumerate(moves):
                            for h, d in chosen:
                                values[p, h] += d
                        ids = bucket_ids(values[: len(moves)])
                        of = ids % groups
                        for g in np.unique(of):
                            at.append(row)
                            group.append(g)
                            buckets.append(ids[of == g])
                    part = b.take(pa.array(at, pa.int64()))
                    n = len(at)
                    cols = [pa.array(np.full(n, x.shape[1], np.int32)), pa.array(np.full(n, t, np.int32)), pa.array(np.array(group, np.int32)), part.column(0), part.column(1), pa.array(buckets, pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(cols, names=["dim", "table", "group", "query", "q", "buckets"])

    kind = dict(queries.dtypes)["rep"]
    return queries.select("rep", "v").mapInArrow(go, f"dim int, table int, `group` int, query {kind}, q array<double>, buckets array<long>")


def _ranked(entries: pa.Table, probes: pa.Table, k: int) -> pa.Table:
    """The k nearest entries of a group for each query that visits it."""
    names = ["query", "rep", "score"]
    if not entries.num_rows or not probes.num_rows:
        return pa.table([pa.array([], probes.schema.field("query").type), pa.array([], probes.schema.field("query").type), pa.array([], pa.float64())], names=names)
    entries = entries.sort_by([("bucket", "ascending"), ("rep", "ascending")])
    bucket = entries.column("bucket").to_numpy()
    vectors = entries.column("v").combine_chunks()
    x = vectors.values.to_numpy().astype(np.float64, copy=False).reshape(len(bucket), -1)
    norm = np.sqrt((x * x).sum(1))
    order = np.arange(len(bucket))
    reps = entries.column("rep").to_numpy()
    query, rep, score = [], [], []
    for i, (q, buckets) in enumerate(zip(probes.column("q"), probes.column("buckets"), strict=True)):
        q, visit = q.values.to_numpy(), buckets.values.to_numpy()
        first, last = np.searchsorted(bucket, visit, "left"), np.searchsorted(bucket, visit, "right")
        rows = np.concatenate([order[a:b] for a, b in zip(first, last, strict=True)])
        if len(rows):
            s = (x[rows] * q).sum(1) / (norm[rows] * np.sqrt((q * q).sum()))
            best = np.lexsort((reps[rows], -s))[:k] if len(s) <= 4 * k else None
            if best is None:
                near = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
                best = near[np.lexsort((reps[rows[near]], -s[near]))[:k]]
            query += [i] * len(best)
            rep.append(rows[best])
            score.append(s[best])
    at = pa.array(np.concatenate(rep) if rep else np.empty(0, np.int64))
    return pa.table([probes.column("query").take(pa.array(query, pa.int64())), entries.column("rep").take(at), pa.array(np.concatenate(score) if score else np.empty(0))], names=names)


def _top(found: DataFrame, k: int) -> DataFrame:
    """The k nearest entries of each query among what the groups found."""
    top = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    return found.groupBy("query", "rep").agg(F.max("score").alias("score")).withColumn("_n", F.row_number().over(top)).where(F.col("_n") <= k).drop("_n")


def scanned(entries: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest of all entries of its dimension for each query entry, exactly: blocks of entries meet blocks of queries."""
    kind = dict(entries.dtypes)["rep"]
    queries = queries.select("rep", "v", F.size("v").alias("dim"))
    entries = entries.select("rep", "v", F.size("v").alias("dim")).join(queries.select("dim").distinct(), "dim", "left_semi")
    most = lambda df: -(-(df.groupBy("dim").count().agg(F.max("count")).first()[0] or 1) // GROUP)
    block = lambda n: F.pmod(F.xxhash64("rep"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    blocks, parts = most(entries), most(queries)
    # one bucket, which all queries visit
    index = entries.withColumns({"bucket": F.lit(0).cast("long"), "block": block(blocks)}).withColumn("part", every(parts))
    probes = queries.select("dim", F.col("rep").alias("query"), F.col("v").alias("q"), F.array(F.lit(0).cast("long")).alias("buckets"), block(parts).alias("part")).withColumn("block", every(blocks))
    by = ["dim", "block", "part"]
    found = index.groupBy(*by).cogroup(probes.groupBy(*by)).applyInArrow(lambda a, b: _ranked(a, b, k), f"query {kind}, rep {kind}, score double")
    return _top(found, k)


def nearest(rows: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each query row its k nearest other rows: query_id, rank, key, score."""
    kind = dict(rows.dtypes)[key]
    all_rows = usable(rows, key, vector)
    # k + 1 ids of a vector are enough, as a query leaves out only itself; the rank limit prunes before the shuffle
    least = all_rows.withColumn("_n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("_n") <= k + 1)
    entries = written(least.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("rep", F.col("ids")[0]), "vectors")
    asked = all_rows.withColumnRenamed("id", key).where(is_query).withColumnRenamed(key, "query_id")
    asked = written(asked.join(entries.select("v", "rep"), "v").select("query_id", "rep"), "queries")
    groups = max(1, -(-entries.count() // GROUP))
    # bucket sizes come without the vectors, which go once through the shuffle to their groups and are not written for each table
    most = indexed(entries).groupBy("dim", "table", "bucket").count().agg(F.max("count")).first()[0] or 0
    # sent once for each table, so in the type that they were read in
    single = dict(rows.dtypes)[vector] == "array<float>"
    index = indexed(entries, "float" if single else "double").withColumn("group", F.expr(f"cast(pmod(bucket, {groups}) as int)"))
    shards = max(1, -(-most // GROUP))
    index = index.withColumn("shard", F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("int"))
    to = asked.select("rep").distinct().join(entries, "rep").select("rep", "v")
    probes = probed(to, groups).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    by = ["dim", "table", "group", "shard"]
    found = index.groupBy(*by).cogroup(probes.groupBy(*by)).applyInArrow(lambda a, b: _ranked(a, b, k + 1), f"query {kind}, rep {kind}, score double")
    merged = written(_top(found, k + 1), "nearest")

    def paired(merged: DataFrame) -> DataFrame:
        ids = merged.join(entries.select("rep", "ids"), "rep").select("query", "score", F.explode("ids").alias(key))
        return asked.join(ids, asked["rep"] == ids["query"]).where(F.col(key) != F.col("query_id"))

    enough = paired(merged).groupBy("query_id").count().where(F.col("count") >= k)
    few = entries.groupBy(F.size("v").alias("dim")).count().where(F.col("count") <= FEW)
    short = asked.join(enough, "query_id", "left_anti").select("rep").union(to.withColumn("dim", F.size("v")).join(few, "dim", "left_semi").select("rep"))
    short = written(to.join(short, "rep", "left_semi"), "short")
    if not short.isEmpty():
        exact = scanned(entries, short, k + 1)
        merged = merged.join(short.select(F.col("rep").alias("query")), "query", "left_anti").unionByName(exact)
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return paired(merged).withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), key, "score")
