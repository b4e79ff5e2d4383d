"""Near-duplicate detection by MinHash bands and odd sketches.

A document's set holds its distinct shingles. Documents with one set are one class. Class representatives
meet in the bands of their MinHash signatures; what meets is compared by odd sketches first: one-permutation
MinHash samples folded into a parity bitmap, where the population count of the exclusive or of two bitmaps
tells how many samples differ. Pairs that pass are confirmed on full sets, and links are contracted to
components, round by round:

* In star rounds the members of a band are compared with one of them, so a group of n near copies costs n
  comparisons. Bands whose members are in one component already are done with.
* Then the members outside a band's largest component are compared with all others of the band, in tiles of
  bounded size; each pair once, in the first band that the two share. Pairs that the sketches let pass leave
  the tile to be confirmed; of members with many such partners only links do, one for each other component.

With 32 bands of 4 rows a pair at the threshold 0.8 is missed with probability 5e-8; the sketch filter
lets pass what is within 4.5 standard deviations of the threshold.

Defined results: words are cut at ASCII white space, A-Z are folded; texts with fewer words than a shingle
have their whole sequence as one; null and blank texts have an empty set and are linked with nothing, as
are rows with a null id; repeated rows are copies of each other; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import dropped, partitions, written

BANDS, ROWS = 32, 4
#: One-permutation samples, and bits of the parity bitmap.
BINS, BITS = 512, 1024
#: Comparisons with one member of each band before the rest is compared in full; the last are left out where few links are left to find.
STARS = 3
#: Members on each side of a tile, and their shingles: full sets of at most so many come to one task.
BLOCK, WEIGHT = 2048, 4_000_000
#: Standard deviations by which the sketches may be off.
MARGIN = 4.5
#: Partners of one member in a tile that leave it as pairs; more are confirmed within the tile.
FEW = 32
TILE, TILE_SCHEMA = ("band", "left", "right"), "band long, left int, right int"
PERCENT = 80
#: Shingles handled at once.
BATCH = 1 << 20

_U = np.uint64
_A = np.random.default_rng(97).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * _U(2) + _U(1)
_B = np.random.default_rng(98).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def shingles(text: str | None, size: int) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, _U)
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))
    n = min(size, len(codes))
    h = np.full(len(codes) - n + 1, n, _U)
    for k in range(n):
        h = _mixed(h * _U(0x9E3779B97F4A7C15) + codes[k : len(codes) - n + 1 + k])
    return np.unique(h)


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(band hashes, parity bitmaps as bytes, numbers of samples) of non-empty sets, a row each."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    h, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum(size)[:-1]])
    band = np.zeros((n, BANDS), _U)
    for k in range(BANDS * ROWS):
        b = k // ROWS
        band[:, b] = _mixed(band[:, b] * _U(0x9E3779B97F4A7C15) + np.minimum.reduceat(h * _A[k] + _B[k], starts) + _U(b))
    # sets are sorted, so the first hash with given top bits is its bin's sample
    row = np.repeat(np.arange(n), size)
    place = row * BINS + (h >> _U(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    bit = row[first] * BITS + (_mixed(h[first] + _U(1)) % _U(BITS)).astype(np.int64)
    odd = (np.bincount(bit, minlength=n * BITS) & 1).astype(np.uint8).reshape(n, BITS)
    return band, np.packbits(odd, axis=1), np.bincount(row[first], minlength=n)


def signature_rows(docs: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """Per document: key, n_shingles, two hashes of the set, bands, sketch and samples."""

    def rows(keys: pa.Array, at: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        n = np.array([len(s) for s in sets], np.int64)
        full = [s for s in sets if len(s)]
        band, sketch, samples = signatures(full) if full else (np.zeros((0, BANDS), _U), np.zeros((0, BITS // 8), np.uint8), np.zeros(0, np.int64))
        where = np.cumsum(n > 0) - 1
        marks = [(int(s.sum(dtype=_U)), int(_mixed(s).sum(dtype=_U))) for s in sets]
        one, two = (pa.array(np.array([m[k] for m in marks], _U).view(np.int64)) for k in (0, 1))
        bands = pa.array([band[w].view(np.int64) if k else None for k, w in zip(n, where, strict=True)], pa.list_(pa.int64()))
        words = pa.array([sketch[w].view(np.int64) if k else None for k, w in zip(n, where, strict=True)], pa.list_(pa.int64()))
        count = pa.array([int(samples[w]) if k else 0 for k, w in zip(n, where, strict=True)], pa.int32())
        return pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), pa.array(n), one, two, bands, words, count], names=[key, "n_shingles", "set1", "set2", "bands", "sketch", "samples"])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, sets, total = [], [], 0
            for i, t in enumerate(b.column(1)):
                sets.append(shingles(t.as_py(), size))
                at.append(i)
                total += len(sets[-1])
                if total >= BATCH:
                    yield rows(b.column(0), at, sets)
                    at, sets, total = [], [], 0
            if at:
                yield rows(b.column(0), at, sets)

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(go, f"`{key}` {kind}, n_shingles long, set1 long, set2 long, bands array<long>, sketch array<long>, samples int")


def set_rows(docs: DataFrame, ids: DataFrame, size: int, key: str, text: str) -> DataFrame:
    """(id, set) of the documents named by ids: their full sets of shingle hashes."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py(), size).view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "set"])

    kind = dict(docs.dtypes)[key]
    found = docs.select(F.col(key).alias("id"), text).join(ids.hint("shuffle_hash"), "id", "left_semi")
    return found.mapInArrow(go, f"id {kind}, set array<long>").dropDuplicates(["id"])


def _most(samples_a, samples_b, percent: int, sqrt, greatest, least, power):
    """The largest population count at which two sets may still reach the threshold."""
    # of the bins that either fills, a share 1 - J differs, and each such bin toggles two bits at most
    either = least(greatest(samples_a, samples_b) * (200.0 / (100 + percent)), BINS * 1.0)
    apart = 2 * either * (1 - percent / 100)
    expected = BITS / 2 * (1 - power(1 - 2 / BITS, apart))
    # sampling of bins, and bits that meet in the bitmap
    spread = sqrt(4 * either * (percent / 100) * (1 - percent / 100) + expected / 2 + 1)
    return expected + MARGIN * spread


def may_link(percent: int) -> Column:
    """Whether the sketches of a pair (sketch_a, samples_a, n_a and the same of b) allow a link."""
    apart = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    most = _most(F.col("samples_a"), F.col("samples_b"), percent, F.sqrt, F.greatest, lambda a, b: F.least(a, F.lit(b)), lambda a, b: F.pow(F.lit(a), b))
    return (apart <= most) & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    b = sets.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
    a = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a"))
    both = pairs.join(b, "b").join(a, "a")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return both.select("a", "b", common.alias("_common"), (F.size("set_a") + F.size("set_b")).alias("_sizes")).where(100 * F.col("_common") >= percent * (F.col("_sizes") - F.col("_common"))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of the edges (a, b): the smallest node of its component.

    Each round takes the least label around a node, then the label of that label, so paths shorten by half.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges", clean=False)
    labels = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels", clean=False)
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        low = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "near").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("label").alias("up"))
        new = written(low.join(up, "low").select("node", F.col("label").alias("_was"), F.least("low", "up").alias("label")), "labels", discard=[labels], clean=False)
        moved = new.where(F.col("label") != F.col("_was")).limit(1).count()
        labels = new.drop("_was")
        if not moved:
            dropped(both)
            return labels


class Tile:
    """Members of a band that meet in one block: minor ones (left) against others (right), and among themselves if `inner`."""

    def __init__(self, table: pa.Table, percent: int):
        self.band = table.column("band")[0].as_py()
        self.ids, self.label = table.column("id").to_numpy(), table.column("label").to_numpy()
        self.left = table.column("side").to_numpy() == 0
        self.inner = table.column("inner")[0].as_py()
        self.sketch = np.stack([s.values.to_numpy() for s in table.column("sketch")]).view(np.uint64)
        self.bands = np.stack([s.values.to_numpy() for s in table.column("bands")])
        self.samples, self.n = table.column("samples").to_numpy().astype(float), table.column("n_shingles").to_numpy()
        self.percent, self.at = percent, int(np.flatnonzero(self.bands[0] == self.band)[0])

    def partners(self, i: int) -> np.ndarray:
        """Members of other components that member i may be linked with, by size and sketch, and meets in no earlier band."""
        other = (~self.left | (self.ids > self.ids[i])) if self.inner else ~self.left
        j = np.flatnonzero(other & (self.label != self.label[i]) & (100 * np.minimum(self.n, self.n[i]) >= self.percent * np.maximum(self.n, self.n[i])))
        if len(j):
            apart = np.bitwise_count(self.sketch[j] ^ self.sketch[i]).sum(1)
            j = j[apart <= _most(self.samples[j], self.samples[i], self.percent, np.sqrt, np.maximum, np.minimum, np.power)]
            j = j[~(self.bands[j, : self.at] == self.bands[i, : self.at]).any(1)]
        return j


def _candidates(table: pa.Table, percent: int) -> pa.Table:
    """Pairs (a, b) of a tile that the sketches let pass; of a member with more than FEW of them one row (a, a)."""
    tile = Tile(table, percent)
    out = []
    for i in np.flatnonzero(tile.left):
        j = tile.partners(i)
        if len(j) > FEW:
            j = np.array([i])
        out.append(np.stack([np.minimum(tile.ids[i], tile.ids[j]), np.maximum(tile.ids[i], tile.ids[j])], 1))
    pairs = np.concatenate(out) if out else np.empty((0, 2), np.int64)
    tags = [table.column(c).take(pa.array(np.zeros(len(pairs), np.int64))) for c in TILE]
    return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), *tags], names=["a", "b", *TILE])


def _settled(table: pa.Table, percent: int) -> pa.Table:
    """Links of a tile's members with many partners, confirmed here on full sets: one for each component that a member is linked with."""
    tile = Tile(table, percent)
    # sets are sorted as numbers without a sign
    sets = [s.values.to_numpy().view(np.uint64) for s in table.column("set")]
    out = []
    for i in np.flatnonzero(table.column("many").to_numpy(zero_copy_only=False)):
        j = tile.partners(i)
        for label in np.unique(tile.label[j]):
            of = j[tile.label[j] == label]
            # blocks of partners, the most alike first, so a link is mostly found in the first block
            of = of[np.argsort(np.bitwise_count(tile.sketch[of] ^ tile.sketch[i]).sum(1), kind="stable")]
            for s in range(0, len(of), FEW):
                some = of[s : s + FEW]
                flat = np.concatenate([sets[k] for k in some])
                at = np.searchsorted(sets[i], flat)
                same = sets[i][np.minimum(at, len(sets[i]) - 1)] == flat
                size = np.array([len(sets[k]) for k in some])
                common = np.add.reduceat(same, np.cumsum(size) - size, dtype=np.int64)
                hit = np.flatnonzero(100 * common >= percent * (size + len(sets[i]) - common))
                if len(hit):
                    out.append((tile.ids[i], tile.ids[some[hit[0]]]))
                    break
    cols = np.array(out, np.int64).reshape(-1, 2)
    return pa.table([pa.array(cols[:, 0]), pa.array(cols[:, 1])], names=["a", "b"])


def _tiles(now: DataFrame) -> DataFrame:
    """Members (band, id, label, n_shingles) of bands with several components, once for each tile: left, right, side, inner.

    Members outside of the band's largest component are minor. They are cut into m chunks, the others into b
    blocks, so many that neither the members of one nor their shingles are too much for a task: tile (i, r) has chunk i on the left and, on the right, block r if r < b, else chunk r - b. Chunks meet
    themselves and each later one; with one chunk that happens in tile (0, 0).
    """
    count = now.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("weight"))
    per = count.groupBy("band").agg(F.max(F.struct("n", "label", "weight")).alias("top"), F.sum("n").alias("all"), F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    size = lambda n, weight: F.ceil(F.greatest(n / BLOCK, weight / WEIGHT)).cast("int")
    per = per.select("band", F.col("top.label").alias("major"), size(F.col("top.n"), F.col("top.weight")).alias("b"), size(F.col("all") - F.col("top.n"), F.col("weight") - F.col("top.weight")).alias("m"))
    per = written(per, "open-bands", clean=False)
    one = now.join(per, "band").withColumn("minor", F.col("label") != F.col("major")).withColumn("_c", F.pmod(F.xxhash64("id"), F.when(F.col("minor"), F.col("m")).otherwise(F.col("b"))).cast("int"))
    c, b, m = F.col("_c"), F.col("b"), F.col("m")

    def tile(left, right, side, inner):
        return F.struct(left.cast("int").alias("left"), right.cast("int").alias("right"), F.lit(side).alias("side"), inner.alias("inner"))

    no, alone = F.lit(False), m == 1
    with_blocks = F.transform(F.sequence(F.lit(0), b - 1), lambda r: tile(c, r, 0, alone & (r == 0)))
    among = F.when(alone, F.array().cast("array<struct<left:int,right:int,side:int,inner:boolean>>")).otherwise(
        F.concat(
            F.array(tile(c, b + c, 0, F.lit(True))),
            F.transform(F.filter(F.sequence(F.lit(0), m - 1), lambda k: k > c), lambda k: tile(c, b + k, 0, no)),
            F.transform(F.filter(F.sequence(F.lit(0), m - 1), lambda k: k < c), lambda k: tile(k, b + c, 1, no)),
        )
    )
    # a block's tiles beside (0, 0) hold no inner pairs; in (0, 0) the flag is the tile's, so it stands on both sides
    as_block = F.transform(F.sequence(F.lit(0), m - 1), lambda k: tile(k, c, 1, alone & (c == 0)))
    return one.select("band", "id", "label", F.explode(F.when(F.col("minor"), F.concat(with_blocks, among)).otherwise(as_block)).alias("t")).select("band", "id", "label", "t.*")


def _relabelled(labels: DataFrame, links: DataFrame, old: DataFrame) -> DataFrame:
    """labels (id, label) after links (a, b) between ids."""
    a = labels.select(F.col("id").alias("a"), F.col("label").alias("la"))
    b = labels.select(F.col("id").alias("b"), F.col("label").alias("lb"))
    edges = written(links.join(a, "a").join(b, "b").select(F.col("la").alias("a"), F.col("lb").alias("b")).where("a <> b").distinct(), "label-edges", clean=False)
    if edges.isEmpty():
        return labels
    to = components(edges)
    new = labels.join(to, labels["label"] == to["node"], "left").select("id", F.coalesce(to["label"], labels["label"]).alias("label"))
    return written(new, "labels", discard=[old, to, edges], clean=False)


def classes(docs: DataFrame, size: int = 5, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key (a long), n_shingles, component_id, kept (the one document of its component that stays)."""
    all_rows = written(signature_rows(docs, size, key, text), "signatures")
    some = all_rows.where(F.col(key).isNotNull() & (F.col("n_shingles") > 0))
    same = ["n_shingles", "set1", "set2"]
    first = written(some.groupBy(*same).agg(F.min(key).alias("id")), "classes")
    reps = written(some.join(first.select("id"), some[key] == F.col("id"), "left_semi").select(F.col(key).alias("id"), "n_shingles", "bands", "sketch", "samples").dropDuplicates(["id"]), "representatives")
    in_bands = reps.select("id", "n_shingles", F.explode("bands").alias("band"))
    shared = in_bands.groupBy("band").agg((F.min("id") < F.max("id")).alias("_several")).where("_several").select("band")
    members = written(in_bands.join(shared, "band"), "members")
    labels = written(members.select("id", F.col("id").alias("label")).distinct(), "labels", clean=False)
    several = labels.count()
    sets = written(set_rows(docs, labels.select("id"), size, key, text), "sets")
    light = reps.select("id", "n_shingles", "sketch", "samples")

    def side(x: str) -> DataFrame:
        return light.select(F.col("id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"), F.col("samples").alias(f"samples_{x}"))

    for r in range(STARS):
        now = members.join(labels, "id")
        centre = now.groupBy("band").agg(F.min(F.struct(F.xxhash64("id", F.lit(r)).alias("h"), "id", "label")).alias("c"), (F.min("label") < F.max("label")).alias("open")).where("open").select("band", F.col("c.id").alias("a"), F.col("c.label").alias("la"))
        pairs = now.join(centre, "band").where(F.col("label") != F.col("la")).select("a", F.col("id").alias("b")).distinct()
        pairs = pairs.join(side("a"), "a").join(side("b"), "b").where(may_link(percent)).select("a", "b")
        links = written(confirmed(pairs, sets, percent), "links", clean=False)
        found = links.count()
        if found:
            labels = _relabelled(labels, links, labels)
        dropped(links)
        if found * 10 < several:
            break
    full = reps.select("id", "n_shingles", "bands", "sketch", "samples")
    tiles = written(_tiles(members.join(labels, "id")), "tiles")
    # as many tasks as the session has partitions: tiles are small tables with much to compare, and not to be put together by size
    spread = partitions(docs.sparkSession)
    pairs = tiles.join(full, "id").repartition(spread, *TILE).groupBy(*TILE).applyInArrow(lambda t: _candidates(t, percent), f"a long, b long, {TILE_SCHEMA}")
    pairs = written(pairs, "pairs")
    links = confirmed(pairs.where("a <> b").select("a", "b").distinct(), sets, percent)
    # members with many partners: their tiles once more, with full sets
    many = pairs.where("a = b").select(*TILE, F.col("a").alias("id"), F.lit(True).alias("many"))
    again = tiles.join(many.select(*TILE).distinct(), list(TILE)).join(many, [*TILE, "id"], "left").withColumn("many", F.coalesce("many", F.lit(False)))
    again = again.join(full, "id").join(sets, "id").repartition(spread, *TILE).groupBy(*TILE).applyInArrow(lambda t: _settled(t, percent), "a long, b long")
    links = written(links.unionByName(again), "links", clean=False)
    if not links.isEmpty():
        labels = _relabelled(labels, links, labels)
    to = first.join(labels, "id", "left").select(*same, F.coalesce("label", "id").alias("_to"))
    to = written(to, "component-of-set", discard=[labels, first, reps, members, sets, tiles, pairs, links])
    out = all_rows.select(key, *same).join(to, same, "left")
    component = F.when((F.col("n_shingles") > 0) & F.col(key).isNotNull(), F.col("_to")).otherwise(F.col(key))
    return out.select(key, "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
