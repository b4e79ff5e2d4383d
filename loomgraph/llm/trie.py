"""The trie of conversation prefixes: which first turns conversations share, and what computing them once would save.

Turns are numbered by a running count, conversations are put together from a shared head and their own rest, and numpy
scans give every prefix a polynomial fingerprint. Prefixes of one depth and fingerprint are candidates for one node. Each is
verified against the representative, the smallest conversation of the group: the turn itself must be equal, and so must be the
nodes above, which with the turns above makes whole prefixes equal. What does not fit becomes a group of its own and is
verified in turn, so a collision costs time and never an error. Nodes are then rolled up to their parents.

Rolling up needs no rounds by depth. The smallest member of a node can only grow with depth, so every conversation is the
representative of a last stretch of its own path, each node lies on one such stretch, and what a node's subtree holds is
the sum, over its members, of what is left of their stretches below it. These are running sums from the end, too.

Running sums are made over ranges of rows: a range is scanned by itself, and the sums before it are added to its first
conversation, so a conversation of any length is the work of many tasks. Only rows of one conversation and one turn number
are put in order in one task. A node that holds more than HEAVY or a 4,096th of all rows is joined apart.

Rows without a conv_id belong to no conversation. A null role or text is an empty one, a null turn comes first, equal turns
follow by role and text, repeated rows are turns of their own. Texts are compared whole, whatever their length. Other columns
are not read, so their names can't clash. An empty table gives no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import dropped, written

#: Moduli of the two halves of a fingerprint, and their bases.
MODULI = (2_147_483_647, 2_147_483_629)
BASES = (1_103_515_245, 69_069)
#: Rows of a node from which it may be joined apart, or its turn be laid beside its members more than once.
HEAVY = 4_096
#: Conversation ids that are joined into one string before they are hashed.
BLOCK = 8_192
WORDS = r"[^\x20\x09-\x0D]+"


def _segmented(new: np.ndarray, values: np.ndarray, carry: int) -> np.ndarray:
    """Running sums that start again where `new`; rows before the first such one go on from carry."""
    sums = np.cumsum(values)
    at = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
    return np.where(at < 0, sums + carry, sums - (sums - values)[at])


def running(df: DataFrame, key: str, order: list, ties: list[str], names: list[str], values: Callable[[pa.RecordBatch], list[np.ndarray]]) -> tuple[DataFrame, DataFrame]:
    """(df with the running sums of values(batch) as names, the written table behind it), per key (long, not null) in the given order.

    Rows are sorted by ranges of (key, order). Only the first key of a range can have begun before it, so there is at most one
    sum for each range to be added.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, carry = TaskContext.get().partitionId(), None, [0] * len(names)
        for b in batches:
            if not b.num_rows:
                continue
            k = b.column(b.schema.get_field_index(key)).to_numpy()
            new = np.concatenate([[last is None or k[0] != last], k[1:] != k[:-1]])
            own = [v.astype(np.int64) for v in values(b)]
            sums = [_segmented(new, v, c) for v, c in zip(own, carry, strict=True)]
            last, carry = k[-1], [int(s[-1]) for s in sums]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part)), *map(pa.array, own), *map(pa.array, sums)], names=[*b.schema.names, *more])

    more = ["_part", *(f"_own_{n}" for n in names), *names]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), *(f"`{c}` long" for c in more)])
    table = written(df.repartitionByRange(key, *order).sortWithinPartitions(key, *order, *ties).mapInArrow(scan, schema), "scan", clean=False)
    ends = table.groupBy("_part").agg(F.min(key).alias("a"), F.max(key).alias("b")).select(F.explode(F.array("a", "b")).alias(key)).distinct()
    # two keys a range at most, and one sum to be added for each range
    spans = table.join(F.broadcast(ends), key, "left_semi").groupBy(key, "_part").agg(*(F.sum(f"_own_{n}").alias(n) for n in names))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    add = spans.select(key, "_part", *(F.sum(n).over(before).alias(f"_add_{n}") for n in names)).where(f"`_add_{names[0]}` is not null")
    out = table.join(F.broadcast(add), [key, "_part"], "left")
    out = out.withColumns({n: F.col(n) + F.coalesce(f"_add_{n}", F.lit(0)) for n in names})
    return out.select(*df.columns, *(f"_own_{n}" for n in names), *names), table


def numbered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, place from 0, role, text, mark, words) of every row with a conv_id, and the written table behind it."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), text.alias("text"))
    rows = rows.withColumns({"mark": F.xxhash64("role", "text"), "words": F.regexp_count("text", F.lit(WORDS)).cast("long")})
    turns, table = running(rows, "conv", ["turn"], ["role", "text"], ["place"], lambda b: [np.ones(b.num_rows)])
    return turns.select("conv", (F.col("place") - 1).alias("place"), "role", "text", "mark", "words"), table


def rebuilt(turns: DataFrame, block: int = 20, heads: int = 4) -> DataFrame:
    """(conv, depth, length, source, place, mark, words): every conversation with its first h turns taken from that of id conv - conv % block, h = crc32(conv) % heads.

    depth 0 is the start of each, without text; source and place tell where a turn stands among the given ones.
    """
    size = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    convs = size.withColumns({"h": F.crc32(F.col("conv").cast("string")) % heads, "base": F.col("conv") - F.col("conv") % block})
    convs = convs.join(size.select(F.col("conv").alias("base"), F.col("n").alias("_n")), "base", "left").withColumn("taken", F.least("h", F.coalesce("_n", F.lit(0))))
    convs = written(convs.select("conv", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "convs", clean=False)
    thin = turns.select(F.col("conv").alias("source"), "place", "mark", "words")
    own = thin.join(convs.withColumnRenamed("conv", "source"), "source").where("place >= h").withColumn("conv", F.col("source")).withColumn("depth", F.col("taken") + F.col("place") - F.col("h") + 1)
    head = thin.where(F.col("place") < heads - 1).join(convs.withColumnRenamed("base", "source"), "source").where("place < taken").withColumn("depth", F.col("place") + 1)
    none = F.lit(0).cast("long")
    root = convs.select("conv", none.alias("depth"), "length", F.col("conv").alias("source"), F.lit(-1).cast("long").alias("place"), none.alias("mark"), none.alias("words"))
    names = root.columns
    return own.select(names).unionByName(head.select(names)).unionByName(root)


def _power(base: int, exponents: np.ndarray, modulus: int) -> np.ndarray:
    out, square, left = np.ones(len(exponents), np.int64), base % modulus, exponents.copy()
    while left.any():
        out = np.where(left & 1, out * square % modulus, out)
        square, left = square * square % modulus, left >> 1
    return out


def fingerprinted(rows: DataFrame, moduli: tuple[int, int] = MODULI) -> tuple[DataFrame, DataFrame]:
    """rows with print, the fingerprint of the conversation's first `depth` turns, and above, that of the turns before the last; and the written table behind it.

    The fingerprint is the sum of mark * base**depth over the prefix, modulo two primes.
    """

    def terms(b: pa.RecordBatch) -> list[np.ndarray]:
        depth, mark = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("depth", "mark"))
        return [np.mod(mark, m) * _power(base, depth, m) % m for base, m in zip(BASES, moduli, strict=True)]

    scanned, table = running(rows, "conv", ["depth"], [], ["_f", "_g"], terms)
    both = lambda f, g: F.shiftleft(f % moduli[0], 31).bitwiseOR(g % moduli[1])
    out = scanned.withColumn("print", both(F.col("_f"), F.col("_g"))).withColumn("above", both(F.col("_f") - F.col("_own__f"), F.col("_g") - F.col("_own__g")))
    return out.select(*rows.columns, "print", "above"), table


NODE = ["depth", "print", "split"]


def _with_groups(rows: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """rows with the columns of their group. Groups of many rows are few, 4,096 at most, and are joined apart."""
    heavy = F.col("n") > max(HEAVY, total // 4_096)
    large = F.broadcast(groups.where(heavy))
    return rows.join(large, NODE).unionByName(rows.join(large.select(NODE), NODE, "left_anti").join(groups.where(~heavy), NODE))


def _misfits(joined: DataFrame, groups: DataFrame, turns: DataFrame) -> DataFrame:
    """(NODE, source, place, above) of the members whose turn, or whose node above, is not that of their representative."""
    own = [*NODE, "source", "place", "above"]
    other = joined.where("n > 1 and depth > 0").select(*own, "n", "rep", "group_above")
    fast = other.where("above <> group_above").select(own)
    # turns that come from one place are equal; the others are compared, once for each place and group
    ask = other.where("above = group_above").where((F.col("source") != F.col("rep.source")) | (F.col("place") != F.col("rep.place"))).select(*own, "n").distinct()
    copies = lambda n: F.ceil(n / HEAVY)
    ask = ask.withColumn("salt", F.pmod(F.xxhash64("source", "place"), copies(F.col("n"))))
    text = turns.select(F.col("conv").alias("source"), "place", "role", "text")
    known = groups.where("n > 1 and depth > 0").select(*NODE, F.col("rep.source").alias("source"), F.col("rep.place").alias("place"), "n").join(text, ["source", "place"])
    known = known.select(*NODE, F.col("role").alias("_role"), F.col("text").alias("_text"), F.explode(F.sequence(F.lit(0).cast("long"), copies(F.col("n")) - 1)).alias("salt"))
    slow = ask.join(text, ["source", "place"]).join(known, [*NODE, "salt"]).where("role <> _role or text <> _text").select(own)
    return fast.unionByName(slow).distinct()


def nodes_of(rows: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with their verified group, groups): groups are (NODE, rep, n, longest), rep.conv the smallest member and longest its members' greatest length."""
    total = rows.count()
    rows = rows.withColumn("split", F.lit(0))
    old: list[DataFrame] = []
    while True:
        rep = F.min(F.struct("conv", "source", "place", "above")).alias("rep")
        groups = written(rows.groupBy(NODE).agg(rep, F.count(F.lit(1)).alias("n"), F.max("length").alias("longest")), "groups", clean=False)
        joined = written(_with_groups(rows, groups.withColumn("group_above", F.col("rep.above")), total), "members", clean=False)
        bad = written(_misfits(joined, groups, turns), "misfits", clean=False)
        dropped(*old)
        if bad.isEmpty():
            return joined, groups
        # misfits leave their group; from now on a node above is known by its group's smallest member
        moved = joined.select(*rows.columns).join(bad.withColumn("_bad", F.lit(1)), [*NODE, "source", "place", "above"], "left").withColumn("split", F.col("split") + F.coalesce("_bad", F.lit(0))).drop("_bad")
        least = moved.groupBy(NODE).agg(F.min("conv").alias("least"), F.count(F.lit(1)).alias("n"))
        named = _with_groups(moved.drop("above"), least, total).drop("n")
        up = named.select("conv", (F.col("depth") + 1).alias("depth"), F.col("least").alias("above"))
        rows = written(named.drop("least").join(up, ["conv", "depth"], "left").withColumn("above", F.coalesce("above", F.lit(-1))), "split", clean=False)
        old = [groups, joined, bad]


def _digests(ends: DataFrame) -> DataFrame:
    """(rep, depth, ends_sha256) of ends (rep, depth, conv): ids in order are joined in blocks, by ranges; the blocks of a node are hashed as a stream."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                rep, depth, conv = (b.column(i).slice(at, BLOCK).to_numpy() for i in range(3))
                cuts = np.concatenate([[0], np.flatnonzero((rep[1:] != rep[:-1]) | (depth[1:] != depth[:-1])) + 1, [len(rep)]]).tolist()
                ids = conv.tolist()
                first = cuts[:-1]
                yield pa.RecordBatch.from_arrays([pa.array(rep[first]), pa.array(depth[first]), pa.array(conv[first]), pa.array([",".join(map(str, ids[i:j])) for i, j in zip(first, cuts[1:], strict=True)], pa.string())], names=["rep", "depth", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            out = []
            for rep, depth, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                if (rep, depth) != key:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = (rep, depth), hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["rep", "depth", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([state.hexdigest()])], names=["rep", "depth", "ends_sha256"])

    order = ["rep", "depth", "conv"]
    blocks = ends.select(order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(join, "rep long, depth long, first long, ids string")
    return blocks.repartition("rep", "depth").sortWithinPartitions("rep", "depth", "first").mapInArrow(hashed, "rep long, depth long, ends_sha256 string")


def rolled_up(members: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per node, see prefix_trie()."""
    rep = F.col("rep.conv")
    own = (rep == F.col("conv")).cast("long")
    rows = members.select("conv", "depth", "length", *NODE[1:], rep.alias("rep"), own.alias("own"), (own * (F.col("n") - 1) * F.col("words")).alias("saved"), (own * (F.col("longest") == F.col("depth")).cast("long")).alias("leaf"), (F.col("length") == F.col("depth")).alias("ends"), (-F.col("depth")).alias("_up"))

    def values(b: pa.RecordBatch) -> list[np.ndarray]:
        return [b.column(b.schema.get_field_index(c)).to_numpy() for c in ("own", "saved", "leaf")]

    summed, _ = running(rows, "conv", ["_up"], [], ["owned", "below", "leaves"], values)
    # a member counts as a child of its node if it is the smallest of the next one, and so of all that are left of its path
    left = F.col("length") - F.col("depth")
    child = ((left > 0) & (F.col("owned") - F.col("own") == left)).cast("long").alias("child")
    summed = summed.select("conv", *NODE, "rep", "own", "ends", "below", "leaves", child)
    totals = summed.groupBy(NODE).agg(F.sum("child").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("below").alias("saved_tokens"))
    # the parent of a node is its smallest member's node above: where that member is the smallest there as well, the id stays
    parents = summed.where("child = 1 and own = 0").select("conv", (F.col("depth") + 1).alias("depth"), F.col("rep").alias("_parent"))
    ends = _digests(summed.where("ends").select("rep", "depth", "conv")).withColumnRenamed("rep", "conv")
    found = groups.select(*NODE, rep.alias("conv"), "n").join(totals, NODE).join(parents, ["conv", "depth"], "left").join(ends, ["conv", "depth"], "left")
    parent: Column = F.when(F.col("depth") > 0, F.coalesce("_parent", "conv"))
    return found.select(F.col("conv").alias("conv_id"), "depth", parent.alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, moduli: tuple[int, int] = MODULI, block: int = 20, heads: int = 4) -> DataFrame:
    """Nodes of the trie of rebuilt conversations: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves and saved_tokens of the subtree, ends_sha256.

    conversations: conv_id, turn, role, text. moduli may be small: only speed depends on them.
    """
    turns, first = numbered_turns(conversations)
    rows, second = fingerprinted(rebuilt(turns, block, heads), moduli)
    members, groups = nodes_of(rows, turns)
    dropped(second)
    return rolled_up(members, groups)
