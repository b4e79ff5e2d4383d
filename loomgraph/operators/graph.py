"""Directed graphs: strongly connected components, condensation, and edges that make a graph irreducible.

Labels and frontiers are DataFrames; every iteration is a few joins and ends in a written table. Chains, runs of nodes with one
edge in and one out, are contracted first by pointers that double their reach, so that rounds follow the logarithm of a chain's
length; what is left takes a round per layer. At most LOCAL edges, counted first, are finished in one process. Component ids are
smallest members; nodes are whole numbers.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions.scalars import ceil_count, counted, f_eta, g_share, with_pair_uniform
from loomgraph.lineage import numbered as ranked
from loomgraph.lineage import stored as _stored
from loomgraph.operators import local


#: Edges up to which a graph, or what is left of it, is finished in one process; measured before anything is collected.
LOCAL = 10_000
#: Rows beyond which a written table is never sent to all tasks.
SPREAD = 10_000


def stored(df: DataFrame, discard: list[DataFrame] | tuple = ()) -> DataFrame:
    """df as a written table. A large one asks for merge joins: labels compress so well that the size of its files says little of
    its rows, and joins would pass them whole through the driver."""
    out = _stored(df, discard)
    return out.hint("merge") if out.count() > SPREAD else out


def _collected(edges: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(node ids, sources, destinations as places among them) of a graph of at most LOCAL edges; else None."""
    if edges.limit(LOCAL + 1).count() > LOCAL:
        return None
    t = edges.select("src", "dst").toArrow()
    a, b = (t.column(k).to_numpy() for k in (0, 1))
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    return ids, place[: len(a)], place[len(a) :]


def _table(spark: SparkSession, kind: str, **columns: np.ndarray) -> DataFrame:
    return spark.createDataFrame(pa.table({k: pa.array(v) for k, v in columns.items()}), kind)


def chains(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(edges without chains, chain nodes, ring nodes); None if there is no chain. edges: (src, dst), distinct.

    The first has (src, dst, length), a chain standing as one edge from the node before it to the one behind it. The second has (node, first,
    place, head, tail): a chain is named by its first node, place counts from 0. A ring is a cycle none of whose nodes has another
    edge; its nodes come as (node, low), low the smallest of them. A pointer leads to the node before, then two, four ... before,
    and stops at the first; those that never stop, after as many rounds as the logarithm of their number, are on rings.
    """
    e = edges.select("src", "dst")
    into, out = e.groupBy("dst").agg(F.count(F.lit(1)).alias("i"), F.min("src").alias("prev")), e.groupBy("src").agg(F.count(F.lit(1)).alias("o"), F.min("dst").alias("next"))
    inner = stored(into.where("i = 1").join(out.where("o = 1"), into["dst"] == out["src"]).select(into["dst"].alias("node"), "prev", "next"))
    n = inner.count()
    if n == 0:
        return None
    known = inner.select(F.col("node").alias("prev"), F.lit(True).alias("inside"))
    now = stored(inner.join(known, "prev", "left").select("node", F.when(F.col("inside"), F.col("prev")).otherwise(F.col("node")).alias("to"), F.when(F.col("inside"), 1).otherwise(0).cast("long").alias("place"), F.least("node", F.when(F.col("inside"), F.col("prev")).otherwise(F.col("node"))).alias("low"), (~F.coalesce("inside", F.lit(False))).alias("ended")))
    for _ in range(math.ceil(math.log2(n)) + 1):
        if now.where(~F.col("ended")).isEmpty():
            break
        on = now.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("place").alias("_place"), F.col("low").alias("_low"), F.col("ended").alias("_ended"))
        moved = now.where(~F.col("ended")).join(on, "to").select("node", F.col("_to").alias("to"), (F.col("place") + F.col("_place")).alias("place"), F.least("low", "_low").alias("low"), F.col("_ended").alias("ended"))
        now = stored(now.where("ended").unionByName(moved), discard=[now])
    line = now.where("ended").select("node", F.col("to").alias("first"), "place")
    before = inner.select(F.col("node").alias("first"), F.col("prev").alias("head"))
    last = line.join(inner.select("node", "next"), "node").join(inner.select(F.col("node").alias("next")), "next", "left_anti").select("first", F.col("next").alias("tail"), (F.col("place") + 2).alias("length"))
    ends = stored(before.join(last, "first"))
    inside = stored(line.join(ends, "first").select("node", "first", "place", "head", "tail"))
    rings = now.where(~F.col("ended")).select("node", "low")
    all_inner = now.select("node")
    plain = e.join(all_inner.withColumnRenamed("node", "src"), "src", "left_anti").join(all_inner.withColumnRenamed("node", "dst"), "dst", "left_anti").withColumn("length", F.lit(1).cast("long"))
    core = stored(plain.unionByName(ends.select(F.col("head").alias("src"), F.col("tail").alias("dst"), "length")))
    return core, inside, rings


def spread_minimum(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, label): the smallest label that reaches each node along edges (src, dst), its own included. Labels are nodes.

    A round takes the least label before a node, then the label of that label, which reaches the node as well: paths shorten by half.
    """
    while True:
        got = edges.join(labels, edges["src"] == labels["node"]).groupBy("dst").agg(F.min("label").alias("got"))
        low = labels.join(got, labels["node"] == got["dst"], "left").select("node", "label", F.least("label", F.coalesce("got", "label")).alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("label").alias("up"))
        new = low.join(up, "low", "left").select("node", F.least("low", F.coalesce("up", "low")).alias("label"), (F.least("low", F.coalesce("up", "low")) < F.col("label")).alias("moved"))
        new = stored(new)
        labels = new.drop("moved")
        if new.where("moved").isEmpty():
            return labels


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node) reached from roots (node) along edges (src, dst), roots included."""
    graph = _collected(edges)
    if graph is not None:
        ids, src, dst = graph
        inside = _table(roots.sparkSession, "node long", node=ids)
        start = inside.join(roots.select("node"), "node", "left_semi").toArrow().column(0).to_numpy()
        mark = local.reached(len(ids), src, dst, np.searchsorted(ids, start).tolist())
        return roots.select("node").union(_table(roots.sparkSession, "node long", node=ids[mark])).distinct()
    found = chains(edges.select("src", "dst").distinct())
    if found is None:
        return _spread(edges, roots)
    core, inside, rings = found
    # a root within a chain reaches what is behind it, and the chain's end
    own = inside.join(roots.select("node").distinct(), "node", "left_semi").groupBy("first", "tail").agg(F.min("place").alias("from"))
    start = roots.select("node").join(inside.select("node"), "node", "left_anti").unionByName(own.select(F.col("tail").alias("node")))
    got = stored(_spread(core.select("src", "dst"), start))
    through = inside.join(got.withColumnRenamed("node", "head"), "head", "left_semi").select("node")
    behind = inside.join(own.select("first", "from"), "first").where(F.col("place") >= F.col("from")).select("node")
    ring = rings.join(rings.join(roots.select("node"), "node", "left_semi").select("low").distinct(), "low", "left_semi").select("node")
    return got.unionByName(through).unionByName(behind).unionByName(ring).distinct()


def _spread(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node) reached from roots, layer by layer."""
    parts = [stored(roots.select("node").distinct())]
    while True:
        step = edges.join(parts[-1], edges["src"] == parts[-1]["node"], "left_semi").select(F.col("dst").alias("node")).distinct()
        for old in parts:  # frontiers are only ever added to
            step = step.join(old, "node", "left_anti")
        front = stored(step)
        if front.isEmpty():
            return reduce(DataFrame.unionByName, parts)
        parts.append(front)
        if len(parts) > 8:
            parts = [stored(reduce(DataFrame.unionByName, parts[:-1]), discard=parts[:-1]), front]


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, comp) for all nodes (node) under edges (src, dst); comp is the smallest node of the component.

    Nodes without an edge in or out are components of their own and go first, repeatedly. The rest is coloured
    by the smallest node that reaches it; what reaches the colour's node within the colour is its component.
    As soon as at most LOCAL edges are left, one process finishes them.
    """
    left, rest = stored(nodes.select("node").distinct()), stored(edges.where("src <> dst").select("src", "dst").distinct())
    found = chains(rest) if _collected(rest) is None else None
    if found is None:
        return _coloured(left, rest)
    core, inside, rings = found
    outer = left.join(inside.select("node").unionByName(rings.select("node")), "node", "left_anti")
    comp = stored(_coloured(stored(outer), stored(core.where("src <> dst").select("src", "dst").distinct())))
    # a chain belongs to the component that holds both of its ends, else its nodes stand alone
    ends = inside.join(comp.select(F.col("node").alias("head"), F.col("comp").alias("_a")), "head").join(comp.select(F.col("node").alias("tail"), F.col("comp").alias("_b")), "tail")
    more = ends.select("node", F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.col("node")).alias("comp"))
    every = stored(comp.unionByName(more).unionByName(rings.select("node", F.col("low").alias("comp"))))
    least = every.groupBy("comp").agg(F.min("node").alias("_least"))
    return every.join(least, "comp").select("node", F.col("_least").alias("comp"))


def _coloured(left: DataFrame, rest: DataFrame) -> DataFrame:
    """Components of a graph whose edges are distinct and no loops, by trimming and colouring."""
    found = left.limit(0).select("node", F.col("node").alias("comp"))

    def within(rest: DataFrame, left: DataFrame) -> DataFrame:
        both = rest.join(left.select(F.col("node").alias("src")), "src", "left_semi").join(left.select(F.col("node").alias("dst")), "dst", "left_semi")
        return stored(both, discard=[rest])

    while True:
        graph = _collected(rest)
        if graph is not None:
            ids, src, dst = graph
            comp = _table(left.sparkSession, "node long, _comp long", node=ids, _comp=ids[local.strong_components(len(ids), src, dst)])
            return found.unionByName(left.join(comp, "node", "left").select("node", F.coalesce("_comp", "node").alias("comp")))
        # trimming
        both = rest.select(F.col("src").alias("node")).distinct().join(rest.select(F.col("dst").alias("node")).distinct(), "node", "left_semi")  # intersect() would lose the hint
        inner = stored(left.join(both, "node", "left_semi"))
        alone = left.join(inner, "node", "left_anti")
        trimmed = stored(alone.select("node", F.col("node").alias("comp")))
        if not trimmed.isEmpty():
            found = stored(found.unionByName(trimmed), discard=[trimmed])
            left = inner
            rest = within(rest, left)
            continue
        colour = spread_minimum(rest, left.select("node", F.col("node").alias("label")))
        ends = rest.join(colour.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(colour.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst")
        same = stored(ends.where("a = b").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        back = reachable(same, colour.where("node = label"))
        part = stored(colour.join(back, "node", "left_semi").select("node", F.col("label").alias("comp")), discard=[same])
        found = stored(found.unionByName(part))
        left = stored(left.join(part, "node", "left_anti"))
        rest = within(rest, left)
        if left.isEmpty():
            return found


def component_sizes(comp: DataFrame) -> DataFrame:
    return comp.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))


def component_members(comp: DataFrame) -> DataFrame:
    """(comp, position, node): members numbered within their component. Numbered rows stand in for lists, whose length has no bound."""
    return comp.withColumn("position", F.row_number().over(Window.partitionBy("comp").orderBy("node"))).select("comp", "position", "node")


def condensation(comp: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct component pairs (src, dst) that an edge joins."""
    a = comp.select(F.col("node").alias("src"), F.col("comp").alias("a"))
    b = comp.select(F.col("node").alias("dst"), F.col("comp").alias("b"))
    return edges.join(a, "src").join(b, "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def ends_of(comp: DataFrame, dag: DataFrame) -> DataFrame:
    """(comp, size, out_degree, in_degree, is_source, is_sink) of every component; one that stands alone is both."""
    ends = dag.select(F.explode(F.array(F.struct(F.col("src").alias("comp"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("comp"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    d = ends.groupBy("comp").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    out = component_sizes(comp).join(d, "comp", "left").select("comp", "size", F.coalesce("o", F.lit(0)).alias("out_degree"), F.coalesce("i", F.lit(0)).alias("in_degree"))
    return out.withColumns({"is_source": F.col("in_degree") == 0, "is_sink": F.col("out_degree") == 0})


def levels(comps: DataFrame, dag: DataFrame) -> DataFrame:
    """(comp, level): the longest path of the acyclic graph that ends in the component."""
    graph = _collected(dag)
    if graph is not None:
        ids, src, dst = graph
        found = _table(comps.sparkSession, "comp long, _level long", comp=ids, _level=local.levels(len(ids), src, dst))
        return comps.select("comp").distinct().join(found, "comp", "left").select("comp", F.coalesce("_level", F.lit(0)).cast("int").alias("level"))
    found = chains(dag.select("src", "dst").distinct())
    if found is None:
        return _lengthened(comps, dag.select("src", "dst", F.lit(1).cast("long").alias("length")))
    core, inside, rings = found
    if not rings.isEmpty():
        raise ValueError("the graph has a cycle")
    outer = comps.select("comp").join(inside.select(F.col("node").alias("comp")), "comp", "left_anti")
    level = stored(_lengthened(outer, core))
    within = inside.join(level.select(F.col("comp").alias("head"), "level"), "head").select(F.col("node").alias("comp"), (F.col("level") + F.col("place") + 1).cast("int").alias("level"))
    return level.unionByName(within)


def _lengthened(comps: DataFrame, dag: DataFrame) -> DataFrame:
    """(comp, level) of a graph whose edges have lengths: levels grow until none does; a level that no path can have is a cycle's."""
    now = stored(comps.select("comp").distinct().withColumn("level", F.lit(0)))
    most = (dag.agg(F.sum("length")).first()[0] or 0) + 1
    while True:
        if (now.agg(F.max("level")).first()[0] or 0) >= most:
            raise ValueError("the graph has a cycle")
        step = dag.join(now, dag["src"] == now["comp"]).groupBy("dst").agg(F.max(F.col("level") + F.col("length")).cast("int").alias("up"))
        new = stored(now.join(step, now["comp"] == step["dst"], "left").select("comp", F.greatest("level", F.coalesce("up", "level")).alias("level"), (F.coalesce("up", "level") > F.col("level")).alias("moved")))
        now = new.drop("moved")
        if new.where("moved").isEmpty():
            return now


def strongly_connected(comps: DataFrame, dag: DataFrame) -> bool:
    """Whether one component reaches all others, and all others reach it."""
    root = comps.select(F.col("comp").alias("node")).orderBy("node").limit(1)
    n = comps.count()
    back = dag.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reachable(dag, root).count() == n and reachable(back, root).count() == n


def sink_source_pairs(comp: DataFrame, dag: DataFrame) -> DataFrame:
    """(pair, a, b): edges from sink components a to source components b that make the condensation strongly connected.

    Sinks and sources are numbered in topological order and paired round after round, with growing shifts, until
    the graph with the pairs is strongly connected. A pair of a component with itself takes the next source.
    """
    ends = stored(ends_of(comp, dag))
    empty = comp.sparkSession.createDataFrame([], f"pair long, a {dict(comp.dtypes)['comp']}, b {dict(comp.dtypes)['comp']}")
    if ends.count() <= 1:
        return empty
    at = ends.join(levels(ends, dag), "comp")

    def ends_in_order(flag: str, name: str) -> DataFrame:
        # the order is global, as the pairing is
        return stored(ranked(at.where(flag).select("level", F.col("comp").alias(name)), ["level", name], "_n").drop("level"))

    sinks, sources = ends_in_order("is_sink", "a"), ends_in_order("is_source", "b")
    nk, ns = sinks.count(), sources.count()
    rounds = comp.sparkSession.range(max(nk, ns)).select(F.col("id").alias("pair"))
    for shift in range(1, ns + 3):
        pairs = rounds.withColumn("_n", F.col("pair") % nk).join(sinks, "_n").drop("_n")
        for k in range(3):
            b = sources.withColumnRenamed("b", f"b{k}")
            pairs = pairs.withColumn("_n", (F.col("pair") + shift + k) % ns).join(b, "_n").drop("_n")
        b = F.when(F.col("b0") != F.col("a"), F.col("b0")).when(F.col("b1") != F.col("a"), F.col("b1")).otherwise(F.col("b2"))
        pairs = stored(pairs.select("pair", "a", b.alias("b")))
        if not pairs.where("a = b").isEmpty():
            continue
        more = dag.unionByName(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))).distinct()
        if strongly_connected(ends, stored(more)):
            return pairs
    raise ValueError("no pairing makes the condensation strongly connected")


def pair_quotas(pairs: DataFrame, comp: DataFrame, edges: DataFrame, theta: float = 0.05, eta: float = 0.001, gamma: float = 0.25, n0: float = 50.0, eta_g: float = 1.0) -> DataFrame:
    """pairs with n_a, n_b, n_there (edges that exist), absent (pairs of members without one), n_keep and n_draw."""
    sizes = component_sizes(comp)
    p = pairs.join(sizes.select(F.col("comp").alias("a"), F.col("size").alias("n_a")), "a").join(sizes.select(F.col("comp").alias("b"), F.col("size").alias("n_b")), "b")
    c = comp.select(F.col("node").alias("src"), F.col("comp").alias("a"))
    d = comp.select(F.col("node").alias("dst"), F.col("comp").alias("b"))
    there = edges.join(c, "src").join(d, "dst").groupBy("a", "b").agg(F.count(F.lit(1)).alias("_there"))
    n = F.least("n_a", "n_b").cast("double")
    p = p.join(there.hint("merge"), ["a", "b"], "left").withColumn("n_there", F.coalesce("_there", F.lit(0))).withColumn("absent", F.col("n_a") * F.col("n_b") - F.col("n_there"))
    p = p.withColumn("_keep", F.greatest(F.lit(1), ceil_count(f_eta(n, theta, eta) * n)))
    p = p.withColumn("n_draw", F.least("absent", F.greatest("_keep", ceil_count(g_share(n, gamma, n0, eta_g) * n))))
    return p.withColumn("n_keep", F.least("_keep", "n_draw")).select("pair", "a", "b", "n_a", "n_b", "n_there", "absent", "n_keep", "n_draw")


def candidates(quotas: DataFrame, comp: DataFrame, edges: DataFrame, seed: int = 12345) -> DataFrame:
    """(pair, src, dst): n_draw absent pairs of members of each pair, drawn without replacement.

    Numbers of member pairs are drawn by the keyed hash, and looked up in the numbered member table; the product
    of the members is never made. Where many of them are wanted, all numbers are taken in hashed order; else
    tries are added, four times as many each round, until every pair has its distinct absent ones. A try's number does not depend on how many there are.
    """
    members = stored(component_members(comp))
    want = quotas.where("n_draw > 0").withColumn("_all", F.col("n_a") * F.col("n_b")).withColumn("_dense", F.col("n_draw") * 4 >= F.col("_all") - F.coalesce("n_there", F.lit(0)))
    src = members.select(F.col("comp").alias("a"), F.col("position").cast("long").alias("_i"), F.col("node").alias("src"))
    dst = members.select(F.col("comp").alias("b"), F.col("position").cast("long").alias("_j"), F.col("node").alias("dst"))
    own = Window.partitionBy("pair").orderBy("_t", "_n")
    # the tries that n_draw distinct absent ones of at most a quarter take are 1.16 times as many by expectation
    found, factor = None, 1.5
    while True:
        tries = F.when(F.col("_dense"), F.col("_all")).otherwise(F.ceil(F.col("n_draw") * factor * F.col("_all") / F.greatest("absent", F.lit(1))) + 64)
        drawn = with_pair_uniform(counted(want, tries, "_t"), "pair", "_t", "_u", seed)
        # all numbers, in the order of their draws; or drawn ones, the first try of each
        drawn = drawn.withColumn("_n", F.when(F.col("_dense"), F.col("_t")).otherwise(F.least(F.floor(F.col("_u") * F.col("_all")).cast("long"), F.col("_all") - 1)))
        drawn = drawn.groupBy("pair", "a", "b", "n_b", "n_draw", "_n").agg(F.min(F.when(F.col("_dense"), F.col("_u")).otherwise(F.col("_t").cast("double"))).alias("_t"))
        drawn = drawn.withColumns({"_i": F.expr("_n div n_b") + 1, "_j": F.col("_n") % F.col("n_b") + 1})
        pairs = drawn.join(src, ["a", "_i"]).join(dst, ["b", "_j"]).where("src <> dst").join(edges.select("src", "dst"), ["src", "dst"], "left_anti")
        got = stored(pairs.withColumn("_r", F.row_number().over(own)).where("_r <= n_draw").select("pair", "src", "dst"))
        found = got if found is None else stored(found.unionByName(got), discard=[found, got])
        full = found.groupBy("pair").agg(F.count(F.lit(1)).alias("_got"))
        short = stored(want.join(full, "pair", "left").where(F.coalesce("_got", F.lit(0)) < F.col("n_draw")).drop("_got"))
        if short.isEmpty():
            return found
        if not short.where("_dense").isEmpty():
            raise ValueError("a pair of components has fewer absent edges than are to be drawn")
        found = stored(found.join(short.select("pair"), "pair", "left_anti"), discard=[found])
        want, factor = short, 4 * factor


def with_delta(cand: DataFrame, firms: DataFrame, incidence: DataFrame, q: str = "q") -> DataFrame:
    """Candidates with the seller's sector l and delta, the inflow that the edge would add to it."""
    b = firms.select(F.col("id").alias("src"), F.col(q).alias("_q"), F.col("sector").alias("k"))
    s = firms.select(F.col("id").alias("dst"), F.col("sector").alias("l"))
    both = cand.join(b, "src").join(s, "dst").join(incidence, ["k", "l"], "left")
    return both.select("pair", "src", "dst", "l", (F.col("_q") * F.coalesce("w", F.lit(0.0))).alias("delta"))


def augmented(nodes: DataFrame, edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Original edges, chosen ones, and a self-loop on every node."""
    loops = nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"))
    return edges.select("src", "dst").unionByName(chosen.select("src", "dst")).unionByName(loops)
