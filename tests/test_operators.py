"""Operators of the production-network domain on small hand-made cases."""

import math
import random
import time
from itertools import product
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S
from loomgraph.lineage import dropped, numbered, shared_dir, written
from loomgraph.operators import graph, gravity, sampling, sectors, selection, weights
from loomgraph.sources import fixtures
from loomgraph.sources.bands import BANDS


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize("value,want", [('"100.0"', "100"), ("12.", "12"), ("1.50", "1.50"), (" 7 ", "7"), ("A.0", "A"), (None, None)])
def test_code(spark, value, want):
    assert one(spark, value, S.code) == want


@pytest.mark.parametrize("value,want", [("Firm_12_3", 12), ("abc", None), (None, None), ("007", 7)])
def test_digits(spark, value, want):
    assert one(spark, value, S.digits) == want


@pytest.mark.parametrize("value,want", [(12.04, 12.0), (12.96, 13.0), (0.05, 0.0), (12.5, 12.5)])
def test_custom_round(spark, value, want):
    assert one(spark, value, S.custom_round, "double") == want


@pytest.mark.parametrize("value,want", [("3.5", 3.5), ("-1", 0.0), ("x", 0.0), (None, 0.0), ("NaN", 0.0), ("Infinity", 0.0)])
def test_lenient_number(spark, value, want):
    assert one(spark, value, S.lenient_number) == want


def test_pair_uniform(spark):
    m = (1 << 64) - 1
    pairs = [(0, 0), (1, 2), (123456789, 987654321), (2**31, 5)]
    df = S.with_pair_uniform(spark.createDataFrame(pairs, "i long, j long"), "i", "j", "u")
    for r in df.collect():
        x = ((r["i"] * S.PAIR_FACTOR) & m) ^ ((r["j"] << 1) & m) ^ S.PAIR_SEED
        x = ((x ^ (x >> 30)) * S.MIX_1) & m
        x = ((x ^ (x >> 27)) * S.MIX_2) & m
        assert r["u"] == float(x ^ (x >> 31)) / 2.0**64


def test_normalised_sizes(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.25)], "id long, size double")
    values = lambda mode: [r["q"] for r in S.max_normalised(df, "size", "q", mode).orderBy("id").collect()]
    assert values("floor_one") == [0.5, 0.25] and values("positive") == [1.0, 0.5] and values("off") == [0.5, 0.25]
    assert [r["q"] for r in S.max_normalised(df.withColumn("size", F.lit(0.0)), "size", "q", "positive").collect()] == [0.0, 0.0]


def counts(spark, values):
    names = [b[0] for b in BANDS]
    return spark.createDataFrame([(s, *v, *[None] * (len(names) - len(v))) for s, v in values], ", ".join(["`SIC ` string", *(f"`{n}` double" for n in names)]))


def test_units_are_taken_back(spark, monkeypatch):
    """Whole parts above the target, as rounding may leave them: cells that have any give one unit each."""
    parts = spark.createDataFrame([(k, "1", 0, 5, 1.0, b, 0.0, -2) for k, b in enumerate([3, 0, 2, 4], 1)], "cell long, sic string, band int, n long, expected double, base long, remainder double, deficit long")
    monkeypatch.setattr(sampling, "allocation", lambda *_: parts)
    drawn = sampling.sample_counts(parts.select("cell", "sic", "band", "n"), 7, seed=3)
    assert drawn.columns == ["cell", "sic", "band", "n", "draw"]
    given = {r["cell"]: r["draw"] for r in drawn.collect()}
    taken = [b - given[k] for k, b in enumerate([3, 0, 2, 4], 1)]
    assert sum(taken) == 2 and set(taken) == {0, 1} and given[2] == 0
    monkeypatch.setattr(sampling, "allocation", lambda *_: parts.withColumn("deficit", F.lit(-4)))
    with pytest.raises(ValueError, match="taken back"):
        sampling.sample_counts(parts.select("cell", "sic", "band", "n"), 5)


def test_only_own_tables_are_dropped(spark, tmp_path):
    theirs = tmp_path / "loomgraph" / "firms"
    spark.range(3).write.parquet(str(theirs))
    ours = written(spark.range(3), "step")
    at = ours.inputFiles()[0].rsplit("/", 1)[0].split(":", 1)[1]
    assert f"/{shared_dir(spark).split(':', 1)[-1].strip('/')}/loomgraph/" in f"/{at.lstrip('/')}"
    dropped(ours, spark.read.parquet(str(theirs)))
    assert theirs.exists() and not Path(at).exists()


def test_cells_and_sampling(spark):
    c = sampling.cells(counts(spark, [("1", [1.0, 0.9, 1.0]), ("20", [None, 1.0, -3.0])]))
    assert [(r["cell"], r["sic"], r["band"], r["n"]) for r in c.orderBy("cell").collect()] == [(1, "1", 0, 1), (2, "1", 2, 1), (3, "20", 1, 1)]
    for target in (2, 7):
        drawn = sampling.sample_counts(c, target, seed=3)
        assert drawn.agg(F.sum("draw")).first()[0] == target
        firms = sampling.expanded(drawn, seed=3).collect()
        assert sorted(r["firm"] for r in firms) == list(range(1, target + 1))
        assert all(r["low"] - 1 <= r["size"] <= r["high"] + 1 for r in firms)
    assert sampling.sample_counts(c, "ALL").agg(F.sum("draw")).first()[0] == 3
    with pytest.raises(ValueError):
        sampling.sample_counts(c.limit(0), 5)
    with pytest.raises(ValueError):
        sampling.allocation(c, 0)
    with pytest.raises(ValueError, match="missing"):
        sampling.cells(spark.createDataFrame([("1",)], "SIC string"))


def components(spark, n, edges):
    nodes = spark.range(1, n + 1).select(F.col("id").alias("node"))
    e = spark.createDataFrame(edges, "src long, dst long")
    return nodes, e, graph.stored(graph.strong_components(nodes, e))


@pytest.mark.parametrize(
    "n,edges,want",
    [
        (3, [(1, 2), (2, 3), (3, 1)], {1: 1, 2: 1, 3: 1}),
        (3, [(1, 2), (2, 3)], {1: 1, 2: 2, 3: 3}),
        (2, [(1, 1)], {1: 1, 2: 2}),
        (6, [(1, 2), (2, 1), (4, 5), (5, 4), (2, 4), (6, 1)], {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6}),
    ],
)
def test_components(spark, n, edges, want):
    assert {r["node"]: r["comp"] for r in components(spark, n, edges)[2].collect()} == want


def test_components_by_tables(spark, monkeypatch):
    """The rounds that larger graphs go through give the same components, levels and reach as one process."""
    rng = random.Random(3)
    edges = [(rng.randint(1, 30), rng.randint(1, 30)) for _ in range(36)]
    nodes, e, comp = components(spark, 30, edges)
    want = sorted(map(tuple, comp.collect()))
    dag = graph.stored(graph.condensation(comp, e))
    levels = sorted(map(tuple, graph.levels(graph.component_sizes(comp), dag).collect()))
    reach = sorted(graph.reachable(e, nodes.where("node = 1")).collect())
    monkeypatch.setattr(graph, "LOCAL", 3)
    assert sorted(map(tuple, components(spark, 30, edges)[2].collect())) == want
    assert sorted(map(tuple, graph.levels(graph.component_sizes(comp), dag).collect())) == levels
    assert sorted(graph.reachable(e, nodes.where("node = 1")).collect()) == reach


def test_deep_graphs(spark):
    n = 10_000
    nodes = spark.range(1, n + 1).select(F.col("id").alias("node"))
    path = spark.range(1, n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    began = time.time()
    comp = graph.stored(graph.strong_components(nodes, path))
    assert comp.where("node = comp").count() == n
    level = graph.levels(comp.select("comp"), path)
    assert level.agg(F.max("level")).first()[0] == n - 1
    assert graph.sink_source_pairs(comp, path).count() == 1
    assert time.time() - began < 60


def test_chains_and_rings_by_tables(spark, monkeypatch):
    """Chains, rings, a cycle closed by a chain, and roots within chains, by the rounds of larger graphs."""
    edges = [(i, i + 1) for i in range(1, 9)] + [(20, 21), (21, 22), (22, 20)] + [(30, 31), (31, 32), (32, 33), (33, 30), (30, 33)] + [(9, 40), (9, 41), (40, 42), (41, 43), (43, 42), (3, 50)]
    want = {n: n for n in range(1, 60)} | {n: 20 for n in (21, 22)} | {n: 30 for n in (31, 32, 33)}
    nodes, e, comp = components(spark, 59, edges)
    assert {r["node"]: r["comp"] for r in comp.collect()} == want
    starts = spark.createDataFrame([(5,), (21,), (31,), (57,)], "node long")
    reach = sorted(graph.reachable(e, starts).collect())
    dag = graph.stored(graph.condensation(comp, e))
    levels = sorted(map(tuple, graph.levels(graph.component_sizes(comp), dag).collect()))
    monkeypatch.setattr(graph, "LOCAL", 1)
    assert {r["node"]: r["comp"] for r in components(spark, 59, edges)[2].collect()} == want
    assert sorted(graph.reachable(e, starts).collect()) == reach
    assert sorted(map(tuple, graph.levels(graph.component_sizes(comp), dag).collect())) == levels
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "src long, dst long")
    with pytest.raises(ValueError):
        graph.levels(spark.range(1, 4).select(F.col("id").alias("comp")), ring)


def test_rounds_follow_the_logarithm_of_a_chain(spark, monkeypatch):
    n, made, keep = 100_000, [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df, discard=(): (made.append(1), keep(df, discard))[1])
    monkeypatch.setattr(graph, "LOCAL", 1_000)
    path = spark.range(1, n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    comp = graph.strong_components(spark.range(1, n + 1).select(F.col("id").alias("node")), path)
    assert comp.where("node = comp").count() == n
    assert len(made) <= 40


def test_numbers_follow_a_global_order(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("x"), F.lit("a").alias("y"))
    got = [(r["x"], r["n"]) for r in numbered(df.repartition(7), ["x"], "n").collect()]
    assert sorted(got) == [(x, i) for i, x in enumerate(sorted(x for x, _ in got))]


def test_too_few_absent_edges_are_an_error(spark):
    nodes, edges, comp = components(spark, 4, [(1, 2), (2, 1), (3, 4), (4, 3), (1, 3)])
    quotas = spark.createDataFrame([(0, 1, 3, 2, 2, 1, 3, 1, 4)], "pair long, a long, b long, n_a long, n_b long, n_there long, absent long, n_keep long, n_draw long")
    assert graph.candidates(quotas.withColumn("n_draw", F.lit(3)), comp, edges).count() == 3
    with pytest.raises(ValueError, match="fewer absent"):
        graph.candidates(quotas, comp, edges)


def test_draws_go_on_until_there_are_enough(spark):
    """Nearly all pairs of two components are edges already, so first tries miss."""
    n = 60
    comp = spark.range(2 * n).select(F.col("id").alias("node"), (F.col("id") >= n).cast("long").alias("comp"))
    every = comp.where("comp = 0").select(F.col("node").alias("src")).crossJoin(comp.where("comp = 1").select(F.col("node").alias("dst")))
    edges = graph.stored(every.where("(src * 31 + dst * 17) % 97 <> 0"))
    free = n * n - edges.count()
    quotas = spark.createDataFrame([(0, 0, 1, n, n, n * n - free, free, 1, free // 5)], "pair long, a long, b long, n_a long, n_b long, n_there long, absent long, n_keep long, n_draw long")
    got = graph.candidates(quotas, comp, edges)
    assert got.count() == got.distinct().count() == free // 5 > 0
    assert got.join(edges, ["src", "dst"]).isEmpty()


def test_graph_becomes_irreducible(spark):
    nodes, edges, comp = components(spark, 6, [(1, 2), (2, 3), (4, 5), (5, 4)])
    dag = graph.stored(graph.condensation(comp, edges))
    ends = {r["comp"]: (r["is_source"], r["is_sink"]) for r in graph.ends_of(comp, dag).collect()}
    assert ends == {1: (True, False), 2: (False, False), 3: (False, True), 4: (True, True), 6: (True, True)}
    assert {r["comp"]: r["level"] for r in graph.levels(graph.component_sizes(comp), dag).collect()} == {1: 0, 2: 1, 3: 2, 4: 0, 6: 0}
    pairs = graph.sink_source_pairs(comp, dag)
    quotas = graph.stored(graph.pair_quotas(pairs, comp, edges, theta=0.9, eta=1.0))
    cand = graph.stored(graph.candidates(quotas, comp, edges))
    got = {r["pair"]: r["n"] for r in cand.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {r["pair"]: r["n_draw"] for r in quotas.collect()}
    assert cand.distinct().count() == cand.count()
    more = graph.stored(graph.augmented(nodes, edges, cand))
    assert graph.strong_components(nodes, more).select("comp").distinct().count() == 1
    assert more.where("src = dst").count() == 6


def test_one_component_needs_no_pairs(spark):
    nodes, edges, comp = components(spark, 2, [(1, 2), (2, 1)])
    assert graph.sink_source_pairs(comp, graph.condensation(comp, edges)).count() == 0


def firms_and_blocks(spark, n=40, k=3):
    firms = spark.range(1, n + 1).select("id", (F.col("id") % k).alias("sector"), (0.2 + (F.col("id") % 4) / 5).alias("q"))
    blocks = spark.range(k).select(F.col("id").alias("k")).crossJoin(spark.range(k).select(F.col("id").alias("l"))).select("k", "l", (0.3 + (F.col("k") + F.col("l")) / 10).alias("s"), F.lit(1.0 / k).alias("i_share"))
    return firms, blocks


def test_block_sums(spark):
    firms, blocks = firms_and_blocks(spark)
    par = gravity.Parameters(0.7, 0.5, 0.6, {(0, 1): 3.0, (2, 2): 1e9})
    f = [(r["id"], r["sector"], r["q"]) for r in firms.collect()]
    b = {(r["k"], r["l"]): (r["s"], r["i_share"]) for r in blocks.collect()}
    got = {(r["k"], r["l"]): r for r in gravity.block_sums(firms, blocks, par).collect()}
    for (k, l), (s, share) in b.items():
        p_sum = e_sum = slope = 0.0
        for i, ki, qi in f:
            for j, lj, qj in f:
                if ki == k and lj == l and i != j:
                    x = par.z * par.factors.get((k, l), 1.0) * s**par.kappa * (qi * qj) ** par.alpha
                    p = 1.0 if x > 1e6 else x / (1 + x)
                    p_sum, e_sum = p_sum + p, e_sum + share * qi * p
                    slope += 0.0 if x > 1e6 else p * (1 - p) * (math.log(qi) + math.log(qj))
        assert math.isclose(got[(k, l)]["p"], p_sum, rel_tol=1e-9) and math.isclose(got[(k, l)]["e"], e_sum, rel_tol=1e-9)
        assert math.isclose(got[(k, l)]["p_a"], slope, rel_tol=1e-9, abs_tol=1e-9)
    half = gravity.block_sums(firms, blocks, gravity.Parameters(0.7), undirected=True).agg(F.sum("p")).first()[0]
    whole = gravity.block_sums(firms, blocks, gravity.Parameters(0.7)).agg(F.sum("p")).first()[0]
    assert 0 < half < whole


def test_fit_and_draw(spark):
    firms, blocks = firms_and_blocks(spark)
    fit = gravity.Fit(firms, blocks, degree=5.0)
    try:
        par, violated = fit.run(rounds=1, more=1, steps=6)
        assert abs(fit.links(par) - 200) <= 1e-5
        drawn = gravity.bernoulli_edges(firms, blocks, par)
        n = drawn.count()
        assert 140 < n < 260 and drawn.where("buyer = seller").count() == 0 and drawn.distinct().count() == n
        assert violated == fit.violations(par)
    finally:
        fit.close()


def test_trimming_sends_no_table_to_all_tasks(spark, monkeypatch):
    """Nodes that only one side of the edges has are trimmed by merging; large labels would pass through the driver otherwise."""
    monkeypatch.setattr(graph, "SPREAD", -1)
    monkeypatch.setattr(graph, "LOCAL", 3)
    kept, plans = graph._stored, []
    monkeypatch.setattr(graph, "_stored", lambda df, discard=(): plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df, discard))
    nodes = spark.range(1, 9).select(F.col("id").alias("node"))
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 3), (3, 4), (3, 5), (2, 4), (6, 1), (6, 2)], "src long, dst long")
    got = {tuple(r) for r in graph.strong_components(nodes, edges).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 6), (7, 7), (8, 8)}
    trimmed = [p for p in plans if p.count("LeftSemi") >= 2 and "node" in p]
    assert trimmed and not any("Broadcast" in p for p in trimmed)


@pytest.mark.parametrize("undirected", [False, True])
def test_draws_by_arrays_equal_those_pair_by_pair(spark, monkeypatch, undirected):
    """Several pieces a sector, sizes that are null, no number, zero or saturated, ids that repeat: the same edges as by columns."""
    firms, blocks = firms_and_blocks(spark, n=150)
    firms = graph.stored(firms.withColumn("q", F.when(F.col("id") == 3, None).when(F.col("id") == 5, float("nan")).when(F.col("id") == 7, 0.0).when(F.col("id") == 9, 1e30).otherwise(F.col("q"))).unionByName(firms.where("id in (11, 12)").select(firms.columns)))
    blocks, par = graph.stored(blocks), gravity.Parameters(0.6)
    pairs = gravity.pair_probabilities(firms, blocks, par, undirected=undirected).where("p > 0").selectExpr("*", "buyer - 1 as i", "seller - 1 as j")
    want = sorted(map(tuple, S.with_pair_uniform(pairs, "i", "j", "u").where("p >= u").select("buyer", "seller").collect()))
    monkeypatch.setattr(gravity, "PIECE", 16)
    monkeypatch.setattr(gravity, "AT_ONCE", 64)
    got = gravity.bernoulli_edges(firms, blocks, par, undirected=undirected)
    assert "MapInArrow" in got._jdf.queryExecution().toString()  # pairs of firms are no rows
    assert len(want) > 100 and sorted(map(tuple, got.collect())) == want


def test_thinned_draws_follow_the_probabilities(spark):
    """Links of each block over many seeds lie within five deviations of their sum of probabilities, and so do those of single pairs."""
    firms, blocks = firms_and_blocks(spark, n=60)
    firms = graph.stored(firms.withColumn("q", F.col("q") / (1 + F.col("id") % 17)))
    blocks, par, seeds = graph.stored(blocks), gravity.Parameters(0.6), 6
    p = {(r["buyer"], r["seller"]): r["p"] for r in gravity.pair_probabilities(firms, blocks, par).collect()}
    sector = {r["id"]: r["sector"] for r in firms.collect()}
    drawn = []
    for seed in range(seeds):
        got = [tuple(r) for r in gravity.thinned_edges(firms, blocks, par, seed=7919 * seed + 1).collect()]
        assert len(got) == len(set(got)) and set(got) <= set(p)
        drawn += got
    for block in {(sector[i], sector[j]) for i, j in p}:
        of = [v for (i, j), v in p.items() if (sector[i], sector[j]) == block]
        mean, deviation = seeds * sum(of), math.sqrt(seeds * sum(v * (1 - v) for v in of))
        assert abs(sum((sector[i], sector[j]) == block for i, j in drawn) - mean) <= 5 * deviation + 1
    # pairs in four classes of probability: thinning leaves none of them too often
    order = sorted(p, key=p.get)
    for c in range(4):
        part = set(order[c * len(order) // 4 : (c + 1) * len(order) // 4])
        mean, deviation = seeds * sum(p[e] for e in part), math.sqrt(seeds * sum(p[e] * (1 - p[e]) for e in part))
        assert abs(sum(e in part for e in drawn) - mean) <= 5 * deviation + 1


@pytest.mark.parametrize("undirected", [False, True])
def test_thinned_draws_are_the_same_by_any_lots(spark, monkeypatch, undirected):
    """Links leave their task by arrays and are neither stored nor joined; lots and parts of them deal the same as whole cells."""
    firms, blocks = firms_and_blocks(spark, n=60)
    firms = graph.stored(firms.withColumn("q", F.col("q") / (1 + F.col("id") % 17)).unionByName(firms.limit(1).withColumn("id", F.lit(None).cast("bigint"))))
    blocks, par, rows = graph.stored(blocks), gravity.Parameters(0.6), []

    def stored(df):
        out = graph.stored(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(gravity, "stored", stored)
    whole = gravity.thinned_edges(firms, blocks, par, undirected=undirected)
    assert "MapInArrow" in whole._jdf.queryExecution().toString()  # links are no rows before they are drawn
    monkeypatch.setattr(gravity, "LOT", 3)
    monkeypatch.setattr(gravity, "DEALT", 2)
    parts = gravity.thinned_edges(firms, blocks, par, undirected=undirected)
    want = sorted(map(tuple, whole.collect()))
    assert len(want) > 40 and sorted(map(tuple, parts.collect())) == want
    # equal sizes, all pairs linked: what is stored follows firms and cells
    rows.clear()
    every = gravity.thinned_edges(firms.where("id is not null").withColumn("q", F.lit(0.5)), blocks, gravity.Parameters(1e40)).count()
    assert every > 1000 and max(rows) <= 60


def test_skips_are_dealt_the_same_in_any_portions(monkeypatch):
    top, long = 0.03, 2134
    rate, n = math.log1p(-top), 50 * long - 7
    dealt = lambda begin, end, spread=0.5: np.sort(np.concatenate([*gravity._dealt(77, top, rate, long, begin, end, spread, 5)])).tolist()
    whole = dealt(0, n)
    assert len(set(whole)) == len(whole) and abs(len(whole) - n * top) < 5 * math.sqrt(n * top) and 0 <= whole[0] and whole[-1] < n
    assert dealt(0, 5000) + dealt(5000, 5001) + dealt(5001, n) == whole
    assert dealt(0, n, spread=-2.0) == dealt(0, n, spread=6.0) == whole
    monkeypatch.setattr(gravity, "RUNS", 3)
    monkeypatch.setattr(gravity, "SKIPS", 16)
    assert dealt(0, n) == whole


def test_runs_that_need_more_skips_go_on(spark):
    firms, blocks = firms_and_blocks(spark, n=60)
    whole = {tuple(r) for r in gravity.thinned_edges(firms, blocks, gravity.Parameters(0.6)).collect()}
    # a negative spread leaves each run a few skips a pass
    passes = {tuple(r) for r in gravity.thinned_edges(firms, blocks, gravity.Parameters(0.6), spread=-2.0).collect()}
    assert whole and passes == whole
    half = {tuple(r) for r in gravity.thinned_edges(firms, blocks, gravity.Parameters(0.6), undirected=True).collect()}
    assert half == {e for e in whole if e[0] < e[1]}
    # saturated strengths link all pairs; without firms there is none
    every = gravity.thinned_edges(firms, blocks, gravity.Parameters(1e40))
    assert every.count() == gravity.pair_probabilities(firms, blocks, gravity.Parameters(1e40)).count()
    assert gravity.thinned_edges(firms.where("id < 0"), blocks, gravity.Parameters(0.6)).isEmpty()
    odd = firms.unionByName(spark.createDataFrame([(900, None, 0.5), (901, 0, None)], "id long, sector long, q double"))
    assert gravity.thinned_edges(odd, blocks, gravity.Parameters(0.6)).where("buyer >= 900 or seller >= 900").isEmpty()


def test_sizes_in_steps_keep_the_error_bound(spark):
    firms, blocks = firms_and_blocks(spark, n=120)
    firms = firms.withColumn("q", F.col("q") * (1 + F.col("id") / 500))
    par = gravity.Parameters(0.3)
    exact = {(r["k"], r["l"]): r["p"] for r in gravity.block_sums(firms, blocks, par).collect()}
    near = gravity.block_sums(firms, blocks, par, resolution=0.05).collect()
    assert gravity.size_groups(firms, "q", 0.05).count() < gravity.size_groups(firms).count()
    assert all(abs(r["p"] / exact[(r["k"], r["l"])] - 1) <= gravity.error_bound(par.alpha, 0.05) for r in near)
    one = gravity.block_sums(firms, blocks, par, slices=1).collect()
    assert all(r["p"] == pytest.approx(exact[(r["k"], r["l"])]) for r in one)


def test_fit_moves_exponents_and_factors(spark):
    """Bands that no scale, and no factor for whole sectors, can meet at the first exponents."""
    firms = fixtures.firms(spark, "/root/testdata/sf0.001")
    firms = S.max_normalised(firms, "size", "q")
    flows = fixtures.sector_flows(spark, "/root/testdata/sf0.001")
    blocks = sectors.blocks(flows, sectors.max_shares(flows))
    fit = gravity.Fit(firms, blocks)
    try:
        start = gravity.Parameters()
        start.z = fit.solve_scale(start)
        assert fit.violations(start) > 0
        par, violated = fit.run()
        assert violated == 0 and (par.alpha, par.kappa) != (0.5, 0.6)
        assert S.ALPHA_BOX[0] < par.alpha < S.ALPHA_BOX[1] and S.KAPPA_BOX[0] < par.kappa < S.KAPPA_BOX[1]
        # the same sums by hand
        f = [(r["id"], r["sector"], r["q"]) for r in firms.collect()]
        by = {(r["k"], r["l"]): (r["s"], r["i_share"]) for r in blocks.collect()}
        links, inflow, size = 0.0, {}, {}
        for i, k, q in f:
            size[k] = size.get(k, 0.0) + q
            for j, l, p in f:
                if i != j and (k, l) in by:
                    x = par.z * par.factors.get((k, l), 1.0) * by[(k, l)][0] ** par.kappa * (q * p) ** par.alpha
                    links += x / (1 + x)
                    inflow[l] = inflow.get(l, 0.0) + by[(k, l)][1] * q * x / (1 + x)
        assert links == pytest.approx(25 * len(f), abs=1e-4)
        assert all(abs(inflow[l] / size[l] - 1) <= 0.1 + 1e-9 for l in size)
    finally:
        fit.close()


def test_weights_meet_the_conditions_of_the_optimum(spark):
    """Within the tolerance, every weight is the sum of its constraints' prices: no other weights have less energy."""
    rng = random.Random(5)
    edges = sorted({(b, s) for b in range(30) for s in [b, *rng.sample(range(30), 9)]})
    size = [rng.uniform(1, 1.6) for _ in range(30)]
    e = spark.createDataFrame(edges, "buyer long, seller long")
    firms = spark.createDataFrame([(i, size[i], i % 3, 0.15) for i in range(30)], "id long, size double, sector long, delta double")
    got = {(r["buyer"], r["seller"]): r["weight"] for r in weights.solve(e, firms, cycles=200, tolerance=1e-7).collect()}
    b, s = (np.array(x) for x in zip(*edges, strict=True))
    x, m = np.array([got[k] for k in edges]), np.array(size)
    rows = np.zeros((30, len(b)))
    rows[b, np.arange(len(b))] = 1
    firm = np.zeros((30, len(b)))
    firm[s, np.arange(len(b))] = m[b]
    sector = np.array([firm[np.arange(30) % 3 == k].sum(0) for k in range(3)])
    total = np.array([m[np.arange(30) % 3 == k].sum() for k in range(3)])
    assert np.abs(rows @ x - 1).max() < 1e-5
    a, low, high = np.vstack([firm, sector]), np.concatenate([0.85 * m, 0.9 * total]), np.concatenate([1.15 * m, 1.1 * total])
    flow = a @ x
    assert (flow >= low - 1e-4).all() and (flow <= high + 1e-4).all()
    at_low, at_high = flow < low + 1e-4, flow > high - 1e-4
    inside = x > 1e-6
    own = (b == s).astype(float)
    assert own @ x <= 3 + 1e-4
    base = np.vstack([rows, a[at_low | at_high], *([own] if own @ x > 3 - 1e-4 else [])])
    price = np.linalg.lstsq(base[:, inside].T, x[inside], rcond=None)[0]
    assert np.abs(base[:, inside].T @ price - x[inside]).max() < 1e-3
    assert (base[:, ~inside].T @ price <= 1e-3).all()


def test_weights(spark):
    edges = [(b, s) for b in range(1, 7) for s in range(1, 7) if (b * s) % 4 != 3] + [(7, 1)]
    e = spark.createDataFrame(edges, "buyer long, seller long")
    firms = spark.createDataFrame([(i, 1.0 + i / 10, i % 2, 0.6) for i in range(1, 8)], "id long, size double, sector long, delta double")
    caps = weights.Caps(sector=0.5)
    w = graph.stored(weights.solve(e, firms, caps, cycles=40, tolerance=1e-3))
    r = weights.residuals(w, firms.where("id < 7"), caps).first()
    assert r["row_miss"] < 5e-3
    assert w.where("buyer = 7").first()["weight"] == pytest.approx(1.0, abs=5e-3)
    assert w.where("weight < 0 or weight > 1").count() == 0
    with pytest.raises(ValueError):
        weights.Caps(firm=-1)


def test_squared_self_weights_are_capped(spark):
    # a ring whose firms also buy from themselves: without the cap all weights are 0.5
    e = spark.createDataFrame([(i, j) for i in range(4) for j in (i, (i + 1) % 4)], "buyer long, seller long")
    firms = spark.createDataFrame([(i, 1.0, i % 2, 0.1) for i in range(4)], "id long, size double, sector long, delta double")
    caps = weights.Caps(eta1=1.0, eta2=0.1)
    assert weights.residuals(weights.solve(e, firms, caps), firms, caps).first()["self_square"] == pytest.approx(1.0, abs=1e-3)
    r = weights.residuals(weights.solve_capped(e, firms, caps), firms, caps).first()
    assert 0.38 < r["self_square"] <= 0.4 + 1e-9
    assert max(r["row_miss"], r["firm_miss"], r["sector_miss"]) <= 1e-3
    # firms that buy from themselves only can't keep to it
    with pytest.raises(ValueError):
        weights.solve_capped(e.where("buyer = seller"), firms, caps, cycles=3)


def test_energy_and_bound_close_in_on_each_other(spark):
    """Against the optimum by hand: three firms that buy from themselves and the next, self weights capped by their squares."""
    e = spark.createDataFrame([(i, j) for i in range(3) for j in (i, (i + 1) % 3)], "buyer long, seller long")
    firms = spark.createDataFrame([(i, 1.0, 0, 0.5) for i in range(3)], "id long, size double, sector long, delta double")
    found = weights.solved_capped(e, firms, weights.Caps(eta1=1.0, eta2=0.09), cycles=80, tolerance=1e-7, gap=1e-6)
    w = found.weights.collect()
    assert all(r["weight"] == pytest.approx(0.3 if r["buyer"] == r["seller"] else 0.7, abs=1e-5) for r in w)
    assert found.energy == pytest.approx(3 * (0.09 + 0.49) / 2, abs=1e-5) and found.gap <= 1e-6
    # stationary: 0.3 (1 + price) = 0.7, both being their row's multiplier
    assert found.square_price == pytest.approx(4 / 3, abs=1e-4)
    # any multipliers give a bound: after two cycles it is below the optimum
    early = weights.solved(e, firms, weights.Caps(eta1=1.0, eta2=0.09), cycles=2, squared=True)
    assert early.cycles == 2 and early.bound <= found.energy + 1e-6
    free = weights.solved_capped(e, firms, weights.Caps(eta1=1.0, eta2=1.0), tolerance=1e-6, gap=1e-6)
    assert free.energy == pytest.approx(0.75, abs=1e-5) and free.square_price == 0.0


def test_weights_without_edges(spark):
    e = spark.createDataFrame([], "buyer long, seller long")
    firms = spark.createDataFrame([(1, 1.0, 0, 1.0)], "id long, size double, sector long, delta double")
    found = weights.solved(e, firms, cycles=2)
    assert found.weights.count() == 0 and found.energy == 0.0


def test_selection(spark):
    cand = spark.createDataFrame([(0, 1, 2, 1, 1.0), (0, 1, 3, 2, 5.0), (1, 4, 2, 1, 1.0), (1, 4, 3, 2, 0.1)], "pair long, src long, dst long, l long, delta double")
    quotas = spark.createDataFrame([(0, 1), (1, 1)], "pair long, n_keep long")
    sizes = spark.createDataFrame([(1, 1.0, -1.0), (2, 1.0, 0.0)], "l long, s_l double, base_l double")
    chosen, value, bound = selection.choose(cand, quotas, sizes)
    assert {(r["pair"], r["dst"]) for r in chosen.collect()} == {(0, 2), (1, 3)}
    assert value == pytest.approx(0.01) and bound <= value + 1e-9
    assert all(r["n_keep"] == r["picked"] for r in selection.picks_per_pair(chosen, quotas).collect())
    with pytest.raises(ValueError):
        selection.choose(cand, quotas, sizes.withColumn("s_l", F.lit(0.0)))
    with pytest.raises(ValueError, match="another number"):
        selection.choose(cand, quotas.withColumn("n_keep", F.lit(3).cast("long")), sizes)
    with pytest.raises(ValueError, match="no candidates"):
        selection.choose(cand.limit(0), quotas, sizes)


def test_selection_against_all_choices(spark):
    rng = random.Random(2)
    cand = [(p, p * 10 + k, 100 + k, rng.randrange(3), round(rng.uniform(0, 2), 3)) for p in range(5) for k in range(4)]
    base, size = [-2.0, 0.5, -1.0], [1.0, 2.0, 1.5]

    def cost(picked):
        y = list(base)
        for _, _, _, l, d in picked:
            y[l] += d
        return sum((v / s) ** 2 for v, s in zip(y, size, strict=True))

    best = min(cost(x) for x in product(*([c for c in cand if c[0] == p] for p in range(5))))
    df = spark.createDataFrame(cand, "pair long, src long, dst long, l long, delta double")
    quotas = spark.createDataFrame([(p, 1) for p in range(5)], "pair long, n_keep long")
    sizes = spark.createDataFrame([(l, size[l], base[l]) for l in range(3)], "l long, s_l double, base_l double")
    chosen, value, bound = selection.choose(df, quotas, sizes)
    assert bound <= best + 1e-9 <= value + 2e-9 and value <= best * 1.25 + 1e-3
    assert value == pytest.approx(cost([tuple(r) for r in chosen.select("pair", "src", "dst", "l", "delta").collect()]))


def test_tolerance_last_wins(spark):
    firms = spark.createDataFrame([(1, 10.0), (2, 10.0)], "id long, size double")
    deltas = spark.createDataFrame([(1, 1, 0.2), (2, 1, 0.5), (3, 2, -1.0)], "line long, id long, delta double")
    assert {r["id"]: r["delta"] for r in sectors.with_tolerance(firms, deltas).collect()} == {1: 0.5, 2: 0.1}


def test_block_sums_by_nodes_equal_those_over_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    ids, sector, q = np.arange(900) // 2 * 3, rng.integers(0, 2, 900), np.exp(rng.uniform(-1.7, 0.0, 900))  # two firms an id
    firms = graph.stored(spark.createDataFrame([(int(i), int(s), float(x)) for i, s, x in zip(ids, sector, q)], "id long, sector long, q double"))
    blocks = graph.stored(spark.createDataFrame([(0, 0, 0.5, 1.0), (0, 1, 1.0, 0.6), (1, 1, 0.2, 0.4)], "k long, l long, s double, i_share double"))
    groups = graph.stored(gravity.size_groups(firms))
    assert gravity.condensed(groups).count() <= 2 * 4 * gravity.NODES < groups.count()
    for alpha in (0.3, 0.95):
        par = gravity.Parameters(40.0, alpha, 0.6)
        for undirected in (False, True):
            got = {(r["k"], r["l"]): r for r in gravity.block_sums(firms, blocks, par, undirected=undirected).collect()}
            assert len(got) == 3
            for k, l, s, share in ((0, 0, 0.5, 1.0), (0, 1, 1.0, 0.6), (1, 1, 0.2, 0.4)):
                a, b = sector == k, sector == l
                x = 40.0 * s**0.6 * np.outer(q[a], q[b]) ** alpha
                p = x / (1 + x)
                keep = ids[a][:, None] < ids[b] if undirected else np.flatnonzero(a)[:, None] != np.flatnonzero(b)
                w, logs = p * (1 - p), np.log(np.outer(q[a], q[b]))
                assert got[k, l]["p"] == pytest.approx((p * keep).sum(), rel=1e-12)
                assert got[k, l]["p_a"] == pytest.approx((w * logs * keep).sum(), rel=1e-11)
                assert got[k, l]["e_z"] == pytest.approx((share * q[a][:, None] * w * keep).sum(), rel=1e-12)


def test_a_fit_reads_nodes_unless_a_pair_may_be_saturated(spark):
    firms = graph.stored(spark.range(300).select("id", F.lit(1).cast("long").alias("sector"), (0.2 + F.col("id") / 400).alias("q")))
    blocks = spark.createDataFrame([(1, 1, 1.0, 1.0)], "k long, l long, s double, i_share double")
    fit = gravity.Fit(firms, blocks, degree=5.0)
    try:
        assert fit._nodes.count() < fit._groups.count() == 300
        q = 0.2 + np.arange(300) / 400
        for z in (0.1, 2.1234567e6):  # beyond 1e6 probabilities jump to 1
            x = z * np.sqrt(np.outer(q, q))
            p = np.where(x > 1e6, 1.0, x / (1 + x))
            assert fit.links(gravity.Parameters(z)) == pytest.approx(p.sum() - np.trace(p), rel=1e-12)
    finally:
        fit.close()


def test_weights_in_blocks_follow_dykstras_cycles(spark, monkeypatch):
    rng = np.random.default_rng(3)
    n, caps = 14, weights.Caps(firm=0.1, sector=0.05, eta1=0.05, eta2=0.002, eps0=0.001)
    size, sector = rng.uniform(1, 3, n), np.arange(n) % 3
    i, j = (np.concatenate([x, np.arange(n)]) for x in zip(*[(a, b) for a in range(n) for b in range(n) if a != b and rng.random() < 0.4]))
    m, own, x, ball, box, fp, sp, op = size[i], i == j, np.zeros(len(i)), np.zeros(len(i)), np.zeros(len(i)), np.zeros(n), np.zeros(3), 0.0
    total = np.bincount(sector, size)
    away = lambda s, whole, part: np.clip(s, (1 - part) * whole, (1 + part) * whole) - s
    for _ in range(3):
        x = x + ((1 - np.bincount(i, x)) / np.bincount(i))[i]
        v = np.bincount(j, m * m)
        new = away(np.bincount(j, m * x) - fp * v, size, caps.firm) / v
        x, fp = x + (new - fp)[j] * m, new
        v = np.bincount(sector[j], m * m)
        new = away(np.bincount(sector[j], m * x) - sp * v, total, caps.sector) / v
        x, sp = x + (new - sp)[sector[j]] * m, new
        new = min(0.0, (n * caps.eta1 - (x[own].sum() - op * n)) / n)
        y, op = np.where(own, x + ball + new - op, x), new
        scale = min(1.0, math.sqrt(n * caps.eta2 / (y[own] ** 2).sum()))
        ball = np.where(own, y * (1 - scale), 0.0)
        y = y - ball + box
        x = np.clip(y, caps.eps0, 1.0)
        box = y - x
    firms = spark.createDataFrame([(a * 5, float(size[a]), int(sector[a]), 0.1) for a in range(n)], "id long, size double, sector long, delta double")
    edges = spark.createDataFrame([(int(a) * 5, int(b) * 5) for a, b in zip(i, j)], "buyer long, seller long")
    monkeypatch.setattr(weights, "SMALL", 5)
    monkeypatch.setattr(weights, "BLOCK", 5)
    found = weights.solved(edges, firms, caps, cycles=3, squared=True)
    got = {(r["buyer"] // 5, r["seller"] // 5): r["weight"] for r in found.weights.collect()}
    assert found.cycles == 3 and len(got) == len(i)
    assert all(got[a, b] == pytest.approx(w, abs=1e-12) for a, b, w in zip(i.tolist(), j.tolist(), x))
    assert found.energy == pytest.approx((x * x).sum() / 2, rel=1e-12)


def test_edges_of_near_firms_are_spread_over_blocks(spark, monkeypatch):
    """Firms that buy within groups of near numbers, as in copies of a network, don't fill the blocks of a group with themselves."""
    monkeypatch.setattr(weights, "SMALL", 5)
    monkeypatch.setattr(weights, "EDGES", 100, raising=False)
    firms = spark.range(400).select("id", F.lit(1.0).alias("size"), (F.col("id") % 3).alias("sector"), F.lit(0.1).alias("delta"))
    near = [(a, a // 50 * 50 + (a * 7 + k * k) % 50) for a in range(400) for k in range(1, 10)]
    edges = spark.createDataFrame([e for e in near if e[0] != e[1]], "buyer long, seller long").distinct()
    net = weights._Network(edges, firms)
    try:
        sizes = [len(r[0]) // 4 for r in net.edges.select("i").collect()]
        assert sum(sizes) == edges.count()
        assert max(sizes) <= 200
    finally:
        net.close()


def test_large_graph_tables_do_not_pass_through_the_driver(spark):
    n = graph.SPREAD + 1
    labels = graph.stored(spark.range(n).select(F.col("id").alias("node"), F.lit(0).cast("long").alias("comp")))
    edges = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"))
    plan = lambda comp: graph.condensation(comp, edges)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan(labels) and "Broadcast" not in plan(labels)
    assert "Broadcast" in plan(graph.stored(labels.limit(100)))
    dropped(labels)
