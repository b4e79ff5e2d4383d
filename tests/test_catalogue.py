"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomgraph.lineage import stored
from loomgraph.operators import weights
from loomgraph.plans import catalogue
from loomgraph.sources import fixtures

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem".split()
#: The graph queries share their components; one of them is enough here.
SLOW = {"scc_members", "condensation_edges", "topological_levels", "edge_weight_residuals", "fitted_bands", "sector_choice", "sampling_stage"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    clean = lambda v: round(float(v), 6) + 0.0 if isinstance(v, float) else v.item() if hasattr(v, "item") else v
    return sorted((tuple(clean(v) for v in r) for r in df.astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(set(catalogue.ORACLE_SQL) - SLOW))
def test_query_equals_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), duck.execute(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() == 25
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_each_scale_keeps_one_kernel_plan(spark):
    plan = catalogue.block_kernel(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "ReadSchema" not in plan or "p_name" not in plan  # columns are pruned


def test_registered_weights_keep_the_default_bands(spark):
    caps = weights.Caps()
    firms = fixtures.firms(spark, SF).withColumn("delta", F.lit(caps.firm))
    w = stored(weights.solve_capped(*catalogue._network(spark, SF)))
    r = weights.residuals(w, firms, caps).first()
    assert max(r["row_miss"], r["firm_miss"], r["sector_miss"]) <= 1e-4
    # the bands bind: equal shares of all suppliers would miss them
    equal = w.withColumn("weight", 1 / F.count(F.lit(1)).over(Window.partitionBy("buyer")))
    assert weights.residuals(equal, firms, caps).first()["firm_miss"] > 0.1


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)


def test_layers_hold_every_line(spark):
    lines = fixtures.read(spark, SF, "lineitem")
    groups = lines.select("l_orderkey", F.when(F.col("l_returnflag").isin("A", "R"), F.col("l_returnflag")).alias("flag")).distinct().count()
    pairs = fixtures.line_pairs(spark, SF, layered=True)
    assert pairs.count() == lines.count() - groups  # each line but the last of its order and layer begins a pair
    assert pairs.where("buyer % 3 <> seller % 3").isEmpty()
    firms = fixtures.firms(spark, SF)
    assert fixtures.layered_firms(firms).select("id").distinct().count() == 3 * firms.count()


def test_candidates_leave_a_choice(spark, tmp_path):
    """Layers whose firms buy in a ring are components of 160: of 31 candidates a pair gives 2, which SQL finds as well."""
    firms = pd.DataFrame({"p_partkey": range(160), "p_brand": [f"Brand#{11 + i % 7}" for i in range(160)], "p_retailprice": 900.0})
    ring = [*range(160), 0]
    lines = pd.concat([pd.DataFrame({"l_orderkey": k, "l_linenumber": range(1, 162), "l_partkey": [(i * (2 * k + 1)) % 160 if k < 2 else i for i in ring], "l_extendedprice": [float(1 + (37 * i * (k + 1)) % 101) for i in ring], "l_returnflag": flag}) for k, flag in enumerate("ANR")])
    con = duckdb.connect()
    for name, df in (("part", firms), ("lineitem", lines)):
        df.to_parquet(tmp_path / f"{name}.parquet")
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
    quotas = catalogue._pairing(spark, str(tmp_path))[3].select("n_keep", "n_draw").collect()
    assert [tuple(q) for q in quotas] == [(2, 31)] * 3
    got = catalogue.chosen_candidates(spark, str(tmp_path)).toPandas()
    assert len(got) == 6
    assert rows(got) == rows(con.execute(catalogue.ORACLE_SQL["chosen_candidates"]).df())


def test_components_after_follow_from_those_before(spark, duck, monkeypatch):
    """The augmented graph's components are found over the components that the chosen edges join, not over all firms and edges again."""
    calls, found = [], catalogue.graph.strong_components

    def counted(nodes, edges):
        calls.append((nodes.distinct().count(), edges.count()))
        return found(nodes, edges)

    monkeypatch.setattr(catalogue.graph, "strong_components", counted)
    (got,) = catalogue.irreducible_graph(spark, SF).collect()
    assert calls[0][0] == 3 * duck.execute("select count(*) from part").fetchone()[0]
    assert calls[1][0] == got["components_before"] and calls[1][1] < calls[0][1]
    assert got["components_after"] == 1
