"""Sector tables: shares, supports, sizes and inflows; firm and sector degrees; checks of references."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.scalars import SUPPORT_FLOOR, clipped


def column_shares(flows: DataFrame, value: str = "flow", out: str = "share") -> DataFrame:
    """Each flow divided by its seller sector's total (by 1 if that is 0). Sectors are few, so the window is small."""
    total = F.sum(value).over(Window.partitionBy("l"))
    return flows.withColumn(out, F.col(value) / F.when(total == 0, F.lit(1.0)).otherwise(total))


def max_shares(flows: DataFrame, value: str = "flow", out: str = "s") -> DataFrame:
    """Positive flows divided by the largest; others stay."""
    top = F.broadcast(flows.agg(F.max(value).alias("_top")))
    return flows.crossJoin(top).withColumn(out, F.when(F.col(value) > 0, F.col(value) / F.col("_top")).otherwise(F.col(value))).drop("_top")


def blocks(iot: DataFrame, sij: DataFrame) -> DataFrame:
    """Sector pairs (k, l, s, i_share) where both tables have support.

    Values are clipped (s to [0, 1], flows to 0 and more); a pair counts if both exceed the floor; the
    shares are of the column totals over these pairs.
    """
    i = iot.select("k", "l", clipped(F.col("flow"), 0.0).alias("_i"))
    s = sij.select("k", "l", clipped(F.col("s"), 0.0, 1.0).alias("s"))
    both = i.join(s, ["k", "l"]).where((F.col("s") > SUPPORT_FLOOR) & (F.col("_i") > SUPPORT_FLOOR))
    return column_shares(both, "_i", "i_share").select("k", "l", "s", "i_share")


def common_sectors(mapping: DataFrame, iot: DataFrame, sij: DataFrame) -> DataFrame:
    """Sectors of the mapping that both tables have on both axes."""
    found = mapping.select("sector").distinct()
    for t in (iot, sij):
        for axis in ("k", "l"):
            found = found.intersect(t.select(F.col(axis).alias("sector")))
    return found


def within_sectors(firms: DataFrame, sectors: DataFrame) -> DataFrame:
    return firms.join(sectors.select("sector"), "sector", "left_semi")


def mapped(strength: DataFrame, mapping: DataFrame) -> DataFrame:
    """Firms with their sector: an inner join on firm_id; repeated ids multiply."""
    return strength.join(mapping.select("firm_id", "sector"), "firm_id")


def aligned(strength: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row of counts: firms in each table, matched ones, and those left over on each side. All zero left over: aligned."""
    a, b = strength.select("firm_id", F.lit(1).alias("a")), mapping.select("firm_id", F.lit(1).alias("b"))
    both = a.join(b, "firm_id", "full")
    return both.agg(F.count("a").alias("n_strength"), F.count("b").alias("n_mapping"), F.count(F.when(F.col("b").isNull(), 1)).alias("unmapped"), F.count(F.when(F.col("a").isNull(), 1)).alias("unsized"))


def load_counts(mapping: DataFrame) -> DataFrame:
    """Rows in all, kept (firm and sector known), dropped."""
    ok = F.col("firm_id").isNotNull() & F.col("sector").isNotNull()
    return mapping.agg(F.count(F.lit(1)).alias("total"), F.count(F.when(ok, 1)).alias("kept"), F.count(F.when(~ok, 1)).alias("dropped"))


def sector_sizes(firms: DataFrame, q: str = "q") -> DataFrame:
    return firms.groupBy(F.col("sector").alias("l")).agg(F.sum(q).alias("s_l"))


def with_ends(edges: DataFrame, firms: DataFrame, q: str = "q") -> DataFrame:
    """Edges with the buyer's size and sector k, and the seller's sector l."""
    b = firms.select(F.col("id").alias("buyer"), F.col(q).alias("q_i"), F.col("sector").alias("k"))
    s = firms.select(F.col("id").alias("seller"), F.col("sector").alias("l"))
    return edges.join(b, "buyer").join(s, "seller")


def inflow_balance(firms: DataFrame, edges: DataFrame, incidence: DataFrame, q: str = "q") -> DataFrame:
    """(l, s_l, b_l, base_l): size of each sector, expected inflow over edges, and their difference.

    incidence: (k, l, w), 1 where the sector table has a positive entry. Edges are summed by sector pair before
    the pair is looked up, so the lookup joins a table of sectors only.
    """
    by_pair = with_ends(edges.where("buyer <> seller"), firms, q).groupBy("k", "l").agg(F.sum("q_i").alias("_q"))
    b = by_pair.join(incidence, ["k", "l"]).groupBy("l").agg(F.sum(F.col("_q") * F.col("w")).alias("b_l"))
    out = sector_sizes(firms, q).join(b, "l", "left").withColumn("b_l", F.coalesce("b_l", F.lit(0.0)))
    return out.withColumn("base_l", F.col("b_l") - F.col("s_l"))


def incidence(flows: DataFrame) -> DataFrame:
    return flows.select("k", "l", (F.col("flow") > 0).cast("double").alias("w"))


def firm_degrees(firms: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree) of all firms; one pass over the edges' ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("buyer").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("seller").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    d = ends.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    return firms.select("id").join(d, "id", "left").select("id", F.coalesce("o", F.lit(0)).alias("out_degree"), F.coalesce("i", F.lit(0)).alias("in_degree"))


def sector_edges(firms: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges into each seller sector."""
    s = firms.select(F.col("id").alias("seller"), F.col("sector").alias("l"))
    return edges.join(s, "seller").groupBy("l").agg(F.count(F.lit(1)).alias("n_edges"))


def node_count(edges: DataFrame) -> DataFrame:
    """Number of firms that any edge touches."""
    return edges.select(F.explode(F.array("buyer", "seller")).alias("id")).agg(F.count_distinct("id").alias("n_nodes"))


def supplier_arrays(edges: DataFrame) -> DataFrame:
    """(buyer, suppliers): distinct suppliers in ascending order. A row is one buyer's list, as the file format needs it."""
    return edges.groupBy("buyer").agg(F.sort_array(F.collect_set("seller")).alias("suppliers"))


def reference_checks(rows: DataFrame, money: DataFrame, sectors: DataFrame, eps0: float = 0.0) -> DataFrame:
    """Counts of violations, a row per check. rows: (buyer, suppliers); money: (id, size); sectors: (id, sector)."""
    spark = rows.sparkSession
    edges = rows.select("buyer", F.explode("suppliers").alias("seller"))
    nodes = edges.select(F.explode(F.array("buyer", "seller")).alias("id")).distinct()
    top = nodes.agg(F.max("id").alias("top"))
    sized = money.where(F.col("size") > 0)
    checks = {
        "duplicate_buyer": rows.groupBy("buyer").count().where("count > 1"),
        "no_supplier": rows.where(F.size("suppliers") == 0),
        "node_without_row": nodes.join(rows.select(F.col("buyer").alias("id")), "id", "left_anti"),
        "buyer_without_sector": rows.select(F.col("buyer").alias("id")).join(sectors, "id", "left_anti"),
        "size_not_positive": nodes.join(sized, "id", "left_anti"),
        "id_above_network": money.crossJoin(F.broadcast(top)).where(F.col("id") > F.col("top")),
        "weights_above_one": rows.where(F.size("suppliers") * eps0 > 1),
    }
    out = None
    for name, df in checks.items():
        one = df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], "check string, violations long")


def with_tolerance(firms: DataFrame, deltas: DataFrame, default: float = 0.10) -> DataFrame:
    """Firms with delta: the last non-negative one given, else the default; and the band (low, high) of their size."""
    given = deltas.where(F.col("delta") >= 0).groupBy("id").agg(F.max_by("delta", "line").alias("delta"))
    out = firms.join(given, "id", "left").withColumn("delta", F.coalesce("delta", F.lit(default)))
    return out.withColumns({"low": (1 - F.col("delta")) * F.col("size"), "high": (1 + F.col("delta")) * F.col("size")})
