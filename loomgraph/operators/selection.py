"""Choosing candidate edges: n_keep of each pair, so that sector inflows stay small for their sizes.

minimise the sum over sectors of (y_l / s_l)**2, y_l = base_l + the deltas of chosen candidates, with exactly
n_keep candidates of each pair. Frank-Wolfe steps on the relaxation: each takes, for every pair, the
candidates of smallest gradient, which is itself a whole-number choice; the best choice met is then improved by
swaps of a chosen candidate for another of its pair, until none helps. The relaxation's gap gives a lower
bound. Steps are grouped sums and a ranking within pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.graph import stored


def _inflows(chosen: DataFrame, sectors: DataFrame, weight: str) -> DataFrame:
    add = chosen.groupBy("l").agg(F.sum(F.col("delta") * F.col(weight)).alias("_add"))
    return sectors.join(add, "l", "left").select("l", "s_l", "base_l", (F.col("base_l") + F.coalesce("_add", F.lit(0.0))).alias("y"))


def objective(inflows: DataFrame) -> float:
    return inflows.agg(F.sum(F.pow(F.col("y") / F.col("s_l"), 2))).first()[0] or 0.0


def _swapped(rows: DataFrame, sectors: DataFrame) -> DataFrame | None:
    """rows (with x, 1 for chosen candidates) after swaps that lower the objective; None if none does.

    Of each pair the chosen candidate goes whose loss helps most, and the one comes that fits best without it. Swaps that touch no
    sector in common are made together, the best ones first; at most one for each sector is looked at by the driver.
    """
    y = stored(_inflows(rows, sectors, "x"))
    now = rows.join(F.broadcast(y.select("l", "y", "s_l")), "l")
    square = lambda d, s: (F.pow(F.col("y") + d, 2) - F.pow("y", F.lit(2.0))) / F.pow(s, F.lit(2.0))
    gone = now.where("x = 1").withColumn("_c", square(-F.col("delta"), "s_l")).groupBy("pair").agg(F.min(F.struct("_c", "src", "dst", "l", "delta")).alias("e"))
    left = now.where("x = 0").join(gone, "pair").withColumn("y", F.col("y") - F.when(F.col("l") == F.col("e.l"), F.col("e.delta")).otherwise(0.0))
    come = left.withColumn("gain", F.col("e._c") + square(F.col("delta"), "s_l")).groupBy("pair").agg(F.min(F.struct("gain", "src", "dst", "l", "e")).alias("f"))
    best = come.where(F.col("f.gain") < -1e-12).groupBy("f.l").agg(F.min(F.struct("f.gain", "pair", "f")).alias("s")).select("s.*").orderBy("gain", "pair").collect()
    used, made = set(), []
    for r in best:
        if used.isdisjoint((r["f"]["l"], r["f"]["e"]["l"])):
            used |= {r["f"]["l"], r["f"]["e"]["l"]}
            made += [(r["pair"], z["src"], z["dst"], x) for z, x in ((r["f"]["e"], 0.0), (r["f"], 1.0))]
    if not made:
        return None
    kinds = dict(rows.dtypes)
    change = rows.sparkSession.createDataFrame(made, f"pair {kinds['pair']}, src {kinds['src']}, dst {kinds['dst']}, _x double")
    return stored(rows.join(F.broadcast(change), ["pair", "src", "dst"], "left").withColumn("x", F.coalesce("_x", "x")).drop("_x").select(rows.columns), discard=[rows])


def choose(cand: DataFrame, quotas: DataFrame, sectors: DataFrame, steps: int = 8, swaps: int = 20) -> tuple[DataFrame, float, float]:
    """(chosen candidates, their objective, lower bound). It is an error if a pair has fewer candidates than it has to give. cand: (pair, src, dst, l, delta); quotas: (pair, n_keep); sectors: (l, s_l, base_l)."""
    if not sectors.where("s_l <= 0").isEmpty():
        raise ValueError("every sector needs a positive size")
    sectors = stored(sectors.select("l", "s_l", "base_l"))
    now = stored(cand.join(quotas.select("pair", "n_keep"), "pair").withColumn("x", F.lit(0.0)))
    if now.isEmpty():
        value = objective(sectors.withColumn("y", F.col("base_l")))
        if not quotas.where("n_keep > 0").isEmpty():
            raise ValueError("there are no candidates")
        return now.drop("x", "n_keep"), value, value
    best, best_value, bound = None, float("inf"), float("-inf")
    first = True
    for step in range(steps):
        y = stored(_inflows(now, sectors, "x"))
        # sectors are few; their gradients go to every task
        g = now.join(F.broadcast(y.select("l", (2 * F.col("y") / F.pow("s_l", F.lit(2.0))).alias("_g"))), "l").withColumn("_cost", F.col("_g") * F.col("delta"))
        own = Window.partitionBy("pair").orderBy("_cost", "src", "dst")
        g = stored(g.withColumn("z", (F.row_number().over(own) <= F.col("n_keep")).cast("double")))
        value = objective(_inflows(g, sectors, "z"))
        if value < best_value:
            best, best_value = g.where("z = 1").select("pair", "src", "dst", "l", "delta"), value
        if not first:
            gap = g.agg(F.sum((F.col("x") - F.col("z")) * F.col("_cost"))).first()[0] or 0.0
            bound = max(bound, objective(y) - gap)
            if gap <= 1e-9 * max(1.0, abs(bound)):
                break
        share = 1.0 if first else 2.0 / (step + 2)
        first = False
        now = stored(g.withColumn("x", F.col("x") + share * (F.col("z") - F.col("x"))).drop("_g", "_cost", "z"), discard=[now])
    rows = stored(cand.select("pair", "src", "dst", "l", "delta").join(best.select("pair", "src", "dst", F.lit(1.0).alias("x")), ["pair", "src", "dst"], "left").fillna(0.0, ["x"]))
    for _ in range(swaps):
        new = _swapped(rows, sectors)
        if new is None:
            break
        rows = new
    best = rows.where("x = 1").drop("x")
    best_value = objective(_inflows(rows, sectors, "x"))
    wrong = picks_per_pair(best, quotas).where("picked <> n_keep")
    if not wrong.isEmpty():
        raise ValueError(f"pairs with another number of edges than asked for: {wrong.limit(5).collect()}")
    return best, best_value, min(bound, best_value)


def picks_per_pair(chosen: DataFrame, quotas: DataFrame) -> DataFrame:
    """(pair, n_keep, picked): the two must be equal."""
    n = chosen.groupBy("pair").agg(F.count(F.lit(1)).alias("picked"))
    return quotas.select("pair", "n_keep").join(n, "pair", "left").withColumn("picked", F.coalesce("picked", F.lit(0)))
