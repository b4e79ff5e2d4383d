"""Choosing candidate edges jointly, with a proven bound: n_keep of each pair, where pairs share sectors.

minimise the sum over sectors of (y_l / s_l)**2, y_l = base_l + the deltas of chosen candidates. Only the vector of y / s
counts, so the relaxation asks for the point of least norm in the hull of what whole choices can give. Wolfe's algorithm finds it:
a choice that is best along the present point is a ranking of the candidates within their pairs, one Spark job, and the point among the
choices found so far is worked out on the driver from one number for each sector and choice. The last ranking proves a bound:
by duality no choice has a norm below (point . best choice) / |point|.

The relaxed choice is then rounded pair by pair, and exchanges improve it: a candidate for another of its pair, or two such
exchanges in two pairs that share a sector, which together bring its inflow nearest to zero. Partners are found by order, as the
nearest neighbour of what is missing, never by trying all of them; pairs are split in two halves by one bit of their rank within the
sector after the other, so that every two pairs meet.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.lineage import dropped, stored
from loomgraph.operators import selection

#: Chosen candidates of a pair and sector that paired exchanges may give up: the smallest and the largest deltas. A single exchange may give up any.
GIVEN_UP = 2
KEY = ["pair", "src", "dst"]


@dataclass
class Choice:
    """The chosen candidates (pair, src, dst, l, delta), their objective, a lower bound of any choice's, and whether the search came to its end."""

    chosen: DataFrame
    value: float
    bound: float
    rankings: int
    exchanges: int
    ended: bool

    @property
    def gap(self) -> float:
        return self.value - self.bound


def least_norm(points: np.ndarray) -> np.ndarray:
    """Weights of the point of least norm in the hull of a few points: the affine minimum of the points kept, those of negative weight leave one by one."""
    best = int((points**2).sum(1).argmin())
    kept, w = [best], np.array([1.0])
    for _ in range(50 * len(points)):
        x = w @ points[kept]
        along = points @ x
        new = int(along.argmin())
        if along[new] >= x @ x - 1e-13 * max(1.0, float((points**2).sum(1).max())) or new in kept:
            break
        kept, w = [*kept, new], np.append(w, 0.0)
        while True:
            p = points[kept]
            n = len(kept)
            system = np.block([[p @ p.T + 1e-15 * np.trace(p @ p.T) * np.eye(n), np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]])
            affine = np.linalg.lstsq(system, np.append(np.zeros(n), 1.0), rcond=None)[0][:n]
            if (affine > 1e-12).all():
                w = affine
                break
            low = affine <= 1e-12
            step = min(1.0, float((w[low] / np.maximum(w[low] - affine[low], 1e-300)).min()))
            w = w + step * (affine - w)
            stay = w > 1e-12
            if stay.all():
                stay[int(w.argmin())] = False
            kept, w = [k for k, s in zip(kept, stay, strict=True) if s], w[stay] / w[stay].sum()
    out = np.zeros(len(points))
    out[kept] = w
    return out


def _ranked(rows: DataFrame, cost: Column, name: str) -> DataFrame:
    """rows with name, 1 for the n_keep candidates of least cost in each pair."""
    order = Window.partitionBy("pair").orderBy("_cost", "src", "dst")
    return rows.withColumn("_cost", cost).withColumn(name, (F.row_number().over(order) <= F.col("n_keep")).cast("double")).drop("_cost")


def relaxed(cand: DataFrame, sectors: list[tuple], steps: int, tolerance: float) -> tuple[DataFrame, float, int]:
    """(candidates with x between 0 and 1, lower bound, rankings). cand: (KEY, l, delta, n_keep); sectors: (l, s_l, base_l)."""
    names = [l for l, _, _ in sectors]
    size, base = (np.array([float(r[i]) for r in sectors]) for i in (1, 2))
    place = {l: i for i, l in enumerate(names)}
    kind = dict(cand.dtypes)["l"]
    atoms: list[np.ndarray] = []
    rows = cand.withColumn("_z", F.array().cast("array<double>"))
    point, bound, weights = base / size, 0.0, np.array([])
    for k in range(steps):
        # along the point: one number for each sector
        price = cand.sparkSession.createDataFrame([(l, float(v)) for l, v in zip(names, point / size, strict=True)], f"l {kind}, _price double")
        new = _ranked(rows.join(F.broadcast(price), "l"), F.col("_price") * F.col("delta"), "_new").drop("_price")
        old, rows = rows, stored(new.withColumn("_z", F.concat("_z", F.array("_new"))).drop("_new"))
        if k:
            dropped(old)
        y = base.copy()
        for r in rows.groupBy("l").agg(F.sum(F.col("delta") * F.element_at("_z", -1)).alias("d")).collect():
            y[place[r["l"]]] += r["d"]
        atoms.append(y / size)
        if k:
            along, norm = float(point @ atoms[-1]), float(point @ point)
            if norm > 0 and along > 0:
                bound = max(bound, along * along / norm)
            if norm - along <= tolerance * max(norm, 1e-300) or norm <= tolerance**2:
                break
        weights = least_norm(np.array(atoms))
        point = weights @ np.array(atoms)
    share = np.append(weights, np.zeros(len(atoms) - len(weights)))
    x = sum((F.col("_z")[i] * float(w) for i, w in enumerate(share) if w > 0), F.lit(0.0))
    best = int((np.array(atoms) ** 2).sum(1).argmin())
    return rows.withColumns({"x": x, "_best": F.col("_z")[best]}).drop("_z"), bound, len(atoms)


def _paired(rows: DataFrame, sectors: DataFrame, bit: int) -> DataFrame | None:
    """rows after the best two exchanges in two pairs for every sector where these help; None if there are none. Pairs are on two sides, by a bit of their rank in the sector."""
    y = selection._inflows(rows, sectors, "x").select("l", "y")
    rank = rows.select("l", "pair").distinct().withColumn("_side", F.shiftright(F.row_number().over(Window.partitionBy("l").orderBy("pair")) - 1, bit).bitwiseAND(1))
    own = Window.partitionBy("l", "pair")
    out = rows.where("x = 1").withColumns({"_r": F.row_number().over(own.orderBy("delta", "src", "dst")), "_n": F.count(F.lit(1)).over(own)})
    out = out.where((F.col("_r") <= GIVEN_UP) | (F.col("_r") > F.col("_n") - GIVEN_UP)).select("l", "pair", F.struct("src", "dst", "delta").alias("out"))
    moves = rows.where("x = 0").select("l", "pair", F.struct("src", "dst", "delta").alias("come")).join(out, ["l", "pair"]).withColumn("shift", F.col("come.delta") - F.col("out.delta"))
    stay = rows.select("l", "pair").distinct().select("l", "pair", F.lit(None).cast(moves.schema["come"].dataType).alias("come"), F.lit(None).cast(moves.schema["out"].dataType).alias("out"), F.lit(0.0).alias("shift"))
    moves = moves.unionByName(stay).join(rank, ["l", "pair"]).join(y, "l")
    # side 0 stands at what it would want from side 1, in one order with what that has
    move = F.struct("pair", "out", "come", "shift")
    at = moves.select("l", "y", "_side", F.when(F.col("_side") == 0, -F.col("y") - F.col("shift")).otherwise(F.col("shift")).alias("_at"), move.alias("move"))
    # what follows is looked for in the reverse order: frames that reach to the end are worked out anew for each row
    line, back = Window.partitionBy("l").orderBy("_at", "_side", "move"), Window.partitionBy("l").orderBy(*(F.desc(c) for c in ("_at", "_side", "move")))
    there = F.when(F.col("_side") == 1, F.col("move"))
    at = at.withColumns({name: F.last(there, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for name, w in (("_low", line), ("_high", back))})
    both = at.where("_side = 0").select("l", "y", "move", F.explode(F.array("_low", "_high")).alias("other")).where("other is not null")
    miss = F.abs(F.col("y") + F.col("move.shift") + F.col("other.shift"))
    best = both.withColumn("_miss", miss).groupBy("l", "y").agg(F.min(F.struct("_miss", "move", "other")).alias("b")).where(F.col("b._miss") < F.abs("y") - 1e-12)
    change = best.select(F.explode(F.array("b.move", "b.other")).alias("m")).where("m.come is not null")
    change = change.select("m.pair", F.explode(F.array(F.struct(F.col("m.out.src").alias("src"), F.col("m.out.dst").alias("dst"), F.lit(0.0).alias("_x")), F.struct(F.col("m.come.src").alias("src"), F.col("m.come.dst").alias("dst"), F.lit(1.0).alias("_x")))).alias("c")).select("pair", "c.*")
    change = stored(change)
    if change.isEmpty():
        return None
    return stored(rows.join(change, KEY, "left").withColumn("x", F.coalesce("_x", "x")).drop("_x").select(rows.columns), discard=[rows])


def choose(cand: DataFrame, quotas: DataFrame, sectors: DataFrame, steps: int = 40, rounds: int = 40, tolerance: float = 1e-6) -> Choice:
    """The choice, its value and bound. cand: (pair, src, dst, l, delta); quotas: (pair, n_keep); sectors: (l, s_l, base_l), one row per sector."""
    known = [tuple(r) for r in sectors.select("l", "s_l", "base_l").orderBy("l").collect()]  # sectors are few
    if any(s <= 0 for _, s, _ in known):
        raise ValueError("every sector needs a positive size")
    sectors = stored(sectors.select("l", "s_l", "base_l"))
    rows = stored(cand.select(*KEY, "l", "delta").join(quotas.select("pair", "n_keep"), "pair"))
    if not quotas.where("n_keep > 0").select("pair").join(rows, "pair", "left_anti").isEmpty():
        raise ValueError("a pair has no candidates")
    rows, bound, rankings = relaxed(rows, known, steps, tolerance)
    # the rounded relaxation, or the best whole choice met
    rows = stored(_ranked(rows, -F.col("x"), "_round").select(*KEY, "l", "delta", "_round", "_best"))
    value = {c: selection.objective(selection._inflows(rows, sectors, c)) for c in ("_round", "_best")}
    now = stored(rows.select(*KEY, "l", "delta", F.col(min(value, key=value.get)).alias("x")), discard=[rows])
    most = now.groupBy("l").agg(F.count_distinct("pair").alias("n")).agg(F.max("n")).first()[0] or 1
    bits = max(1, math.ceil(math.log2(max(2, most))))
    exchanges, quiet, turn = 0, 0, 0
    while quiet <= bits and exchanges < rounds:
        # single exchanges take their turn with those of each bit
        new = selection._swapped(now, sectors) if turn == bits else _paired(now, sectors, turn)
        if new is None:
            quiet, turn = quiet + 1, (turn + 1) % (bits + 1)
        else:
            now, quiet, exchanges = new, 0, exchanges + 1
    best = now.where("x = 1").drop("x")
    wrong = selection.picks_per_pair(best, quotas).where("picked <> n_keep")
    if not wrong.isEmpty():
        raise ValueError(f"pairs with another number of edges than asked for: {wrong.limit(5).collect()}")
    value_now = selection.objective(selection._inflows(now, sectors, "x"))
    return Choice(best, value_now, min(bound, value_now), rankings, exchanges, quiet > bits)
