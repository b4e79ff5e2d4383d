"""The constrained fit: links as near to their target as bands on sector inflows allow, by an interior-point method.

minimise (links / target - 1)**2 with |inflow_l / s_l - 1| <= band for every seller sector l, over the exponent alpha in its box
and the strength of every block, c = z * factor * s**kappa. A block's factor takes up what z and kappa do, so only the strength is
determined; of all z, kappa and factors that give it, split() takes those whose factors are nearest to 1.

Link probabilities depend on log q_i + log q_j only. So sizes are put on a grid of `resolution` in log size, the
histograms of two sectors are convolved once for each block, and all iterations work on these pair histograms: their
length follows from the range of sizes and the resolution, not from the number of firms. gravity.error_bound() says what the grid costs.
Sizes on the grid already (or equal ones) lose nothing.

An iteration is one job that sums links, inflow and their first and second derivatives by block. Only these sums come to the
driver: one row for each pair of sectors that trade, as many as the sector tables have cells. The Newton system is solved there by its
structure, an arrow of the blocks and alpha plus one direction for the links and one for each sector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.scalars import ALPHA_BOX, KAPPA_BOX, SATURATED, SIZE_FLOOR, SUPPORT_FLOOR
from loomgraph.lineage import stored
from loomgraph.operators.gravity import BAND, MEAN_DEGREE, Parameters

#: Step in log size by default: an expected link is off by 1 % at most.
RESOLUTION = 0.01
TOLERANCE = 1e-8


def sector_histograms(firms: DataFrame, resolution: float = RESOLUTION, q: str = "q") -> DataFrame:
    """(sector, bin, n, size): number and total size of a sector's firms by rounded log size."""
    size = F.greatest(F.col(q), F.lit(SIZE_FLOOR))
    rows = firms.select("sector", F.rint(F.log(size) / resolution).cast("int").alias("bin"), size.alias("_q"))
    return rows.groupBy("sector", "bin").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("_q").alias("size"))


def pair_histograms(firms: DataFrame, blocks: DataFrame, resolution: float = RESOLUTION, q: str = "q") -> DataFrame:
    """(k, l, step, n, v): pairs of a buyer in k and another firm, the seller, in l by the sum of their bins; v sums the buyers' sizes.

    A sector's histogram is one row, as long as its range of log sizes has steps; blocks meet two of them and convolve them.
    """
    own = sector_histograms(firms, resolution, q).groupBy("sector").agg(F.sort_array(F.collect_list(F.struct("bin", "n", "size"))).alias("h"))
    kinds = dict(blocks.dtypes)
    both = blocks.select("k", "l").join(own.select(F.col("sector").alias("k"), F.col("h").alias("a")), "k").join(own.select(F.col("sector").alias("l"), F.col("h").alias("b")), "l").select("k", "l", "a", "b")

    def dense(rows: pa.Array) -> tuple[int, np.ndarray, np.ndarray]:
        bins, n, size = (rows.field(i).to_numpy() for i in range(3))
        out = np.zeros((2, bins[-1] - bins[0] + 1))
        out[:, bins - bins[0]] = n, size
        return int(bins[0]), out[0], out[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                (lo, n, size), (low, m, _) = dense(b.column(2)[i].values), dense(b.column(3)[i].values)
                pairs, value = np.convolve(n, m), np.convolve(size, m)
                if b.column(0)[i] == b.column(1)[i]:  # a firm does not buy from itself
                    pairs[2 * np.arange(len(n))] -= n
                    value[2 * np.arange(len(n))] -= size
                at = np.flatnonzero(np.rint(pairs))
                same = lambda c: pa.array([b.column(c)[i].as_py()] * len(at), b.schema.field(c).type)
                yield pa.RecordBatch.from_arrays([same(0), same(1), pa.array((at + lo + low).astype(np.int32)), pa.array(np.rint(pairs[at])), pa.array(value[at])], names=["k", "l", "step", "n", "v"])

    return both.mapInArrow(run, f"k {kinds['k']}, l {kinds['l']}, step int, n double, v double")


KERNEL = ("p", "w", "wl", "w2", "w2l", "w2ll", "e", "f", "fl", "f2", "f2l", "f2ll")


def kernel(pairs: DataFrame, strengths: DataFrame, resolution: float) -> DataFrame:
    """(k, l, KERNEL): links p of a block, their first and second derivatives by log strength (w, w2), by alpha (wl, w2ll) and by both (w2l); the same of inflow, from e on.

    strengths: (k, l, t, alpha), t the log of a block's strength, one row for each pair of sectors that trade. alpha is a column,
    so that the code made for the sums is the same in every iteration.
    """
    size = F.col("step") * F.lit(resolution)
    x = F.exp(F.col("t") + F.col("alpha") * size)
    rows = pairs.join(strengths, ["k", "l"]).select("k", "l", "n", "v", size.alias("_s"), x.alias("_x"))
    p = F.when(F.col("_x") > SATURATED, F.lit(1.0)).otherwise(F.col("_x") / (1 + F.col("_x")))
    w = F.when(F.col("_x") > SATURATED, F.lit(0.0)).otherwise(p * (1 - p))
    terms = [p, w, w * F.col("_s"), w * (1 - 2 * p), w * (1 - 2 * p) * F.col("_s"), w * (1 - 2 * p) * F.col("_s") ** 2]
    sums = [F.sum(F.col(of) * t) for of in ("n", "v") for t in terms]
    return rows.groupBy("k", "l").agg(*(s.alias(name) for s, name in zip(sums, KERNEL, strict=True)))


@dataclass
class Report:
    """What a fit found, and how it ended. kkt is the largest of the gradient of the Lagrangian, the violation of bands and the complementarity."""

    parameters: Parameters
    strengths: dict[tuple, float]
    links: float
    target: float
    objective: float
    kkt: float
    iterations: int
    evaluations: int
    converged: bool
    gaps: dict = field(default_factory=dict)
    multipliers: dict = field(default_factory=dict)

    def rows(self) -> list[tuple[str, float]]:
        """(name, value) of everything but the sectors."""
        p = self.parameters
        named = {"z": p.z, "alpha": p.alpha, "kappa": p.kappa, "factor_min": min(p.factors.values()), "factor_max": max(p.factors.values()), "links": self.links, "target": self.target}
        return [(k, float(v)) for k, v in (named | {"objective": self.objective, "kkt": self.kkt, "iterations": self.iterations, "evaluations": self.evaluations, "converged": self.converged}).items()]


class ConstrainedFit:
    """The problem on one firm table and block table. blocks: (k, l, s, i_share)."""

    def __init__(self, firms: DataFrame, blocks: DataFrame, q: str = "q", degree: float = MEAN_DEGREE, band: float = BAND, resolution: float = RESOLUTION):
        self.band, self.resolution, self.spark = band, resolution, firms.sparkSession
        size = F.greatest(F.col(q), F.lit(SIZE_FLOOR))
        per = {r["sector"]: r for r in firms.groupBy("sector").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("s")).collect()}  # one row per sector
        self.target = degree * sum(r["n"] for r in per.values())
        self.pairs = stored(pair_histograms(firms, blocks, resolution, q))
        self.kinds = dict(blocks.dtypes)
        # one row per pair of sectors; blocks without a pair of firms have no links
        found = {(r["k"], r["l"]) for r in self.pairs.select("k", "l").distinct().collect()}
        rows = sorted((r["k"], r["l"], max(r["s"], SUPPORT_FLOOR), r["i_share"]) for r in blocks.select("k", "l", "s", "i_share").collect() if (r["k"], r["l"]) in found)
        if not rows:
            raise ValueError("no block has a pair of firms")
        self.keys = [(k, l) for k, l, _, _ in rows]
        self.place = {b: i for i, b in enumerate(self.keys)}
        self.log_s, self.share = (np.array([r[c] for r in rows]) for c in (2, 3))
        self.log_s = np.log(self.log_s)
        self.sectors = sorted({l for _, l in self.keys})
        at = {l: i for i, l in enumerate(self.sectors)}
        self.seller = np.array([at[l] for _, l in self.keys])
        self.sizes = np.array([per[l]["s"] for l in self.sectors])
        self.evaluations = 0

    def sums(self, t: np.ndarray, alpha: float) -> dict[str, np.ndarray]:
        kind = f"k {self.kinds['k']}, l {self.kinds['l']}, t double, alpha double"
        k, l = zip(*self.keys, strict=True)
        strengths = self.spark.createDataFrame(pa.table({"k": pa.array(k), "l": pa.array(l), "t": pa.array(t), "alpha": pa.array([float(alpha)] * len(t))}), kind)
        out = {name: np.zeros(len(self.keys)) for name in KERNEL}
        for r in kernel(self.pairs, F.broadcast(strengths), self.resolution).collect():
            i = self.place[(r["k"], r["l"])]
            for name in KERNEL:
                out[name][i] = r[name] * (self.share[i] if name in KERNEL[6:] else 1.0)
        self.evaluations += 1
        return out

    def by_sector(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.seller, x, len(self.sectors))

    def start(self, alpha: float = 0.5, rounds: int = 12) -> tuple[np.ndarray, dict]:
        """Log strengths at which each sector's inflow is about its size: equal within a sector, by Newton steps per sector."""
        t = np.full(len(self.keys), math.log(0.01))
        for _ in range(rounds):
            now = self.sums(t, alpha)
            e, slope = self.by_sector(now["e"]), self.by_sector(now["f"])
            step = np.clip(e / np.maximum(slope, 1e-300) * np.log(self.sizes / np.maximum(e, 1e-300)), -3, 3)
            if np.abs(e / self.sizes - 1).max() < 0.25 * self.band:
                break
            t = t + step[self.seller]
        return t, self.sums(t, alpha)

    def _arrow(self, g: float, c: np.ndarray, d: np.ndarray, rhs0, rhs):
        """Solves [[g, c], [c', diag d]] for one or more right-hand sides (rhs0, rhs)."""
        over = c / d
        x0 = (rhs0 - over @ rhs) / (g - over @ c)
        return x0, (rhs - np.multiply.outer(c, x0)) / (d if rhs.ndim == 1 else d[:, None])

    def _step(self, now: dict, alpha: float, y: np.ndarray, weight: np.ndarray, grad0: float, grad: np.ndarray, slope: float, bend: float):
        """A Newton step (for alpha's raw value, for log strengths): curvature of the Lagrangian made positive, links and weighted bands as further directions."""
        r = now["p"].sum() / self.target - 1
        a, b = 2 * r / self.target, (y / self.sizes)[self.seller]
        d = a * now["w2"] + b * now["f2"]
        c = (a * now["w2l"] + b * now["f2l"]) * slope
        g = (a * now["w2ll"] + b * now["f2ll"]).sum() * slope**2 + (a * now["wl"] + b * now["fl"]).sum() * bend
        # directions of the links and of every sector
        links = np.concatenate([[now["wl"].sum() * slope], now["w"]]) * math.sqrt(2) / self.target
        inflow = np.zeros((len(self.keys), len(self.sectors)))
        inflow[np.arange(len(self.keys)), self.seller] = now["f"]
        u0 = np.concatenate([[links[0]], self.by_sector(now["fl"]) * slope / self.sizes * np.sqrt(weight)])
        u = np.column_stack([links[1:], inflow / self.sizes * np.sqrt(weight)])
        # least damping for which the arrow is positive definite; scaled as the directions are
        scale = np.maximum((u * u).sum(1), 1e-16)
        damping = 1e-9
        while True:
            dd = np.maximum(d, 0) + np.where(d < 0, np.minimum(-d, scale), 0) + damping * scale + 1e-18
            gg = abs(g) + damping * max(float((u0 * u0).sum()), 1e-12) + 1e-15
            if gg - (c * c / dd).sum() > 1e-3 * gg:
                break
            damping *= 10
        x0, x = self._arrow(gg, c, dd, -grad0, -grad)
        z0, z = self._arrow(gg, c, dd, u0, u)
        inner = np.eye(u.shape[1]) + np.outer(u0, z0) + u.T @ z
        back = np.linalg.solve(inner, u0 * x0 + u.T @ x)
        return float(x0 - z0 @ back), x - z @ back

    def solve(self, tolerance: float = TOLERANCE, steps: int = 120) -> Report:
        """Newton's method on the conditions of the optimum with slacks for both sides of each band, for falling barrier weights."""
        lo, hi = ALPHA_BOX
        box = lambda raw: lo + (hi - lo) / (1 + math.exp(-raw))
        raw = math.log((0.5 - lo) / (hi - 0.5))
        t, now = self.start()
        n, band, mu = len(self.sectors), self.band, 1e-2
        gap = self.by_sector(now["e"]) / self.sizes - 1
        up, down = np.maximum(band - gap, 0.05 * band), np.maximum(band + gap, 0.05 * band)
        y_up, y_down = mu / up, mu / down
        done, kkt = False, math.inf
        for k in range(steps + 1):
            alpha = box(raw)
            slope = (alpha - lo) * (hi - alpha) / (hi - lo)
            bend = slope * (1 - 2 * (alpha - lo) / (hi - lo))
            links = now["p"].sum()
            a = 2 * (links / self.target - 1) / self.target
            b = ((y_up - y_down) / self.sizes)[self.seller]
            grad0, grad = (a * now["wl"].sum() + (b * now["fl"]).sum()) * slope, a * now["w"] + b * now["f"]
            miss_up, miss_down = gap + up - band, -gap + down - band
            first = max(abs(grad0), np.abs(grad).max())
            missed = max(np.abs(miss_up).max(), np.abs(miss_down).max())
            error = lambda m: max(first, missed, np.abs(up * y_up - m).max(), np.abs(down * y_down - m).max())
            kkt = error(0.0)
            if kkt <= tolerance or k == steps:
                done = kkt <= tolerance
                break
            while mu > tolerance / 10 and error(mu) <= 10 * mu:
                mu = max(tolerance / 20, min(0.2 * mu, mu**1.5))
            pull = (mu / up - y_up + y_up / up * miss_up) - (mu / down - y_down + y_down / down * miss_down)
            more = (pull / self.sizes)[self.seller]
            weight = y_up / up + y_down / down
            d0, d = self._step(now, alpha, y_up - y_down, weight, grad0 + (more * now["fl"]).sum() * slope, grad + more * now["f"], slope, bend)
            short = min(1.0, 2.0 / max(abs(d0), np.abs(d).max(), 1e-300))
            d0, d = d0 * short, d * short
            moved = (self.by_sector(now["fl"]) * slope * d0 + self.by_sector(now["f"] * d)) / self.sizes
            s_up, s_down = -miss_up - moved, -miss_down + moved
            v_up, v_down = mu / up - y_up - y_up / up * s_up, mu / down - y_down - y_down / down * s_down
            limit = lambda x, dx: min(1.0, float((0.995 * x[dx < 0] / -dx[dx < 0]).min(initial=1.0)))  # noqa: E731, B023
            primal, dual = min(limit(up, s_up), limit(down, s_down)), min(limit(y_up, v_up), limit(y_down, v_down))

            # the barrier function with a price on missed bands must not rise
            price = 2 * max(1e-4, y_up.max(), y_down.max())

            def merit(p: float, g: np.ndarray, s1: np.ndarray, s2: np.ndarray) -> float:
                return (p / self.target - 1) ** 2 - mu * (np.log(s1).sum() + np.log(s2).sum()) + price * (np.abs(g + s1 - band).sum() + np.abs(-g + s2 - band).sum())  # noqa: B023

            before = merit(links, gap, up, down)
            for _ in range(12):
                new_raw, new_t = raw + primal * d0, t + primal * d
                trial = self.sums(new_t, box(new_raw))
                new_gap = self.by_sector(trial["e"]) / self.sizes - 1
                # slacks are what the gaps leave of the band, where that is more than a small part of what was left
                new_up = np.where(band - new_gap > 0.002 * up, band - new_gap, up + primal * s_up)
                new_down = np.where(band + new_gap > 0.002 * down, band + new_gap, down + primal * s_down)
                if merit(trial["p"].sum(), new_gap, new_up, new_down) <= before + 1e-12 * abs(before) + 1e-14:
                    break
                primal /= 2
            raw, t, now, gap, up, down = new_raw, new_t, trial, new_gap, new_up, new_down
            y_up, y_down = y_up + dual * v_up, y_down + dual * v_down
            # multipliers stay near what slacks and the barrier ask for
            y_up, y_down = (np.clip(y, mu / (1e8 * s), 1e8 * mu / s) for y, s in ((y_up, up), (y_down, down)))
        links = float(now["p"].sum())
        return Report(self.split(t, box(raw)), dict(zip(self.keys, np.exp(t).tolist(), strict=True)), links, self.target, (links / self.target - 1) ** 2, float(kkt), k, self.evaluations, done, dict(zip(self.sectors, gap.tolist(), strict=True)), dict(zip(self.sectors, (y_up - y_down).tolist(), strict=True)))

    def split(self, t: np.ndarray, alpha: float) -> Parameters:
        """z, kappa and factors of given log strengths: the least squares of the factors' logs, kappa within its box."""
        spread = self.log_s - self.log_s.mean()
        kappa = float((spread @ t) / (spread @ spread)) if (spread @ spread) > 0 else 0.6
        kappa = min(max(kappa, KAPPA_BOX[0] + 1e-9), KAPPA_BOX[1] - 1e-9)
        level = float((t - kappa * self.log_s).mean())
        factors = np.exp(t - level - kappa * self.log_s)
        return Parameters(math.exp(level), alpha, kappa, dict(zip(self.keys, factors.tolist(), strict=True)))
