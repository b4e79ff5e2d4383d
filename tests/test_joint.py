"""The joint choice against all choices."""

import random
import time
from itertools import combinations, product

import numpy as np
import pytest

from loomgraph.lineage import stored
from loomgraph.operators import joint


def tables(spark, seed, pairs, draw, keep):
    rng = random.Random(seed)
    cand = [(p, 10 * p + i, 500 + i, rng.randrange(3), round(rng.random(), 3)) for p in range(pairs) for i in range(draw)]
    sectors = [(l, 1.0 + l, -round(rng.random() * 1.5, 3)) for l in range(3)]
    return cand, sectors, (spark.createDataFrame(cand, "pair long, src long, dst long, l long, delta double"), spark.createDataFrame([(p, keep) for p in range(pairs)], "pair long, n_keep long"), spark.createDataFrame(sectors, "l long, s_l double, base_l double"))


@pytest.mark.parametrize(("seed", "pairs", "draw", "keep"), [(1, 4, 6, 1), (2, 3, 5, 2)])
def test_against_all_choices(spark, seed, pairs, draw, keep):
    cand, sectors, given = tables(spark, seed, pairs, draw, keep)

    def value(rows):
        y = {l: b for l, _, b in sectors}
        for r in rows:
            y[r[3]] += r[4]
        return sum((y[l] / s) ** 2 for l, s, _ in sectors)

    best = min(value([r for part in c for r in part]) for c in product(*(list(combinations([r for r in cand if r[0] == p], keep)) for p in range(pairs))))
    got = joint.choose(*given)
    rows = [tuple(r) for r in got.chosen.collect()]
    assert set(rows) <= set(cand) and all(sum(r[0] == p for r in rows) == keep for p in range(pairs))
    assert got.value == pytest.approx(value(rows))
    assert got.bound <= best + 1e-9 and got.value >= best - 1e-9
    assert got.value <= best + 0.02 and got.ended


def test_two_exchanges_where_one_does_not_help(spark):
    """Each exchange alone makes the inflow worse; both together bring it to zero."""
    cand = [(1, 1, 9, 1, 0.5), (1, 2, 9, 1, 1.1), (2, 3, 9, 1, 0.6), (2, 4, 9, 1, -0.1)]
    rows = spark.createDataFrame([(*r, 1.0 if r[1] in (1, 3) else 0.0) for r in cand], "pair long, src long, dst long, l long, delta double, x double")
    sectors = spark.createDataFrame([(1, 1.0, -1.0)], "l long, s_l double, base_l double")
    new = joint._paired(rows.where("pair > 0"), sectors, 0)
    assert sorted(r["src"] for r in new.where("x = 1").collect()) == [2, 4]


def test_paired_exchanges_of_many_candidates(spark):
    """40,000 candidates of one sector: the best partner on either side is found by order, in time that does not follow the square of their number."""
    rng = random.Random(5)
    cand = [(p, 100_000 * p + i, 9, 1, rng.random(), 1.0 if i == 0 else 0.0) for p in (1, 2) for i in range(20_000)]
    rows = stored(spark.createDataFrame(cand, "pair long, src long, dst long, l long, delta double, x double"))
    began = time.time()
    new = joint._paired(rows, spark.createDataFrame([(1, 1.0, -1.1)], "l long, s_l double, base_l double"), 0)
    took = time.time() - began
    a, b = (np.sort([r[4] for r in cand if r[0] == p]) for p in (1, 2))
    at = np.clip(np.searchsorted(b, 1.1 - a), 1, len(b) - 1)
    best = min(np.abs(a + b[at] - 1.1).min(), np.abs(a + b[at - 1] - 1.1).min())
    assert abs(sum(r["delta"] for r in new.where("x = 1").collect()) - 1.1) == pytest.approx(best, abs=1e-12)
    assert took < 60


def test_least_norm():
    rng = np.random.default_rng(3)
    for _ in range(20):
        p = rng.normal(1.0, 1.0, (8, 4))
        x = joint.least_norm(p) @ p
        assert (p @ x >= x @ x - 1e-8).all()


def test_errors(spark):
    _, _, (cand, quotas, sectors) = tables(spark, 3, 2, 2, 1)
    with pytest.raises(ValueError):
        joint.choose(cand, quotas, sectors.selectExpr("l", "0.0D as s_l", "base_l"))
    with pytest.raises(ValueError):
        joint.choose(cand.where("pair = 0"), quotas, sectors)
