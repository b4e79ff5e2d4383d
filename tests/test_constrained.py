"""The constrained fit: derivatives, conditions of the optimum by brute force, and the grid's error bound."""

import math
import random

import numpy as np
import pytest

from loomgraph.operators import constrained, gravity
from loomgraph.plans import stages


def setting(spark, n=36, sectors=3, seed=2):
    rng = random.Random(seed)
    firms = [(i + 1, i % sectors, math.exp(0.25 * rng.randint(-8, 0))) for i in range(n)]  # sizes on a grid of 0.25
    blocks = [(k, l, 0.1 + 0.9 * rng.random()) for k in range(sectors) for l in range(sectors) if (k + 2 * l) % 4 != 3]
    total = {l: sum(s for _, m, s in blocks if m == l) for l in range(sectors)}
    rows = [(k, l, s, s / total[l]) for k, l, s in blocks]
    return spark.createDataFrame(firms, "id long, sector long, q double"), spark.createDataFrame(rows, "k long, l long, s double, i_share double"), firms, rows


def links_and_inflow(firms, rows, t, alpha):
    """By all pairs of firms: links, and inflow by seller sector, and their derivatives by log strength and alpha."""
    p_of, e_of = {}, {}
    by_alpha = [0.0, {}]
    for k, l, _, share in rows:
        p = w = e = f = 0.0
        for i, m, q in firms:
            for j, o, r in firms:
                if m == k and o == l and i != j:
                    x = math.exp(t[(k, l)] + alpha * (math.log(q) + math.log(r)))
                    y = x / (1 + x)
                    d = y * (1 - y)
                    p, w, e, f = p + y, w + d, e + share * q * y, f + share * q * d
                    by_alpha[0] += d * (math.log(q) + math.log(r))
                    by_alpha[1][l] = by_alpha[1].get(l, 0.0) + share * q * d * (math.log(q) + math.log(r))
        p_of[(k, l)], e_of[(k, l)] = (p, w), (e, f)
    return p_of, e_of, by_alpha


def test_kernel_equals_all_pairs(spark):
    firms, blocks, plain, rows = setting(spark)
    fit = constrained.ConstrainedFit(firms, blocks, degree=3.0, resolution=0.25)
    t = np.linspace(-2, 1, len(fit.keys))
    now = fit.sums(t, 0.6)
    p, e, by_alpha = links_and_inflow(plain, rows, dict(zip(fit.keys, t, strict=True)), 0.6)
    for i, b in enumerate(fit.keys):
        assert now["p"][i] == pytest.approx(p[b][0]) and now["w"][i] == pytest.approx(p[b][1])
        assert now["e"][i] == pytest.approx(e[b][0]) and now["f"][i] == pytest.approx(e[b][1])
    assert now["wl"].sum() == pytest.approx(by_alpha[0])
    h = 1e-5
    up, down = fit.sums(t + h, 0.6), fit.sums(t - h, 0.6)
    right, left = fit.sums(t, 0.6 + h), fit.sums(t, 0.6 - h)
    for first, second, mixed, twice in (("w", "w2", "w2l", "w2ll"), ("f", "f2", "f2l", "f2ll")):
        assert (up[first] - down[first]) / (2 * h) == pytest.approx(now[second], abs=1e-6)
        assert (right[first] - left[first]) / (2 * h) == pytest.approx(now[mixed], abs=1e-6)
        assert (right[first + "l"] - left[first + "l"]) / (2 * h) == pytest.approx(now[twice], abs=1e-6)


@pytest.mark.parametrize("degree", [6.0, 0.3])
def test_conditions_of_the_optimum(spark, degree):
    """A target out of reach, above and below: bands bind, and the Lagrangian's gradient, taken over all pairs of firms, vanishes."""
    firms, blocks, plain, rows = setting(spark)
    fit = constrained.ConstrainedFit(firms, blocks, degree=degree, resolution=0.25)
    got = fit.solve()
    assert got.converged and got.kkt <= 1e-8 and got.objective > 1e-4
    t = {b: math.log(c) for b, c in got.strengths.items()}
    p, e, by_alpha = links_and_inflow(plain, rows, t, got.parameters.alpha)
    links = sum(v[0] for v in p.values())
    assert links == pytest.approx(got.links)
    size = {l: sum(q for _, m, q in plain if m == l) for l in range(3)}
    pull = 2 * (links / got.target - 1) / got.target
    y = got.multipliers
    for (k, l), (_, w) in p.items():
        assert abs(pull * w + y[l] / size[l] * e[(k, l)][1]) < 1e-7
    a, (lo, hi) = got.parameters.alpha, constrained.ALPHA_BOX
    assert abs((pull * by_alpha[0] + sum(y[l] / size[l] * v for l, v in by_alpha[1].items())) * (a - lo) * (hi - a) / (hi - lo)) < 1e-7
    for l in size:
        gap = sum(v[0] for b, v in e.items() if b[1] == l) / size[l] - 1
        assert abs(gap) <= 0.1 + 1e-7
        assert abs(y[l]) < 1e-6 or abs(abs(gap) - 0.1) < 1e-4
        assert y[l] * (1 if degree > 1 else -1) > -1e-9  # links pull inflows the same way
    assert any(abs(v) > 1e-4 for v in y.values())
    # the model's parameters give the same strengths
    par, s = got.parameters, {(k, l): s for k, l, s, _ in rows}
    for b, c in got.strengths.items():
        assert par.z * par.factors[b] * s[b] ** par.kappa == pytest.approx(c)


def test_a_target_within_reach_is_met(spark):
    firms, blocks, _, _ = setting(spark)
    fit = constrained.ConstrainedFit(firms, blocks, degree=2.2, resolution=0.25)
    t, now = fit.start()
    off = now["p"].sum() / fit.target - 1
    got = fit.solve()
    assert got.converged and got.objective < 1e-12 and max(map(abs, got.gaps.values())) <= 0.1
    assert got.objective < off**2


def test_the_grid_keeps_its_bound(spark):
    rng = random.Random(5)
    firms = spark.createDataFrame([(i, i % 2, rng.random() + 0.01) for i in range(80)], "id long, sector long, q double")
    blocks = spark.createDataFrame([(k, l, 0.5, 0.5) for k in range(2) for l in range(2)], "k long, l long, s double, i_share double")
    par = gravity.Parameters(0.8)
    exact = {(r["k"], r["l"]): r["p"] for r in gravity.block_sums(firms, blocks, par).collect()}
    strengths = spark.createDataFrame([(k, l, math.log(0.8 * 0.5**0.6)) for k in range(2) for l in range(2)], "k long, l long, t double").selectExpr("*", "0.5D as alpha")
    for resolution in (0.3, 0.05, 0.001):
        got = constrained.kernel(constrained.pair_histograms(firms, blocks, resolution), strengths, resolution).collect()
        assert len(got) == 4
        for r in got:
            assert abs(r["p"] / exact[(r["k"], r["l"])] - 1) <= gravity.error_bound(par.alpha, resolution)


def test_blocks_without_pairs(spark):
    firms = spark.createDataFrame([(1, 1, 1.0), (2, 2, 1.0)], "id long, sector long, q double")
    own = spark.createDataFrame([(1, 1, 1.0, 1.0)], "k long, l long, s double, i_share double")
    with pytest.raises(ValueError):  # a firm alone in its sector buys nothing there
        constrained.ConstrainedFit(firms, own)


def test_fit_stage_reports(spark, tmp_path):
    p = lambda name: str(tmp_path / name)
    (tmp_path / "map.csv").write_text("Firm_ID,SIC\n" + "".join(f"Firm_{i + 1},{10 + i % 2}\n" for i in range(30)))
    (tmp_path / "size.csv").write_text("Firm_ID,Size\n" + "".join(f"Firm_{i + 1},{1 + i % 3}\n" for i in range(30)))
    (tmp_path / "m.csv").write_text("x,10,11\n10,0.7,0.2\n11,0.3,0.8\n")
    _, violated = stages.fit(spark, p("map.csv"), p("size.csv"), p("m.csv"), p("m.csv"), p("edges"), mean_degree=9.0, report_out=p("report"))
    report = {r["name"]: r["value"] for r in spark.read.csv(p("report"), header=True).collect()}
    assert float(report["target"]) == 270.0 and float(report["kkt"]) <= 1e-7 and float(report["objective"]) > 0.01
    status = [v for k, v in report.items() if k.endswith("status")]
    assert len(status) == 2 and status.count("VIOLATED") == violated
    assert all(abs(float(v)) <= 0.1 + 0.01 for k, v in report.items() if k.endswith(" gap"))
    assert any(abs(float(v)) > 1e-4 for k, v in report.items() if k.endswith("multiplier"))
