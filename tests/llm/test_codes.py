"""Vector codes against Lloyd's rounds in whole Python numbers; bounds must change nothing but the work."""

import hashlib
import math
import random

import numpy as np
import pytest

from loomgraph.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, v string, entry int, upper double"


def brute(rows, rounds=4):
    kept = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = next((len(v) for _, v, _ in kept if v and len(v) % 4 == 0), 0)
    fit = [r for r in kept if len(r[1]) == size] if size else []
    w = size // 4
    part = lambda v, j: v[j * w : (j + 1) * w]
    books = [[part(v, j) for _, v, _ in fit[:256]] for j in range(4)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(book))
    for _ in range(rounds):
        for j in range(4):
            mine = {}
            for _, v, _ in fit:
                mine.setdefault(near(part(v, j), books[j])[1], []).append(part(v, j))
            for k, vs in mine.items():
                books[j][k] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    out, by = [], {}
    for i, v, lab in kept:
        found = [near(part(v, j), books[j]) for j in range(4)] if size and len(v) == size else None
        out.append((i, "".join(f"{k:02x}" for _, k in found) if found else None, sum(d for d, _ in found) if found else None, lab))
        if found:
            by[lab] = by.get(lab, 0) + out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((i, c, e, by.get(lab), digest) for i, c, e, lab in out), key=repr)


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, 2.0) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in codes.vector_codes(df).collect()), key=repr)


def vectors(n, size, seed, step=None):
    rng = random.Random(seed)
    value = lambda: float(np.float32(rng.gauss(0, 0.4) if step is None else rng.randint(-3, 3) * step))
    return [(i * 3 - 40, [value() for _ in range(size)], rng.choice((1, 2, 2, 2, None))) for i in range(n)]


def test_many_vectors(spark):
    rows = vectors(700, 8, 1)
    assert found(spark, rows) == brute(rows)


def test_ties_and_copies(spark):
    rows = vectors(400, 4, 2, step=1 / 1024) + [(5, [0.0] * 4, 9)] * 30 + [(2000 + i, [-1 / 2048] * 4, None) for i in range(40)]
    assert found(spark, rows) == brute(rows)


def test_odd_rows(spark):
    good = [(3, [0.5, -0.25, 0.1, 2.0], 1), (3, [0.5, -0.25, 0.1, 1.0], 1), (None, [1.0, 1.0, 1.0, 1.0], None)]
    bad = [(1, None, 1), (2, [1.0, None, 1.0, 1.0], 1), (4, [float("nan")] * 4, 1), (6, [float("inf")] * 4, 1)]
    other = [(0, [], 1), (-1, [1.0, 2.0, 3.0], 2), (7, [1.0] * 8, 1)]
    for rows in (good, good + bad, good + bad + other, other[:2], bad, []):
        assert found(spark, rows) == brute(rows), rows


def test_large_components(spark):
    rows = [(i, [x * 1000.0, -x, x * 30000.0, 1.0], 1) for i, x in enumerate([1.0, -7.5, 30.0, 2.25])]
    assert found(spark, rows) == brute(rows)
    with pytest.raises(Exception, match="too large"):
        found(spark, [(1, [1e30, 0.0, 0.0, 0.0], 1)])


@pytest.mark.parametrize(("noise", "spared"), [(50, 0.95), (500, 0.3)])
def test_bounds_spare_scans_and_hold(noise, spared):
    rng = np.random.default_rng(4)
    x = rng.integers(-noise, noise, (3000, 4)) + (np.arange(3000) % 64)[:, None] * (1 if noise > 50 else 4000)
    now = x[:64].copy()
    book = codes.Codebook(now)
    a, upper, lower = book.scan(x)
    scans = []
    for _ in range(5):
        new = now.copy()
        for k in range(64):
            if (a == k).any():
                new[k] = x[a == k].sum(0) // (a == k).sum()
        book, now = codes.Codebook(new, now), new
        a, upper, lower, whole = book.assign(x, a, upper, lower)
        d = ((x[:, None] - now) ** 2).sum(2)
        assert (a == d.argmin(1)).all()
        rows = np.arange(len(x))
        assert (upper >= np.sqrt(d[rows, a])).all()
        d[rows, a] = 10**15
        assert (lower <= np.sqrt(d.min(1))).all()
        scans.append(len(whole))
    assert scans[-1] < (1 - spared) * len(x)


def test_the_state_keeps_bounds(spark):
    df = codes.whole_vectors(spark.createDataFrame([(*r, "x", 1, 2.0) for r in vectors(300, 8, 6)], SCHEMA))
    books = [codes.Codebook(np.array([r["v"][2 * j : 2 * j + 2] for r in df.orderBy("vec_id").limit(16).collect()])) for j in range(4)]
    state = codes.assigned(df, books)
    again = codes.assigned(state.drop("scans"), books)
    assert state.where("scans <> 4").isEmpty()
    one, two = ({r["vec_id"]: r for r in s.collect()} for s in (state, again))
    assert all(one[k]["entry"] == two[k]["entry"] for k in one)
    assert sum(r["scans"] for r in two.values()) < len(two)  # nothing moved: only ties are looked at again
