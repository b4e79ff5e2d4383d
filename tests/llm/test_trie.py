"""The prefix trie against a brute-force one, with and without colliding fingerprints."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from loomgraph.llm import trie

SCHEMA = "conv_id long, turn int, role string, text string, depth string, n int, print string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        whole[c] = own.get(base, [])[:h] + v[h:]
    members = defaultdict(list)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out = {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        below = [out[q] for q in children[p]]
        ends = ",".join(map(str, sorted(c for c in members[p] if len(whole[c]) == len(p))))
        leaves = sum(b[5] for b in below) if below else 1
        saved = (len(members[p]) - 1) * words + sum(b[6] for b in below)
        out[p] = (min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(below), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=lambda r: (r[1], r[0]))


def given(seed=1, n=140):
    rng = random.Random(seed)
    says = ["a b", "a", "", None, " x\ty ", "long one " * 40, "b a", "Ünï 漢"]
    rows = []
    for c in rng.sample(range(-60, 200), n):
        for turn in range(rng.choice((0, 1, 2, 3, 4, 6, 9))):
            rows.append((c, rng.choice((turn, turn, turn, None)), rng.choice(("user", "assistant", None)) if turn > 2 else "user", rng.choice(says[: 2 + turn])))
    rows += [(500 + i, t, "user", f"same {t}") for i in range(60) for t in range(3)]  # many copies
    rows += [(700, t, "user", f"t{t}") for t in range(400)] + [(701, t, "user", f"t{t}") for t in range(350)]  # long
    rows += [(None, 0, "user", "x"), (5, 0, "user", "x"), (5, 0, "user", "x")]
    return rows


def found(spark, rows, **more):
    df = spark.createDataFrame([(*r, "z", 1, "p") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in trie.prefix_trie(df, **more).collect()), key=lambda r: (r[1], r[0]))


def test_nodes(spark):
    rows = given()
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("moduli", [(1, 1), (3, 2)])
def test_collisions_are_split(spark, moduli):
    rows = [r for r in given(2, 40) if r[0] is None or r[0] < 500] + [(900 + i, t, "user", f"{i % 4} {t // 2}") for i in range(12) for t in range(4)]
    assert found(spark, rows, moduli=moduli) == brute(rows)


def test_heavy_nodes_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr(trie, "HEAVY", 8)
    monkeypatch.setattr(trie, "BLOCK", 7)
    rows = given(3, 60)
    assert found(spark, rows) == brute(rows)


def test_few_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "user", "a")]) == []
    for rows in ([(7, 0, "user", "a b")], [(7, None, None, None), (7, None, None, None)], [(i, 0, "user", "a") for i in range(8)]):
        assert found(spark, rows) == brute(rows)


def test_running_sums_go_on_over_ranges(spark):
    df = spark.createDataFrame([(k, i) for k, n in ((1, 1), (2, 900), (3, 3)) for i in range(n)], "key long, at long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out, table = trie.running(df, "key", ["at"], [], ["n", "s"], lambda b: [b.column(1).to_numpy() * 0 + 1, b.column(1).to_numpy()])
        assert table.select("_part").distinct().count() > 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for r in out.collect():
        assert (r["n"], r["s"]) == (r["at"] + 1, r["at"] * (r["at"] + 1) // 2)
