"""The substring and near-duplicate operators against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from loomgraph.llm import neardup, passages, suffixdup, worddup

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall


def by_words(rows, width=50):
    seen = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = WORDS(t or "")
        for k in range(len(w) - width + 1):
            seen.setdefault(tuple(w[k : k + width]), i)
    out = []
    for i, t in rows:
        w = WORDS(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if i is not None and seen[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return sorted(out, key=str)


def by_bytes(rows, width=200):
    count = Counter()
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            count.update(b[k : k + width] for k in range(len(b) - width + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if i is not None and count[b[k : k + width]] > 1:
                gone[k : k + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("split,copies", [(4000, 4000), (1, 2), (20, 1)])
def test_words(make, corpus, monkeypatch, split, copies):
    monkeypatch.setattr(passages, "SPLIT", split)
    monkeypatch.setattr(passages, "COPIES", copies)
    got = worddup.digests(make(corpus)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == by_words(corpus)
    assert sum(r["n_removed"] for r in got) > 1000


@pytest.mark.parametrize("split,copies", [(4000, 4000), (1, 2), (20, 1)])
def test_bytes(make, corpus, monkeypatch, split, copies):
    monkeypatch.setattr(passages, "SPLIT", split)
    monkeypatch.setattr(passages, "COPIES", copies)
    got = suffixdup.digests(make(corpus)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == by_bytes(corpus)


@pytest.mark.parametrize("split", [4000, 1])
@pytest.mark.parametrize("operator,across", [(worddup, True), (suffixdup, False)])
def test_nothing_goes_but_by_the_method(make, corpus, monkeypatch, split, operator, across):
    """What the blocks don't report stays: there is no other path to a removal."""
    monkeypatch.setattr(passages, "SPLIT", split)
    none = lambda t: operator._block(t, operator.WIDTH).slice(0, 0)
    assert passages.found_again(make(corpus), operator.units(operator.WIDTH, operator.RUN), none, "doc_id", "text", across).isEmpty()


@pytest.mark.parametrize("split,copies", [(4000, 4000), (1, 1)])
@pytest.mark.parametrize("operator", [worddup, suffixdup])
def test_hashes_do_not_decide(make, words, monkeypatch, split, copies, operator):
    """A copy whose units are changed on the way to its block stays, though anchors and contexts are equal; the others go."""
    monkeypatch.setattr(passages, "SPLIT", split)
    monkeypatch.setattr(passages, "COPIES", copies)
    text = " ".join(words[:90])

    def other(t):
        at = t.column_names.index("span")
        spans = [s.swapcase()[::-1] if k == 3 else s for k, s in zip(t.column("_key").to_pylist(), t.column("span").to_pylist(), strict=True)]
        return operator._block(t.set_column(at, "span", pa.array(spans, pa.binary())), operator.WIDTH)

    found = passages.found_again(make([(i, text) for i in range(6)]), operator.units(operator.WIDTH, operator.RUN), other, "doc_id", "text", operator is worddup)
    assert {r["_key"] for r in found.collect()} == {0, 1, 2, 4, 5} - ({0} if operator is worddup else set())


@pytest.mark.parametrize("split", [4000, 1])
def test_ids_repeated_with_other_texts(make, words, monkeypatch, split):
    """Each row is cut by its own words; rows of one id do not count against each other for words, but do for bytes."""
    monkeypatch.setattr(passages, "SPLIT", split)
    a, b = " ".join(words[:70]), " ".join(words[100:160])
    rows = [(0, a), (1, b + " " + a), (1, "a b c"), (1, b), (2, b + " x " + a), (2, None), (2, a + " y " + a), (2, a + " y " + a)]
    got = worddup.digests(make(rows)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == by_words(rows)
    assert all(r["n_removed"] <= r["n_words"] for r in got)
    got = suffixdup.digests(make(rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == by_bytes(rows)
    kept = sorted((r["doc_id"], r["text"] or "") for r in worddup.cleaned(make(rows)).collect())
    assert kept == [(0, a), (1, "a b c"), (1, b), (1, b), (2, ""), (2, "x"), (2, "y"), (2, "y")]


def test_cleaned_passes_clashing_columns_on(spark, words):
    text = " ".join(words[:60])
    rows = spark.createDataFrame([(1, text, 7, "r"), (2, text, 8, "r")], "doc_id long, text string, _spans int, _row string")
    assert sorted(map(tuple, worddup.cleaned(rows).collect())) == [(1, text, 7, "r"), (2, "", 8, "r")]


def test_transform_reads_back():
    """The segments alone, walked by where their symbols go, give the texts."""
    rng = np.random.default_rng(8)
    columns = rng.integers(97, 100, (30, 12)).astype(np.uint8)
    t = suffixdup.ColumnTransform(columns, np.zeros(12, int), np.full(12, 30))
    for _ in range(30):
        t.step()
    at, out = np.arange(12), []  # before the first round, texts stand in the order in which they entered
    for segment in t.segments:
        out.append(segment[at])
        place = np.empty(12, int)
        place[np.argsort(segment, kind="stable")] = np.arange(12)
        at = place[at]
    assert (np.array(out)[::-1] == columns).all()


def test_long_text_in_parts(words):
    codes = np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.uint64)
    whole = passages.occurrences(codes, np.array([5000]), 50, 16)
    assert int(whole[4].sum()) == 4951  # every window is in one occurrence
    assert all(a >= 0 for a in whole[5])


def test_cleaned_keeps_untouched_texts(make, corpus):
    rows = [r for r in corpus if r[0] != 10]
    got = {r["doc_id"]: r["text"] for r in worddup.cleaned(make(rows)).collect()}
    want = {i: n for i, _, n, _ in by_words(rows)}
    for i, t in rows:
        if want[i] == 0:
            assert got[i] == t
        else:
            assert len(WORDS(got[i])) == len(WORDS(t)) - want[i]


def test_factors_cross_boundaries():
    a, b = np.arange(100, dtype=np.uint64), np.arange(1000, 1100, dtype=np.uint64)
    target = np.concatenate([a[20:80], b[:30], a[:70]])
    codes = np.concatenate([a, b, target])
    found = worddup.factors(codes, np.array([0, 100, 200, 200 + len(target)]), np.array([0, 1, 2]), 50)
    assert found == [(2, 0, 60), (2, 90, 160)]


def test_column_transform_sorts_suffixes():
    texts = [b"banana$", b"bandana", b"ananas!", b"banana?"]
    columns = np.array([list(t) for t in texts], np.uint8).T.copy()
    t = suffixdup.ColumnTransform(columns, np.zeros(4, int), np.full(4, 7))
    for c in range(6, -1, -1):
        t.step()
        suffixes = [texts[i][c:] for i in t.order]
        assert suffixes == sorted(suffixes)
        for k in range(1, 4):
            x, y = suffixes[k - 1], suffixes[k]
            n = next((i for i in range(len(x)) if x[i] != y[i]), len(x))
            assert t.common[k] == n


def linked(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        n = min(size, len(w))
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else frozenset()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    at = defaultdict(list)
    for i in sets:
        if i is None:
            continue
        meets = Counter(j for g in sets[i] for j in at[g])
        for j, n in meets.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for g in sets[i]:
            at[g].append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("size,few,block,stars", [(2, 32, 4096, 3), (5, 1, 2, 1)])
def test_near_duplicates(make, corpus, monkeypatch, size, few, block, stars):
    monkeypatch.setattr(neardup, "FEW", few)
    monkeypatch.setattr(neardup, "BLOCK", block)
    monkeypatch.setattr(neardup, "STARS", stars)
    rows = neardup.classes(make(corpus), size=size).collect()
    want = linked(corpus, size, 80)
    assert len(rows) == len(corpus)
    for r in rows:
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"])


def test_members_with_many_partners_are_linked_at_the_threshold():
    """Sets are sorted without a sign; what a search for the common part finds must not depend on it."""
    rng = np.random.default_rng(4)
    a = np.unique(rng.integers(0, 2**64, 360, dtype=np.uint64))
    near = [np.unique(np.concatenate([a[:324], rng.integers(0, 2**64, 40, dtype=np.uint64)])) for _ in range(neardup.FEW + 8)]
    sets = [a, *near]
    assert all(100 * 324 >= 80 * (len(a) + len(s) - 324) for s in near)
    _, sketch, samples = neardup.signatures(sets)
    n = len(sets)
    band = np.tile(np.arange(neardup.BANDS), (n, 1)) * 1000 + np.arange(n)[:, None]  # they share the first band only
    band[:, 0] = 7
    ids = np.arange(n)
    lists = lambda rows: pa.array([r.view(np.int64) for r in rows], pa.list_(pa.int64()))
    t = pa.table({"band": np.full(n, 7), "left": np.zeros(n, np.int32), "right": np.zeros(n, np.int32), "id": ids, "label": (ids > 0) * 1, "side": (ids > 0) * 1, "inner": np.zeros(n, bool), "n_shingles": [len(s) for s in sets], "samples": samples, "bands": lists(band), "sketch": lists(sketch), "set": lists(sets), "many": ids == 0})
    assert neardup._candidates(t, 80).select(["a", "b"]).to_pylist() == [{"a": 0, "b": 0}]
    (link,) = neardup._settled(t, 80).to_pylist()
    assert link["a"] == 0 and link["b"] > 0


def test_odd_sketch_tells_similarity():
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(0, 2**63, 2000, dtype=np.uint64) * np.uint64(2))
    near, far = np.union1d(a[:-150], rng.integers(0, 2**63, 150, dtype=np.uint64)), np.union1d(a[:800], rng.integers(0, 2**63, 1200, dtype=np.uint64))
    _, sketch, samples = neardup.signatures([a, near, far])
    apart = [int(np.bitwise_count(sketch[0] ^ sketch[k]).sum()) for k in (1, 2)]
    most = neardup._most(float(samples[0]), float(samples[1]), 80, np.sqrt, np.maximum, np.minimum, np.power)
    assert apart[0] < most < apart[1]


def test_empty_table(make):
    none = make([])
    assert worddup.digests(none).count() == 0
    assert suffixdup.digests(none).count() == 0
    assert neardup.classes(none).count() == 0
