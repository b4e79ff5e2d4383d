"""BPE and packing against the public libraries."""

import base64
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomgraph.llm import bpe, packing
from loomgraph.llm.memory import Memory

RANKS, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def hf():
    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    return t


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("aabeiothn  \n\té漢🙂!?'s19<|endoftext|>ΣİÁ"), max_size=60))
def test_encoders_agree_with_the_libraries(text):
    t = test_encoders_agree_with_the_libraries
    if not hasattr(t, "tools"):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
        h = Tokenizer.from_file(WORDS)
        h.encode_special_tokens = True
        t.tools = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), h
    tik, h = t.tools
    c = bpe.codec(RANKS, P.PATTERN)
    assert c.encode(text).tolist() == tik.encode_ordinary(text)
    assert c.decode(c.encode(text)) == text.encode()
    got = np.frombuffer(next(packing.tokenizer(WORDS).encode_all([text])), "<u4").tolist()
    assert got == h.encode(text, add_special_tokens=False).ids


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(2).integers(0, 2**63, 5000, dtype=np.uint64)
    keys = np.unique(keys)
    h = bpe.PerfectHash(keys)
    assert sorted(h.lookup(keys).tolist()) == list(range(len(keys)))
    with pytest.raises(ValueError):
        bpe.PerfectHash(np.array([1, 1], np.uint64))


def test_memory_forgets_but_stays_right():
    m = Memory(4)
    for k in range(40):
        assert m.fetch({k, k + 1}, lambda new: {x: x * x for x in new}) == {k: k * k, k + 1: (k + 1) ** 2}
        assert len(m) + len(m.old) <= 10


def test_digests(make, corpus, tik):
    got = {(r[0], r[3]): r for r in bpe.digests(make(corpus), RANKS, P.PATTERN).collect()}
    for i, t in corpus:
        ids = tik.encode_ordinary(t or "")
        plain = hashlib.sha256((t or "").encode()).hexdigest()
        assert got[(i, plain)][1:3] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_encode_and_decode_columns(make):
    df = bpe.decode(bpe.encode(make([(1, "the cat"), (2, None)]), RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert {r["doc_id"]: bytes(r["decoded"]) for r in df.collect()} == {1: b"the cat", 2: b""}
    with pytest.raises(ValueError):
        bpe.encode(df, RANKS, P.PATTERN)


def test_packing(make, corpus, hf):
    rows = packing.packed(make(corpus), WORDS, with_ids=True).collect()
    want = Counter()
    for i, t in corpus:
        ids = hf.encode(t or "", add_special_tokens=False).ids + [2]
        for s in range(0, len(ids), 4096):
            part = ids[s : s + 4096]
            want[(i, s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids))] += 1
    assert Counter(tuple(r[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")) for r in rows) == want
    packs = defaultdict(list)
    for r in rows:
        packs[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in packs.values():
        assert packing.gaps(spans) == [] and max(a + n for a, n in spans) <= 4096
    total = [sum(n for _, n in s) for s in packs.values()]
    assert packing.padding(total) <= 4096


def test_shortest_pack_first_places_everything():
    rng = np.random.default_rng(4)
    histogram = Counter(rng.integers(1, 4097, 5000).tolist()) + Counter(rng.integers(1, 300, 5000).tolist())
    patterns = packing.shortest_pack_first(histogram)
    placed = Counter()
    for packs, pattern in patterns:
        assert sum(n * k for n, k in pattern) <= 4096
        for n, k in pattern:
            placed[n] += k * packs
    assert placed == histogram
    room = sum(packs * (4096 - sum(n * k for n, k in pattern)) for packs, pattern in patterns)
    assert room / (4096 * sum(p for p, _ in patterns)) < 0.03
    with pytest.raises(ValueError):
        packing.shortest_pack_first({5000: 1})


def test_ranks_and_places_on_any_plan(make, corpus, monkeypatch):
    """Few or many salts, places broadcast or joined: pieces fill the same sequences without a gap."""
    keep = lambda: sorted((r["doc_id"] or -1, r["start"], r["length"], r["ids_crc32"]) for r in packing.packed(make(corpus), WORDS).collect())
    want = keep()
    monkeypatch.setattr(packing, "SALTS", 1)
    monkeypatch.setattr(packing, "RANKED", 2)
    monkeypatch.setattr(packing, "FEW_PLACES", 0)
    assert keep() == want
    packs = defaultdict(list)
    for r in packing.packed(make(corpus), WORDS).collect():
        packs[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(packing.gaps(spans) == [] for spans in packs.values())


def test_empty(make):
    assert packing.packed(make([]), WORDS).count() == 0
    assert bpe.digests(make([]), RANKS, P.PATTERN).count() == 0
