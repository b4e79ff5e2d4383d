"""Token counts against the library, with chunks small enough that they must be spliced and widened."""

import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from loomgraph.llm import tokencount

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def pieces():
    with open(PATH, "rb") as f:
        return tokencount.Pieces(f.read(), remembered=50)


def _texts(words):
    rng = random.Random(3)
    bits = [*words[:60], " ", "  ", "    ", "\n", "\n\n", "▁", "a", "aaaa", "été", "漢字", "🙂", "<s>", "</s>", "<0x0A>", "<unk>", "\x00", "​", "1234", "=====", "http://x.y/?z=1"]
    out = ["", " ", "   ", "a", " a", "a ", "▁", " ▁ ", "<unk>", "é" * 700, "a" * 900, "ab" * 700, " " * 800, "\n" * 500, "x" + " " * 700 + "y", "漢" * 300, "🙂" * 300, "=" * 1000]
    for n in (3, 20, 90, 300, 700):
        out += ["".join(rng.choice(bits) + (" " if rng.random() < 0.6 else "") for _ in range(n)) for _ in range(8)]
    return out


def test_texts_count_as_the_library_counts_them(pieces, library, words):
    texts = _texts(words)
    assert pieces.apart
    assert list(pieces.counts(texts)) == [len(library.encode(t)) for t in texts]
    assert list(pieces.counts([None, ""])) == [0, 0]


def test_offsets_cover_the_text(pieces, library, words):
    for t in _texts(words):
        normal = pieces.normal(t)
        ids, starts = pieces.tokens(normal)
        assert ids.tolist() == library.encode(t)
        assert (starts[:1] == 0).all() and (starts[1:] > starts[:-1]).all()


def test_chunks_are_spliced_and_widened(spark, library, words):
    texts = _texts(words)
    docs = spark.createDataFrame(list(enumerate(texts)), "key string, text string").where("length(text) > 0")
    once = tokencount.spliced(tokencount.encoded(tokencount.chunked(docs, 64, 16), open(PATH, "rb").read()))
    first = {r["key"]: r["n_tokens"] for r in once.collect()}
    want = {str(i): len(library.encode(t)) for i, t in enumerate(texts) if t}
    assert first.keys() == want.keys()
    assert all(n is None or n == want[k] for k, n in first.items())
    agreed = [k for k, n in first.items() if n is not None and len(texts[int(k)]) > 128]
    apart = [k for k, n in first.items() if n is None]
    assert len(agreed) > 20 and apart  # splices that hold, and ones that need more overlap
    whole = {r["key"]: r["n_tokens"] for r in tokencount.huge_counts(docs, open(PATH, "rb").read(), 64, 16).collect()}
    assert whole == want


def test_counted_rows(spark, make, library, corpus):
    rows = {r["doc_id"]: r for r in tokencount.counted(make([r for r in corpus if r[0] not in (None, 10)]), PATH, limit=30, chunk=256, overlap=32).collect()}
    given = {r[0]: r[1] or "" for r in corpus if r[0] not in (None, 10)}
    assert rows.keys() == given.keys()
    for i, t in given.items():
        n = len(library.encode(t))
        assert (rows[i]["n_bytes"], rows[i]["n_tokens"], rows[i]["over_limit"]) == (len(t.encode()), n, n > 30), i


def test_odd_rows(spark, make, library):
    text = "one two  three " * 200
    docs = make([(1, text), (1, text), (1, "x"), (None, text), (None, None), (7, None)])
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in tokencount.counted(docs, PATH, chunk=128, overlap=16).collect())
    n = len(library.encode(text))
    assert got == sorted([(False, 1, 3000, n), (False, 1, 3000, n), (False, 1, 1, 1), (True, 0, 3000, n), (True, 0, 0, 0), (False, 7, 0, 0)])
    empty = tokencount.counted(docs.limit(0), PATH)
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


def test_a_very_long_text(spark, make, library, words):
    rng = random.Random(8)
    text = " ".join(rng.choice(words) for _ in range(60_000))
    row = tokencount.counted(make([(1, text)]), PATH).first()
    assert row["n_tokens"] == len(library.encode(text)) and row["over_limit"]


def test_models_that_can_not_be_spliced_are_refused():
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto.FromString(open(PATH, "rb").read())
    proto.normalizer_spec.remove_extra_whitespaces = True
    with pytest.raises(ValueError):
        tokencount.Pieces(proto.SerializeToString())


def test_overlaps_must_fit(make):
    with pytest.raises(ValueError):
        tokencount.counted(make([(1, "a")]), PATH, chunk=10, overlap=8)


def test_query_on_all_documents(spark, library):
    from loomgraph.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = QUERIES["op11_token_counts"](spark, sf).select("doc_id", F.struct("n_bytes", "n_tokens", "over_limit").alias("v"))
    for r in docs.join(got, "doc_id").collect():
        t = r["text"] or ""
        n = len(library.encode(t))
        assert tuple(r["v"]) == (len(t.encode()), n, n > 4096)
