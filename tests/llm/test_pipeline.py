"""Each pipeline stage on what the one before kept, against brute force."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
from test_dedup import WORDS, by_words, linked
from tokenizers import Tokenizer

import corpus_pipeline as cp
from loomgraph.llm import language


def test_stages(spark, tmp_path, make, corpus):
    rows = [r for r in corpus if r[0] is not None]
    rows.remove(next(r for r in rows if r[0] == 10))  # one row per id
    sf = str(tmp_path)
    make([(i, t, "en") for i, t in rows]).select(*cp.COLUMNS, "anchor").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1) for i, _ in rows], "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, sf).write.parquet(f"{sf}/{k}")
        docs = spark.read.parquet(f"{sf}/{k}")
        seen[name] = docs
        if k < 4:
            assert tuple(docs.columns) == cp.COLUMNS
    texts = {k: {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()} for k, df in seen.items() if k != "packing"}

    first = texts["quality rules"]
    assert first == {i: t for i, t in rows if i in first}
    assert all(len(WORDS(t or "")) >= 50 for t in first.values()) and set(range(100, 103)) <= set(first)
    second = texts["language"]
    assert second == {i: t for i, t in first.items() if any(c.isalpha() for c in t)}
    links = linked(list(second.items()), 5, 80)
    third = texts["near duplicates"]
    assert third == {i: t for i, t in second.items() if links[i][1] == i}
    want = {i: n - gone for i, n, gone, _ in by_words(list(third.items()))}
    fourth = texts["repeated passages"]
    assert {i: len(WORDS(t)) for i, t in fourth.items()} == want
    assert any(fourth[i] != third[i] for i in third)
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    pieces = Counter()
    for i, x in fourth.items():
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        for s in range(0, len(ids), 4096):
            pieces[(i, s, zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["start"], r["ids_crc32"]) for r in docs.collect()) == pieces


def test_stages_on_odd_rows(spark, tmp_path, make, words):
    """A learned rule, two languages, ties, a very long text, nulls, and columns whose names operators use."""
    rng = random.Random(21)
    stock = {"en": "the of and with that ing tion er".split(), "de": "der die und ein heit keit ung sch".split()}
    text = lambda lang, n=90: " ".join(rng.choice(stock[lang]) + rng.choice(words) for _ in range(n))
    rows, labels = [], []
    for i in range(240):
        bad = i % 4 == 0
        lang = ("en", "de")[i % 2]
        rows.append((i, text(lang).replace(" ", " ## " if bad else " "), lang))
        labels.append((i, 0 if bad else 1))
    rows += [(1000, text("en", 30_000), "en"), (1001, None, "en"), (1002, "", None), (1003, rows[1][1], "de"), (1004, rows[1][1], "de")]
    sf = str(tmp_path)
    docs = make(rows).withColumnsRenamed({"anchor": "_spans", "sketch": "rule"})
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    kept = {r["doc_id"] for r in cp.quality_stage(spark, docs, sf).collect()}
    assert len(kept & set(range(0, 240, 4))) <= 3 and len(kept & {i for i in range(240) if i % 4}) >= 177
    assert {1000, 1003, 1004} <= kept and not kept & {1001, 1002}
    second = {r["doc_id"] for r in cp.language_stage(spark, docs, sf).collect()}
    assert second >= set(range(240)) | {1000} and not second & {1001, 1002}
    third = {r["doc_id"] for r in cp.near_duplicate_stage(spark, docs, sf).collect()}
    assert third == {r[0] for r in rows} - {1003, 1004}
    fourth = {r["doc_id"]: r for r in cp.passage_stage(spark, docs, sf).collect()}
    assert fourth[1003]["text"] == fourth[1004]["text"] == "" and fourth[1003]["n_chars"] == 0
    assert fourth[1001]["text"] is None and fourth[1000]["text"] == rows[240][1]
    last = cp.packing_stage(spark, docs, sf).collect()
    assert {r["doc_id"] for r in last} == {r[0] for r in rows} and sum(r["doc_id"] == 1000 for r in last) > 10


def test_empty_tables(spark, tmp_path, make):
    sf = str(tmp_path)
    make([]).select(*cp.COLUMNS).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    assert cp.run(spark, sf).count() == 0
    assert language.UNKNOWN == "und"
