"""Chat formatting, quality rules, pages, languages and nearest neighbours."""

import hashlib
import json
import os
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import ann, chat, htmltext, language, quality
from loomgraph.llm.common import held_out


def test_chat_round_trip(spark):
    rows = [(1, 1, "assistant", "b#\\<x> ### y: </turn>\n"), (1, 0, "user", None), (2, 0, "r:o\\le", "\\### Assistant: </turn> ok"), (2, 0, "r:o\\le", "\\### Assistant: </turn> ok"), (None, 5, None, ""), (3, None, "assistant", "é🙂")]
    df = spark.createDataFrame([(*r, "segment") for r in rows], "conv_id long, turn long, role string, text string, segment string")
    got = {r["conv_id"]: r for r in chat.conversation_digests(chat.segments(chat.canonical_turns(df))).collect()}
    assert set(got) == {1, 2, 3, None}
    turns = [("user", ""), ("assistant", "b#\\<x> ### y: </turn>\n")]
    assert got[1]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert got[1]["loss_chars"] == len(turns[1][1])
    assert got[1]["loss_sha256"] == hashlib.sha256(turns[1][1].encode()).hexdigest()
    assert (got[2]["n_turns"], got[2]["loss_chars"], got[3]["loss_chars"]) == (2, 0, 2)
    assert chat.read_back("### a: x</turn>\n") == [("a", "x")]
    with pytest.raises(ValueError):
        chat.read_back("### a: x")


def test_chat_layouts(spark):
    assert len(chat.BY_FINGERPRINT) == len(chat.LAYOUTS)
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 3},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"instruction": "do", "input": "this", "output": "a"},
        {"prompt": "q", "completion": "a"},
        {"title": "nothing known"},
        None,
    ]
    df = spark.createDataFrame([(i, json.dumps(r) if r else "{bad") for i, r in enumerate(records)], "k int, record string")
    got = {}
    for r in chat.canonical_records(df, "record", "k").orderBy("conv_id", "position").collect():
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert got[0] == got[1] == got[3] == [("user", "q"), ("assistant", "a")]
    assert got[2] == [("user", "do\n\nthis"), ("assistant", "a")]
    assert got[4] == got[5] == [(None, None)]
    nested = spark.createDataFrame([(1, [("user", "q"), ("assistant", None)])], "k int, messages array<struct<role:string,content:string>>")
    assert [(r["role"], r["text"]) for r in chat.canonical_turns(nested, "k").orderBy("position").collect()] == [("user", "q"), ("assistant", "")]
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.range(1))


def test_quality_statistics(make, corpus):
    rows = corpus + [(500, "x y z x y z x y z"), (501, "l\nl\n \nl\nm"), (502, "A! #$ <b>|%&*")]
    for r in quality.statistics(make(rows)).collect():
        t = r["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = Counter(zip(w, w[1:], w[2:]))
        covered = {k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), sum(t.count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        assert tuple(r[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_quality_rules_are_learned(spark, make, words):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(300):
        bad = i % 5 == 0
        rows.append((i, " ".join(rng.choice(words) + ("##" if bad and rng.random() < 0.6 else "") for _ in range(80))))
        labels += [(i, 0 if bad else 1)] * (1 + i % 2)
    labels += [(None, 0), (7, None), (99999, 0)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    rules = quality.fit(make(rows), lab)
    assert rules and all(isinstance(c, quality.Condition) for r in rules for c in r)
    kept = {r["doc_id"]: r["kept"] for r in quality.judged(make(rows), rules).collect()}
    assert sum(kept[i] == (i % 5 != 0) for i in range(300)) >= 297
    assert quality.judged(make(rows), rules).where("kept").count() == sum(kept.values())
    assert quality.fit(make(rows), lab.limit(0)) == []
    assert quality.fit(make([]), lab) == []


def test_pages(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><script>var a = "</p><p>no";</script></head><body><header><h1>Site</h1></header>
    <nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy now, please, really.</div><article><h1>Head &amp; tail</h1>
    <p><b>First   para,<br> with commas, and dots.<p>Second one, which is longer &lt;than&gt; the first. It ends here.</p><p>Short</p><aside>side, note</aside></article>
    <div id="comments"><p>I think, therefore, that this is a long comment, with marks.</p></div><footer>&copy; me</footer>"""
    want = "Head & tail\nFirst para, with commas, and dots.\nSecond one, which is longer <than> the first. It ends here.\nShort"
    assert htmltext.main_text(page) == want
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<div><p>"), (4, "u", "plain &eacute;")], "page_id long, url string, html string")
    got = sorted((r["page_id"], r["text"]) for r in htmltext.extract(df).collect())
    assert got == [(1, want), (2, ""), (3, ""), (4, ""), (4, "plain é")]
    assert htmltext.main_text("<p>" + "word, " * 200_000).count("word") == 200_000


def test_pages_keep_content_beside_the_longest_section():
    para = "<p>A long paragraph, with commas, marks, and words; it goes on, and on, for a while.</p>"
    page = f"""<html><body><nav><a href="/">Home</a></nav><div id="page"><div id="text"><h1>Title</h1><section><h2>First</h2><p>A short start, with a comma.</p><p>Hm</p></section>
    <section><h2>Second</h2>{para * 40}</section><section><p>A short end, with a comma, too.</p></section></div><div class="links"><ul><li>One</li></ul></div></div><footer>me</footer></body></html>"""
    got = htmltext.main_text(page).split("\n")
    assert got[:5] == ["Title", "First", "A short start, with a comma.", "Hm", "Second"]
    assert len(got) == 46 and got[-1] == "A short end, with a comma, too."
    # a short introduction need not stand in a section
    page = f"<body><div><p>A short start, with a comma.</p><section>{para * 40}</section></div></body>"
    assert htmltext.main_text(page).startswith("A short start, with a comma.\nA long")
    # an article element still holds all of its text
    page = f"<body><article>{para * 40}</article><div><p>Another text, which is short.</p></div></body>"
    assert htmltext.main_text(page).count("\n") == 39


def _bare(page):
    """The page with elements and classes that say nothing."""
    for old, new in (("<nav>", '<div class="k1">'), ('<div class="ad">', '<div class="k2">'), ("<article>", '<div class="k3">'), ("<footer>", '<div class="k4">'), ("</nav>", "</div>"), ("</article>", "</div>"), ("</footer>", "</div>")):
        page = page.replace(old, new)
    return page


def _by_hand(page):
    """The blocks of the pages table's one template, by its tags: the truth."""
    inside = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:h1|p)>", inside.replace("<br>", " "))
    joined = (" ".join(htmltext.entities.unescape(re.sub(r"</?b>", "", b)).split()) for b in blocks)
    return "\n".join(b for b in joined if b)


def test_ratios_decide(spark, monkeypatch):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()
    pages = [r[0] for r in rows]
    truth = [_by_hand(p) for p in pages]
    right = lambda pages: sum(htmltext.main_text(p) == t for p, t in zip(pages, truth, strict=True))
    assert right(pages) == len(pages)
    assert right([_bare(p) for p in pages]) > 0.9 * len(pages)  # nothing but the ratios to go by
    # with the ratios out of work, every path is content
    monkeypatch.setattr(htmltext, "path_ratios", lambda blocks: ({p: 1.0 for p, _, _ in blocks},) * 2)
    assert right([_bare(p) for p in pages]) == 0
    monkeypatch.setattr(htmltext, "_passing", lambda ratios, weight: set(ratios))
    assert right(pages) == 0


def test_ratios_of_paths_against_plain_sums():
    rng = random.Random(4)
    for _ in range(50):
        blocks = [(rng.randrange(5), rng.randrange(900), rng.randrange(12)) for _ in range(rng.randint(1, 30))]
        smooth, own = htmltext.path_ratios(blocks)
        every = max(1, sum(n for _, n, _ in blocks))
        for p in {b[0] for b in blocks}:
            of = [b for b in blocks if b[0] == p]
            total = sum(n for _, n, _ in of)
            mean = min(total / len(of), 500), min(sum(m for _, _, m in of) / len(of), 8)
            assert own[p] == pytest.approx(mean[0] * (1 + mean[1]) * (total / every) ** 0.5)
        kernel = {d: np.exp(-(d**2) / 2) for d in range(-2, 3)}
        means = {p: [min(np.mean([b[k] for b in blocks if b[0] == p]), top) for k, top in ((1, 500), (2, 8))] for p in own}
        for p in own:
            values = []
            for i, b in enumerate(blocks):
                if b[0] == p:
                    near = [(kernel[j - i], means[blocks[j][0]]) for j in range(len(blocks)) if abs(j - i) <= 2]
                    x, y = (sum(w * m[k] for w, m in near) / sum(w for w, _ in near) for k in (0, 1))
                    values.append(x * (1 + y))
            assert smooth[p] == pytest.approx(np.mean(values) * (sum(b[1] for b in blocks if b[0] == p) / every) ** 0.5)


def test_generated_pages():
    """Pages put together from parts whose place in or out of the article is known."""
    rng = random.Random(6)
    words = lambda n, end=".": " ".join("".join(rng.choice("abcdeimnorst") for _ in range(rng.randint(2, 9))) for _ in range(n)) + end
    for k in range(60):
        para = lambda: words(rng.randint(20, 60)).replace(" ", ", ", 3)
        body, want = [], []

        def add(html, text=None, body=body, want=want):
            body.append(html)
            if text is not None:
                want.append(text)

        title = words(5, "")
        add(f"<h1>{title}</h1>", title)
        for _ in range(rng.randint(4, 9)):
            x = para()
            add(rng.choice(["<p>{}</p>", "<p class='lead'>{}</p>", "<p><span>{}</span>", "<p>{}"]).format(x), x)
            if rng.random() < 0.3:
                x = words(3, "")
                add(f"<h2>{x}</h2>", x)
            if rng.random() < 0.3:
                items = [words(4) for _ in range(3)]
                add("<ul>" + "".join(f"<li>{i}" for i in items) + "</ul>")
                want.extend(items)
            if rng.random() < 0.3:
                add(f"<div class='{rng.choice(['ad', 'x9', 'promo'])}'>{words(4, '')}</div>")
        links = "".join(f"<li><a href='#'>{words(2, '')}</a>" for _ in range(6))
        box = rng.choice([("<article>", "</article>"), ("<div id='page'>", "</div>"), ("<main><section>", "</section></main>"), ("<td>", "</td>")])
        comments = "".join(f"<div class='comment'><b>{words(1, '')}</b><p>{words(9)}</p></div>" for _ in range(3))
        page = f"<html><head><title>t</title></head><body><div class='top'><ul>{links}</ul></div>{box[0]}{''.join(body)}{box[1]}<div class='comments'>{comments}</div><form><p>{words(5)}</p><input></form><div class='foot'>{words(4)}</div></body></html>"
        assert htmltext.main_text(page) == "\n".join(want), k


@pytest.mark.parametrize("unit", ["<a ", "<div>", "<b>x</b></i>", "<p><li>", "<!", "<i a='", "<b><div></b>"])
def test_pages_take_time_in_proportion(unit):
    began = time.process_time()
    htmltext.main_text(unit * (1_000_000 // len(unit)) + "<p>end")
    assert time.process_time() - began < 4


def test_pages_of_odd_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert htmltext.extract(none).columns == ["page_id", "url", "text"] and htmltext.extract(none).isEmpty()
    clash = spark.createDataFrame([(1, "a", "<p>b")], "page_id long, text string, html string")
    with pytest.raises(ValueError, match="text exists"):
        htmltext.extract(clash)
    assert htmltext.extract(clash, out="main").collect()[0]["main"] == "b"


def test_records_that_are_no_records(spark):
    rows = ['{"prompt": "a\\ud800b", "completion": "c"}', "[" * 200_000, '{"a":' * 50_000, '{"\\ud800": 1}', "", None, "7"]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, record string")
    got = sorted(chat.canonical_records(df, "record", "id").collect(), key=lambda r: (r["conv_id"], r["position"]))
    assert [(r["conv_id"], r["role"], r["text"]) for r in got[:2]] == [(0, "user", "a\ufffdb"), (0, "assistant", "c")]
    assert [(r["conv_id"], r["role"], r["text"], r["layout"]) for r in got[2:]] == [(k, None, None, None) for k in range(1, 7)]


def test_chat_of_odd_tables(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert chat.conversation_digests(chat.segments(chat.canonical_turns(spark.createDataFrame([], kind)))).count() == 0
    long = "### x\\" * 300_000
    row = chat.conversation_digests(chat.segments(chat.canonical_turns(spark.createDataFrame([(1, 0, "assistant", long)], kind)))).first()
    assert (row["loss_chars"], row["loss_sha256"]) == (len(long), hashlib.sha256(long.encode()).hexdigest())


def test_quality_can_be_filtered(make, corpus, spark):
    judged = quality.judged(make(corpus), [])
    want = Counter((r["doc_id"], r["n_words"]) for r in judged.collect() if r["n_words"] > 60 and not r["base_failed"])
    some = judged.where("n_words > 60 and not base_failed").select("doc_id", "n_words")
    assert Counter(map(tuple, some.collect())) == want
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 2  # the words and the lines, once each
    assert quality.judged(make([]), []).count() == 0
    odd = make(corpus[:3]).withColumnsRenamed({"lang": "_length", "source": "_words"})
    assert set(odd.columns) < set(quality.judged(odd, []).columns)
    with pytest.raises(ValueError, match="n_words, rule exist"):
        quality.judged(odd.withColumnsRenamed({"anchor": "rule", "sketch": "n_words"}), [])


def test_languages_against_plain_votes(make):
    """Decisions, votes and scores of identify() against a version that looks at one text and one machine at a time."""
    rng = random.Random(12)
    stock = {"en": "the of and with", "de": "der die und ein", "nl": "het een van dat", "fr": "le la que des", "es": "el los que una", "fi": "ja on ei se"}
    rows = [(i, " ".join(rng.choice(stock[lang].split()) for _ in range(rng.randint(1, 30))), lang) for i, lang in enumerate(list(stock) * 40)]
    docs = make([*rows, (9000, None), (9001, "..."), (9002, "é")])
    model = language.fit(language.sample(docs, F.lit(True)))
    for r in language.identify(docs, model).collect():
        t = (r["text"] or "").translate({k: " " for k in range(9, 14)} | {k: "0" for k in range(48, 58)} | {k: chr(k + 32) for k in range(65, 91)})
        if not any(c.isalpha() for c in t):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        b = t.encode().ljust(3)
        grams = [((b[k] << 16 | b[k + 1] << 8 | b[k + 2]) * 2654435761 % 2**32) >> 19 for k in range(len(b) - 2)]
        margin = [sum(float(model.weights[g, m]) for g in grams) / len(grams) + float(model.bias[m]) for m in range(len(model.machines))]

        def winner(group, names, margin=margin):
            if len(names) == 1:
                return names[0], 1.0
            points = {n: [0, 0.0, 0.0] for n in names}
            for (g, i, j), m in zip(model.machines, margin, strict=True):
                if g == group:
                    p = 1 / (1 + np.exp(-3 * np.clip(m, -20, 20)))
                    points[names[i if m >= 0 else j]][0] += 1
                    for n, sign, chance in ((names[i], 1, p), (names[j], -1, 1 - p)):
                        points[n][1] += sign * m
                        points[n][2] += chance
            best = max(names, key=lambda n: (points[n][0], points[n][1]))
            return best, points[best][2] / (len(names) - 1)

        family, p = winner("", model.families)
        lang, q = winner(family, model.languages[family])
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(p * q, abs=1e-5)
    with pytest.raises(ValueError, match="lang_pred exists"):
        language.identify(docs.withColumnRenamed("source", "lang_pred"), model)
    assert language.identify(make([]), model).count() == 0


def test_language_accuracy_on_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(language.sample(docs, ~held_out(F.col("doc_id"))))
    seen = language.identify(docs.where(held_out(F.col("doc_id")) & F.col("lang").isNotNull()), model).where("lang_pred <> 'und'")
    assert seen.where("lang = lang_pred").count() >= 0.97 * seen.count() > 0


def test_languages(make):
    rng = random.Random(2)
    stock = {"en": "the of and with that ing tion er".split(), "de": "der die und ein heit keit ung sch".split(), "fr": "le la que des eau eux ment oi".split(), "es": "el los que ción mente ado ía ñ".split()}
    text = lambda lang: " ".join(rng.choice(stock[lang]) + rng.choice(stock[lang]) for _ in range(40))
    rows = [(i, text(lang), lang) for i, lang in enumerate(list(stock) * 60)] + [(1000, None, "en"), (1001, "123 !?", "en"), (1002, text("fr"), None)]
    docs = make(rows)
    model = language.fit(language.sample(docs, ~held_out(F.col("doc_id"))))
    assert model.families == ["germanic", "romance"] and len(model.machines) == 3
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(docs, model).collect()}
    assert all(got[i][0] == lang and 0.5 < got[i][1] <= 1 for i, _, lang in rows[:240])
    assert got[1000] == got[1001] == ("und", 0.0) and got[1002][0] == "fr"
    assert language.fit([]).predict(["abc"]) == (["und"], [0.0])
    long = text("de") * 40
    whole = model.margins([long.encode()])
    before, language.CHUNK = language.CHUNK, 1000
    try:
        assert np.allclose(model.margins([long.encode()]), whole)
    finally:
        language.CHUNK = before


def test_nearest(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(400)]
    rows += [(400 + i, rows[0][1]) for i in range(9)] + [(450, [2 * x for x in rows[0][1]]), (500, None), (501, [0.0] * 16), (502, [float("nan")] + [1.0] * 15), (503, [None] + [1.0] * 15), (504, [1.0, 2.0]), (3, rows[3][1]), (None, rows[1][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    ok = {i: np.array(v) for i, v in rows if i is not None and v and None not in v and len(v) == 16 and np.isfinite(v).all() and any(v)}
    hits = total = 0
    assert set(got) == {i for i in ok if i % 50 == 0}
    for q, found in got.items():
        s = {i: float(v @ ok[q] / np.linalg.norm(v) / np.linalg.norm(ok[q])) for i, v in ok.items() if i != q}
        best = sorted(s, key=lambda i: (-round(s[i], 12), i))[:5]
        assert list(found) and max(found) == 5
        assert all(abs(s[i] - x) < 1e-12 for i, x in found.values())
        hits += len({i for i, _ in found.values()} & set(best))
        total += 5
    assert hits / total >= 0.9
    assert [got[0][k][0] for k in range(1, 6)] == [400, 401, 402, 403, 404]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("n,few", [(2, ann.FEW), (6, ann.FEW), (6, 0), (90, ann.FEW)])
def test_nearest_of_few_or_scattered_vectors(spark, n, few, monkeypatch):
    monkeypatch.setattr(ann, "FEW", few)
    rng = np.random.default_rng(n)
    # a rare dimension beside a large one; without FEW only the queries that buckets leave short are scanned
    rows = [(i, rng.normal(size=32).tolist()) for i in range(n)] + [(1000 + i, rng.normal(size=8).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") < n).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    x = np.array([v for i, v in rows[:n]])
    x /= np.linalg.norm(x, axis=1)[:, None]
    for q in range(n):
        best = sorted((i for i in range(n) if i != q), key=lambda i: (-(x[i] @ x[q]), i))[:5]
        assert sorted(got[q]) == list(range(1, len(best) + 1))
        assert all(abs(x[i] @ x[q] - s) < 1e-12 for i, s in got[q].values())
        if n <= 6:
            assert [got[q][k + 1][0] for k in range(len(best))] == best


@pytest.mark.parametrize("blocks", [16_384, 30])
def test_scan_is_exact(spark, blocks, monkeypatch):
    monkeypatch.setattr(ann, "GROUP", blocks)
    x = np.random.default_rng(3).normal(size=(100, 16))
    entries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(200, [1.0, 2.0])], "rep long, v array<double>")
    got = {}
    for r in ann.scanned(entries, entries.where("rep < 70"), 6).collect():
        got.setdefault(r["query"], []).append((-r["score"], r["rep"]))
    x /= np.linalg.norm(x, axis=1)[:, None]
    assert set(got) == set(range(70))
    assert all([i for _, i in sorted(got[q])] == np.argsort(-(x @ x[q]))[:6].tolist() for q in got)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="the driver's tables are not here")
def test_recall_on_the_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in df.select("vec_id", "embedding").collect()]
    ids, x = [i for i, _ in rows], np.stack([v / np.linalg.norm(v) for _, v in rows])
    at = {i: n for n, i in enumerate(ids)}
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in (i for i in ids if i % 50 == 0):
        best = sorted((i for i in ids if i != q), key=lambda i: (-round(x[at[i]] @ x[at[q]], 12), i))[:5]
        assert len(got[q]) == 5
        hits += len(got[q] & set(best))
    assert hits / (5 * len(got)) >= 0.93, hits / (5 * len(got))


def test_probes_come_in_order():
    low = np.array([0.1, 0.7, 1.2])
    sets = ann.perturbations(low, 20)
    cost = [sum(low[i] ** 2 if d < 0 else (ann.WIDTH - low[i]) ** 2 for i, d in s) for s in sets]
    assert sets[0] == [] and cost == sorted(cost) and len(sets) == 20
