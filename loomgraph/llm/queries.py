"""Registered queries of the operators in this subpackage: thin layers that derive the agreed columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from loomgraph.llm import ann, bpe, chat, codes, htmltext, language, neardup, packing, quality, suffixdup, tokencount, trie, worddup
from loomgraph.llm.common import held_out, table


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    text = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    turns = chat.canonical_turns(rows.select("conv_id", "turn", "role", "text").unionByName(extra))
    return chat.conversation_digests(chat.segments(turns))


def op2_word_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worddup.digests(table(spark, sf_dir, "documents"))


def op3_multiprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judged(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op5_byte_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdup.digests(table(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return htmltext.extract(pages).withColumn("n_chars", F.length("text").cast("long"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"), size=2)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(language.sample(docs, ~held_out(F.col("doc_id"))))
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return language.identify(rows, model).drop("text")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.counted(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.vector_codes(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_word_dedup": op2_word_dedup,
    "op3_multiprobe": op3_multiprobe,
    "op4_quality_rules": op4_quality_rules,
    "op5_byte_dedup": op5_byte_dedup,
    "op7_html_text": op7_html_text,
    "op8_minhash": op8_minhash,
    "op9_language": op9_language,
    "op6_packing": op6_packing,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_token_counts": op11_token_counts,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_vector_codes": op13_vector_codes,
}


def _code_sql(rounds: int = 4) -> str:
    """Every assignment and every update of codebooks as tables of their own: a0, c1, a1, ..., by plain comparison with all entries."""
    near = "list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c)"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} as materialized (select vec_id, label, j, v, m % 256 as i, m // 256 as d2 from (select vec_id, label, j, v, min(({near})::bigint * 256 + i) as m from p join c{r} using (j) group by vec_id, label, j, v))")
        if r < rounds:
            mean = f"select j, i, list(((s - ((s % n) + n) % n) // n)::double order by pos) as c from (select j, i, pos, sum(x::bigint) as s, count(*) as n from (select j, i, unnest(v) as x, unnest(range(len(v))) as pos from a{r}) group by 1, 2, 3) group by 1, 2"
            steps.append(f"c{r + 1} as materialized (select j, i, coalesce(u.c, c{r}.c) as c from c{r} left join ({mean}) u using (j, i))")
    return f"""
        with k as materialized (select vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        p as materialized (select vec_id, label, j, v[(j * len(v)) // 4 + 1 : ((j + 1) * len(v)) // 4] as v from k, range(4) t(j)),
        c0 as materialized (select j, row_number() over (partition by j order by vec_id) - 1 as i, v as c from p qualify i < 256),
        {", ".join(steps)},
        e as (select vec_id, label, string_agg(lpad(lower(to_hex(i)), 2, '0'), '' order by j) as code, sum(d2)::bigint as error from a{rounds} group by 1, 2),
        h as (select sha256(string_agg(x::bigint::varchar, ',' order by j, i, pos)) as codebooks_sha256 from (select j, i, unnest(c) as x, unnest(range(len(c))) as pos from c{rounds}))
        select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256 from e, h"""


_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL: dict[str, str] = {
    "op1_chat_format": r"""
        with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
                   union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
        select conv_id, count(*) as n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
               coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
               sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
               sum(14 + length(regexp_replace(role, '[\\#<:]', 'xx', 'g')) + length(regexp_replace(text, '[\\#<]', 'xx', 'g')))::bigint as formatted_chars
        from t group by conv_id""",
    "op2_word_dedup": f"""
        with d as (select doc_id, {_WORDS.format("text")} as ws from documents),
        w as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as pos from d),
        k as (select *, string_agg(word, ' ') over f as k, count(*) over f = 50 as whole from w
              window f as (partition by doc_id order by pos rows between current row and 49 following)),
        m as (select *, whole and min(case when whole then doc_id end) over (partition by case when whole then k end) < doc_id as dup from k),
        r as (select doc_id, word, pos, max(dup::int) over (partition by doc_id order by pos rows between 49 preceding and current row) = 1 as gone from m),
        g as (select doc_id, count(*) as n_words, count(*) filter (gone) as n_removed, string_agg(word, ' ' order by pos) filter (not gone) as kept from r group by 1)
        select doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
        from documents left join g using (doc_id)""",
    "op8_minhash": f"""
        with recursive d as (select doc_id, {_WORDS.format(f"translate(text, '{_UPPER}', '{_LOWER}')")} as ws from documents),
        w as (select doc_id, len(ws) as n, unnest(ws) as word, generate_subscripts(ws, 1) as pos from d),
        p as (select doc_id, n, pos, word, lead(word) over (partition by doc_id order by pos) as next from w),
        s as (select distinct doc_id, case when n = 1 then word else word || ' ' || next end as sh from p where n = 1 or next is not null),
        z as (select doc_id, count(*) as n from s group by 1),
        i as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2),
        l as (select x, y from i join z a on a.doc_id = x join z b on b.doc_id = y where 100 * c >= 80 * (a.n + b.n - c)),
        e as (select x, y from l union all select y, x from l),
        r(x, y) as (select doc_id, doc_id from documents union select r.x, e.y from r join e on r.y = e.x),
        c as (select x as doc_id, min(y) as component_id from r group by 1)
        select doc_id, coalesce(z.n, 0)::bigint as n_shingles, component_id, doc_id = component_id as kept from documents join c using (doc_id) left join z using (doc_id)""",
    # h is worked out bit by bit, as there is no crc32: -1 stands for a shift
    "op12_prefix_trie": r"""
        with t as (select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text,
                          row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as p from conversations where conv_id is not null),
        k as (select c, count(*) as n, c - c % 20 as b,
                     xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(c::varchar, ''), lambda x: [ascii(x)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, 3988292384 * (a & 1)) end), 4294967295) % 4 as h from t group by 1),
        r as (select c, p as d, role, text from k join (select c as b, p, role, text from t) using (b) where p <= h
              union all select c, p - h + least(h, coalesce(o.n, 0)), role, text from t join k using (c) left join (select c as b, n from k) o using (b) where p > h),
        f as (select c, d, len(regexp_extract_all(text, '[^ 	-
]+')) as w, list({'r': role, 't': text}) over (partition by c order by d) as path from r
              union all select c, 0, 0, [] from k),
        m as (select *, d = max(d) over (partition by c) as last from f),
        v as (select d, path, min(c) as conv, count(*) as n, max(w) as w, coalesce(string_agg(c, ',' order by c) filter (last), '') as ends from m group by 1, 2),
        u as (select a.*, b.conv as parent from v a left join v b on b.d = a.d - 1 and b.path = a.path[1:a.d - 1]),
        q as (select d - 1 as d, path[1:d - 1] as path, count(*) as n_children from v where d > 0 group by 1, 2),
        s as (select *, coalesce(n_children, 0) as kids from u left join q using (d, path)),
        x as (select e as d, path[1:e] as path, count(*) filter (kids = 0) as n_leaves, sum((n - 1) * w)::bigint as saved from (select *, unnest(range(0, d + 1)) as e from s) group by 1, 2)
        select conv as conv_id, d::bigint as depth, parent as parent_conv_id, n as n_convs, kids as n_children, n_leaves, saved as saved_tokens, sha256(ends) as ends_sha256
        from s join x using (d, path)""",
    "op13_vector_codes": _code_sql(),
}
