"""A corpus pipeline: quality rules, language ID, near duplicates, repeated passages, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that, written
as Parquet and read again, is the next one's docs. run() applies them all to the documents of a folder.

Documents that the first two stages reject go; of each group of near duplicates the one with the smallest id stays;
passages of 50 words or more that a document with a smaller id has too are cut out (a document may be
left empty, it stays); the last stage returns the pieces of all documents with their places in sequences.
Nulls, empty texts and repeated rows are treated as each operator defines.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import language, neardup, packing, quality, worddup
from loomgraph.llm.common import held_out, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Shingle size and similarity (per cent) of near duplicates.
SHINGLE, PERCENT = 5, 80
#: Words that packing remembers: workers keep them while other stages need the memory.
REMEMBERED = 200_000
#: Language predictions that are less sure than this are rejected.
LEAST_SCORE = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and no learned rule rejects. Null and empty texts fail the base rules; without labels nothing is learned."""
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judged(docs.select(*COLUMNS), rules).where("kept").select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with some certainty. Texts without a letter go; where no language is known at all, every document does."""
    docs = docs.select(*COLUMNS)
    model = language.fit(language.sample(docs, ~held_out(F.col("doc_id"))))
    known = language.identify(docs, model)
    return known.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates. Rows of one id stand or fall together; null ids stay."""
    docs = docs.select(*COLUMNS)
    gone = neardup.classes(docs, size=SHINGLE, percent=PERCENT).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*COLUMNS)


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document with a smaller id has, too, and n_chars to match. Null texts stay null, and so does their n_chars."""
    kind = docs.schema["n_chars"].dataType
    return worddup.cleaned(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast(kind)).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places; null and empty texts are one piece of their end id."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), remembered=REMEMBERED)


STAGES = [
    ("quality rules", quality_stage),
    ("language", language_stage),
    ("near duplicates", near_duplicate_stage),
    ("repeated passages", passage_stage),
    ("packing", packing_stage),
]

#: No SQL: several stages can't be expressed in it; tests/llm compares each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
