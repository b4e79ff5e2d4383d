"""Readers of the domain's text files, and writers of its outputs. All lines are read and written by Spark."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.scalars import code, digits, lenient_number
from loomgraph.lineage import numbered

#: Column names that stand for the same thing, in order of preference.
FIRM_ALIASES = ("firm_id", "firm id", "firmid", "id")
SECTOR_ALIASES = ("sic", "sector", "sector_code", "sector code")
SIZE_ALIASES = ("size",)
DELIMITERS = (",", ";", "\t")


def exists(spark: SparkSession, path: str, missing: str = "error") -> bool:
    """Whether a path exists; missing: "error" raises if it doesn't, "skip" reports and returns False."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return True
    if missing == "skip":
        print(f"{path} is missing; skipped")
        return False
    raise FileNotFoundError(path)


def resolve(columns: list[str], aliases: tuple[str, ...]) -> str:
    """The column that the first matching alias names, whatever its case and outer blanks."""
    known = {c.strip().lower(): c for c in reversed(columns)}
    for a in aliases:
        if a in known:
            return known[a]
    raise ValueError(f"none of the columns {', '.join(aliases)} is there")


def delimiter(line: str) -> str:
    """The delimiter that occurs most often in a header line; a comma if none does."""
    return max(DELIMITERS, key=lambda d: (line.count(d), -DELIMITERS.index(d)))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with a number that grows in file order."""
    return spark.read.text(path).withColumn("line", F.monotonically_increasing_id())


def _tokens(lines: DataFrame) -> DataFrame:
    return lines.withColumn("_t", F.split(F.trim("value"), r"\s+"))


def edges_lenient(lines: DataFrame) -> DataFrame:
    """(buyer, seller) of lines (value): lines of fewer than two tokens are skipped, further tokens ignored; a non-integer raises."""
    t = _tokens(lines).where(F.size("_t") >= 2)
    return t.select(F.col("_t")[0].cast("bigint").alias("buyer"), F.col("_t")[1].cast("bigint").alias("seller"))


def edges_strict(lines: DataFrame, n: int | None = None, flip: bool = False) -> DataFrame:
    """Distinct edges (buyer, seller) without self-loops. Ids that are no integers, below 1 or above n raise.

    Unlike readers that stop at the first odd token without a word, any odd line is an error.
    """
    t = _tokens(lines).where(F.trim("value") != "")
    a, b = (F.try_element_at("_t", F.lit(k)).try_cast("bigint") for k in (1, 2))
    odd = a.isNull() | b.isNull() | (a < 1) | (b < 1)
    if n is not None:
        odd = odd | (a > n) | (b > n)
    fail = F.raise_error(F.concat(F.lit("not an edge: "), F.col("value"))).cast("bigint")
    t = t.select(F.when(odd, fail).otherwise(a).alias("buyer"), F.when(odd, fail).otherwise(b).alias("seller"))
    if flip:
        t = t.select(F.col("seller").alias("buyer"), F.col("buyer").alias("seller"))
    return t.where("buyer <> seller").distinct()


def read_edges(spark: SparkSession, path: str, strict: bool = False, n: int | None = None, flip: bool = False) -> DataFrame:
    lines = spark.read.text(path)
    return edges_strict(lines, n, flip) if strict else edges_lenient(lines)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A delimited table with a header as strings: the delimiter is the header's, names are trimmed, quotes doubled in quotes."""
    head = spark.read.text(path).where(F.trim("value") != "").first()
    sep = delimiter(head[0] if head else "")
    df = spark.read.csv(path, header=True, sep=sep, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return df.toDF(*(c.strip().lstrip("﻿").strip() for c in df.columns))


def read_strength(spark: SparkSession, path: str) -> DataFrame:
    """(firm_id, size); sizes that can't be read, are negative or not finite are 0."""
    df = read_table(spark, path)
    return df.select(F.trim(F.col(resolve(df.columns, FIRM_ALIASES))).alias("firm_id"), lenient_number(F.col(resolve(df.columns, SIZE_ALIASES))).alias("size"))


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(firm_id, sic) with sector codes normalised."""
    df = read_table(spark, path)
    return df.select(F.trim(F.col(resolve(df.columns, FIRM_ALIASES))).alias("firm_id"), code(F.col(resolve(df.columns, SECTOR_ALIASES))).alias("sic"))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(k, l, value) of a labelled square matrix: blank lines skipped, a first line `sep=x` honoured, byte order mark dropped.

    Rows are taken in the order of the header's columns, their own labels are passed over. With fewer rows than columns
    the matrix is cut to the sectors that have a row, with a warning; rows beyond the columns are passed over; a row with
    fewer cells than the header is an error. The header has one name per sector, so the driver reads it; cells are split by Spark.
    """
    lines = _lines(spark, path).withColumn("value", F.regexp_replace("value", "^\ufeff", "")).where(F.trim("value") != "")
    first = lines.orderBy("line").limit(2).collect()
    if not first:
        raise ValueError(f"{path} is empty")
    sep = None
    if first[0]["value"].lower().startswith("sep="):
        sep, first = first[0]["value"][4:5], first[1:]
    if not first:
        raise ValueError(f"{path} has no header")
    header = first[0]["value"]
    sep = sep or delimiter(header)
    names = next(csv.reader([header], delimiter=sep, skipinitialspace=True))[1:]
    labels = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(names)], "i int, x string").orderBy("i").select(code(F.col("x"))).collect()]
    width = len(labels) + 1
    schema = ", ".join(f"c{i} string" for i in range(width))
    body = lines.where(F.col("line") > first[0]["line"]).withColumn("_c", F.from_csv("value", schema, {"sep": sep, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "true", "mode": "PERMISSIVE"}))
    n = min(body.count(), len(labels))
    if n < len(labels):
        print(f"{path}: {n} rows for {len(labels)} columns; cut to {n}")
    rows = numbered(body, ["line"], "r").where(F.col("r") < n)
    short = F.raise_error(F.concat(F.lit("fewer cells than columns: "), F.col("value"))).cast("double")
    names_of = F.array(*(F.lit(x) for x in labels))
    # a missing cell is null, an empty one is a zero like any other that is no number
    values = F.array(*(F.when(F.col(f"_c.c{width - 1}").isNull() & ~F.col("value").endswith(sep), short).otherwise(lenient_number(F.coalesce(F.col(f"_c.c{i + 1}"), F.lit("")))) for i in range(n)))
    return rows.select(F.get(names_of, F.col("r").cast("int")).alias("k"), F.posexplode(values).alias("p", "value")).select("k", F.get(names_of, F.col("p")).alias("l"), "value")


def supplier_rows(lines: DataFrame) -> DataFrame:
    """(buyer, suppliers) of lines `buyer,s1,s2,...`: comments and blank lines skipped, ids of 0 or less dropped, suppliers sorted and distinct."""
    t = lines.where((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    ids = F.filter(F.transform(F.split("value", ","), lambda x: F.trim(x).try_cast("bigint")), lambda x: x.isNotNull() & (x > 0))
    t = t.select(F.trim(F.split("value", ",")[0]).try_cast("bigint").alias("buyer"), ids.alias("_ids"))
    return t.where(F.col("buyer") > 0).select("buyer", F.array_sort(F.array_distinct(F.slice("_ids", 2, F.greatest(F.size("_ids") - 1, F.lit(0))))).alias("suppliers"))


def id_values(lines: DataFrame, top: int | None = None) -> DataFrame:
    """(id, value) of numbered lines `id,value`: the last line of an id counts, negative values are 0; ids above top are left out."""
    t = lines.withColumn("_t", F.split("value", ",")).where((F.size("_t") >= 2) & ~F.trim("value").startswith("#"))
    t = t.select("line", F.trim(F.col("_t")[0]).try_cast("bigint").alias("id"), F.greatest(F.coalesce(F.trim(F.col("_t")[1]).try_cast("double"), F.lit(0.0)), F.lit(0.0)).alias("v"))
    t = t.where((F.col("id") > 0) & (F.lit(True) if top is None else F.col("id") <= top))
    return t.groupBy("id").agg(F.max_by("v", "line").alias("value"))


def read_network(spark: SparkSession, path: str) -> DataFrame:
    return supplier_rows(spark.read.text(path))


def read_money(spark: SparkSession, path: str, top: int | None = None) -> DataFrame:
    return id_values(_lines(spark, path), top).withColumnRenamed("value", "size")


def read_sectors(spark: SparkSession, path: str, top: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, sector), the last line of an id counting; and the sorted distinct sectors of all lines in range."""
    lines = _lines(spark, path)
    every = lines.withColumn("_t", F.split("value", ",")).where(F.size("_t") >= 2).select("line", F.trim(F.col("_t")[0]).try_cast("bigint").alias("id"), F.trim(F.col("_t")[1]).try_cast("bigint").alias("sector"))
    every = every.where((F.col("id") > 0) & F.col("sector").isNotNull() & (F.lit(True) if top is None else F.col("id") <= top))
    return every.groupBy("id").agg(F.max_by("sector", "line").alias("sector")), every.select("sector").distinct().orderBy("sector")


def read_deltas(spark: SparkSession, path: str | None) -> DataFrame:
    """(line, id, delta); without a file nothing, so every firm gets the default."""
    if path is None or not exists(spark, path, "skip"):
        return spark.createDataFrame([], "line long, id long, delta double")
    t = _lines(spark, path).withColumn("_t", F.split("value", ",")).where(F.size("_t") >= 2)
    return t.select("line", F.trim(F.col("_t")[0]).try_cast("bigint").alias("id"), F.trim(F.col("_t")[1]).try_cast("double").alias("delta")).where(F.col("id").isNotNull() & F.col("delta").isNotNull())


def edge_lines(edges: DataFrame, flip: bool = False) -> DataFrame:
    """Lines `buyer seller`."""
    a, b = ("seller", "buyer") if flip else ("buyer", "seller")
    return edges.select(F.format_string("%d %d", a, b).alias("value"))


def network_lines(rows: DataFrame) -> DataFrame:
    """Lines `buyer,s1,s2,...`, buyers ascending."""
    return rows.orderBy("buyer").select(F.concat_ws(",", F.col("buyer").cast("string"), F.array_join(F.transform("suppliers", lambda x: x.cast("string")), ",")).alias("value"))


def sector_lines(mapping: DataFrame) -> DataFrame:
    """Lines `firm,sector` of rows that have both, sorted by them, repeated rows kept. mapping: (firm_id, sector) in any form."""
    ids = mapping.select(digits(F.col("firm_id")).alias("id"), digits(F.col("sector")).alias("s")).dropna()
    return ids.orderBy("id", "s").select(F.format_string("%d,%d", "id", "s").alias("value"))


def money_lines(strength: DataFrame) -> DataFrame:
    """Lines `id,size` of all rows; an unknown id is empty."""
    return strength.select(F.concat_ws(",", F.coalesce(digits(F.col("firm_id")).cast("string"), F.lit("")), F.col("size").cast("string")).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("overwrite").text(path)


def write_weights(weights: DataFrame, path: str) -> None:
    """buyer, seller, weight with a header; doubles are written so that they read back unchanged."""
    weights.select("buyer", "seller", "weight").write.mode("overwrite").csv(path, header=True)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)
