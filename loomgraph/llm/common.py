"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.lineage import dropped, shared_dir, written

__all__ = ["dropped", "extended", "held_out", "partitions", "shared_dir", "table", "written"]

#: Characters between words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD_BREAKS = " \t\n\x0b\x0c\r"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text is divisible by five; a null id is held out, so never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def extended(schema: T.StructType, **columns: str) -> T.StructType:
    """A schema with further columns; the one given stays as it is."""
    more = T.StructType.fromDDL(", ".join(f"`{name}` {kind}" for name, kind in columns.items()))
    return T.StructType([*schema.fields, *more.fields])
