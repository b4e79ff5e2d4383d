"""Written tables that cut lineage in iterative jobs, and ranks over whole tables."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where that is unset, a local master (one machine, as in tests) gets a temporary folder; on a cluster it is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loomgraph-"))
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return current.get()


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that written() made, once nothing reads them any more; tables from elsewhere stay."""
    for old in tables:
        spark = old.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path
        own = path(f"{shared_dir(spark)}/loomgraph").toUri().getPath()
        for folder in {f.rsplit("/", 1)[0] for f in old.inputFiles()}:
            at = path(folder)
            if at.getParent().toUri().getPath() == own:
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/loomgraph/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, discard: list[DataFrame] | tuple = (), clean: bool = True) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here, and a lost executor loses nothing.

    Tables in `discard`, which this one replaces, are deleted; if clean, shuffle files of finished jobs are let go.
    """
    spark, schema = df.sparkSession, df.schema
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    del df
    dropped(*discard)
    if clean:
        gc.collect()
        spark._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def stored(df: DataFrame, discard: list[DataFrame] | tuple = ()) -> DataFrame:
    """df as a written table: an iteration's plan doesn't grow, and lost executors lose nothing."""
    return written(df, "step", discard, clean=False)


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """df with its rows numbered from 0 in a global order: ranges are sorted apart, and each is shifted by the rows before it."""
    parts = stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")  # one row per range
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn(out, own).join(before, "_part").withColumn(out, (F.col(out) + F.col("_before") - 1).cast("long")).drop("_part", "_before")
