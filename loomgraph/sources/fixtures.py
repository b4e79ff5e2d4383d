"""The driver's tables read as tables of the domain: firms, edges, sector flows and size-band counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions.scalars import digits
from loomgraph.sources.bands import BANDS


#: Layers of the line items, by return flag: A is 0, R is 2, all others are 1.
LAYERS = 3


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def firms(spark: SparkSession, sf_dir: str, size: str = "price") -> DataFrame:
    """(id, firm_id, sector, size); size "price" is nearly equal for all firms, "turnover" varies."""
    part = read(spark, sf_dir, "part").select((F.col("p_partkey") + 1).alias("id"), digits(F.col("p_brand")).alias("sector"), F.col("p_retailprice").alias("price"))
    if size == "turnover":
        line = read(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") + 1).alias("id")).agg(F.sum("l_extendedprice").alias("turnover"))
        part = part.join(line, "id", "left").withColumn("turnover", F.coalesce("turnover", F.lit(0.0)))
    return part.select("id", F.concat(F.lit("Firm_"), F.col("id").cast("string")).alias("firm_id"), "sector", F.col(size).alias("size"))


def layered_firms(firms: DataFrame) -> DataFrame:
    """Each firm once in every layer, as the firm LAYERS * id + layer."""
    layers = F.explode(F.array(*(F.lit(n) for n in range(LAYERS))))
    return firms.withColumn("_layer", layers).withColumn("id", F.col("id") * LAYERS + F.col("_layer")).drop("_layer")


def line_pairs(spark: SparkSession, sf_dir: str, layered: bool = False) -> DataFrame:
    """Consecutive lines of an order as (buyer, seller, amount); self pairs and repeated pairs are still there.

    If layered, consecutive among the order's lines of one layer, between the layer's firms.
    """
    line = read(spark, sf_dir, "lineitem").withColumns({"firm": F.col("l_partkey") + 1, "layer": F.lit(0)})
    if layered:
        line = line.withColumn("layer", F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "R", 2).otherwise(1))
        line = line.withColumn("firm", F.col("firm") * LAYERS + F.col("layer"))
    own = Window.partitionBy("l_orderkey", *(["layer"] if layered else [])).orderBy("l_linenumber", "l_partkey", "l_extendedprice")
    pairs = line.select(F.col("firm").alias("buyer"), F.lead("firm").over(own).alias("seller"), F.col("l_extendedprice").alias("amount"))
    return pairs.where(F.col("seller").isNotNull())


def edges(spark: SparkSession, sf_dir: str, layered: bool = False) -> DataFrame:
    """Distinct directed edges (buyer, seller) without self-loops."""
    return line_pairs(spark, sf_dir, layered).where("buyer <> seller").select("buyer", "seller").distinct()


def sector_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, l, flow): amounts by buyer sector and seller sector."""
    f = firms(spark, sf_dir).select("id", "sector")
    pairs = line_pairs(spark, sf_dir)
    return (
        pairs.join(f.select(F.col("id").alias("buyer"), F.col("sector").alias("k")), "buyer")
        .join(f.select(F.col("id").alias("seller"), F.col("sector").alias("l")), "seller")
        .groupBy("k", "l")
        .agg(F.sum("amount").alias("flow"))
    )


def firm_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide table of firm counts: a row per sector (nation) and a column per size band (price times 100)."""
    orders = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    price = F.col("o_totalprice") * 100
    return orders.groupBy(F.col("c_nationkey").cast("string").alias("SIC")).agg(*(F.count(F.when((price >= low) & (price <= high), 1)).alias(name) for name, low, high in BANDS))
