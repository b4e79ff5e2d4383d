"""Sampling firms from counts by sector and size band."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.scalars import counted, custom_round, with_pair_uniform
from loomgraph.sources.bands import BANDS


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """df with trimmed column names; an error lists what is missing."""
    df = df.toDF(*(c.strip() for c in df.columns))
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def cells(counts: DataFrame) -> DataFrame:
    """(cell, sic, band, low, high, n) of each positive count; cell numbers follow sector, then band.

    Counts are cut to whole numbers; null counts and those below 1 make no cell.
    """
    counts = require_columns(counts, ["SIC", *(b[0] for b in BANDS)])
    band = F.posexplode(F.array(*(F.struct(F.lit(float(low)).alias("low"), F.lit(float(high)).alias("high"), F.col(f"`{name}`").cast("double").alias("n")) for name, low, high in BANDS)))
    rows = counts.select(F.trim(F.col("SIC").cast("string")).alias("sic"), band.alias("band", "_c")).select("sic", "band", "_c.low", "_c.high", F.col("_c.n").cast("long").alias("n"))
    order = Window.orderBy(F.length("sic"), "sic", "band")  # bounded: sectors times bands
    return rows.where(F.col("n") > 0).withColumn("cell", F.row_number().over(order).cast("long")).select("cell", "sic", "band", "low", "high", "n")


def allocation(cell_table: DataFrame, target: int) -> DataFrame:
    """cells with expectation, base (its whole part), remainder, and the deficit that is left to draw."""
    if target <= 0:
        raise ValueError("the target must be positive")
    total = F.broadcast(cell_table.agg(F.sum("n").alias("_total")))
    df = cell_table.crossJoin(total).withColumn("expected", F.col("n") * (F.lit(float(target)) / F.col("_total"))).drop("_total")
    df = df.withColumn("base", F.floor("expected").cast("long")).withColumn("remainder", F.col("expected") - F.col("base"))
    return df.crossJoin(F.broadcast(df.agg((F.lit(target) - F.sum("base")).alias("deficit"))))


def sample_counts(cell_table: DataFrame, target: int | str, seed: int = 0) -> DataFrame:
    """cells with `draw`: how many firms to take. "ALL" takes the counts.

    Units left over after the whole parts are drawn with replacement, each by the remainders' shares. Where rounding has
    put the whole parts above the target, units are taken back, one each from cells drawn among those that have any. The
    sum is always the target; a cell may exceed its count, as in any draw with replacement.
    """
    if target == "ALL":
        return cell_table.withColumn("draw", F.col("n"))
    if cell_table.agg(F.sum("n")).first()[0] in (None, 0):
        raise ValueError("the counts sum to zero")
    spark = cell_table.sparkSession
    parts = allocation(cell_table, int(target))
    deficit = parts.select("deficit").first()[0]
    if deficit < 0:
        if parts.where("base > 0").count() < -deficit:
            raise ValueError("more units are to be taken back than cells have any")
        drawn = with_pair_uniform(parts.withColumn("_seed", F.lit(seed)), "cell", "_seed", "_u")
        place = F.row_number().over(Window.orderBy(F.col("base") <= 0, "_u", "cell"))  # bounded: sectors times bands
        return drawn.withColumn("draw", F.col("base") - F.when(place <= -deficit, 1).otherwise(0)).drop("expected", "base", "remainder", "deficit", "_seed", "_u")
    w = Window.orderBy("cell")
    weight = F.when(F.sum("remainder").over(Window.partitionBy()) > 0, F.col("remainder")).otherwise(F.lit(1.0))
    running = parts.withColumn("_w", weight).withColumn("_to", F.sum("_w").over(w)).withColumn("_from", F.col("_to") - F.col("_w"))
    top = F.max("_to").over(Window.partitionBy())
    running = running.withColumn("_last", F.col("_to") == top).withColumn("_from", F.col("_from") / top).withColumn("_to", F.col("_to") / top)
    draws = with_pair_uniform(spark.range(deficit).withColumn("_seed", F.lit(seed)), "id", "_seed", "u").select("u")
    hit = (F.col("u") >= F.col("_from")) & ((F.col("u") < F.col("_to")) | F.col("_last"))
    # cells are sectors times bands, a bounded table: their ranges go to every task
    extra = draws.join(F.broadcast(running.select("cell", "_from", "_to", "_last")), hit).groupBy("cell").agg(F.count(F.lit(1)).alias("extra"))
    return parts.join(extra, "cell", "left").withColumn("draw", F.col("base") + F.coalesce("extra", F.lit(0))).drop("expected", "base", "remainder", "deficit", "extra")


def expanded(drawn: DataFrame, seed: int = 0) -> DataFrame:
    """(firm, firm_id, sic, size): `draw` firms per cell, numbered through in cell order, sizes uniform in the band.

    Numbers come from each cell's offset, so no global sort of firms is needed.
    """
    offset = F.sum("draw").over(Window.orderBy("cell")) - F.col("draw")
    df = counted(drawn.withColumn("_before", offset), F.col("draw"), "_k").withColumn("firm", F.col("_before") + F.col("_k") + 1)
    df = with_pair_uniform(df.withColumn("_seed", F.lit(seed + 1)), "firm", "_seed", "_u")
    size = custom_round(F.col("low") + (F.col("high") - F.col("low")) * F.col("_u"))
    return df.select("firm", F.concat(F.lit("Firm_"), F.col("firm").cast("string")).alias("firm_id"), "sic", "low", "high", size.alias("size"))
