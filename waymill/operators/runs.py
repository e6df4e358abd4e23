"""Windows over ordered steps: runs, repeats, islands, order checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_step(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    return df.withColumn("step", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def islands(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """One row per run of equal values: key, value, first step, length."""
    own, same = Window.partitionBy(key).orderBy(*order), Window.partitionBy(key, value).orderBy(*order)
    numbered = df.withColumns({"step": F.row_number().over(own), "_island": F.row_number().over(own) - F.row_number().over(same)})
    return numbered.groupBy(key, value, "_island").agg(F.min("step").alias("first_step"), F.count("*").alias("length")).drop("_island")


def longest_runs(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    return islands(df, key, order, value).groupBy(key, value).agg(F.max("length").alias("longest_run"))


def nearest_rank(df: DataFrame, value: str, quantiles: dict[str, float], key: list[str] = ()) -> DataFrame:
    """min, mean, max and nearest-rank quantiles (half-even index) from a histogram, without a sort of all rows."""
    key = list(key) or ["_all"]
    src = df if key != ["_all"] else df.withColumn("_all", F.lit(1))
    hist = src.filter(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*key)
    cum = hist.withColumns({"_upto": F.sum("_n").over(w.orderBy(value)), "_total": F.sum("_n").over(w)})
    at = {name: F.min(F.when(F.col("_upto") > F.bround((F.col("_total") - 1) * F.lit(q)), F.col(value))).alias(name) for name, q in quantiles.items()}
    out = cum.groupBy(*key).agg(F.sum("_n").alias("n"), F.min(value).alias("min"), (F.sum(F.col(value).cast("decimal(18,4)") * F.col("_n")) / F.sum("_n")).cast("double").alias("mean"), *at.values(), F.max(value).alias("max"))
    return out.drop("_all") if key == ["_all"] else out


def streaks(df: DataFrame, run: str, order: list[str], outcome: str, counted: str, reset: str) -> DataFrame:
    """Length of the streak of counted outcomes after each row; reset outcomes start anew, all others leave it."""
    w = Window.partitionBy(run).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    parts = df.withColumn("_part", F.sum((F.col(outcome) == reset).cast("int")).over(w))
    inner = Window.partitionBy(run, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return parts.withColumn("streak", F.sum((F.col(outcome) == counted).cast("long")).over(inner)).drop("_part")
