"""Groups of rollouts: classification, policy metrics, signal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def classify(rollouts: DataFrame, group: list[str], size: int = 8, tolerance: float = 1e-9) -> DataFrame:
    """One row per group. rollouts: reward, reward_valid, overflow, rollout (its number). Rules in order: a wrong size or an
    invalid reward make it invalid, overflow comes between them, no spread is zero_variance, all else is usable."""
    g = rollouts.groupBy(*group).agg(
        F.count("*").alias("n"), F.max("reward").alias("max_reward"), F.min("reward").alias("min_reward"), F.avg(F.col("reward").cast("decimal(18,4)")).cast("double").alias("mean_reward"),
        F.bool_or("overflow").alias("any_overflow"), F.bool_or(~F.col("reward_valid")).alias("any_invalid"), F.min_by("reward", "rollout").alias("first_reward"), F.count(F.when(F.col("reward_valid") & (F.col("reward") >= 0.5), 1)).alias("n_pass"),
    )
    outcome = F.when(F.col("n") != size, "invalid").when(F.col("any_overflow"), "length_exceeded").when(F.col("any_invalid"), "invalid").when(F.col("max_reward") - F.col("min_reward") <= tolerance, "zero_variance").otherwise("usable")
    out = g.withColumn("outcome", outcome)
    return out.withColumn("shared_reward", F.when(F.col("outcome") == "zero_variance", F.col("first_reward"))).drop("first_reward")


def policy_metrics(groups: DataFrame, size: int = 8) -> DataFrame:
    """Over complete groups: average and any-of-n pass rates, and the shares unsolved, at the frontier and mastered."""
    own = groups.filter(F.col("n") == size)
    share = lambda c: F.coalesce(F.count(F.when(c, 1)) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0))
    return own.agg(
        F.count("*").alias("groups"), F.coalesce(F.sum("n_pass") / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)).alias("avg_at_n"), share(F.col("n_pass") > 0).alias("pass_at_n"),
        share(F.col("n_pass") == 0).alias("unsolved"), share((F.col("n_pass") > 0) & (F.col("n_pass") < size)).alias("frontier"), share(F.col("n_pass") == size).alias("mastered"),
    )


def advantages(rollouts: DataFrame, group: list[str]) -> DataFrame:
    """Rewards less their group's mean."""
    return rollouts.withColumn("advantage", F.col("reward") - F.avg("reward").over(Window.partitionBy(*group)))
