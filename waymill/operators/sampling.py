"""Exact quotas and splits by stable hash ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymill.functions.columns import stable_rank


def largest_remainder(counts: DataFrame, strata: list[str], total: int, seed: str, count: str = "n", within: list[str] = ()) -> DataFrame:
    """Adds quota: total dealt to the strata by their counts; what rounding leaves goes to the largest remainders, ties by hash.
    With within, each of its groups deals out its own total (column ``total``). Whole numbers throughout."""
    w = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(1))  # one row a stratum
    have = counts if within else counts.withColumn("total", F.lit(total).cast("long"))
    have = have.withColumn("_all", F.sum(count).over(w)).withColumn("_exact", F.col(count) * F.col("total"))
    have = have.withColumns({"_floor": F.floor(F.col("_exact") / F.col("_all")).cast("long"), "_rest": F.col("_exact") % F.col("_all"), "_tie": stable_rank(seed, *[F.col(s) for s in strata])})
    left = F.col("total") - F.sum("_floor").over(w)
    ranked = have.withColumns({"_left": left, "_rank": F.row_number().over(w.orderBy(F.desc("_rest"), "_tie"))})
    return ranked.withColumn("quota", F.col("_floor") + (F.col("_rank") <= F.col("_left")).cast("long")).drop("_all", "_exact", "_floor", "_rest", "_tie", "_left", "_rank", *([] if within else ["total"]))


def least_ranked(df: DataFrame, strata: list[str], key: str, quotas: DataFrame, seed: str, chosen: str = "_chosen") -> DataFrame:
    """Adds chosen: whether a row is among the quota (columns strata, quota) of the least hash ranks of its stratum.

    Rows are counted by the first three digits of their hash and ranked inside such a bucket, in one pass; whole buckets below
    the quota are in, so no task orders a stratum.
    """
    own = df.withColumn("_h", stable_rank(seed, F.col(key))).withColumn("_b", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    w = Window.partitionBy(*strata).orderBy("_b")  # 4,096 rows of a stratum at most
    counts = own.groupBy(*strata, "_b").agg(F.count("*").alias("_n")).withColumn("_upto", F.sum("_n").over(w))
    ends = counts.join(quotas.select(*strata, "quota"), strata).filter("_upto - _n < quota").select(*strata, "_b", (F.col("quota") - (F.col("_upto") - F.col("_n"))).alias("_left"), "_n")
    held = own.join(ends, [*strata, "_b"], "left")
    ranked = held.withColumn("_r", F.row_number().over(Window.partitionBy(*strata, "_b").orderBy("_h", key)))
    return ranked.withColumn(chosen, F.coalesce(F.col("_r") <= F.col("_left"), F.lit(False))).drop("_h", "_b", "_left", "_n", "_r")


def stratified_split(df: DataFrame, strata: list[str], key: str, holdout: int, seed: str) -> DataFrame:
    """Adds split: in each stratum the rows of the least ranks, as many as its quota, are the holdout."""
    quotas = largest_remainder(df.groupBy(*strata).agg(F.count("*").alias("n")), strata, holdout, seed)
    ranked = least_ranked(df, strata, key, quotas, seed)
    return ranked.withColumn("split", F.when(F.col("_chosen"), "holdout").otherwise("train")).drop("_chosen")


def global_rank(df: DataFrame, order: str, rank: str = "rank") -> DataFrame:
    """Adds the place (from 1) of each row in the order of a hex hash column, ties in any order. Ranks are counted inside the
    hash's 4,096 leading values and shifted by the counts before them, so no task sees more than its share of the rows."""
    own = df.withColumn("_b", F.conv(F.substring(order, 1, 3), 16, 10).cast("int"))
    sizes = own.groupBy("_b").agg(F.count("*").alias("_n"))  # 4,096 rows at most
    before = sizes.select("_b", (F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy("_b")) - F.col("_n")).alias("_before"))
    inner = F.row_number().over(Window.partitionBy("_b").orderBy(order))
    return own.withColumn("_r", inner).join(F.broadcast(before), "_b").withColumn(rank, (F.col("_before") + F.col("_r")).cast("long")).drop("_b", "_r", "_before")


def blended_prior(weights: DataFrame, weight: str = "weight", share: float = 0.65) -> DataFrame:
    """Adds prior: the share of the weights mixed with equal parts. One row a value."""
    w = Window.partitionBy(F.lit(1))
    return weights.withColumn("prior", share * F.col(weight) / F.sum(weight).over(w) + (1 - share) / F.count("*").over(w))


def balanced_repetitions(values: DataFrame, key: str, total: int, seed: str) -> DataFrame:
    """Adds quota: equal parts of total, what is left one each to the values of the least hashes. One row a value."""
    w = Window.partitionBy(F.lit(1))
    n = F.count("*").over(w)
    rank = F.row_number().over(w.orderBy(stable_rank(seed, F.col(key))))
    return values.withColumn("quota", (F.floor(F.lit(total) / n) + (rank <= F.lit(total) % n).cast("long")).cast("long"))


def exact_column(slots: DataFrame, quotas: DataFrame, value: str, key: str, seed: str) -> DataFrame:
    """Gives every slot a value so that the counts equal the quotas (value, quota; a small table): slots in hash order take the
    values in turn by running totals. Slots beyond the quotas' total get null."""
    upper = F.sum("quota").over(Window.partitionBy(F.lit(1)).orderBy(value))
    bounds = quotas.select(value, (upper - F.col("quota")).alias("_from"), upper.alias("_to"))
    ranked = global_rank(slots.withColumn("_h", stable_rank(seed, F.col(key))), "_h", "_rank")
    return ranked.join(F.broadcast(bounds), (F.col("_rank") > F.col("_from")) & (F.col("_rank") <= F.col("_to")), "left").drop("_h", "_rank", "_from", "_to")


def round_robin(rows: DataFrame, group: list[str], key: str, values: list, seed: str, out: str = "assigned") -> DataFrame:
    """Deals the values in turn over the rows of each group, in hash order: their counts in a group differ by one at most.

    Ranks are counted inside the first three digits of the hash and shifted by the rows before, so no task orders a group.
    """
    own = rows.withColumn("_h", stable_rank(seed, F.col(key))).withColumn("_b", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    counts = own.groupBy(*group, "_b").agg(F.count("*").alias("_n"))
    before = counts.select(*group, "_b", (F.sum("_n").over(Window.partitionBy(*group).orderBy("_b")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(*group, "_b").orderBy("_h", key))
    held = own.withColumn("_r", rank).join(before, [*group, "_b"])
    return held.withColumn(out, F.get(F.array(*map(F.lit, values)), ((F.col("_before") + F.col("_r") - 1) % len(values)).cast("int"))).drop("_h", "_b", "_r", "_before")


def quota_drift(rows: DataFrame, quotas: DataFrame, value: str) -> DataFrame:
    """(value, quota, n, drift) of all values of either side."""
    n = rows.groupBy(value).agg(F.count("*").alias("n"))
    own = quotas.select(value, "quota").join(n, value, "full").select(value, F.coalesce("quota", F.lit(0)).alias("quota"), F.coalesce("n", F.lit(0)).alias("n"))
    return own.withColumn("drift", F.col("n") - F.col("quota"))


def swap_violators(rows: DataFrame, key: str, column: str, violates, donates, seed: str) -> DataFrame:
    """Rows that break a rule swap their value with the k-th row that may give, both in hash order; the column's counts stay.
    Violators without a donor keep their value. violates and donates are conditions that exclude each other; keys are unique."""
    rank = lambda cond: global_rank(rows.filter(cond).select(key, column).withColumn("_h", stable_rank(seed, F.col(key))), "_h", "_k")
    a, b = rank(violates).select("_k", F.col(key).alias("_a"), F.col(column).alias("_va")), rank(donates).select("_k", F.col(key).alias("_b"), F.col(column).alias("_vb"))
    pairs = a.join(b, "_k")
    new = pairs.select(F.col("_a").alias(key), F.col("_vb").alias("_new")).unionByName(pairs.select(F.col("_b").alias(key), F.col("_va").alias("_new")))
    return rows.join(new.withColumn("_hit", F.lit(True)), key, "left").withColumn(column, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(column))).drop("_new", "_hit")
