"""What the query modules share: registration, and the stand-in tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Queries(dict):
    """name -> (function of a table reader, SQL or None)"""

    def add(self, name: str, sql: str | None = None):
        def put(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
            self[name] = (lambda spark, sf_dir: f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")), sql)
            return f

        return put


def rollouts(events: DataFrame) -> DataFrame:
    """Events as rollouts: groups of eight in a user's order; value / 100 as reward, errors as invalid, large values as overflow."""
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return events.select(
        "user_id", "event_id", F.floor((rn - 1) / 8).cast("long").alias("grp"), ((rn - 1) % 8).cast("long").alias("rollout"), (F.floor("value") / 100).alias("reward"),
        (F.col("event_type") != "error").alias("reward_valid"), (F.col("value") > 250).alias("overflow"), "event_type", "value",
    )


ROLLOUTS = """ro AS (SELECT user_id, event_id, (rn - 1) // 8 AS grp, (rn - 1) % 8 AS rollout, floor(value) / 100 AS reward, event_type <> 'error' AS reward_valid, value > 250 AS overflow, event_type, value
 FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)),
gr AS (SELECT user_id, grp, count(*) AS n, max(reward) AS max_reward, min(reward) AS min_reward, CAST(avg(CAST(reward AS DECIMAL(18,4))) AS DOUBLE) AS mean_reward, bool_or(overflow) AS any_overflow, bool_or(NOT reward_valid) AS any_invalid,
 arg_min(reward, rollout) AS first_reward, count(*) FILTER (WHERE reward_valid AND reward >= 0.5) AS n_pass FROM ro GROUP BY user_id, grp),
gc AS (SELECT *, CASE WHEN n <> 8 THEN 'invalid' WHEN any_overflow THEN 'length_exceeded' WHEN any_invalid THEN 'invalid' WHEN max_reward - min_reward <= 1e-9 THEN 'zero_variance' ELSE 'usable' END AS outcome FROM gr)
"""

STEPS = "st AS (SELECT user_id, event_id, ts, event_type, value, props, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events)\n"


def steps(events: DataFrame) -> DataFrame:
    """Events as steps of a trajectory per user."""
    return events.withColumn("step", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long"))


def clock(minute):
    return F.format_string("%02d:%02d", F.floor(minute / 60).cast("int"), (minute % 60).cast("int"))


def activities(lineitem: DataFrame) -> DataFrame:
    """Line items as activities of plans, with days, kinds and clock times from their keys."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    kinds = F.array(*map(F.lit, ("attraction", "breakfast", "lunch", "dinner", "accommodation", "train")))
    start = (F.col("l_partkey") * 7 + F.col("l_linenumber") * 60) % 1380
    return lineitem.select(
        F.col("l_orderkey").alias("plan_id"), (F.col("l_linenumber") % 3 + 1).alias("day"), F.row_number().over(w).alias("pos"), F.get(kinds, (F.col("l_suppkey") % 6).cast("int")).alias("activity_type"),
        F.col("l_partkey").alias("candidate_id"), clock(start).alias("start_time"), clock(start + 45).alias("end_time"), start.alias("start_min"), (start + 45).alias("end_min"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"), F.col("l_extendedprice").alias("amount"),
    )


def entities(part: DataFrame) -> DataFrame:
    """Parts of more than size 2 as places and transports."""
    kinds = F.array(*map(F.lit, ("hotel", "restaurant", "attraction")))
    return part.filter("p_size > 2").select(
        F.col("p_partkey").alias("candidate_id"), F.get(kinds, F.col("p_size") % 3).alias("entity_type"), (F.col("p_size") % 3).alias("city"), (F.col("p_size") % 3).alias("origin_city"), (F.col("p_partkey") % 3).alias("destination_city"),
        clock(F.col("p_size") % 9 * 60).alias("open_time"), clock(1020 + F.col("p_size") % 6 * 60).alias("close_time"),
    )


def plan_table(orders: DataFrame) -> DataFrame:
    return orders.select(F.col("o_orderkey").alias("plan_id"), (F.col("o_custkey") % 3).alias("origin"), (F.col("o_orderkey") % 3).alias("destination"), (F.col("o_custkey") % 4 + 1).alias("days"))


PLANS = """act AS (SELECT l_orderkey AS plan_id, l_linenumber % 3 + 1 AS day, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos,
 ['attraction', 'breakfast', 'lunch', 'dinner', 'accommodation', 'train'][l_suppkey % 6 + 1] AS activity_type, l_partkey AS candidate_id, (l_partkey * 7 + l_linenumber * 60) % 1380 AS a, (l_partkey * 7 + l_linenumber * 60) % 1380 + 45 AS b, l_extendedprice / l_quantity AS unit_price, l_extendedprice AS amount FROM lineitem),
ent AS (SELECT p_partkey AS candidate_id, ['hotel', 'restaurant', 'attraction'][p_size % 3 + 1] AS entity_type, p_size % 3 AS city, p_size % 3 AS origin_city, p_partkey % 3 AS destination_city, p_size % 9 * 60 AS o, 1020 + p_size % 6 * 60 AS c FROM part WHERE p_size > 2),
pl AS (SELECT o_orderkey AS plan_id, o_custkey % 3 AS origin, o_orderkey % 3 AS destination, o_custkey % 4 + 1 AS days FROM orders)
"""
