"""Evaluation reports."""

from pyspark.sql import functions as F

from waymill.plans.base import Queries

QUERIES = Queries()


@QUERIES.add("e1_benchmark_summary", "SELECT count(*) AS attempts, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'purchase') AS accepted, round(count(*) FILTER (WHERE event_type = 'purchase') / nullif(count(*), 0), 6) AS rate FROM events")
def e1(t):
    n = lambda v: F.count(F.when(F.col("event_type") == v, 1))
    return t("events").agg(F.count("*").alias("attempts"), n("error").alias("errors"), n("purchase").alias("accepted"), F.round(n("purchase") / F.nullif(F.count("*"), F.lit(0)), 6).alias("rate"))


@QUERIES.add("e2_delta", "WITH s AS (SELECT user_id % 2 AS arm, count(*) FILTER (WHERE event_type = 'purchase') / count(*) AS rate FROM events GROUP BY 1) SELECT round(b.rate - a.rate, 6) AS delta FROM s a, s b WHERE a.arm = 0 AND b.arm = 1")
def e2(t):
    arm = lambda k: (F.count(F.when((F.col("user_id") % 2 == k) & (F.col("event_type") == "purchase"), 1)) / F.count(F.when(F.col("user_id") % 2 == k, 1)))
    return t("events").agg(F.round(arm(1) - arm(0), 6).alias("delta"))


@QUERIES.add("e3_pass_table", "SELECT coalesce(o_orderpriority, 'total') AS split, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS passed FROM orders GROUP BY ROLLUP (o_orderpriority)")
def e3(t):
    return t("orders").rollup("o_orderpriority").agg(F.count("*").alias("n"), F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("passed")).select(F.coalesce("o_orderpriority", F.lit("total")).alias("split"), "n", "passed")


@QUERIES.add("e4_paired_change", "WITH a AS (SELECT o_custkey AS k, bool_or(o_orderstatus = 'F') AS x FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1), b AS (SELECT o_custkey AS k, bool_or(o_orderstatus = 'F') AS y FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1) SELECT count(*) FILTER (WHERE y AND NOT x) AS gained, count(*) FILTER (WHERE x AND NOT y) AS lost, count(*) FILTER (WHERE y AND NOT x) - count(*) FILTER (WHERE x AND NOT y) AS net FROM a JOIN b USING (k)")
def e4(t):
    passed = lambda k, name: F.bool_or(F.when(F.col("o_orderkey") % 2 == k, F.col("o_orderstatus") == "F")).alias(name)
    g = t("orders").groupBy("o_custkey").agg(passed(0, "x"), passed(1, "y")).filter("x is not null and y is not null")
    gained, lost = F.count(F.when(F.col("y") & ~F.col("x"), 1)), F.count(F.when(F.col("x") & ~F.col("y"), 1))
    return g.agg(gained.alias("gained"), lost.alias("lost"), (gained - lost).alias("net"))


@QUERIES.add("e6_grouping_sets", "SELECT o_orderpriority, extract(year FROM o_orderdate) AS year, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderpriority), (extract(year FROM o_orderdate)))")
def e6(t):
    o = t("orders").withColumn("year", F.year("o_orderdate").cast("long"))
    p, y = F.col("o_orderpriority"), F.col("year")
    return o.groupingSets([[p], [y]], p, y).agg(F.count("*").alias("n"))


@QUERIES.add("e7_failed_checks", "SELECT CASE WHEN toxic = 1 AND quality = 0 THEN 'both' WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'quality' ELSE 'none' END AS failed, count(*) AS n FROM labels GROUP BY 1")
def e7(t):
    bad, low = F.col("toxic") == 1, F.col("quality") == 0
    return t("labels").groupBy(F.when(bad & low, "both").when(bad, "toxic").when(low, "quality").otherwise("none").alias("failed")).agg(F.count("*").alias("n"))


E5 = """WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), r AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS i, count(*) OVER () AS k FROM c)
SELECT count(*) AS n, min(n) AS min, CAST(sum(CAST(n AS DECIMAL(18,4))) / count(*) AS DOUBLE) AS mean, min(n) FILTER (WHERE i = CAST(round_even((k - 1) * 0.9, 0) AS BIGINT)) AS p90, max(n) AS max FROM r"""


@QUERIES.add("e5_behaviour", f"SELECT n, min, round(mean, 4) AS mean, p90, max FROM ({E5})")
def e5(t):
    from waymill.operators.runs import nearest_rank

    c = t("events").groupBy("user_id").agg(F.count("*").alias("steps"))
    return nearest_rank(c, "steps", {"p90": 0.9}).withColumn("mean", F.round("mean", 4))
