"""Trajectory audits over events (a user's events are a trajectory, the event type is the tool)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from waymill.operators import runs
from waymill.plans.base import STEPS, Queries, steps

QUERIES = Queries()
KEY, ORDER, TOOL = "user_id", ["ts", "event_id"], "event_type"


def by_step():
    return Window.partitionBy("user_id").orderBy("step")


@QUERIES.add("a1_tool_coverage", "SELECT event_type, count(*) AS n_calls, count(*) FILTER (WHERE value > 10) AS n_supervised, count(DISTINCT user_id) AS n_samples, count(DISTINCT CASE WHEN value > 10 THEN user_id END) AS n_supervised_samples FROM events GROUP BY event_type")
def a1(t):
    keep = F.col("value") > 10
    return t("events").groupBy(TOOL).agg(F.count("*").alias("n_calls"), F.count(F.when(keep, 1)).alias("n_supervised"), F.countDistinct(KEY).alias("n_samples"), F.countDistinct(F.when(keep, F.col(KEY))).alias("n_supervised_samples"))


A2 = """WITH d(tool) AS (VALUES ('signup'), ('error'), ('click'), ('view'), ('purchase'), ('refund')), s AS (SELECT count(DISTINCT user_id) AS n FROM events),
c AS (SELECT event_type AS tool, count(DISTINCT user_id) AS n_samples FROM events GROUP BY 1)
SELECT tool, coalesce(n_samples, 0) AS n_samples, CAST(ceil(s.n / 10) AS BIGINT) AS needed, greatest(0, CAST(ceil(s.n / 10) AS BIGINT) - coalesce(n_samples, 0)) AS shortfall FROM d LEFT JOIN c USING (tool), s"""


@QUERIES.add("a2_coverage_shortfall", A2)
def a2(t):
    e = t("events")
    declared = e.sparkSession.createDataFrame([(x,) for x in ("signup", "error", "click", "view", "purchase", "refund")], "tool string")
    have = e.groupBy(F.col(TOOL).alias("tool")).agg(F.countDistinct(KEY).alias("n_samples"))
    total = e.agg(F.ceil(F.countDistinct(KEY) / 10).alias("needed"))
    n = F.coalesce("n_samples", F.lit(0))
    return declared.join(have, "tool", "left").crossJoin(F.broadcast(total)).select("tool", n.alias("n_samples"), "needed", F.greatest(F.lit(0), F.col("needed") - n).alias("shortfall"))


A3 = """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT count(DISTINCT user_id) AS n FROM events)
SELECT event_type, CAST(sum(c.n) AS BIGINT) AS n_calls, count(*) AS n_samples, round(count(*) / any_value(s.n), 6) AS sample_rate, max(c.n) AS max_in_sample FROM c, s GROUP BY event_type"""


@QUERIES.add("a3_action_statistics", A3)
def a3(t):
    e = t("events")
    total = e.agg(F.countDistinct(KEY).alias("total"))
    c = e.groupBy(KEY, TOOL).agg(F.count("*").alias("n")).groupBy(TOOL).agg(F.sum("n").alias("n_calls"), F.count("*").alias("n_samples"), F.max("n").alias("max_in_sample"))
    return c.crossJoin(F.broadcast(total)).select(TOOL, "n_calls", "n_samples", F.round(F.col("n_samples") / F.col("total"), 6).alias("sample_rate"), "max_in_sample")


@QUERIES.add("a4_identical_repeats", "SELECT user_id, CAST(sum(n - 1) AS BIGINT) AS repeats, max(n) AS most FROM (SELECT user_id, event_type, props, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def a4(t):
    return t("events").groupBy(KEY, TOOL, "props").agg(F.count("*").alias("n")).groupBy(KEY).agg(F.sum(F.col("n") - 1).alias("repeats"), F.max("n").alias("most"))


A5 = f"""WITH {STEPS}, i AS (SELECT user_id, event_type, step - row_number() OVER (PARTITION BY user_id, event_type ORDER BY step) AS isl FROM st),
l AS (SELECT user_id, event_type, isl, count(*) AS n FROM i GROUP BY ALL) SELECT user_id, event_type, max(n) AS longest_run, max(n) <= 3 AS within_limit FROM l GROUP BY user_id, event_type"""


@QUERIES.add("a5_longest_run", A5)
def a5(t):
    return runs.longest_runs(t("events"), KEY, ORDER, TOOL).withColumn("within_limit", F.col("longest_run") <= 3)


def rank_sql(src, value, key, qs):
    at = ", ".join(f"min(v) FILTER (WHERE i = CAST(round_even((n - 1) * {q}, 0) AS BIGINT)) AS {name}" for name, q in qs.items())
    return f"WITH r AS (SELECT {key} AS k, {value} AS v, row_number() OVER (PARTITION BY {key} ORDER BY {value}) - 1 AS i, count(*) OVER (PARTITION BY {key}) AS n FROM {src}) SELECT k AS {key}, count(*) AS n, min(v) AS min, CAST(sum(CAST(v AS DECIMAL(18,4))) / count(*) AS DOUBLE) AS mean, {at}, max(v) AS max FROM r GROUP BY k"


QS = {"p20": 0.2, "p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


@QUERIES.add("a6_nearest_rank_distribution", "SELECT l_returnflag, n, min, round(mean, 4) AS mean, p20, p50, p90, p95, p99, max FROM (" + rank_sql("lineitem", "l_quantity", "l_returnflag", QS) + ")")
def a6(t):
    return runs.nearest_rank(t("lineitem"), "l_quantity", QS, ["l_returnflag"]).withColumn("mean", F.round("mean", 4))


@QUERIES.add("a7_policy_checks", f"WITH {STEPS} SELECT user_id, count(*) AS n_steps, count(*) <= 70 AS within_steps, count(*) FILTER (WHERE event_type = 'error') AS n_invalid, arg_max(event_type, step) AS termination, count(*) <= 70 AND count(*) FILTER (WHERE event_type = 'error') = 0 AS passed FROM st GROUP BY user_id")
def a7(t):
    g = steps(t("events")).groupBy(KEY).agg(F.count("*").alias("n_steps"), F.count(F.when(F.col(TOOL) == "error", 1)).alias("n_invalid"), F.max_by(TOOL, "step").alias("termination"))
    return g.select(KEY, "n_steps", (F.col("n_steps") <= 70).alias("within_steps"), "n_invalid", "termination", ((F.col("n_steps") <= 70) & (F.col("n_invalid") == 0)).alias("passed"))


@QUERIES.add("a8_tool_surface", "SELECT tools, count(*) AS n_trajectories FROM (SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS tools FROM events GROUP BY user_id) GROUP BY tools")
def a8(t):
    return t("events").groupBy(KEY).agg(F.array_join(F.array_sort(F.collect_set(TOOL)), ",").alias("tools")).groupBy("tools").agg(F.count("*").alias("n_trajectories"))


A9 = f"""WITH {STEPS}, f AS (SELECT user_id, props, min(step) AS first_seen FROM st WHERE event_type = 'view' GROUP BY ALL)
SELECT st.event_type, count(*) AS n_uses, count(*) FILTER (WHERE first_seen < step) AS n_grounded FROM st LEFT JOIN f USING (user_id, props) WHERE st.event_type <> 'view' GROUP BY st.event_type"""


@QUERIES.add("a9_causal_grounding", A9)
def a9(t):
    s = steps(t("events"))
    seen = s.filter("event_type = 'view'").groupBy(KEY, "props").agg(F.min("step").alias("first_seen"))
    return s.filter("event_type <> 'view'").join(seen, [KEY, "props"], "left").groupBy(TOOL).agg(F.count("*").alias("n_uses"), F.count(F.when(F.col("first_seen") < F.col("step"), 1)).alias("n_grounded"))


@QUERIES.add("a10_consume_next", f"WITH {STEPS}, n AS (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY step) AS nxt FROM st) SELECT user_id, count(*) AS n_views, count(*) FILTER (WHERE nxt = 'click') AS n_consumed FROM n WHERE event_type = 'view' GROUP BY user_id")
def a10(t):
    s = steps(t("events")).withColumn("nxt", F.lead(TOOL).over(by_step())).filter("event_type = 'view'")
    return s.groupBy(KEY).agg(F.count("*").alias("n_views"), F.count(F.when(F.col("nxt") == "click", 1)).alias("n_consumed"))


@QUERIES.add("a11_removal_follows_review", f"WITH {STEPS}, n AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY step) AS prv FROM st) SELECT user_id, event_id, coalesce(prv = 'click', false) AS follows_review FROM n WHERE event_type = 'purchase'")
def a11(t):
    s = steps(t("events")).withColumn("prv", F.lag(TOOL).over(by_step())).filter("event_type = 'purchase'")
    return s.select(KEY, "event_id", F.coalesce(F.col("prv") == "click", F.lit(False)).alias("follows_review"))


A17 = f"""WITH {STEPS}, g AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type <> 'error') AS valid, arg_max(event_type, step) AS reason FROM st GROUP BY user_id)
SELECT reason, count(*) AS n_trajectories, CAST(sum(n) AS BIGINT) AS n_steps, CAST(sum(valid) AS BIGINT) AS n_valid, count(*) FILTER (WHERE n >= 70) AS n_reached_limit, max(n) AS most_steps FROM g GROUP BY reason"""


@QUERIES.add("a17_batch_summary", A17)
def a17(t):
    g = steps(t("events")).groupBy(KEY).agg(F.count("*").alias("n"), F.count(F.when(F.col(TOOL) != "error", 1)).alias("valid"), F.max_by(TOOL, "step").alias("reason"))
    return g.groupBy("reason").agg(F.count("*").alias("n_trajectories"), F.sum("n").alias("n_steps"), F.sum("valid").alias("n_valid"), F.count(F.when(F.col("n") >= 70, 1)).alias("n_reached_limit"), F.max("n").alias("most_steps"))


A18 = """WITH a AS (SELECT event_type, count(*) AS n FROM events WHERE user_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type, count(*) AS n FROM events WHERE user_id % 2 = 1 AND event_type <> 'signup' GROUP BY 1)
SELECT event_type, coalesce(a.n, 0) AS n_left, coalesce(b.n, 0) AS n_right FROM a FULL JOIN b USING (event_type)"""


@QUERIES.add("a18_cohort_comparison", A18)
def a18(t):
    e = t("events")
    a = e.filter("user_id % 2 = 0").groupBy(TOOL).agg(F.count("*").alias("a"))
    b = e.filter("user_id % 2 = 1 and event_type <> 'signup'").groupBy(TOOL).agg(F.count("*").alias("b"))
    return a.join(b, TOOL, "full").select(TOOL, F.coalesce("a", F.lit(0)).alias("n_left"), F.coalesce("b", F.lit(0)).alias("n_right"))


D5 = f"""WITH {STEPS}, n AS (SELECT *, last_value(CASE WHEN event_type <> 'error' THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_tool,
first_value(CASE WHEN event_type <> 'error' THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY step ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after_tool FROM st)
SELECT user_id, step, before_tool, after_tool FROM n WHERE event_type = 'error'"""


@QUERIES.add("d5_invalid_action_context", D5)
def d5(t):
    valid = F.when(F.col(TOOL) != "error", F.col(TOOL))
    s = steps(t("events")).withColumns({"before_tool": F.last(valid, True).over(by_step().rowsBetween(Window.unboundedPreceding, -1)), "after_tool": F.first(valid, True).over(by_step().rowsBetween(1, Window.unboundedFollowing))})
    return s.filter("event_type = 'error'").select(KEY, "step", "before_tool", "after_tool")


P6 = f"""WITH {STEPS}, v AS (SELECT *, last_value(CASE WHEN event_type <> 'error' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_end FROM st)
SELECT user_id, count(*) AS n, count(*) FILTER (WHERE prev_end IS NULL OR value >= prev_end) AS n_ordered FROM v GROUP BY user_id"""


@QUERIES.add("p6_chronology", P6)
def p6(t):
    prev = F.last(F.when(F.col(TOOL) != "error", F.col("value")), True).over(by_step().rowsBetween(Window.unboundedPreceding, -1))
    return steps(t("events")).withColumn("prev_end", prev).groupBy(KEY).agg(F.count("*").alias("n"), F.count(F.when(F.col("prev_end").isNull() | (F.col("value") >= F.col("prev_end")), 1)).alias("n_ordered"))
