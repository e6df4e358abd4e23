"""Rollout-group analytics over events."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from waymill.operators import rollouts as ops
from waymill.operators import runs
from waymill.plans.base import ROLLOUTS, Queries, rollouts

QUERIES = Queries()
GROUP = ["user_id", "grp"]


@QUERIES.add("r1_group_classification", f"WITH {ROLLOUTS} SELECT user_id, grp, n, max_reward, min_reward, round(mean_reward, 6) AS mean_reward, any_overflow, any_invalid, n_pass, outcome, CASE WHEN outcome = 'zero_variance' THEN first_reward END AS shared_reward FROM gc")
def r1(t):
    return ops.classify(rollouts(t("events")), GROUP).withColumn("mean_reward", F.round("mean_reward", 6))


@QUERIES.add("r2_policy_metrics", f"WITH {ROLLOUTS} SELECT count(*) AS groups, round(sum(n_pass) / sum(n), 6) AS avg_at_n, round(count(*) FILTER (WHERE n_pass > 0) / count(*), 6) AS pass_at_n, round(count(*) FILTER (WHERE n_pass = 0) / count(*), 6) AS unsolved, round(count(*) FILTER (WHERE n_pass BETWEEN 1 AND 7) / count(*), 6) AS frontier, round(count(*) FILTER (WHERE n_pass = 8) / count(*), 6) AS mastered FROM gc WHERE n = 8")
def r2(t):
    m = ops.policy_metrics(ops.classify(rollouts(t("events")), GROUP))
    return m.select("groups", *[F.round(c, 6).alias(c) for c in m.columns[1:]])


@QUERIES.add("r3_sampler_metrics", f"WITH {ROLLOUTS} SELECT outcome, count(*) AS n_groups, CAST(sum(n) AS BIGINT) AS n_rollouts FROM gc GROUP BY outcome")
def r3(t):
    return ops.classify(rollouts(t("events")), GROUP).groupBy("outcome").agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_rollouts"))


@QUERIES.add("r4_component_means", f"WITH {ROLLOUTS} SELECT event_type, count(*) AS n, CAST(sum(CASE WHEN reward_valid THEN CAST(reward AS DECIMAL(18,4)) END) AS DOUBLE) / count(*) FILTER (WHERE reward_valid) AS mean_valid_reward FROM ro GROUP BY event_type")
def r4(t):
    total = F.sum(F.when(F.col("reward_valid"), F.col("reward").cast("decimal(18,4)"))).cast("double")  # a decimal mean would be cut at eight places
    return rollouts(t("events")).groupBy("event_type").agg(F.count("*").alias("n"), F.try_divide(total, F.count_if("reward_valid")).alias("mean_valid_reward"))


R5 = f"""WITH {ROLLOUTS}, o AS (SELECT user_id, grp, CASE WHEN n <> 8 OR any_overflow THEN 'invalid' WHEN any_invalid THEN 'usable' ELSE 'zero_variance' END AS outcome FROM gr),
p AS (SELECT *, sum(CASE WHEN outcome = 'usable' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY grp ROWS UNBOUNDED PRECEDING) AS part FROM o)
SELECT user_id, grp, outcome, CAST(sum(CASE WHEN outcome = 'zero_variance' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, part ORDER BY grp ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM p"""


@QUERIES.add("r5_no_signal_streak", R5)
def r5(t):
    g = ops.classify(rollouts(t("events")), GROUP)
    # stand-in outcomes: groups with an error count as usable, those without as zero variance, so that streaks occur
    o = g.select("user_id", "grp", F.when((F.col("n") != 8) | F.col("any_overflow"), "invalid").when(F.col("any_invalid"), "usable").otherwise("zero_variance").alias("outcome"))
    return runs.streaks(o, "user_id", ["grp"], "outcome", "zero_variance", "usable")


@QUERIES.add("r6_overflow_diagnostics", f"WITH {ROLLOUTS} SELECT count(DISTINCT (user_id, grp)) AS n_groups, count(*) AS n_rollouts, max(value) AS max_value FROM ro WHERE overflow")
def r6(t):
    return rollouts(t("events")).filter("overflow").agg(F.countDistinct("user_id", "grp").alias("n_groups"), F.count("*").alias("n_rollouts"), F.max("value").alias("max_value"))


R7 = """WITH s AS (SELECT user_id, event_type <> 'error' AS valid, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events),
i AS (SELECT *, step - row_number() OVER (PARTITION BY user_id, valid ORDER BY step) AS isl FROM s),
l AS (SELECT user_id, valid, isl, min(step) AS first_step, count(*) AS length FROM i GROUP BY ALL)
SELECT user_id, string_agg((CASE WHEN valid THEN '1' ELSE '0' END) || 'x' || length, ' ' ORDER BY first_step) AS mask_runs FROM l GROUP BY user_id"""


@QUERIES.add("r7_mask_run_lengths", R7)
def r7(t):
    i = runs.islands(t("events").withColumn("valid", F.col("event_type") != "error"), "user_id", ["ts", "event_id"], "valid")
    text = F.concat(F.when(F.col("valid"), "1").otherwise("0"), F.lit("x"), F.col("length").cast("string"))
    return i.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("first_step", text.alias("s")))).alias("a")).select("user_id", F.array_join(F.transform("a", lambda x: x["s"]), " ").alias("mask_runs"))


@QUERIES.add("r8_response_budget", "SELECT doc_id, least(4096, 32768 - n_chars) AS budget, n_chars > 32768 AS overflow FROM documents")
def r8(t):
    return t("documents").select("doc_id", F.least(F.lit(4096).cast("long"), 32768 - F.col("n_chars")).alias("budget"), (F.col("n_chars") > 32768).alias("overflow"))


@QUERIES.add("r9_group_advantage", f"WITH {ROLLOUTS} SELECT user_id, grp, rollout, round(reward - avg(reward) OVER (PARTITION BY user_id, grp), 6) + 0.0 AS advantage FROM ro")
def r9(t):
    return ops.advantages(rollouts(t("events")), GROUP).select("user_id", "grp", "rollout", (F.round("advantage", 6) + F.lit(0.0)).alias("advantage"))


@QUERIES.add("r10_variance_diagnostics", f"WITH {ROLLOUTS} SELECT user_id, grp, count(DISTINCT reward) AS n_rewards, round(var_pop(reward), 8) AS reward_variance FROM ro GROUP BY user_id, grp")
def r10(t):
    return rollouts(t("events")).groupBy(*GROUP).agg(F.countDistinct("reward").alias("n_rewards"), F.round(F.var_pop("reward"), 8).alias("reward_variance"))
