"""Audit and split reports, sources, sinks and streams over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymill.functions.columns import money, normalize_question
from waymill.operators import reports
from waymill.operators.components import shared_folder
from waymill.plans.base import ROLLOUTS, STEPS, Queries, clock, rollouts, steps
from waymill.sources import jsonl, records
from waymill.streaming import rollouts as streams
from waymill.streaming.signals import signal_streaks

QUERIES = Queries()

TOOLS = {"view": "search_intercity_transport", "click": "search_nearby", "signup": "list_candidates", "purchase": "save_candidate", "error": "remove_candidate"}
A11 = f"""WITH {STEPS}, a AS (SELECT *, CAST(floor(value) AS BIGINT) * 15 % 1440 AS m, lag(event_type) OVER (PARTITION BY user_id ORDER BY step) AS last, max(CASE WHEN event_type = 'purchase' THEN 1 END) OVER (PARTITION BY user_id, event_id % 5 ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS saved FROM st),
b AS (SELECT user_id, unnest([CASE WHEN event_type = 'view' AND NOT (m % 60 = 0 AND m // 60 <= 21 AND m // 60 % 3 = 0) THEN 'coarse_time' END, CASE WHEN event_type = 'click' AND event_id % 6 = 5 THEN 'radius' END, CASE WHEN event_type = 'click' AND event_id % 4 = 0 THEN 'top_k' END,
 CASE WHEN event_type = 'error' AND saved IS NULL THEN 'removed_unsaved' END, CASE WHEN event_type = 'error' AND last IS DISTINCT FROM 'signup' THEN 'removed_unreviewed' END, CASE WHEN event_type = 'error' AND event_id % 2 = 1 THEN 'removed_without_price' END]) AS violation FROM a)
SELECT user_id AS task_id, violation, count(*) AS n FROM b WHERE violation IS NOT NULL GROUP BY ALL"""


@QUERIES.add("a11_action_rules", A11)
def a11(t):
    """Events as actions: their types are tools, their values times, their ids candidates, radii and numbers of results."""
    tool = F.create_map(*[F.lit(x) for p in TOOLS.items() for x in p])[F.col("event_type")]
    radius = F.get(F.array(*map(F.lit, (*reports.RADII, 7))), (F.col("event_id") % 6).cast("int"))
    e = steps(t("events")).select(
        F.col("user_id").alias("task_id"), "step", tool.alias("tool"), (F.col("event_id") % 5).alias("entity_id"), clock(F.floor("value") * 15 % 1440).alias("at_time"), radius.alias("radius"),
        F.when(F.col("event_id") % 4 == 0, 10).otherwise(40).alias("top_k"), F.when(F.col("event_id") % 2 == 0, "价格更低，移除").otherwise("移除").alias("content"),
    )
    return reports.action_violations(e)


X20 = """SELECT l_returnflag, l_linestatus, count(*) AS n, count(*) FILTER (WHERE l_returnflag <> 'N' AND l_extendedprice / l_quantity <> p_retailprice AND l_linestatus = 'O') AS n_compared FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2"""


@QUERIES.add("x20_price_contract", X20)
def x20(t):
    """Reasons written from line items: what is named (price or nothing), how it compares, and whether it goes."""
    j = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    text = F.concat(F.when(F.col("l_returnflag") == "N", "评分").when(F.col("l_returnflag") == "A", "标价").otherwise("人均"), unit.cast("string"), F.when(unit > F.col("p_retailprice"), "高于").when(unit < F.col("p_retailprice"), "更低").otherwise("等于"), F.when(F.col("l_linestatus") == "O", "移除").otherwise("保留"))
    return j.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.count(F.when(reports.price_comparison(text), 1)).alias("n_compared"))


FAMILIES = f"""WITH {STEPS}, g AS (SELECT user_id, arg_max(event_type, step) AS family, count(*) AS steps, arg_min(props, step) AS question, count(*) FILTER (WHERE event_type = 'error') AS warnings FROM st GROUP BY user_id)"""
RANK = "list_sort(list(steps))[CAST(round_even((count(*) - 1) * {q}, 0) AS BIGINT) + 1]"


def trajectories(t):
    g = steps(t("events")).groupBy(F.col("user_id").alias("task_id"))
    return g.agg(F.max_by("event_type", "step").alias("family"), F.count("*").alias("steps"), F.min_by("props", "step").alias("question"), F.count(F.when(F.col("event_type") == "error", 1)).alias("warnings"))


@QUERIES.add("a13_family_report", f"{FAMILIES} SELECT family, count(*) AS n, min(steps) AS min_steps, round(CAST(sum(steps) AS DOUBLE) / count(*), 4) AS mean_steps, {RANK.format(q=0.5)} AS p50, {RANK.format(q=0.9)} AS p90, max(steps) AS max_steps, round(count(DISTINCT question) / count(*), 6) AS unique_share, sum(warnings)::BIGINT AS warnings, min(user_id) AS example_id, arg_min(question, user_id) AS example FROM g GROUP BY family")
def a13(t):
    r = reports.family_report(trajectories(t))
    return r.select("family", "n", F.col("min").alias("min_steps"), F.round("mean", 4).alias("mean_steps"), "p50", "p90", F.col("max").alias("max_steps"), "unique_share", "warnings", F.col("example.task_id").alias("example_id"), F.col("example.question").alias("example"))


@QUERIES.add("e5_behaviour_shares", f"{FAMILIES} SELECT user_id % 3 AS model, count(*) AS n, round(count(*) FILTER (WHERE family = 'purchase') / count(*), 6) AS share_purchase, round(count(*) FILTER (WHERE family = 'error') / count(*), 6) AS share_error, round(count(*) FILTER (WHERE family = 'view') / count(*), 6) AS share_view, round(CAST(sum(steps) AS DOUBLE) / count(*), 4) AS mean, {RANK.format(q=0.9)} AS p90 FROM g GROUP BY 1")
def e5(t):
    return reports.behaviour_table(trajectories(t).select((F.col("task_id") % 3).alias("model"), "steps", F.col("family").alias("ended")), ["purchase", "error", "view"])


D13 = """WITH s AS (SELECT DISTINCT conv_id, CASE WHEN conv_id % 2 = 0 THEN 'even' ELSE 'odd' END AS mode FROM conversations)
SELECT 'mode' AS section, mode AS name, count(*) AS n, CAST(NULL AS BIGINT) AS supervised FROM s GROUP BY mode UNION ALL SELECT 'tool', role, count(*), count(*) FILTER (WHERE turn % 2 = 0) FROM conversations GROUP BY role UNION ALL SELECT 'total', 'samples', count(*), NULL FROM s UNION ALL SELECT 'total', 'calls', count(*), count(*) FILTER (WHERE turn % 2 = 0) FROM conversations"""


@QUERIES.add("d13_dataset_totals", D13)
def d13(t):
    c = t("conversations")
    mode = F.when(F.col("conv_id") % 2 == 0, "even").otherwise("odd")
    return reports.dataset_report(c.select(F.col("conv_id").alias("sample_id"), mode.alias("mode")).distinct(), c.select(F.col("conv_id").alias("sample_id"), F.col("role").alias("tool"), (F.col("turn") % 2 == 0).alias("supervised")))


G5 = """WITH w AS (SELECT doc_id, md5(text) AS h, CASE WHEN doc_id % 10 = 0 THEN 'holdout' WHEN doc_id % 97 <> 5 THEN 'train' END AS part FROM documents),
o AS (SELECT (SELECT count(*) FROM (SELECT 1 FROM w GROUP BY doc_id HAVING count(*) > 1)) AS a, (SELECT count(*) FROM (SELECT 1 FROM w GROUP BY h HAVING count(*) > 1)) AS b, 0 AS c, (SELECT count(*) FROM (SELECT 1 FROM w GROUP BY h HAVING count(DISTINCT part) > 1)) AS d, (SELECT count(*) FROM w WHERE part IS NULL) AS e)
SELECT unnest(['id', 'hash', 'id', 'hash', 'union', 'union', 'all']) AS gate_group, unnest(['repeated_id', 'repeated_hash', 'id_in_two_parts', 'hash_in_two_parts', 'in_no_part', 'not_in_the_whole', 'accepted']) AS gate, true AS hard, unnest([a, b, c, d, e, 0, CASE WHEN a + b + c + d + e = 0 THEN 1 ELSE 0 END])::DOUBLE AS value, unnest([0, 0, 0, 0, 0, 0, NULL])::DOUBLE AS bound, unnest([a = 0, b = 0, c = 0, d = 0, e = 0, true, a + b + c + d + e = 0]) AS passed FROM o"""


@QUERIES.add("g5_split_gates", G5)
def g5(t):
    """Documents split by id, with some in no part; copies of a text are one semantic hash."""
    w = t("documents").select("doc_id", F.md5("text").alias("h"), F.when(F.col("doc_id") % 10 == 0, "holdout").when(F.col("doc_id") % 97 != 5, "train").alias("part"))
    return reports.split_gates(w.drop("part"), w.filter("part is not null"), "doc_id", "h")


X17 = """WITH b AS (SELECT DISTINCT trim(text) AS x FROM benchmark), r AS (SELECT d.doc_id, md5(lower(regexp_replace(d.text, '[^\\p{L}\\p{N}]', '', 'g'))) AS q, quality, toxic = 1 AS toxic, d.lang, trim(d.text) IN (SELECT x FROM b) AS reused FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
o AS (SELECT count(*)::DOUBLE AS v0, count(*) FILTER (WHERE quality IS DISTINCT FROM 1)::DOUBLE AS v1, (count(doc_id) - count(DISTINCT doc_id))::DOUBLE AS v2, (count(q) - count(DISTINCT q))::DOUBLE AS v3, count(*) FILTER (WHERE reused)::DOUBLE AS v4, count(*) FILTER (WHERE toxic) / count(*) AS v5, count(*) FILTER (WHERE lang = 'en')::DOUBLE AS v6, count(*) FILTER (WHERE lang = 'fr')::DOUBLE AS v7 FROM r),
p AS (SELECT *, [v0 = 400, v1 = 0, v2 = 0, v3 = 0, v4 = 0, v5 <= 0.25, v6 = 200, v7 = 50] AS ok FROM o)
SELECT unnest(['count', 'reward', 'unique', 'unique', 'reuse', 'rate', 'quota', 'quota', 'all']) AS gate_group, unnest(['requested', 'not_rewarded', 'repeated_ids', 'repeated_questions', 'reused', 'toxic', 'lang:en', 'lang:fr', 'accepted']) AS gate, true AS hard, unnest([v0, v1, v2, v3, v4, v5, v6, v7, CASE WHEN list_bool_and(ok) THEN 1 ELSE 0 END]) AS value, unnest([400, 0, 0, 0, 0, 0.25, 200, 50, NULL])::DOUBLE AS bound, unnest(list_append(ok, list_bool_and(ok))) AS passed FROM p"""


@QUERIES.add("x17_alignment_table", X17)
def x17(t):
    """Labelled documents as a batch: quality is the reward, the text the question, a benchmark's text is reuse."""
    known = t("benchmark").select(F.trim("text").alias("x")).distinct().withColumn("reused", F.lit(True))
    d = t("documents").join(t("labels"), "doc_id").withColumn("x", F.trim("text")).join(known, "x", "left")
    r = d.select(F.col("doc_id").alias("record_id"), F.md5(normalize_question(F.col("text"))).alias("question"), F.col("quality").alias("reward"), F.coalesce("reused", F.lit(False)).alias("reused"), (F.col("toxic") == 1).alias("toxic"), "lang")
    return reports.alignment_gates(r, 400, {"lang": {"en": 200, "fr": 50}}, {"toxic": 0.25})


# ---- sources and sinks, written to the shared folder and read back


def folder(df, tag: str) -> str:
    return f"{shared_folder(df.sparkSession)}/waymill-{tag}-{uuid.uuid4().hex}"


S1 = """SELECT CASE WHEN event_id % 11 = 0 THEN 'not_an_object' WHEN event_id % 7 = 0 THEN 'missing_key' ELSE event_type END AS kind, count(*) AS n, coalesce(sum(event_id) FILTER (WHERE event_id % 11 <> 0 AND event_id % 7 <> 0), 0)::BIGINT AS ids FROM events WHERE event_id % 13 <> 0 GROUP BY 1"""


@QUERIES.add("s1_jsonl_scan", S1)
def s1(t):
    """Events as lines of JSON, some blank, some no object, some without their key: scanned strictly."""
    e = t("events")
    line = F.when(F.col("event_id") % 13 == 0, "  ").when(F.col("event_id") % 11 == 0, F.concat(F.lit("["), F.col("props"))).otherwise(F.to_json(F.struct(F.when(F.col("event_id") % 7 != 0, F.col("event_id")).alias("event_id"), "event_type", "value")))
    path = folder(e, "jsonl")
    e.select(line.alias("value")).write.text(path)
    good, bad = jsonl.read_jsonl(e.sparkSession, path, T.StructType.fromDDL("event_id long, event_type string, value double"), "event_id")
    rows = good.select(F.col("event_type").alias("kind"), "event_id").unionByName(bad.select(F.col("fault").alias("kind"), F.lit(None).cast("long").alias("event_id")))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.coalesce(F.sum("event_id"), F.lit(0)).alias("ids"))


@QUERIES.add("s2_csv_import", "SELECT c_custkey::VARCHAR AS uid, c_name AS name, c_nationkey AS days, CASE c_mktsegment WHEN 'BUILDING' THEN true WHEN 'MACHINERY' THEN false END AS flag, c_mktsegment AS first_tag, 3 AS n_tags, c_acctbal IS NOT NULL AS has_rule FROM customer")
def s2(t):
    """Customers as a CSV of tasks with flags and list literals, split into public and hidden columns, and joined again."""
    c = t("customer")
    path = folder(c, "csv")
    flag = F.when(F.col("c_mktsegment") == "BUILDING", "True").when(F.col("c_mktsegment") == "MACHINERY", "FALSE").otherwise("")
    tags = F.concat(F.lit("['"), "c_mktsegment", F.lit("', \"x\", 'y, z']"))
    c.select(F.col("c_custkey").alias("uid"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("days"), flag.alias("flag"), tags.alias("tags"), F.col("c_acctbal").cast("string").alias("rule")).write.option("escape", '"').csv(path, header=True)
    public, hidden = records.import_tasks(c.sparkSession, path, ["rule"], ints=["days"], flags=["flag"], lists=["tags"])
    return public.join(hidden, "uid").select("uid", "name", "days", "flag", F.get("tags", F.lit(0)).alias("first_tag"), F.size("tags").cast("long").alias("n_tags"), (F.col("rule") != "").alias("has_rule"))


S6 = """SELECT 'name' AS projection, count(*) AS n, sum(length(s_name))::BIGINT AS total FROM supplier UNION ALL SELECT 'debt', count(*), sum(-round(s_acctbal))::BIGINT FROM supplier WHERE s_acctbal < 0 UNION ALL SELECT 'parts', count(*), sum(l_partkey)::BIGINT FROM supplier JOIN (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) ON s_suppkey = l_suppkey"""


@QUERIES.add("s6_bundle_fan_out", S6)
def s6(t):
    """Suppliers as records with a list of parts: written as JSON, read with a schema, and fanned out into three tables."""
    parts = t("lineitem").groupBy(F.col("l_suppkey").alias("slot")).agg(F.collect_set("l_partkey").alias("parts"))
    rec = t("supplier").select(F.col("s_suppkey").alias("slot"), F.col("s_name").alias("name"), F.when(F.col("s_acctbal") < 0, -F.round("s_acctbal")).alias("debt")).join(parts, "slot", "left")
    path = folder(rec, "records")
    rec.write.json(path)
    held = rec.sparkSession.read.schema(rec.schema).json(path)
    out = records.fan_out(held, ["name"], ["debt"], ["parts"])
    value = {"name": F.length("name"), "debt": F.col("debt"), "parts": F.col("parts")}
    rows = [df.agg(F.count("*").alias("n"), F.sum(value[k]).cast("long").alias("total")).select(F.lit(k).alias("projection"), "n", "total") for k, df in out.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


S7 = """WITH d AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations) SELECT conv_id, count(*) AS n_messages, sum(length(text))::BIGINT AS n_chars, CASE WHEN conv_id % 5 = 0 THEN 0 ELSE count(*) FILTER (WHERE role = 'assistant') END AS n_mask FROM d GROUP BY conv_id"""


@QUERIES.add("s7_trainer_rows", S7)
def s7(t):
    """Conversations as rows for a trainer, messages as JSON text: written as Parquet and read back."""
    c = t("conversations").distinct()
    mask = F.when(F.first("conv_id") % 5 != 0, F.collect_list(F.when(F.col("role") == "assistant", 1)))
    samples = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages"), mask.alias("assistant_loss_mask"))
    path = folder(c, "trainer")
    records.sft_rows(samples, ["messages"]).write.parquet(path)
    back = c.sparkSession.read.parquet(path).withColumn("m", F.from_json("messages", "array<struct<role:string,content:string>>"))
    return back.select("conv_id", F.size("m").cast("long").alias("n_messages"), F.aggregate("m", F.lit(0).cast("long"), lambda s, x: s + F.length(x["content"])).alias("n_chars"), F.size("assistant_loss_mask").cast("long").alias("n_mask"))


S8 = """WITH p AS (SELECT o_custkey * 10 + o_orderkey % 10 AS uid, o_orderpriority AS query, count(*) OVER (PARTITION BY o_custkey * 10 + o_orderkey % 10) AS n FROM orders) SELECT uid, 'system,user' AS roles, query, c_mktsegment AS scenario_id FROM p LEFT JOIN customer ON uid = c_custkey * 10 AND c_nationkey <> 3 WHERE n = 1"""


@QUERIES.add("s8_prompt_rows", S8)
def s8(t):
    """Orders as prompts: customers' numbers with the last digit of the order; those that occur twice are rejected."""
    public = t("orders").select((F.col("o_custkey") * 10 + F.col("o_orderkey") % 10).alias("uid"), F.col("o_orderpriority").alias("query"))
    scenarios = t("customer").filter("c_nationkey <> 3").select((F.col("c_custkey") * 10).alias("uid"), F.col("c_mktsegment").alias("scenario_id"))
    rows, _ = records.prompt_rows(public, scenarios, "plan a trip", ["hard_logic"])
    path = folder(public, "prompts")
    rows.write.parquet(path)
    back = public.sparkSession.read.parquet(path)
    return back.select("uid", F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"), F.element_at("messages", 2)["content"].alias("query"), "scenario_id")


@QUERIES.add("s11_leak_guard", "SELECT 'value' AS denied_columns, count(*) AS n, count(*) FILTER (WHERE event_id % 3 = 0) AS leaks_props FROM events")
def s11(t):
    """Events against a deny list: one column of that name, and payloads with a hidden key."""
    e = t("events").withColumn("props", F.when(F.col("event_id") % 3 == 0, F.lit('{"hard_logic": 1, "k": 2}')).otherwise(F.col("props")))
    return jsonl.hidden_leaks(e, ["hard_logic", "VALUE"], ["props"]).select(F.array_join("denied_columns", ",").alias("denied_columns"), "n", "leaks_props")


S12 = f"""WITH {STEPS}, g AS (SELECT user_id, bool_or(event_type = 'error') AS e, count(*) FILTER (WHERE event_type = 'error') >= 12 AS r, arg_min(props, step) AS text FROM st GROUP BY user_id),
k AS (SELECT *, CASE WHEN r THEN 'repaired' WHEN e THEN 'had_invalid' ELSE 'clean' END AS kind FROM g)
SELECT kind, place, user_id, '# ' || user_id || chr(10) || text AS text FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY user_id) AS place FROM k) WHERE place <= 10"""


@QUERIES.add("s12_preview", S12)
def s12(t):
    g = steps(t("events")).groupBy("user_id").agg(F.bool_or(F.col("event_type") == "error").alias("had_invalid"), (F.count(F.when(F.col("event_type") == "error", 1)) >= 12).alias("repaired"), F.min_by("props", "step").alias("text"))
    return records.preview(g, "user_id").withColumn("place", F.col("place").cast("long"))


# ---- streams, run over all there is and then stopped


def streamed(df, rows, tag: str, mode: str = "append"):
    """The rows that a stream over df (written to the shared folder first) gives until it has read all."""
    spark, src = df.sparkSession, folder(df, f"{tag}-in")
    df.write.parquet(src)
    out, at = folder(df, f"{tag}-out"), folder(df, f"{tag}-checkpoint")
    stream = rows(spark.readStream.schema(df.schema).parquet(src))
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@QUERIES.add("m1_unseen_keys", "SELECT event_id FROM events")
def m1(t):
    """Every event once, though every fourth stands twice in the stream."""
    e = t("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return streamed(e.unionByName(e.filter("event_id % 4 = 0")), lambda s: streams.unseen(s, "event_id", "ts", "100 days"), "m1").select("event_id")


M2 = f"""WITH {ROLLOUTS}, o AS (SELECT user_id, grp, outcome, row_number() OVER (PARTITION BY user_id ORDER BY grp) AS rn, sum(CASE WHEN outcome = 'usable' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY grp) AS part FROM (SELECT user_id, grp, CASE WHEN outcome = 'usable' AND grp % 4 <> 0 THEN 'zero_variance' ELSE outcome END AS outcome FROM gc)),
s AS (SELECT *, count(*) FILTER (WHERE outcome = 'zero_variance') OVER w AS streak, list(grp) FILTER (WHERE outcome = 'zero_variance') OVER w AS held FROM o WINDOW w AS (PARTITION BY user_id, part ORDER BY grp))
SELECT user_id AS run, grp, outcome, streak, streak >= 3 AS stop, array_to_string(coalesce(held, [])[greatest(1, streak - 2):], ',') AS history FROM s"""


@QUERIES.add("m2_streak_history", M2)
def m2(t):
    """Rollout groups as a stream: the streak without a signal, and the last three groups of it."""
    from waymill.operators.rollouts import classify

    g = classify(rollouts(t("events")), ["user_id", "grp"])
    outcome = F.when((F.col("outcome") == "usable") & (F.col("grp") % 4 != 0), "zero_variance").otherwise(F.col("outcome"))
    groups = g.select(F.col("user_id").alias("run"), "grp", outcome.alias("outcome"), F.lit(0.5).alias("reward"))
    spark, key = groups.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    had = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = streamed(groups, lambda s: signal_streaks(s, threshold=3), "m2")
    finally:
        spark.conf.set(key, had) if had else spark.conf.unset(key)
    return out.select("run", "grp", "outcome", "streak", "stop", F.array_join(F.transform("history", lambda h: h["grp"].cast("string")), ",").alias("history"))


@QUERIES.add("m3_outcome_counts", "SELECT event_type, count(*) AS n, count(DISTINCT CAST(ts AS DATE)) AS n_days FROM events GROUP BY event_type")
def m3(t):
    """Counts of each outcome by day of event time, from a stream, summed up."""
    e = t("events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    last = e.agg(F.max("ts")).first()[0]
    late = e.sparkSession.createDataFrame([(last, "_end")], "ts timestamp, event_type string").withColumn("ts", F.col("ts") + F.expr("interval 30 days"))  # closes all days
    by_day = streamed(e.unionByName(late), lambda s: streams.outcome_counts(s, "ts", "event_type", "1 day", "0 seconds"), "m3")
    return by_day.filter("event_type <> '_end'").groupBy("event_type").agg(F.sum("n").alias("n"), F.count("*").alias("n_days"))


@QUERIES.add("m4_validated_ingest", "SELECT CASE WHEN value < 20 THEN 'too_small' END AS fault, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 1")
def m4(t):
    """Events as a stream that is validated and written to two tables, good rows and rejects."""
    e = t("events").select("event_id", "value")
    src, good, bad, at = (folder(e, f"m4-{x}") for x in ("in", "good", "bad", "checkpoint"))
    e.write.parquet(src)
    spark = e.sparkSession
    streams.ingest(spark.readStream.schema(e.schema).parquet(src), F.when(F.col("value") < 20, "too_small"), good, bad, at, {"availableNow": True}).awaitTermination()
    both = spark.read.parquet(good).select(F.lit(None).cast("string").alias("fault"), "value").unionByName(spark.read.parquet(bad).select("fault", "value"))
    return both.groupBy("fault").agg(F.count("*").alias("n"), F.sum(money(F.col("value"))).cast("double").alias("total"))
