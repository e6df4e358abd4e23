"""Fine-tuning rows from conversations, and table checks."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from waymill.operators import rows
from waymill.plans.base import Queries
from waymill.sources import records

QUERIES = Queries()


@QUERIES.add("d2_exclusion_waterfall", "SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'unaudited' WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'low_quality' ELSE 'kept' END AS reason FROM documents LEFT JOIN labels l USING (doc_id)")
def d2(t):
    j = t("documents").select("doc_id").join(t("labels").withColumn("seen", F.lit(True)), "doc_id", "left")
    return j.select("doc_id", F.when(F.col("seen").isNull(), "unaudited").when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low_quality").otherwise("kept").alias("reason"))


@QUERIES.add("d3_duplicate_keys", "SELECT md5(text) AS h, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def d3(t):
    return t("documents").groupBy(F.md5("text").alias("h")).agg(F.count("*").alias("n")).filter("n > 1")


@QUERIES.add("d6_loss_mask", "SELECT conv_id, string_agg(CASE WHEN role = 'assistant' AND length(text) > 40 THEN '1' ELSE '0' END, '' ORDER BY turn, role, text) AS mask, count(*) FILTER (WHERE role = 'assistant' AND length(text) <= 40) AS n_masked FROM conversations GROUP BY conv_id")
def d6(t):
    bit = F.when((F.col("role") == "assistant") & (F.char_length("text") > 40), "1").otherwise("0")
    g = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", bit.alias("bit")))).alias("a"), F.count(F.when((F.col("role") == "assistant") & (F.char_length("text") <= 40), 1)).alias("n_masked"))
    return g.select("conv_id", F.array_join(F.transform("a", lambda x: x["bit"]), "").alias("mask"), "n_masked")


@QUERIES.add("d7_message_assembly", "SELECT conv_id, sha256(string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text)) AS messages_hash, count(*) AS n_messages FROM conversations GROUP BY conv_id")
def d7(t):
    g = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("a"))
    return g.select("conv_id", F.sha2(F.array_join(F.transform("a", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n"), 256).alias("messages_hash"), F.size("a").cast("long").alias("n_messages"))


@QUERIES.add("d9_sample_id", "SELECT DISTINCT conv_id, 'sft_' || substr(sha256('v1:' || CAST(conv_id AS VARCHAR)), 1, 24) AS sample_id FROM conversations")
def d9(t):
    return t("conversations").select("conv_id").distinct().withColumn("sample_id", F.concat(F.lit("sft_"), F.substring(F.sha2(F.concat(F.lit("v1:"), F.col("conv_id").cast("string")), 256), 1, 24)))


FAULTS = ["version", "no_messages", "thinking", "response_mode", "response_version", "protocols_mixed", "supervision_mode", "no_system", "boundaries", "user_format", "user_empty", "user_json", "mask", "mask_terminal", "mask_clean", "reasoning", "content_no_text", "not_one_call", "arguments_no_object", "tool_content_no_json", "delta_incomplete", "response_versions_mixed", "delta_leaks", "snapshot_leaks", "alternation", "nothing_visible", "mask_disagrees"]
D10 = f"""WITH u AS (SELECT conv_id, arg_min(text, (turn, role, text)) AS q, count(*) AS n FROM conversations GROUP BY conv_id) SELECT conv_id, CASE WHEN conv_id % 29 < {len(FAULTS)} THEN {FAULTS}[conv_id % 29 + 1] END AS fault FROM u"""


def faulty_rows(conversations):
    """A row of each conversation (its first text as the question, its other texts as what the assistant says), with one fault
    by the number of the conversation, or none."""
    g = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("a"))
    f = F.get(F.array(*map(F.lit, FAULTS)), (F.col("conv_id") % 29).cast("int"))
    is_ = lambda *x: F.coalesce(f.isin(*x), F.lit(False))
    empty = F.array().cast("array<struct<name:string,arguments:string>>")
    null = F.lit(None).cast("string")
    message = lambda role, content, reasoning=null, calls=empty: F.struct(F.lit(role).alias("role") if isinstance(role, str) else role.alias("role"), content.alias("content"), reasoning.alias("reasoning"), calls.alias("calls"))
    call = F.struct(F.lit("search").alias("name"), F.when(is_("arguments_no_object"), F.lit("[1]")).otherwise(F.lit('{"q": 1}')).alias("arguments"))
    calls = F.when(is_("not_one_call"), F.array(call, call)).otherwise(F.array(call))
    snapshot = is_("snapshot_leaks")
    body = F.when(is_("tool_content_no_json"), "no json").when(snapshot, '{"reward": 1, "info": {}}').when(is_("delta_incomplete"), '{"response_version": "r3"}')
    body = body.otherwise(F.concat(F.lit('{"response_version": "'), F.when(is_("response_versions_mixed"), "r2").otherwise("r3"), F.lit('", "valid_action": '), F.when(is_("mask_disagrees"), "false").otherwise("true"), F.lit(', "remaining_steps": 3, "tool_result": {}'), F.when(is_("delta_leaks"), ', "reward": 0}').otherwise("}")))
    says = lambda text: message("assistant", F.when(is_("content_no_text"), null).when(is_("nothing_visible"), F.lit(" ")).otherwise(text), F.when(is_("reasoning"), F.lit("hm")), calls)
    turns = F.flatten(F.transform(F.slice("a", 2, 1_000_000), lambda x: F.array(says(x["text"]), message(F.when(is_("alternation"), "user").otherwise("tool"), body))))
    question = F.when(is_("user_empty"), F.lit(" ")).when(is_("user_json"), F.lit('{"query": "x"}')).otherwise(F.get("a", F.lit(0))["text"])
    head = F.array(message(F.when(is_("no_system"), "user").otherwise("system"), F.lit("rules")), message(F.when(is_("boundaries"), "assistant").otherwise("user"), question))
    # one step more than the texts, so that every row has a tool's answer
    last = F.array(says(F.lit("first")), message(F.when(is_("alternation"), "user").otherwise("tool"), body), says(F.lit("done")))
    messages = F.concat(head, turns, last)
    n = F.size("a") + 1
    mask = F.when(is_("mask"), F.array(F.lit(True))).when(is_("mask_terminal"), F.concat(F.array_repeat(F.lit(True), n - 1), F.array(F.lit(False)))).when(is_("mask_clean"), F.concat(F.array(F.lit(False)), F.array_repeat(F.lit(True), n - 1))).otherwise(F.array_repeat(F.lit(True), n))
    pick = lambda code, bad, good: F.when(is_(code), bad).otherwise(good)
    return g.select(
        "conv_id", pick("version", "v9", "v3").alias("format_version"), pick("response_mode", "none", F.when(snapshot, "snapshot").otherwise("delta")).alias("tool_response_mode"), F.when(is_("response_version"), "r9").when(is_("protocols_mixed"), "r1").otherwise("r3").alias("response_version"),
        pick("supervision_mode", "other", F.when(snapshot, "action_selective").otherwise("react")).alias("supervision_mode"), pick("user_format", "json", "text").alias("user_content_format"), is_("thinking").alias("enable_thinking"), mask.alias("loss_mask"), F.array(F.lit("search")).alias("tools"), F.when(~is_("no_messages"), messages).alias("messages"),
    )


@QUERIES.add("d10_row_validator", D10)
def d10(t):
    return rows.first_fault(faulty_rows(t("conversations"))).select("conv_id", "fault")


@QUERIES.add("d13_dataset_report", "SELECT role, count(*) AS n, count(DISTINCT conv_id) AS n_samples, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY role")
def d13(t):
    return t("conversations").groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("n_samples"), F.sum(F.char_length("text")).alias("chars"))


@QUERIES.add("s3_union_splits", "WITH u AS (SELECT 'a' AS split, doc_id AS uid FROM documents UNION ALL SELECT 'b', doc_id FROM labels), r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY split) AS rn FROM (SELECT DISTINCT split, uid FROM u)) SELECT CASE WHEN rn > 1 THEN split || ':' || CAST(uid AS VARCHAR) ELSE CAST(uid AS VARCHAR) END AS uid, CAST(uid AS VARCHAR) AS source_uid FROM r")
def s3(t):
    u = t("documents").select(F.lit("a").alias("split"), F.col("doc_id").alias("uid")).unionByName(t("labels").select(F.lit("b").alias("split"), F.col("doc_id").alias("uid"))).distinct()
    rn = F.row_number().over(Window.partitionBy("uid").orderBy("split"))
    own = F.col("uid").cast("string")
    return u.withColumn("rn", rn).select(F.when(F.col("rn") > 1, F.concat("split", F.lit(":"), own)).otherwise(own).alias("uid"), own.alias("source_uid"))


@QUERIES.add("s5_snapshot_alignment", "SELECT count(*) FILTER (WHERE l.doc_id IS NULL) AS only_documents, count(*) FILTER (WHERE d.doc_id IS NULL) AS only_labels, count(*) FILTER (WHERE d.doc_id = l.doc_id) AS in_both FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id")
def s5(t):
    j = t("documents").select("doc_id", F.lit(1).alias("a")).join(t("labels").select("doc_id", F.lit(1).alias("b")), "doc_id", "full")
    n = lambda c: F.count(F.when(c, 1))
    return j.agg(n(F.col("b").isNull()).alias("only_documents"), n(F.col("a").isNull()).alias("only_labels"), n(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("in_both"))


@QUERIES.add("s9_pending", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem UNION SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def s9(t):
    o = t("orders")
    done = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey")).unionByName(o.filter("o_orderstatus = 'P'").select("o_orderkey"))
    return o.join(done, "o_orderkey", "left_anti").select("o_orderkey")


@QUERIES.add("s10_table_fingerprint")
def s10(t):
    return records.table_fingerprint(t("lineitem"))


@QUERIES.add("a13_question_uniqueness", "SELECT role, count(*) AS n, count(DISTINCT lower(trim(text))) AS n_distinct, min(conv_id) AS example FROM conversations GROUP BY role")
def a13(t):
    return t("conversations").groupBy("role").agg(F.count("*").alias("n"), F.countDistinct(F.lower(F.trim("text"))).alias("n_distinct"), F.min("conv_id").alias("example"))


@QUERIES.add("d12_length_audit", "SELECT conv_id, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(CASE WHEN role = 'assistant' THEN n ELSE 0 END) AS BIGINT) AS loss_tokens, sum(n) > 400 AS over_limit FROM (SELECT conv_id, role, len(regexp_extract_all(text, '[^ \\t\\n\\r]+')) AS n FROM conversations) GROUP BY conv_id")
def d12(t):
    n = F.size(F.regexp_extract_all("text", F.lit("([^ \\t\\n\\r]+)"))).cast("long")
    own = t("conversations").select("conv_id", "role", n.alias("n"))
    return own.groupBy("conv_id").agg(F.sum("n").alias("tokens"), F.sum(F.when(F.col("role") == "assistant", F.col("n")).otherwise(0)).alias("loss_tokens"), (F.sum("n") > 400).alias("over_limit"))
