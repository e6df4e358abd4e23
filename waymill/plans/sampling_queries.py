"""Quotas and splits."""

from pyspark.sql import functions as F

from waymill.functions.columns import stable_rank
from waymill.operators import sampling
from waymill.plans.base import Queries

QUERIES = Queries()


def quota_sql(src, cols, total, seed):
    key = " || chr(31) || ".join(f"CAST({c} AS VARCHAR)" for c in cols)
    c = ", ".join(cols)
    return f"""c AS (SELECT {c}, count(*) AS n FROM {src} GROUP BY {c}), s AS (SELECT sum(n)::BIGINT AS tot FROM c),
f AS (SELECT c.*, (n * {total}) // tot AS fl, (n * {total}) % tot AS rest, sha256('{seed}' || chr(31) || {key}) AS tie FROM c, s),
q AS (SELECT {c}, n, CAST(fl + CASE WHEN row_number() OVER (ORDER BY rest DESC, tie) <= {total} - (SELECT sum(fl) FROM f) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM f)"""


@QUERIES.add("g1_largest_remainder", f"WITH {quota_sql('customer', ['c_mktsegment'], 137, 'g1')} SELECT * FROM q")
def g1(t):
    return sampling.largest_remainder(t("customer").groupBy("c_mktsegment").agg(F.count("*").alias("n")), ["c_mktsegment"], 137, "g1")


G2 = f"""WITH {quota_sql('documents', ['lang', 'source'], 100, 'g2')}, r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY sha256('g2' || chr(31) || CAST(doc_id AS VARCHAR)), doc_id) AS rk FROM documents)
SELECT doc_id, lang, source, CASE WHEN rk <= quota THEN 'holdout' ELSE 'train' END AS split FROM r JOIN q USING (lang, source)"""


@QUERIES.add("g2_stratified_split", G2)
def g2(t):
    return sampling.stratified_split(t("documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id", 100, "g2")


G3 = f"""WITH {quota_sql('orders', ['o_orderstatus'], 211, 'g3')},
c2 AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n2 FROM orders GROUP BY ALL),
f2 AS (SELECT c2.*, q.quota AS total, (n2 * q.quota) // q.n AS fl2, (n2 * q.quota) % q.n AS rest2, sha256('g3b' || chr(31) || c2.o_orderstatus || chr(31) || c2.o_orderpriority) AS tie2 FROM c2 JOIN q USING (o_orderstatus))
SELECT o_orderstatus, o_orderpriority, n2 AS n, total, CAST(fl2 + CASE WHEN row_number() OVER (PARTITION BY o_orderstatus ORDER BY rest2 DESC, tie2) <= total - sum(fl2) OVER (PARTITION BY o_orderstatus) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM f2"""


@QUERIES.add("g3_hierarchical_quotas", G3)
def g3(t):
    o = t("orders")
    top = sampling.largest_remainder(o.groupBy("o_orderstatus").agg(F.count("*").alias("n")), ["o_orderstatus"], 211, "g3").select("o_orderstatus", F.col("quota").alias("total"))
    low = o.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")).join(top, "o_orderstatus")
    return sampling.largest_remainder(low, ["o_orderstatus", "o_orderpriority"], 0, "g3b", within=["o_orderstatus"])


G4 = f"""WITH {quota_sql('customer', ['c_nationkey'], 90, 'g4')}, r AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256('g4' || chr(31) || CAST(c_custkey AS VARCHAR)), c_custkey) AS rk FROM customer)
SELECT c_custkey, c_nationkey FROM r JOIN q USING (c_nationkey) WHERE rk <= quota"""


@QUERIES.add("g4_stable_cohort", G4)
def g4(t):
    return sampling.stratified_split(t("customer").select("c_custkey", "c_nationkey"), ["c_nationkey"], "c_custkey", 90, "g4").filter("split = 'holdout'").drop("split")


@QUERIES.add("g5_split_leakage", "WITH h AS (SELECT * FROM documents WHERE doc_id % 10 = 0), t AS (SELECT * FROM documents WHERE doc_id % 10 <> 0) SELECT (SELECT count(*) FROM h) AS n_holdout, (SELECT count(*) FROM t) AS n_train, (SELECT count(*) FROM h WHERE md5(text) IN (SELECT md5(text) FROM t)) AS n_leaked")
def g5(t):
    d = t("documents").select("doc_id", F.md5("text").alias("h"))
    held, train = d.filter("doc_id % 10 = 0"), d.filter("doc_id % 10 <> 0")
    leaked = held.join(train.select("h"), "h", "left_semi").agg(F.count("*").alias("n_leaked"))
    return d.agg(F.count(F.when(F.col("doc_id") % 10 == 0, 1)).alias("n_holdout"), F.count(F.when(F.col("doc_id") % 10 != 0, 1)).alias("n_train")).crossJoin(leaked)


@QUERIES.add("g6_split_distribution", "SELECT 'lang' AS field, lang AS value, doc_id % 10 = 0 AS holdout, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT 'source', source, doc_id % 10 = 0, count(*) FROM documents GROUP BY ALL")
def g6(t):
    d = t("documents").select((F.col("doc_id") % 10 == 0).alias("holdout"), "lang", "source")
    return d.unpivot("holdout", ["lang", "source"], "field", "value").groupBy("field", "value", "holdout").agg(F.count("*").alias("n"))


@QUERIES.add("g7_stratum_metadata", "SELECT n_name, o_orderpriority, count(*) AS n_items FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def g7(t):
    """Items are counted by order before anything is joined."""
    items = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    o, c, n = t("orders"), t("customer"), t("nation")
    j = items.join(o, "o_orderkey").join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.groupBy("n_name", "o_orderpriority").agg(F.sum("n").alias("n_items"))


@QUERIES.add("stable_rank_order", "SELECT c_custkey, sha256('s' || chr(31) || CAST(c_custkey AS VARCHAR)) AS rank_hash FROM customer")
def rank(t):
    return t("customer").select("c_custkey", stable_rank("s", F.col("c_custkey")).alias("rank_hash"))


SEG = "q(v, quota) AS (SELECT o, quota FROM (SELECT o_orderpriority AS o, count(*) AS n FROM orders GROUP BY 1), LATERAL (SELECT (n * (SELECT count(*) FROM customer)) // (SELECT count(*) FROM orders) AS quota)), bo AS (SELECT v, sum(quota) OVER (ORDER BY v) AS hi, quota FROM q)"
G8 = f"""WITH {SEG}, r AS (SELECT c_custkey, row_number() OVER (ORDER BY sha256('g8' || chr(31) || CAST(c_custkey AS VARCHAR))) AS rk FROM customer)
SELECT c_custkey, v AS priority FROM r LEFT JOIN bo ON rk > hi - quota AND rk <= hi"""


def priority_quotas(t):
    """Counts of priorities among orders, scaled to the number of customers and rounded down."""
    o, c = t("orders"), t("customer").agg(F.count("*").alias("n_slots"))
    n = o.groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))
    total = o.agg(F.count("*").alias("total"))
    return n.crossJoin(F.broadcast(c)).crossJoin(F.broadcast(total)).select("priority", F.floor(F.col("n") * F.col("n_slots") / F.col("total")).alias("quota"))


@QUERIES.add("g8_exact_columns", G8)
def g8(t):
    return sampling.exact_column(t("customer").select("c_custkey"), priority_quotas(t), "priority", "c_custkey", "g8")


@QUERIES.add("g9_blended_prior", "WITH w AS (SELECT c_mktsegment, count(*) AS weight FROM customer GROUP BY 1), n AS (SELECT count(*) AS k, sum(weight) AS s FROM w) SELECT c_mktsegment, weight, round(0.65 * weight / s + 0.35 / k, 8) AS prior, 103 // k + CASE WHEN row_number() OVER (ORDER BY sha256('g9' || chr(31) || c_mktsegment)) <= 103 % k THEN 1 ELSE 0 END AS quota FROM w, n")
def g9(t):
    w = t("customer").groupBy("c_mktsegment").agg(F.count("*").alias("weight"))
    return sampling.balanced_repetitions(sampling.blended_prior(w), "c_mktsegment", 103, "g9").withColumn("prior", F.round("prior", 8))


@QUERIES.add("g10_balanced_assignment", "SELECT c_custkey, c_nationkey, ['north', 'south', 'east'][(row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256('g10' || chr(31) || CAST(c_custkey AS VARCHAR))) - 1) % 3 + 1] AS origin FROM customer")
def g10(t):
    return sampling.round_robin(t("customer").select("c_custkey", "c_nationkey"), ["c_nationkey"], "c_custkey", ["north", "south", "east"], "g10", "origin")


@QUERIES.add("g11_quota_drift", f"WITH {SEG}, n AS (SELECT o_orderpriority AS v, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT coalesce(q.v, n.v) AS priority, coalesce(quota, 0) AS quota, coalesce(n, 0) AS n, coalesce(n, 0) - coalesce(quota, 0) AS drift FROM q FULL JOIN n ON q.v = n.v")
def g11(t):
    return sampling.quota_drift(t("orders").filter("o_orderstatus = 'F'").select(F.col("o_orderpriority").alias("priority")), priority_quotas(t), "priority")


G12 = """WITH h AS (SELECT p_partkey, p_brand, p_size, sha256('g12' || chr(31) || CAST(p_partkey AS VARCHAR)) AS h, p_brand < 'Brand#2' AND p_size > 25 AS bad, p_brand >= 'Brand#2' AND p_size <= 25 AS gives FROM part),
a AS (SELECT p_partkey, p_size, row_number() OVER (ORDER BY h) AS k FROM h WHERE bad), b AS (SELECT p_partkey, p_size, row_number() OVER (ORDER BY h) AS k FROM h WHERE gives),
s AS (SELECT a.p_partkey AS key, b.p_size AS new FROM a JOIN b USING (k) UNION ALL SELECT b.p_partkey, a.p_size FROM a JOIN b USING (k))
SELECT p_partkey, p_brand, coalesce(new, p_size) AS p_size FROM part LEFT JOIN s ON p_partkey = key"""


@QUERIES.add("g12_compatibility_swaps", G12)
def g12(t):
    low = F.col("p_brand") < "Brand#2"
    return sampling.swap_violators(t("part").select("p_partkey", "p_brand", "p_size"), "p_partkey", "p_size", low & (F.col("p_size") > 25), ~low & (F.col("p_size") <= 25), "g12")
