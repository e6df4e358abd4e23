"""Alternatives of planned places, grounded paging, and the logic and repair of task texts."""

from pyspark.sql import functions as F

from waymill.operators import comparisons, texts
from waymill.plans.base import Queries

QUERIES = Queries()

A19 = """WITH c AS (SELECT o_orderkey, o_orderstatus = 'F' AND o_custkey % 10 = 0 AS named, CASE o_orderpriority WHEN '1-URGENT' THEN 'search_nearby' ELSE 'search_attractions' END AS tool, count(*) AS planned, count(*) FILTER (WHERE l_discount > 0.05) AS visible,
 coalesce(max(l_linenumber) FILTER (WHERE l_returnflag <> 'A' AND l_linestatus = 'O'), 0) AS required, count(*) FILTER (WHERE l_linestatus = 'F') AS resolved FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2, 3)
SELECT o_orderkey, CAST(required AS BIGINT) AS required, named OR (tool <> 'search_nearby' AND ((planned > 1 AND visible BETWEEN 1 AND planned - 1) OR (required > 1 AND resolved BETWEEN 1 AND required - 1))) AS grounded FROM c"""


@QUERIES.add("a19_pagination_grounding", A19)
def a19(t):
    """Line items as constraints: of attractions if open, with an operator by their flag."""
    scope = F.when(F.col("l_linestatus") == "O", "attraction").otherwise("hotel")
    operator = F.when(F.col("l_returnflag") == "A", "lte").when(F.col("l_returnflag") == "N", "eq").otherwise("gte")
    one = F.struct(F.lit("activity_count").alias("kind"), scope.alias("scope"), operator.alias("operator"), F.col("l_linenumber").alias("count"))
    n = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(one).alias("constraints"), F.count("*").alias("planned"), F.count_if(F.col("l_discount") > 0.05).alias("visible"), F.count_if(F.col("l_linestatus") == "F").alias("resolved"))
    named = (F.col("o_orderstatus") == "F") & (F.col("o_custkey") % 10 == 0)
    tool = F.when(F.col("o_orderpriority") == "1-URGENT", "search_nearby").otherwise("search_attractions")
    o = t("orders").select("o_orderkey", named.alias("named"), tool.alias("tool")).join(n, "o_orderkey").withColumn("required", comparisons.required_count(F.col("constraints")))
    return o.select("o_orderkey", "required", comparisons.pagination_grounded(*map(F.col, ("named", "tool", "planned", "visible", "required", "resolved"))).alias("grounded"))


W24 = """WITH it AS (SELECT DISTINCT l_orderkey AS plan_id, l_partkey AS candidate_id FROM lineitem), li AS (SELECT DISTINCT l_orderkey AS plan_id, 920.0 + l_orderkey % 80 AS max_price FROM lineitem WHERE l_orderkey % 2 = 0),
q AS (SELECT i.plan_id, i.candidate_id, b.p_partkey AS alternative_id, b.p_retailprice AS alternative_price FROM it i JOIN part a ON a.p_partkey = i.candidate_id JOIN part b ON b.p_type = a.p_type AND b.p_brand = a.p_brand AND b.p_retailprice > a.p_retailprice
 ANTI JOIN it p ON p.plan_id = i.plan_id AND p.candidate_id = b.p_partkey LEFT JOIN li ON li.plan_id = i.plan_id WHERE max_price IS NULL OR b.p_retailprice <= max_price)
SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY plan_id, candidate_id ORDER BY alternative_price, alternative_id) = 1"""


@QUERIES.add("w24_candidate_comparison", W24)
def w24(t):
    """Parts as places of a type and (their brand) a city; plans with an even key have a limit."""
    items = t("lineitem").select(F.col("l_orderkey").alias("plan_id"), F.col("l_partkey").alias("candidate_id"))
    places = t("part").select(F.col("p_partkey").alias("candidate_id"), F.col("p_type").alias("entity_type"), F.col("p_brand").alias("city"), F.col("p_retailprice").alias("price"))
    limits = items.filter("plan_id % 2 = 0").join(places, "candidate_id").select("plan_id", "entity_type", (F.lit(920.0) + F.col("plan_id") % 80).alias("max_price"))
    return comparisons.comparable_alternatives(items, places, limits)


WORDS = {"or": [" or ", " oder ", " ou ", " o "], "or_anywhere": ["either"], "and": [" and ", " und ", " et ", " y ", ","], "and_anywhere": ["both", "each"]}
OR, AND = (lambda b: f"regexp_matches({b}, ' or | oder | ou | o ')"), (lambda b: f"regexp_matches({b}, ' and | und | et | y |,')")
X7_AND = " AND ".join(f"NOT {OR(b)} AND ({AND(b)} OR regexp_matches(text, 'both|each'))" for b in ("b1", "b2"))
X7_OR = " AND ".join(f"NOT {AND(b)} AND ({OR(b)} OR contains(text, 'either'))" for b in ("b1", "b2"))
X7 = f"""WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '[a-z]{{4,}}') AS w FROM documents WHERE text IS NOT NULL),
o AS (SELECT doc_id, text, list_sort([{{'p': strpos(text, w[1]), 'o': w[1]}}, {{'p': strpos(text, w[3]), 'o': w[3]}}, {{'p': strpos(text, w[6]), 'o': w[6]}}]) AS s FROM w WHERE len(w) >= 6),
b AS (SELECT doc_id, text, substr(text, s[1].p + length(s[1].o), greatest(0, s[2].p - s[1].p - length(s[1].o))) AS b1, substr(text, s[2].p + length(s[2].o), greatest(0, s[3].p - s[2].p - length(s[2].o))) AS b2 FROM o)
SELECT doc_id, CASE WHEN {X7_AND} THEN 'ok' ELSE 'changed' END AS conjunction, CASE WHEN {X7_OR} THEN 'ok' ELSE 'changed' END AS disjunction FROM b"""


@QUERIES.add("x7_logic_shape", X7)
def x7(t):
    """The first, third and sixth longer words of a document as operands."""
    d = t("documents").filter("text is not null").select("doc_id", "text", F.regexp_extract_all("text", F.lit("([a-z]{4,})")).alias("w")).filter(F.size("w") >= 6)
    operands = F.array(*[F.get("w", F.lit(i)) for i in (0, 2, 5)])
    return d.select("doc_id", texts.logic_shape(F.col("text"), operands, "and", WORDS).alias("conjunction"), texts.logic_shape(F.col("text"), operands, "or", WORDS).alias("disjunction"))


SPANS = {"a": (20, 26), "b": (40, 45), "c": (60, 66)}
X21_WIDE = ", ".join(f"{s} - length(regexp_extract(substr(text, 1, {s}), '[^,.;!?:\\n]*$')) AS {k}_from, {e} + length(regexp_extract(substr(text, {e} + 1), '^[^,.;!?:\\n]*')) AS {k}_to" for k, (s, e) in SPANS.items())
X21_SHARED = ", ".join(f"({' OR '.join(f'({s} < {k}_to AND {e} > {k}_from)' for o, (s, e) in SPANS.items() if o != k)}) AS {k}_shared" for k in "ab")
X21_FINAL = ", ".join(f"CASE WHEN {k}_shared THEN {SPANS[k][0]} ELSE {k}_from END AS {k}_from, CASE WHEN {k}_shared THEN {SPANS[k][1]} ELSE {k}_to END AS {k}_to" for k in "ab")
X21 = f"""WITH w AS (SELECT doc_id, text, {X21_WIDE} FROM documents WHERE length(text) >= 80), x AS (SELECT *, {X21_SHARED} FROM w), f AS (SELECT doc_id, text, {X21_FINAL} FROM x),
r AS (SELECT doc_id, substr(text, 1, a_from) || 'first clause' || substr(text, a_to + 1, b_from - a_to) || 'second clause' || substr(text, b_to + 1) AS text FROM f) SELECT doc_id, md5(text) AS repaired_md5, length(text) AS n_chars, false AS conflict FROM r"""


@QUERIES.add("x21_span_repair", X21)
def x21(t):
    """Two of three mentions of each document get a new clause; a stretch that both would replace stays between them, as in the SQL."""
    mentions = F.array(*[F.struct(F.lit(k).alias("id"), F.lit(s).alias("start"), F.lit(e).alias("end")) for k, (s, e) in SPANS.items()])
    clauses = F.create_map(F.lit("a"), F.lit("first clause"), F.lit("b"), F.lit("second clause"))
    d = t("documents").filter(F.char_length("text") >= 80).select("doc_id", texts.patch_clauses(F.col("text"), mentions, clauses, ",.;!?:\n", keep_shared=True).alias("r"))
    return d.select("doc_id", F.md5("r.text").alias("repaired_md5"), F.char_length("r.text").cast("long").alias("n_chars"), F.col("r.conflict").alias("conflict"))
