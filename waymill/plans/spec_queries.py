"""Task specifications over orders and line items."""

from pyspark.sql import functions as F

from waymill.operators import specs
from waymill.plans.base import Queries

QUERIES = Queries()
LIST = "[" + ", ".join(f"'{k}'" for k in [*specs.KINDS, "weather"]) + "]"
OPS = ["lte", "gte", "eq", "contains", "include", "exclude", "not_in", "not_contains"]
SCOPE = [*specs.SCOPES, "planet"]
KEYS = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def constraints(t):
    """Line items as constraints: kind, operator and scope from their keys, amounts from the quantity."""
    pick = lambda xs, c: F.get(F.array(*map(F.lit, xs)), (F.col(c) % len(xs)).cast("int"))
    q = F.col("l_quantity").cast("int").cast("string")
    value = F.when(F.col("l_partkey") % 12 == 8, F.concat(F.lit('{"leg":"return","field":"end_time","time":"'), F.format_string("%02d:00", F.col("l_quantity").cast("int")), F.lit('"}'))).otherwise(
        F.concat(F.lit('{"amount":'), q, F.lit(',"count":'), q, F.lit(',"room_type":0,"values":["a"],"names":[],"any_of":'), F.when(F.col("l_quantity") > 25, '[["b"]]').otherwise("null"), F.lit(',"modes":["taxi"," "]}')))
    c = F.struct(*KEYS, F.col("l_partkey").cast("string").alias("id"), pick([*specs.KINDS, "weather"], "l_partkey").alias("kind"), pick(OPS, "l_suppkey").alias("operator"), value.alias("value"), pick(SCOPE, "l_linenumber").alias("scope"), F.when(F.col("l_returnflag") == "N", "hard").otherwise("soft").alias("hardness"))
    return t("lineitem").groupBy(F.col("l_orderkey").alias("spec_id")).agg(F.array_sort(F.collect_list(c)).alias("constraints"))


ALLOWED = " ".join(f"WHEN '{k}' THEN [{', '.join(repr(o) for o in ops)}]" for k, ops in specs.KINDS.items())
T1 = f"""WITH c AS (SELECT l_orderkey AS spec_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(KEYS)}) - 1 AS pos, CAST(l_partkey AS VARCHAR) AS constraint_id, {LIST}[l_partkey % 12 + 1] AS kind, {OPS}[l_suppkey % 8 + 1] AS op, {SCOPE}[l_linenumber % 9 + 1] AS scope, l_quantity AS q FROM lineitem),
f AS (SELECT *, CASE kind WHEN 'weather' THEN 'unknown_kind' ELSE NULL END AS e0, NOT list_contains(CASE kind {ALLOWED} ELSE [] END, op) AS e1, scope = 'planet' AS e2,
 CASE WHEN kind IN ('activity_count', 'category_budget', 'room_count', 'total_budget') THEN q > 0 WHEN kind = 'room_type' THEN false WHEN kind IN ('entity_attribute', 'entity_category') THEN true WHEN kind IN ('exclude_entity', 'include_entity', 'transport_mode') THEN q > 25 ELSE q < 24 END AS shaped,
 row_number() OVER (PARTITION BY spec_id, constraint_id ORDER BY pos) > 1 AS again FROM c)
SELECT spec_id, pos, constraint_id, CASE WHEN e0 IS NOT NULL THEN e0 WHEN e1 THEN 'operator_not_allowed' WHEN e2 THEN 'unknown_scope' WHEN NOT shaped THEN 'bad_value' WHEN again THEN 'repeated_id' END AS error FROM f"""


@QUERIES.add("t1_constraint_validation", T1)
def t1(t):
    return specs.validate_constraints(constraints(t))


@QUERIES.add("t3_semantic_hash", "SELECT l_orderkey, sha256(string_agg(h, ',' ORDER BY h) || '|' || string_agg(DISTINCT g, ',' ORDER BY g)) AS semantic_hash FROM (SELECT l_orderkey, sha256(CAST(l_partkey AS VARCHAR)) AS h, sha256(l_returnflag) AS g FROM lineitem) GROUP BY l_orderkey")
def t3(t):
    g = t("lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_partkey").cast("string")).alias("a"), F.collect_set("l_returnflag").alias("b"))
    return g.select("l_orderkey", specs.semantic_hash(F.col("a"), F.col("b")).alias("semantic_hash"))


T4 = """WITH a AS (SELECT DISTINCT l_orderkey AS spec_id, l_partkey AS k FROM lineitem WHERE l_discount < 0.09), b AS (SELECT DISTINCT l_orderkey AS spec_id, l_partkey AS k FROM lineitem WHERE l_discount > 0.01)
SELECT spec_id, count(*) AS n, count(*) FILTER (WHERE kb IS NULL) AS n_missing, count(*) FILTER (WHERE ka IS NULL) AS n_extra, CASE WHEN count(*) FILTER (WHERE ka IS NULL OR kb IS NULL) = 0 THEN 'complete' ELSE 'incomplete' END AS status
FROM (SELECT coalesce(a.spec_id, b.spec_id) AS spec_id, a.k AS ka, b.k AS kb FROM a FULL JOIN b ON a.spec_id = b.spec_id AND a.k = b.k) GROUP BY spec_id"""


@QUERIES.add("t4_materialize_spec", T4)
def t4(t):
    li = t("lineitem").select(F.col("l_orderkey").alias("spec_id"), F.col("l_partkey").alias("constraint_id"), "l_discount")
    return specs.materialize(li.filter("l_discount < 0.09"), li.filter("l_discount > 0.01"))


def rule_text():
    """Orders as rule texts of six forms."""
    n = F.col("o_custkey").cast("string")
    forms = [F.concat(F.lit("total_cost <= people_number * "), n), F.concat(F.lit("total_cost<="), n, F.lit(".5")), F.concat(F.lit("food_cost/food_count/people_count(plan) <= "), n), F.concat(F.lit("hotel_cost/people_count(plan)/(day_count(plan)-1)<="), n), F.concat(F.lit("result=("), F.get(F.array(*map(F.lit, ("go_start_time", "go_end_time", "return_start_time", "back_end_time"))), (F.col("o_custkey") % 4).cast("int")), F.when(F.col("o_custkey") % 3 == 0, " >= '").otherwise("<='"), F.format_string("%02d:30", (F.col("o_custkey") % 24).cast("int")), F.lit("')")), F.concat(F.lit("other "), n)]
    return F.get(F.array(*forms), (F.col("o_orderkey") % 6).cast("int"))


T5 = """SELECT o_orderkey, ['per_person_budget', 'total_budget', 'food_budget', 'hotel_budget', 'time_window', 'quarantine'][o_orderkey % 6 + 1] AS form, ['total_budget', 'total_budget', 'category_budget', 'category_budget', 'time_window', NULL][o_orderkey % 6 + 1] AS kind, ['trip', 'trip', 'restaurant', 'accommodation', 'intercity_transport', NULL][o_orderkey % 6 + 1] AS scope,
CASE o_orderkey % 6 WHEN 4 THEN CASE WHEN o_custkey % 3 = 0 THEN 'gte' ELSE 'lte' END WHEN 5 THEN NULL ELSE 'lte' END AS operator, CASE o_orderkey % 6 WHEN 1 THEN o_custkey || '.5' WHEN 4 THEN lpad(CAST(o_custkey % 24 AS VARCHAR), 2, '0') || ':30' WHEN 5 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS value,
['per_person', NULL, 'per_person_per_activity', 'per_person_per_night', NULL, NULL][o_orderkey % 6 + 1] AS basis, CASE WHEN o_orderkey % 6 = 4 THEN CASE WHEN o_custkey % 4 < 2 THEN 'outbound' ELSE 'return' END END AS leg, CASE WHEN o_orderkey % 6 = 4 THEN CASE WHEN o_custkey % 2 = 0 THEN 'start_time' ELSE 'end_time' END END AS field FROM orders"""


@QUERIES.add("t5_rule_mining", T5)
def t5(t):
    return t("orders").select("o_orderkey", specs.mine_constraints(rule_text()).alias("m")).select("o_orderkey", "m.*")


T6 = """SELECT doc_id, CASE WHEN v IS NULL THEN NULL ELSE trim(list_extract(string_split_regex(substr(text, 1, strpos(text, v) - 1), '[.,;]'), -1) || list_extract(string_split_regex(substr(text, strpos(text, v)), '[.,;]'), 1)) END AS clause
FROM (SELECT doc_id, text, CASE WHEN contains(text, 'people') THEN 'people' WHEN contains(text, 'nous') THEN 'nous' WHEN contains(text, 'und') THEN 'und' WHEN contains(text, 'a') THEN 'a' END AS v FROM documents)"""


@QUERIES.add("t6_source_clause", T6)
def t6(t):
    return t("documents").select("doc_id", specs.source_clause(F.col("text"), ["a", "und", "nous", "people"], ".,;").alias("clause"))


T9 = """SELECT o_orderkey AS spec_id, CASE o_orderstatus WHEN 'F' THEN 'Plan: ' WHEN 'O' THEN 'Please plan ' ELSE 'We need ' END || string_agg(c, '; ' ORDER BY ord, c) || CASE o_orderstatus WHEN 'F' THEN '.' WHEN 'O' THEN ', thanks.' ELSE '!' END AS query
FROM (SELECT l_orderkey, l_linenumber AS ord, 'part ' || l_partkey AS c FROM lineitem) JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus"""


@QUERIES.add("t9_template_rendering", T9)
def t9(t):
    li = t("lineitem").select(F.col("l_orderkey").alias("spec_id"), F.col("l_linenumber").alias("ord"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("clause"))
    templates = li.sparkSession.createDataFrame([("F", "Plan: ", "."), ("O", "Please plan ", ", thanks."), ("P", "We need ", "!")], "style string, opening string, closing string")
    return specs.render(li.join(t("orders").select(F.col("o_orderkey").alias("spec_id"), F.col("o_orderstatus").alias("style")), "spec_id"), templates)


T10 = """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'rejected' WHEN o_orderkey % 3 = 0 THEN 'stored' WHEN o_orderkey % 6 <> 5 THEN 'mined' ELSE 'base' END AS origin FROM orders"""


@QUERIES.add("t10_spec_precedence", T10)
def t10(t):
    """A stored spec (every third order; the even ones carry a stale hash), else what the rule text yields, else the base."""
    o = t("orders").select("o_orderkey", rule_text().alias("rule"))
    stored = t("orders").filter("o_orderkey % 3 = 0").select("o_orderkey", F.col("o_custkey").cast("string").alias("body"), F.sha2(F.concat(F.col("o_custkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, "x").otherwise("")), 256).alias("h"))
    kind = specs.mine_constraints(F.col("rule"))["form"]
    origin = F.when(F.col("h").isNotNull(), F.when(F.sha2("body", 256) == F.col("h"), "stored").otherwise("rejected")).when(kind != "quarantine", "mined").otherwise("base")
    return o.join(stored, "o_orderkey", "left").select("o_orderkey", origin.alias("origin"))
