"""The checks of plans over orders and line items."""

from pyspark.sql import functions as F

from waymill.operators import checks
from waymill.plans.base import PLANS, Queries, activities, clock, entities, plan_table

QUERIES = Queries()


def status_sql(body: str) -> str:
    """SQL of a check from its counts: unknown, bad, score."""
    return f"WITH {PLANS}, g AS ({body}) SELECT plan_id, CASE WHEN unknown > 0 THEN 'unverifiable' WHEN bad > 0 THEN 'fail' ELSE 'pass' END AS status, CASE WHEN unknown = 0 THEN round(score, 8) END AS score FROM g"


# the clock of an end reads 24:00 at most as 24:00; later ones are no times
P11 = status_sql("""SELECT plan_id, count(*) FILTER (WHERE u) AS unknown, count(*) FILTER (WHERE NOT u AND late) AS bad, 1 - count(*) FILTER (WHERE NOT u AND late) / count(*) AS score FROM (
 SELECT plan_id, entity_type IS NULL OR (NOT (activity_type = 'breakfast' AND entity_type = 'hotel') AND b > 1440) AS u, NOT (activity_type = 'breakfast' AND entity_type = 'hotel') AND o <= c AND (a < o OR b > c) AS late
 FROM act LEFT JOIN ent USING (candidate_id) WHERE activity_type IN ('attraction', 'breakfast', 'lunch', 'dinner')) GROUP BY plan_id""")


@QUERIES.add("p11_opening_hours", P11)
def p11(t):
    return checks.opening_hours(activities(t("lineitem")), entities(t("part")))


P14 = status_sql("""SELECT plan_id, CAST(sum(u) AS BIGINT) AS unknown, CAST(sum(odd + greatest(n - 1, 0)) AS BIGINT) AS bad, CASE WHEN sum(odd + greatest(n - 1, 0)) = 0 THEN 1.0 ELSE 0.0 END AS score FROM (
 SELECT plan_id, day, activity_type, count(*) FILTER (WHERE b > 1440) AS u, count(*) FILTER (WHERE b <= 1440 AND (a < lo OR b > hi OR (activity_type = 'breakfast' AND coalesce(entity_type, '') = 'hotel' AND NOT (unit_price = 0 AND amount = 0)))) AS odd, count(*) FILTER (WHERE b <= 1440) AS n
 FROM act LEFT JOIN ent USING (candidate_id) JOIN (VALUES ('breakfast', 360, 540), ('lunch', 660, 840), ('dinner', 1020, 1200)) m(activity_type, lo, hi) USING (activity_type) GROUP BY ALL) GROUP BY plan_id""")


@QUERIES.add("p14_meal_commonsense", P14)
def p14(t):
    return checks.meal_commonsense(activities(t("lineitem")), entities(t("part")))


P9 = status_sql("""SELECT plan_id, count(*) FILTER (WHERE dep IS NULL) AS unknown, count(*) FILTER (WHERE dep <> a) AS bad, 1 - count(*) FILTER (WHERE dep <> a) / count(*) AS score FROM (
 SELECT plan_id, a, (candidate_id * 7 + 120) % 1380 AS d0, CASE WHEN candidate_id IN (SELECT p_partkey FROM part WHERE p_size > 2) THEN d0 END AS dep FROM act WHERE activity_type = 'train') GROUP BY plan_id""")


@QUERIES.add("p9_intercity_time", P9)
def p9(t):
    departs = (F.col("p_partkey") * 7 + 120) % 1380
    return checks.intercity_time(activities(t("lineitem")), t("part").filter("p_size > 2").select(F.col("p_partkey").alias("candidate_id"), clock(departs).alias("departs"), clock(departs + 45).alias("arrives")))


P8 = f"""WITH {PLANS}, ok(activity_type, entity_type) AS (VALUES ('attraction', 'attraction'), ('breakfast', 'restaurant'), ('breakfast', 'hotel'), ('lunch', 'restaurant'), ('dinner', 'restaurant'), ('accommodation', 'hotel')),
g AS (SELECT plan_id, count(*) FILTER (WHERE j) AS n, count(*) FILTER (WHERE j AND entity_type IS NULL) AS u, count(*) FILTER (WHERE j AND entity_type IS NOT NULL AND NOT fits) AS bad FROM (
 SELECT plan_id, entity_type, activity_type IN (SELECT activity_type FROM ok) AS j, EXISTS (SELECT 1 FROM ok WHERE ok.activity_type = x.activity_type AND ok.entity_type = x.entity_type) AS fits FROM (SELECT * FROM act LEFT JOIN ent USING (candidate_id)) x) GROUP BY plan_id)
SELECT plan_id, CASE WHEN n = 0 THEN 'not_applicable' WHEN u > 0 THEN 'unverifiable' WHEN bad > 0 THEN 'fail' ELSE 'pass' END AS status, CASE WHEN n > 0 AND u = 0 THEN round(1 - bad / n, 8) END AS score FROM g"""
ALLOWED = [("attraction", "attraction"), ("breakfast", "restaurant"), ("breakfast", "hotel"), ("lunch", "restaurant"), ("dinner", "restaurant"), ("accommodation", "hotel")]


@QUERIES.add("p8_candidate_usage", P8)
def p8(t):
    allowed = t("part").sparkSession.createDataFrame(ALLOWED, "activity_type string, entity_type string")
    return checks.candidate_usage(activities(t("lineitem")), entities(t("part")), allowed)


P10 = status_sql("""SELECT plan_id, count(*) FILTER (WHERE f IS NULL OR g IS NULL) AS unknown, count(*) FILTER (WHERE f <> g AND coalesce(minutes > gap, true)) AS bad, 1 - count(*) FILTER (WHERE f <> g AND coalesce(minutes > gap, true)) / greatest(count(*) FILTER (WHERE f <> g), 1) AS score FROM (
 SELECT m.plan_id, m.gap, m.f, m.g, CASE WHEN m.f < m.g THEN 20 + m.f * 10 END AS minutes FROM (
  SELECT plan_id, lag(city) OVER w AS f, city AS g, a - lag(b) OVER w AS gap, row_number() OVER w AS rn FROM (SELECT act.*, city FROM act LEFT JOIN ent USING (candidate_id)) WINDOW w AS (PARTITION BY plan_id ORDER BY a, pos)) m WHERE rn > 1) GROUP BY plan_id""")


@QUERIES.add("p10_route_grounding", P10)
def p10(t):
    own = activities(t("lineitem")).join(entities(t("part")).select("candidate_id", "city"), "candidate_id", "left").withColumns({"place_from": F.col("city"), "place_to": F.col("city")})
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("f"), F.lit(b).alias("t"), F.lit(20 + a * 10).alias("m")) for a in range(3) for b in range(a + 1, 3)]))
    routes = t("orders").select(F.col("o_orderkey").alias("plan_id"), pairs.alias("r")).select("plan_id", F.col("r.f").alias("from_place"), F.col("r.t").alias("to_place"), F.col("r.m").alias("minutes"))
    return checks.route_grounding(own, routes)


P12 = f"""WITH {PLANS}, j AS (SELECT *, activity_type = 'train' AS moves, coalesce(origin_city = origin AND destination_city = destination, false) AS outw, coalesce(origin_city = destination AND destination_city = origin, false) AS back FROM act LEFT JOIN ent USING (candidate_id) JOIN pl USING (plan_id)),
g AS (SELECT plan_id, count(*) FILTER (WHERE entity_type IS NULL) AS u, CAST(bool_or(activity_type = 'attraction') AS INT) AS visit, CASE WHEN any_value(days) <= 1 THEN 1.0 ELSE least(count(*) FILTER (WHERE activity_type = 'accommodation') / (any_value(days) - 1), 1.0) END AS nights,
 CASE WHEN any_value(origin <> destination) THEN least((CAST(bool_or(moves AND outw) AS INT) + CAST(bool_or(moves AND back) AS INT)) / 2, (CAST(arg_min(outw, day * 1000 + pos) AS INT) + CAST(arg_max(back, day * 1000 + pos) AS INT)) / 2) ELSE 1.0 END AS journey,
 count(*) FILTER (WHERE NOT moves AND city = destination) / greatest(count(*) FILTER (WHERE NOT moves), 1) AS loc FROM j GROUP BY plan_id)
SELECT plan_id, CASE WHEN u > 0 THEN 'unverifiable' WHEN (visit + nights + journey + loc) / 4 = 1 THEN 'pass' ELSE 'fail' END AS status, CASE WHEN u = 0 THEN round((visit + nights + journey + loc) / 4, 8) END AS score FROM g"""


@QUERIES.add("p12_trip_coverage", P12)
def p12(t):
    return checks.trip_coverage(plan_table(t("orders")), activities(t("lineitem")), entities(t("part")))


P23 = f"""WITH {PLANS}, m AS (SELECT plan_id, list(DISTINCT activity_type) AS modes FROM act GROUP BY plan_id), r AS (SELECT plan_id, coalesce(modes, []) AS modes, [['lunch', 'dinner'], ['train']] AS any_of FROM pl LEFT JOIN m USING (plan_id)),
s AS (SELECT plan_id, list_transform(any_of, lambda g: len(list_intersect(modes, g))) AS k, len(modes) AS n FROM r)
SELECT plan_id, {{}} FROM s"""


@QUERIES.add("p23_transport_mode", P23.format("CASE WHEN k[1] = 2 OR k[2] = 1 THEN 'pass' ELSE 'fail' END AS status, round(greatest(k[1] / 2, k[2] / 1), 8) AS score"))
def p23(t, operator="include"):
    modes = activities(t("lineitem")).groupBy("plan_id").agg(F.collect_set("activity_type").alias("modes"))
    groups = F.array(F.array(F.lit("lunch"), F.lit("dinner")), F.array(F.lit("train")))
    return checks.mode_check(modes, plan_table(t("orders")).select("plan_id", groups.alias("any_of")), operator)


@QUERIES.add("p23_transport_mode_eq", P23.format("CASE WHEN (k[1] = 2 AND n = 2) OR (k[2] = 1 AND n = 1) THEN 'pass' ELSE 'fail' END AS status, round(greatest(k[1] / (2 + n - k[1]), k[2] / (1 + n - k[2])), 8) AS score"))
def p23_eq(t):
    return p23(t, "eq")


@QUERIES.add("p25_exclude_entity", "SELECT o_orderkey AS plan_id, CASE WHEN bad IS NULL THEN 'pass' ELSE 'fail' END AS status, CASE WHEN bad IS NULL THEN 1.0 ELSE 0.0 END AS score FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS bad FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand IN ('Brand#11', 'Brand#22')) ON o_orderkey = bad")
def p25(t):
    used = t("lineitem").join(t("part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("plan_id"), F.col("p_brand").alias("name"))
    return checks.entity_presence(used, plan_table(t("orders")).select("plan_id", F.array(F.array(F.lit("Brand#11")), F.array(F.lit("Brand#22"))).alias("any_of")), "exclude")


def check_rows(t):
    """Line items as rows of checks: one of the registered checks by part, a status by supplier."""
    ids = F.array(*[F.lit(r[0]) for r in checks.REGISTRY])
    status = F.get(F.array(*map(F.lit, checks.STATUSES)), (F.col("l_suppkey") % 5).cast("int"))
    c = F.get(ids, (F.col("l_partkey") % 15).cast("int"))
    own = t("lineitem").select(F.col("l_orderkey").alias("plan_id"), c.alias("check_id"), status.alias("status"), F.col("l_discount").alias("score")).groupBy("plan_id", "check_id").agg(F.min("status").alias("status"), F.min("score").alias("score"))
    return own.withColumns({"dimension": checks.owner(F.col("check_id")), "source": F.lit("environment"), "hardness": F.lit("hard"), "affects_success": F.lit(True), "shaping": F.lit(True)})


CHECKS = f"""reg(k, check_id, dimension, grp) AS (VALUES {", ".join(f"({k}, '{c}', '{d}', '{g}')" for k, (c, d, g) in enumerate(checks.REGISTRY))}),
ch AS (SELECT l_orderkey AS plan_id, check_id, any_value(dimension) AS dimension, any_value(grp) AS grp, min(['pass', 'fail', 'unverifiable', 'blocked', 'not_applicable'][l_suppkey % 5 + 1]) AS status, min(l_discount) AS score FROM lineitem JOIN reg ON l_partkey % 15 = k GROUP BY l_orderkey, check_id)"""
P19 = f"""WITH {CHECKS}, d(check_id, ord, dep) AS (VALUES {", ".join(f"('{c}', {k}, '{d}')" for c, ds in checks.WAITS_FOR for k, d in enumerate(ds))}),
b AS (SELECT x.plan_id, x.check_id, arg_min(d.dep, d.ord) AS blocked_by FROM ch x JOIN d USING (check_id) JOIN ch y ON y.plan_id = x.plan_id AND y.check_id = d.dep AND y.status IN ('fail', 'blocked') WHERE x.status = 'unverifiable' GROUP BY ALL)
SELECT plan_id, check_id, CASE WHEN blocked_by IS NOT NULL THEN 'blocked' ELSE status END AS status, CASE WHEN blocked_by IS NULL THEN score END AS score, blocked_by FROM ch LEFT JOIN b USING (plan_id, check_id)"""


@QUERIES.add("p19_blocker_resolution", P19)
def p19(t):
    return checks.resolve_blockers(check_rows(t).select("plan_id", "check_id", "status", "score"))


P29 = f"WITH {CHECKS} SELECT plan_id, " + ", ".join(
    f"round(coalesce(CAST(avg(CAST(score AS DECIMAL(18,8))) FILTER (WHERE dimension = '{d}' AND status IN ('pass', 'fail')) AS DOUBLE), 0), 8) AS {d}, count(*) FILTER (WHERE dimension = '{d}' AND status IN ('pass', 'fail')) AS {d}_scored, count(*) FILTER (WHERE dimension = '{d}' AND status = 'blocked') AS {d}_blocked, count(*) FILTER (WHERE dimension = '{d}' AND status = 'not_applicable') AS {d}_not_applicable" for d in checks.DIMENSIONS) + " FROM ch GROUP BY plan_id"


@QUERIES.add("p29_dimension_scores", P29)
def p29(t):
    return checks.dimension_scores(check_rows(t))


@QUERIES.add("p30_group_results", f"WITH {CHECKS} SELECT plan_id, " + ", ".join(f"coalesce(bool_and(status = 'pass') FILTER (WHERE grp = '{g}'), true) AS {g}" for g in checks.GROUPS) + " FROM ch GROUP BY plan_id")
def p30(t):
    return checks.group_results(check_rows(t))


@QUERIES.add("p33_registry_integrity", f"WITH {CHECKS} SELECT CASE WHEN status NOT IN ('pass', 'fail') THEN 'score_without_verdict' ELSE 'other' END AS fault, count(*) AS n FROM ch WHERE status NOT IN ('pass', 'fail') GROUP BY 1")
def p33(t):
    return checks.registry_violations(check_rows(t).withColumn("blocked_by", F.when(F.col("status") == "blocked", "entity_grounding")))
