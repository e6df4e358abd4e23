"""Plan scoring: orders as plans, line items as activities and cost items."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from waymill.functions.columns import money, numeric_score
from waymill.operators import preferences
from waymill.plans.base import Queries

QUERIES = Queries()


@QUERIES.add("p4_no_plan", "SELECT o_orderkey, -1.0 AS reward, 'no_evaluable_plan' AS reason FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def p4(t):
    return t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", F.lit(-1.0).alias("reward"), F.lit("no_evaluable_plan").alias("reason"))


@QUERIES.add("p5_plan_structure", "SELECT l_orderkey, count(*) AS n, round((count(*) FILTER (WHERE l_quantity > 0 AND l_discount < 0.08) / count(*) + CASE WHEN min(l_linenumber) = 1 AND max(l_linenumber) = count(DISTINCT l_linenumber) THEN 1.0 ELSE 0.0 END) / 2, 6) AS score FROM lineitem GROUP BY l_orderkey")
def p5(t):
    fine = F.count(F.when((F.col("l_quantity") > 0) & (F.col("l_discount") < 0.08), 1)) / F.count("*")
    whole = (F.min("l_linenumber") == 1) & (F.max("l_linenumber") == F.countDistinct("l_linenumber"))
    return t("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round((fine + F.when(whole, 1.0).otherwise(0.0)) / 2, 6).alias("score"))


@QUERIES.add("p7_entity_grounding", "SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE p_partkey IS NULL) AS n_missing, round(1 - count(*) FILTER (WHERE p_partkey IS NULL) / count(*), 6) AS score FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 5) ON l_partkey = p_partkey GROUP BY l_orderkey")
def p7(t):
    known = t("part").filter("p_size > 5").select("p_partkey")
    j = t("lineitem").join(known, F.col("l_partkey") == F.col("p_partkey"), "left")
    missing = F.count(F.when(F.col("p_partkey").isNull(), 1))
    return j.groupBy("l_orderkey").agg(F.count("*").alias("n"), missing.alias("n_missing"), F.round(1 - missing / F.count("*"), 6).alias("score"))


@QUERIES.add("p13_entity_uniqueness", "SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def p13(t):
    return t("lineitem").groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("n")).filter("n > 1")


@QUERIES.add("p15_quantity_consistency", "SELECT l_orderkey, count(*) FILTER (WHERE l_quantity * 2 < 10) AS n_short, count(*) FILTER (WHERE l_quantity <> floor(l_quantity)) AS n_derived_wrong FROM lineitem GROUP BY l_orderkey")
def p15(t):
    return t("lineitem").groupBy("l_orderkey").agg(F.count(F.when(F.col("l_quantity") * 2 < 10, 1)).alias("n_short"), F.count(F.when(F.col("l_quantity") != F.floor("l_quantity"), 1)).alias("n_derived_wrong"))


@QUERIES.add("p16_cost_accounting", "WITH c AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS cost FROM lineitem GROUP BY 1) SELECT o_orderkey, CAST(cost AS DOUBLE) AS cost, coalesce(abs(CAST(o_totalprice AS DECIMAL(18,2)) - cost) <= 0.01, false) AS matches FROM orders LEFT JOIN c ON o_orderkey = l_orderkey")
def p16(t):
    c = t("lineitem").groupBy("l_orderkey").agg(F.sum(money(F.col("l_extendedprice"))).alias("cost"))
    j = t("orders").join(c, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return j.select("o_orderkey", F.col("cost").cast("double").alias("cost"), F.coalesce(F.abs(money(F.col("o_totalprice")) - F.col("cost")) <= 0.01, F.lit(False)).alias("matches"))


@QUERIES.add("p18_task_alignment", "SELECT o_orderkey, (CAST(o_orderstatus = 'F' AS INT) + CAST(c_mktsegment = 'BUILDING' AS INT) + CAST(o_orderpriority LIKE '1%' AS INT) + CAST(c_nationkey < 10 AS INT)) / 4 AS score FROM orders JOIN customer ON o_custkey = c_custkey")
def p18(t):
    o, c = t("orders"), t("customer")
    same = [F.col("o_orderstatus") == "F", F.col("c_mktsegment") == "BUILDING", F.col("o_orderpriority").like("1%"), F.col("c_nationkey") < 10]
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", (sum((x.cast("int") for x in same), F.lit(0)) / 4).alias("score"))


@QUERIES.add("p21_total_budget", "SELECT o_orderkey, o_totalprice <= 150000 AS passed, round(CASE WHEN o_totalprice <= 150000 THEN 1.0 ELSE 150000 / o_totalprice END, 6) AS score FROM orders")
def p21(t):
    return t("orders").select("o_orderkey", (F.col("o_totalprice") <= 150000).alias("passed"), F.round(numeric_score("lte", F.col("o_totalprice"), F.lit(150000.0)), 6).alias("score"))


@QUERIES.add("p22_category_budget", "SELECT l_orderkey, CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) END) AS DOUBLE) AS spent, count(*) FILTER (WHERE l_returnflag = 'R') AS n, count(*) FILTER (WHERE l_returnflag = 'R') > 0 AND sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) <= 40000 AS passed FROM lineitem GROUP BY l_orderkey")
def p22(t):
    own = F.col("l_returnflag") == "R"
    g = t("lineitem").groupBy("l_orderkey").agg(F.sum(F.when(own, money(F.col("l_extendedprice")))).alias("spent"), F.count(F.when(own, 1)).alias("n"))
    return g.select("l_orderkey", F.col("spent").cast("double").alias("spent"), "n", ((F.col("n") > 0) & (F.coalesce("spent", F.lit(0)) <= 40000)).alias("passed"))


@QUERIES.add("p24_entity_category", "SELECT p_partkey, contains(lower(p_type), 'promo') OR (contains(lower(p_type), 'small') AND contains(lower(p_name), 'e')) AS passed FROM part")
def p24(t):
    groups = [[("p_type", "promo")], [("p_type", "small"), ("p_name", "e")]]
    fits = F.lit(False)
    for g in groups:
        own = F.lit(True)
        for c, word in g:
            own = own & F.contains(F.lower(c), F.lit(word))
        fits = fits | own
    return t("part").select("p_partkey", fits.alias("passed"))


@QUERIES.add("p27_activity_count", "SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'N') AS n, count(*) FILTER (WHERE l_returnflag = 'N') >= 2 AS passed FROM lineitem GROUP BY l_orderkey")
def p27(t):
    n = F.count(F.when(F.col("l_returnflag") == "N", 1))
    return t("lineitem").groupBy("l_orderkey").agg(n.alias("n"), (n >= 2).alias("passed"))


P31 = """WITH c AS (SELECT l_orderkey, count(*) FILTER (WHERE l_quantity > 0 AND l_discount < 0.08) / count(*) AS a, CASE WHEN min(l_linenumber) = 1 THEN 1.0 ELSE 0.0 END AS v, count(*) FILTER (WHERE l_returnflag = 'N') / count(*) AS g FROM lineitem GROUP BY 1)
SELECT l_orderkey, round(CASE WHEN a = 1 AND v = 1 THEN 0.5 + 0.5 * g ELSE least(-1 + (a + v + g) / 3, -0.00000001) END, 8) AS reward, a = 1 AND v = 1 AS accepted FROM c"""


@QUERIES.add("p31_final_reward", P31)
def p31(t):
    share = lambda c: F.count(F.when(c, 1)) / F.count("*")
    c = t("lineitem").groupBy("l_orderkey").agg(share((F.col("l_quantity") > 0) & (F.col("l_discount") < 0.08)).alias("a"), F.when(F.min("l_linenumber") == 1, 1.0).otherwise(0.0).alias("v"), share(F.col("l_returnflag") == "N").alias("g"))
    good = (F.col("a") == 1) & (F.col("v") == 1)
    reward = F.when(good, 0.5 + 0.5 * F.col("g")).otherwise(F.least(-1 + (F.col("a") + F.col("v") + F.col("g")) / 3, F.lit(-1e-8)))
    return c.select("l_orderkey", F.round(reward, 8).alias("reward"), good.alias("accepted"))


@QUERIES.add("f2_cost_share", "SELECT l_orderkey, round(CASE WHEN sum(l_extendedprice) > 0 THEN CAST(sum(CASE WHEN l_returnflag = 'A' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) / CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) ELSE 0 END, 6) AS share FROM lineitem GROUP BY l_orderkey")
def f2(t):
    cost = money(F.col("l_extendedprice"))
    part, whole = F.sum(F.when(F.col("l_returnflag") == "A", cost).otherwise(0)).cast("double"), F.sum(cost).cast("double")
    return t("lineitem").groupBy("l_orderkey").agg(F.round(F.when(whole > 0, part / whole).otherwise(0.0), 6).alias("share"))


@QUERIES.add("f3_best_candidate", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn = 1")
def f3(t):
    w = Window.partitionBy("l_orderkey").orderBy("l_extendedprice", "l_linenumber", "l_partkey", "l_suppkey")
    return t("lineitem").withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@QUERIES.add("f4_discrimination", "SELECT l_orderkey, count(*) >= 2 AND count(DISTINCT l_quantity) >= 2 AND bool_and(l_discount < 0.1) AS discriminates FROM lineitem GROUP BY l_orderkey")
def f4(t):
    return t("lineitem").groupBy("l_orderkey").agg(((F.count("*") >= 2) & (F.countDistinct("l_quantity") >= 2) & F.bool_and(F.col("l_discount") < 0.1)).alias("discriminates"))


@QUERIES.add("t7_bound_derivation", "SELECT o_custkey, count(*) AS n_plans, ceil(max(o_totalprice) * 1.12 / 100) * 100 AS budget FROM orders GROUP BY o_custkey")
def t7(t):
    return t("orders").groupBy("o_custkey").agg(F.count("*").alias("n_plans"), (F.ceil(F.max("o_totalprice") * 1.12 / 100) * 100).cast("double").alias("budget"))


@QUERIES.add("p26_room_type", "SELECT l_orderkey, round(avg(CASE WHEN l_linenumber % 4 = 2 THEN 1.0 ELSE 0.0 END), 6) AS score FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_orderkey")
def p26(t):
    return t("lineitem").filter("l_linestatus = 'O'").groupBy("l_orderkey").agg(F.round(F.avg(F.when(F.col("l_linenumber") % 4 == 2, 1.0).otherwise(0.0)), 6).alias("score"))


P17 = """WITH d AS (SELECT o_orderkey, unnest(range(1, 4)) AS day FROM orders), s AS (SELECT l_orderkey, l_linenumber AS day, count(*) AS n FROM lineitem WHERE l_returnflag = 'N' GROUP BY ALL)
SELECT o_orderkey, count(*) FILTER (WHERE coalesce(n, 0) = CASE WHEN d.day < 3 THEN 1 ELSE 0 END) AS n_nights_fine FROM d LEFT JOIN s ON o_orderkey = l_orderkey AND d.day = s.day GROUP BY o_orderkey"""


@QUERIES.add("p17_overnight_coverage", P17)
def p17(t):
    d = t("orders").select("o_orderkey", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("day"))
    s = t("lineitem").filter("l_returnflag = 'N'").groupBy(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("day")).agg(F.count("*").alias("n"))
    right = F.coalesce("n", F.lit(0)) == F.when(F.col("day") < 3, 1).otherwise(0)
    return d.join(s, ["o_orderkey", "day"], "left").groupBy("o_orderkey").agg(F.count(F.when(right, 1)).alias("n_nights_fine"))


@QUERIES.add("p28_time_window", "SELECT l_orderkey, bool_and((l_partkey * 7) % 1440 BETWEEN 360 AND 1320) AS passed, round(avg(CASE WHEN (l_partkey * 7) % 1440 BETWEEN 360 AND 1320 THEN 1.0 ELSE 0.0 END), 6) AS score FROM lineitem GROUP BY l_orderkey")
def p28(t):
    fine = ((F.col("l_partkey") * 7) % 1440).between(360, 1320)
    return t("lineitem").groupBy("l_orderkey").agg(F.bool_and(fine).alias("passed"), F.round(F.avg(F.when(fine, 1.0).otherwise(0.0)), 6).alias("score"))


@QUERIES.add("p34_contract_hash", "SELECT l_orderkey, sha256(string_agg(DISTINCT CAST(l_partkey AS VARCHAR), ',' ORDER BY CAST(l_partkey AS VARCHAR))) AS contract_hash FROM lineitem GROUP BY l_orderkey")
def p34(t):
    return t("lineitem").groupBy("l_orderkey").agg(F.sha2(F.array_join(F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))), ","), 256).alias("contract_hash"))


@QUERIES.add("t8_category_actual", "SELECT l_orderkey, CAST(sum(CASE WHEN l_returnflag = 'N' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) / 2 / greatest(1, count(*) FILTER (WHERE l_returnflag = 'N')) AS per_person_meal FROM lineitem GROUP BY l_orderkey")
def t8(t):
    own = F.col("l_returnflag") == "N"
    n = F.greatest(F.lit(1), F.count(F.when(own, 1)))
    return t("lineitem").groupBy("l_orderkey").agg((F.sum(F.when(own, money(F.col("l_extendedprice"))).otherwise(0)).cast("double") / 2 / n).alias("per_person_meal"))


F1 = """WITH li AS (SELECT l_orderkey AS plan_id, l_linenumber, ['attraction', 'lunch', 'dinner', 'accommodation', 'train', 'breakfast'][l_partkey % 6 + 1] AS kind, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, CASE WHEN l_suppkey * 11 % 1440 >= l_partkey * 7 % 1440 THEN l_suppkey * 11 % 1440 - l_partkey * 7 % 1440 ELSE 0 END AS m,
 CASE WHEN l_suppkey * 11 % 1440 >= l_partkey * 7 % 1440 AND l_returnflag = 'A' THEN l_suppkey * 11 % 1440 - l_partkey * 7 % 1440 ELSE 0 END AS w, l_linestatus = 'O' AS meal, l_partkey, l_suppkey FROM lineitem),
rt AS (SELECT plan_id, l_linenumber, meal, sum(m) AS m, sum(w) AS w FROM li GROUP BY ALL), ra AS (SELECT plan_id, sum(m) AS rm, count(*) AS nr, sum(m) FILTER (WHERE meal) AS mm, count(*) FILTER (WHERE meal) AS nm, sum(w) AS wm FROM rt GROUP BY 1),
co AS (SELECT plan_id, sum(amount) AS total, count(*) FILTER (WHERE kind = 'attraction') AS na, count(*) FILTER (WHERE kind IN ('lunch', 'dinner', 'breakfast')) AS ne, coalesce(sum(amount) FILTER (WHERE kind IN ('lunch', 'dinner', 'breakfast')), 0) AS meals, coalesce(sum(amount) FILTER (WHERE kind = 'accommodation'), 0) AS lodging, coalesce(sum(amount) FILTER (WHERE kind = 'attraction'), 0) AS sights, coalesce(sum(amount) FILTER (WHERE kind = 'train'), 0) AS inter, coalesce(sum(m) FILTER (WHERE kind = 'train'), 0) AS leg FROM li GROUP BY 1),
en AS (SELECT DISTINCT plan_id, l_partkey, l_partkey % 90 AS lat, l_partkey % 170 AS lon FROM li WHERE l_partkey % 5 <> 0), di AS (SELECT plan_id, avg(2 * 6371.0088 * asin(sqrt(least(pow(sin(radians(lat - 30) / 2), 2) + cos(radians(30)) * cos(radians(lat)) * pow(sin(radians(lon - 120) / 2), 2), 1.0)))) AS km FROM en GROUP BY 1),
j AS (SELECT o_orderkey AS plan_id, o_custkey % 4 AS days, CAST(coalesce(total, 0) AS DOUBLE) AS total, coalesce(na, 0) AS na, coalesce(ne, 0) AS ne, ra.* EXCLUDE (plan_id), co.* EXCLUDE (plan_id, total, na, ne), km FROM orders LEFT JOIN ra ON ra.plan_id = o_orderkey LEFT JOIN co ON co.plan_id = o_orderkey LEFT JOIN di ON di.plan_id = o_orderkey),
x AS (SELECT plan_id, unnest([struct_pack(k := 'daily_attraction_count', v := na / greatest(days, 1)), struct_pack(k := 'average_innercity_route_minutes', v := coalesce(rm / nullif(nr, 0), 0)), struct_pack(k := 'average_meal_transfer_minutes', v := coalesce(mm / nullif(nm, 0), 0)), struct_pack(k := 'dining_cost_share', v := CASE WHEN total > 0 THEN CAST(meals AS DOUBLE) / total ELSE 0 END), struct_pack(k := 'absolute_lodging_cost', v := CAST(coalesce(lodging, 0) AS DOUBLE)), struct_pack(k := 'average_poi_anchor_distance_km', v := km), struct_pack(k := 'walking_minutes', v := CAST(coalesce(wm, 0) AS DOUBLE)), struct_pack(k := 'total_cost', v := total), struct_pack(k := 'scheduled_stop_count', v := CAST(na + CASE WHEN ne > 0 THEN 1 ELSE 0 END AS DOUBLE)), struct_pack(k := 'attraction_cost_share', v := CASE WHEN total > 0 THEN CAST(sights AS DOUBLE) / total ELSE 0 END), struct_pack(k := 'intercity_cost_share', v := CASE WHEN total > 0 THEN CAST(inter AS DOUBLE) / total ELSE 0 END), struct_pack(k := 'total_travel_minutes', v := CAST(coalesce(leg, 0) + coalesce(rm, 0) AS DOUBLE))]) AS s FROM j)
SELECT plan_id, s.k AS metric, round(s.v, 6) AS value FROM x"""


@QUERIES.add("f1_preference_metrics", F1)
def f1(t):
    """Line items as cost items, routes of a segment, legs (those by train) and places (their keys as coordinates)."""
    kind = F.get(F.array(*map(F.lit, ("attraction", "lunch", "dinner", "accommodation", "train", "breakfast"))), (F.col("l_partkey") % 6).cast("int"))
    li = t("lineitem").select(F.col("l_orderkey").alias("plan_id"), F.col("l_linenumber").alias("route_id"), kind.alias("activity_type"), F.col("l_extendedprice").alias("amount"), F.when(F.col("l_linestatus") == "O", "restaurant").otherwise("attraction").alias("to_kind"), F.when(F.col("l_returnflag") == "A", "walk").otherwise("taxi").alias("mode"), (F.col("l_partkey") * 7 % 1440).alias("start_min"), (F.col("l_suppkey") * 11 % 1440).alias("end_min"), "l_partkey")
    n = li.groupBy("plan_id").agg(F.sum(money(F.col("amount"))).cast("double").alias("total_cost"), F.count(F.when(F.col("activity_type") == "attraction", 1)).alias("n_attractions"), F.count(F.when(F.col("activity_type").isin(*preferences.MEALS), 1)).alias("n_restaurants"))
    plans = t("orders").select(F.col("o_orderkey").alias("plan_id"), (F.col("o_custkey") % 4).alias("days"), F.lit(30.0).alias("anchor_lat"), F.lit(120.0).alias("anchor_lon")).join(n, "plan_id", "left").fillna(0, ["total_cost", "n_attractions", "n_restaurants"])
    places = li.select("plan_id", F.col("l_partkey").alias("entity_id"), F.when(F.col("l_partkey") % 5 == 0, "station").otherwise("hotel").alias("entity_type"), (F.col("l_partkey") % 90).cast("double").alias("lat"), (F.col("l_partkey") % 170).cast("double").alias("lon"))
    legs = li.filter("activity_type = 'train'").select("plan_id", F.col("start_min").alias("departs"), F.col("end_min").alias("arrives"))
    return preferences.preference_metrics(plans, li, li, legs, places).withColumn("value", F.round("value", 6))


@QUERIES.add("p3_route_cost", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_returnflag WHEN 'A' THEN CAST(ceil(l_quantity / 4) AS BIGINT) WHEN 'N' THEN CAST(l_quantity AS BIGINT) ELSE 1 END AS quantity FROM lineitem")
def p3(t):
    q = F.when(F.col("l_returnflag") == "A", F.ceil(F.col("l_quantity") / 4)).when(F.col("l_returnflag") == "N", F.col("l_quantity").cast("long")).otherwise(F.lit(1).cast("long"))
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", q.alias("quantity"))


P36 = """SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS plan FROM lineitem GROUP BY l_orderkey"""


@QUERIES.add("p36_plan_export", P36)
def p36(t):
    g = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("a"))
    return g.select("l_orderkey", F.array_join(F.transform("a", lambda x: F.concat(x["l_linenumber"].cast("string"), F.lit(":"), x["l_partkey"].cast("string"))), ",").alias("plan"))


P32 = """SELECT o_orderkey, CASE WHEN o_totalprice IS NULL THEN 'no_total' WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_totalprice > 200000 THEN 'too_dear' ELSE 'accepted' END AS reason FROM orders"""


@QUERIES.add("p32_accept_filter", P32)
def p32(t):
    return t("orders").select("o_orderkey", F.when(F.col("o_totalprice").isNull(), "no_total").when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_totalprice") > 200000, "too_dear").otherwise("accepted").alias("reason"))
