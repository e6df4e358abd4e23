"""Checks of many plans at once.

Frames: activities (plan_id, day, pos, activity_type, candidate_id, start_time, end_time as HH:MM, unit_price, amount),
entities (candidate_id, entity_type, city, origin_city, destination_city, open_time, close_time), plans (plan_id, origin,
destination, days). Each check gives one row per plan: plan_id, status, score (null where it cannot be told).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymill.functions.columns import clock_minutes

# Meal windows in minutes of the day, the checks with their dimension and group, and what a check that
# could not be told waits for, in the order in which it is asked.
MEALS = [("breakfast", 360, 540), ("lunch", 660, 840), ("dinner", 1020, 1200)]
TRANSPORT = ("train", "airplane")
DIMENSIONS = ("artifact", "validity", "goal")
REGISTRY = [
    ("terminal_plan", "artifact", "protocol_structure"),
    ("plan_structure", "artifact", "protocol_structure"),
    ("chronology", "validity", "protocol_structure"),
    ("entity_grounding", "validity", "evidence_grounding"),
    ("candidate_usage", "validity", "evidence_grounding"),
    ("intercity_time", "validity", "evidence_grounding"),
    ("route_grounding", "validity", "evidence_grounding"),
    ("opening_hours", "validity", "spatiotemporal_commonsense"),
    ("entity_uniqueness", "validity", "spatiotemporal_commonsense"),
    ("meal_commonsense", "validity", "spatiotemporal_commonsense"),
    ("quantity_consistency", "validity", "quantity_cost"),
    ("cost_accounting", "validity", "quantity_cost"),
    ("overnight_coverage", "validity", "protocol_structure"),
    ("task_alignment", "goal", "protocol_structure"),
    ("trip_coverage", "goal", "spatiotemporal_commonsense"),
]
GROUPS = ("protocol_structure", "evidence_grounding", "spatiotemporal_commonsense", "task_constraints", "quantity_cost")
WAITS_FOR = [
    ("candidate_usage", ["entity_grounding"]),
    ("intercity_time", ["entity_grounding", "plan_structure"]),
    ("route_grounding", ["entity_grounding", "plan_structure", "chronology"]),
    ("opening_hours", ["entity_grounding", "plan_structure"]),
    ("trip_coverage", ["entity_grounding"]),
    ("meal_commonsense", ["plan_structure", "entity_grounding"]),
    ("cost_accounting", ["entity_grounding", "route_grounding", "plan_structure"]),
]
STATUSES = ("pass", "fail", "unverifiable", "blocked", "not_applicable")


def n_where(c: Column) -> Column:
    return F.count(F.when(c, 1))


def status_of(unknown: Column, bad: Column) -> Column:
    return F.when(unknown > 0, "unverifiable").when(bad > 0, "fail").otherwise("pass")


def grounded(activities: DataFrame, entities: DataFrame) -> DataFrame:
    """Activities with the fields of their candidates; known tells whether there is one. Spark broadcasts the entities only if
    they are small; a plan's activities of one hot candidate are split by AQE."""
    return activities.join(entities.withColumn("known", F.lit(True)), "candidate_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def opening_hours(activities: DataFrame, entities: DataFrame) -> DataFrame:
    """Visits and meals lie within the hours of their places; hours over midnight always fit; a hotel's breakfast is exempt."""
    own = grounded(activities.filter(F.col("activity_type").isin("attraction", "breakfast", "lunch", "dinner")), entities)
    exempt = F.coalesce((F.col("activity_type") == "breakfast") & (F.col("entity_type") == "hotel"), F.lit(False))
    o, c, a, b = clock_minutes(F.col("open_time")), clock_minutes(F.col("close_time"), True), clock_minutes(F.col("start_time")), clock_minutes(F.col("end_time"), True)
    unknown = ~F.col("known") | (~exempt & (o.isNull() | c.isNull() | a.isNull() | b.isNull()))
    late = ~exempt & (o <= c) & ~((a >= o) & (b <= c))
    found = own.groupBy("plan_id").agg(n_where(unknown).alias("unknown"), n_where(~unknown & late).alias("bad"), F.count("*").alias("n"))
    return found.select("plan_id", status_of(F.col("unknown"), F.col("bad")).alias("status"), F.when(F.col("unknown") == 0, F.round(1 - F.col("bad") / F.col("n"), 8)).alias("score"))


def meal_commonsense(activities: DataFrame, entities: DataFrame) -> DataFrame:
    """Meals lie within their windows, one of each a day; a hotel's breakfast costs nothing."""
    windows = F.create_map(*[x for m, a, b in MEALS for x in (F.lit(m), F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")))])
    own = grounded(activities.filter(F.col("activity_type").isin(*[m for m, _, _ in MEALS])), entities).withColumn("w", windows[F.col("activity_type")])
    a, b = clock_minutes(F.col("start_time")), clock_minutes(F.col("end_time"), True)
    unknown = a.isNull() | b.isNull() | F.col("day").isNull()
    charged = F.coalesce((F.col("activity_type") == "breakfast") & (F.col("entity_type") == "hotel"), F.lit(False)) & ~(F.coalesce(F.col("unit_price") == 0, F.lit(False)) & F.coalesce(F.col("amount") == 0, F.lit(False)))
    odd = ~unknown & ((a < F.col("w.a")) | (b > F.col("w.b")) | charged)
    days = own.groupBy("plan_id", "day", "activity_type").agg(n_where(unknown).alias("unknown"), n_where(odd).alias("odd"), n_where(~unknown).alias("n"))
    return days.groupBy("plan_id").agg(F.sum("unknown").alias("unknown"), F.sum(F.col("odd") + F.greatest(F.col("n") - 1, F.lit(0))).alias("bad")).select(
        "plan_id", status_of(F.col("unknown"), F.col("bad")).alias("status"), F.when(F.col("unknown") == 0, (F.col("bad") == 0).cast("double")).alias("score"))


def intercity_time(activities: DataFrame, transports: DataFrame) -> DataFrame:
    """Transport times equal the evidence (candidate_id, departs, arrives as HH:MM) where it states them."""
    own = activities.filter(F.col("activity_type").isin(*TRANSPORT)).join(transports.withColumn("known", F.lit(True)), "candidate_id", "left")
    differs = lambda x, y: F.coalesce(F.col(y).isNotNull() & ~F.col(x).eqNullSafe(F.col(y)), F.lit(False))
    g = own.groupBy("plan_id").agg(n_where(F.col("known").isNull()).alias("unknown"), n_where(F.col("known") & (differs("start_time", "departs") | differs("end_time", "arrives"))).alias("bad"), F.count("*").alias("n"))
    return g.select("plan_id", status_of(F.col("unknown"), F.col("bad")).alias("status"), F.when(F.col("unknown") == 0, F.round(1 - F.col("bad") / F.col("n"), 8)).alias("score"))


def candidate_usage(activities: DataFrame, entities: DataFrame, allowed: DataFrame) -> DataFrame:
    """Candidates are of a type that their use allows. allowed: (activity_type, entity_type), a small table; a use that it does
    not name is not judged, and a plan without a judged use is not_applicable."""
    uses = allowed.groupBy("activity_type").agg(F.collect_set("entity_type").alias("types"))
    j = grounded(activities, entities).join(uses, "activity_type", "left")
    judged = F.col("types").isNotNull()
    g = j.groupBy("plan_id").agg(n_where(judged).alias("n"), n_where(judged & F.col("entity_type").isNull()).alias("unknown"), n_where(judged & F.col("entity_type").isNotNull() & ~F.array_contains("types", F.col("entity_type"))).alias("bad"))
    return g.select("plan_id", F.when(F.col("n") == 0, "not_applicable").otherwise(status_of(F.col("unknown"), F.col("bad"))).alias("status"), F.when((F.col("n") > 0) & (F.col("unknown") == 0), F.round(1 - F.col("bad") / F.col("n"), 8)).alias("score"))


def route_grounding(activities: DataFrame, routes: DataFrame) -> DataFrame:
    """A change of place between two activities needs a saved route that fits in the gap.

    activities here carry place_from, place_to, start_min, end_min; routes: (plan_id, from_place, to_place, minutes), one row per
    pair of places. Missing places make a step unverifiable; a missing or too long route makes it fail.
    """
    w = Window.partitionBy("plan_id").orderBy("start_min", "pos")
    moves = activities.select("plan_id", F.lag("place_to").over(w).alias("from_place"), F.col("place_from").alias("to_place"), (F.col("start_min") - F.lag("end_min").over(w)).alias("gap"), F.row_number().over(w).alias("rn")).filter("rn > 1")
    best = routes.groupBy("plan_id", "from_place", "to_place").agg(F.min("minutes").alias("minutes"))
    unknown = F.col("from_place").isNull() | F.col("to_place").isNull()
    needed = ~unknown & (F.col("from_place") != F.col("to_place"))
    j = moves.join(best, ["plan_id", "from_place", "to_place"], "left")
    g = j.groupBy("plan_id").agg(n_where(unknown).alias("unknown"), n_where(needed & F.coalesce(F.col("minutes") > F.col("gap"), F.lit(True))).alias("bad"), n_where(needed).alias("n"))
    return g.select("plan_id", status_of(F.col("unknown"), F.col("bad")).alias("status"), F.when(F.col("unknown") == 0, F.round(1 - F.col("bad") / F.greatest("n", F.lit(1)), 8)).alias("score"))


def trip_coverage(plans: DataFrame, activities: DataFrame, entities: DataFrame) -> DataFrame:
    """Mean of four parts: a visit, the nights, the journeys there and back (each present, and first and last), and the share
    of local activities in the destination. All must be 1 for a pass."""
    j = grounded(activities, entities).join(plans, "plan_id")
    moves = F.col("activity_type").isin(*TRANSPORT)
    out = F.coalesce((F.col("origin_city") == F.col("origin")) & (F.col("destination_city") == F.col("destination")), F.lit(False))
    back = F.coalesce((F.col("origin_city") == F.col("destination")) & (F.col("destination_city") == F.col("origin")), F.lit(False))
    at = F.struct("day", "pos")
    g = j.groupBy("plan_id").agg(
        n_where(~F.col("known")).alias("unknown"), F.max((F.col("activity_type") == "attraction").cast("double")).alias("visit"), n_where(F.col("activity_type") == "accommodation").alias("nights"),
        F.first("days").alias("days"), F.bool_or(moves & out).cast("double").alias("there"), F.bool_or(moves & back).cast("double").alias("home"), F.min_by(out, at).cast("double").alias("first"),
        F.max_by(back, at).cast("double").alias("last"), (n_where(~moves & (F.col("city") == F.col("destination"))) / F.greatest(n_where(~moves), F.lit(1))).alias("local"), F.first(F.col("origin") != F.col("destination")).alias("travels"),
    )
    nights = F.when(F.col("days") <= 1, 1.0).otherwise(F.least(F.col("nights") / (F.col("days") - 1), F.lit(1.0)))
    journey = F.when(F.col("travels"), F.least((F.col("there") + F.col("home")) / 2, (F.col("first") + F.col("last")) / 2)).otherwise(1.0)
    score = (F.col("visit") + nights + journey + F.col("local")) / 4
    return g.select("plan_id", F.when(F.col("unknown") > 0, "unverifiable").when(score == 1, "pass").otherwise("fail").alias("status"), F.when(F.col("unknown") == 0, F.round(score, 8)).alias("score"))


def mode_check(actual: DataFrame, required: DataFrame, operator: str) -> DataFrame:
    """Modes of travel against alternatives. actual: (plan_id, modes array); required: (plan_id, any_of array of arrays).
    eq: one alternative is the set; include: one lies in it; exclude: none of them meets it."""
    a, r = F.array_distinct("modes"), F.col("any_of")
    both = lambda g: F.size(F.array_intersect(a, g))
    if operator == "exclude":
        passed = ~F.arrays_overlap(a, F.flatten(r))
        score = passed.cast("double")
    elif operator == "eq":
        passed = F.exists(r, lambda g: (both(g) == F.size(a)) & (both(g) == F.size(F.array_distinct(g))))
        score = F.array_max(F.transform(r, lambda g: both(g) / F.greatest(F.size(F.array_union(a, g)), F.lit(1))))
    else:
        passed = F.exists(r, lambda g: both(g) == F.size(F.array_distinct(g)))
        score = F.array_max(F.transform(r, lambda g: both(g) / F.greatest(F.size(F.array_distinct(g)), F.lit(1))))
    return required.join(actual, "plan_id", "left").withColumn("modes", F.coalesce("modes", F.array().cast("array<string>"))).select("plan_id", F.when(passed, "pass").otherwise("fail").alias("status"), F.round(score, 8).alias("score"))


def entity_presence(used: DataFrame, required: DataFrame, operator: str = "include") -> DataFrame:
    """As mode_check over names: include asks for all of one alternative, exclude for none of any. used: (plan_id, name)."""
    names = used.groupBy("plan_id").agg(F.collect_set("name").alias("modes"))
    return mode_check(names, required, operator)


def resolve_blockers(checks: DataFrame) -> DataFrame:
    """Unverifiable checks are blocked by the first check they wait for that failed or is blocked, by the statuses as given.
    checks: plan_id, check_id, status, score; adds blocked_by."""
    spark = checks.sparkSession
    waits = spark.createDataFrame([(c, k, d) for c, ds in WAITS_FOR for k, d in enumerate(ds)], "check_id string, ord int, dep string")
    stuck = checks.filter(F.col("status").isin("fail", "blocked")).select("plan_id", F.col("check_id").alias("dep")).distinct()
    open_ = checks.filter("status = 'unverifiable'").select("plan_id", "check_id").join(F.broadcast(waits), "check_id").join(stuck, ["plan_id", "dep"])
    first = open_.groupBy("plan_id", "check_id").agg(F.min_by("dep", "ord").alias("blocked_by"))
    j = checks.join(first, ["plan_id", "check_id"], "left")
    hit = F.col("blocked_by").isNotNull() & (F.col("status") == "unverifiable")
    return j.withColumns({"status": F.when(hit, "blocked").otherwise(F.col("status")), "score": F.when(~hit, F.col("score")), "blocked_by": F.when(hit, F.col("blocked_by"))})


def owner(check: Column, field: int = 1) -> Column:
    """Dimension (1) or group (2) of a check; null if it is not registered."""
    return F.create_map(*[F.lit(x) for r in REGISTRY for x in (r[0], r[field])])[check]


def dimension_scores(checks: DataFrame) -> DataFrame:
    """Per plan and dimension: the mean of the scored shaping checks (0 if none), and the counts scored, blocked and
    not_applicable. checks: plan_id, check_id, dimension, status, score, shaping."""
    scored = F.col("shaping") & F.col("status").isin("pass", "fail") & F.col("score").isNotNull()
    aggs = []
    for d in DIMENSIONS:
        own = F.col("dimension") == d
        aggs += [F.round(F.coalesce(F.avg(F.when(own & scored, F.col("score").cast("decimal(18,8)"))).cast("double"), F.lit(0.0)), 8).alias(d), n_where(own & scored).alias(f"{d}_scored"), n_where(own & (F.col("status") == "blocked")).alias(f"{d}_blocked"), n_where(own & (F.col("status") == "not_applicable")).alias(f"{d}_not_applicable")]
    return checks.groupBy("plan_id").agg(*aggs)


def group_results(checks: DataFrame) -> DataFrame:
    """Per plan and group: whether all hard checks that count for success pass (none: true). checks: plan_id, check_id, source,
    hardness, status, affects_success."""
    grp = F.when(F.col("source") == "task_spec", "task_constraints").otherwise(F.coalesce(owner(F.col("check_id"), 2), F.lit("protocol_structure")))
    counts = (F.col("hardness") == "hard") & F.col("affects_success")
    return checks.groupBy("plan_id").agg(*[F.coalesce(F.bool_and(F.when((grp == g) & counts, F.col("status") == "pass")), F.lit(True)).alias(g) for g in GROUPS])


def registry_violations(checks: DataFrame) -> DataFrame:
    """Counts of illegal check rows: unknown checks or statuses, scores outside 0 to 1, scored rows without a verdict, blocked
    rows without a blocker, and doubled checks of a plan."""
    env = F.col("source") != "task_spec"
    fault = (
        F.when(env & owner(F.col("check_id")).isNull(), "unknown_check").when(~F.col("status").isin(*STATUSES), "unknown_status")
        .when(~F.col("score").between(0, 1), "score_out_of_range").when(F.col("score").isNotNull() & ~F.col("status").isin("pass", "fail"), "score_without_verdict")
        .when((F.col("status") == "blocked") != F.col("blocked_by").isNotNull(), "blocker_mismatch")
    )
    rows = checks.withColumn("fault", fault).filter("fault is not null").groupBy("fault").agg(F.count("*").alias("n"))
    twice = checks.groupBy("plan_id", "check_id").agg(F.count("*").alias("n")).filter("n > 1").agg(F.lit("doubled_check").alias("fault"), F.sum("n").alias("n")).filter("n is not null")
    return rows.unionByName(twice)
