"""Evidence paths that a task's wording calls for, chosen within the steps that its plan has left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Preferences about places near each other, the word for nearby, and the order in which paths are offered.
SPATIAL = ("less_innercity_time", "less_walking", "near_poi", "shorter_meal_transfer", "shorter_total_travel_time")
NEARBY = "附近"
KINDS = ("opening_verification", "nearby_discovery", "candidate_comparison")


def compared_types(preferences: Column, constraints: Column) -> Column:
    """The types of entities whose prices a task makes worth comparing: all for a lower total or a budget of the whole trip,
    hotels for a lower share of lodging. constraints: an array of structs with kind and scope."""
    all_ = F.array(*map(F.lit, ("attraction", "restaurant", "hotel")))
    budget = F.exists(constraints, lambda c: (c["kind"] == "total_budget") & (c["scope"] == "trip"))
    whole = F.coalesce(F.array_contains(preferences, "lower_total_cost"), F.lit(False)) | F.coalesce(budget, F.lit(False))
    return F.when(whole, all_).when(F.array_contains(preferences, "lower_lodging_share"), F.array(F.lit("hotel"))).otherwise(F.array().cast("array<string>"))


def select_paths(tasks: DataFrame, capabilities: DataFrame, entities: DataFrame, spatial: tuple[str, ...] = SPATIAL, nearby: str = NEARBY) -> DataFrame:
    """(task_id, kind, candidate_id, reason): every offered path of a task and why it was taken or not: selected, not_called_for,
    over_budget.

    tasks: task_id, query, steps_left, preferences (array), constraints (array of kind, scope). capabilities: task_id, kind,
    candidate_id, steps; one a kind and task (of several the one with the smallest candidate_id). entities: candidate_id, name,
    entity_type. Opening hours are verified where the query names the entity, nearby search is used for spatial preferences or
    where the query says so, candidates are compared where compared_types has their type. Paths called for are offered in
    the order of KINDS; each is taken if its steps still fit into what those before have left, and passed over otherwise. Missing
    entities, steps or budgets call for nothing or fit nowhere; unknown kinds are not_called_for.
    """
    one = capabilities.groupBy("task_id", "kind").agg(F.min(F.struct("candidate_id", "steps")).alias("c")).select("task_id", "kind", "c.*")
    j = one.join(tasks, "task_id").join(entities.select("candidate_id", "name", "entity_type"), "candidate_id", "left")
    preferences = F.coalesce("preferences", F.array().cast("array<string>"))
    called = F.when(F.col("kind") == KINDS[0], (F.col("name") != "") & F.contains("query", F.col("name"))).when(F.col("kind") == KINDS[1], F.arrays_overlap(preferences, F.array(*map(F.lit, spatial))) | F.contains("query", F.lit(nearby)))
    called = F.coalesce(called.when(F.col("kind") == KINDS[2], F.array_contains(compared_types(preferences, F.col("constraints")), F.col("entity_type"))), F.lit(False))
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    offers = j.groupBy("task_id").agg(F.first("steps_left").alias("left"), F.array_sort(F.collect_list(F.struct(place.alias("place"), "kind", "candidate_id", "steps", called.alias("called")))).alias("o"))
    # a fold over the few offers of a task: what is left, and the verdicts so far
    start = F.struct(F.col("left").cast("long").alias("left"), F.array().cast("array<boolean>").alias("taken"))

    def take(s: Column, o: Column) -> Column:
        fits = F.coalesce(o["called"] & (o["steps"] <= s["left"]), F.lit(False))
        return F.struct((s["left"] - F.when(fits, o["steps"]).otherwise(0)).cast("long").alias("left"), F.concat(s["taken"], F.array(fits)).alias("taken"))

    done = offers.withColumn("t", F.aggregate("o", start, take, lambda s: s["taken"]))
    rows = done.select("task_id", F.explode(F.arrays_zip("o", "t")).alias("r"))
    reason = F.when(~F.col("r.o.called"), "not_called_for").when(F.col("r.t"), "selected").otherwise("over_budget")
    return rows.select("task_id", "r.o.kind", "r.o.candidate_id", reason.alias("reason"))
