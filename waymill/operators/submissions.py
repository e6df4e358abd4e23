"""Submitted plans and trajectories: from JSON to rows, quality metrics, acceptance, alignment, reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLAN = "struct<days: array<struct<day: int, activities: array<struct<activity_type: string, candidate_id: bigint, start_min: int, end_min: int, quantity: double>>>>>"


def materialize_plans(submissions: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row per activity of the submitted JSON (plan_id, body), with its day and place in it, absolute minutes, and the
    price of its saved candidate (candidate_id, price): unit_price, amount, known. An end before its start is on the next day.
    Bodies that are no plan yield no rows."""
    one = submissions.select("plan_id", F.explode(F.from_json("body", PLAN)["days"]).alias("d"))
    acts = one.select("plan_id", F.col("d.day").alias("day"), F.posexplode("d.activities").alias("pos", "a"))
    j = acts.select("plan_id", "day", "pos", "a.*").join(candidates, "candidate_id", "left")
    base = (F.col("day") - 1) * 1440
    over = F.when(F.col("end_min") < F.col("start_min"), 1440).otherwise(0)
    return j.select("plan_id", "day", "pos", "activity_type", "candidate_id", (base + F.col("start_min")).alias("abs_start"), (base + F.col("end_min") + over).alias("abs_end"), "quantity", F.col("price").alias("unit_price"), (F.col("price") * F.col("quantity")).alias("amount"), F.col("price").isNotNull().alias("known"))


def upgrade_legacy(activities: DataFrame) -> DataFrame:
    """Fills abs_start, abs_end and pos where they are missing: from day and minutes, and from the index in the day. Transport
    that ends before it starts ends on the next day."""
    base = (F.col("day") - 1) * 1440
    late = F.when((F.col("end_min") < F.col("start_min")) & F.col("activity_type").isin("train", "airplane"), 1440).otherwise(0)
    return activities.withColumns({"abs_start": F.coalesce("abs_start", base + F.col("start_min")), "abs_end": F.coalesce("abs_end", base + F.col("end_min") + late), "pos": F.coalesce("pos", F.col("activity_index"))})


def trip_quality(activities: DataFrame, plans: DataFrame) -> DataFrame:
    """(plan_id, dav, att, ddr and their scores): visits a day, mean minutes of the routes (120 if there is none), meals a day.
    activities: plan_id, activity_type, route_start, route_end in minutes of the day (null without a route)."""
    took = F.when(F.col("route_end") >= F.col("route_start"), F.col("route_end") - F.col("route_start")).otherwise(F.col("route_end") + 1440 - F.col("route_start"))
    meal = F.col("activity_type").isin("breakfast", "lunch", "dinner")
    g = activities.groupBy("plan_id").agg(F.count(F.when(F.col("activity_type") == "attraction", 1)).alias("a"), F.count(F.when(meal, 1)).alias("m"), (F.sum(took) / F.count(took)).alias("t"))
    clip = lambda c: F.round(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)), 8)
    dav, att, ddr = F.col("a") / F.col("days"), F.coalesce("t", F.lit(120.0)), F.col("m") / F.col("days")
    return g.join(plans.select("plan_id", "days"), "plan_id").select("plan_id", F.round(dav, 8).alias("dav"), clip(dav / 4).alias("dav_score"), F.round(att, 8).alias("att"), clip((120 - att) / 105).alias("att_score"), F.round(ddr, 8).alias("ddr"), clip(ddr / 3).alias("ddr_score"))


def is_accepted(versions: list[str]) -> Column:
    """Whether a trajectory's reward lets it into the training rows; missing values do not."""
    conds = [F.col("trajectory_version").isin(*versions), F.col("termination_reason") == "plan_submitted", F.col("final_reward") == 1.0, F.col("rft_accepted"), F.col("reward_valid"), F.col("all_hard_pass")]
    out = F.lit(True)
    for c in conds:
        out = out & F.coalesce(c, F.lit(False))
    return out


def align_calls(messages: DataFrame, steps: DataFrame) -> DataFrame:
    """(key, call_id, problem) of every tool call told by only one side, told twice, or told differently; problem is null if
    both sides agree. Both frames: key, call_id, tool, arguments."""
    side = lambda df, s: df.groupBy("key", "call_id").agg(F.count("*").alias(f"n_{s}"), F.min("tool").alias(f"tool_{s}"), F.min("arguments").alias(f"args_{s}"))
    j = side(messages, "m").join(side(steps, "s"), ["key", "call_id"], "full")
    problem = (
        F.when(F.col("n_s").isNull(), "not_executed").when(F.col("n_m").isNull(), "not_told").when((F.col("n_m") > 1) | (F.col("n_s") > 1), "told_twice")
        .when(~F.col("tool_m").eqNullSafe(F.col("tool_s")), "other_tool").when(~F.col("args_m").eqNullSafe(F.col("args_s")), "other_arguments")
    )
    return j.select("key", "call_id", problem.alias("problem"))


def compact_response(response: Column, fields: list[str]) -> Column:
    """The kept top-level fields of a JSON object, in the given order; null or absent ones are dropped."""
    return F.to_json(F.struct(*[F.get_json_object(response, f"$.{f}").alias(f) for f in fields]))


def key_order_ok(arguments: Column, required: list[str]) -> Column:
    """Whether the required keys of a JSON object come first, in the schema's order; null or no object: false."""
    keys = F.json_object_keys(arguments)
    return F.coalesce(F.slice(keys, 1, len(required)) == F.array(*map(F.lit, required)), F.lit(False))


def review_rollup(reviews: DataFrame, dimensions: list[str]) -> DataFrame:
    """(panel, dimension, n, mean_score) over the valid reviews: exactly the given dimensions, once each, with scores of 1 to 5
    and evidence. reviews: panel, review_id, dimension, score, evidence (an array). Panels stay apart; no joint score."""
    fine = F.coalesce(F.col("score").between(1, 5) & (F.size("evidence") > 0) & F.col("dimension").isin(*dimensions), F.lit(False))
    g = reviews.groupBy("panel", "review_id").agg(F.bool_and(fine).alias("fine"), F.count("*").alias("k"), F.countDistinct("dimension").alias("d"))
    valid = g.filter(F.col("fine") & (F.col("k") == len(dimensions)) & (F.col("d") == len(dimensions))).select("panel", "review_id")
    return reviews.join(valid, ["panel", "review_id"], "left_semi").groupBy("panel", "dimension").agg(F.count("*").alias("n"), F.round(F.sum("score") / F.count("score"), 6).alias("mean_score"))


def with_field(payload: str, field: str, value: Column) -> Column:
    """A JSON object (a column of text) in which a field is a new text; other fields stay as they are, with their types.
    Without the field, or where the new text is null, the payload stays."""
    held = F.map_entries(F.from_json(payload, "map<string,string>"))  # other values than texts come as they are written
    bare = lambda k: F.regexp_like(F.col(payload), F.concat(F.lit('"'), k, F.lit('"\\s*:\\s*[^"\\s]')))
    text = lambda x: F.regexp_replace(F.to_json(F.struct(x.alias("v"))), r'^\{"v":|\}$', "")
    new = lambda e: F.when(e["key"] == field, text(value)).when(bare(e["key"]), F.coalesce(e["value"], F.lit("null"))).otherwise(text(e["value"]))
    pairs = F.transform(held, lambda e: F.concat(text(e["key"]), F.lit(":"), new(e)))
    return F.when(F.exists(held, lambda e: e["key"] == field) & value.isNotNull(), F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise(F.col(payload))
