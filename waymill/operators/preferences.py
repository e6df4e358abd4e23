"""The twelve figures by which plans of one task are compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymill.functions.columns import haversine_km, money

MEALS = ("breakfast", "lunch", "dinner")
INTERCITY = ("train", "airplane")


def preference_metrics(plans: DataFrame, items: DataFrame, routes: DataFrame, legs: DataFrame, entities: DataFrame) -> DataFrame:
    """(plan_id, metric, value), one row for each of the twelve metrics of a plan.

    plans: plan_id, days, total_cost, n_attractions, n_restaurants, anchor_lat, anchor_lon; items: plan_id, activity_type,
    amount; routes: plan_id, route_id, to_kind (kind of the destination), mode, start_min, end_min, one row a segment; legs:
    plan_id, departs, arrives (minutes of a day); entities: plan_id, entity_id, entity_type, lat, lon. A segment without both
    times, or that ends before it starts, takes no time; shares of a total of nothing are 0, as are means of nothing; the mean
    distance from the anchor is null without an anchor, without places, or if one of them lacks coordinates.
    """
    took = F.when(F.col("end_min") >= F.col("start_min"), F.col("end_min") - F.col("start_min")).otherwise(0)
    by_route = routes.groupBy("plan_id", "route_id", "to_kind").agg(F.sum(F.coalesce(took, F.lit(0))).alias("m"), F.sum(F.when(F.col("mode") == "walk", F.coalesce(took, F.lit(0))).otherwise(0)).alias("w"))
    meal = F.col("to_kind") == "restaurant"
    r = by_route.groupBy("plan_id").agg(F.sum("m").alias("route_m"), F.count("*").alias("n_routes"), F.sum(F.when(meal, F.col("m"))).alias("meal_m"), F.count(F.when(meal, 1)).alias("n_meal"), F.sum("w").alias("walk_m"))
    spent = lambda *kinds: F.coalesce(F.sum(F.when(F.col("activity_type").isin(*kinds), money(F.col("amount")))), F.lit(0)).cast("double")
    c = items.groupBy("plan_id").agg(spent(*MEALS).alias("meals"), spent("accommodation").alias("lodging"), spent("attraction").alias("sights"), spent(*INTERCITY).alias("intercity"))
    t = legs.groupBy("plan_id").agg(F.sum(F.greatest(F.col("arrives") - F.col("departs"), F.lit(0))).alias("leg_m"))
    near = entities.filter(F.col("entity_type").isin("attraction", "restaurant", "hotel")).dropDuplicates(["plan_id", "entity_id"]).join(plans.select("plan_id", "anchor_lat", "anchor_lon"), "plan_id")
    km = haversine_km(F.col("anchor_lat"), F.col("anchor_lon"), F.col("lat"), F.col("lon"))
    d = near.groupBy("plan_id").agg(F.when(F.count(km) == F.count("*"), F.avg(km)).alias("anchor_km"))
    j = plans.join(r, "plan_id", "left").join(c, "plan_id", "left").join(t, "plan_id", "left").join(d, "plan_id", "left")
    zero = lambda x: F.coalesce(F.col(x).cast("double"), F.lit(0.0))
    mean = lambda a, n: F.when(zero(n) > 0, F.col(a) / F.col(n)).otherwise(0.0)
    share = lambda a: F.when(F.col("total_cost") > 0, zero(a) / F.col("total_cost")).otherwise(0.0)
    metrics = {
        "daily_attraction_count": F.col("n_attractions") / F.greatest(F.col("days"), F.lit(1)), "average_innercity_route_minutes": mean("route_m", "n_routes"), "average_meal_transfer_minutes": mean("meal_m", "n_meal"),
        "dining_cost_share": share("meals"), "absolute_lodging_cost": zero("lodging"), "average_poi_anchor_distance_km": F.col("anchor_km"), "walking_minutes": zero("walk_m"), "total_cost": F.col("total_cost"),
        "scheduled_stop_count": F.col("n_attractions") + F.when(F.col("n_restaurants") > 0, 1).otherwise(0), "attraction_cost_share": share("sights"), "intercity_cost_share": share("intercity"), "total_travel_minutes": zero("leg_m") + zero("route_m"),
    }
    return j.select("plan_id", F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in metrics.items()])).alias("x")).select("plan_id", "x.*")
