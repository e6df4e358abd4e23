"""Scenario effects, realistic routes, and ranked candidates of a catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymill.functions.columns import money, stable_rank


def draw_effects(slots: DataFrame, places: DataFrame, seed: str) -> DataFrame:
    """(slot, effect, kind, place_id, before, after) drawn by hash rank inside a slot.

    slots: slot, city, profile; places: place_id, kind, city, price. poi_closure and hotel_unavailable close up to 5 attractions
    or hotels; transport_cancellation cancels min(3, max(1, n // 10), n - 1) of n transports; price_change raises 6 prices of
    places by a quarter, in decimals, half a cent up. Only places of the slot's city and of the kind that the profile asks for are ranked.
    """
    wanted = F.when(F.col("profile") == "poi_closure", F.array(F.lit("attraction"))).when(F.col("profile") == "hotel_unavailable", F.array(F.lit("hotel"))).when(F.col("profile") == "transport_cancellation", F.array(F.lit("transport"))).when(F.col("profile") == "price_change", F.array(F.lit("attraction"), F.lit("restaurant"), F.lit("hotel")))
    j = slots.filter("profile <> 'normal'").withColumn("kind", F.explode(wanted)).join(places, ["city", "kind"]).filter((F.col("profile") != "price_change") | F.col("price").isNotNull())
    w = Window.partitionBy("slot")
    n = F.count("*").over(w)
    most = F.when(F.col("profile") == "price_change", 6).when(F.col("profile") == "transport_cancellation", F.least(F.lit(3), F.greatest(F.lit(1), F.floor(n / 10)), n - 1)).otherwise(5)
    ranked = j.withColumns({"effect": F.row_number().over(w.orderBy(stable_rank(seed, F.col("slot"), F.col("place_id")))), "_most": most}).filter("effect <= _most")
    dearer = F.col("profile") == "price_change"
    return ranked.select("slot", "effect", "kind", "place_id", F.when(dearer, F.col("price")).alias("before"), F.when(dearer, F.round(money(F.col("price")) * F.lit(1.25).cast("decimal(3,2)"), 2).cast("double")).alias("after"))


def route_is_real(mode: Column, segments: Column) -> Column:
    """Whether the distances of a route (array of mode, km) suit its mode: on foot 2 km, taxi 80, metro 40 with 2 on foot.
    No segments, or one without a number, is not real."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + F.greatest(x["km"], F.lit(0.0)))
    whole, walked = total(segments), total(F.filter(segments, lambda x: x["mode"] == "walk"))
    fine = F.when(mode == "walk", whole <= 2).when(mode == "taxi", whole <= 80).when(mode == "metro", (whole <= 40) & (walked <= 2)).otherwise(True)
    return F.coalesce((F.size(segments) > 0) & fine, F.lit(False))


def rank_by_neighbors(places: DataFrame, pairs: DataFrame, top: int) -> DataFrame:
    """The top places of each city by how many neighbours they have. pairs: (anchor_id, place_id, km)."""
    n = pairs.groupBy(F.col("anchor_id").alias("place_id")).agg(F.count("*").alias("n_neighbors"))
    w = Window.partitionBy("city").orderBy(F.desc("n_neighbors"), "place_id")
    j = places.select("city", "place_id").join(n, "place_id", "left").withColumn("n_neighbors", F.coalesce("n_neighbors", F.lit(0)))
    return j.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top)
