"""Pricier alternatives to what a plan holds, and the rule for asking a search for its next page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROUP = ["entity_type", "city"]


def price_ranks(places: DataFrame, step: float) -> DataFrame:
    """Adds rank (place by price, then id, among those of its type and city, from 1) and upto (how many cost no more). Ranks are
    counted inside price bands of the given width and shifted by the counts before them, so no task sorts a whole city."""
    own = places.filter("price is not null").withColumn("_band", F.floor(F.col("price") / step))
    bands = own.groupBy(*GROUP, "_band").agg(F.count("*").alias("_n"))
    before = bands.select(*GROUP, "_band", (F.sum("_n").over(Window.partitionBy(*GROUP).orderBy("_band")) - F.col("_n")).alias("_before"))
    band = Window.partitionBy(*GROUP, "_band")
    inner = {"rank": F.row_number().over(band.orderBy("price", "candidate_id")), "upto": F.count("*").over(band.orderBy("price"))}
    return own.withColumns(inner).join(before, [*GROUP, "_band"]).withColumns({c: (F.col(c) + F.col("_before")).cast("long") for c in inner}).drop("_band", "_before")


def value_ranks(df: DataFrame, group: list[str], value: str, key: str, step: float, rank: str = "rank", total: str | None = None) -> DataFrame:
    """Adds rank (from 1, by value and key, in a group) and, if named, the group's number of rows. Counted inside bands of the
    value and shifted by the counts before them, so no task sorts a whole group. Rows without a value come first."""
    own = df.withColumn("_band", F.coalesce(F.floor(F.col(value) / step), F.lit(-(2**62))))
    bands = own.groupBy(*group, "_band").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*group)
    bands = bands.select(*group, "_band", (F.sum("_n").over(w.orderBy("_band")) - F.col("_n")).alias("_before"), F.sum("_n").over(w).alias("_all"))
    inner = F.row_number().over(Window.partitionBy(*group, "_band").orderBy(value, key))
    out = own.withColumn("_r", inner).join(bands, [*group, "_band"]).withColumn(rank, F.col("_r") + F.col("_before"))
    return (out.withColumn(total, F.col("_all")) if total else out).drop("_band", "_r", "_before", "_all")


def comparable_alternatives(items: DataFrame, places: DataFrame, limits: DataFrame, step: float = 10.0) -> DataFrame:
    """(plan_id, candidate_id, alternative_id, alternative_price): for each planned place the cheapest place of its type and city
    that costs more, is not planned itself and keeps the plan's least limit; places without one are left out. items: plan_id,
    candidate_id; places: candidate_id, entity_type, city, price; limits: plan_id, entity_type, max_price.

    The planned ranks of a plan form runs, and the place sought is the one after the run that follows the planned place, so one
    equality join finds it and nothing is paired."""
    ranked = price_ranks(places, step)
    own = items.select("plan_id", "candidate_id").distinct().join(ranked.select("candidate_id", *GROUP, "price", "rank", "upto"), "candidate_id")
    of = Window.partitionBy("plan_id", *GROUP)
    own = own.withColumn("_run", F.col("rank") - F.row_number().over(of.orderBy("rank")))
    runs = own.select("plan_id", *GROUP, (F.col("rank") - 1).alias("upto"), F.max("rank").over(Window.partitionBy("plan_id", *GROUP, "_run")).alias("_end"))
    next_rank = (F.coalesce("_end", "upto") + 1).alias("rank")
    sought = own.select("plan_id", "candidate_id", *GROUP, "upto").join(runs, ["plan_id", *GROUP, "upto"], "left").select("plan_id", "candidate_id", *GROUP, next_rank)
    found = sought.join(ranked.select(*GROUP, "rank", F.col("candidate_id").alias("alternative_id"), F.col("price").alias("alternative_price")), [*GROUP, "rank"])
    least = limits.groupBy("plan_id", "entity_type").agg(F.min("max_price").alias("_limit"))
    kept = found.join(least, ["plan_id", "entity_type"], "left").filter("_limit is null or alternative_price <= _limit")
    return kept.select("plan_id", "candidate_id", "alternative_id", "alternative_price")


def required_count(constraints: Column, kind: str = "activity_count", scope: str = "attraction") -> Column:
    """The largest count that the constraints (an array of kind, scope, operator, count) ask for at least or exactly; 0 if none."""
    own = F.filter(constraints, lambda c: (c["kind"] == kind) & (c["scope"] == scope) & c["operator"].isin("eq", "gte"))
    return F.coalesce(F.array_max(F.transform(own, lambda c: c["count"])), F.lit(0)).cast("long")


def pagination_grounded(named: Column, tool: Column, planned: Column, visible: Column, required: Column, resolved: Column) -> Column:
    """Whether a further page is asked for with reason: the place is named in the task, or (not for a nearby search) some but not
    all of several planned places were seen, or some but not all of several required ones are resolved."""
    gap = lambda want, have: (want > 1) & (have > 0) & (have < want)
    return named | ((tool != "search_nearby") & (gap(planned, visible) | gap(required, resolved)))
