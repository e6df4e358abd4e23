"""A scenario laid over a catalogue: effects as data, and searches on what the scenario shows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymill.operators.comparisons import value_ranks


def apply_scenario(records: DataFrame, effects: DataFrame, on: list[str] = ("place_id",), fields: list[str] | None = None) -> DataFrame:
    """records without those that the scenario closes, with its new values.

    effects: the columns of on, kind, field, after (text), ord. Kinds unavailable and cancelled take the record away;
    field_override puts after, in the column's own type, in place of a field (the one with the highest ord, then text, if there
    are several; a null after makes it null). Other kinds, and fields that the records lack or that are not among ``fields``
    (default: all but on), do nothing. A text that is no value of the type gives a null. With a scenario's key among ``on``
    each scenario has records of its own.
    """
    on, fields = list(on), [c for c in (fields or records.columns) if c in records.columns and c not in on]
    gone = effects.filter(F.col("kind").isin("unavailable", "cancelled")).select(*on).distinct()
    changed = effects.filter((F.col("kind") == "field_override") & F.col("field").isin(*fields))
    last = [F.max_by(F.when(F.col("field") == c, F.struct(F.col("after").alias("v"))), F.when(F.col("field") == c, F.struct("ord", "after"))).alias(f"_new_{c}") for c in fields]
    new = changed.groupBy(*on).agg(*last)
    kinds = dict(records.dtypes)
    put = {c: F.when(F.col(f"_new_{c}").isNotNull(), F.col(f"_new_{c}.v").try_cast(kinds[c])).otherwise(F.col(c)) for c in fields}
    return records.join(gone, on, "left_anti").join(new, on, "left").withColumns(put).select(*records.columns)


def search_scenario(records: DataFrame, effects: DataFrame, group: list[str], on: list[str] = ("place_id",), low: float | None = None, high: float | None = None, by_price: bool = True, page: int = 10, step: float = 50.0) -> DataFrame:
    """apply_scenario's records within a price range, with rank and page in their group, by price (or by place_id).

    Filter and order see the scenario's prices, not the catalogue's. Without a price a record is outside of any range, and last
    in an order by price. Ranks are counted inside bands of the price.
    """
    seen = apply_scenario(records, effects, on)
    price = F.col("price").cast("double")
    if low is not None or high is not None:
        seen = seen.filter(price.isNotNull() & (price >= (low if low is not None else float("-inf"))) & (price <= (high if high is not None else float("inf"))))
    seen = seen.withColumn("_by", F.coalesce(price, F.lit(1e15)) if by_price else F.col("place_id").cast("double"))
    return value_ranks(seen, group, "_by", "place_id", step).withColumn("page", F.floor((F.col("rank") - 1) / page).cast("long")).drop("_by")


def task_page_index(tasks: DataFrame, places: DataFrame, page: int = 10, step: float = 50.0) -> DataFrame:
    """(task_id, place_id, variant, page, rank): where a task's entity stands in the search that the task states.

    tasks: task_id, place_id, variant, value. Variants: price (cheapest first), facet (value: a category), room_type (value: a
    number as text), named (value: part of a name), plain. places: place_id, kind, city, name, category, room_type, price.
    An entity outside of its variant's result has its place in the plain search, as the task's filter then says nothing of it;
    one that is no place has null. Places stand once in each variant that some task of their kind and city asks for, and all of
    these are ranked together, each group in bands of its order; no task is ranked on its own.
    """
    j = tasks.join(places.select("place_id", "kind", "city", "name", "category", "room_type"), "place_id", "left")
    meets = F.when(F.col("variant") == "facet", F.col("category") == F.col("value")).when(F.col("variant") == "room_type", F.col("room_type").cast("string") == F.col("value")).when(F.col("variant") == "named", F.contains("name", F.col("value"))).otherwise(F.col("variant").isin("price", "plain"))
    asked = F.when(F.coalesce(meets, F.lit(False)), F.struct("variant", F.when(F.col("variant").isin("price", "plain"), F.lit("")).otherwise(F.col("value")).alias("value"))).otherwise(F.struct(F.lit("plain").alias("variant"), F.lit("").alias("value")))
    own = j.select("task_id", "place_id", "kind", "city", F.col("variant").alias("stated"), asked.alias("v")).select("task_id", "place_id", "kind", "city", "stated", F.col("v.variant").alias("variant"), F.col("v.value").alias("value"))
    wanted = own.filter("kind is not null").select("kind", "city", "variant", "value").distinct()
    base = places.select("place_id", "kind", "city", "name", "price", F.explode(F.array(F.struct(F.lit("plain").alias("variant"), F.lit("").alias("value")), F.struct(F.lit("price").alias("variant"), F.lit("").alias("value")), F.struct(F.lit("facet").alias("variant"), F.col("category").cast("string").alias("value")), F.struct(F.lit("room_type").alias("variant"), F.col("room_type").cast("string").alias("value")))).alias("v"))
    held = base.select("place_id", "kind", "city", "price", "v.*").join(wanted.filter("variant <> 'named'"), ["kind", "city", "variant", "value"], "left_semi")
    names = wanted.filter("variant = 'named'")
    named = places.join(names, ["kind", "city"]).filter(F.contains("name", F.col("value"))).select("place_id", "kind", "city", "price", "variant", "value")
    order = F.when(F.col("variant") == "price", F.coalesce(F.col("price").cast("double"), F.lit(1e15))).otherwise(F.col("place_id").cast("double"))
    group = ["kind", "city", "variant", "value"]
    ranked = value_ranks(held.unionByName(named).withColumn("_by", order), group, "_by", "place_id", step).select("place_id", *group, "rank")
    out = own.join(ranked, ["place_id", *group], "left")
    return out.select("task_id", "place_id", F.col("stated").alias("variant"), F.floor((F.col("rank") - 1) / page).cast("long").alias("page"), F.col("rank").cast("long").alias("rank"))
