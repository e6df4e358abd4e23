"""Tool responses cut down to what a model needs next: a projection for each tool, values kept with their JSON types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tools that answer with a page of items, and the fields that are kept of each kind of object.
SEARCHES = ("search_attractions", "search_restaurants", "search_restaurants_by_food", "search_hotels", "search_intercity_transport", "search_nearby")
PLACE = ("place_id", "entity_type", "city", "name", "price")
OF_TYPE = {"attraction": ("category", "open_time", "close_time"), "restaurant": ("cuisine", "open_time", "close_time"), "hotel": ("hotel_type", "room_type")}
DETAILS = ("recommended_min_hours", "recommended_max_hours")
TRANSPORT = ("transport_id", "mode", "source_id", "origin_city", "destination_city", "origin", "destination", "departure_time", "arrival_time", "cost", "train_type", "origin_anchor_id", "destination_anchor_id")
CANDIDATE = ("candidate_id", "entity_id", "entity_type", "name", "purpose", "note")
ROUTE = ("route_id", "origin_place_id", "destination_place_id", "mode")
PAGE = ("returned", "total", "next_cursor")


def _field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _text(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "string")


def _kept(v: Column, names: tuple[str, ...]) -> list[Column]:
    return [_field(v, n).alias(n) for n in names]


def _food_hint(v: Column) -> Column:
    parts = F.filter(F.transform(F.split(_text(v, "recommended_food"), "[,，、|/]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.get(parts, F.lit(0))


def _place(v: Column, detailed: bool = False) -> list[Column]:
    kind = _text(v, "entity_type")
    by = {n: [k for k, names in OF_TYPE.items() if n in names] for names in OF_TYPE.values() for n in names}
    own = [F.when(kind.isin(*kinds), _field(v, n)).alias(n) for n, kinds in by.items()]  # each field once, for the kinds that have it
    own += [F.when(kind == "attraction", _field(v, n)).alias(n) for n in DETAILS] if detailed else []
    return [*_kept(v, PLACE), *own, F.when(kind == "restaurant", _food_hint(v)).alias("recommended_food_hint"), _field(v, "distance_km").alias("distance_km")]


def _is_object(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("OBJECT")


def _candidate(v: Column) -> Column:
    return F.when(_is_object(v), F.struct(*_kept(v, CANDIDATE), _field(_field(v, "evidence"), "price").alias("price")))


def _json(*cols: Column) -> Column:
    return F.to_json(F.struct(*cols))


def compact_response(tool: Column, response: Column) -> Column:
    """The JSON text of a tool's response with the kept fields alone; absent fields are left out, and so is what should be an
    object and is none; a null, an empty object and an empty list stay. Numbers, texts, lists and objects keep their types. Of a search each item is a transport if it has a
    transport_id that is a text, else a place; of a route the times of its first and last segment stand for the segments.
    Responses of other tools stay as they are; a text that is no JSON object gives null."""
    v = F.try_parse_json(response)
    v = F.when(_is_object(v), v)
    items = F.coalesce(F.try_variant_get(v, "$.items", "array<variant>"), F.array().cast("array<variant>"))
    # one element of a list as JSON text, put together below: the two kinds of items have fields of their own
    item = lambda i: F.when(F.schema_of_variant(_field(i, "transport_id")) == "STRING", _json(*_kept(i, TRANSPORT))).otherwise(_json(*_place(i)))
    listed = lambda of: F.concat(F.lit("["), F.array_join(F.transform(F.filter(items, lambda i: _is_object(i)), of), ","), F.lit("]"))
    named = F.concat(F.lit('{"tool":'), F.to_json(F.struct(tool.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(tool.alias("v")))) - 6))
    segments = F.try_variant_get(v, "$.route.segments", "array<variant>")
    at = lambda k, n: F.when(F.size(segments) > 0, _field(F.element_at(segments, k), n))
    route = _field(v, "route")
    one = {
        SEARCHES: F.concat(named, F.lit(',"items":'), listed(item), F.lit(',"page":'), _json(*_kept(_field(v, "page"), PAGE)), F.lit("}")),
        ("save_candidate", "remove_candidate"): _json(tool.alias("tool"), _field(v, "status").alias("status"), _candidate(_field(v, "candidate")).alias("candidate")),
        ("list_candidates",): F.concat(named, F.lit(',"items":'), listed(lambda i: F.to_json(_candidate(i))), F.coalesce(F.concat(F.lit(',"count":'), F.to_json(_field(v, "count"))), F.lit("")), F.lit("}")),
        ("inspect_place",): _json(tool.alias("tool"), F.when(_is_object(_field(v, "item")), F.struct(*_place(_field(v, "item"), True))).alias("item")),
        ("get_route",): _json(tool.alias("tool"), F.when(_is_object(route), F.struct(*_kept(route, ROUTE), at(1, "start_time").alias("start_time"), at(-1, "end_time").alias("end_time"))).alias("route")),
        ("submit_plan",): _json(tool.alias("tool"), _field(v, "status").alias("status"), _field(v, "candidate_count").alias("candidate_count")),
    }
    out = F.lit(None).cast("string")
    for tools, text in one.items():
        out = F.when(tool.isin(*tools), text).otherwise(out)
    known = [t for tools in one for t in tools]
    return F.when(v.isNotNull(), F.when(tool.isin(*known), out).otherwise(response))
