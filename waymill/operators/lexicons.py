"""Names of a lexicon found in texts: one automaton over many names in place of an expression for each."""

from __future__ import annotations

from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The automata of this Python worker, by what they were built from; kept over its tasks.
_built: dict[int, ahocorasick.Automaton] = {}


def _automaton(shared) -> ahocorasick.Automaton:
    key = hash(shared.value)
    if key not in _built:
        _built.clear()
        a = _built[key] = ahocorasick.Automaton()
        for n in shared.value:
            a.add_word(n, n)
        a.make_automaton()
    return _built[key]


def _found(shared, keys: int):
    def run(batches):
        a = _automaton(shared)
        for b in batches:
            at, names, counts = [], [], []
            for i, text in enumerate(b.column(keys).to_pylist()):
                held: dict[str, int] = {}
                for _, n in a.iter(text or ""):
                    held[n] = held.get(n, 0) + 1
                at += [i] * len(held)
                names += held
                counts += held.values()
            rows = pa.RecordBatch.from_arrays(b.columns[:keys], names=b.schema.names[:keys]).take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(names, pa.string()), pa.array(counts, pa.int64())], names=[*rows.schema.names, "name", "n"])

    return run


def find_names(rows: DataFrame, names: DataFrame, keep: list[str], text_col: str, name_col: str = "name", most_bytes: int = 16 << 20) -> DataFrame:
    """(keep..., name, n): every distinct name of the lexicon that a row's text contains, and how often, overlaps included.

    The lexicon's size is summed up first: up to most_bytes it is one automaton, sent to the tasks once; a larger one is dealt by
    hash into automata of about that size, each with a pass of its own over the rows. Null and empty names are in no text, null
    texts hold none; comparison is by characters as they are. A row of the input gives its names on its own, also if repeated.
    """
    spark = rows.sparkSession
    lexicon = names.select(F.col(name_col).cast("string").alias("name")).filter("name <> ''").distinct()
    size = lexicon.agg(F.sum(F.octet_length("name") + 64)).first()[0] or 0
    src = rows.select(*keep, F.col(text_col).cast("string").alias("_text"))
    schema = src.select(*keep).withColumns({"name": F.lit(""), "n": F.lit(0).cast("long")}).schema
    shards = max(1, -(-size // most_bytes))
    parts = []
    for k in range(shards):
        own = lexicon.filter(F.pmod(F.xxhash64("name"), F.lit(shards)) == k) if shards > 1 else lexicon
        shared = tuple(sorted(r.name for r in own.collect()))  # about most_bytes
        if shared:
            parts.append(src.mapInArrow(_found(spark.sparkContext.broadcast(shared), len(keep)), schema))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def city_guard(tasks: DataFrame, lexicon: DataFrame, name_col: str = "name") -> DataFrame:
    """(task_id, introduced, removed, ok): names of the lexicon that a task's new text holds and its canonical text does not, and
    cities of the trip that the new text lost; both sorted. tasks: task_id, canonical, query, cities (array).

    A task_id is one task. Null texts hold no name; a task without cities loses none.
    """
    side = lambda c: find_names(tasks, lexicon, ["task_id"], c, name_col).select("task_id", "name").distinct()
    new = side("query").join(side("canonical"), ["task_id", "name"], "left_anti").groupBy("task_id").agg(F.array_sort(F.collect_list("name")).alias("introduced"))
    none = F.array().cast("array<string>")
    lost = F.array_sort(F.filter(F.coalesce("cities", none), lambda c: ~F.contains(F.coalesce("query", F.lit("")), c)))
    out = tasks.select("task_id", lost.alias("removed")).join(new, "task_id", "left").withColumn("introduced", F.coalesce("introduced", none))
    return out.select("task_id", "introduced", "removed", ((F.size("introduced") == 0) & (F.size("removed") == 0)).alias("ok"))


def catalogue_requirements(constraints: DataFrame, entities: DataFrame) -> DataFrame:
    """(task_id, entity_id, facet): the facet that justifies looking an entity up in the catalogue, by the task's first constraint
    (by ord) that gives one; null where none does.

    constraints: task_id, ord, kind, scope, values (array of texts), room_type. entities: task_id, entity_id, entity_type,
    category, hotel_type, room_type. Attractions and restaurants (scope alike): entity_category whose values hold the entity's
    category. Hotels (scope accommodation): entity_attribute of which a value lies within the hotel's type (the first such
    value in the order of the values), or room_type equal to the hotel's, told as beds:<n>. All values asked for are one lexicon,
    sought in the distinct types of hotels; pairs of constraint and entity then meet by plain equalities.
    """
    flat = constraints.select("task_id", "ord", "kind", "scope", "room_type", F.posexplode_outer("values").alias("place", "value")).withColumn("value", F.when(F.trim("value") != "", F.col("value")))
    fits = {"attraction": "attraction", "restaurant": "restaurant", "hotel": "accommodation"}
    scope = F.create_map(*[F.lit(x) for p in fits.items() for x in p])[F.col("entity_type")]
    e = entities.select("task_id", "entity_id", "entity_type", "category", "hotel_type", F.col("room_type").alias("own_room"), scope.alias("scope"))
    by_value = flat.filter("kind = 'entity_category'").select("task_id", "scope", "ord", "place", F.col("value").alias("category"))
    a = e.filter("entity_type in ('attraction', 'restaurant')").join(by_value, ["task_id", "scope", "category"]).select("task_id", "entity_id", "ord", "place", F.col("category").alias("facet"))
    asked = flat.filter("kind = 'entity_attribute' and scope = 'accommodation' and value is not null")
    types = e.filter("entity_type = 'hotel'").select("hotel_type").distinct()
    within = find_names(types, asked, ["hotel_type"], "hotel_type", "value").select("hotel_type", F.col("name").alias("value"))
    hotels = e.filter("entity_type = 'hotel'").select("task_id", "entity_id", "hotel_type", "own_room")
    b = hotels.join(within, "hotel_type").join(asked.select("task_id", "value", "ord", "place"), ["task_id", "value"]).select("task_id", "entity_id", "ord", "place", F.col("value").alias("facet"))
    rooms = flat.filter("kind = 'room_type' and scope = 'accommodation'").select("task_id", "ord", F.coalesce("place", F.lit(0)).alias("place"), F.col("room_type").alias("own_room"))
    c = hotels.join(rooms, ["task_id", "own_room"]).select("task_id", "entity_id", "ord", "place", F.concat(F.lit("beds:"), F.col("own_room").cast("string")).alias("facet"))
    first = a.unionByName(b).unionByName(c).groupBy("task_id", "entity_id").agg(F.min_by("facet", F.struct("ord", "place", "facet")).alias("facet"))
    return entities.select("task_id", "entity_id").join(first, ["task_id", "entity_id"], "left")
