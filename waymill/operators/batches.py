"""Admission of new rows against all rows admitted before: several keys a row, batch after batch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymill.operators.components import checkpointed

SEEN = "key_name string, key string, batch long"


def key_filter(keys: DataFrame, bits: int = 1 << 23) -> DataFrame:
    """One row (words): a filter of so many bits (a power of two) in which each (key_name, key) sets four, built as joins and
    sums; its size is fixed, so it can be sent to all tasks."""
    at = keys.select(F.explode(F.array(*_places(bits))).alias("p"))
    words = at.groupBy(F.expr("p >> 6").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))
    every = keys.sparkSession.range(bits // 64).select(F.col("id").alias("w")).join(words, "w", "left")
    return every.agg(F.array_sort(F.collect_list(F.struct("w", F.coalesce("b", F.lit(0).cast("long")).alias("b")))).alias("a")).select(F.col("a.b").alias("words"))


def _places(bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(i), F.col("key_name"), F.col("key")), F.lit(bits)) for i in range(4)]


def _maybe(bits: int) -> Column:
    out = F.lit(True)
    for p in _places(bits):
        out = out & (F.shiftright(F.get("words", F.shiftright(p, 6)), 0).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(F.lit(63)).cast("int"))) != 0)
    return out


@dataclass
class Admission:
    verdicts: DataFrame  # id, accepted, reason: null, or what the row collides with
    seen: DataFrame  # all keys held now


def admit(rows: DataFrame, keys: dict[str, Column], id_col: str, order: Column, batch: int, seen: DataFrame | None = None, bits: int = 1 << 23) -> Admission:
    """Admits the rows of a batch one after the other (by order, then id): a row is accepted if none of its keys is held, by an
    earlier batch or by an accepted row before it, and then holds its keys.

    Only rows with a key that a filter of the earlier keys (of a fixed size) lets pass meet the earlier keys in a join. Inside the
    batch, rounds accept every open row that is the first open one of all of its keys, and reject those that share a key with
    it, until none is open: the outcome of going through them one by one. Running a batch again admits nothing more. Null keys
    collide with nothing; equal ids are one row (the first in order); reason is earlier:<key> or batch:<key>, the first by name.
    """
    named = F.array(*[F.struct(F.lit(k).alias("key_name"), F.md5(F.encode(c.cast("string"), "UTF-8")).alias("key")) for k, c in sorted(keys.items())])
    one = rows.select(F.col(id_col).alias("id"), F.struct(order.alias("o"), F.col(id_col).alias("i")).alias("ord"), named.alias("k"))
    one = checkpointed(one.groupBy("id").agg(F.min_by("k", "ord").alias("k"), F.min("ord").alias("ord")))
    keyed = one.select("id", "ord", F.explode("k").alias("k")).select("id", "ord", "k.*").filter("key is not null")
    earlier = None
    if seen is not None:
        likely = keyed.crossJoin(F.broadcast(key_filter(seen.select("key_name", "key"), bits))).filter(_maybe(bits)).drop("words")
        earlier = checkpointed(likely.join(seen.select("key_name", "key"), ["key_name", "key"], "left_semi").groupBy("id").agg(F.concat(F.lit("earlier:"), F.min("key_name")).alias("reason")))
    open_ = checkpointed(keyed.join(earlier, "id", "left_anti") if earlier is not None else keyed)
    accepted, rejected = [], [earlier] if earlier is not None else []
    bare = one.select("id", F.filter("k", lambda k: k["key"].isNotNull()).alias("k")).filter(F.size("k") == 0).select("id")
    while not open_.isEmpty():
        first = open_.groupBy("key_name", "key").agg(F.min("ord").alias("first"))
        led = open_.join(first, ["key_name", "key"])
        good = checkpointed(led.groupBy("id").agg(F.bool_and(F.col("ord") == F.col("first")).alias("g")).filter("g").select("id"))
        held = open_.join(good, "id", "left_semi").select("key_name", "key")
        rest = open_.join(good, "id", "left_anti")
        bad = checkpointed(rest.join(held, ["key_name", "key"], "left_semi").groupBy("id").agg(F.concat(F.lit("batch:"), F.min("key_name")).alias("reason")))
        accepted.append(good)
        rejected.append(bad)
        open_ = checkpointed(rest.join(bad, "id", "left_anti"))
    fine = bare
    for a in accepted:
        fine = fine.unionByName(a)
    verdicts = fine.select("id", F.lit(True).alias("accepted"), F.lit(None).cast("string").alias("reason"))
    for r in rejected:
        verdicts = verdicts.unionByName(r.select("id", F.lit(False).alias("accepted"), "reason"))
    new = keyed.join(fine, "id", "left_semi").select("key_name", "key", F.lit(batch).cast("long").alias("batch"))
    return Admission(verdicts, checkpointed(seen.unionByName(new)) if seen is not None else checkpointed(new))
