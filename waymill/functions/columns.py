"""Column functions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def to_number(c: Column) -> Column:
    """A number from dirty text: the text as a number, else the first number in it; NaN and infinities are null."""
    s = c.cast("string")
    n = F.coalesce(s.try_cast("double"), F.nullif(F.regexp_extract(s, r"-?\d+(?:\.\d+)?", 0), F.lit("")).try_cast("double"))
    return F.when(F.isnan(n) | (F.abs(n) == float("inf")), None).otherwise(n)


def to_number_strict(c: Column) -> Column:
    """As to_number, but text that is no number as a whole is null."""
    n = c.cast("string").try_cast("double")
    return F.when(F.isnan(n) | (F.abs(n) == float("inf")), None).otherwise(n)


def clock_minutes(c: Column, allow_24: bool = False) -> Column:
    """Minutes since midnight of HH:MM; null for what is no clock time. 24:00 only as an end."""
    part = lambda i: F.regexp_extract(c, r"^\s*(\d{1,2}):(\d{2})\s*$", i).try_cast("int")
    h, m = part(1), part(2)
    fine = (h <= 23) & (m <= 59)
    return F.when(fine | (F.lit(allow_24) & (h == 24) & (m == 0)), h * 60 + m)


def is_open(opens: Column, closes: Column, at: Column) -> Column:
    """Whether a place is open at a clock time; hours may cross midnight; bad text is closed."""
    o, c, q = clock_minutes(opens), clock_minutes(closes, True), clock_minutes(at)
    known = o.isNotNull() & c.isNotNull() & q.isNotNull()
    return known & F.coalesce(F.when(o <= c, (q >= o) & (q <= c)).otherwise((q >= o) | (q <= c)), F.lit(False))


def normalize_name(c: Column) -> Column:
    """Lower case, trimmed, runs of white space as one space."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def normalize_question(c: Column) -> Column:
    """Letters and digits alone, in lower case."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def stable_rank(seed: str, *parts: Column) -> Column:
    """SHA-256 of the seed and the parts, with a unit separator between: an order that any engine can reproduce."""
    return F.sha2(F.concat_ws("\x1f", F.lit(seed), *[p.cast("string") for p in parts]), 256)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def numeric_score(op: str, actual: Column, expected: Column) -> Column:
    """1 where the bound holds, else how near the value comes to it, from 0 to 1."""
    ratio = lambda a, b: F.when((a > 0) & (b > 0), F.least(a / b, F.lit(1.0))).otherwise(0.0)
    if op == "lte":
        return F.when(actual <= expected, 1.0).otherwise(ratio(expected, actual))
    if op == "gte":
        return F.when(actual >= expected, 1.0).otherwise(ratio(actual, expected))
    return F.when(actual == expected, 1.0).otherwise(ratio(F.least(actual, expected), F.greatest(actual, expected)))


def money(c: Column) -> Column:
    """Currency as a decimal of two places: sums do not depend on their order."""
    return c.cast("decimal(18,2)")
