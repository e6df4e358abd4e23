"""Document fingerprints: bottom-k sketches of word-shingle hashes, with DataFrame functions alone.

A text is lower-cased and cut at white space; each run of ``width`` words is a shingle (a shorter text is one), hashed from
the hashes of its words. The sketch is the k smallest distinct hashes in ascending order. Sketches of parts merge into the
sketch of the whole: the k smallest of their union. Of two sketches, the k smallest of the union are a uniform sample of
the shingles of both texts: the share of them in both sketches estimates resemblance, the share of the first's hashes that
are in the second (below the larger of the sketches' reach) estimates containment, and the k-th smallest hash the number of
distinct shingles. Texts with k shingles or fewer have exact results.

Defined results: null is the empty text; a text without words has an empty sketch; two empty sketches have likeness 1, an
empty and another 0; equal texts have equal fingerprints; an empty table gives an empty result; a null doc_id comes last
in descending order; rows of one id, or of none, follow each other in the order of their text's hash. Ids are whole numbers;
a column of another type is refused.
"""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymill.llm.common import sha256_of, shuffle_parts, whole_numbers, with_columns_free

K, WIDTH = 128, 5


def sketch(text, k: int = K, width: int = WIDTH):
    """array<long>: the k smallest distinct shingle hashes."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    whole = lambda h: F.size(h) <= width
    each = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(width)]))
    # the word hashes are bound once, by a one-element array, as they are read several times
    bound = F.transform(F.array(hashes), lambda h: F.when(F.size(h) == 0, F.array().cast("array<bigint>")).when(whole(h), F.array(F.aggregate(h, F.lit(0).cast("bigint"), lambda a, x: F.xxhash64(a, x)))).otherwise(F.slice(F.array_sort(F.array_distinct(each(h))), 1, k)))
    return F.get(bound, F.lit(0))


def merged(a, b, k: int = K):
    """The sketch of two parts together."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def resemblance(a, b, k: int = K):
    u = merged(a, b, k)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u))


def containment(a, b, k: int = K):
    """The share of the first text's shingles that the second has too."""
    reach = F.least(*[F.when(F.size(s) < k, F.lit(2**63 - 1)).otherwise(F.element_at(s, -1)) for s in (a, b)])
    within = F.filter(a, lambda x: x <= reach)
    return F.when(F.size(within) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(within, b)) / F.size(within))


def distinct_shingles(a, k: int = K):
    last = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / last)


def as_text(a):
    return F.array_join(F.transform(a, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def merge_parts(parts: DataFrame, by: list[str], sketch_col: str = "sketch", k: int = K, fan_in: int = 256) -> DataFrame:
    """by and sketch_col: the sketch of all parts of each group.

    A tree of merges: in each round about fan_in sketches at most meet, so no task holds the sketches of a large group.
    """
    left = parts.select(*by, sketch_col).distinct()  # equal sketches add nothing
    most = left.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    merged_ = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(sketch_col, F.array().cast("array<bigint>")))))), 1, k).alias(sketch_col)
    rounds = 0
    while most > fan_in:
        salts, rounds = -(-most // (fan_in // 2)), rounds + 1
        left = left.withColumn("_salt", F.pmod(F.xxhash64(sketch_col, F.lit(rounds)), F.lit(salts))).groupBy(*by, "_salt").agg(merged_).drop("_salt")
        most = salts
    return left.groupBy(*by).agg(merged_)


def number_of_range(value, cuts: list[int]):
    """How many of the cuts (ascending) lie below the value.

    A grid over the cuts says how many lie in the cells before the value's; only those of its own cell are compared.
    """
    lo, hi, cells = float(cuts[0]), float(cuts[-1]), 4 * len(cuts)
    width = (hi - lo) / cells or 1.0
    cell = lambda v: min(cells - 1, max(0, math.floor((float(v) - lo) / width)))
    own = [0] * cells
    for c in cuts:
        own[cell(c)] += 1
    below = [0, *accumulate(own)][:-1]
    numbers = lambda x: F.array(*map(F.lit, x))
    at = F.floor(F.least(F.lit(cells - 1.0), F.greatest(F.lit(0.0), (value.cast("double") - F.lit(lo)) / F.lit(width)))).cast("int")
    first = F.get(numbers(below), at)
    return first + F.size(F.filter(F.slice(numbers(cuts), first + 1, F.get(numbers(own), at)), lambda c: c < value))


def cuts_of(df: DataFrame, col: str, parts: int) -> list[int]:
    """Values of col that cut the rows into about so many parts, the largest among them; few numbers."""
    own = df.filter(F.col(col).isNotNull())
    about = own.agg(F.percentile_approx(col, [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0]
    if not about:
        return []
    # percentiles are worked out in doubles: the cuts are the largest values that do not exceed them
    found = own.groupBy(number_of_range(F.col(col), sorted({int(x) for x in about})).alias("r")).agg(F.max(col).alias("c")).collect()
    return sorted(r.c for r in found)


def with_next(docs: DataFrame, id_col: str, carried: list[str], parts: int, tie: str) -> DataFrame:
    """Each row with ``_next``, the carried columns of the row that follows in descending id order (after the last: the first).

    The rows are cut into ranges at ids that the table holds (rows without an id, which come last, at ties that it holds), so
    the first row of a range is known by its id; the row after a range's last is found by a join on the range, and no order
    over all rows is needed in one task.
    """
    docs = docs.withColumns({"_id": F.col(id_col).cast("long"), "_none": F.col(id_col).isNull()})
    ids, ties = cuts_of(docs, "_id", parts), cuts_of(docs.filter("_none"), tie, parts)
    if not ids and not ties:
        return docs.withColumn("_next", F.struct(*carried)).drop("_id", "_none")
    # range r: with ids in descending order of the cuts, an id belongs to the smallest cut that is not below it; then those without an id, ascending
    none = F.lit(-1).cast("int")
    by_id = F.lit(len(ids) - 1) - number_of_range(F.col("_id"), ids) if ids else none
    by_tie = F.lit(len(ids)) + number_of_range(F.col(tie), ties[:-1]) if len(ties) > 1 else F.lit(len(ids))
    held = docs.withColumn("_range", F.when(F.col("_none"), by_tie).otherwise(by_id))
    order = Window.partitionBy("_range").orderBy(F.desc_nulls_last("_id"), tie)
    # a range of ids begins with a cut; one of ties may begin anywhere above the cut before
    some = held.filter(F.col("_id").isin(ids) | F.col("_none")) if ids else held
    first = some.groupBy("_range").agg(F.min_by(F.struct(*carried), F.col(tie)).alias("_first"))
    total = len(ids) + (max(1, len(ties)) if ties else 0)
    first = first.withColumn("_range", F.pmod(F.col("_range") - 1, F.lit(total)))
    seen = held.withColumn("_lead", F.lead(F.struct(*carried)).over(order)).join(first, "_range")
    return seen.withColumn("_next", F.coalesce("_lead", "_first")).drop("_lead", "_first", "_range", "_id", "_none")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """docs with sketch."""
    return with_columns_free(docs, "sketch").withColumn("sketch", sketch(F.col(text_col).cast("string"), k))


def query(docs: DataFrame, k: int = K) -> DataFrame:
    whole_numbers(docs, "doc_id")
    own = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = own.withColumns({"h": F.xxhash64("text"), "s": sketch(F.col("text"), k)})
    spark = docs.sparkSession
    next_ = with_next(own, "doc_id", ["text", "s"], 4 * shuffle_parts(spark), "h")
    half = F.expr("length(text) div 2").cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(length(text) div 2 as int))"), F.substring(F.col("_next.text"), F.lit(1), half))
    out = next_.select("doc_id", F.length("text").cast("long").alias("n_chars"), "s", F.col("_next.s").alias("t"), edited.alias("edited"))
    out = out.select("*", sketch(F.col("edited"), k).alias("e"))
    return out.select(
        "doc_id", "n_chars", sha256_of(F.col("edited")).alias("edited_sha256"), as_text("s").alias("fingerprint"), as_text("e").alias("edited_fingerprint"),
        resemblance(F.col("s"), F.col("e"), k).alias("near_edited"), resemblance(F.col("s"), F.col("t"), k).alias("near_next"),
    )
