"""Mixing of sources to target weights by Pfair scheduling.

The rows of a source are dealt, in a hashed order, into blocks of ``block_rows``. A source of weight w (its share, an exact
fraction) releases its block i (from 0) at slot floor(i / w) and has it due by slot ceil((i + 1) / w); each slot runs the
released block with the earliest deadline, so at every slot each source has had its share to less than one block.

All blocks are jobs of one slot on one machine, and the shares add up to 1, so earliest deadline first meets every deadline
(leaving out jobs of sources that have run out never hurts the others). The schedule is one run of it over exact whole
numbers: a table of one row a block, of ``most_blocks`` blocks at most (with more rows, blocks hold more of them), which one
task streams out with one waiting block a source in memory. Where all sources but some have run out, slots between their
releases stay empty, so that the others keep their proportions; no row is dropped or repeated.

Defined results: null sources are one source; ties in the hashed order fall by id and text hash; rows without an id are
dealt by their other columns; repeated rows keep their own places; an empty table gives an empty result; columns with the
names of the new ones are replaced, others pass through. Weights must be positive and finite (sources may be named that the
table lacks), a source without one gets the mean weight; shares whose slots pass 64 bits are refused, and so are more than
``most_sources`` sources: they are a table of the driver.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymill.llm.common import staged, with_columns_free

NEW = ("block", "slot", "release", "deadline", "place")


def shares(weights: dict, sources: list) -> list[Fraction]:
    """The exact share of each source; they add up to 1."""
    if bad := [k for k, w in weights.items() if not (math.isfinite(w) and w > 0)]:
        raise ValueError(f"weights must be positive and finite: {bad}")
    exact = {k: Fraction(w) for k, w in weights.items()}
    mean = sum(exact.values()) / len(exact)
    own = [exact.get(k, mean) for k in sources]
    return [w / sum(own) for w in own]


def schedule(w: list[Fraction], blocks: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """(source, block, slot, release, deadline) of all blocks, by slot: the released one with the earliest deadline; ties by source."""
    whole = math.lcm(*(x.denominator for x in w))
    part = [x.numerator * (whole // x.denominator) for x in w]
    if any(-(-n * whole // p) >= 1 << 63 for n, p in zip(blocks, part, strict=True)):
        raise ValueError("a share so small that its slots pass 64 bits")
    later = [(0, k, 0) for k in range(len(w)) if blocks[k]]
    ready: list[tuple[int, int, int, int]] = []
    t = 0
    while later or ready:
        if not ready and later[0][0] > t:
            t = later[0][0]
        while later and later[0][0] <= t:
            release, k, i = heapq.heappop(later)
            heapq.heappush(ready, (-(-(i + 1) * whole // part[k]), k, i, release))
        due, k, i, release = heapq.heappop(ready)
        yield k, i, t, release, due
        t += 1
        if i + 1 < blocks[k]:
            heapq.heappush(later, ((i + 1) * whole // part[k], k, i + 1))


def _plan(w: list[Fraction], blocks: list[int], at_once: int = 1 << 16):
    def run(batches):
        rows = schedule(w, blocks) if any(b.num_rows for b in batches) else iter(())
        while some := list(islice(rows, at_once)):
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*some, strict=True)], names=["_k", "block", "slot", "release", "deadline"])

    return run


def running(counts: DataFrame, coarse: int) -> DataFrame:
    """_start: the rows of a source in the buckets before; in two steps, so that no window holds all buckets of a source."""
    before = lambda part, by: Window.partitionBy(*part).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_c", F.floor(F.col("_b") / coarse))
    wide = counts.groupBy("_s", "_c").agg(F.sum("_n").alias("_m"))
    wide = wide.withColumn("_m", F.coalesce(F.sum("_m").over(before(["_s"], "_c")), F.lit(0)))
    own = F.coalesce(F.sum("_n").over(before(["_s", "_c"], "_b")), F.lit(0))
    return counts.withColumn("_own", own).join(wide, ["_s", "_c"]).select("_s", "_b", "_n", (F.col("_own") + F.col("_m")).alias("_start"))


def mix(docs: DataFrame, weights: dict | None = None, source_col: str = "source", id_col: str = "doc_id", tie_col: str = "text", block_rows: int = 16, seed: int = 1, bucket_rows: int = 512, power: float = 0.5, most_sources: int = 20_000, most_blocks: int = 1 << 22) -> DataFrame:
    """docs with block, slot, release, deadline (in slots) and place (within the block).

    weights: by source. Without any, the weights are the sources' sizes to the given power.
    """
    spark = docs.sparkSession
    docs = with_columns_free(docs, *NEW, "_h", "_b", "_n", "_s", "_k", "_parts", "_start", "_plan", "_at")
    sizes = docs.groupBy(F.col(source_col).alias("s")).count().limit(most_sources + 1).collect()  # one row a source
    if len(sizes) > most_sources:
        raise ValueError(f"over {most_sources} sources: mix by a coarser column")
    if not sizes:
        return docs.withColumns({c: F.lit(None).cast("long") for c in NEW})
    sizes = sorted(((r[0], r[1]) for r in sizes), key=lambda r: (r[0] is None, str(r[0])))
    w = shares(weights or {k: n**power for k, n in sizes}, [k for k, _ in sizes])
    block_rows = max(block_rows, -(-sum(n for _, n in sizes) // most_blocks))
    blocks = [-(-n // block_rows) for _, n in sizes]
    simple = [c for c, kind in docs.dtypes if not kind.startswith(("map", "array", "struct", "variant"))]
    # without an id, equal hashes are left to rows that are equal in all plain columns
    hashed = F.when(F.col(id_col).isNull(), F.xxhash64(F.lit(seed), *simple)).otherwise(F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)))
    known = spark.createDataFrame([(k, i, max(1, -(-n // bucket_rows))) for i, (k, n) in enumerate(sizes)], docs.select(F.col(source_col).alias("_src")).schema.add("_s", "integer").add("_parts", "long"))
    # the broadcast (one row a source, most_sources at most) leaves the rows where they are: windows are dealt by source and bucket, never by source alone
    span = F.shiftrightunsigned("_h", 33).cast("double") / F.lit(float(1 << 31))
    held = docs.withColumn("_h", hashed).join(F.broadcast(known), F.col(source_col).eqNullSafe(F.col("_src"))).drop("_src").withColumn("_b", F.floor(span * F.col("_parts")))
    starts = running(staged(held.groupBy("_s", "_b").agg(F.count("*").alias("_n")), "mixcounts"), 1024)
    plan = spark.range(1, numPartitions=1).mapInArrow(_plan(w, blocks), "_k long, block long, slot long, release long, deadline long")
    # the blocks that a bucket reaches into, in order: a few for each bucket
    reach = starts.withColumn("block", F.explode(F.sequence(F.floor(F.col("_start") / block_rows), F.floor((F.col("_start") + F.col("_n") - 1) / block_rows))))
    planned = reach.join(plan.withColumnRenamed("_k", "_s"), ["_s", "block"]).groupBy("_s", "_b").agg(F.first("_start").alias("_start"), F.array_sort(F.collect_list(F.struct("block", "slot", "release", "deadline"))).alias("_plan"))
    within = Window.partitionBy("_s", "_b").orderBy("_h", F.col(id_col), F.xxhash64(F.col(tie_col)))
    ranked = held.withColumn("_k", F.row_number().over(within) - 1).join(planned, ["_s", "_b"]).withColumn("_k", F.col("_k") + F.col("_start"))
    own = F.get("_plan", (F.floor(F.col("_k") / block_rows) - F.floor(F.col("_start") / block_rows)).cast("int"))
    return ranked.withColumn("_at", own).select(*docs.columns, *[F.col(f"_at.{c}").alias(c) for c in NEW[:4]], F.pmod("_k", F.lit(block_rows)).cast("long").alias("place"))


def query(docs: DataFrame) -> DataFrame:
    return mix(docs.select("doc_id", "source", F.xxhash64("text").alias("text"))).drop("text")
