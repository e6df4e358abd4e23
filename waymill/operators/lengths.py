"""Lengths of training samples in tokens: distributions, the share that counts for the loss, and samples that are too long."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymill.operators.runs import nearest_rank

QUANTILES = {"p50": 0.5, "p90": 0.9, "p99": 0.99}


def words(text: Column) -> Column:
    """The number of runs without white space: the counter without a tokenizer."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")).cast("long")


def tokenizer(build: Callable[[], Callable[[list[str]], list[int]]]) -> Callable[[Column], Column]:
    """A counter from a tokenizer: build gives, once in each task, a function from texts to their numbers of tokens."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = build()
        for texts in batches:
            yield pd.Series(own(texts.fillna("").tolist()), dtype="int64")

    return count


@dataclass
class LengthAudit:
    kept: DataFrame  # the samples within the limit, with sequence_tokens and loss_tokens
    quarantine: DataFrame  # the others, whole
    distributions: DataFrame  # mode, metric, n, min, mean, p50, p90, p99, max
    totals: DataFrame  # mode, samples, over_limit, sequence_tokens, loss_tokens, loss_ratio, masked_turns


def audit_lengths(messages: DataFrame, count: Callable[[Column], Column] = words, limit: int = 65_536, overhead: int = 0) -> LengthAudit:
    """messages: sample_id, mode, role, content, supervised (whether an assistant's turn counts for the loss).

    A sample is as long as its messages, with ``overhead`` tokens for each; loss tokens are those of the assistant's supervised
    turns, masked turns those of the assistant's others (also with a null). Samples above the limit go to quarantine and are never
    cut; distributions and totals are over all samples, by mode and for all together (mode null). Texts are tokenized once a
    message and summed by sample, so no task holds a sample; null contents have no tokens; a null mode is called
    none; loss_ratio is 0 without tokens.
    """
    assistant = F.col("role") == "assistant"
    on = F.coalesce(F.col("supervised"), F.lit(False))
    counted = messages.select("sample_id", F.coalesce("mode", F.lit("none")).alias("mode"), (count(F.col("content")) + overhead).alias("n"), F.coalesce(assistant & on, F.lit(False)).alias("loss"), F.coalesce(assistant & ~on, F.lit(False)).alias("masked"))
    samples = counted.groupBy("sample_id", "mode").agg(F.sum("n").alias("sequence_tokens"), F.sum(F.when(F.col("loss"), F.col("n")).otherwise(0)).alias("loss_tokens"), F.count(F.when(F.col("masked"), 1)).alias("masked_turns"))
    both = samples.withColumn("mode", F.explode(F.array("mode", F.lit(None).cast("string"))))
    long = both.select("mode", F.explode(F.create_map(F.lit("sequence_tokens"), "sequence_tokens", F.lit("loss_tokens"), "loss_tokens")).alias("metric", "tokens"))
    named = long.withColumn("mode", F.coalesce("mode", F.lit("\0")))
    spread = nearest_rank(named, "tokens", QUANTILES, ["mode", "metric"]).withColumn("mode", F.nullif("mode", F.lit("\0")))
    totals = both.groupBy("mode").agg(F.count("*").alias("samples"), F.count(F.when(F.col("sequence_tokens") > limit, 1)).alias("over_limit"), F.sum("sequence_tokens").alias("sequence_tokens"), F.sum("loss_tokens").alias("loss_tokens"), F.sum("masked_turns").alias("masked_turns"))
    totals = totals.withColumn("loss_ratio", F.coalesce(F.round(F.try_divide("loss_tokens", "sequence_tokens"), 6), F.lit(0.0)))
    return LengthAudit(samples.filter(F.col("sequence_tokens") <= limit), samples.filter(F.col("sequence_tokens") > limit), spread, totals)
