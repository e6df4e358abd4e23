"""Streams over finished rollout groups and trajectory events, with batch results as their truth."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def unseen(events: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """The rows of a stream whose key has not been seen within the delay."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def outcome_counts(events: DataFrame, time: str, outcome: str, width: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Counts of each outcome per window of event time."""
    w = events.withWatermark(time, delay).groupBy(F.window(time, width), outcome).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("window_start"), outcome, "n")


def no_signal_streaks(groups: DataFrame, run: str = "run", order: str = "grp", outcome: str = "outcome", counted: str = "zero_variance", reset: str = "usable") -> DataFrame:
    """(run, order, outcome, streak) of each finished group: the stateful form of runs.streaks.

    State is one number per run. A micro-batch's groups of a run are taken in their order; a group that comes in a later
    batch than its successors counts at its arrival.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(frames)).sort_values(order)
        streak, out = state.get[0] if state.exists else 0, []
        for o in pdf[outcome]:
            streak = 0 if o == reset else streak + (o == counted)
            out.append(streak)
        state.update((int(streak),))
        yield pdf.assign(streak=out)[[run, order, outcome, "streak"]]

    kinds = dict(groups.dtypes)
    schema = f"{run} {kinds[run]}, {order} {kinds[order]}, {outcome} string, streak long"
    return groups.groupBy(run).applyInPandasWithState(step, schema, "streak long", "append", GroupStateTimeout.NoTimeout)


def ingest(rows: DataFrame, fault, good_path: str, reject_path: str, checkpoint: str, trigger: dict):
    """Starts a stream that writes each micro-batch's valid rows and rejects to two tables. fault is a column: null for a valid
    row. Batches are written by their id as a partition and replace it, so that a batch that is run again adds nothing."""

    def put(batch: DataFrame, batch_id: int) -> None:
        marked = batch.withColumns({"fault": fault, "batch_id": F.lit(batch_id)}).persist()  # the source is read once
        for part, path in ((marked.filter("fault is null").drop("fault"), good_path), (marked.filter("fault is not null"), reject_path)):
            part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)
        marked.unpersist()

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**trigger).start()
