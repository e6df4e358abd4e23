"""The streak of rollout groups without a signal, as a stateful stream that remembers the last groups of the streak."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SCHEMA = "run {run}, grp {grp}, outcome string, streak long, stop boolean, history array<struct<grp:{grp},reward:double>>"


class _Streak(StatefulProcessor):
    def __init__(self, order_type: str, threshold: int):
        self.order_type, self.threshold = order_type, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.streak = handle.getValueState("streak", "n long")
        self.history = handle.getListState("history", f"grp {self.order_type}, reward double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("grp", kind="stable")
        streak = self.streak.get()[0] if self.streak.exists() else 0
        held = [tuple(h) for h in self.history.get()] if self.history.exists() else []
        out = []
        for grp, outcome, reward in zip(pdf["grp"].tolist(), pdf["outcome"].tolist(), pdf["reward"].tolist(), strict=True):
            if outcome == "usable":
                streak, held = 0, []
            elif outcome == "zero_variance":
                streak, held = streak + 1, [*held, (grp, None if pd.isna(reward) else reward)][-self.threshold :]
            out.append((key[0], grp, outcome, streak, streak >= self.threshold, [{"grp": g, "reward": r} for g, r in held]))
        self.streak.update((streak,))
        if held:
            self.history.put(held)
        elif self.history.exists():
            self.history.clear()
        yield pd.DataFrame(out, columns=["run", "grp", "outcome", "streak", "stop", "history"])

    def close(self) -> None:
        pass


def signal_streaks(groups: DataFrame, threshold: int = 10) -> DataFrame:
    """(run, grp, outcome, streak, stop, history) of every finished group of a stream: the length of its run's streak of
    zero_variance groups, whether the streak has reached the threshold, and the streak's last groups (threshold at most) with
    their shared rewards.

    groups: run, grp (a whole number, the order), outcome, reward. Usable groups end a streak; all others leave it as it is. State
    is a number and a list of threshold entries a run, kept by the checkpoint, so that a stopped stream goes on where it was.
    Groups that come in a later batch than their successors count at their arrival. The session's state store must be RocksDB
    (spark.sql.streaming.stateStore.providerClass).
    """
    kinds = dict(groups.dtypes)
    schema = SCHEMA.format(run=kinds["run"], grp=kinds["grp"])
    own = groups.select("run", "grp", "outcome", "reward")
    return own.groupBy("run").transformWithStateInPandas(_Streak(kinds["grp"], threshold), schema, "Append", "None")
