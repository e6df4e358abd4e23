"""Acceptance gates as a table: each gate is one row with its verdict, and all are evaluated in one aggregate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Gate:
    """A named aggregate. The verdict compares it with a bound; advice never decides on acceptance."""

    group: str
    name: str
    value: Column  # an aggregate that is a number, or a truth value
    relation: str = "is"  # is, eq, le, ge
    bound: float | None = None
    hard: bool = True


def gate_table(df: DataFrame, gates: list[Gate], by: list[str] = ()) -> DataFrame:
    """(by..., gate_group, gate, hard, value, bound, passed) with one row a gate, and a last row ``all``/``accepted``: all hard
    gates pass. A gate without a value (no rows, nulls alone) fails. Gates of one table share one scan and one aggregate."""
    aggregates = [g.value.cast("double").alias(f"v{k}") for k, g in enumerate(gates)]
    one = df.groupBy(*by).agg(*aggregates)
    value = lambda k: F.col(f"v{k}")
    verdict = {"is": lambda v, b: v == 1, "eq": lambda v, b: v == b, "le": lambda v, b: v <= b, "ge": lambda v, b: v >= b}
    passed = [F.coalesce(verdict[g.relation](value(k), F.lit(g.bound)), F.lit(False)) for k, g in enumerate(gates)]
    accepted = F.lit(True)
    for g, p in zip(gates, passed, strict=True):
        accepted = accepted & p if g.hard else accepted
    row = lambda group, name, hard, v, bound, p: F.struct(F.lit(group).alias("gate_group"), F.lit(name).alias("gate"), F.lit(hard).alias("hard"), v.alias("value"), F.lit(bound).cast("double").alias("bound"), p.alias("passed"))
    rows = [row(g.group, g.name, g.hard, value(k), g.bound, p) for k, (g, p) in enumerate(zip(gates, passed, strict=True))]
    rows.append(row("all", "accepted", True, accepted.cast("double"), None, accepted))
    return one.select(*by, F.explode(F.array(*rows)).alias("g")).select(*by, "g.*")


def policy_violations(trajectories: DataFrame, policies: DataFrame, audits: DataFrame, wanted: dict[str, object], most_steps: int = 50, most_run: int = 3) -> DataFrame:
    """A row a trajectory: task_id, policy_present, steps_fine, all_valid, runs_fine, audit_agrees, page_calls.

    trajectories: task_id, steps (how many), invalid, longest_run, page_calls. policies: task_id and the keys of wanted, each of
    which must have the wanted value. audits: task_id, max_valid_steps, max_run, page_calls, steps. A trajectory without a policy
    fails on it and is not held against it elsewhere; one without an audit disagrees with it.
    """
    p = policies.select("task_id", F.lit(True).alias("_has"), *[F.col(k).eqNullSafe(F.lit(v)).alias(f"_{k}") for k, v in wanted.items()])
    a = audits.select("task_id", F.struct("max_valid_steps", "max_run", "page_calls", "steps").alias("_audit"))
    present = F.coalesce("_has", F.lit(False))
    for k in wanted:
        present = present & F.coalesce(f"_{k}", F.lit(False))
    agrees = (F.col("_audit.max_valid_steps") == most_steps) & (F.col("_audit.max_run") == most_run) & (F.col("_audit.page_calls") == F.col("page_calls")) & (F.col("_audit.steps") == F.col("steps"))
    j = trajectories.join(p, "task_id", "left").join(a, "task_id", "left").withColumn("policy_present", present)
    open_ = lambda c: ~F.col("policy_present") | F.coalesce(c, F.lit(False))
    return j.select("task_id", "policy_present", open_(F.col("steps") <= most_steps).alias("steps_fine"), open_(F.col("invalid") == 0).alias("all_valid"), open_(F.col("longest_run") <= most_run).alias("runs_fine"), open_(agrees).alias("audit_agrees"), F.when(F.col("policy_present"), F.col("page_calls")).alias("page_calls"))
