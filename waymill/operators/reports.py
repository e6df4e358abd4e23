"""Audit and split reports: rules for single actions, families, data sets, behaviour, and leaks between parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymill.operators.gates import Gate, gate_table
from waymill.operators.runs import nearest_rank

# The words of a price, of a comparison, and for taking a candidate away.
PRICE_TERMS = ("价格", "标价", "价钱", "费用", "成本", "人均")
COMPARISON_TERMS = ("高于", "低于", "更高", "更低", "更贵", "更便宜", "成本优势")
REMOVAL = "移除"
# The radii and the number of results that a search around a place may ask for.
RADII = (2, 5, 10, 20, 50)
TOP_K = 40
QUANTILES = {"p50": 0.5, "p90": 0.9}


def price_comparison(text: Column, price: tuple[str, ...] = PRICE_TERMS, comparison: tuple[str, ...] = COMPARISON_TERMS, removal: str = REMOVAL) -> Column:
    """Whether a text gives a price and a comparison as the reason for a removal; false for null."""
    holds = lambda terms: F.exists(F.array(*map(F.lit, terms)), lambda x: F.contains(text, x))
    return F.coalesce(holds(price) & holds(comparison) & F.contains(text, F.lit(removal)), F.lit(False))


def is_coarse(at: Column) -> Column:
    """Whether a time is a full hour, every third from 00:00 to 21:00, written HH:MM; false for null."""
    hour = F.substring(at, 1, 2).try_cast("int")
    return F.coalesce(at.rlike("^[0-9]{2}:00$") & (hour <= 21) & (hour % 3 == 0), F.lit(False))


def action_violations(steps: DataFrame) -> DataFrame:
    """(task_id, violation, n): how often a trajectory's actions break a rule.

    steps: task_id, step, tool, entity_id, at_time, radius, top_k, content. Transport is searched from coarse times, places
    around another within the known radii and for TOP_K results; a candidate is removed only after a save of it, right after a
    review of the list, and with a price as the reason. Missing arguments break their rule; tasks without a violation have no row.
    """
    w = Window.partitionBy("task_id").orderBy("step")
    saved = F.max(F.when(F.col("tool") == "save_candidate", 1)).over(Window.partitionBy("task_id", "entity_id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1))
    j = steps.withColumns({"_last": F.lag("tool").over(w), "_saved": saved})
    tool = F.col("tool")
    removed = tool == "remove_candidate"
    rules = {
        "coarse_time": (tool == "search_intercity_transport") & ~is_coarse(F.col("at_time")),
        "radius": (tool == "search_nearby") & ~F.coalesce(F.col("radius").isin(*RADII), F.lit(False)),
        "top_k": (tool == "search_nearby") & ~F.coalesce(F.col("top_k") == TOP_K, F.lit(False)),
        "removed_unsaved": removed & (F.col("_saved").isNull() | F.col("entity_id").isNull()),
        "removed_unreviewed": removed & ~F.coalesce(F.col("_last") == "list_candidates", F.lit(False)),
        "removed_without_price": removed & ~price_comparison(F.col("content")),
    }
    broken = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]))
    return j.select("task_id", F.explode(broken).alias("violation")).groupBy("task_id", "violation").agg(F.count("*").alias("n"))


def family_report(trajectories: DataFrame) -> DataFrame:
    """(family, n, min, mean, p50, p90, max of steps, unique_share of questions, warnings, example): one row a family; the example
    is its trajectory with the smallest task_id. trajectories: task_id, family, steps, question, warnings."""
    spread = nearest_rank(trajectories, "steps", QUANTILES, ["family"]).withColumnRenamed("n", "_n")
    own = trajectories.groupBy("family").agg(F.count("*").alias("n"), F.round(F.countDistinct("question") / F.count("*"), 6).alias("unique_share"), F.sum(F.coalesce("warnings", F.lit(0))).alias("warnings"), F.min_by(F.struct("task_id", "question", "steps"), "task_id").alias("example"))
    return own.join(spread.drop("_n"), "family", "left")


def dataset_report(samples: DataFrame, calls: DataFrame) -> DataFrame:
    """(section, name, n, supervised): samples by mode, calls by tool, and totals. samples: sample_id, mode; calls: sample_id,
    tool, supervised."""
    count = F.count("*").alias("n")
    on = F.count(F.when(F.col("supervised"), 1)).alias("supervised")
    none = F.lit(None).cast("long").alias("supervised")
    row = lambda df, section, name: df.select(F.lit(section).alias("section"), name.alias("name"), "n", "supervised")
    parts = [row(samples.groupBy("mode").agg(count).withColumn("supervised", none), "mode", F.coalesce("mode", F.lit("none"))), row(calls.groupBy("tool").agg(count, on), "tool", F.col("tool"))]
    parts += [row(samples.agg(count).withColumn("supervised", none), "total", F.lit("samples")), row(calls.agg(count, on), "total", F.lit("calls"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def behaviour_table(trajectories: DataFrame, ends: list[str]) -> DataFrame:
    """(model, n, mean, p90, one share for each end): steps and how trajectories of a model end. trajectories: model, steps,
    ended."""
    spread = nearest_rank(trajectories, "steps", {"p90": 0.9}, ["model"]).select("model", F.round("mean", 4).alias("mean"), "p90")
    shares = [F.round(F.count(F.when(F.col("ended") == e, 1)) / F.count("*"), 6).alias(f"share_{e}") for e in ends]
    return trajectories.groupBy("model").agg(F.count("*").alias("n"), *shares).join(spread, "model", "left")


def split_gates(whole: DataFrame, parts: DataFrame, id_col: str, hash_col: str) -> DataFrame:
    """The gate table of a split: ids and semantic hashes are unique in the whole, no id and no hash is in two parts, and the parts
    hold all ids of the whole and no others. parts: id_col, hash_col, part. A null id or hash is one value like any other."""
    every = whole.select(F.col(id_col).alias("i"), F.col(hash_col).alias("h"), F.lit("").alias("part")).unionByName(parts.select(F.col(id_col).alias("i"), F.col(hash_col).alias("h"), "part"))
    in_whole, held = F.count(F.when(F.col("part") == "", 1)).alias("whole"), F.countDistinct(F.when(F.col("part") != "", F.col("part"))).alias("parts")
    by = lambda c, kind: every.groupBy(c).agg(in_whole, held).select(F.lit(kind).alias("kind"), "whole", "parts")
    j = by("i", "id").unionByName(by("h", "hash"))
    bad = lambda kind, c: F.count(F.when((F.col("kind") == kind) & c, 1))
    gates = [Gate(kind, f"repeated_{kind}", bad(kind, F.col("whole") > 1), "eq", 0) for kind in ("id", "hash")]
    gates += [Gate(kind, f"{kind}_in_two_parts", bad(kind, F.col("parts") > 1), "eq", 0) for kind in ("id", "hash")]
    gates += [Gate("union", "in_no_part", bad("id", (F.col("whole") > 0) & (F.col("parts") == 0)), "eq", 0), Gate("union", "not_in_the_whole", bad("id", (F.col("whole") == 0) & (F.col("parts") > 0)), "eq", 0)]
    return gate_table(j, gates)


def alignment_gates(records: DataFrame, requested: int, quotas: dict[str, dict[str, int]], rates: dict[str, float]) -> DataFrame:
    """The gate table of a batch: as many records as requested, all of reward 1, no repeated id or question, none reused from
    earlier batches, each rate (the share of a true column) within its limit, and each quota (column, value, number) met exactly.

    records: record_id, question, reward, reused, and the columns of quotas and rates. Nulls count for no quota and no rate.
    """
    share = lambda c: F.count(F.when(F.col(c), 1)) / F.count("*")
    gates = [
        Gate("count", "requested", F.count("*"), "eq", requested), Gate("reward", "not_rewarded", F.count(F.when(~F.coalesce(F.col("reward") == 1, F.lit(False)), 1)), "eq", 0),
        Gate("unique", "repeated_ids", F.count("record_id") - F.countDistinct("record_id"), "eq", 0), Gate("unique", "repeated_questions", F.count("question") - F.countDistinct("question"), "eq", 0), Gate("reuse", "reused", F.count(F.when(F.col("reused"), 1)), "eq", 0),
        *[Gate("rate", c, share(c), "le", most) for c, most in rates.items()], *[Gate("quota", f"{c}:{v}", F.count(F.when(F.col(c) == v, 1)), "eq", n) for c, own in quotas.items() for v, n in own.items()],
    ]
    return gate_table(records, gates)
