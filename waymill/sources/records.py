"""Benchmark CSV files, folders of JSON records, and the tables and rows written from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymill.sources.jsonl import hidden_leaks


def literal_list(c: Column) -> Column:
    """An array of strings from a list literal, with single or double quotes; null if it is none."""
    quoted = r"""\s*(?:'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")\s*"""
    items = F.regexp_extract_all(c, F.lit(r"""('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")"""))
    plain = F.transform(items, lambda x: F.regexp_replace(F.substr(x, F.lit(2), F.length(x) - 2), r"\\(.)", "$1"))
    return F.when(c.rlike(rf"^\s*\[(?:{quoted}(?:,{quoted})*,?)?\s*\]\s*$"), plain)


def import_tasks(spark: SparkSession, path: str, hidden: list[str], ints: list[str] = (), flags: list[str] = (), lists: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(public, hidden) tables of a CSV of wide rows with a header: uid stays in both, the hidden columns in the second alone.

    A byte-order mark is dropped; ints that are none are null; flags are true for True in any case, false for False, else null;
    lists are list literals.
    """
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    df = df.toDF(*[c.removeprefix("﻿").strip() for c in df.columns])
    df = df.withColumns({c: F.trim(c).try_cast("int") for c in ints} | {c: F.when(F.lower(F.trim(c)) == "true", True).when(F.lower(F.trim(c)) == "false", False) for c in flags} | {c: literal_list(F.col(c)) for c in lists})
    return df.drop(*hidden), df.select("uid", *hidden)


def read_records(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """One row per file of the folder, each one JSON document; the file's number is the slot. Files without one are left out."""
    df = spark.read.schema(schema).json(f"{folder}/*.json", multiLine=True)
    slot = F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)\.json$", 1).try_cast("long")
    return df.withColumn("slot", slot).filter("slot is not null")


def fan_out(records: DataFrame, scalars: list[str], optional: list[str] = (), exploded: list[str] = (), key: str = "slot") -> dict[str, DataFrame]:
    """One table per named column: scalars for all rows, optional ones where they are not null, arrays one row an element.
    Plans only: write records once before, if they are dear to compute."""
    out = {c: records.select(key, c) for c in scalars}
    out |= {c: records.filter(F.col(c).isNotNull()).select(key, c) for c in optional}
    return out | {c: records.select(key, F.posexplode(c).alias("pos", c)) for c in exploded}


def sft_rows(samples: DataFrame, payloads: list[str], mask: str = "assistant_loss_mask") -> DataFrame:
    """Rows for a trainer: payload columns as JSON text, a missing mask as an empty array."""
    out = samples.withColumns({c: F.to_json(c) for c in payloads})
    return out.withColumn(mask, F.coalesce(mask, F.array().cast("array<int>"))) if mask in out.columns else out


def prompt_rows(public: DataFrame, scenarios: DataFrame, system: str, denied: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects). A row: uid, messages (system, user), scenario_id; uids that occur twice are rejected, all their rows.
    public: uid, query and more, none of which may be on the deny list; scenarios: uid, scenario_id."""
    held = hidden_leaks(public.limit(0), denied).first()["denied_columns"]
    if held:
        raise ValueError(f"hidden columns in the public table: {held}")
    counted = public.withColumn("_n", F.count("*").over(Window.partitionBy("uid")))
    msg = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    rows = counted.filter("_n = 1").join(scenarios.select("uid", "scenario_id"), "uid", "left")
    return rows.select("uid", F.array(msg("system", F.lit(system)), msg("user", F.col("query"))).alias("messages"), "scenario_id"), counted.filter("_n > 1").drop("_n")


def preview(samples: DataFrame, key: str, n: int = 10) -> DataFrame:
    """A report: of each class (repaired before had_invalid before clean) the n first samples, as text. samples: key, repaired,
    had_invalid, text."""
    kind = F.when(F.col("repaired"), "repaired").when(F.col("had_invalid"), "had_invalid").otherwise("clean")
    w = Window.partitionBy("kind").orderBy(key)
    return samples.withColumn("kind", kind).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).select("kind", "place", key, F.concat_ws("\n", F.concat(F.lit("# "), F.col(key).cast("string")), "text").alias("text"))


def table_fingerprint(df: DataFrame) -> DataFrame:
    """One row (n, xor, total): equal for tables of the same rows, repeats included, in any order and partitioning."""
    h = F.xxhash64(*df.columns)
    return df.agg(F.count("*").alias("n"), F.bit_xor(h).alias("xor"), F.sum(h.cast("decimal(38,0)")).alias("total"))
