"""Strict JSONL scans and guards for sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAD = "_corrupt_record"


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: T.StructType, key: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejects): blank lines are skipped; lines that are no JSON object of the schema, or lack the key, are rejected
    with their file and text."""
    lines = spark.read.text(paths).withColumn("file", F.col("_metadata.file_path")).filter(F.trim("value") != "")
    held = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    rows = lines.withColumn("r", F.from_json("value", held, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}))
    fault = F.when(F.col("r").isNull() | F.col(f"r.{BAD}").isNotNull() | ~F.ltrim("value").startswith("{"), "not_an_object").when(F.col(f"r.{key}").isNull(), "missing_key")
    rows = rows.withColumn("fault", fault)
    return rows.filter("fault is null").select(*[F.col(f"r.{f.name}").alias(f.name) for f in schema.fields]), rows.filter("fault is not null").select("file", "value", "fault")


def hidden_leaks(df: DataFrame, denied: list[str], json_cols: list[str] = ()) -> DataFrame:
    """One row: columns of the deny list, and for each JSON column the rows whose top-level keys meet it."""
    held = [c for c in df.columns if c.lower() in {d.lower() for d in denied}]
    leaks = [F.count(F.when(F.arrays_overlap(F.coalesce(F.json_object_keys(c), F.array().cast("array<string>")), F.array(*map(F.lit, denied))), 1)).alias(f"leaks_{c}") for c in json_cols]
    return df.agg(F.array(*map(F.lit, held)).cast("array<string>").alias("denied_columns"), F.count("*").alias("n"), *leaks)
