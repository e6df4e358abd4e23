"""The corpus pipeline: language ID, line dedup, near dedup, decontamination and mixing, each over all that is left.

Defined results: an empty table stays empty through all stages. Null, empty and letterless texts go in language ID; without
any labelled text, all others stay. Of a line on several rows the one with the smallest id keeps it, rows without an id come
last. Repeated rows are one document for near dedup. Rows with a null source are a source of their own in the mix. Columns
beyond those of documents pass through all stages; the last one replaces those that it adds. Only columns whose names begin
with an underscore may be dropped, where an operator has one of that name for itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymill.llm import common, decontam, langid, linededup, mixing, neardup


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language is found (no text, or no letter in it) go; without a labelled text nothing else does."""
    common.short_batches(spark)
    cols, new = docs.columns, common.free_names(docs, "lang_pred", "score")
    found = langid.identify(docs, docs.filter(~langid.held_out()), cols, names=new)
    return found.filter(~F.col(new[0]).eqNullSafe("und")).select(common.held(cols, found))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document of which no line is left goes with them."""
    common.short_batches(spark)
    cols, new = docs.columns, common.free_names(docs, *linededup.NEW)
    out = linededup.dedup_lines(docs, names=new).filter((F.col(new[2]) == 0) | (F.trim(new[0]) != ""))
    return out.withColumns({"text": F.col(new[0]), "n_chars": F.length(new[0]).cast("long")}).select(common.held(cols, out))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (SimHash within 4 bits, or 5-word Jaccard of 0.8 or more) one document stays.

    It is the one with the smallest id, and of different texts under that id the one with the smallest hash; a document
    without an id stays only if none of its group has one. Different texts of one id in different groups are judged each
    on its own. Rows with equal id and text are one document.
    """
    common.short_batches(spark)
    groups = neardup.components(docs)
    least = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("s"))
    # plain equalities only, so that the join's shuffle also serves the last step
    key = list(common.free_names(docs, "_none", "_id", "_own"))
    named = lambda df, i, h: df.withColumns(dict(zip(key, (F.isnull(i), F.coalesce(F.col(i).cast("string"), F.lit("")), h), strict=True)))
    stay = named(least.select("s.doc_id", "s.text_hash"), "doc_id", F.col("text_hash")).select(key).distinct()
    kept = named(docs, "doc_id", F.xxhash64(F.col("text").cast("string"))).join(stay, key, "left_semi").dropDuplicates(key)
    return kept.select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    common.short_batches(spark)
    cols, new = docs.columns, common.free_names(docs, *decontam.NEW)
    out = decontam.find_contaminated(docs, common.table(spark, sf_dir, "benchmark"), names=new)
    return out.filter(~F.col(new[-1])).select(common.held(cols, out))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its slot and place in the mixed order."""
    return mixing.mix(docs)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing to target weights", mix_sources),
]

#: SimHash components and the Pfair schedule have no form in DuckDB's SQL; tests/llm compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.staged(docs, f"stage{k}")
    return docs
