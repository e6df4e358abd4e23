"""Connected components as joins, with checkpoints in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; a folder of this machine is set only under a local master."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir names no folder: set it to one that all executors share")
        context.setCheckpointDir(named or f"file://{tempfile.gettempdir()}/waymill-checkpoints")
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node of the edges; root is the least node that it reaches.

    Each round takes the least root of the neighbours and then the root's root, until no root changes.
    """
    both = checkpointed(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(b, a)).filter("u <> v").distinct())
    roots = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v")).select("node", F.least("node", "v").alias("root"))
    while True:
        roots = checkpointed(roots)
        near = both.join(roots.select(F.col("node").alias("v"), "root"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("near"))
        hooked = roots.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jumped = hooked.join(roots.select(F.col("node").alias("root"), F.col("root").alias("above")), "root", "left")
        new = checkpointed(jumped.select("node", "old", F.least("root", F.coalesce("above", "root")).alias("root")))
        if not new.filter("old <> root").limit(1).count():
            return new.select("node", "root")
        roots = new.select("node", "root")
