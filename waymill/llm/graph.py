"""Connected components of a graph of any size, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymill.llm.common import staged


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the edges; root is the smallest node that can be reached.

    Each round takes the least root among the neighbours (summed up before the shuffle, so that a hub is no hot key),
    then jumps to the root's root, which halves the paths. Rounds end when no root changes.
    """
    both = staged(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(b, a)).filter("u <> v").distinct(), "edges")
    roots = staged(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least")).select("node", F.least("node", "least").alias("root")), "roots")
    while True:
        near = both.join(roots.select(F.col("node").alias("v"), F.col("root").alias("r")), "v").groupBy(F.col("u").alias("node")).agg(F.min("r").alias("r"))
        hooked = roots.join(near, "node", "left").select("node", F.col("root").alias("old"), F.least("root", F.coalesce("r", "root")).alias("root"))
        hooked = staged(hooked, "hooked")
        up = hooked.select(F.col("node").alias("root"), F.col("root").alias("above"))
        new = staged(hooked.join(up, "root", "left").select("node", "old", F.least("root", F.coalesce("above", "root")).alias("root")), "roots")
        if new.filter("old <> root").limit(1).count() == 0:
            return new.select("node", "root")
        roots = new.select("node", "root")
