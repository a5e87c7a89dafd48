"""Connected components of a graph in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stash, stash


def components(edges: DataFrame) -> DataFrame:
    """v and c for each vertex of the edges (a, b): the smallest vertex that v is connected with.

    Each round takes the least label among the neighbours, then the label of that label, until nothing changes; the
    rounds grow with the logarithm of the longest path. The labels are written out each round. No edges give no rows.
    """
    both = stash(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b"), "edges")
    labels = stash(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("v")).alias("c")), "labels")
    while True:
        near = both.join(labels.hint("merge"), both["b"] == labels["v"]).groupBy(F.col("a").alias("v")).agg(F.min("c").alias("near"))
        lower = labels.join(near.hint("merge"), "v").select("v", F.least("c", "near").alias("c"), F.col("c").alias("was"))
        jump = labels.select(F.col("v").alias("c"), F.col("c").alias("to"))
        new = stash(lower.join(jump.hint("merge"), "c").select("v", F.least("c", "to").alias("c"), (F.least("c", "to") < F.col("was")).alias("changed")), "labels")
        changed = new.where("changed").limit(1).count()
        drop_stash(labels)
        labels = new
        if not changed:
            drop_stash(both)
            return labels.select("v", "c")
