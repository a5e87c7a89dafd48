"""Ranks over a whole table, without one task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideway.sources.staging import bounded, staged


def positions(rows: DataFrame, order: list[Column], name: str = "rank", first: int = 1, by: list[str] = ()) -> DataFrame:
    """rows with their position in a total order, from `first`; with `by`, in each of a few groups.

    The rows are dealt into ranges of the order, counted there, and each range begins after all before it; only a row for each range
    is summed up, and for each group its first position. The order should tell all rows apart: equal rows take neighbouring positions in any order. An empty table gives none.
    """
    order = [*map(F.col, by), *order]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = staged(dealt.select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_id")), "ranges")
    ranges = kept.groupBy("_range").agg(F.count("*").alias("_n"), F.min("_id").alias("_low"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = staged(ranges.select("_range", "_low", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), "range-starts")
    out = kept.join(bounded(ranges), "_range").withColumn(name, F.col("_before") + F.col("_id") - F.col("_low") + first).drop("_range", "_id", "_low", "_before")
    if not by:
        return out
    starts = staged(out.groupBy(*by).agg((F.min(name) - first).alias("_start")), "group-starts")
    return out.join(bounded(starts), list(by)).withColumn(name, F.col(name) - F.col("_start")).drop("_start")
