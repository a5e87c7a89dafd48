"""Where a record stands in its file, for files that many tasks read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideway.sources.staging import bounded, staged


def located(rows: DataFrame) -> DataFrame:
    """Rows of a file source with the file, the part of it (its first byte) and a number that grows within a part.

    A part of a file is read by one task from beginning to end; the number is that task's own count, whatever other parts it reads.
    Filters before it are counted as gone, so blank rows can be left out first.
    """
    return rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_part"), F.monotonically_increasing_id().alias("_id"))


def numbered(rows: DataFrame, name: str = "row_number", first: int = 0) -> DataFrame:
    """Rows of a file source (or of located()) with their place in their own file, from `first`, as column `name`.

    The rows are written out with their parts before anything is counted, so a task that is repeated can't shift a number. A row's
    place is that in its part after all rows of earlier parts; only a row for each part is summed up.
    """
    own = rows if "_id" in rows.columns else located(rows)
    kept = staged(own, "located-rows")
    parts = kept.groupBy("_file", "_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_low"))
    before = Window.partitionBy("_file").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = staged(parts.select("_file", "_part", "_low", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), "file-parts")
    return kept.join(bounded(parts), ["_file", "_part"]).withColumn(name, F.col("_before") + F.col("_id") - F.col("_low") + first).drop("_file", "_part", "_id", "_low", "_before")
