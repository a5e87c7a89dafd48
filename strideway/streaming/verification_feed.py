"""Verification records as a stream: each batch adds its latest records to a table, and a reader takes the latest of all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from strideway.operators.verify import latest

#: The batch that a compacted table begins with; those of a stream come after it.
COMPACTED = -1


def keep_latest(records: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Run the stream of valid, typed records; batch N writes the last record of each of its candidates to folder/batch=N.

    A batch reads and writes its own rows only, however much the table holds. One that is repeated after a failure writes its
    own part again.
    """

    def add(batch: DataFrame, number: int) -> None:
        latest(batch).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return records.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The latest record of each candidate over all batches: the last of the last ones, in whatever order they came."""
    return latest(spark.read.parquet(folder).drop("batch"))


def compact(spark: SparkSession, folder: str, target: str) -> None:
    """Write the current records as the first part of another table; a new stream may go on there."""
    current(spark, folder).write.mode("overwrite").parquet(f"{target}/batch={COMPACTED}")
