"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of so many rows at most are sent to all executors where bounded() asks; longer ones meet the other side by a merge join.
FEW_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local run without one gets its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="strideway-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write the rows out once and read them back: what is used several times is computed once, and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def drop_staged(*frames: DataFrame) -> None:
    """Delete tables that staged() wrote, when nothing reads them any more."""
    for df in frames:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.staged_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def bounded(small: DataFrame, most: int = FEW_ROWS) -> DataFrame:
    """A written table as one side of a join: broadcast if a count says that it has few rows, else merged."""
    return F.broadcast(small) if small.limit(most + 1).count() <= most else small.hint("merge")
