"""What the operators of this subpackage share: tables, intermediate tables, words and hashes."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
#: Lists of so many keys at most are sent to all executors to pick rows by; longer ones meet the rows by shuffling.
BROADCAST_KEYS = 1_000_000
_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, wherever the driver found it, and keep Arrow batches short.

    Spark's 10,000 rows to a batch suit numbers; rows here are whole texts. A session's own setting stays.
    """
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    to = os.path.join(tempfile.mkdtemp(prefix="strideway-"), "strideway.zip")
    with zipfile.ZipFile(to, "w") as z:
        for folder, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    p = os.path.join(folder, n)
                    z.write(p, os.path.relpath(p, os.path.dirname(top)))
    sc.addPyFile(to)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which every executor sees; a local run without one gets its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="strideway-checkpoints-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder and read them back: it ends the lineage, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stash_path = path
    return out


def drop_stash(*frames: DataFrame) -> None:
    """Delete tables that stash() wrote and that nothing reads any more."""
    for df in frames:
        sc = SparkContext._active_spark_context
        path = sc._jvm.org.apache.hadoop.fs.Path(df.stash_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets(spark: SparkSession) -> int:
    """How many groups hashes are dealt into; it follows the number of shuffle partitions, which follows the input."""
    return max(64, partitions(spark))


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    return name


def parted(rows: DataFrame, lists: DataFrame, key: str = "print") -> tuple[DataFrame, DataFrame | None]:
    """The rows whose key is in lists, and the others, so that only the first need to meet the lists.

    The keys are broadcast where a count says that there are few; else the first are all rows, and the others None.
    """
    if lists.count() > BROADCAST_KEYS:
        return rows, None
    keys = F.broadcast(lists.select(key))
    return rows.join(keys, key, "left_semi"), rows.join(keys, key, "left_anti")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def n_words(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def slices(batch: pa.RecordBatch, most: int = 8_000_000, rows: int = 5000):
    """Parts of an Arrow batch of about `most` bytes, and of `rows` rows at most, so that copies stay small; a longer row is a part of its own."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_large_string(c.type):
            sizes += np.asarray(pc.fill_null(pc.binary_length(c), 0))
    ends = np.cumsum(sizes)
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, min(a + rows, int(np.searchsorted(ends, ends[a] - sizes[a] + most, "right"))))
        yield batch.slice(a, b - a)
        a = b


def column(batch: pa.RecordBatch, name: str) -> list:
    """A column as Python values; text as UTF-8 bytes, with null as empty."""
    c = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_string(c.type) or pa.types.is_large_string(c.type):
        return [x or b"" for x in c.cast(pa.large_binary() if pa.types.is_large_string(c.type) else pa.binary()).to_pylist()]
    return c.to_pylist()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), "<u8")


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values, so that high and low bits can both serve as hashes."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def rolled(h: np.ndarray, k: int, base: int = BASE) -> np.ndarray:
    """Hashes of every run of k neighbours of h, in order."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, "<u8")
    p = np.uint64(base)
    if k <= 8:
        out = h[:n].copy()
        for i in range(1, k):
            out *= p
            out += h[i : n + i]
        return mixed(out)
    # prefix sums of h[i] * p**i; a run's sum is brought to a common power by the inverse of p**start
    power = np.full(len(h), p, "<u8")
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    inverse = np.full(n, np.uint64(pow(base, -1, 1 << 64)), "<u8")
    inverse[0] = 1
    np.multiply.accumulate(inverse, out=inverse)
    sums = np.zeros(len(h) + 1, "<u8")
    np.cumsum(h * power, out=sums[1:])
    return mixed((sums[k:] - sums[:-k]) * inverse)
