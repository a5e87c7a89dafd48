"""Token ids in binary shard files: each document a zstandard frame of its own under one shared dictionary.

A shard holds the frames of a range of documents in ascending doc_id order, then an index row for each document
(doc_id or null, offset, bytes, ids, and ids before it) and a footer with the index's place and the dictionary's hash. The manifest, a
table beside the shards, names the files of the tasks that succeeded with their counts, so a shard that a lost or
repeated task left behind is never read. Files are opened with pyarrow.fs, by the same URI on driver and executors.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions, shared_dir, ship, slices
from .tokens import default_tokenizer, encoder, with_end

MAGIC = b"STRDTOK2"
INDEX = np.dtype([("known", "<u1"), ("doc_id", "<i8"), ("offset", "<i8"), ("bytes", "<i8"), ("n_tokens", "<i8"), ("start", "<i8")])
#: The dictionary is trained on so many documents at most, on so many slices of each with so many ids, and has so many bytes at most.
SAMPLE_DOCS, SAMPLE_SLICES, SAMPLE_IDS, DICTIONARY_BYTES = 512, 8, 512, 65536
MANIFEST = "shard int, file string, n_docs long, n_tokens long, index_at long, dictionary_sha256 string"
DECODED = "doc_id long, start long, n_tokens long, ids_crc32 long"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def spaced(ids: np.ndarray) -> np.ndarray:
    """All ids, or SAMPLE_SLICES slices of SAMPLE_IDS each, evenly spaced."""
    if len(ids) <= SAMPLE_SLICES * SAMPLE_IDS:
        return ids
    starts = np.linspace(0, len(ids) - SAMPLE_IDS, SAMPLE_SLICES).astype(int)
    return ids[(starts[:, None] + np.arange(SAMPLE_IDS)).ravel()]


def train_dictionary(docs: DataFrame, tokenizer: str) -> bytes:
    """From the ids of a bounded sample: the SAMPLE_DOCS documents whose doc_id hashes lowest, evenly spaced slices of each.

    Without enough documents to train on, the sample itself serves, and for an empty table a fixed byte.
    """
    chosen = [r[0] for r in docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS).collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 4_000_000):
                ids, at = with_end(*encoder(tokenizer).encode(part.column("text")))
                own = [spaced(ids[a:b]).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(own, pa.binary())], ["doc_id", "ids"])

    sample = docs.where(F.col("doc_id").isin(chosen)).select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")
    ids = [bytes(r["ids"]) for r in sample.orderBy("doc_id", "ids").limit(2 * SAMPLE_DOCS).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, ids).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(ids)[:DICTIONARY_BYTES] or b"\0"


def write_token_files(docs: DataFrame, uri: str, tokenizer: str | None = None, shards: int | None = None) -> DataFrame:
    """Write docs (doc_id, text; other columns are ignored) to shard files under uri; returns the manifest.

    Null text is an empty document; null doc_ids come first; repeated doc_ids are documents of their own, by text.
    An empty table gives an empty manifest.
    """
    spark, path = docs.sparkSession, tokenizer or default_tokenizer()
    ship(spark)
    words = train_dictionary(docs, path)
    sha = hashlib.sha256(words).hexdigest()
    target, base = opened(uri)
    target.create_dir(base, recursive=True)
    with target.open_output_stream(f"{base}/{sha}.dictionary") as f:
        f.write(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, name = TaskContext.get().partitionId(), None
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(words))
        index, at, total = [], len(MAGIC), 0
        target, base = opened(uri)
        for batch in batches:
            for part in slices(batch, 4_000_000):
                if name is None:
                    name = f"{shard:06d}-{uuid.uuid4().hex}.tokens"
                    out = target.open_output_stream(f"{base}/{name}")
                    out.write(MAGIC)
                ids, bounds = with_end(*encoder(path).encode(part.column("text")))
                frames = [packer.compress(ids[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                out.write(b"".join(frames))
                doc = part.column("doc_id").cast(pa.int64())
                rows = np.zeros(len(frames), INDEX)
                rows["known"], rows["doc_id"] = np.asarray(doc.is_valid()), np.asarray(doc.fill_null(0))
                rows["bytes"], rows["n_tokens"] = [len(x) for x in frames], np.diff(bounds)
                rows["offset"] = at + np.cumsum(rows["bytes"]) - rows["bytes"]
                at, total = at + int(rows["bytes"].sum()), total + int(bounds[-1])
                index.append(rows)
        if name:
            rows = np.concatenate(index)
            rows["start"] = np.cumsum(rows["n_tokens"]) - rows["n_tokens"]
            out.write(rows.tobytes() + at.to_bytes(8, "little") + len(rows).to_bytes(8, "little") + bytes.fromhex(sha) + MAGIC)
            out.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "file": name, "n_docs": len(rows), "n_tokens": total, "index_at": at, "dictionary_sha256": sha}], pa.schema([("shard", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("index_at", pa.int64()), ("dictionary_sha256", pa.string())]))

    ordered = docs.select("doc_id", "text").repartitionByRange(shards or partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, MANIFEST).write.mode("overwrite").parquet(f"{uri}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{uri}/manifest")


def read_index(source: fs.FileSystem, file: str, at: int, first: int, n: int) -> np.ndarray:
    """n rows of a shard's index, which begins at `at`, from its row `first`; no others are read."""
    with source.open_input_file(file) as f:
        f.seek(at + first * INDEX.itemsize)
        return np.frombuffer(f.read(n * INDEX.itemsize), INDEX)


def read_token_files(spark: SparkSession, uri: str, block: int = 4096, keep_ids: bool = False) -> DataFrame:
    """The documents in the shard files, decoded in blocks of `block` by way of the index.

    start is the number of ids in all documents before one. keep_ids adds the ids themselves.
    """
    ship(spark)
    manifest = spark.read.schema(MANIFEST).parquet(f"{uri}/manifest")
    # a row for each shard, so the window over all of them is small
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    blocks = shards.select("*", F.explode(F.sequence(F.lit(0), (F.col("n_docs") - 1).cast("long"), F.lit(block).cast("long"))).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, base = opened(uri)
        unpackers: dict[str, zstandard.ZstdDecompressor] = {}
        for batch in batches:
            for r in batch.to_pylist():
                sha = r["dictionary_sha256"]
                if sha not in unpackers:
                    with source.open_input_stream(f"{base}/{sha}.dictionary") as f:
                        words = f.read()
                    if hashlib.sha256(words).hexdigest() != sha:
                        raise ValueError(f"the dictionary of {uri} is not the one its shards were written with")
                    unpackers[sha] = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words))
                own = read_index(source, f"{base}/{r['file']}", r["index_at"], r["first"], min(r["n_docs"] - r["first"], block))
                start = r["base"] + own["start"]
                with source.open_input_file(f"{base}/{r['file']}") as f:
                    f.seek(int(own["offset"][0]))
                    data = memoryview(f.read(int(own["bytes"].sum())))
                at = own["offset"] - own["offset"][0]
                ids = [unpackers[sha].decompress(data[a : a + n]) for a, n in zip(at.tolist(), own["bytes"].tolist(), strict=True)]
                cols = [pa.array(own["doc_id"], mask=own["known"] == 0), pa.array(start), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())]
                if keep_ids:
                    cols.append(pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    dealt = blocks.repartition(max(partitions(spark), 1), "shard", "first")
    return dealt.mapInArrow(run, DECODED + ", ids array<int>" * keep_ids)


def read_document(uri: str, file: str, row: int) -> np.ndarray:
    """One document's ids: two short reads by the index, without the rest of the shard."""
    source, base = opened(uri)
    with source.open_input_file(f"{base}/{file}") as f:
        f.seek(f.size() - 56)
        footer = f.read(56)
        at = int.from_bytes(footer[:8], "little") + row * INDEX.itemsize
        f.seek(at)
        own = np.frombuffer(f.read(INDEX.itemsize), INDEX)[0]
        f.seek(int(own["offset"]))
        frame = f.read(int(own["bytes"]))
    with source.open_input_stream(f"{base}/{footer[16:48].hex()}.dictionary") as f:
        words = zstandard.ZstdCompressionDict(f.read())
    return np.frombuffer(zstandard.ZstdDecompressor(dict_data=words).decompress(frame), "<u4")


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
