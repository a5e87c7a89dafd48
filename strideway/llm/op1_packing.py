"""Best-fit packing of documents into sequences of a fixed number of tokens.

The plan is made over counts, not over documents: how many pieces have each length. At most `capacity` counts reach the
driver, whatever the input is. Pieces then take the planned slots by their rank within their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets, fresh, ship, slices, stash
from .tokens import default_tokenizer, encoder, with_end

CAPACITY = 4096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLAN = "length long, rank_from long, rank_to long, first_sequence long, in_each long, at long"


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """Each document's ids with END_ID at the end, cut after every `capacity` ids.

    docs: doc_id and text; other columns are ignored. Null text counts as empty (one id); a null doc_id stays null.
    Repeated rows give repeated pieces. keep_ids adds the ids themselves.
    """
    path = tokenizer or default_tokenizer()
    ship(docs.sparkSession)
    schema = PIECES + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 4_000_000):
                ids, bounds = with_end(*encoder(path).encode(part.column("text")))
                n = np.diff(bounds)
                pieces = -(-n // capacity)
                k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = k * capacity
                length = np.minimum(np.repeat(n, pieces) - start, capacity)
                ends = np.cumsum(length)
                crc = [zlib.crc32(ids[b - m : b]) for b, m in zip(ends.tolist(), length.tolist(), strict=True)]
                doc = part.column("doc_id").cast(pa.int64()).take(pa.array(np.repeat(np.arange(len(n)), pieces)))
                out = [doc, pa.array(k, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if keep_ids:
                    out.append(pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.array(ids.view("<i4"))))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(out)])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def plan_best_fit(lengths: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, over how many pieces have each length.

    A row (length, rank_from, rank_to, first_sequence, in_each, at) places the pieces of these ranks within their length
    into sequences from first_sequence on, in_each to a sequence, the first of them at offset `at`. Sequences that are
    equally full are handled together, so the work follows the number of lengths, not of pieces.
    """
    space: dict[int, list[tuple[int, int]]] = {}  # by free places: (first sequence, how many)
    free: list[int] = []
    rows, unused = [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in space:
                insort(free, room)
            space.setdefault(room, []).append((first, n))

    for length in sorted(lengths, reverse=True):
        left, rank = lengths[length], 0
        while left:
            at = bisect_left(free, length)
            if at == len(free):  # none is free enough: open as many as the rest can fill
                n = max(1, left // (capacity // length))
                put(capacity, unused, n)
                unused += n
                continue
            room = free[at]
            first, n = space[room].pop()
            if not space[room]:
                del space[room], free[at]
            each = min(room // length, left)
            use = min(n, left // each)
            rows.append((length, rank, rank + use * each, first, each, capacity - room))
            put(room - each * length, first, use)
            put(room, first + use, n - use)
            left -= use * each
            rank += use * each
    return rows


def best_fit_pack(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """pieces with sequence_id and offset: the sequence that holds a piece and its place there.

    pieces: a length from 1 to capacity and the columns of `order`; all its columns are kept, whatever their names, but for its own
    sequence_id and offset, which are replaced. Its rows must be the same when read again (a written table). Rows that agree in
    `order` and length are alike, so either may take either slot. One length may belong to most pieces: ranks are counted in
    buckets of a length, which are laid end to end.
    """
    spark = pieces.sparkSession
    n_buckets = 2 * buckets(spark)
    bucket, rank, n, before = (fresh(pieces, f"_{c}") for c in ("bucket", "rank", "n", "before"))
    plan_columns = {c.split()[0]: fresh(pieces, f"_plan_{c.split()[0]}") for c in PLAN.split(", ")}
    dealt = pieces.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(n_buckets)).cast("int"))
    counts = stash(dealt.groupBy("length", bucket).agg(F.count("*").alias(n)), "length-counts")
    lengths = {r["length"]: r[n] for r in counts.groupBy("length").agg(F.sum(n).alias(n)).collect()}
    earlier = Window.partitionBy("length").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", bucket, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before))
    within = Window.partitionBy("length", bucket).orderBy(*order)
    ranked = dealt.withColumn(rank, F.row_number().over(within) - 1).join(counts.hint("merge"), ["length", bucket]).withColumn(rank, F.col(rank) + F.col(before))
    # the plan's rows follow the number of lengths, which capacity bounds
    plan = spark.createDataFrame(plan_best_fit(lengths, capacity), PLAN).withColumnsRenamed(plan_columns)
    p = {k: F.col(v) for k, v in plan_columns.items()}
    slot = F.col(rank) - p["rank_from"]
    return ranked.join(F.broadcast(plan), (F.col("length") == p["length"]) & (F.col(rank) >= p["rank_from"]) & (F.col(rank) < p["rank_to"])).select(
        *[c for c in pieces.columns if c not in ("sequence_id", "offset")],
        (p["first_sequence"] + F.floor(slot / p["in_each"])).cast("long").alias("sequence_id"),
        (p["at"] + F.pmod(slot, p["in_each"]) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """Documents as pieces with their places in sequences of at most `capacity` tokens; an empty table gives no rows."""
    return best_fit_pack(stash(token_pieces(docs, tokenizer, capacity, keep_ids), "pieces"), capacity)
