"""Removal of repeated chunks of lines, with boundaries that the lines themselves choose.

A rolling hash over the hashes of a document's lines says where a boundary stands, wherever these lines are and whatever is around them.
A chunk goes from one boundary to the next and holds the lines of both: so it is chosen by its own lines alone, has two at
least, and the same lines make the same chunk in every document. One rule leaves every other short run between its boundaries, so
there are four: windows of one line (three times, by other hashes) and of two. A document's first and last lines are boundaries of
every rule.

A chunk that stands anywhere before (in a smaller doc_id, or further up) is removed: hashes pick candidates, and their bytes
decide. From the ends of a removed chunk the removal can be extended line by line, as far as the lines equal those around the
occurrence that stays.

Rows are told apart by doc_id and a hash of their text.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import column, drop_stash, fresh, mixed, parted, rolled, ship, slices, stash, word_hashes

#: The boundary rules: lines in the rolling hash, the mean distance of boundaries, and what tells rules with equal windows apart.
RULES = ((1, 2, 0x1), (1, 2, 0x1234567), (1, 2, 0x9999), (2, 2, 0xABCDEF))
KEY = ["doc_id", "print"]
CHUNK = "doc_id long, print long, first int, n int, h long, h2 long"
#: Lines that are compared on each side of a chunk at first; twice as many in each further round, for what is equal so far.
WINDOW = 4
AROUND = ", before array<binary>, after array<binary>"
KINDS = {"first": pa.int32(), "n": pa.int32(), "h": pa.int64(), "h2": pa.int64(), "chunk": pa.binary(), "before": pa.list_(pa.binary()), "after": pa.list_(pa.binary())}


def line_chunks(lines: list[bytes], rules: tuple[tuple[int, int, int], ...] = RULES) -> list[tuple[int, int]]:
    """(first line, lines) of the chunks of all rules, each once, in order."""
    hashes, out = word_hashes(lines), set()
    for width, spacing, salt in rules:
        ends = len(lines) - width + 1
        if ends > 1:
            hit = mixed(rolled(hashes, width) ^ np.uint64(salt)) % np.uint64(spacing) == 0
            hit[[0, -1]] = True
            at = np.flatnonzero(hit)
            out.update(zip(at[:-1].tolist(), (at[1:] + width - at[:-1]).tolist(), strict=True))
    return sorted(out)


def arrow_rows(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64() if n in KEY else KINDS[n] for n in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def hashed_chunks(docs: DataFrame) -> DataFrame:
    """Chunks with 128 bits of hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                n, found, prints = [], [], []
                for text in column(part, "text"):
                    lines = text.split(b"\n")
                    own = line_chunks(lines)
                    n.append(len(own))
                    found += own
                    prints += [xxhash.xxh3_128_digest(b"\n".join(lines[a : a + k])) for a, k in own]
                if found:
                    h, place = np.frombuffer(b"".join(prints), "<i8").reshape(-1, 2), np.array(found, np.int32)
                    own = [part.column(c).cast(pa.int64()).take(pa.array(np.repeat(np.arange(len(n)), n))) for c in KEY]
                    yield pa.RecordBatch.from_arrays([*own, *[pa.array(c.copy()) for c in (place[:, 0], place[:, 1], h[:, 0], h[:, 1])]], [*KEY, "first", "n", "h", "h2"])

    return docs.where("doc_id is not null").select(*KEY, "text").mapInArrow(run, CHUNK)


def around(lines: list[bytes], first: int, n: int, skip: int, size: int) -> tuple[list[bytes], list[bytes]]:
    """128-bit digests of `size` lines before a chunk, nearest first, and of as many after it, without the nearest `skip`."""
    end = first + n + skip
    sides = lines[max(0, first - skip - size) : max(0, first - skip)][::-1], lines[end : end + size]
    return tuple([hashlib.blake2b(x, digest_size=16).digest() for x in side] for side in sides)


def chunk_texts(docs: DataFrame) -> DataFrame:
    """docs: doc_id, print, text, chunks (first, n, h, h2); each chunk with its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc, print_, text, chunks in zip(*(column(part, c) for c in (*KEY, "text", "chunks")), strict=True):
                    lines = text.split(b"\n")
                    rows += [(doc, print_, c["first"], c["n"], c["h"], c["h2"], b"\n".join(lines[c["first"] : c["first"] + c["n"]])) for c in chunks]
                yield arrow_rows(rows, [*KEY, "first", "n", "h", "h2", "chunk"])

    return docs.select(*KEY, "text", "chunks").mapInArrow(run, CHUNK + ", chunk binary")


def farther(docs: DataFrame, skip: int, size: int) -> DataFrame:
    """docs: doc_id, print, text, places (first and n of chunks); digests of the lines around them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = []
                for doc, print_, text, places in zip(*(column(part, c) for c in (*KEY, "text", "places")), strict=True):
                    lines = text.split(b"\n")
                    rows += [(doc, print_, p["first"], p["n"], *around(lines, p["first"], p["n"], skip, size)) for p in places]
                yield arrow_rows(rows, [*KEY, "first", "n", "before", "after"])

    return docs.select(*KEY, "text", "places").mapInArrow(run, "doc_id long, print long, first int, n int" + AROUND)


def agreement(a: Column, b: Column) -> Column:
    """How many elements two arrays have in common from their beginnings."""
    n = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), F.lit(False))
    return F.when(n == 0, F.size(a)).otherwise(n - 1).cast("int")


def extended(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """doc_id, print, first and lines of removed chunks with the lines around them that equal those around the chunk that stays.

    gone: doc_id, print, first, n and keep (doc_id, print, first). Removed chunks that touch make a run; upwards its first chunk is
    compared with the one that stays for it, downwards the one that ends last. Whatever goes equals lines at a smaller place, so the
    first of equal lines stays. A side ends at an unlike line, an end of either document, or the next run; rounds with
    windows twice as long go on until every side has ended.
    """
    key, kept_key = [*KEY, "first", "n"], ["k_doc", "k_print", "k_first", "n"]
    end, by = F.col("first") + F.col("n"), Window.partitionBy(*KEY).orderBy("first", "n")
    rows = gone.select(*key, *[F.col(f"keep.{c}").alias(k) for c, k in zip(key[:3], kept_key[:3], strict=True)])
    rows = rows.withColumn("floor", F.coalesce(F.max(end).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)))
    rows = rows.withColumn("opens", F.col("first") > F.col("floor")).withColumn("run", F.sum(F.col("opens").cast("int")).over(by))
    rows = rows.withColumn("ceiling", F.min(F.when(F.col("opens"), F.col("first"))).over(by.rowsBetween(1, Window.unboundedFollowing)))
    rows = rows.withColumn("closes", F.row_number().over(Window.partitionBy(*KEY, "run").orderBy(end.desc(), "first")) == 1)
    rows = rows.withColumn("floor", F.greatest("floor", F.lit(0))).withColumns({"up": F.lit(0), "down": F.lit(0)}).drop("run")
    found, reached, size, used = [stash(rows, "reach")], 0, WINDOW, []
    while True:
        up = F.col("opens") & (F.col("up") == reached) & (F.col("first") - F.col("up") > F.col("floor"))
        down = F.col("closes") & (F.col("down") == reached) & (F.col("ceiling").isNull() | (end + F.col("down") < F.col("ceiling")))
        left = found[-1].where(up | down)
        if not left.limit(1).count():
            break
        places = left.select(*key).union(left.select(*kept_key)).distinct()
        places = stash(places.groupBy(*KEY).agg(F.collect_list(F.struct("first", "n")).alias("places")), "reach-places")
        sides = farther(parted(docs, places)[0].join(places.hint("shuffle_hash"), KEY), reached, size)
        sides = stash(sides.groupBy(*key).agg(F.min(F.struct("before", "after")).alias("s")), "reach-sides")
        kept = sides.select(*[F.col(c).alias(k) for c, k in zip(key, kept_key, strict=True)], F.col("s").alias("k"))
        met = left.join(sides.hint("merge"), key).join(kept.hint("merge"), kept_key)
        grown = [(F.col(c) + F.when(open_, agreement(F.col(f"s.{side}"), F.col(f"k.{side}"))).otherwise(0)).alias(c) for c, open_, side in (("up", up, "before"), ("down", down, "after"))]
        found.append(stash(met.select(*key, *kept_key[:3], *grown, "floor", "ceiling", "opens", "closes"), "reach"))
        used += [places, sides]
        reached, size = reached + size, 2 * (reached + size)
    # the next run bounds what a window holds beyond it
    first = F.greatest(F.col("first") - F.col("up"), F.least("first", "floor"))
    last = F.least(end + F.col("down"), F.when(F.col("ceiling").isNotNull(), F.greatest("ceiling", end)))
    out = [f.select(*KEY, first.alias("first"), (last - first).cast("int").alias("lines")) for f in found]
    out = stash(functools.reduce(DataFrame.unionByName, out), "extended")
    drop_stash(*found, *used)
    return out


def without_chunks(docs: DataFrame, keep_text: bool) -> DataFrame:
    """docs: doc_id, text and gone (first, lines, or null)."""
    schema = "doc_id long, n_lines long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nulls = np.asarray(batch.column(batch.schema.get_field_index("text")).is_null())
            at = 0
            for part in slices(batch):
                rows: tuple[list, ...] = ([], [], [], [])
                for text, gone in zip(column(part, "text"), column(part, "gone"), strict=True):
                    lines = [] if nulls[at] else text.split(b"\n")
                    drop = {i for g in gone or () for i in range(g["first"], g["first"] + g["lines"])}
                    out = b"\n".join([x for i, x in enumerate(lines) if i not in drop]) if drop else text
                    values = (len(lines), len(drop), hashlib.sha256(out).hexdigest(), None if nulls[at] else out.decode())
                    for r, v in zip(rows, values, strict=True):
                        r.append(v)
                    at += 1
                cols = [part.column("doc_id").cast(pa.int64()), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2]), pa.array(rows[3], pa.string())]
                yield pa.RecordBatch.from_arrays(cols[: 4 + keep_text], ["doc_id", "n_lines", "n_removed", "kept_sha256", "kept_text"][: 4 + keep_text])

    return docs.select("doc_id", "text", "gone").mapInArrow(run, schema)


def repeated_chunks(docs: DataFrame, extend: bool = True) -> DataFrame:
    """docs: doc_id, print, text. doc_id and print to gone, the chunks that stand before, as (first, lines); with extend, with
    the equal lines around them."""
    place = F.struct(*KEY, "first")
    # rows that are equal in all, doc_id too, are one
    chunks = stash(hashed_chunks(docs), "chunks")
    often = chunks.groupBy("h", "h2").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("h", "h2")
    # one chunk may stand in most documents: a merge join of written tables is split where it is hot
    often = stash(often, "repeated-hashes")
    candidates = chunks.join(often.hint("merge"), ["h", "h2"], "left_semi")
    candidates = stash(candidates.groupBy(*KEY).agg(F.collect_set(F.struct("first", "n", "h", "h2")).alias("chunks")), "candidates")
    found = parted(docs, candidates)[0].join(candidates.hint("shuffle_hash"), KEY)
    texts = stash(chunk_texts(found), "chunk-texts")
    same = stash(texts.groupBy("h", "h2", "chunk").agg(F.min(place).alias("keep")), "same-chunks")
    gone = texts.join(same.hint("merge"), ["h", "h2", "chunk"]).where(place != F.col("keep"))
    # a repeated row brings the same chunk once more
    gone = gone.groupBy(*KEY, "first", "n").agg(F.min("keep").alias("keep"))
    ranges = extended(docs, gone) if extend else gone.withColumn("lines", F.col("n"))
    gone = stash(ranges.groupBy(*KEY).agg(F.collect_set(F.struct("first", "lines")).alias("gone")), "gone")
    drop_stash(chunks, often, candidates, texts, same, *[ranges] * extend)
    return gone


def line_dedup(docs: DataFrame, keep_text: bool = True, extend: bool = True) -> DataFrame:
    """A row for each row of docs: doc_id, n_lines, n_removed, kept_sha256, and with keep_text kept_text.

    docs: doc_id and text; other columns are ignored. Lines end at \\n and are compared byte by byte. Of equal chunks the one
    with the smallest (doc_id, hash of the text, place) stays; with extend, the lines next to a removed chunk go too,
    as far as they equal those next to the one that stays (by 128 bits of digest). An empty text is one empty line; a null text has
    none, stays null, and hashes like an empty one. Rows that share a doc_id are documents of their own, but for those whose
    texts are equal too: they are one, and don't repeat each other. A null doc_id is not compared. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("print"))
    gone = repeated_chunks(rows, extend)
    hit, rest = parted(rows, gone)
    out = without_chunks(hit.join(gone.hint("shuffle_hash"), KEY, "left"), keep_text)
    return out if rest is None else out.unionByName(without_chunks(rest.withColumn("gone", F.lit(None).cast("array<struct<first:int,lines:int>>")), keep_text))


def line_dedup_texts(docs: DataFrame, extend: bool = True) -> DataFrame:
    """The rows of docs, with all their columns, and text without the chunks that stand before (see line_dedup)."""
    ship(docs.sparkSession)
    schema, print_, ranges = docs.schema, fresh(docs, "_print"), fresh(docs, "_gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                at = part.schema.get_field_index("text")
                texts, gone = part.column(at).to_pylist(), part.column(ranges).to_pylist()
                for i, g in enumerate(gone):
                    if g and texts[i] is not None:
                        drop = {k for x in g for k in range(x["first"], x["first"] + x["lines"])}
                        texts[i] = "\n".join([x for k, x in enumerate(texts[i].split("\n")) if k not in drop])
                part = part.drop_columns([ranges])
                yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

    gone = repeated_chunks(docs.select("doc_id", "text", F.xxhash64("text").alias("print")), extend)
    gone = gone.select(F.col("doc_id"), F.col("print").alias(print_), F.col("gone").alias(ranges))
    hit, rest = parted(docs.withColumn(print_, F.xxhash64("text")), gone, print_)
    out = hit.join(gone.hint("shuffle_hash"), ["doc_id", print_], "left").select(*docs.columns, ranges).mapInArrow(run, schema)
    return out if rest is None else out.unionByName(rest.select(*docs.columns))
