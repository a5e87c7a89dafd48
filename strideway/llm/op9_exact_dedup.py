"""Exact deduplication against an index of the digests seen before.

The index is a table of buckets. Each holds a minimal perfect hash over its distinct digests and, in the slots that the
hash numbers, the full digests with their winners' ids and counts. A lookup finds the slot and compares all 32 bytes, so
what is not in the index is told from what is. Rows are reduced to one for each digest before they are dealt to buckets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, buckets, ship, stash

INDEX = "bucket int, bits array<binary>, digests binary, winners binary, counts binary"
CLASSES = "digest binary, winner long, size long, seen boolean"
#: Places for each key of a level of the perfect hash.
SPREAD = 2
#: The winner where all doc_ids are null.
NONE = -(2**63)


def text_digest(text: Column) -> Column:
    """SHA-256 of the text with A-Z lower-cased; null counts as empty."""
    return F.unhex(F.sha2(F.encode(ascii_lower(F.coalesce(text, F.lit(""))), "utf-8"), 256))


def places(keys: np.ndarray, level: int, n: int) -> np.ndarray:
    """Where each key (four 64-bit words of a digest) falls in a level of n bits."""
    h = (keys[:, 0] ^ (keys[:, 1] * np.uint64(2 * level + 1))) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(29)) ^ keys[:, 2]) % np.uint64(n)).astype(np.int64)


def build_levels(keys: np.ndarray) -> list[np.ndarray]:
    """Bit arrays of a minimal perfect hash over distinct keys: those alone in their place stay in a level, the rest go on."""
    levels = []
    while len(keys):
        n = SPREAD * len(keys)
        at = places(keys, len(levels), n)
        alone = np.bincount(at, minlength=n) == 1
        levels.append(alone)
        keys = keys[~alone[at]]
    return levels


def slots(keys: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """The number of each key, 0 to keys - 1 without gaps; anything, or -1, for a key that the hash was not built over."""
    out = np.full(len(keys), -1, np.int64)
    base, open_ = 0, np.arange(len(keys))
    for level, bits in enumerate(levels):
        at = places(keys[open_], level, len(bits))
        hit = bits[at]
        out[open_[hit]] = base + np.cumsum(bits)[at[hit]] - 1
        base, open_ = base + int(bits.sum()), open_[~hit]
    return out


def as_keys(digests) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, digests)), "<u8").reshape(-1, 4)


def by_digest(rows: DataFrame) -> DataFrame:
    """doc_id and digest as one row for each digest: the largest doc_id and the number of rows."""
    return rows.groupBy("digest").agg(F.coalesce(F.max("doc_id"), F.lit(NONE)).alias("winner"), F.count("*").alias("size"))


def in_buckets(classes: DataFrame, n: int) -> DataFrame:
    return classes.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(n)).cast("int"))


def build_index(classes: DataFrame) -> DataFrame:
    """digest, winner and size, a row for each digest, as an index."""
    ship(classes.sparkSession)

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        keys = as_keys(rows["digest"])
        levels = build_levels(keys)
        order = np.argsort(slots(keys, levels))
        winners = rows["winner"].to_numpy("<i8")
        # packed bits after their number
        bits = [len(b).to_bytes(8, "little") + np.packbits(b).tobytes() for b in levels]
        return pd.DataFrame({"bucket": [rows["bucket"].iloc[0]], "bits": [bits], "digests": [keys[order].tobytes()], "winners": [winners[order].tobytes()], "counts": [rows["size"].to_numpy("<i8")[order].tobytes()]})

    return in_buckets(classes, buckets(classes.sparkSession)).groupBy("bucket").applyInPandas(build, INDEX)


def update_index(index: DataFrame, classes: DataFrame) -> DataFrame:
    """Classes after new rows: of members, nonmembers, and digests that no new row has. seen: it was in the index."""
    ship(classes.sparkSession)

    def look_up(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        keys = as_keys(new["digest"])
        winners, sizes = new["winner"].to_numpy("<i8"), new["size"].to_numpy("<i8")
        if not len(old):
            return pd.DataFrame({"digest": list(map(bytes, new["digest"])), "winner": winners, "size": sizes, "seen": False})
        held = np.frombuffer(old["digests"].iloc[0], "<u8").reshape(-1, 4)
        first, count = np.frombuffer(old["winners"].iloc[0], "<i8").copy(), np.frombuffer(old["counts"].iloc[0], "<i8").copy()
        levels = [np.unpackbits(np.frombuffer(b[8:], np.uint8), count=int.from_bytes(b[:8], "little")).astype(bool) for b in map(bytes, old["bits"].iloc[0])]
        at = slots(keys, levels)
        found = (at >= 0) & (held[at] == keys).all(axis=1)
        np.maximum.at(first, at[found], winners[found])
        np.add.at(count, at[found], sizes[found])
        rest = np.flatnonzero(~found)
        old_digests = old["digests"].iloc[0]
        digests = [*(old_digests[i : i + 32] for i in range(0, len(old_digests), 32)), *(new["digest"].iloc[i] for i in rest)]
        return pd.DataFrame({"digest": digests, "winner": np.r_[first, winners[rest]], "size": np.r_[count, sizes[rest]], "seen": [True] * len(held) + [False] * len(rest)})

    new = in_buckets(classes, buckets(classes.sparkSession))
    return index.groupBy("bucket").cogroup(new.groupBy("bucket")).applyInPandas(look_up, CLASSES)


def exact_dedup(docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """One row for each row of history and docs: doc_id, keep_id, group_size, kept, text_sha256, in_history.

    Both have doc_id and text; other columns are ignored. Of equal texts (A-Z lower-cased, null as empty) the largest
    doc_id stays; rows that share a doc_id and a text share its verdict. A null doc_id loses to any other, and a group of
    null doc_ids alone has a null keep_id and keeps its rows. Without history, or with an empty one, all rows are new.
    """
    rows = docs.select("doc_id", "text").withColumn("past", F.lit(False))
    if history is not None:
        rows = rows.unionByName(history.select("doc_id", "text").withColumn("past", F.lit(True)))
    rows = stash(rows.select("doc_id", "past", text_digest(F.col("text")).alias("digest")), "digests")
    index = build_index(by_digest(rows.where("past")))
    classes = stash(update_index(index, by_digest(rows.where("not past"))), "classes")
    # a class of one needs no lookup; a class of many may be hot, and a merge join is split where it is
    many = classes.where("size > 1").select("digest", "winner", "size")
    keep = F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.nullif("winner", F.lit(NONE)))
    return (
        rows.join(many.hint("merge"), "digest", "left")
        .withColumn("keep_id", keep)
        .select(
            "doc_id",
            "keep_id",
            F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
            F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
            F.col("past").alias("in_history"),
        )
    )
