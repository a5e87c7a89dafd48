"""Removal of repeated passages, exactly, by way of difference-cover anchors.

A difference cover of a period has, for any two residues, a shift that brings both into it. So of two equal windows,
wherever they start in their documents, some position within the first period is a cover position in both: hashing
only at cover positions finds every match. The texts are read three times:
1. Hashes at cover positions are dealt by hash, packed as arrays; those that two documents share are anchors.
2. Around its anchors each document hashes whole windows. These are dealt likewise; a window that a smaller doc_id has
   too is a repeat.
3. Each document drops the words that its repeats cover.
A part of a batch settles what it can before the shuffle: of the documents there that share a hash only the first (and for
anchors the last) is dealt, and the others are known to repeat. So a passage that most documents hold comes to its task
once or twice for each part, not once for each document. Rows are told apart by doc_id and a hash of their text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets, column, drop_stash, parted, rolled, ship, slices, stash, word_hashes

WINDOW, PERIOD = 50, 21
OTHER_BASE = 0xD6E8FEB86659FD93
PACKED = "bucket int, known boolean, docs binary, prints binary, counts binary, hashes binary, checks binary, places binary"
KEY = ["doc_id", "print"]


@cache
def difference_cover(period: int) -> tuple[int, ...]:
    """The first smallest set of residues whose differences are all residues."""

    def extend(chosen: tuple[int, ...], size: int) -> tuple[int, ...] | None:
        if len(chosen) == size:
            return chosen if len({(a - b) % period for a in chosen for b in chosen}) == period else None
        for x in range(chosen[-1] + 1, period):
            if found := extend((*chosen, x), size):
                return found
        return None

    size = 1
    while not (found := extend((0,), size)):
        size += 1
    return found


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)])


def packed(n_buckets: int, docs: np.ndarray, prints: np.ndarray, owner: np.ndarray, h: np.ndarray, check: np.ndarray, place: np.ndarray, all_of_them: bool) -> Iterator[pa.RecordBatch]:
    """Hashes by bucket, with 32 more bits each, their places, and the rows that have them in runs.

    Only what the first doc_id here has (and the last, for all_of_them) is sent to be compared; the rest is known to repeat.
    """
    doc, check, place = docs[owner], check.astype("<u4"), place.astype("<u4")
    order = np.lexsort((doc, check, h))
    starts = runs(h[order], check[order])
    n = np.diff(np.r_[starts, len(h)])
    first, last = np.repeat(doc[order][starts], n), np.repeat(doc[order][starts + n - 1], n)
    sent = np.empty(len(h), bool)
    sent[order] = (doc[order] == first) | ((doc[order] == last) if all_of_them else False)
    for known in (False, True):
        own = np.flatnonzero(sent != known)
        if not len(own):
            continue
        bucket = ((prints[owner[own]] if known else h[own] >> np.uint64(32)) % n_buckets).astype(np.int32)
        order = np.argsort(bucket, kind="stable")  # which leaves each row's places together
        own, bucket = own[order], bucket[order]
        at = runs(bucket, owner[own])
        counts, row, run_bucket = np.diff(np.r_[at, len(own)]).astype("<u4"), owner[own[at]], bucket[at]
        present = np.unique(bucket)
        of_runs = list(zip(np.searchsorted(run_bucket, present), np.searchsorted(run_bucket, present, "right"), strict=True))
        of_rows = list(zip(np.searchsorted(bucket, present), np.searchsorted(bucket, present, "right"), strict=True))
        cut = lambda x, at: pa.array([x[a:b].tobytes() for a, b in at], pa.binary())
        none = pa.array([b""] * len(present), pa.binary())
        cols = [cut(docs[row], of_runs), cut(prints[row], of_runs), cut(counts, of_runs), none if known else cut(h[own], of_rows), none if known else cut(check[own], of_rows), cut(place[own], of_rows)]
        yield pa.RecordBatch.from_arrays([pa.array(present), pa.array([known] * len(present)), *cols], ["bucket", "known", "docs", "prints", "counts", "hashes", "checks", "places"])


def repeated(windows: DataFrame, all_of_them: bool) -> DataFrame:
    """doc_id, print and places (packed 32-bit integers) of the hashes that another document has too: all_of_them, or those
    that a smaller doc_id has."""

    def run(t: pa.Table) -> pa.Table:
        joined = lambda t, name, kind: np.frombuffer(b"".join(t.column(name).to_pylist()), kind)
        found = []
        for known in (False, True):
            own = t.filter(pc.equal(t.column("known"), known))
            n = joined(own, "counts", "<u4")
            docs, prints, place = np.repeat(joined(own, "docs", "<i8"), n), np.repeat(joined(own, "prints", "<i8"), n), joined(own, "places", "<u4")
            if not known:
                h, check = joined(own, "hashes", "<u8"), joined(own, "checks", "<u4")
                order = np.lexsort((docs, check, h))
                h, check, docs, prints, place = h[order], check[order], docs[order], prints[order], place[order]
                starts = runs(h, check)
                n = np.diff(np.r_[starts, len(h)])
                first, last = np.repeat(docs[starts], n), np.repeat(docs[starts + n - 1], n)
                hit = (first != last) if all_of_them else (docs != first)
                docs, prints, place = docs[hit], prints[hit], place[hit]
            found.append((docs, prints, place))
        docs, prints, place = map(np.concatenate, zip(*found, strict=True))
        order = np.lexsort((prints, docs))
        docs, prints, place = docs[order], prints[order], place[order]
        at = runs(docs, prints)
        ends = np.r_[at[1:], len(docs)] if len(at) else at
        return pa.table({"doc_id": pa.array(docs[at], pa.int64()), "print": pa.array(prints[at], pa.int64()), "places": pa.array([place[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary())})

    return windows.groupBy("bucket").applyInArrow(run, "doc_id long, print long, places binary")


def hashed(docs: DataFrame, of, all_of_them: bool) -> DataFrame:
    """docs: doc_id, print, text and maybe anchors. `of` gives a text's hashes, check bits and their places."""
    n_buckets = buckets(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                lists = column(part, "anchors") if "anchors" in part.schema.names else [()] * part.num_rows
                found = [of(word_hashes(text.split()), anchors) for text, anchors in zip(column(part, "text"), lists, strict=True)]
                h, check, place = (np.concatenate(x) for x in zip(*found, strict=True))
                owner = np.repeat(np.arange(len(found)), [len(x[0]) for x in found])
                if len(h):
                    yield from packed(n_buckets, np.array(column(part, "doc_id"), "<i8"), np.array(column(part, "print"), "<i8"), owner, h, check, place, all_of_them)

    return docs.mapInArrow(run, PACKED)


def anchor_hashes(docs: DataFrame, window: int, period: int) -> DataFrame:
    length, cover = window - period + 1, np.array(difference_cover(period))

    def of(words: np.ndarray, _) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.arange(len(words) - length + 1 if len(words) >= window else 0)
        at = at[np.isin(at % period, cover)]
        r = rolled(words, length)[at]
        return r, r & np.uint64(0xFFFFFFFF), at

    # an anchor only says where to look, so half of its hash twice is enough of a check
    return hashed(docs.where("doc_id is not null").select(*KEY, "text"), of, True)


def window_hashes(docs: DataFrame, window: int, period: int) -> DataFrame:
    """docs: doc_id, print, text and anchors (lists of packed places)."""
    length = window - period + 1

    def of(words: np.ndarray, anchors: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, n = np.frombuffer(b"".join(anchors), "<u4").astype(np.int64), max(0, len(words) - window + 1)
        # windows from window - length before an anchor to the anchor itself hold it
        open_ = np.zeros(len(words) + 1, np.int64)
        np.add.at(open_, np.maximum(at - (window - length), 0), 1)
        np.add.at(open_, at + 1, -1)
        at = np.flatnonzero(np.cumsum(open_)[:n])
        return rolled(words, window)[at], rolled(words, window, OTHER_BASE)[at] >> np.uint64(32), at

    return hashed(docs.select(*KEY, "text", "anchors"), of, False)


def without_repeats(docs: DataFrame, window: int, keep_text: bool) -> DataFrame:
    """docs: doc_id, text and repeats (lists of packed places, or null)."""
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string, removed array<struct<first:int,words:int>>" * keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows: dict[str, list] = {"n_words": [], "n_removed": [], "kept_sha256": [], "kept_text": [], "removed": []}
                for text, repeats in zip(column(part, "text"), column(part, "repeats"), strict=True):
                    words, runs = text.split(), []
                    kept = words
                    if repeats:
                        at = np.frombuffer(b"".join(repeats), "<u4").astype(np.int64)
                        cover = np.zeros(len(words) + 1, np.int64)
                        np.add.at(cover, at, 1)
                        np.add.at(cover, at + window, -1)
                        gone = np.cumsum(cover)[:-1] > 0
                        kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                        edges = np.flatnonzero(np.diff(np.r_[0, gone, 0]))
                        runs = [{"first": int(a), "words": int(b - a)} for a, b in zip(edges[::2], edges[1::2], strict=True)]
                    out = b" ".join(kept)
                    values = (len(words), len(words) - len(kept), hashlib.sha256(out).hexdigest(), out.decode(), runs)
                    for name, value in zip(rows, values, strict=True):
                        rows[name].append(value)
                cols = [part.column("doc_id").cast(pa.int64()), pa.array(rows["n_words"], pa.int64()), pa.array(rows["n_removed"], pa.int64()), pa.array(rows["kept_sha256"])]
                if keep_text:
                    runs_type = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32())]))
                    cols += [pa.array(rows["kept_text"], pa.string()), pa.array(rows["removed"], runs_type)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "removed"][: len(cols)])

    return docs.select("doc_id", "text", "repeats").mapInArrow(run, schema)


def gathered(places: DataFrame, name: str) -> DataFrame:
    return places.groupBy(*KEY).agg(F.collect_list("places").alias(name))


def substring_dedup(docs: DataFrame, window: int = WINDOW, period: int = PERIOD, keep_text: bool = True) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, n_removed, kept_sha256, and with keep_text kept_text and removed.

    docs: doc_id and text; other columns are ignored. Words are as they stand. Every word is removed that a window of
    `window` words covers which also starts in a document with a smaller doc_id; windows are judged on the input. Kept
    words are joined by a space. Null text has no words. Rows that share a doc_id are judged each by its own text, and neither
    repeats the other, as no doc_id is smaller. A null doc_id is not compared. Windows are told apart by 96 bits of hash.
    An empty table gives no rows.
    """
    ship(docs.sparkSession)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("print"))
    anchors = stash(gathered(repeated(anchor_hashes(rows, window, period), True), "anchors"), "anchors")
    # lists of places are far smaller than texts, and no text has many rows: they are the side to build from
    found = parted(rows, anchors)[0].join(anchors.hint("shuffle_hash"), KEY)
    repeats = stash(gathered(repeated(window_hashes(found, window, period), False), "repeats"), "repeats")
    drop_stash(anchors)
    hit, rest = parted(rows, repeats)
    out = without_repeats(hit.join(repeats.hint("shuffle_hash"), KEY, "left"), window, keep_text)
    return out if rest is None else out.unionByName(without_repeats(rest.withColumn("repeats", F.lit(None).cast("array<binary>")), window, keep_text))
