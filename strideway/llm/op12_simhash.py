"""SimHash near-duplicates with BK-trees: fingerprints of 64 bits that differ in few bits are linked.

A BK-tree's children are keyed by their Hamming distance to the parent, so a search follows only edges that are within the
radius of its own distance to a node. One tree of all fingerprints would grow with the documents, and so would a broadcast
of all shard trees. So fingerprints are dealt by what two linked ones must share: with RADIUS differing bits at most, of RADIUS + 1
blocks of bits one is equal. Each block's value is a shard with a tree, searched by its own members only; a shard of
more than MOST members is dealt again by the blocks of the bits that it doesn't share yet, until the bits left bound it. A
tree gives back a link from each member to the first one that it is connected with, and never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, drop_stash, ship, slices, stash
from .graph import components

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Fingerprints of a shard at most; a shard that shares all but FEW_BITS bits can't have more.
MOST, FEW_BITS = 4096, 12
#: Fingerprints whose trees are built at a time, and pairs of a search and a node that are looked at together.
ROWS, PAIRS = 50_000, 1_000_000
#: Shingles that are hashed at a time.
PART = 100_000


def fingerprint(text: bytes) -> bytes:
    """Eight bytes, highest bit first: those bits that more than half of the shingles' hashes have; no words: zero."""
    words = text.lower().split()
    if not words:
        return bytes(8)
    whole, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(SHINGLE, len(words))
    starts, ends = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    sums, digest = np.zeros(64, np.int64), xxhash.xxh64_digest
    for a in range(0, len(starts), PART):
        hashes = b"".join([digest(whole[s:e], SEED) for s, e in zip(starts[a : a + PART], ends[a : a + PART], strict=True)])
        sums += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int32)
    return np.packbits(sums * 2 > len(starts)).tobytes()


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                bits = b"".join([fingerprint(t) for t in column(part, "text")])
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(np.frombuffer(bits, ">i8").astype(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def blocks(bits: list[int], radius: int) -> list[list[int]]:
    n = radius + 1
    return [bits[len(bits) * i // n : len(bits) * (i + 1) // n] for i in range(n)]


def shards(fps: DataFrame, radius: int, most: int) -> DataFrame:
    """path, value and fp, written out: the members of the shards with two to `most` members. path numbers the shared blocks,
    value has their bits."""
    free, rows, done, used = {"": list(range(64))}, fps.select("fp", F.lit("").alias("path")), [], []
    while True:
        free = {f"{path}{i}": [b for b in bits if b not in block] for path, bits in free.items() for i, block in enumerate(blocks(bits, radius))}
        masks = {path: np.uint64(sum(1 << b for b in range(64) if b not in bits)).astype(np.int64) for path, bits in free.items()}
        mask = F.create_map(*[F.lit(x) for path, m in masks.items() for x in (path, int(m))])
        dealt = rows.select("fp", F.explode(F.array(*[F.concat("path", F.lit(str(i))) for i in range(radius + 1)])).alias("path"))
        dealt = stash(dealt.withColumn("value", F.col("fp").bitwiseAND(mask[F.col("path")])), "bit-shards")
        used.append(dealt)
        sizes = dealt.groupBy("path", "value").agg(F.count("*").alias("size")).where("size > 1")
        # a shard may hold most fingerprints: a merge join is split where it is hot
        sized = stash(dealt.join(sizes.hint("merge"), ["path", "value"]), "sized-shards")
        last = max(map(len, free.values())) <= FEW_BITS
        done.append(sized if last else sized.where(F.col("size") <= most))
        used.append(sized)
        rows = sized.where(F.col("size") > most).select("fp", "path")
        if last or not rows.limit(1).count():
            out = stash(reduce(DataFrame.unionByName, done).select("path", "value", "fp"), "shards")
            drop_stash(*used)
            return out


def forest(fp: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes that have a parent, by parent and distance: (their key parent * 65 + distance, in order, and themselves).

    root: for each fingerprint the first one of its shard, the root of the tree. All trees grow together: of the fingerprints that
    stand at a node at the same distance, the first becomes its child, and the others go on there.
    """
    at, left = root.copy(), np.flatnonzero(root != np.arange(len(fp)))
    keys, nodes = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    while len(left):
        key = at[left] * 65 + np.bitwise_count(fp[left] ^ fp[at[left]]).astype(np.int64)
        new, first, child = np.unique(key, return_index=True, return_inverse=True)
        keys.append(new)
        nodes.append(left[first])
        at[left] = left[first][child]
        left = np.delete(left, first)
    key, node = np.concatenate(keys), np.concatenate(nodes)
    order = np.argsort(key)
    return key[order], node[order]


def ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which range each element belongs to, and the elements of all ranges [lo, hi)."""
    n = np.maximum(hi - lo, 0)
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def connected(fp: np.ndarray, root: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint the first that links within its shard connect it with, by searches of the trees."""
    keys, nodes = forest(fp, root)
    label = np.arange(len(fp))
    sizes = np.bincount(root, minlength=len(fp))[root]
    part = np.cumsum(sizes) // PAIRS
    for chunk in np.split(np.arange(len(fp)), np.flatnonzero(np.diff(part)) + 1):
        who, node = chunk, root[chunk]
        near: list[tuple[np.ndarray, np.ndarray]] = []
        while len(who):
            d = np.bitwise_count(fp[who] ^ fp[node]).astype(np.int64)
            hit = (d <= radius) & (node < who)
            near.append((who[hit], node[hit]))
            lo, hi = np.searchsorted(keys, node * 65 + np.maximum(d - radius, 0)), np.searchsorted(keys, node * 65 + np.minimum(d + radius, 64), "right")
            of, edge = ranges(lo, hi)
            who, node = who[of], nodes[edge]
        a, b = (np.concatenate(x) for x in zip(*near, strict=True))
        while len(a):
            a, b = label[a], label[b]
            unlike = a != b
            a, b = a[unlike], b[unlike]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (up := label[label]).tobytes() != label.tobytes():
                label = up
    return label


def links(dealt: DataFrame, radius: int) -> DataFrame:
    """a and b: each member of a shard with the first one that the shard's links connect it with."""

    def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
        path, value = (table.column(c).combine_chunks() for c in ("path", "value"))
        path, value, fp = np.asarray(path.dictionary_encode().indices), np.asarray(value), np.asarray(table.column("fp")).view(np.uint64)
        if len(fp):
            new = np.concatenate([[True], (path[1:] != path[:-1]) | (value[1:] != value[:-1])])
            root = np.maximum.accumulate(np.where(new, np.arange(len(fp)), 0))
            label = connected(fp, root, radius)
            other = np.flatnonzero(label != np.arange(len(fp)))
            yield pa.RecordBatch.from_arrays([pa.array(fp[x].view(np.int64)) for x in (other, label[other])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= ROWS:
                whole = pa.Table.from_batches(held).combine_chunks()
                path, value = whole.column("path"), np.asarray(whole.column("value"))
                last = (value == value[-1]) & np.asarray(pc.equal(path, path[-1]))
                cut = whole.num_rows - int(np.argmin(last[::-1])) if not last.all() else 0
                yield from found(whole.slice(0, cut))
                held = whole.slice(cut).to_batches()
        if held:
            yield from found(pa.Table.from_batches(held).combine_chunks())

    return dealt.repartition("path", "value").sortWithinPartitions("path", "value", "fp").mapInArrow(run, "a long, b long")


def simhash_components(docs: DataFrame, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id that links lead to, for each row of docs.

    docs: doc_id and text; other columns are ignored. Rows whose fingerprints differ in `radius` bits at most are linked, whatever
    they are: null and empty texts, and texts of white space, have fingerprint zero. Rows that share a doc_id are told apart. A null
    doc_id links like any other but names no component; a component of none but null ids has a null id. An empty table gives
    no rows.
    """
    ship(docs.sparkSession)
    rows = stash(fingerprints(docs), "fingerprints")
    fps = stash(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    dealt = shards(fps, radius, most)
    edges = stash(links(dealt, radius).distinct(), "links")
    joined = components(edges).withColumnsRenamed({"v": "fp", "c": "class"})
    classes = stash(fps.join(joined.hint("merge"), "fp", "left").select("fp", "least", F.coalesce("class", "fp").alias("class")), "classes")
    ids = classes.groupBy("class").agg(F.min("least").alias("component_id"))
    named = classes.join(ids.hint("merge"), "class").select("fp", "component_id")
    drop_stash(dealt, edges, fps)
    # one fingerprint may stand for most rows: a merge join is split where it is hot
    return rows.join(named.hint("merge"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
