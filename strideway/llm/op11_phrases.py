"""Phrases whose words stand together more often than apart, counted with an FM-index over word ids in each shard.

Texts are dealt into shards of one language. A shard keeps the Burrows-Wheeler transform of its words, with suffixes in the order of
their first MAX_WORDS words: a phrase of so many words is an interval of suffixes, and stands as often as the interval is
long. The symbols in an interval are the words to its left, and where they lead is the interval of the longer phrase; the
interval around that place, one word shorter, is the phrase without its last word. So every step knows what a phrase
adds on the left and on the right.

Level by level, the shards' counts are summed, and only phrases that are frequent overall are extended, those whose
beginning is frequent too. What a shard is told is its own share of them, never the whole list:
1. Words by language and shard; those that are rare overall end a phrase, like a mark.
2. Each shard's transform.
3. Pairs of words, most of which are rare overall: shards deal their counts out packed, by a short hash of the pair, and are
   told by one bit each which of the hashes are frequent. Unlike pairs with one hash only let a rare pair through.
4. Phrases of two, three, ... words: rows of (shard, place, count) meet by phrase, one row for each shard and phrase, so that
   no phrase is hot; the smallest (shard, place) names the phrase.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stash, mixed, partitions, ship, slices, stash

MIN_COUNT, MAX_WORDS, TOP = 30, 4, 2000
#: A phrase goes when a longer one around it stands at least so many times for each 100 of its own.
COVERED = 80
#: Bytes of text in a shard; texts are cut between pieces, a longer piece is a shard of its own.
SHARD_BYTES = 16_000_000
#: Marks between pieces become line ends, tabs become spaces.
MARKS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n\n\n\n\n\n\n\n\n ")
#: A name holds the number of its shard and its place there: so many bits for shards within a task, and for places.
SHARD_BITS, PLACE_BITS = 12, 31
EMPTY = np.empty(0, np.int64)
#: Bits of a pair's short hash, and words of the corpus for each range of hashes that one task sums up.
HASH_BITS, RANGE_WORDS = 40, 4_000_000


def pieces(text: bytes, most: int = SHARD_BYTES // 4) -> Iterator[bytes]:
    """The text in lower case (A-Z), with a line end between pieces, in parts of about `most` bytes."""
    text = text.lower().translate(MARKS)
    a = 0
    while len(text) - a > most:
        b = text.rfind(b"\n", a, a + most)
        b = text.find(b"\n", a + most) if b < 0 else b
        if b < 0:
            break
        yield text[a:b]
        a = b + 1
    yield text[a:]


def packed(a: np.ndarray) -> bytes:
    kind = np.uint16 if not len(a) or a.max() < 1 << 16 else np.uint32
    return bytes([np.dtype(kind).itemsize]) + zstandard.compress(a.astype(kind).tobytes(), 1)


def unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b[1:]), np.uint16 if b[0] == 2 else np.uint32)


def shard_words(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """docs: text, lang. A row for each word of each shard (shard, lang, local, word, c), and one with local = -1 and the ids.

    Ids number the words of the shard; the last number ends a piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq = TaskContext.get().partitionId(), 0
        held: dict[str, list[pa.Array]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal seq, size
            for lang, parts in held.items():
                every = pa.chunked_array(parts).combine_chunks().dictionary_encode()
                ids, words = np.asarray(every.indices).astype(np.int64), every.dictionary
                end = pc.index(words, pa.scalar(b"\n", words.type)).as_py()
                # the mark gets the last number
                order = np.arange(len(words))
                order[end], order[-1] = len(words) - 1, end
                words, ids = words.take(pa.array(order))[:-1], order[ids]
                if len(words):
                    if seq >> SHARD_BITS or task >> (63 - SHARD_BITS - PLACE_BITS):
                        raise ValueError("too many shards in a task, or tasks: read the texts in more, or larger, partitions")
                    shard = (task << SHARD_BITS) + seq
                    seq += 1
                    n = len(words)
                    cols = [pa.array(np.full(n, shard)), pa.array([lang] * n, pa.string()), pa.array(np.arange(n, dtype=np.int32)), words.cast(pa.large_string()).cast(pa.string()), pa.array(np.bincount(ids, minlength=n + 1)[:-1]), pa.nulls(n, pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, names)
                    cols = [pa.array([shard]), pa.array([lang]), pa.array([-1], pa.int32()), pa.nulls(1, pa.string()), pa.array([0]), pa.array([packed(ids)], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, names)
            held.clear()
            size = 0

        names = ["shard", "lang", "local", "word", "c", "ids"]
        for batch in batches:
            for part in slices(batch):
                for text, lang in zip(part.column("text").cast(pa.large_binary()).to_pylist(), part.column("lang").to_pylist(), strict=True):
                    for piece in pieces(text or b""):
                        if size and size + len(piece) > shard_bytes:
                            yield from flush()
                        words = [w for w in piece.replace(b"\n", b" \n ").split(b" ") if w]
                        words.append(b"\n")
                        held.setdefault(lang, []).append(pa.array(words, pa.large_binary()))
                        size += len(piece)
        yield from flush()

    return docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang")).mapInArrow(run, "shard long, lang string, local int, word string, c long, ids binary")


def transform(seq: np.ndarray, depth: int = MAX_WORDS) -> np.ndarray:
    """The symbol before each suffix, suffixes in the order of their first `depth` symbols; 0 stands between pieces and first."""
    rank, width = seq.astype(np.int64), 1
    while width < depth:
        step = min(width, depth - width)
        after = np.concatenate([rank[step:], np.zeros(step, np.int64)])
        pair = rank * (rank.max() + 1) + after
        width += step
        if width < depth:
            rank = np.unique(pair, return_inverse=True)[1]
        else:
            rank = pair
    order = np.argsort(rank, kind="stable")
    return seq[order - 1]


def extended(bwt: np.ndarray, lo: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """Every word to the left of disjoint intervals [lo, lo + count): symbol, interval, new place, new count, and the interval
    among them around the new place (-1: none)."""
    n, symbols = len(bwt), int(bwt.max()) + 1
    by_symbol = np.argsort(bwt, kind="stable")
    leads = np.empty(n, np.int64)
    leads[by_symbol] = np.arange(n)
    inside = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
    owner = np.repeat(np.arange(len(lo)), count)
    symbol = bwt[inside].astype(np.int64)
    word = symbol > 0
    inside, owner, symbol = inside[word], owner[word], symbol[word]
    # places of an interval are in order, so a stable sort keeps the first occurrence first
    key = owner * symbols + symbol
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else EMPTY
    new_count = np.diff(np.concatenate([first, [len(key)]]))
    owner, symbol, place = owner[order][first], symbol[order][first], leads[inside[order][first]]
    around = np.full(n, -1, np.int64)
    around[np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))] = np.repeat(np.arange(len(lo)), count)
    return symbol, owner, place, new_count, around[place]


def indexes(rows: DataFrame) -> DataFrame:
    """rows: shard, ids, alive (local, name); shard, bwt and names of its symbols from 1, for shards with frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, alive = unpacked(batch.column("ids")[i].as_buffer().to_pybytes()), batch.column("alive")[i].values
                local, name = (np.asarray(alive.field(c)) for c in ("local", "name"))
                symbol = np.zeros(int(ids.max()) + 1, np.int64)
                symbol[local] = np.arange(1, len(local) + 1)
                seq = np.concatenate([[0], symbol[ids], [0]])
                seq = seq[np.concatenate([[True], (seq[1:] > 0) | (seq[:-1] > 0)])]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("shard")[i].as_py()]), pa.array([packed(transform(seq))], pa.binary()), pa.array([name.astype("<i8").tobytes()], pa.binary())], ["shard", "bwt", "names"])

    return rows.select("shard", "ids", "alive").mapInArrow(run, "shard long, bwt binary, names binary")


def short_hashes(word: np.ndarray, rest: np.ndarray) -> np.ndarray:
    return mixed(word.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + rest.view(np.uint64)) >> np.uint64(64 - HASH_BITS)


def packed_steps(h: np.ndarray) -> bytes:
    """Numbers in order, as the steps between them."""
    return zstandard.compress(np.diff(h, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T[: HASH_BITS // 8].tobytes(), 1)


def unpacked_steps(b: bytes) -> np.ndarray:
    low = np.frombuffer(zstandard.decompress(b), np.uint8).reshape(HASH_BITS // 8, -1)
    whole = np.zeros((8, low.shape[1]), np.uint8)
    whole[: len(low)] = low
    return np.cumsum(whole.T.copy().view("<u8").ravel())


def pairs(bwt: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, ...]:
    """A shard's pairs of words in the order of their short hashes: symbol, interval of the second word, place, count; hash."""
    count = np.bincount(bwt, minlength=len(names) + 1)
    symbol, owner, place, n, start = extended(bwt, np.cumsum(count)[:-1], count[1:])
    h = short_hashes(names[symbol - 1], names[owner])
    order = np.argsort(h, kind="stable")
    return symbol[order], owner[order], place[order], n[order], h[order]


def frequent_hashes(index: DataFrame, least: int, ranges: int) -> DataFrame:
    """shard and bits: for each range of hashes, which of the shard's pairs there have a hash that is frequent over all shards."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                *_, n, h = pairs(unpacked(batch.column("bwt")[i].as_buffer().to_pybytes()), np.frombuffer(batch.column("names")[i].as_buffer(), "<i8"))
                part = range_of(h, ranges)
                cuts = np.searchsorted(part, np.arange(ranges + 1))
                held = [r for r in range(ranges) if cuts[r] < cuts[r + 1]]
                n = np.minimum(n, least).astype("<u4") if least > 255 else np.minimum(n, least).astype(np.uint8)
                cols = [[packed_steps(h[cuts[r] : cuts[r + 1]]) for r in held], [zstandard.compress(n[cuts[r] : cuts[r + 1]].tobytes(), 1) for r in held]]
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([batch.column("shard")[i].as_py()] * len(held), pa.int64()), *[pa.array(c, pa.binary()) for c in cols]], ["part", "shard", "hashes", "counts"])

    def settle(table: pa.Table) -> pa.Table:
        hashes = [unpacked_steps(x) for x in table.column("hashes").to_pylist()]
        kind = np.dtype("<u4") if least > 255 else np.dtype(np.uint8)
        counts = np.concatenate([np.frombuffer(zstandard.decompress(x), kind) for x in table.column("counts").to_pylist()])
        every, which = np.unique(np.concatenate(hashes), return_inverse=True)
        enough = (np.bincount(which, counts, len(every)) >= least)[which]
        ends = np.cumsum([len(h) for h in hashes])
        bits = [np.packbits(x).tobytes() for x in np.split(enough, ends[:-1])]
        return pa.table({"part": table.column("part"), "shard": table.column("shard"), "n": pa.array([len(h) for h in hashes], pa.int32()), "bits": pa.array(bits, pa.binary())})

    dealt = index.select("shard", "bwt", "names").mapInArrow(deal, "part int, shard long, hashes binary, counts binary")
    found = dealt.groupBy("part").applyInArrow(settle, "part int, shard long, n int, bits binary")
    return found.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("part", "n", "bits"))).alias("bits"))


def range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    """Ranges of equal width, in order."""
    return (h >> np.uint64(HASH_BITS - 24)).astype(np.int64) * ranges >> 24


def kept_pairs(index: DataFrame, bits: DataFrame) -> DataFrame:
    """The pairs of words whose hash is frequent, as longer() gives longer phrases; Spark leaves out the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                bwt, names = unpacked(batch.column("bwt")[i].as_buffer().to_pybytes()), np.frombuffer(batch.column("names")[i].as_buffer(), "<i8")
                symbol, owner, place, n, _ = pairs(bwt, names)
                known = [np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=x["n"]) for x in batch.column("bits")[i].as_py() or ()]
                often = np.concatenate(known) if known else EMPTY
                for rows in phrase_batches(batch.column("shard")[i].as_py(), place, n, names[symbol - 1], names[owner]):
                    yield rows.append_column("often", pa.array(often[: rows.num_rows].astype(bool)))
                    often = often[rows.num_rows :]

    rows = index.join(bits.hint("merge"), "shard")
    return rows.select("shard", "bwt", "names", "bits").mapInArrow(run, PHRASE + ", often boolean").where("often").drop("often").withColumn("start", F.col("word"))


PHRASE = "shard long, place int, c int, word long, rest long"


def phrase_batches(shard: int, place: np.ndarray, n: np.ndarray, *names: np.ndarray) -> Iterator[pa.RecordBatch]:
    cols = [pa.array(np.full(len(n), shard)), pa.array(place.astype(np.int32)), pa.array(n.astype(np.int32)), *map(pa.array, names)]
    whole = pa.RecordBatch.from_arrays(cols, ["shard", "place", "c", "word", "rest", "start"][: len(cols)])
    for a in range(0, whole.num_rows, 100_000):
        yield whole.slice(a, 100_000)


def longer(index: DataFrame, alive: DataFrame) -> DataFrame:
    """Each shard's phrases of one word more: shard, place, c, word and rest (the phrase after it), and start (that before its last
    word). alive: shard, phrases (place, c, name)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                bwt, names = unpacked(batch.column("bwt")[i].as_buffer().to_pybytes()), np.frombuffer(batch.column("names")[i].as_buffer(), "<i8")
                known = batch.column("phrases")[i].values
                lo, count, name = (np.asarray(known.field(c)).astype(np.int64) for c in ("place", "c", "name"))
                order = np.argsort(lo)
                lo, count, name = lo[order], count[order], name[order]
                symbol, owner, place, n, start = extended(bwt, lo, count)
                own = start >= 0
                yield from phrase_batches(batch.column("shard")[i].as_py(), place[own], n[own], names[symbol[own] - 1], name[owner[own]], name[start[own]])

    return index.join(alive.hint("merge"), "shard").select("shard", "bwt", "names", "phrases").mapInArrow(run, PHRASE + ", start long")


def named(shard: str, place: str) -> Column:
    return F.shiftleft(F.col(shard), PLACE_BITS) + F.col(place)


def frequent(rows: DataFrame, key: list[str], place: str, least: int) -> DataFrame:
    """The rows of phrases with at least `least` occurrences over all shards, with f and the phrase's name."""
    by = Window.partitionBy(*key)
    return rows.withColumn("f", F.sum("c").over(by)).withColumn("name", F.min(named("shard", place)).over(by)).where(F.col("f") >= least)


def phrases(docs: DataFrame, least: int = MIN_COUNT, most_words: int = MAX_WORDS, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """All phrases of up to most_words (4 at most) words that stand `least` times or more in a language, and words by language.

    The first: lang, phrase, words (array), size, f, n_left and n_right (different frequent phrases with one word more on that
    side). The second: lang and n, occurrences of all words. docs: text and lang; null text is empty, null lang is `und`; other
    columns are ignored. An empty table, or one without words, gives two empty tables.
    """
    ship(docs.sparkSession)
    shards = stash(shard_words(docs, shard_bytes), "shard-words")
    words = shards.where("local >= 0")
    totals = stash(words.groupBy("lang").agg(F.sum("c").alias("n")), "word-totals")
    alive = stash(frequent(words.select("shard", "lang", "local", "word", "c"), ["lang", "word"], "local", least), "frequent-words")
    own = lambda df, place: df.where(F.col("name") == named("shard", place))
    levels = [stash(own(alive, "local").select("name", "lang", F.array("word").alias("words"), "f"), "phrase-level")]
    lists = alive.groupBy("shard").agg(F.collect_list(F.struct("local", "name")).alias("alive"))
    index = stash(indexes(shards.where("local = -1").select("shard", "ids").join(lists.hint("merge"), "shard")), "shard-indexes")
    # what each shard holds goes as soon as the next level has it
    drop_stash(shards, alive)
    found, links = None, []
    for size in range(2, most_words + 1):
        if found is None:
            ranges = 1 + (totals.agg(F.sum("n").alias("n")).first()["n"] or 0) // RANGE_WORDS
            new = kept_pairs(index, frequent_hashes(index, least, ranges))
        else:
            new = longer(index, found.groupBy("shard").agg(F.collect_list(F.struct("place", "c", "name")).alias("phrases")))
        new = stash(frequent(new, ["word", "rest"], "place", least), "frequent-phrases")
        if found is not None:
            drop_stash(found)
        found = new
        links.append(stash(own(found, "place").select("name", "word", "rest", "start", "f", F.lit(size - 1).alias("size")), "phrase-links"))
        first = levels[0].select(F.col("name").alias("word"), F.col("words").alias("w"))
        rest = levels[-1].select(F.col("name").alias("rest"), "lang", F.col("words").alias("r"))
        level = links[-1].join(first.hint("merge"), "word").join(rest.hint("merge"), "rest").select("name", "lang", F.concat("w", "r").alias("words"), "f")
        levels.append(stash(level, "phrase-level"))
    if found is not None:
        drop_stash(found)
    drop_stash(index)
    # names tell phrases of one size apart
    whole = functools.reduce(DataFrame.unionByName, levels).withColumn("size", F.size("words"))
    if links:
        ends = functools.reduce(DataFrame.unionByName, links)
        for side, c in (("rest", "n_left"), ("start", "n_right")):
            whole = whole.join(ends.groupBy(F.col(side).alias("name"), "size").agg(F.count("*").alias(c)).hint("merge"), ["name", "size"], "left")
    else:
        whole = whole.withColumn("n_left", F.lit(0)).withColumn("n_right", F.lit(0))
    whole = whole.select("lang", F.array_join("words", " ").alias("phrase"), "words", "size", "f", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_left", "n_right")])
    out = stash(whole, "phrases")
    drop_stash(*levels, *links)
    return out, totals


def exact(c: str) -> Column:
    return F.col(c).cast("decimal(20,0)")


def collocations(docs: DataFrame, least: int = MIN_COUNT, top: int = TOP, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Each language's first `top` phrases of two to MAX_WORDS words: lang, rank, phrase, a, l, r, n, score, n_left, n_right.

    a counts the phrase, l and r its parts at its lowest-scoring cut (ties: the first), n all words of the language; score is
    floor(2,000,000 a / (l + r)), in whole numbers of any size. A phrase inside a longer one that stands at least COVERED % as often
    is left out. Order: score and a descending, then the phrase's bytes. For nulls and empty tables see phrases().
    """
    every, totals = phrases(docs, least, shard_bytes=shard_bytes)
    known = every.select("lang", "phrase", "f")
    many = stash(every.where("size > 1").withColumnRenamed("f", "a"), "candidates")
    cuts = many.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("words", F.col("k") + 1, F.size("words")), " ").alias("rest"))
    for part, c in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(part), F.col("f").alias(c)).hint("merge"), ["lang", part])
    score = F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice("words", i, m), " "))))
    around = many.where("size > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    rows = many.join(best.hint("merge"), ["lang", "phrase"]).join(around.hint("merge"), ["lang", "phrase"], "left")
    rows = rows.where(F.col("longer").isNull() | (exact("longer") * 100 < exact("a") * COVERED)).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", "n_left", "n_right")
    # a language may have most phrases: the first of each part, then the first of those
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(max(16, partitions(docs.sparkSession))))
    for by in ([F.col("lang"), part], [F.col("lang")]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    out = rows.join(totals.hint("merge"), "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"), "n_left", "n_right")
