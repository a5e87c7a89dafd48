"""Mixing sources to target weights: exact block quotas, split among output shards down a tree.

A source's documents are dealt into blocks by a hash of their ids and texts, which makes a block a random part of its source and
the blocks' order a random permutation. The mix takes a source's blocks in that order, pass after pass, until its target
is met; the block where that happens gives documents in hash order. So many block draws are the source's quota. The
quotas of all sources are split in two again and again, each time by a multivariate hypergeometric draw, until each
output shard has its own; a shard then takes the next draws of each source, and shuffles what it has by hash.
All of it is DataFrame functions, and every draw comes from a hash, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_stash, fresh, n_words, partitions, stash

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
#: Documents to a block, about.
BLOCK_DOCS = 64
#: Words of the mix to an output shard, about, and the least number of shards; both numbers of shards are powers of two.
SHARD_WORDS, LEAST_SHARDS = 1 << 28, 16
#: Blocks of a source that are numbered and summed in one task.
SEGMENT = 256


def uniform(*key: str | Column, seed: int) -> Column:
    """A number in [0, 1) from a hash of the key."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 11) / F.lit(float(1 << 53))


def in_order(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """rows with their numbers (from 0) in the order of all: each sorted partition counts its own, after those before it."""
    dealt = stash(rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), name)
    part, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    base, before = [], 0
    for r in dealt.groupBy(part.alias("p")).count().orderBy("p").collect():  # a row for each partition
        base += [F.lit(r["p"]), F.lit(before)]
        before += r["count"]
    return dealt.withColumn(name, at + F.element_at(F.create_map(*base), part) if base else at).drop("_at")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size to which source_no, weight and target come: weights repeat over the sources by code point, null last.

    Targets are shares by weight of `share` times all sizes, none above `most` times its source's size: those that would
    be are held there, and the rest is shared again, until none is above. Each round brings one row to the driver.
    """
    rows = in_order(sizes, "source_no", F.col("source").isNull(), F.col("source").cast("binary"))
    cap = F.col("source_size") * most
    rows = rows.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod("source_no", F.lit(len(weights))) + 1).cast("int")))
    level, held = 0.0, -1
    goal = float(rows.agg(F.sum("source_size").alias("n")).first()["n"] or 0) * share
    while True:
        above = F.lit(held >= 0) & (F.col("weight") * level > cap)
        r = rows.agg(F.count_if(above).alias("held"), F.sum(F.when(above, cap)).alias("at_cap"), F.sum(F.when(~above, F.col("weight"))).alias("open")).first()
        if r["held"] == held or not r["open"]:
            break
        level, held = (goal - (r["at_cap"] or 0.0)) / r["open"], r["held"]
    return rows.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)) if r["open"] else cap)


def log_factorial(n: str) -> str:
    """SQL for ln(n!): Stirling's series at n + 8, less what was added."""
    x = f"({n} + 8D)"
    return f"(({x} + 0.5D) * ln({x}) - {x} + {0.5 * math.log(2 * math.pi)!r}D + 1D / (12D * {x}) - 1D / (360D * {x} * {x} * {x}) - ln(" + " * ".join(f"({n} + {k}D)" for k in range(1, 9)) + "))"


def log_choose(n: str, k: str) -> str:
    return f"({log_factorial(n)} - {log_factorial(k)} - {log_factorial(f'({n} - {k})')})"


def hypergeometric(of: str, marked: str, drawn: str, u: str) -> str:
    """SQL for how many of `drawn` items out of `of` are among the `marked` ones, for a uniform u: the inverse of the sum.

    The sum goes over 12 standard deviations on both sides of the mean, as what lies beyond doesn't show in a double.
    """
    mean = f"({drawn} * ({marked} / cast({of} as double)))"
    around = f"ceil(12 * sqrt({mean} * (1 - {marked} / cast({of} as double)) + 1))"
    low, high = f"greatest(0L, {drawn} + {marked} - {of}, floor({mean}) - {around})", f"least({marked}, {drawn}, ceil({mean}) + {around})"
    chance = f"exp({log_choose(marked, 'k')} + {log_choose(f'({of} - {marked})', f'({drawn} - k)')} - {log_choose(of, drawn)})"
    return (
        f"if({of} = 0, 0L, aggregate(sequence({low}, {high}), named_struct('p', 0D, 'n', {low}),"
        f" (c, k) -> if(c.p > {u}, c, named_struct('p', c.p + {chance}, 'n', k)), c -> c.n))"
    )


def split_quotas(quotas: DataFrame, shards: int = LEAST_SHARDS, seed: int = 1) -> DataFrame:
    """source_no and quota to source_no, shard and draws: how many of a source's draws each shard gets.

    A node of the tree holds a quota for each source. Its left child gets half of the places, filled by a multivariate
    hypergeometric draw: for one source after another, the hypergeometric share of what is left of both. The quotas of
    all shards add up to those given, and shards differ by one draw at most.
    """
    if shards & (shards - 1):
        raise ValueError("the number of shards is a power of two")
    # a row for each source, gathered once: their number is that of the sources, whatever the documents are. Nodes are
    # dealt out anew when there are enough of them for many tasks
    nodes = quotas.groupBy().agg(F.array_sort(F.collect_list(F.struct("source_no", "quota"))).alias("q")).withColumn("shard", F.lit(0).cast("long"))
    for level in range(shards.bit_length() - 1):
        if level == 4:
            nodes = nodes.repartition(partitions(quotas.sparkSession), "shard")
        u = f"(shiftrightunsigned(xxhash64({seed}, {level}, shard, x.source_no), 11) / {float(1 << 53)!r}D)"
        take = hypergeometric("a.of", "x.quota", "a.places", u)
        start = "named_struct('of', total, 'places', total div 2 + if(total % 2 = 1, pmod(xxhash64(shard), 2), 0L), 'left', cast(array() as array<struct<source_no:bigint,quota:bigint>>))"
        step = (
            f"transform(array({take}), h -> named_struct('of', a.of - x.quota, 'places', a.places - h,"
            " 'left', concat(a.left, array(named_struct('source_no', x.source_no, 'quota', h)))))[0]"
        )
        nodes = (
            nodes.withColumn("total", F.expr("aggregate(q, 0L, (a, x) -> a + x.quota)"))
            .withColumn("left", F.expr(f"aggregate(q, {start}, (a, x) -> {step}, a -> a.left)"))
            .withColumn("right", F.expr("zip_with(q, left, (x, y) -> named_struct('source_no', x.source_no, 'quota', x.quota - y.quota))"))
            .select(F.explode(F.array(F.struct((F.col("shard") * 2).alias("shard"), F.col("left").alias("q")), F.struct((F.col("shard") * 2 + 1).alias("shard"), F.col("right").alias("q")))).alias("n"))
            .select("n.*")
        )
    return nodes.select("shard", F.explode("q").alias("x")).select("shard", "x.source_no", F.col("x.quota").alias("draws")).where("draws > 0")


def cumulated(blocks: DataFrame) -> DataFrame:
    """source_no, block, words, ... with the number of the source's blocks up to each and the words before it.

    Segments of blocks add up their own; then each source adds up its segments.
    """
    own = blocks.withColumn("segment", F.floor(F.col("block") / SEGMENT))
    upto = Window.partitionBy("source_no", "segment").orderBy("block")
    own = own.withColumn("_n", F.row_number().over(upto)).withColumn("_w", F.sum("words").over(upto) - F.col("words"))
    before = Window.partitionBy("source_no").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    sums = blocks.groupBy("source_no", F.floor(F.col("block") / SEGMENT).alias("segment")).agg(F.count("*").alias("n"), F.sum("words").alias("w"))
    sums = sums.select("source_no", "segment", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}0") for c in ("n", "w")], F.sum("n").over(Window.partitionBy("source_no")).alias("all_blocks"))
    met = own.join(sums.hint("merge"), ["source_no", "segment"])
    return met.select(*blocks.columns, "all_blocks", (F.col("_n") + F.col("_n0")).alias("number"), (F.col("_w") + F.col("_w0")).alias("words_before"))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, shards: int | None = None, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """The rows of docs with their sizes, targets and blocks, and the draws (a row for each copy in the mix).

    docs: row (told apart from all others), doc_id, text and source. Size is the number of words, 0 for null text; such
    documents are never taken. A null source is a source of its own, and a null doc_id an id like any other. Rows that share
    a doc_id are documents of their own; which of several wholly equal ones is drawn is left open. An empty table gives
    empty results. At most `most` = 2 copies of a document are drawn. Without `shards`, their number follows the words.

    Draws: row, source_no, block, copy, shard, place (the hash that orders a shard).
    """
    sized = stash(docs.select("row", "doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("print")), "mix-sizes")
    sources = stash(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "mix-sources")
    targets = source_targets(sources, weights, share, most)
    n_blocks = F.ceil(F.col("n") / BLOCK_DOCS).cast("long")
    targets = stash(targets.select("source", "source_no", "source_size", "weight", "target", n_blocks.alias("n_blocks")), "mix-targets")
    if shards is None:
        words = targets.agg(F.sum("target").alias("t")).first()["t"] or 0.0
        shards = 1 << max(LEAST_SHARDS.bit_length() - 1, math.ceil(math.log2(max(1.0, words / SHARD_WORDS))))
    # as many rows as sources; a merge join is split where a source is hot
    found = sized.join(targets.hint("merge"), sized["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    found = found.withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "print"), "n_blocks")).withColumn("order", uniform("print", seed=seed + 1))
    found = stash(found.drop("print", "weight", "n_blocks"), "mix-found")

    # whole passes, then whole blocks in the order of their numbers, then documents of the block where the target lies
    words = stash(found.groupBy("source_no", "block", "target", "source_size").agg(F.sum("size").alias("words")), "mix-words")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0)
    rows = cumulated(words).withColumn("passes", passes.cast("long"))
    need = F.col("target") - F.col("passes") * F.col("source_size") - F.col("words_before")
    rows = stash(rows.select("source_no", "block", "passes", "all_blocks", "number", need.alias("_need")), "mix-blocks")
    running = Window.partitionBy("source_no", "block").orderBy("order", "row").rowsBetween(Window.unboundedPreceding, -1)
    taken = found.join(rows.hint("merge"), ["source_no", "block"]).withColumn("_before", F.coalesce(F.sum("size").over(running), F.lit(0)))
    # a document is in when at least half of it fits, so the sum ends within half a document of the target
    extra = (F.col("size") > 0) & (F.col("_need") >= F.col("_before") + F.col("size") / 2)
    taken = taken.withColumn("copies", F.when(F.col("size") > 0, F.col("passes")).otherwise(0) + extra.cast("long"))
    taken = stash(taken.select("row", "doc_id", "source", "source_no", "size", "source_size", "target", "block", "order", "copies"), "mix-taken")

    # the draws of a source in order: pass by pass, block by block; a shard takes as many as its quota from where the last ended
    # blocks of the last pass come first in their order, so a draw's number follows from its block's
    part = F.col("_need") > 0
    # sequence(1, 0) would count down: a block without draws has no row
    draws = rows.withColumn("n", F.col("passes") + part.cast("long")).where("n > 0")
    draws = draws.select("source_no", "block", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"), "all_blocks", "number")
    draws = draws.withColumn("draw", (F.col("copy") - 1) * F.col("all_blocks") + F.col("number"))
    quotas = draws.groupBy("source_no").agg(F.count("*").alias("quota"))
    ends = Window.partitionBy("source_no").orderBy("shard")
    ranges = split_quotas(quotas, shards, seed).withColumn("last", F.sum("draws").over(ends)).withColumn("first", F.col("last") - F.col("draws") + 1)
    # a row for each shard and draw number, so that shards and draws meet by equality
    slots = ranges.select("source_no", "shard", F.explode(F.sequence("first", "last")).alias("draw"))
    placed = stash(draws.join(slots.hint("merge"), ["source_no", "draw"]).select("source_no", "block", "copy", "shard"), "mix-placed")
    copies = taken.where("copies > 0").select("row", "source_no", "block", "order", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    place = F.xxhash64(F.lit(seed + 2), "shard", "order", "copy")
    drawn = copies.join(placed.hint("merge"), ["source_no", "block", "copy"]).select("row", "source_no", "block", "copy", "shard", place.alias("place"))
    drop_stash(sized, sources, targets, found, words, rows)
    return taken, drawn


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: a row of docs for each copy, with shard and place; a reader takes a shard in order of place.

    docs: see mix_plan; all its columns are kept, but for any named mix_copy, mix_shard or mix_place, which these replace.
    """
    new = ("mix_copy", "mix_shard", "mix_place")
    kept = [c for c in docs.columns if c.lower() not in new]
    row = fresh(docs, "mix_row")
    # rows get their numbers once, in a written table, so that both readings agree
    numbered = stash(docs.select(*kept, F.monotonically_increasing_id().alias(row)), "mix-documents")
    _, drawn = mix_plan(numbered.select(F.col(row).alias("row"), "doc_id", "text", "source"), **options)
    drawn = stash(drawn.select(F.col("row").alias(row), F.col("copy").alias("mix_copy"), F.col("shard").alias("mix_shard"), F.col("place").alias("mix_place")), "mix-drawn")
    return numbered.join(drawn.hint("merge"), row).select(*kept, *new)


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """A row for each row of docs: doc_id, size, source_size, target, taken (the words that its copies in the mix have
    together), and the shards of its copies with the places there."""
    # rows are numbered once: mix_plan writes them out before it reads them twice
    taken, drawn = mix_plan(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "source"), **options)
    own = drawn.groupBy("row").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("copy", "shard", "place"))).alias("c"))  # two copies at most
    none = F.array().cast("array<long>")
    return taken.join(own.hint("merge"), "row", "left").select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.coalesce("n", F.lit(0))).alias("taken"),
        F.coalesce("c.shard", none).alias("shards"),
        F.coalesce("c.place", none).alias("places"),
    )
