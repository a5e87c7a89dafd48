"""Near copies by the Jaccard similarity of their word shingles: an exact grouped prefix join.

1. Documents with the same set are one class. In one pass over the texts every shingle is dealt by its hash to where its
   classes are counted, packed as arrays. A part of a batch settles what it can before: of the sets there that hold a shingle
   two are dealt, and the others are known to share it, so a common shingle comes to its task twice for each part and not
   once for each document. Two sets can be similar only if 80 % of a set's shingles occur in others too, so most classes end here.
2. The shingles of the rest are put in order of frequency. Similar sets share one of their first (rarest) few, the
   prefix. Sets with the same prefix and size are one group, and pairs of groups are filtered by size, position and bits.
3. Within a shingle's list the group with the fewest shingles of its own is tested against the others, and every group
   against its members. What that connects needs no more tests. Then each pair of groups whose members are not all
   connected yet is expanded, and its members verified. So a large group of near copies needs about as many tests as it
   has members, while every link between what isn't connected otherwise is tested.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, buckets, column, drop_stash, fresh, mixed, rolled, ship, slices, stash, word_hashes
from .graph import components

SHINGLE, PERCENT = 5, 80
SKETCH = ("b0", "b1", "b2", "b3")
PACKED = "bucket int, keys binary, counts binary, tokens binary, docs binary, known binary"
FACTS = "kind int, doc_id long, print long, n long, fp1 long, fp2 long, r long"
DOC = np.dtype([("known", "<i8"), ("doc_id", "<i8"), ("print", "<i8"), ("n", "<i8"), ("fp1", "<i8"), ("fp2", "<i8")])
KNOWN = np.dtype([("fp1", "<i8"), ("r", "<i8")])


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """The distinct shingles of a text as sorted hashes: k words each, or all words if there are fewer; A-Z lower-cased."""
    w = word_hashes(text.lower().split())
    if not len(w):
        return np.empty(0, "<u8")
    h = rolled(w, k) if len(w) >= k else mixed(rolled(w, len(w)) + np.uint64(len(w)))
    h.sort()
    return h[np.r_[True, h[1:] != h[:-1]]]


def pack_sets(docs: DataFrame, k: int) -> DataFrame:
    """Shingles by bucket: the sets' keys, how many shingles of each set follow, and 32 bits of each shingle's hash; and the
    rows' own facts, with what is known here already of how many of a set's shingles others have."""
    n_buckets = buckets(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = [shingle_set(t, k) for t in column(part, "text")]
                info = np.zeros(len(sets), DOC)
                ids = part.column("doc_id").cast(pa.int64())
                info["known"], info["doc_id"], info["print"] = np.asarray(ids.is_valid()), np.asarray(ids.fill_null(0)), np.asarray(part.column("print"))
                info["n"] = [len(s) for s in sets]
                both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), "<i8").reshape(-1, 2)
                info["fp1"], info["fp2"] = both[:, 0], both[:, 1]
                # equal sets once, then the shingles in order, with the sets that have them
                keys, at = np.unique(info["fp1"], return_index=True)
                tokens = np.concatenate([sets[i] for i in at])
                owner = np.repeat(np.arange(len(at)), info["n"][at])
                order = np.argsort(tokens, kind="stable")
                tokens, owner = tokens[order], owner[order]
                starts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]]) if len(tokens) else np.empty(0, np.int64)
                sent = np.arange(len(tokens)) - np.repeat(starts, np.diff(np.r_[starts, len(tokens)])) < 2
                known = np.zeros(len(keys), KNOWN)
                known["fp1"], known["r"] = keys, np.bincount(owner[~sent], minlength=len(keys))
                tokens, owner = tokens[sent], owner[sent]
                bucket = ((tokens >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.int32)
                order = np.lexsort((owner, bucket))
                bucket, owner, low = bucket[order], owner[order], tokens[order].astype("<u4")
                # runs of one owner in one bucket, and where each bucket's runs and shingles begin
                starts = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1])]) if len(owner) else np.empty(0, int)
                counts, run_keys, run_bucket = np.diff(np.r_[starts, len(owner)]).astype("<u4"), keys[owner[starts]], bucket[starts]
                home = int(info["fp2"][0]) % n_buckets
                present = np.union1d(run_bucket, [home]).astype(np.int32)
                a, b = np.searchsorted(run_bucket, present), np.searchsorted(run_bucket, present, "right")
                c, d = np.searchsorted(bucket, present), np.searchsorted(bucket, present, "right")
                cut = lambda x, a, b: pa.array([x[i:j].tobytes() for i, j in zip(a, b, strict=True)], pa.binary())
                at_home = lambda x: pa.array([x.tobytes() if p == home else b"" for p in present], pa.binary())
                cols = [pa.array(present), cut(run_keys, a, b), cut(counts, a, b), cut(low, c, d), at_home(info), at_home(known[known["r"] > 0])]
                yield pa.RecordBatch.from_arrays(cols, ["bucket", "keys", "counts", "tokens", "docs", "known"])

    return docs.select("doc_id", "print", "text").mapInArrow(run, PACKED)


def joined(t: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(t.column(name).to_pylist()), kind)


def count_shared(packed: DataFrame) -> DataFrame:
    """The rows' own facts (kind 0), and of each set in each bucket r, how many of its shingles another set has too (kind 1),
    and what parts knew of that before (kind 2)."""

    def run(t: pa.Table) -> pa.Table:
        keys, dense = np.unique(joined(t, "keys", "<i8"), return_inverse=True)
        own = np.repeat(dense.astype("<u8"), joined(t, "counts", "<u4"))
        codes = joined(t, "tokens", "<u4").astype("<u8") << np.uint64(32) | own
        codes.sort()
        if len(codes):
            codes = codes[np.r_[True, codes[1:] != codes[:-1]]]
        token = codes >> np.uint64(32)
        same = token[1:] == token[:-1]
        shared = np.r_[False, same] | np.r_[same, False] if len(codes) else np.empty(0, bool)
        r = np.bincount((codes & np.uint64(0xFFFFFFFF)).astype(np.int64)[shared], minlength=len(keys))
        docs, known = joined(t, "docs", DOC), joined(t, "known", KNOWN)
        some, none = len(docs), int((r > 0).sum()) + len(known)
        col = lambda name: pa.concat_arrays([pa.array(docs[name]), pa.nulls(none, pa.int64())])
        return pa.table(
            {
                "kind": pa.array(np.repeat(np.arange(3, dtype=np.int32), [some, none - len(known), len(known)])),
                "doc_id": pa.concat_arrays([pa.array(docs["doc_id"], mask=docs["known"] == 0), pa.nulls(none, pa.int64())]),
                "print": col("print"),
                "n": col("n"),
                "fp1": pa.array(np.r_[docs["fp1"], keys[r > 0], known["fp1"]]),
                "fp2": col("fp2"),
                "r": pa.concat_arrays([pa.nulls(some, pa.int64()), pa.array(np.r_[r[r > 0], known["r"]].astype("<i8"))]),
            }
        )

    return packed.groupBy("bucket").applyInArrow(run, FACTS)


def sets_of(docs: DataFrame, k: int) -> DataFrame:
    """sid, n, tokens, and 256 bits: whether an odd number of the set's hashes begin with each byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = [shingle_set(t, k) for t in column(part, "text")]
                n = np.array([len(s) for s in sets])
                flat = pa.array(np.concatenate(sets).view("<i8"))
                lists = pa.ListArray.from_arrays(pa.array([0, *np.cumsum(n)], pa.int32()), flat)
                odd = [np.packbits(np.bincount(s >> np.uint64(56), minlength=256).astype(np.uint8) & 1) for s in sets]
                bits = np.concatenate(odd).view("<i8").reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([part.column("sid"), pa.array(n, pa.int64()), lists, *(pa.array(bits[:, i].copy()) for i in range(4))], ["sid", "n", "tokens", *SKETCH])

    return docs.select("sid", "text").mapInArrow(run, "sid long, n long, tokens array<long>, " + ", ".join(f"{b} long" for b in SKETCH))


def chosen(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id and print are among ids, with the sid there."""
    rows, few = docs.select("doc_id", "print", "text"), ids.count() <= BROADCAST_KEYS
    ids = ids.withColumnRenamed("doc_id", "_doc")
    return rows.join(F.broadcast(ids) if few else ids.hint("merge"), "print").where("doc_id = _doc").select("sid", "text")


def similar_enough(common: Column, n1: Column, n2: Column, percent: int) -> Column:
    return common * (100 + percent) >= (n1 + n2) * percent


def may_match(a: str, b: str, percent: int) -> Column:
    """Filters by size and position, which are the same for all members of a group and lose no similar pair.

    Before the shared shingle at most as many match as either has shared ones, after it as many as follow.
    """
    c = lambda s, x: F.col(f"{s}.{x}")
    before, after = F.least(c(a, "pos") - c(a, "u"), c(b, "pos") - c(b, "u")), F.least(c(a, "n") - c(a, "pos"), c(b, "n") - c(b, "pos"))
    sizes = F.least(c(a, "n"), c(b, "n")) * 100 >= F.greatest(c(a, "n"), c(b, "n")) * percent
    return sizes & similar_enough(before + after, c(a, "n"), c(b, "n"), percent)


def bits_allow(a: str, b: str, percent: int) -> Column:
    """A filter of two single sets that loses no similar pair: each bit that differs takes a shingle that only one has."""
    c = lambda s, x: F.col(f"{s}.{x}")
    apart = sum((F.bit_count(c(a, x).bitwiseXOR(c(b, x))) for x in SKETCH), F.lit(0))
    return apart * (100 + percent) <= (c(a, "n") + c(b, "n")) * (100 - percent)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    x = sets.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    y = sets.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    bits = sets.select("sid", "n", *SKETCH)
    told = pairs.join(bits.withColumnRenamed("sid", "a").alias("x").hint("merge"), "a").join(bits.withColumnRenamed("sid", "b").alias("y").hint("merge"), "b")
    both = told.where(bits_allow("x", "y", percent)).select("a", "b").join(x.hint("merge"), "a").join(y.hint("merge"), "b")
    return both.where(similar_enough(F.size(F.array_intersect("ta", "tb")), F.col("na"), F.col("nb"), percent)).select("a", "b")


def set_links(sets: DataFrame, percent: int) -> DataFrame:
    """sid and component over sets (sid, n, tokens, bits; a row for each sid) that are linked with any other."""
    postings = sets.select("sid", "n", F.explode("tokens").alias("token"))
    # written out, so that the joins below are between two shuffles, which are split where a shingle is hot
    df = stash(postings.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "shared-shingles")
    order = F.sort_array(F.collect_list(F.struct("df", "token")))
    ordered = postings.join(df.hint("merge"), "token").groupBy("sid", "n").agg(order.alias("t"), F.sum("df").alias("common"))
    # u shingles are the set's own; they come first and match nothing
    need = F.floor((F.col("n") * percent + 99) / 100)
    prefixes = ordered.withColumn("u", F.col("n") - F.size("t")).withColumn("of", (F.col("n") - need + 1 - F.col("u")).cast("int"))
    prefixes = stash(prefixes.where("of > 0").select("sid", "n", "u", "common", F.slice(F.col("t.token"), F.lit(1), F.col("of")).alias("prefix")), "prefixes")

    # the same prefix and size: one group, named after its least member
    key = [F.col("n"), F.col("u"), F.when(F.col("u") == 0, F.xxhash64("prefix")).otherwise(F.col("sid")).alias("key")]
    keyed = prefixes.select("sid", *key)
    groups = keyed.groupBy("n", "u", "key").agg(F.min("sid").alias("gid"), (F.count("*") == 1).alias("single"))
    members = stash(keyed.join(groups.hint("merge"), ["n", "u", "key"]).select("gid", "sid", "single"), "members")
    heads = prefixes.join(members.where("gid = sid").select("sid", "single").hint("merge"), "sid")
    heads = heads.join(sets.select("sid", *SKETCH).hint("merge"), "sid")
    lists = stash(heads.select(F.col("sid").alias("gid"), "n", "u", "single", "common", *SKETCH, F.posexplode("prefix").alias("at", "token")).select("token", "gid", "n", "u", "single", "common", *SKETCH, (F.col("u") + F.col("at")).alias("pos")), "prefix-lists")

    # first tests: the most typical group of each list against the others, and each group against its members
    # (fewest shingles of its own, then the most of what others have too)
    typical = F.struct((F.col("u") / F.col("n")).alias("own"), (-F.col("common")).alias("common"), "gid", "n", "u", "pos", *SKETCH)
    pivots = stash(lists.groupBy("token").agg(F.min(typical).alias("p"), F.count("*").alias("df")).where("df > 1").select("token", "p"), "pivots")
    star = lists.alias("x").join(pivots.hint("merge"), "token").where((F.col("x.gid") != F.col("p.gid")) & may_match("x", "p", percent) & bits_allow("x", "p", percent))
    star = star.select(F.least("x.gid", "p.gid").alias("a"), F.greatest("x.gid", "p.gid").alias("b"))
    tested = stash(star.unionByName(members.where("gid <> sid").select(F.col("gid").alias("a"), F.col("sid").alias("b"))).distinct(), "first-pairs")
    links = stash(verified(tested, sets, percent), "first-links")

    # then what these tests left apart
    found = stash(components(links), "first-components")
    placed = members.select("gid", "sid").join(found.withColumnRenamed("v", "sid").hint("merge"), "sid", "left").select("gid", "sid", F.coalesce("c", "sid").alias("c"))
    placed = stash(placed, "placed")
    units = lists.join(placed.groupBy("gid", "c").agg(F.lit(1).alias("_")).drop("_").hint("merge"), "gid")
    units = stash(units, "units")
    main = units.groupBy("token", "c").agg(F.count("*").alias("k")).groupBy("token").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.count("*").alias("cs")).where("cs > 1").select("token", "main")
    main = stash(main, "main-components")
    apart = stash(units.join(main.hint("merge"), "token"), "apart")
    x, y = apart.where("c <> main").alias("x"), apart.alias("y")
    crossed = (F.col("x.c") != F.col("y.c")) & ((F.col("y.c") == F.col("y.main")) | (F.struct("x.c", "x.gid") < F.struct("y.c", "y.gid")))
    # bits are those of a group's first member, so they tell only of groups of one
    told = ~(F.col("x.single") & F.col("y.single")) | bits_allow("x", "y", percent)
    pairs = x.join(y.hint("merge"), "token").where(crossed & may_match("x", "y", percent) & told)
    pairs = pairs.select(F.col("x.gid").alias("g"), F.col("x.c").alias("c"), F.col("y.gid").alias("h"), F.col("y.c").alias("d")).distinct()
    pairs = pairs.join(placed.select(F.col("gid").alias("g"), "c", F.col("sid").alias("a")).hint("merge"), ["g", "c"])
    pairs = pairs.join(placed.select(F.col("gid").alias("h"), F.col("c").alias("d"), F.col("sid").alias("b")).hint("merge"), ["h", "d"])
    rest = stash(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(tested.hint("merge"), ["a", "b"], "left_anti"), "last-pairs")
    more = stash(verified(rest, sets, percent), "last-links")
    first = found
    if more.limit(1).count():
        found = stash(components(links.unionByName(more)), "components")
        drop_stash(first)
    drop_stash(df, prefixes, members, lists, pivots, tested, links, placed, units, main, apart, rest, more)
    return found


def row_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs: doc_id, text, print. For each doc_id and print: rows (how many there are), n, class_id, component_id and
    component_print (the row that the component is named after)."""
    facts = count_shared(pack_sets(docs, shingle))
    r = F.when(F.col("kind") == 2, F.max("r")).otherwise(F.sum("r"))  # parts that hold the same set know of the same shingles
    facts = stash(facts.groupBy("kind", "doc_id", "print", "n", "fp1", "fp2").agg(r.alias("r"), F.count("*").alias("rows")), "set-facts")
    rows = facts.where("kind = 0").drop("kind", "r")
    first = F.min(F.struct("doc_id", "print"))
    classes = rows.where("n > 0 and doc_id is not null").groupBy("fp1", "fp2", "n").agg(first.alias("rep"), F.count("*").alias("size"))
    shared = facts.where("kind > 0").groupBy("fp1").agg(F.sum("r").alias("r"))
    classes = classes.join(shared.hint("merge"), "fp1", "left").withColumn("alive", F.coalesce(F.col("r") * 100 >= F.col("n") * percent, F.lit(False)))
    # classes get their numbers in a written table
    classes = stash(classes.select("fp1", "fp2", "rep", "size", "alive", F.monotonically_increasing_id().alias("sid")), "set-classes")
    alive = stash(classes.where("alive").select("rep.doc_id", "rep.print", "sid"), "alive-sets")
    named = classes.where("size > 1 or alive").select("fp1", "fp2", "rep", "sid")
    if alive.limit(1).count():
        # wholly equal rows give a set twice
        sets = stash(sets_of(chosen(docs, alive), shingle).dropDuplicates(["sid"]), "sets")
        found = set_links(sets, percent).withColumnRenamed("v", "sid")
        named = stash(named.join(found.hint("merge"), "sid", "left"), "set-components")
        heads = stash(named.where("c is not null").groupBy("c").agg(F.min("rep").alias("head")), "component-heads")
        named = named.join(heads.hint("merge"), "c", "left").select("fp1", "fp2", "rep", F.coalesce("head", "rep").alias("head"))
    else:
        named = named.select("fp1", "fp2", "rep", F.col("rep").alias("head"))
    named = stash(named, "named-sets")
    out = rows.where("n > 0 and doc_id is not null").join(named.hint("merge"), ["fp1", "fp2"], "left")
    own = F.struct("doc_id", "print")
    out = out.withColumn("rep", F.coalesce("rep", own)).withColumn("head", F.coalesce("head", own))
    alone = rows.where("n = 0 or doc_id is null").withColumn("rep", own).withColumn("head", own)
    return out.select(*alone.columns).unionByName(alone).select("doc_id", "print", "rows", "n", F.col("rep.doc_id").alias("class_id"), F.col("head.doc_id").alias("component_id"), F.col("head.print").alias("component_print"))


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, class_id, component_id.

    docs: doc_id and text; other columns are ignored. Two documents link where intersection / union of their shingle sets
    is at least percent / 100. class_id is the smallest doc_id with the same set; component_id the smallest that links
    lead to. A text that is null or has no words has no shingles and no links, so both are its own doc_id. Rows that
    share a doc_id are documents of their own, each with its own set; those with a null doc_id have null for both and link
    with nothing. Sets are of 64-bit hashes, and equal sets are found by 128 bits of hash. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    found = row_components(docs.select("doc_id", "text", F.xxhash64("text").alias("print")), shingle, percent)
    each = F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("_row")
    return found.select("doc_id", F.col("n").alias("n_shingles"), "class_id", "component_id", each).drop("_row")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs without near copies: of each component one row of the smallest doc_id stays. Rows without a doc_id or without
    words are in no component, and stay."""
    ship(docs.sparkSession)
    print_, id_ = fresh(docs, "_print"), fresh(docs, "_id")
    found = row_components(docs.select("doc_id", "text", F.xxhash64("text").alias("print")), shingle, percent)
    found = stash(found.where("n > 0 and doc_id is not null"), "near-copies")
    key = [F.col("doc_id").alias(id_), F.col("print").alias(print_)]
    stays = (F.col("doc_id") == F.col("component_id")) & (F.col("print") == F.col("component_print"))
    gone, twice = found.where(~stays).select(*key), found.where(stays & (F.col("rows") > 1)).select(*key)
    own = docs.withColumn(print_, F.xxhash64("text"))
    same = lambda keys: (own["doc_id"] == keys[id_]) & (own[print_] == keys[print_])
    near = lambda keys: F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys.hint("merge")
    own = own.join(near(gone), same(gone), "left_anti")
    if twice.limit(1).count():
        # equal rows are one document
        many = near(twice)
        own = own.join(many, same(twice), "left_anti").unionByName(own.join(many, same(twice), "left_semi").dropDuplicates(["doc_id", print_]))
    return own.select(*docs.columns)
