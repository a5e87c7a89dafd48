"""Spelling variants: words one code point apart, found with an index of variable-length grams, and the common word that each stands for.

The gram dictionary holds all grams of LEAST code points in the words, and one code point more wherever a gram is frequent, up to
LONGEST. A word is cut into the longest grams of the dictionary from each place, less those inside an earlier one. For every edit it is
worked out which of its grams the edit may change; the worst case bounds how many, so of so many and one more, rarest first,
two words that are one edit apart share one that neither lost. Left or right of that gram they are equal up to their ends, so the
lists of the index are kept by the gram with the whole side: a list is a key of a join and never all words with a gram.
A list that is still long is cut by halves of what its words don't share yet (one of the two halves is equal), and so are the
words all of whose grams an edit may change. Whatever shares a list is verified by edit distance.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, drop_stash, ship, slices, stash

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: A run whose hash this divides loses a code point.
SLIP = 199
LETTERS, OCCURRENCES, TIMES = 6, 5, 5
LEAST, LONGEST = 2, 3
#: A gram is frequent if it stands at more than one in so many places. So many grams at most are frequent at each length, and
#: the dictionary has at most so many times the alphabet (90 letters) besides those of LEAST.
DETAIL = 4096
#: Words of a list at most, unless they differ in two code points of one place only.
MOST = 64
#: Words that a task counts before it passes them on.
HELD = 300_000


def word_counts(docs: DataFrame, slip: int = SLIP, letters: int = LETTERS, occurrences: int = OCCURRENCES) -> DataFrame:
    """word and n: the runs of letters of all texts, A-Z lower-cased, after the slips; see spelling_variants()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for part in slices(batch):
                for doc, text in zip(part.column("doc_id").to_pylist(), column(part, "text"), strict=True):
                    start = zlib.crc32(b"%s:" % (b"" if doc is None else str(doc).encode()))
                    for word, n in Counter(RUN.findall(text.lower().decode())).items():
                        h = zlib.crc32(word.encode(), start)
                        if h % slip == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                        if len(word) >= letters:
                            total[word] += n
                    if len(total) > HELD:
                        yield flush()
        yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def dictionary(words: DataFrame, least: int = LEAST, longest: int = LONGEST, detail: int = DETAIL) -> dict[str, int]:
    """The grams and how many places have them; its size is bounded by the alphabet and detail, so it comes to the driver."""
    substrings = lambda q: F.transform(F.sequence(F.lit(1), F.length("word") - q + 1), lambda p: F.substring("word", p, F.lit(q)))
    every = F.flatten(F.array(*[substrings(q) for q in range(least, longest + 1)]))
    counts = stash(words.where(F.length("word") >= longest).select(F.explode(every).alias("gram")).groupBy("gram").agg(F.count("*").alias("c")), "grams")
    places = words.agg(F.sum(F.length("word")).alias("s")).first()["s"] or 0
    frequent = counts.where((F.length("gram") < longest) & (F.col("c") > places / detail)).select(F.col("gram").alias("short"))
    kept = counts.withColumn("short", F.expr("substring(gram, 1, length(gram) - 1)")).join(frequent.hint("merge"), "short", "left_semi")
    found = {r["gram"]: r["c"] for r in kept.where(F.length("gram") > least).union(counts.where(F.length("gram") == least).withColumn("short", F.lit("")).select(kept.columns)).collect()}
    drop_stash(counts)
    return found


class Grams:
    """A gram dictionary with what tells which grams of a word an edit may change."""

    def __init__(self, counts: dict[str, int], least: int = LEAST, longest: int = LONGEST):
        self.counts, self.least, self.longest = counts, least, longest
        self.beginnings = {g[:k] for g in counts for k in range(1, len(g))}
        self.insides = {g[a:b] for g in counts for a in range(1, len(g)) for b in range(a + 1, len(g) + 1)}

    def cut(self, word: str) -> list[tuple[int, int]]:
        """The word's grams as (begin, end)."""
        out, end = [], 0
        for p in range(len(word) - self.least + 1):
            q = min(self.longest, len(word) - p)
            while q > self.least and word[p : p + q] not in self.counts:
                q -= 1
            if p + q > end:
                end = p + q
                out.append((p, end))
        return out

    def affected(self, word: str, grams: list[tuple[int, int]]) -> int:
        """How many grams one edit may change at most.

        An edit at i changes those across it; those before it, from the first place whose gram could come to reach over i; and
        those after it that a gram from before their beginning could come to cover.
        """
        n, worst = len(word), 0
        for i in range(n + 1):
            first = next((j for j in range(max(0, i - self.longest + 1), i) if i - j < self.least or word[j:i] in self.beginnings), i)
            for after in (i, i + 1)[: 1 + (i < n)]:
                last = after
                while last < n and last - after < self.longest - 1 and word[after : last + 1] in self.insides:
                    last += 1
                worst = max(worst, sum((b > i and a < after) or (b <= i and a >= first) or (a >= after and b <= last) or a < i < b for a, b in grams))
        return worst

    def lists(self, word: str) -> Iterator[tuple[str, int, int]]:
        """The lists that the word is in: key, and how much its members share at their beginnings and at their ends."""
        grams = self.cut(word)
        different, lost = {word[a:b] for a, b in grams}, self.affected(word, grams)
        if lost >= len(different):
            yield "", 0, 0
        rarest = set(sorted(different, key=lambda g: (self.counts.get(g, 0), g))[: lost + 1])
        for a, b in grams:
            if word[a:b] in rarest:
                yield f"{b - a}<{word[:b]}", b, 0
                yield f"{b - a}>{word[a:]}", 0, len(word) - a


def listed(words: DataFrame, grams: Grams) -> DataFrame:
    """key, word, n, a and z: the lists of the index with their words."""
    shared = words.sparkSession.sparkContext.broadcast(grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(key, word, n, a, z) for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True) for key, a, z in shared.value.lists(word)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["key", "word", "n", "a", "z"])

    return words.select("word", "n").mapInArrow(run, "key string, word string, n long, a int, z int").withColumn("key", F.xxhash64("key"))


def halves(rows: DataFrame) -> DataFrame:
    """The lists by halves of what their words don't share: equally long words by their own halves, and each with one that is
    a code point longer by those of the shorter."""
    width = F.length("word") - F.col("a") - F.col("z")
    rows = rows.withColumn("t", F.explode(F.array(width, width - 1))).where("t >= 0")
    left = F.floor((F.col("t") + 1) / 2).cast("int")
    side = lambda name, text, a, z: F.struct(F.xxhash64("key", "t", F.lit(name), text).alias("key"), a.cast("int").alias("a"), z.cast("int").alias("z"))
    right = F.col("t") - left
    first = side("<", F.substring("word", F.col("a") + 1, left), F.col("a") + left, F.col("z"))
    last = side(">", F.substring("word", F.length("word") - F.col("z") - right + 1, right), F.col("a"), F.col("z") + right)
    return rows.select("word", "n", F.explode(F.array(first, last)).alias("h")).select("h.key", "word", "n", "h.a", "h.z")


def near_words(words: DataFrame, most: int = MOST, detail: int = DETAIL) -> DataFrame:
    """word, n, other and other_n for each two words (both ways) that are one edit apart. words: word and n, written out."""
    rows, done, used = listed(words, Grams(dictionary(words, detail=detail))), [], []
    while True:
        rows = stash(rows, "gram-lists")
        width = F.max(F.length("word") - F.col("a") - F.col("z"))
        sizes = rows.groupBy("key").agg(F.count("*").alias("size"), width.alias("width")).where("size > 1")
        # a list may have most words: a merge join is split where it is hot
        sized = stash(rows.join(sizes.hint("merge"), "key"), "sized-lists")
        used += [rows, sized]
        short = (F.col("size") <= most) | (F.col("width") <= 2)
        done.append(sized.where(short).select("key", "word", "n"))
        left = sized.where(~short)
        if not left.limit(1).count():
            break
        rows = halves(left.select("key", "word", "n", "a", "z"))
    lists = stash(reduce(DataFrame.unionByName, done), "lists")
    other = lists.select("key", F.col("word").alias("other"), F.col("n").alias("other_n"))
    close = (F.col("word") < F.col("other")) & (F.abs(F.length("word") - F.length("other")) <= 1) & (F.levenshtein("word", "other", 1) == 1)
    pairs = stash(lists.join(other.hint("merge"), "key").where(close).select("word", "n", "other", "other_n").distinct(), "near-words")
    drop_stash(*used, lists)
    return pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))


def roots(forms: DataFrame) -> DataFrame:
    """word and root, where forms (word, form) lead in the end; each round goes twice as far."""
    up = stash(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = stash(up.join(on.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        drop_stash(up)
        up = new
        if not new.where("moved").limit(1).count():
            return new.select("word", "root")


def spelling_variants(docs: DataFrame, most: int = MOST, detail: int = DETAIL) -> DataFrame:
    """word, form, root, n, n_near and form_n for each word.

    docs: doc_id and text. Words are runs of letters (A-Z, a-z, U+00C0 to U+00FF) with A-Z lower-cased, but a run for which SLIP divides
    the crc32 h of `<doc_id>:<run>` has lost its code point h % length; of these, words have LETTERS code points and OCCURRENCES
    occurrences at least. form: of the words one edit away the most frequent (ties: the smallest), if TIMES as frequent, else
    null; root follows forms to the last. n_near counts the words one edit away; form_n is the form's n. Null texts have no words,
    a null doc_id is written as nothing, rows that share a doc_id count each for itself, other columns are ignored; a table
    without words gives no rows.
    """
    ship(docs.sparkSession)
    words = stash(word_counts(docs), "words")
    near = near_words(words, most, detail)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    rows = words.join(best.hint("merge"), "word", "left").withColumn("own", -F.col("best.less") >= F.col("n") * TIMES)
    form = lambda c: F.when(F.col("own"), c)
    rows = stash(rows.select("word", form(F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), form(-F.col("best.less")).alias("form_n")), "variants")
    found = roots(rows.where("form is not null"))
    return rows.join(found.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.col("n_near").cast("long").alias("n_near"), "form_n")
