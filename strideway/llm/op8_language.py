"""Language by the nearest of several centroids.

A text is a vector of its lower-cased letters' byte n-grams (anything else in ASCII is a space), hashed to DIMENSIONS places, with TF-IDF weights and length 1. The
vectors of a bounded sample of labelled documents make a few centroids for each language (spherical k-means). A text gets
the language of the centroid with the largest cosine; it is rejected if the cosine is below what nearly all sampled
documents of that centroid have.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, ship, slices

DIMENSIONS, SIZES = 4096, (2, 3)
#: Documents to learn from: so many in all at most (about), shared evenly among languages.
SAMPLE_DOCS = 2048
CENTROIDS, ROUNDS = 4, 12
#: A text is rejected below this quantile of its centroid's sampled cosines, less MARGIN.
QUANTILE, MARGIN = 0.005, 0.1
SPACED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    idf: np.ndarray
    centroids: np.ndarray
    #: Of each centroid: the number of its language, and the least cosine that it takes.
    owner: np.ndarray
    least: np.ndarray


def counts(texts: list[bytes]) -> np.ndarray:
    """A row of n-gram counts for each text."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for row, text in zip(out, texts, strict=True):
        b = np.frombuffer(b" ".join(text.decode().lower().encode().translate(SPACED).split()), np.uint8).astype(np.uint32)
        for n in SIZES:
            if len(b) >= n:
                h = b[: len(b) - n + 1].copy()
                for i in range(1, n):
                    h = h * np.uint32(257) + b[i : len(b) - n + 1 + i]
                h = (h * np.uint32(2654435761)) >> np.uint32(20)
                row += np.bincount(h, minlength=DIMENSIONS)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def weighted(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return unit(np.sqrt(tf) * idf)


def cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Centroids of unit vectors: the first from the mean, each next from the vector farthest from those before."""
    c = unit(x.mean(axis=0, keepdims=True))
    while len(c) < min(k, len(x)):
        c = np.vstack([c, x[np.argmin((x @ c.T).max(axis=1))]])
    for _ in range(ROUNDS):
        at = (x @ c.T).argmax(axis=1)
        c = unit(np.vstack([x[at == i].mean(axis=0) if (at == i).any() else c[i] for i in range(len(c))]))
    return c


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame) -> LanguageModel | None:
    """Learn from text and lang of documents that aren't held out. The sample is drawn by a hash of doc_id, so reruns agree.
    Its size is about SAMPLE_DOCS vectors of DIMENSIONS counts, however long the texts are or often an id repeats.

    None without any labelled text.
    """
    ship(docs.sparkSession)
    known = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    n = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(SAMPLE_DOCS).collect()}
    if not n:
        return None
    each = SAMPLE_DOCS // len(n)
    share = F.create_map(*[F.lit(v) for lang, size in n.items() for v in (lang, each / size)])
    drawn = known.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53) < F.element_at(share, F.col("lang")))
    # one row of each doc_id, so that a repeated id is one sample
    drawn = drawn.groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("s")).select("doc_id", "s.lang", "s.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2_000_000, 1000):
                rows = counts(column(part, "text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("lang"), pa.array([r.astype("<f4").tobytes() for r in rows], pa.binary())], ["doc_id", "lang", "tf"])

    sample = sorted(drawn.mapInArrow(run, "doc_id long, lang string, tf binary").collect(), key=lambda r: (r["doc_id"], r["lang"], bytes(r["tf"])))
    if not sample:
        return None
    tf = np.vstack([np.frombuffer(r["tf"], "<f4") for r in sample])
    idf = (np.log((1 + len(tf)) / (1 + (tf > 0).sum(axis=0))) + 1).astype(np.float32)
    x, languages = weighted(tf, idf), tuple(sorted({r["lang"] for r in sample}))
    of = np.array([languages.index(r["lang"]) for r in sample])
    parts = [cluster(x[of == i], CENTROIDS) for i in range(len(languages))]
    centroids, owner = np.vstack(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    cosine = x @ centroids.T
    at, best = cosine.argmax(axis=1), cosine.max(axis=1)
    low = np.quantile(best, QUANTILE)
    least = np.array([min(low, np.quantile(best[at == i], QUANTILE)) if (at == i).any() else low for i in range(len(centroids))]) - MARGIN
    return LanguageModel(languages, idf, centroids.astype(np.float32), owner, least.astype(np.float32))


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """A row for each row of docs: doc_id, held_out, lang_pred, score (the cosine, 0 to 1), rejected.

    docs: doc_id and text; other columns are ignored, lang too. A text that is null or has no letter is `und` with score 0
    and rejected; so is every text without a model. Repeated rows are judged alike, and a null doc_id is not held out.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few centroids of DIMENSIONS places for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch, 2_000_000, 1000):
                texts = column(part, "text")
                has = np.array([m is not None and LETTER.search(t.decode()) is not None for t in texts])
                lang, score, out = np.full(len(texts), "und", object), np.zeros(len(texts)), np.ones(len(texts), bool)
                if has.any():
                    cosine = weighted(counts([t for t, h in zip(texts, has, strict=True) if h]), m.idf) @ m.centroids.T
                    at, best = cosine.argmax(axis=1), cosine.max(axis=1)
                    lang[has] = np.array(m.languages, object)[m.owner[at]]
                    score[has], out[has] = np.clip(best.astype(float), 0, 1), best < m.least[at]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("held_out"), pa.array(lang, pa.string()), pa.array(score), pa.array(out)], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def recognised(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """The rows of docs that the model doesn't reject, with all their columns."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch, 2_000_000, 1000):
                texts = column(part, "text")
                has = np.array([m is not None and LETTER.search(t.decode()) is not None for t in texts])
                if has.any():
                    cosine = weighted(counts([t for t, h in zip(texts, has, strict=True) if h]), m.idf) @ m.centroids.T
                    has[has] = cosine.max(axis=1) >= m.least[cosine.argmax(axis=1)]
                yield part.filter(pa.array(has))

    return docs.mapInArrow(run, docs.schema)
