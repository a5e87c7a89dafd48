"""Raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), with docs in the columns of the table `documents`, and returns the documents that
it keeps in the same columns; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideway.llm import op1_packing, op3_jaccard, op5_mixing, op7_line_dedup, op8_language
from strideway.llm.common import stash, table

#: The stages' decisions rest on fitted models, rolling hashes and drawn blocks, which SQL can't express.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or far from every language that the labelled ones have, go."""
    return op8_language.recognised(docs, op8_language.fit(docs))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks of lines that stand before go, with the equal lines around them; so does a document with nothing left."""
    kept = op7_line_dedup.line_dedup_texts(docs)
    text = F.col("text")
    return kept.where("text is null or trim(text) <> ''").withColumn("n_chars", F.when(text.isNull(), F.col("n_chars")).otherwise(F.length(text).cast("long")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return op3_jaccard.one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in proportion to their target weights: a row for each copy of a document in the mix."""
    return op5_mixing.mix_sources(docs).select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, with their ids, and the sequences that hold them."""
    return op1_packing.pack_documents(docs)


STAGES = [("language", language), ("repeated_lines", repeated_lines), ("near_copies", near_copies), ("source_mix", source_mix), ("sequences", sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
