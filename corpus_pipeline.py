"""A corpus made ready for training: rules, toxicity, line dedup, near duplicates, packing.

Each stage takes all that its predecessor kept, written as a table and read again. The
first four return the columns of ``documents``; the last one the pieces of documents with
their places in sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmosaic.llm import line_dedup, ngram_join, packing, quality_rules, toxicity
from fieldmosaic.llm.common import documents, written
from fieldmosaic.llm.labelled import remainder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; references come from all of ``docs``."""
    return quality_rules.apply_rules(docs).where("kept").select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5, with a model learned from the labels of four fifths
    of the ids."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, remainder(5) != 0)
    return toxicity.score(docs, model).where("score < 0.5").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that stand in an earlier passage; ``n_chars`` follows."""
    return (
        line_dedup.remove_repeats(docs)
        .withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
        .select(*docs.columns)
    )


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near copies."""
    return ngram_join.keep_one(docs).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).drop("row")


STAGES = [
    ("quality_rules", quality),
    ("toxicity", toxic),
    ("line_dedup", lines),
    ("ngram_join", near_duplicates),
    ("packing", packed),
]

#: Toxicity and packing can't be put as SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
