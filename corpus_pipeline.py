"""The corpus pipeline: documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept and returns a
DataFrame; all but the last return the columns of documents.  ``run`` writes each stage's result as
a Parquet table in the shared folder and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sutrapath.llm import language_id, mixing, ngram_join, packing, quality
from sutrapath.llm.common import dropped, scratch, stored, table


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those without letters (null and empty texts too), or without a language that has half of the letters, go.

    Texts are read whole; repeated rows and ties are decided alike; other columns stay as they are.
    """
    return language_id.keep_identified(docs)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good; it learns from ``labels`` of the documents still there.

    A text without words has the score of the bias, which without any label keeps all rows.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, Jaccard index 0.8): the one with the least id.

    Rows without an id or without words stay; of rows with equal id and text one stays.
    """
    return ngram_join.one_of_each(docs, width=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources mixed to their target weights: whole documents, once for each shard that draws them, in shuffled shards.

    Null and empty texts have no words and are in no mix; rows with equal id and size are drawn alike.
    """
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens; workers that other stages have used take little memory more."""
    return packing.pack(docs, remembered=40_000, slice_bytes=2 << 20, batch_rows=500, forget=True)


STAGES = [
    ("language_id", identified),
    ("quality", good),
    ("ngram_join", unlike),
    ("mixing", mixed),
    ("packing", packed),
]

#: SQL can express neither the learned models nor the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage has stored goes once its result is, and that once the next one's is."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as kept:
            before, docs = docs, stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
            kept.append(docs)
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
