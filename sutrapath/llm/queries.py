"""Queries of the training-data operators: thin, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, doc_fingerprint, embedding_dedup, language_id, lexical, license_scan, lm_scoring, merkle, mixing, ngram_join, packing, quality, sharding
from .common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language_id.identify_documents(table(spark, sf_dir, "documents"), spans=True)
    return out.select("doc_id", "held_out", "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.deduplicate(table(spark, sf_dir, "embeddings"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", F.size("shards").cast("long").alias("n_copies"), F.array_join(F.transform("shards", lambda k: k.cast("string")), ",").alias("shards"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.link(table(spark, sf_dir, "conversations"), turns=True)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.classify_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.attested(table(spark, sf_dir, "documents"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_language_id": op2_language_id,
    "op3_ngram_join": op3_ngram_join,
    "op4_fingerprint": op4_fingerprint,
    "op5_packing": op5_packing,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_mixing": op7_mixing,
    "op8_chat_format": op8_chat_format,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_quality": op10_quality,
    "op11_merkle": op11_merkle,
    "op12_sharding": op12_sharding,
    "op13_lexical": op13_lexical,
}

#: DuckDB equivalents where SQL can express the whole result.
ORACLES: dict[str, str] = {
    "op1_license_scan": license_scan.oracle_sql(),
    "op3_ngram_join": ngram_join.ORACLE_SQL,
    "op8_chat_format": chat_format.ORACLE_SQL,
    "op11_merkle": merkle.ORACLE_SQL,
    "op13_lexical": lexical.ORACLE_SQL,
}
