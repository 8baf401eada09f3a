"""Suggestion cache: a Parquet table by language, region and the first digits of its keys, which are hashes of folded queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold
from .manifest import listed
from .shared import cut

SCHEMA = "key string, query string, suggestions array<string>, language string, region string, shard string"
#: Digits of a key that name its partition.
SHARD = 2


def key(query: str = "query"):
    """First 24 hexadecimal digits of the folded query's SHA-256."""
    return F.substring(F.sha2(fold(F.col(query)), 256), 1, 24)


def read(spark: SparkSession, path: str, language: str, region: str) -> DataFrame:
    """(key, query, suggestions, shard) of one language and region; only those partitions are read.  Nothing is cached where there is no table."""
    if not listed(spark, path):
        return spark.createDataFrame([], SCHEMA).select("key", "query", "suggestions", "shard")
    rows = spark.read.schema(SCHEMA).parquet(path).where((F.col("language") == language) & (F.col("region") == region))
    return rows.select("key", "query", "suggestions", "shard")


def look_up(queries: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``queries`` (query, ...) that are cached, with suggestions and measured; and those that are not.  Only their keys' partitions are read."""
    asked = cut(queries.withColumns({"_key": key(), "_fold": fold(F.col("query"))}))
    shards = [r[0] for r in asked.select(F.substring("_key", 1, SHARD)).distinct().collect()]  # 16^SHARD at most
    # the folded query itself is compared too, as keys are shortened; of several answers one counts
    known = cached.where(F.col("shard").isin(shards)).select(F.col("key").alias("_k"), fold(F.col("query")).alias("_folded"), "suggestions")
    known = known.groupBy("_k", "_folded").agg(F.min("suggestions").alias("suggestions"))
    same = (F.col("_key") == F.col("_k")) & (F.col("_fold") == F.col("_folded"))
    hits = asked.join(known, same).select(*queries.columns, "suggestions").withColumn("measured", F.lit(True))
    return hits, asked.join(known, same, "left_anti").drop("_key", "_fold")


def write(results: DataFrame, path: str, language: str, region: str) -> None:
    """Adds measured results (query, measured, suggestions); what is not measured is never cached."""
    rows = results.where("measured").select(key().alias("key"), "query", "suggestions").dropDuplicates(["key", "query"])
    rows = rows.select("*", F.lit(language).alias("language"), F.lit(region).alias("region"), F.substring("key", 1, SHARD).alias("shard"))
    rows.repartition("shard").write.mode("append").partitionBy("language", "region", "shard").parquet(path)
