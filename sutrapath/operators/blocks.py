"""Joins whose result is many rows for a key: a key's rows are dealt over blocks, and pairs of blocks are joined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def blocked_join(left: DataFrame, right: DataFrame, key: str, most: int = 1000) -> DataFrame:
    """All pairs of rows of equal ``key``; a task joins blocks of about ``most`` rows of either side.

    A key with up to ``most`` rows on each side is joined as it is.  Of a larger one each row goes once to every block of the
    other side: a share of 1 / ``most`` of the pairs that the result has anyway.
    """
    count = lambda df, name: df.groupBy(F.col(key).alias(f"_k{name}")).agg(F.count("*").alias(f"_n{name}"))
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / most)).cast("int")
    sizes = count(left, "l").join(count(right, "r"), F.col("_kl") == F.col("_kr")).select(F.col("_kl").alias("_key"), blocks("_nl").alias("_bl"), blocks("_nr").alias("_br"))

    def dealt(rows: DataFrame, own: str, other: str, at: str, against: str) -> DataFrame:
        block = F.pmod(F.xxhash64(*rows.columns), F.col(own)).cast("int")
        out = rows.join(sizes, F.col(key) == F.col("_key")).withColumn(at, block)
        return out.withColumn(against, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("_key", "_bl", "_br")

    a = dealt(left, "_bl", "_br", "_l", "_r")
    b = dealt(right, "_br", "_bl", "_r", "_l")
    return a.join(b, [key, "_l", "_r"]).drop("_l", "_r")
