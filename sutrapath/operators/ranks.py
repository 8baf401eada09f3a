"""Places and running sums in an order, worked out in two levels so that no key, and no whole table, is one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut


def numbered(rows: DataFrame, key: list[str], order: list[Column], at: str, total: str | None = None, upto: dict[str, str] | None = None) -> DataFrame:
    """``rows`` with ``at``, the place among the rows of equal ``key`` in ``order``, from 0.

    ``total`` names a column for how many these are; ``upto`` columns for running sums, by the column that each sums up to
    and with its row.  Rows are written once in range partitions of key and order; what is dealt by key is one small row
    for each partition that it lies in.
    """
    by = [*[F.col(c) for c in key], *order]
    laid = cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_mid", F.monotonically_increasing_id()))
    laid = laid.withColumn("_part", F.shiftright("_mid", 33))
    sums = upto or {}
    parts = laid.groupBy("_part", *key).agg(F.min("_mid").alias("_least"), F.count("*").alias("_rows"), *[F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()])
    own = Window.partitionBy(*key)
    earlier = own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    parts = parts.select(F.col("_part").alias("_num_part"), *[F.col(c).alias(f"_num_{c}") for c in key], (before("_rows") - F.col("_least")).alias("_shift"), F.sum("_rows").over(own).alias("_total"), *[before(f"_sum_{n}").alias(f"_before_{n}") for n in sums])
    same = F.col("_part") == F.col("_num_part")
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"_num_{c}"))
    out = laid.join(parts, same)
    inside = Window.partitionBy("_part", *key).orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)  # one range partition at most
    made = {at: F.col("_mid") + F.col("_shift"), **({total: F.col("_total")} if total else {})}
    made |= {n: F.sum(c).over(inside) + F.col(f"_before_{n}") for n, c in sums.items()}
    return out.withColumns(made).select(*[c for c in rows.columns if c not in made], *made)
