"""A table by key that batches are merged into: only the buckets that a batch touches are read and written."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources import manifest
from ..sources.shared import cut

Merge = Callable[[DataFrame, DataFrame | None], DataFrame]


@dataclasses.dataclass
class KeyedTable:
    """Rows in buckets of a hash of ``key``, each a folder written by the last batch that touched it: ``data/vN/_bucket=B``.

    The manifest says which folder holds each bucket and which batch came last, so a batch that comes again, wholly or
    after a writer was lost halfway, changes nothing or is done anew.  Buckets that a batch doesn't touch keep their files.
    Older folders go once none of the last two versions names them; ``changes`` compares those two.
    """

    spark: SparkSession
    path: str
    key: list[str]
    buckets: int = 64

    def state(self) -> dict:
        return manifest.read(self.spark, self.path)

    def _read(self, state: dict, buckets: list[int] | None = None) -> DataFrame | None:
        held = {int(b): v for b, v in state.get("held", {}).items() if buckets is None or int(b) in buckets}
        if not held:
            return None
        schema = StructType.fromJson(state["schema"])
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/v{v}/_bucket={b}" for b, v in sorted(held.items())])

    def read(self) -> DataFrame | None:
        """The rows of the last version; none without one."""
        return self._read(self.state())

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int"))

    def merge(self, batch: DataFrame, number: int, merge: Merge) -> list[int]:
        """Merges the batch of that number; ``merge`` gets it and the rows of its buckets (or None), and gives their next rows.  Returns the buckets."""
        state = self.state()
        if number <= state.get("applied", -1):
            return []
        self.buckets = state.get("buckets", self.buckets)
        batch = cut(self._bucketed(batch))
        touched = sorted(r[0] for r in batch.select("_bucket").distinct().collect())  # the buckets
        version, held = state.get("version", 0) + 1, dict(state.get("held", {}))
        schema = state.get("schema")
        if touched:
            rows = merge(batch.drop("_bucket"), self._read(state, touched))
            schema = rows.schema.jsonValue()
            # a writer that was lost may have left files of this version
            self._bucketed(rows).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/data/v{version}")
            there = set(manifest.listed(self.spark, f"{self.path}/data/v{version}"))
            held = {b: v for b, v in held.items() if int(b) not in touched} | {str(b): version for b in touched if f"_bucket={b}" in there}
        manifest.commit(self.spark, self.path, state | {"buckets": self.buckets, "held": held, "applied": number, "schema": schema, "touched": touched})
        self.vacuum()
        return touched

    def vacuum(self) -> list[str]:
        named = {f"v{v}" for s in manifest.kept_versions(self.spark, self.path) for v in s["held"].values()}
        return manifest.vacuum(self.spark, self.path, {"data": named})

    def changes(self, number: int) -> DataFrame | None:
        """The rows that batch ``number``, the last one, brought or changed; none where it changed nothing."""
        versions = manifest.kept_versions(self.spark, self.path)
        if not versions or versions[-1]["applied"] != number or not versions[-1]["touched"]:
            return None
        after = self._read(versions[-1], versions[-1]["touched"])
        before = self._read(versions[-2], versions[-1]["touched"]) if len(versions) > 1 else None
        return after if before is None else after.exceptAll(before)
