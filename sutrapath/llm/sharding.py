"""Sharding: groups that must stay together, dealt over shards of nearly equal size.

Method.  Longest-processing-time scheduling: groups sorted by size, largest first, each to the least-loaded shard through a heap.
Groups with at least 1/4096 of all bytes or of all rows, so 8192 at most, are scheduled so in one go on the driver.  Their
loads say how much room is left below the level that all bytes would fill the shards to.  The others are dealt by
hash over tasks of a bounded number of groups; each task gives every shard its part of that room and schedules its own
groups, largest first, to the shard with most room left.  A task ends with its smallest groups, so it misses each
shard's part by little, and the misses of many tasks cancel out.

A group above a shard's fair share fills a shard of its own, and the others are nearly equal.  Groups of many rows are
counted before they are shuffled; a large group's shard is broadcast, so its rows are never dealt by their group.  Slots
come from ``common.numbered``: a shard with most rows lies in many tasks.

Defined results
* size is the text's UTF-8 bytes plus 16, 16 for null; a group are all rows of equal text, null texts being one group
  and empty ones another;
* ``text_crc32`` of a null text is null;
* slots ascend by doc_id within a shard (null first) and by the text's digest; of rows alike in both, any may be first;
* equal sizes are scheduled in the order of the texts' digests, equal loads to the lowest shard, so reruns agree; with a
  partitioning of another width small groups may move;
* shards may stay empty where there are fewer groups; no rows: no rows.  Other columns are neither read nor needed.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, scratch, stored

#: Bytes that a row counts besides its text.
ROW_BYTES = 16
#: One in so many of all bytes or rows makes a group large; groups of a task at most, on average.
LARGE, TASK_GROUPS = 4096, 200_000


def schedule(sizes: list[int], loads: list[float]) -> list[int]:
    """The shard of each size, in the given order, on top of ``loads``: always the least loaded, the lowest of equal ones."""
    heap = [(load, shard) for shard, load in enumerate(loads)]
    heapq.heapify(heap)
    out = []
    for size in sizes:
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        out.append(shard)
    return out


def level(loads: list[int], rest: int) -> float:
    """How high the shards are filled when ``rest`` goes where they are lowest."""
    rising = sorted(loads)
    for n in range(1, len(rising) + 1):
        height = (rest + sum(rising[:n])) / n
        if n == len(rising) or height <= rising[n]:
            return height
    return 0.0


def groups_of(rows: DataFrame) -> DataFrame:
    """(group, bytes, rows) of rows (group, size)."""
    return rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def assigned(groups: DataFrame, shards: int, large: int = LARGE, task_groups: int = TASK_GROUPS) -> tuple[DataFrame, DataFrame]:
    """(group, shard) of (group, bytes, rows), ``groups`` being stored: of the large groups, a bounded number, and of the others."""
    spark = groups.sparkSession
    total = groups.agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.count("*").alias("groups")).first()
    everything, every_row = total["bytes"] or 0, total["rows"] or 0
    big = (F.col("bytes") * large >= everything) | (F.col("rows") * large >= every_row)
    head = sorted(groups.where(big).collect(), key=lambda r: (-r["bytes"], r["group"]))  # 2 * ``large`` at most
    chosen = schedule([r["bytes"] for r in head], [0] * shards)
    loads = [0] * shards
    for r, shard in zip(head, chosen, strict=True):
        loads[shard] += r["bytes"]
    rest = everything - sum(loads)
    over = [(load - level(loads, rest)) / max(1, rest) for load in loads]  # a shard's room, below 0, by byte of the rest

    def place(batches):
        batches = [b for b in batches if b.num_rows]
        if batches:
            found = pa.Table.from_batches(batches).combine_chunks()
            key, size = found.column("group").to_pylist(), found.column("bytes").to_numpy()
            order = sorted(range(len(key)), key=lambda i: (-size[i], key[i]))
            own = int(size.sum())
            out = np.empty(len(key), dtype=np.int32)
            out[order] = schedule(size[order].tolist(), [x * own for x in over])
            yield pa.RecordBatch.from_arrays([found.column("group").combine_chunks(), pa.array(out)], ["group", "shard"])

    tasks = max(1, -(-((total["groups"] or 0) - len(head)) // task_groups))
    others = groups.where(~big).select("group", "bytes").repartition(tasks, "group").mapInArrow(place, "group binary, shard int")
    first = spark.createDataFrame([(r["group"], shard) for r, shard in zip(head, chosen, strict=True)], "group binary, shard int")
    return first, others


def joined_shards(rows: DataFrame, first: DataFrame, others: DataFrame) -> DataFrame:
    """``rows`` with the shard of their group: large groups from a broadcast table, the others by a join on the group."""
    named = first.withColumnRenamed("group", "_large")
    known = F.col("group") == F.col("_large")
    large = rows.join(F.broadcast(named), known).drop("_large")  # 2 * LARGE rows at most
    return large.unionByName(rows.join(F.broadcast(named.select("_large")), known, "left_anti").join(others, "group"))


def shard(docs: DataFrame, shards: int = 40, large: int = LARGE, task_groups: int = TASK_GROUPS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: nothing is said of another number of shards) of every document."""
    spark = docs.sparkSession
    with scratch(spark) as kept:
        size = (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long")
        rows = stored(docs.select("doc_id", size.alias("size"), F.crc32("text").alias("text_crc32"), _group().alias("group")), "shard-rows")
        first, others = assigned(stored(groups_of(rows), "shard-groups"), shards, large, task_groups)
        out = numbered(joined_shards(rows, first, others), ["shard"], ["doc_id", "group"], "slot", "_rows", "shard-slots")
        out = stored(out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")), "sharded")
        kept.append(out)
    return out


def _group():
    """A text's SHA-256; of null the empty value."""
    return F.coalesce(F.unhex(F.sha2("text", 256)), F.lit(b""))


def write(docs: DataFrame, path: str, shards: int = 40, file_bytes: int = 128 << 20) -> None:
    """Writes the documents with all of their columns in a folder for each shard, in files of about ``file_bytes`` of text.

    Folders are named ``_shard=N``, with more underscores behind the name where ``docs`` have such a column.
    """
    spark, name = docs.sparkSession, "_shard"
    while name in docs.columns:
        name += "_"
    with scratch(spark):
        size = (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long")
        groups = stored(groups_of(docs.select(size.alias("size"), _group().alias("group"))), "shard-groups")
        first, others = assigned(groups, shards)
        rows = docs.select(F.struct(*docs.columns).alias("_row"), _group().alias("group"), F.xxhash64("doc_id", "text").alias("_any"))
        laid = joined_shards(rows, first, others).withColumnRenamed("shard", name)
        files = max(shards, -(-(groups.agg(F.sum("bytes")).first()[0] or 0) // file_bytes))
        laid = laid.repartitionByRange(files, name, "_any").sortWithinPartitions(name, F.col("_row.doc_id"))
        laid.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns], name).write.partitionBy(name).parquet(path)
