"""Continuous ingest of feed items with Structured Streaming: into a table by key, and into the search index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.text import domain
from ..operators import index, search
from ..operators.segments import Store
from ..operators.web import upsert
from ..sources import manifest
from ..sources.shared import cut
from .keyed import KeyedTable, Merge


def feed_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_seen(items: DataFrame, key: str, at: str, late: str = "10 minutes") -> DataFrame:
    """Items whose key was not seen within the watermark: a repeated item changes nothing."""
    return items.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def firsts(items: DataFrame, key: str, at: str, item: str) -> DataFrame:
    """(key, item, times): of each key its first item, by time, then by the item itself, and how many there were; a stream holds one row of state for each key."""
    return items.groupBy(key).agg(F.min_by(item, F.struct(at, item)).alias(item), F.count("*").alias("times"))


def window_counts(items: DataFrame, at: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, by, n) in tumbling windows of event time."""
    counted = items.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), by, "n")


def merge_titles(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Known pages with the titles of a batch (url, title, published_at): new pages enter, null and empty titles are filled, others stay."""
    filled = lambda df: df.withColumn("title", F.nullif("title", F.lit("")))
    return upsert(filled(stored), filled(batch), ["url"], "published_at", keep_old=["title"])


def started(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """A query that hands each batch and its number to ``step``: once for all that is there, or, with ``every`` ("300 seconds"), whenever that time is over, until it is stopped."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def ingest(stream: DataFrame, path: str, checkpoint: str, merge: Merge, key: list[str], every: str | None = None, buckets: int = 64) -> StreamingQuery:
    """Merges a stream into the table by key at ``path`` (``KeyedTable``); without ``every`` it has ended when this returns.

    ``merge`` (batch, rows of its buckets or None) gives those buckets' next rows.  A batch that comes again changes nothing.
    """
    table = KeyedTable(stream.sparkSession, path, key, buckets)
    query = started(stream, lambda batch, number: table.merge(batch, number, merge) and None, checkpoint, every)
    if not every:
        query.awaitTermination()
    return query


# --- feeds into pages and their index -------------------------------------------------------------------------

#: Pages as the index and its searches take them.
PAGES = ["page_id", "url", "domain", "path", "title", "lastmod"]


def fresh_pages(items: DataFrame) -> DataFrame:
    """Pages of feed items (url, title, published_at): the native part of a title, else the title; the id is a hash of the URL."""
    shown = search.headline(F.col("title"))
    path = F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1)
    return items.select(
        F.xxhash64("url").alias("page_id"), "url", domain(F.col("url")).alias("domain"), F.when(path == "", "/").otherwise(path).alias("path"),
        F.nullif(F.when(F.length(shown) > 0, shown).otherwise(F.col("title")), F.lit("")).alias("title"), F.col("published_at").alias("lastmod"),
    )


def merge_pages(batch: DataFrame, known: DataFrame | None) -> DataFrame:
    """Pages with a batch of others merged in: new ones enter, an empty title is filled, with that item's date; a page that has a title stays as it is.

    Of items for one page in a batch, the first with a title counts, by date, then by title.
    """
    titled = F.col("title").isNotNull()
    order = F.struct((~titled).alias("a"), F.coalesce("lastmod", F.lit("9999-01-01").cast("timestamp")).alias("b"), "title")
    first = batch.groupBy("url").agg(F.min_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
    if known is None:
        return first
    mine = known.select(F.col("url").alias("_url"), F.struct(*known.columns).alias("k"))
    rows = first.select(F.col("url").alias("_u"), F.struct(*known.columns).alias("n")).join(mine, F.col("_u") == F.col("_url"), "full")
    better = F.col("k").isNull() | (F.col("k.title").isNull() & F.col("n.title").isNotNull())
    return rows.select(F.when(better, F.col("n")).otherwise(F.col("k")).alias("r")).select("r.*")


def refresh(batch: DataFrame, number: int, pages: KeyedTable, index_path: str, segments: int = 8) -> None:
    """Brings a batch of feed items into the pages and, of those that are new or changed, a segment into the index.

    Both take a batch once: after a loss between the two, the pages of that batch are found again as the difference of the
    table's last two versions.  Buckets of the index in ``segments`` segments are compacted; older files go.
    """
    spark = batch.sparkSession
    pages.merge(fresh_pages(batch), number, merge_pages)
    changed = pages.changes(number)
    if changed is None:
        return
    changed = cut(changed)
    built = index.build(changed)
    if not manifest.versions(spark, index_path):
        Store.create(built.documents, built.postings, index_path, applied=number)
        return
    store = Store.open(spark, index_path).add(built.documents, built.postings, removed=changed, applied=number)
    store.compact(segments)
    Store.open(spark, index_path).vacuum()


def live_index(stream: DataFrame, pages_path: str, index_path: str, checkpoint: str, every: str | None = None, buckets: int = 64) -> StreamingQuery:
    """Feed items of a stream into pages and index, batch by batch (``refresh``); without ``every`` it has ended when this returns."""
    pages = KeyedTable(stream.sparkSession, pages_path, ["url"], buckets)
    query = started(stream, lambda batch, number: refresh(batch, number, pages, index_path), checkpoint, every)
    if not every:
        query.awaitTermination()
    return query


def run_to_memory(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now and returns what came out."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def run_to_table(stream: DataFrame, path: str) -> DataFrame:
    """Runs an aggregate of a stream over all that is there now, into tables below ``path`` in the shared folder, and returns its last result."""
    spark, numbers = stream.sparkSession, []

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        numbers.append(number)

    write = stream.writeStream.foreachBatch(step).outputMode("complete").option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True)
    write.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/batch={max(numbers)}") if numbers else spark.createDataFrame([], stream.schema)
