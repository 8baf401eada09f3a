"""Shared pieces of the training-data operators.

Words are maximal runs outside ``[\\x20\\x09-\\x0D]`` throughout.  The Arrow/numpy kernel
works on one slice of a record batch at a time: the slice's words are dictionary-encoded
once, every per-word quantity is computed on the distinct words only, and the documents
are then sums over integer codes.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that the Python kernels take at a time.
SLICE_BYTES = 6 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none and runs in one process (tests) a folder of our own is made and set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="sutrapath-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Settings of the session that hold inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Paths of tables written within ``scratch``.
_WRITTEN: list[list[str]] = []


def _file_system(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def stored(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """``df`` written once as a Parquet table in the shared folder and read back: its lineage ends there.

    As the table stays, the shuffle files of the run that made it go at its end.  The table itself goes when
    the application ends, or earlier (``dropped``, ``scratch``).  ``batch_rows`` bounds the rows that Python functions
    of that run get at a time, for rows that are long.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/sutrapath-{name}-{uuid.uuid4().hex}"
    values = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    if batch_rows:
        values["spark.sql.execution.arrow.maxRecordsPerBatch"] = str(batch_rows)
    with settings(spark, values):
        df.write.parquet(path)
    system, place = _file_system(spark, path)
    system.deleteOnExit(place)
    for written in _WRITTEN:
        written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by ``stored`` that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "stored_path", None):
            system, place = _file_system(df.sparkSession, path)
            system.delete(place, True)
            system.cancelDeleteOnExit(place)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables that are stored inside go at the end, but for those appended to the list that it gives."""
    written: list[str] = []
    kept: list[DataFrame] = []
    _WRITTEN.append(written)
    try:
        yield kept
    finally:
        _WRITTEN.remove(written)
        stays = {getattr(df, "stored_path", None) for df in kept}
        for path in written:
            if path not in stays:
                system, place = _file_system(spark, path)
                system.delete(place, True)


def joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join on columns of equal names in which nulls are equal too; those of ``right`` go."""
    named = right.withColumnsRenamed({c: f"_same_{c}" for c in on})
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_same_{c}"))
    return left.join(named, same, how).drop(*[f"_same_{c}" for c in on])


def numbered(rows: DataFrame, key: list[str], order: list[str], at: str, total: str, name: str) -> DataFrame:
    """``rows`` with ``at``, the place among the rows of equal ``key`` in ``order`` (from 0, nulls first), and ``total``, how many these are.

    The rows are stored once in range partitions; a place is that within the partition, after the key's rows in the partitions
    before.  So a key with most of the rows lies in many tasks, and none but one small row for each key and partition is
    dealt by key.  Of rows that are alike in all of these columns, any may be first.
    """
    by = [F.col(c).asc_nulls_first() for c in [*key, *order]]
    laid = stored(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_mid", F.monotonically_increasing_id()), name)
    laid = laid.withColumn("_part", F.shiftright("_mid", 33))
    parts = laid.groupBy("_part", *key).agg(F.min("_mid").alias("_least"), F.count("*").alias("_rows"))
    own = Window.partitionBy(*key)  # a row for each partition that the key's rows lie in
    before = F.coalesce(F.sum("_rows").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("_part", *key, (before - F.col("_least")).alias("_shift"), F.sum("_rows").over(own).alias(total))
    return joined(laid, parts, ["_part", *key]).withColumn(at, F.col("_mid") + F.col("_shift")).drop("_mid", "_part", "_shift")


def fold(column: str | Column, modulus: int) -> Column:
    """crc32 of an id written as text, modulo ``modulus``; a null id counts as the empty text."""
    col = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % F.lit(modulus)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def carried(docs: DataFrame) -> str:
    """A column name that ``docs`` doesn't have."""
    name = "_found"
    while name in docs.columns:
        name += "_"
    return name


def mapped(docs: DataFrame, run: Callable, made: list[tuple[str, str]], carry: bool) -> DataFrame:
    """mapInArrow of a function whose rows come from ``beside``: doc_id and the columns ``made``, or all columns and those in a struct."""
    if not carry:
        kind = docs.schema["doc_id"].dataType.simpleString()
        return docs.select("doc_id", "text").mapInArrow(run, ", ".join([f"doc_id {kind}", *(f"{k} {t}" for k, t in made)]))
    found = StructType([StructField(carried(docs), StructType.fromDDL(", ".join(f"{k} {t}" for k, t in made)))])
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *found.fields]))


def beside(part: pa.RecordBatch, made: list[pa.Array], names: list[str], carry: bool) -> pa.RecordBatch:
    if not carry:
        return pa.RecordBatch.from_arrays([part.column("doc_id"), *made], ["doc_id", *names])
    return pa.RecordBatch.from_arrays([*part.columns, pa.StructArray.from_arrays(made, names)], [*part.schema.names, "_"])


# --- Arrow kernel -------------------------------------------------------------------------


def trim() -> None:
    """Gives freed memory back to the system: Python workers live on between tasks, beside the executor's JVM."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES):
    """Consecutive slices of a batch with at most ``limit`` bytes of text (one row at least)."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(size), 0
    while at < len(size):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to
    trim()


class Words:
    """The words of a slice: ``distinct`` strings, ``code`` of each token, ``starts`` of each row (n + 1)."""

    def __init__(self, texts: pa.Array, lower: str | None = None):
        texts = pc.fill_null(texts, "")
        if lower:
            texts = {"ascii": pc.ascii_lower, "utf8": pc.utf8_lower}[lower](texts)
        lists = pc.ascii_split_whitespace(texts)
        values, offsets = lists.values, lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        base, values = offsets[0], values.slice(offsets[0], offsets[-1] - offsets[0])
        full = pc.greater(pc.binary_length(values), 0)
        keep = full.to_numpy(zero_copy_only=False)
        self.starts = np.concatenate([[0], np.cumsum(keep)])[offsets - base].astype(np.int64)
        coded = values.filter(full).dictionary_encode()
        self.distinct: pa.Array = coded.dictionary
        self.code: np.ndarray = coded.indices.to_numpy(zero_copy_only=False)
        self.rows = len(texts)
        self.counts = np.diff(self.starts)

    def row_sums(self, per_word: np.ndarray) -> np.ndarray:
        """For each row, the sum over its tokens of a value given for each distinct word."""
        return segment_sums(per_word[self.code] if len(self.code) else np.zeros((0, *per_word.shape[1:])), self.starts)


def segment_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    out = np.zeros((len(starts) - 1, *values.shape[1:]), dtype=values.dtype if values.dtype != bool else np.int64)
    full = np.flatnonzero(starts[1:] > starts[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, starts[full], axis=0)
    return out


def joined_bytes(words: pa.Array, mark: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """All words in one byte array, each with ``mark`` before and after it; and where each begins (n + 1)."""
    size = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(words.cast(pa.binary()).to_pylist()), dtype=np.uint8)
    starts = np.concatenate([[0], np.cumsum(size + 2)])
    out = np.full(starts[-1], mark, dtype=np.uint8)
    inner = np.ones(starts[-1], dtype=bool)
    inner[starts[:-1]] = False
    inner[starts[1:] - 1] = False
    out[inner] = data
    return out, starts


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def word_hashes(words: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over mixed bytes, finalised."""
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    data, starts = joined_bytes(words)
    size = np.diff(starts)
    at = np.arange(starts[-1]) - np.repeat(starts[:-1], size)
    longest = int(size.max())
    power = np.full(longest, 0x9E3779B97F4A7C15, dtype=np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    value = mix64(np.arange(1, 257, dtype=np.uint64) + np.uint64(1000 * (seed + 1)))[data]
    return mix64(np.add.reduceat(value * power[at], starts[:-1]))


def ngram_features(words: pa.Array, orders: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte n-grams of each marked word, of the given orders, and one feature for the whole word.

    Returns the feature ids of all words in a row, and where each word's begin (n + 1).  ``buckets`` is a power of two.
    """
    data, starts = joined_bytes(words)
    n, ends = len(data), np.repeat(starts[1:], np.diff(starts))
    wide = data.astype(np.uint64)
    parts, owner = [word_hashes(words)], [np.arange(len(words))]
    of = np.repeat(np.arange(len(words)), np.diff(starts))
    for k in orders:
        if n < k:
            continue
        h = np.full(n - k + 1, k, dtype=np.uint64)
        for j in range(k):
            h = h * np.uint64(257) + wide[j : n - k + 1 + j] + np.uint64(1)
        inside = np.arange(n - k + 1) + k <= ends[: n - k + 1]
        parts.append(mix64(h[inside]))
        owner.append(of[: n - k + 1][inside])
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    ids = (np.concatenate(parts)[order] & np.uint64(buckets - 1)).astype(np.int64)
    return ids, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(words)))])


def feature_sums(words: pa.Array, orders: tuple[int, ...], weight: np.ndarray, buckets: int, at_once: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """For each word the sum of its features' rows of ``weight``, and how many features it has; some words at a time."""
    sums, counts = np.zeros((len(words), *weight.shape[1:]), dtype=weight.dtype), np.zeros(len(words), dtype=np.int64)
    for i in range(0, len(words), at_once):
        ids, starts = ngram_features(words.slice(i, at_once), orders, buckets)
        sums[i : i + at_once], counts[i : i + at_once] = segment_sums(weight[ids], starts), np.diff(starts)
    return sums, counts
