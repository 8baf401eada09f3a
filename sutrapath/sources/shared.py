"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a folder of our own only where it names none and runs in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="sutrapath-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def _file_system(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def place(spark: SparkSession, kind: str) -> str:
    """A path in the shared folder for a table of that kind; what is there goes when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/sutrapath-{kind}-{uuid.uuid4().hex}"
    system, at = _file_system(spark, path)
    system.deleteOnExit(at)
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, written as a table and read back: its lineage ends there.  The table goes when the application ends."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/sutrapath-{uuid.uuid4().hex}"
    df.write.parquet(path)
    system, place = _file_system(df.sparkSession, path)
    system.deleteOnExit(place)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def bucketed(df: DataFrame, column: str, buckets: int, apart: str | None = None) -> DataFrame:
    """Like ``cut``, but the rows lie in buckets of a hash of ``column`` and in its order: joins on it with others bucketed alike shuffle neither.

    Rows of different ``apart`` lie in different files.  The table is in the session's catalog until ``dropped``.
    """
    spark, name = df.sparkSession, f"sutrapath_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/{name}"
    write = df.write.partitionBy(apart) if apart else df.write
    write.bucketBy(buckets, column).sortBy(column).option("path", path).format("parquet").saveAsTable(name)
    system, place = _file_system(spark, path)
    system.deleteOnExit(place)
    out = spark.table(name)
    out.cut_path, out.cut_table = path, name
    return out


def dropped(df: DataFrame) -> None:
    """Deletes a table made by ``cut`` or ``bucketed`` that nothing reads any more."""
    if name := getattr(df, "cut_table", None):
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    if path := getattr(df, "cut_path", None):
        system, place = _file_system(df.sparkSession, path)
        system.delete(place, True)
        system.cancelDeleteOnExit(place)
