"""Readers: Parquet tables, seed lists, recorded suggestions, observation tables, raw documents."""

from __future__ import annotations

import contextlib
import gzip
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.classify import tristate
from ..functions.text import domain


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """(seed_ord, seed) of a text file: a seed a line, blank lines and lines that begin with # left out."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "seed")).withColumn("seed", F.trim("seed"))
    lines = lines.where((F.col("seed") != "") & ~F.col("seed").startswith("#"))
    return lines.select(F.row_number().over(Window.partitionBy().orderBy("line")).alias("seed_ord"), "seed")  # one small file


def recorded_suggestions(spark: SparkSession, path: str) -> DataFrame:
    """(query, suggestions) of a JSON file {query: [suggestion, ...]}."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("query", "suggestions"))


def observations(spark: SparkSession, path: str) -> DataFrame:
    """(ord, keyword, thin, weak, stale, own, notes) of a CSV table; blank cells are not recorded, unknown words are an error."""
    names = ["keyword", "top_results_stale", "thin_results", "weak_domains", "own_sites_ranking", "notes"]
    rows = spark.read.option("header", True).schema(", ".join(f"{n} string" for n in names)).csv(path).where(F.trim("keyword") != "")
    cells = {"thin": "thin_results", "weak": "weak_domains", "stale": "top_results_stale", "own": "own_sites_ranking"}
    return rows.select(F.monotonically_increasing_id().alias("ord"), F.trim("keyword").alias("keyword"), *[tristate(F.col(c)).alias(k) for k, c in cells.items()], "notes")


def raw_pages(spark: SparkSession, path: str) -> DataFrame:
    """(url, html) of files, one document each; gzip data is known by its first bytes, not by the name, and stays as it is where it doesn't unpack."""

    def run(data: pd.Series) -> pd.Series:
        def text(raw: bytes) -> str:
            if raw[:2] == b"\x1f\x8b":
                with contextlib.suppress(OSError, EOFError, zlib.error):
                    raw = gzip.decompress(raw)
            return raw.decode("utf-8", errors="ignore")

        return data.map(text)

    rows = spark.read.format("binaryFile").load(path).select("path", "content")
    return rows.select(F.col("path").alias("url"), F.pandas_udf(run, "string")("content").alias("html"))


def result_blocks(pages: DataFrame, most: int = 10) -> DataFrame:
    """(query, rank, url, domain, title) of result pages (query, html): the first link and heading of each result block."""
    blocks = F.regexp_extract_all("html", F.lit(r"""(?is)<div class="MjjYud">.*?<a href="[^"]+".*?<h3[^>]*>.*?</h3>"""), F.lit(0))
    rows = pages.select("query", F.posexplode(F.slice(blocks, 1, most)).alias("n", "block"))
    url = F.regexp_extract("block", r"""(?is)<a href="([^"]+)\"""", 1)
    title = F.regexp_replace(F.regexp_extract("block", r"(?is)<h3[^>]*>(.*?)</h3>", 1), "<[^>]+>", "")
    return rows.select("query", (F.col("n") + 1).alias("rank"), url.alias("url"), domain(url).alias("domain"), title.alias("title"))


def live_suggestions(responses: DataFrame) -> DataFrame:
    """(query, suggestions, measured, error) of raw responses (query, status, body): a JSON array of the query and its suggestions.

    A response other than 200 is not measured; one of 200 in another form is an error of the protocol, not an empty answer.
    """
    parts = F.from_json("body", "array<string>")
    lists = F.from_json(F.get(parts, F.lit(1)), "array<string>")
    ok = F.col("status") == 200
    fits = F.coalesce(F.size(parts) >= 2, F.lit(False)) & lists.isNotNull()
    error = F.when(~F.coalesce(ok, F.lit(False)), F.concat(F.lit("status "), F.coalesce(F.col("status").cast("string"), F.lit("none")))).when(~fits, "protocol")
    return responses.select("query", F.when(ok & fits, lists).alias("suggestions"), F.coalesce(ok & fits, F.lit(False)).alias("measured"), error.alias("error"))


def suggestions(queries: DataFrame, source: str, language: str = "mr", path: str | None = None, responses: DataFrame | None = None) -> DataFrame:
    """``queries`` with suggestions and measured from a source: live (``responses``), recorded (a file) or fixture; recorded without a file is the fixture."""
    from ..operators import demand

    if source == "live" and responses is not None:
        found = live_suggestions(responses).where("measured").select("query", "suggestions")
        return demand.recorded(queries, found)
    if source == "recorded" and path:
        return demand.recorded(queries, recorded_suggestions(queries.sparkSession, path))
    if source in ("recorded", "fixture"):
        return demand.fixture(queries, language)
    raise ValueError(f"no such source: {source}")
