"""Connected components of a link table, by hooking and contraction.

Each round every node hooks to its least neighbour below it, chains are shortened by pointer jumping,
and links are rewritten between roots; links within a root go.  Rounds are few (hubs and cliques
vanish in two), every step is a join or an aggregate on plain tables, and each round's tables are
written to the shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored


def _ordered(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def _jump(parents: DataFrame, times: int) -> DataFrame:
    for _ in range(times):
        up = parents.select(F.col("a").alias("_up"), F.col("parent").alias("_over"))
        parents = parents.join(up, F.col("parent") == F.col("_up"), "left").select("a", F.coalesce("_over", "parent").alias("parent"))
    return parents


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the least node that it is connected to.

    Null ends are ignored; a node without a link to another has no row.  No links: no rows.
    """
    links = stored(_ordered(links.where("a is not null and b is not null")), "links")
    nodes = stored(links.select(F.col("a").alias("node")).union(links.select("b")).distinct(), "link-nodes")
    label = nodes.withColumn("component", F.col("node"))
    while not links.isEmpty():
        near = stored(links.groupBy("a").agg(F.min("b").alias("parent")), "parents")
        parents = stored(_jump(near, 2), "roots")
        left, right = parents.withColumnsRenamed({"a": "_a", "parent": "_pa"}), parents.withColumnsRenamed({"a": "_b", "parent": "_pb"})
        moved = links.join(left, F.col("a") == F.col("_a")).join(right, F.col("b") == F.col("_b"), "left")
        moved = stored(_ordered(moved.select(F.col("_pa").alias("a"), F.coalesce("_pb", "b").alias("b"))), "links")
        over = label.join(left, F.col("component") == F.col("_a"), "left").select("node", F.coalesce("_pa", "component").alias("component"))
        over = stored(over, "labels")
        dropped(links, near, parents, label)
        links, label = moved, over
    dropped(links)
    return label
