"""Link-graph operators: matrix, degrees, PageRank, HITS, density, reciprocity, category flows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut
from .steps import Steps


def link_matrix(links: DataFrame) -> DataFrame:
    """(source_domain, target_domain, link_count, is_internal) of links (source_domain, target_domain, ...)."""
    internal = F.col("source_domain") == F.col("target_domain")
    return links.groupBy("source_domain", "target_domain").agg(F.count("*").alias("link_count")).withColumn("is_internal", internal)


def outward(matrix: DataFrame) -> DataFrame:
    """(u, v, w): edges between two different domains."""
    return matrix.where("source_domain <> target_domain").select(F.col("source_domain").alias("u"), F.col("target_domain").alias("v"), F.col("link_count").alias("w"))


def cross_edges(matrix: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, v, w): edges between two different known domains."""
    known = nodes.select(F.col("domain").alias("_d"))
    return outward(matrix).join(known, F.col("u") == F.col("_d"), "left_semi").join(known, F.col("v") == F.col("_d"), "left_semi").select("u", "v", "w")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(domain, in_degree, out_degree), 0 without edges."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("domain"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("v").alias("domain"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    sums = ends.groupBy("e.domain").agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))
    return nodes.select("domain").join(sums, "domain", "left").fillna(0, ["in_degree", "out_degree"])


def link_totals(matrix: DataFrame) -> DataFrame:
    """(domain, internal_links, external_out, external_in) of every domain in the matrix."""
    n, own = F.col("link_count"), F.col("source_domain") == F.col("target_domain")
    zero = F.lit(0).cast("long")
    rows = matrix.select(F.explode(F.array(F.struct(F.col("source_domain").alias("domain"), F.when(own, n).otherwise(zero).alias("a"), F.when(own, zero).otherwise(n).alias("b"), zero.alias("c")), F.struct(F.col("target_domain").alias("domain"), zero.alias("a"), zero.alias("b"), F.when(own, zero).otherwise(n).alias("c")))).alias("e"))
    return rows.groupBy("e.domain").agg(F.sum("e.a").alias("internal_links"), F.sum("e.b").alias("external_out"), F.sum("e.c").alias("external_in"))


def density_reciprocity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, graph_density (6 places) and reciprocity (4 places)."""
    up, down = (F.max(c.cast("int")).alias(n) for c, n in ((F.col("u") <= F.col("v"), "up"), (F.col("u") >= F.col("v"), "down")))
    pairs = edges.groupBy(F.least("u", "v").alias("low"), F.greatest("u", "v").alias("high")).agg(up, down)
    own, both = F.col("low") == F.col("high"), F.col("up") + F.col("down")  # an edge to itself is one, and its own way back
    pairs = pairs.select(F.when(own, 1).otherwise(both).alias("edges"), F.when(own, 1).when(both == 2, 2).otherwise(0).alias("mutual"))
    sums = pairs.agg(F.coalesce(F.sum("edges"), F.lit(0)).alias("edges"), F.coalesce(F.sum("mutual"), F.lit(0)).alias("mutual"))
    out = nodes.agg(F.count("*").alias("nodes")).crossJoin(sums)  # one row each
    possible = F.greatest(F.col("nodes") * (F.col("nodes") - 1), F.lit(1))
    return out.select("nodes", "edges", F.round(F.col("edges") / possible, 6).alias("graph_density"), F.when(F.col("edges") > 0, F.round(F.col("mutual") / F.col("edges"), 4)).otherwise(0.0).alias("reciprocity"))


def _placed(matrix: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, v, w, source_category, target_category, known) of links between different domains; ``known`` where both are nodes."""
    end = lambda c: nodes.select(F.col("domain").alias(c), F.col("category").alias(f"_{c}"), F.lit(True).alias(f"_{c}_known"))
    out = outward(matrix).join(end("u"), "u", "left").join(end("v"), "v", "left")
    known = F.col("_u_known").isNotNull() & F.col("_v_known").isNotNull()
    return out.select("u", "v", "w", F.col("_u").alias("source_category"), F.col("_v").alias("target_category"), known.alias("known"))


def _flows(placed: DataFrame) -> DataFrame:
    unknown = F.lit("Unclassified")
    return placed.groupBy(F.coalesce("source_category", unknown).alias("source_category"), F.coalesce("target_category", unknown).alias("target_category")).agg(F.sum("w").alias("links"))


def category_flows(matrix: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source_category, target_category, links) over links between different domains; unknown domains are Unclassified."""
    return _flows(_placed(matrix, nodes))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    """(domain, pagerank): weighted PageRank with the rank of dangling nodes dealt to all; edges with an end that is no node are left out.

    Without ``tolerance`` exactly ``iterations`` steps run; with it the L1 change ends them earlier.  Of each state only sums
    come to the driver.
    """
    n = nodes.count()
    if not n:
        return nodes.select("domain", F.lit(0.0).alias("pagerank"))
    walk, scales = Steps(nodes, edges, [(True, 0, 0)], [1.0 / n], weighted=True), [(1.0, 0.0)]
    for _ in range(iterations):
        ((idle, _),) = walk.step(scales, tolerance is not None)
        scales = [(damping, (1 - damping) / n + damping * idle / n)]
        if tolerance is not None and walk.change(scales) < tolerance:
            break
    return walk.end(["pagerank"], scales)


def hits(nodes: DataFrame, edges: DataFrame, iterations: int = 40, tolerance: float | None = 1e-5) -> DataFrame:
    """(domain, hub, authority): unweighted HITS; hubs take the authorities of the step before, both are scaled to length 1.

    Edges with an end that is no node are left out.  In a step each edge carries a hub to its target and an authority to its
    source; states are stored unscaled, their lengths are numbers on the driver.
    """
    walk, scales = Steps(nodes, edges, [(True, 0, 1), (False, 1, 0)], [1.0, 1.0], weighted=False), [(1.0, 0.0), (1.0, 0.0)]
    for _ in range(iterations):
        scales = [(1 / (math.sqrt(squares) or 1.0), 0.0) for _, squares in walk.step(scales, tolerance is not None)]
        if tolerance is not None and walk.change(scales) < tolerance:
            break
    return walk.end(["hub", "authority"], scales)


def top(scores: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The ``n`` best domains by a score; ties by domain."""
    return scores.orderBy(F.col(column).desc(), "domain").limit(n)


def snapshot(nodes: DataFrame, matrix: DataFrame) -> DataFrame:
    """One row of totals of the whole graph."""
    return _totals(nodes, matrix, cross_edges(matrix, nodes))


def _totals(nodes: DataFrame, matrix: DataFrame, edges: DataFrame) -> DataFrame:
    totals = matrix.agg(F.coalesce(F.sum(F.when(F.col("is_internal"), F.col("link_count"))), F.lit(0)).alias("total_internal_links"), F.coalesce(F.sum(F.when(~F.col("is_internal"), F.col("link_count"))), F.lit(0)).alias("total_external_links"))
    return density_reciprocity(nodes, edges).crossJoin(totals)


def record(nodes: DataFrame, matrix: DataFrame, scores: DataFrame, crawled: DataFrame | None = None) -> DataFrame:
    """The row that the table of snapshots takes: ``snapshot``'s totals, the counts of a crawl (``crawled``, one row) if there are any, and JSON of the ten best
    authorities and hubs (scores to four decimals, ties to six by domain) and of the links between categories, most first."""

    def best(column: str) -> DataFrame:
        ten = scores.select("domain", F.round(column, 6).alias("_s")).orderBy(F.col("_s").desc(), "domain").limit(10)
        listed = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("_s")).alias("s"), "domain"))), lambda x: F.struct(x["domain"].alias("domain"), F.format_string("%.4f", -x["s"] + 0.0).alias("score")))
        return ten.agg(F.to_json(listed).alias(f"top_{column}_json"))  # ten rows

    placed = cut(_placed(matrix, nodes))
    flows = _flows(placed)
    between = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("links")).alias("n"), "source_category", "target_category"))), lambda x: F.struct(x["source_category"].alias("source"), x["target_category"].alias("target"), (-x["n"]).alias("links")))
    out = _totals(nodes, matrix, placed.where("known")).crossJoin(best("authority")).crossJoin(best("hub")).crossJoin(flows.agg(F.to_json(between).alias("category_flows_json")))  # one row each
    return out if crawled is None else out.crossJoin(crawled)
