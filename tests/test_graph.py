from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sutrapath.operators import graph, steps


def build(spark, names, links):
    nodes = spark.createDataFrame([(n, "c") for n in names], "domain string, category string")
    matrix = graph.link_matrix(spark.createDataFrame(links, "source_domain string, target_domain string"))
    return nodes, matrix, graph.cross_edges(matrix, nodes)


def ranks(df, column):
    return {r["domain"]: r[column] for r in df.collect()}


def test_empty(spark):
    nodes, matrix, edges = build(spark, [], [])
    assert graph.pagerank(nodes, edges).count() == 0
    assert graph.density_reciprocity(nodes, edges).first()["graph_density"] == 0


def test_star_with_dangling_leaves(spark):
    nodes, _, edges = build(spark, ["h", "a", "b"], [("h", "a"), ("h", "b"), ("h", "h"), ("h", "unknown")])
    got = ranks(graph.pagerank(nodes, edges), "pagerank")
    assert sum(got.values()) == pytest.approx(1) and got["a"] == pytest.approx(got["b"]) and got["a"] > got["h"]
    scores = graph.hits(nodes, edges)
    assert ranks(scores, "hub")["h"] == pytest.approx(1) and ranks(scores, "authority")["a"] == pytest.approx(2**-0.5)


def test_cycle(spark):
    nodes, matrix, edges = build(spark, ["a", "b"], [("a", "b"), ("b", "a"), ("a", "b")])
    assert ranks(graph.pagerank(nodes, edges), "pagerank") == pytest.approx({"a": 0.5, "b": 0.5})
    row = graph.density_reciprocity(nodes, edges).first()
    assert (row["graph_density"], row["reciprocity"]) == (1.0, 1.0)
    assert graph.category_flows(matrix, nodes).first()["links"] == 3


def test_unknown_domain_flows(spark):
    nodes, matrix, edges = build(spark, ["a"], [("a", "z")])
    assert edges.count() == 0
    assert graph.category_flows(matrix, nodes).first().asDict() == {"source_category": "c", "target_category": "Unclassified", "links": 1}


def dense(spark, n, links):
    """Nodes n0.., edges with weights, and the matrix of weights."""
    w = np.zeros((n, n))
    for u, v, k in links:
        w[u, v] += k
    nodes = spark.createDataFrame([(f"n{i:04}",) for i in range(n)], "domain string")
    edges = spark.createDataFrame([(f"n{u:04}", f"n{v:04}", k) for u, v, k in links], "u string, v string, w long")
    return nodes, edges, w


def test_a_step_shuffles_nodes_not_edges(spark):
    nodes, edges, _ = dense(spark, 120, [(u, v, 1) for u in range(120) for v in range(120) if u != v])
    walk = steps.Steps(nodes, edges, [(True, 0, 1), (False, 1, 0)], [1.0, 1.0], weighted=False)
    pieces = walk.nodes.select("home").distinct().count()
    sent = walk.blocks.where("sends").agg(F.sum(F.array_max("rows") + 1)).first()[0]
    assert edges.count() == 14280 and sent <= 2 * 120 * pieces


@pytest.mark.parametrize("piece,hot", [(1 << 22, 1000), (500, 3)])
def test_many_pieces_and_ends_with_many_edges(spark, monkeypatch, piece, hot):
    monkeypatch.setattr(steps, "PIECE", piece)
    monkeypatch.setattr(steps, "HOT", hot)
    random = np.random.default_rng(1)
    links = [(int(u), int(v), int(k)) for u, v, k in zip(random.integers(0, 290, 2000), random.integers(0, 300, 2000), random.integers(1, 5, 2000), strict=True) if u != v]
    links += [(u, 7, 2) for u in range(300) if u % 3 == 0 and u != 7] + [(9, v, 1) for v in range(300) if v != 9]
    nodes, edges, w = dense(spark, 300, links)
    out, rank = w.sum(1), np.full(300, 1 / 300)
    share = np.divide(w, out[:, None], out=np.zeros_like(w), where=out[:, None] > 0)
    for _ in range(6):
        rank = 0.15 / 300 + 0.85 * (rank @ share + rank[out == 0].sum() / 300)
    more = edges.union(spark.createDataFrame([("n0001", "away", 100), ("away", "n0001", 100)], edges.schema))  # an end that is no node
    got = ranks(graph.pagerank(nodes, more, iterations=6, tolerance=None), "pagerank")
    assert [got[f"n{i:04}"] for i in range(300)] == pytest.approx(rank, rel=1e-9)
    link, hub, authority = (w > 0).astype(float), np.ones(300), np.ones(300)
    for _ in range(5):
        hub, authority = link @ authority, link.T @ hub
        hub, authority = hub / np.linalg.norm(hub), authority / np.linalg.norm(authority)
    scores = {r["domain"]: (r["hub"], r["authority"]) for r in graph.hits(nodes, more, iterations=5, tolerance=None).collect()}
    assert [scores[f"n{i:04}"][0] for i in range(300)] == pytest.approx(hub, abs=1e-9)
    assert [scores[f"n{i:04}"][1] for i in range(300)] == pytest.approx(authority, abs=1e-9)


def test_nodes_that_occur_twice(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "domain string")
    edges = spark.createDataFrame([("a", "b", 1), ("a", "c", 1), ("b", "c", 3)], "u string, v string, w long")
    got = graph.pagerank(nodes, edges, iterations=1, tolerance=None).orderBy("domain").collect()
    base = 0.15 / 4 + 0.85 / 4 / 4
    assert [r["pagerank"] for r in got] == pytest.approx([base, base + 0.85 / 8, base + 0.85 / 8, base + 0.85 * (1 / 8 + 2 / 4)])


def test_both_ways_and_loops(spark):
    nodes = spark.createDataFrame([(c,) for c in "abc"], "domain string")
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "a"), ("a", "c"), ("c", "c")], "u string, v string")
    row = graph.density_reciprocity(nodes, edges).first()
    assert (row["nodes"], row["edges"], row["reciprocity"]) == (3, 4, 0.75)
