"""Repeated sums along the edges of a graph.

Nodes are dealt over pieces by a hash.  The edges between two pieces are one block: which numbers the piece at their start
sends, and what the piece at their end makes of them.  Blocks are stored once, in the buckets of the piece that needs them, and
the vectors of a state beside them, so a step shuffles one number for each node and piece that it has edges to, however many
edges that are.  An end with many edges in one block is summed up where they start: its edges lie in all pieces, not in one.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import bucketed, cut, dropped

#: Nodes and edges of a piece, on average, at most; and so few that no more pieces than cores are made for them.
PIECE, SMALL = 1 << 22, 1 << 15
#: Edges of a block into one node, from which on they are summed up at their start.
HOT = 1000
#: What a piece sends to itself: its own vectors.
OWN = -1
BLOCK = "home long, other long, reads int, writes int, rows array<int>, columns array<int>, values array<double>, sends boolean"
MESSAGE = "home long, other long, vector int, x array<double>, idle double"
STATE = "home long, vector int, x array<double>, before array<double>, idle double, squares double"


def _keys(spark: SparkSession, pieces: int, buckets: int) -> list[int]:
    """A key for each piece, by whose hash the pieces lie evenly in the buckets."""
    ids = spark.range(32 * max(pieces, buckets)).select("id", F.pmod(F.hash("id"), F.lit(buckets)).alias("bucket"))
    ranked = ids.withColumn("n", F.row_number().over(Window.partitionBy("bucket").orderBy("id")))
    return [r["id"] for r in ranked.orderBy("n", "bucket").limit(pieces).collect()]


def _table(rows: list[tuple], ddl: str) -> pa.Table:
    kinds = {"long": np.int64, "int": np.int32, "double": np.float64, "boolean": np.bool_}
    fields = [c.split(" ") for c in ddl.split(", ")]
    made = []
    for k, (_, kind) in enumerate(fields):
        cells, item = [r[k] for r in rows], np.dtype(kinds[kind.removeprefix("array<").removesuffix(">")])
        if kind.startswith("array"):
            offsets = np.cumsum([0, *map(len, cells)], dtype=np.int32)
            made.append(pa.ListArray.from_arrays(offsets, np.concatenate([np.empty(0, item), *(c.astype(item, copy=False) for c in cells)])))
        else:
            made.append(pa.array(np.array(cells, item)))
    return pa.table(made, names=[name for name, _ in fields])


def _rows(table: pa.Table) -> list[dict]:
    """Rows with their arrays as numpy ones."""
    cell = lambda x: x.values.to_numpy(zero_copy_only=False) if isinstance(x, pa.ListScalar) else x.as_py()
    return [{n: cell(table[n][i]) for n in table.column_names} for i in range(table.num_rows)]


def _product(block: dict, x: np.ndarray, size: int = 0) -> np.ndarray:
    """The block's sparse matrix times ``x``; no values are ones."""
    taken = x[block["columns"]]
    return np.bincount(block["rows"], weights=taken * block["values"] if len(block["values"]) else taken, minlength=size)


def _factors(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> tuple[tuple, tuple]:
    """(rows, columns, values) of numbers sent by nodes, and of nodes by numbers sent, for edges from ``a`` to ``b``.

    A number sent is that of a node at the start; or, for an end with many of the edges, the sum over them.
    """
    hot = np.bincount(b)[b] >= HOT
    sent, number = np.unique(np.where(hot, -1 - b, a), return_inverse=True)
    alone, summed = np.flatnonzero(sent >= 0), np.flatnonzero(sent < 0)
    join = lambda *parts: np.concatenate(parts)
    given = join(alone, number[hot]), join(sent[alone], a[hot]), join(np.ones(len(alone)), weight[hot])
    taken = join(b[~hot], -1 - sent[summed]), join(number[~hot], summed), join(weight[~hot], np.ones(len(summed)))
    return tuple((r, c, v if (v != 1).any() else v[:0]) for r, c, v in (given, taken))


def _packed(ways: Sequence[tuple[bool, int, int]], weighted: bool):
    def pack(key: tuple, edges: pa.Table) -> pa.Table:
        i, j = (k.as_py() for k in key)
        a, b, weight = (edges[c].to_numpy() for c in ("_ua", "_va", "_weight"))
        a, b = a.astype(np.int64), b.astype(np.int64)
        if not weighted:
            _, first = np.unique(a << 32 | b, return_index=True)
            a, b, weight = a[first], b[first], weight[first]
        out = []
        for forward, reads, writes in ways:
            (start, end), ends = ((i, j), (a, b)) if forward else ((j, i), (b, a))
            given, taken = _factors(*ends, weight)
            out += [(start, end, reads, writes, *given, True), (end, start, reads, writes, *taken, False)]
        return _table(out, BLOCK)

    return pack


def _sent(scales: Sequence[tuple[float, float]]):
    def send(key: tuple, state: pa.Table, blocks: pa.Table) -> pa.Table:
        home = key[0].as_py()
        x = {r["vector"]: r["x"] * scales[r["vector"]][0] + scales[r["vector"]][1] for r in _rows(state.select(["vector", "x"]))}
        out, idle = [], {vector: np.ones(len(own), bool) for vector, own in x.items()}
        for r in _rows(blocks):
            out.append((r["other"], home, r["writes"], _product(r, x[r["reads"]]), 0.0))
            idle[r["reads"]][r["columns"]] = False
        return _table(out + [(home, OWN, vector, own, own[idle[vector]].sum()) for vector, own in x.items()], MESSAGE)

    return send


def _received(keep: bool):
    def receive(key: tuple, messages: pa.Table, blocks: pa.Table) -> pa.Table:
        home, sent = key[0].as_py(), _rows(messages)
        got = {(r["other"], r["vector"]): r["x"] for r in sent}
        own, idle = ({r["vector"]: r[c] for r in sent if r["other"] == OWN} for c in ("x", "idle"))
        new = {vector: np.zeros(len(x)) for vector, x in own.items()}
        for r in _rows(blocks):
            new[r["writes"]] += _product(r, got[r["other"], r["writes"]], len(new[r["writes"]]))
        return _table([(home, vector, x, own[vector] if keep else x[:0], idle[vector], x @ x) for vector, x in new.items()], STATE)

    return receive


class Steps:
    """A state of some vectors over the nodes (domain); each step sums them up along the edges (u, v, w) whose ends are both nodes.

    ``ways`` are (forward, vector read, vector written), at most one for each vector written; ``start`` is the value that each
    vector begins with.  Weighted edges carry w by the sum over the edges of their start, others 1, once for each pair.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame, ways: Sequence[tuple[bool, int, int]], start: Sequence[float], weighted: bool):
        spark = nodes.sparkSession
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        edges = cut(edges.select("u", "v", *(["w"] if weighted else [])))
        size = nodes.count() + edges.count()
        keys = _keys(spark, max(-(-size // PIECE), min(spark.sparkContext.defaultParallelism, -(-size // SMALL)), 1), self.buckets)
        piece = F.pmod(F.xxhash64("domain"), F.lit(len(keys))).cast("int")
        inside = Window.partitionBy("home").orderBy("domain")
        laid = nodes.select("domain", F.array(*[F.lit(k).cast("long") for k in keys])[piece].alias("home"))
        self.nodes = cut(laid.select("domain", "home", (F.row_number().over(inside) - 1).alias("at"), F.coalesce(F.lag("domain").over(inside) == F.col("domain"), F.lit(False)).alias("twin")))
        end = lambda c: self.nodes.select(F.col("domain").alias(c), F.col("home").alias(f"_{c}h"), F.col("at").alias(f"_{c}a"), F.col("twin").alias(f"_{c}t"))
        known = edges.join(end("v"), "v").join(end("u"), "u")
        total = F.sum(F.when(~F.col("_ut") & ~F.col("_vt"), F.col("w"))).over(Window.partitionBy("u"))
        known = known.select("_uh", "_ua", "_vh", "_va", (F.col("w") / total if weighted else F.lit(1.0)).alias("_weight"))
        blocks = known.groupBy("_uh", "_vh").applyInArrow(_packed(ways, weighted), BLOCK)
        self.blocks = bucketed(blocks.repartition(self.buckets, "home"), "home", self.buckets, "sends")
        dropped(edges)
        first = F.explode(F.array(*[F.struct(F.lit(k).alias("vector"), F.lit(float(x)).alias("x")) for k, x in enumerate(start)])).alias("s")
        empty = F.array().cast("array<double>")
        self.state = bucketed(self.nodes.groupBy("home").agg(F.count("*").cast("int").alias("n")).select("home", "n", first).select("home", "s.vector", F.array_repeat("s.x", F.col("n")).alias("x"), empty.alias("before"), F.lit(0.0).alias("idle"), F.lit(0.0).alias("squares")), "home", self.buckets)

    def step(self, scales: Sequence[tuple[float, float]], keep: bool) -> list[tuple[float, float]]:
        """One step from the vectors times the first of their scale plus the second; returns for each vector what nodes without edges had of it, and the sum of squares of the new one.  ``keep`` is for ``change``."""
        moved = self.state.groupBy("home").cogroup(self.blocks.where("sends").groupBy("home")).applyInArrow(_sent(scales), MESSAGE)
        after = moved.groupBy("home").cogroup(self.blocks.where("not sends").groupBy("home")).applyInArrow(_received(keep), STATE)
        old, self.state = self.state, bucketed(after, "home", self.buckets)
        dropped(old)
        sums = {r["vector"]: (r["idle"], r["squares"]) for r in self.state.groupBy("vector").agg(F.sum("idle").alias("idle"), F.sum("squares").alias("squares")).collect()}
        return [sums.get(k, (0.0, 0.0)) for k in range(len(scales))]

    def change(self, scales: Sequence[tuple[float, float]]) -> float:
        """The sum of absolute changes that the last step made, with the new vectors' scales."""
        by, more = (F.array(*[F.lit(float(s[k])) for s in scales])[F.col("vector")] for k in (0, 1))
        moved = F.zip_with("x", "before", lambda a, b: F.abs(a * by + more - b))
        return self.state.agg(F.sum(F.aggregate(moved, F.lit(0.0), lambda s, x: s + x))).first()[0] or 0.0

    def end(self, names: Sequence[str], scales: Sequence[tuple[float, float]]) -> DataFrame:
        """(domain, one column for each vector); the edges are dropped."""
        dropped(self.blocks)
        one = self.state.groupBy("home").agg(*[F.first(F.when(F.col("vector") == k, F.col("x")), True).alias(n) for k, n in enumerate(names)])
        rows = one.select("home", F.posexplode(F.arrays_zip(*names)).alias("at", "_x"))
        return self.nodes.join(rows, ["home", "at"]).select("domain", *[(F.col(f"_x.{n}") * F.lit(float(by)) + F.lit(float(more))).alias(n) for n, (by, more) in zip(names, scales, strict=True)])
