"""Embedding near-duplicates by NN-descent, within equal labels.

Method.  Equal vectors of a label are one node with a weight.  A neighbour graph starts from random
projections (signs of hyperplanes cut each label into cells; nodes take their nearest in the cell)
and is refined by NN-descent: the neighbours and sampled reverse neighbours of each node are
compared with each other, and what is nearer than the worst of a list enters it.  Edges at the
threshold are kept and form components.  Lists that are full of such edges are saturated: components with
such lists are compared with the others of their label (``_merges``) and joined where a link is found.  Each
component is then compared with itself in blocks, so the counts of links in dense groups are whole; only
counts leave a block, not pairs.  A sample of nodes, drawn over nodes, labels and groups, is compared with
all rows to audit recall, per link and per node (``audit``); where the least figure is below ``least_recall`` the graph is built again with twice the projections and longer lists, and after ``tries``
graphs each label is compared with itself as a whole, in blocks.

Cosines are in double precision throughout, and no pair below the threshold is ever linked.

Defined results
* null vectors, vectors with null or non-finite components, zero or empty vectors, and rows with a null
  label or vec_id link with nothing: n_links 0, their own component, kept (a null vec_id: null, not kept);
* vectors of different lengths are not compared;
* vec_id is taken as unique; rows with equal id, label and vector count as copies of one another;
* equal vectors link with each other, as their cosine is 1;
* no rows: no rows.  Columns other than vec_id, embedding and label are neither read nor needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components

#: Nodes of a cell, nodes of a split cell or ball, reverse neighbours of a node in a round.
CELL, BLOCK, REVERSE = 96, 256, 16
#: Nodes of a block in comparisons of all with all, rows of such a comparison at a time, and rows of small components in one group.
COMPARED, TILE, SHARED = 2048, 256, 1024
#: Sampled nodes from which the audit takes a figure for groups of their size.
LEAST_NODES = 16
EDGES = "v long, u long, sim double"


def _matrix(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit rows in double precision; all vectors have one length."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(vectors), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _nodes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct valid vectors (v, part, weight, vector), and of every valid row (vec_id, v)."""
    vector = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = vectors.select("vec_id", "label", vector.alias("vector")).where("vec_id is not null and label is not null and vector is not null").where(finite & F.exists("vector", lambda x: x != 0))
    key = ["part", "h1", "h2"]
    rows = rows.select("vec_id", F.xxhash64("label", F.size("vector")).alias("part"), F.xxhash64("vector").alias("h1"), F.xxhash64("vector", F.lit(3)).alias("h2"), "vector")
    nodes = rows.groupBy(*key).agg(F.min("vec_id").alias("v"), F.count("*").alias("weight"), F.min("vector").alias("vector"))
    nodes = stored(nodes, "vectors")
    named = nodes.select(*[F.col(k).alias(f"_{k}") for k in key], "v")
    own = rows.select("vec_id", *key).join(named, [F.col(k) == F.col(f"_{k}") for k in key]).select("vec_id", "v")
    return nodes.select("v", "part", "weight", "vector"), own


def _cells(nodes: DataFrame, trees: int, seed: int) -> DataFrame:
    """(v, cell): for each projection tree the node's cell, of about CELL nodes; larger ones are split at random."""
    sizes = stored(nodes.groupBy("part").agg(F.count("*").alias("size")), "vector-parts")
    bits = nodes.select("v", "part", "vector").join(sizes.withColumnRenamed("part", "_part"), F.col("part") == F.col("_part")).select("v", "part", "vector", "size")

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column("vector").value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, int(dim)]).standard_normal((int(dim), trees * 24))
                on = (_matrix(part.column("vector")) @ planes[dim] > 0).reshape(len(part), trees, 24)
                depth = np.ceil(np.log2(np.maximum(1, part.column("size").to_numpy() / CELL))).clip(0, 24).astype(int)
                code = (on * (np.arange(24) < depth[:, None, None]) * (1 << np.arange(24))).sum(2)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column("v").to_numpy(), trees)), pa.array(np.repeat(part.column("part").to_numpy(), trees)), pa.array(np.tile(np.arange(trees), len(part))), pa.array(code.ravel())], ["v", "part", "tree", "code"])

    placed = bits.mapInArrow(signs, "v long, part long, tree long, code long").select("v", F.col("tree"), F.xxhash64("part", "tree", "code").alias("cell"))
    placed = stored(placed, "vector-cells")
    full = stored(placed.groupBy("cell").agg(F.count("*").alias("size")), "vector-cell-sizes").withColumnRenamed("cell", "_cell")
    split = F.pmod(F.xxhash64("v", "tree", F.lit(seed)), F.ceil(F.col("size") / BLOCK))
    return placed.join(full, F.col("cell") == F.col("_cell")).select("v", F.xxhash64("cell", split).alias("cell"))


def _nearest(x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sim = x @ x.T
    np.fill_diagonal(sim, -2)
    k = min(k, len(ids) - 1)
    best = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    return np.repeat(ids, k), ids[best].ravel(), np.take_along_axis(sim, best, 1).ravel()


def _merge(edges: DataFrame, k: int) -> DataFrame:
    """(v, near): the k nearest of each node, nearest first; ties by id."""
    best = F.slice(F.array_sort(F.array_distinct(F.collect_list(F.struct((-F.col("sim")).alias("far"), "u")))), 1, k)
    return edges.groupBy("v").agg(best.alias("near"))


def _start(nodes: DataFrame, trees: int, k: int, seed: int) -> DataFrame:
    held = _cells(nodes, trees, seed).withColumnRenamed("v", "_v").join(nodes.select("v", "vector"), F.col("_v") == F.col("v")).select("v", "cell", "vector")

    def run(group: pa.Table) -> pa.Table:
        ids = group.column("v").to_numpy()
        v, u, sim = _nearest(_matrix(group.column("vector")), ids, k) if len(ids) > 1 else (ids[:0], ids[:0], np.zeros(0))
        return pa.table({"v": v, "u": u, "sim": sim})

    return held.groupBy("cell").applyInArrow(run, EDGES)


def _round(nodes: DataFrame, lists: DataFrame, k: int, groups: int, turn: int) -> DataFrame:
    """Edges found by comparing each node's neighbours and reverse neighbours with each other."""
    edges = lists.select("v", F.explode("near.u").alias("u"))
    degree = stored(edges.groupBy("u").agg(F.count("*").alias("degree")), "vector-degrees").withColumnRenamed("u", "_u")
    draw = F.pmod(F.xxhash64("v", "u", F.lit(turn)), F.lit(1 << 20)) / F.lit(1 << 20)
    back = edges.join(degree, F.col("u") == F.col("_u")).where(draw * F.col("degree") < REVERSE).select(F.col("u").alias("c"), F.col("v").alias("m"))
    own = lists.select(F.col("v").alias("c"), F.col("v").alias("m"))
    around = edges.select(F.col("v").alias("c"), F.col("u").alias("m")).union(back).union(own).distinct()
    worst = lists.select(F.col("v").alias("_v"), F.when(F.size("near") >= k, -F.element_at("near", -1)["far"]).otherwise(-2.0).alias("worst"))
    held = nodes.select("v", "vector").join(worst, F.col("v") == F.col("_v")).select("v", "vector", "worst")
    around = around.join(held, F.col("m") == F.col("v")).select("c", "m", "vector", "worst", F.pmod(F.xxhash64("c"), F.lit(groups)).alias("g"))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("c", "ascending"), ("m", "ascending")])
        dims = group.column("vector").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for dim in np.unique(dims):
            part = group.filter(pa.array(dims == dim))
            c, m, worst, x = part.column("c").to_numpy(), part.column("m").to_numpy(), part.column("worst").to_numpy(), _matrix(part.column("vector"))
            begin = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
            size = np.diff(np.append(begin, len(c)))
            for width in np.unique(size):
                at = begin[size == width]
                for i in range(0, len(at), 500):
                    rows = at[i : i + 500, None] + np.arange(width)
                    sim = np.einsum("cid,cjd->cij", x[rows], x[rows], optimize=True)
                    better = (sim > worst[rows][:, :, None]) & ~np.eye(width, dtype=bool)
                    b, p, q = np.nonzero(better)
                    out.append((m[rows[b, p]], m[rows[b, q]], sim[b, p, q]))
        v, u, sim = (np.concatenate([o[k] for o in out]) if out else np.zeros(0) for k in range(3))
        both = np.unique(np.rec.fromarrays([v.astype(np.int64), u.astype(np.int64), sim], names="v,u,sim")) if len(v) else None
        return pa.table({"v": both.v, "u": both.u, "sim": both.sim}) if both is not None else pa.table({"v": pa.array([], pa.int64()), "u": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})

    return around.groupBy("g").applyInArrow(run, EDGES)


def neighbour_lists(nodes: DataFrame, k: int, trees: int, rounds: int, seed: int) -> DataFrame:
    """The refined neighbour graph: (v, near), near an array of (far, u) with far the negative cosine."""
    lists = stored(_merge(_start(nodes, trees, k, seed), k), "vector-lists")
    groups = max(1, -(-nodes.count() // 1000))
    for turn in range(rounds):
        found = _round(nodes, lists, k, groups, turn)
        old = lists.select("v", F.explode("near").alias("e")).select("v", "e.u", (-F.col("e.far")).alias("sim"))
        lists = stored(_merge(old.union(found), k), "vector-lists")
    return lists


def _blocks(rows: DataFrame, key: str, most: int) -> DataFrame:
    """``rows`` dealt over pairs of blocks of their ``key``, each pair once: columns block, i, j and g, the group that compares it."""
    sizes = stored(rows.groupBy(key).agg(F.count("*").alias("size")), "vector-components").withColumnRenamed(key, "_key")
    shared = -(-(sizes.where(F.col("size") <= most).agg(F.sum("size")).first()[0] or 0) // SHARED) or 1
    rows = rows.join(sizes, F.col(key) == F.col("_key")).withColumn("blocks", F.ceil(F.col("size") / most)).withColumn("block", F.pmod(F.xxhash64("v", F.lit(9)), F.col("blocks"))).drop("_key", "size")
    # small components share a group; each block of a large one meets every other once
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    rows = rows.select("*", other).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    group = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64(key), F.lit(shared))).otherwise(F.xxhash64(key, "i", "j"))
    return rows.withColumn("g", group).drop("blocks", "other")


def _joined(near: np.ndarray) -> np.ndarray:
    """For each row of a symmetric link matrix, the least row that it is connected to."""
    label = np.arange(len(near))
    while True:
        least = np.minimum(label, np.where(near, label, len(near)).min(axis=1))
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _compared(nodes: DataFrame, place: DataFrame, threshold: float, join: bool = False) -> DataFrame:
    """(v, u, linked) for each node and pair of blocks of its component, all compared: the weights of the nodes linked with it, and with ``join`` the node that links join it to."""
    rows = place.select(F.col("node").alias("_v"), "component").join(nodes.select("v", "weight", "vector"), F.col("_v") == F.col("v"))
    rows = _blocks(rows.select("v", "weight", "vector", "component"), "component", BLOCK if join else COMPARED)

    def sums(x: np.ndarray, y: np.ndarray, wx: np.ndarray, wy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row of ``x`` the weights linked in ``y``, and the other way round, some rows at a time."""
        mine, theirs = np.zeros(len(x), dtype=np.int64), np.zeros(len(y), dtype=np.int64)
        for at in range(0, len(x), TILE):
            near = x[at : at + TILE] @ y.T >= threshold
            mine[at : at + TILE] = near @ wy
            theirs += wx[at : at + TILE] @ near
        return mine, theirs

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("component", "ascending"), ("block", "ascending"), ("v", "ascending")])
        v, weight, block, c, i, j = (table.column(k).to_numpy() for k in ("v", "weight", "block", "component", "i", "j"))
        lists = table.column("vector").combine_chunks()
        bounds = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1])]))
        ids, to, linked = [], [], []
        for lo, hi in zip(bounds, np.append(bounds[1:], len(v)), strict=True):
            x, w, first = _matrix(lists.slice(lo, hi - lo)), weight[lo:hi], block[lo:hi] == i[lo]
            own = i[lo] == j[lo]
            if join:  # blocks are in order: the rows of the first come first
                near = x @ x.T >= threshold
                near &= ~np.eye(len(x), dtype=bool) if own else first[:, None] != first
                ids.append(v[lo:hi])
                linked.append(near @ w)
                to.append(v[lo:hi][_joined(near | near.T)])
            elif own:
                ids.append(v[lo:hi])
                # a node is always its own neighbour: its cosine with itself is 1
                linked.append(sums(x, x, w, w)[0] - w * (np.einsum("ij,ij->i", x, x) >= threshold))
                to.append(v[lo:hi])
            else:
                ids += [v[lo:hi][first], v[lo:hi][~first]]
                linked += sums(x[first], x[~first], w[first], w[~first])
                to.append(v[lo:hi])
        return pa.table({"v": np.concatenate(ids), "u": np.concatenate(to), "linked": np.concatenate(linked).astype(np.int64)})

    return rows.groupBy("g").applyInArrow(run, "v long, u long, linked long")


def _counts(nodes: DataFrame, place: DataFrame, threshold: float) -> DataFrame:
    """(v, linked): the weights of the other nodes linked with each node of a component, all compared, in blocks."""
    return _compared(nodes, place, threshold).groupBy("v").agg(F.sum("linked").alias("linked"))


def _balls(members: DataFrame) -> DataFrame:
    """(v, vector, part, component, ball, radius): of each block of a component's members the one nearest to their mean, and the angle to the farthest."""
    groups = max(1, -(-members.count() // 4000))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("component", "ascending"), ("ball", "ascending"), ("v", "ascending")])
        c, ball, lists = table.column("component").to_numpy(), table.column("ball").to_numpy(), table.column("vector").combine_chunks()
        bounds = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (ball[1:] != ball[:-1])]))
        at, radius = [], []
        for lo, hi in zip(bounds, np.append(bounds[1:], len(c)), strict=True):
            x = _matrix(lists.slice(lo, hi - lo))
            best = int(np.argmax(x @ x.mean(axis=0)))
            at.append(lo + best)
            radius.append(float(np.arccos(np.clip((x @ x[best]).min(), -1, 1))))
        return table.select(["v", "vector", "part", "component", "ball"]).take(pa.array(at)).append_column("radius", pa.array(radius, pa.float64()))

    group = F.pmod(F.xxhash64("component", "ball"), F.lit(groups))
    return members.withColumn("g", group).groupBy("g").applyInArrow(run, "v long, vector array<double>, part long, component long, ball long, radius double")


def _merges(nodes: DataFrame, lists: DataFrame, place: DataFrame, k: int, threshold: float) -> DataFrame | None:
    """(node, component) of components that links between saturated nodes join to others of their label, or None.

    A link that neither end's list holds has two saturated ends, if lists hold the nearest.  So the saturated
    nodes of different components are compared: first one of each block of them, which joins most; by the
    triangle inequality for angles most other pairs of blocks can't be linked, and the rest are compared in full.
    """
    full = lists.where((F.size("near") >= k) & (-F.element_at("near", -1)["far"] >= threshold)).select(F.col("v").alias("_f"))
    members = place.join(full, F.col("node") == F.col("_f")).select("node", "component").join(nodes.select("v", "part", "vector"), F.col("node") == F.col("v")).select("v", "part", "vector", "component")
    members = stored(members, "vector-saturated")
    many = members.groupBy("part").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select(F.col("part").alias("_part"))
    members = members.join(many, F.col("part") == F.col("_part"), "left_semi")
    sizes = stored(members.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).alias("balls")), "vector-balls").withColumnRenamed("component", "_component")
    if sizes.isEmpty():
        return None
    members = stored(members.join(sizes, F.col("component") == F.col("_component")).select("v", "part", "vector", "component", F.pmod(F.xxhash64("v", F.lit(5)), F.col("balls")).alias("ball")), "vector-members")
    angle = float(np.arccos(threshold)) + 1e-6

    def meet(table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("block", "ascending"), ("v", "ascending")])
        part, block, i, j, c, ball, radius = (table.column(n).to_numpy() for n in ("part", "block", "i", "j", "component", "ball", "radius"))
        lists = table.column("vector").combine_chunks()
        bounds = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        out: list[tuple[np.ndarray, ...]] = []
        for lo, hi in zip(bounds, np.append(bounds[1:], len(part)), strict=True):
            x, of, at, r = _matrix(lists.slice(lo, hi - lo)), c[lo:hi], ball[lo:hi], radius[lo:hi]
            cos = x @ x.T
            sure = _joined((cos >= threshold) | (of[:, None] == of))
            out.append((of, at, of[sure], at[sure], np.ones(len(of), dtype=bool)))
            maybe = (np.arccos(cos.clip(-1, 1)) - r[:, None] - r <= angle) & (sure[:, None] != sure)
            if i[lo] != j[lo]:
                maybe &= block[lo:hi][:, None] != block[lo:hi]
            a, b = np.nonzero(np.triu(maybe))
            out.append((of[a], at[a], of[b], at[b], np.zeros(len(a), dtype=bool)))
        return pa.table(dict(zip(("a", "ball_a", "b", "ball_b", "sure"), (np.concatenate(o) for o in zip(*out, strict=True)), strict=True)))

    pairs = _blocks(_balls(members), "part", BLOCK).groupBy("g").applyInArrow(meet, "a long, ball_a long, b long, ball_b long, sure boolean")
    pairs = stored(pairs.where("a <> b"), "vector-pairs")
    sure = pairs.where("sure").select("a", "b")
    over = components(sure)
    left, right = over.select(F.col("node").alias("_a"), F.col("component").alias("_ca")), over.select(F.col("node").alias("_b"), F.col("component").alias("_cb"))
    apart = pairs.where("not sure").join(left, F.col("a") == F.col("_a"), "left").join(right, F.col("b") == F.col("_b"), "left").where("coalesce(_ca, a) <> coalesce(_cb, b)")
    apart = stored(apart.select("a", "ball_a", "b", "ball_b").distinct().withColumn("pair", F.xxhash64("a", "ball_a", "b", "ball_b")), "vector-apart")
    groups = max(1, -(-apart.count() // 16))
    sides = apart.select("pair", F.col("a").alias("c"), F.col("ball_a").alias("at"), F.lit(True).alias("first")).union(apart.select("pair", F.col("b").alias("c"), F.col("ball_b").alias("at"), F.lit(False).alias("first")))
    sides = sides.join(members, (F.col("c") == F.col("component")) & (F.col("at") == F.col("ball"))).select("pair", "first", "component", "vector", F.pmod("pair", F.lit(groups)).alias("g"))

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("pair", "ascending"), ("first", "descending")])
        pair, first, c, lists = table.column("pair").to_numpy(), table.column("first").to_numpy(), table.column("component").to_numpy(), table.column("vector").combine_chunks()
        bounds = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        ends = []
        for lo, hi in zip(bounds, np.append(bounds[1:], len(pair)), strict=True):
            x, n = _matrix(lists.slice(lo, hi - lo)), int(first[lo:hi].sum())
            if (x[:n] @ x[n:].T >= threshold).any():
                ends.append((c[lo], c[hi - 1]))
        return pa.table({"a": pa.array([e[0] for e in ends], pa.int64()), "b": pa.array([e[1] for e in ends], pa.int64())})

    return components(sure.union(sides.groupBy("g").applyInArrow(compare, "a long, b long")))


def audit(nodes: DataFrame, counts: DataFrame, threshold: float, sample: int = 512, seed: int = 3) -> float:
    """The least of several figures for a sample of nodes that are compared with all rows (1.0 where there are no links).

    One is the share of all links that is found.  The others are means over nodes that have links of the share
    found, so that no large group decides: for nodes drawn alike, for nodes drawn over labels and for linked
    nodes drawn over groups, and for each true size (a power of two) that LEAST_NODES of the sample have.
    """
    # the smallest of exponential draws, times a size: every label, or group of linked nodes, is as likely as another
    draw = lambda n: -F.log((F.pmod(F.xxhash64("v", F.lit(seed + n)), F.lit(1 << 40)) + 1) / F.lit((1 << 40) + 1))
    sizes = nodes.groupBy("part").agg(F.count("*").alias("size")).withColumnRenamed("part", "_part")
    drawn = {
        "nodes": nodes.orderBy(draw(0)).limit(sample // 2),
        "labels": nodes.join(sizes, F.col("part") == F.col("_part")).orderBy(draw(1) * F.col("size")).limit(sample // 4),
        "groups": counts.where("linked > 0").orderBy(draw(2) * F.col("linked")).limit(sample // 4),
    }
    of: dict[int, set[str]] = {}
    for name, some in drawn.items():
        for r in some.select("v").collect():
            of.setdefault(r["v"], set()).add(name)
    picked = nodes.sparkSession.createDataFrame([(v,) for v in of], "v long")
    rows = nodes.join(F.broadcast(picked.withColumnRenamed("v", "_v")), F.col("v") == F.col("_v")).select("v", "part", "vector").collect()  # ``sample`` vectors at most
    asked: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for part in {r["part"] for r in rows}:
        own = [r for r in rows if r["part"] == part]
        x = np.array([r["vector"] for r in own])
        asked[part] = (np.array([r["v"] for r in own]), x / np.linalg.norm(x, axis=1, keepdims=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column("part").to_numpy()
            for part in np.unique(parts):
                if int(part) in asked:
                    ids, x = asked[int(part)]
                    own = batch.filter(pa.array(parts == part))
                    near = (x @ _matrix(own.column("vector")).T >= threshold) & (ids[:, None] != own.column("v").to_numpy())
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array((near @ own.column("weight").to_numpy()).astype(np.int64))], ["v", "n"])

    truth = nodes.mapInArrow(run, "v long, n long").groupBy("v").agg(F.sum("n").alias("n"))
    found = truth.join(counts.withColumnRenamed("v", "_v"), F.col("v") == F.col("_v"), "left").where("n > 0").select("v", "n", F.least("n", F.coalesce("linked", F.lit(0))).alias("found")).collect()  # ``sample`` rows at most
    if not found:
        return 1.0
    shares: dict[str, list[float]] = {}
    for r in found:
        for name in of[r["v"]]:
            shares.setdefault(name, []).append(r["found"] / r["n"])
        shares.setdefault(f"size {r['n'].bit_length()}", []).append(r["found"] / r["n"])
    means = [float(np.mean(s)) for name, s in shares.items() if not name.startswith("size") or len(s) >= LEAST_NODES]
    return min([sum(r["found"] for r in found) / sum(r["n"] for r in found), *means])


def deduplicate(vectors: DataFrame, threshold: float = 0.93, k: int = 10, trees: int = 6, rounds: int = 2, least_recall: float = 0.95, tries: int = 3, seed: int = 1) -> DataFrame:
    """The operator: (vec_id, n_links, component_id, kept, audited_recall) for every row; vec_id is a whole number."""
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    nodes, own = _nodes(vectors)
    for attempt in range(tries):
        lists = neighbour_lists(nodes, k << attempt, trees << attempt, rounds, seed + attempt)
        edges = lists.select("v", F.explode("near").alias("e")).where(-F.col("e.far") >= threshold).select(F.col("v").alias("a"), F.col("e.u").alias("b"))
        place = components(edges)
        over = _merges(nodes, lists, place, k << attempt, threshold)
        if over is not None:
            over = over.select(F.col("node").alias("_c"), F.col("component").alias("_over"))
            place = stored(place.join(over, F.col("component") == F.col("_c"), "left").select("node", F.coalesce("_over", "component").alias("component")), "vector-merged")
        counts = stored(_counts(nodes, place, threshold), "vector-counts")
        recall = audit(nodes, counts, threshold)
        if recall >= least_recall:
            break
    else:  # no graph was good enough: each label is compared as a whole
        whole = stored(_compared(nodes, nodes.select(F.col("v").alias("node"), F.col("part").alias("component")), threshold, join=True), "vector-whole")
        place = components(whole.select(F.col("v").alias("a"), F.col("u").alias("b")))
        counts = stored(whole.groupBy("v").agg(F.sum("linked").alias("linked")), "vector-counts")
        recall = audit(nodes, counts, threshold)
    known = nodes.select("v", "weight").join(place.withColumnRenamed("node", "_node"), F.col("v") == F.col("_node"), "left").join(counts.withColumnRenamed("v", "_c"), F.col("v") == F.col("_c"), "left")
    known = stored(known.select(F.col("v").alias("_v"), F.coalesce("component", "v").alias("component"), (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("links")), "vector-known")
    linked = own.join(known, F.col("v") == F.col("_v")).select(F.col("vec_id").alias("_id"), "component", "links").distinct()
    out = vectors.select("vec_id").join(stored(linked, "vector-linked"), F.col("vec_id") == F.col("_id"), "left")
    component: Column = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"), F.lit(float(recall)).alias("audited_recall"))
