"""Merkle manifest of a dataset: leaves, subroots by source, one root, and a proof for each row.

Method.  A leaf is the digest of a row's fields in a canonical form.  Leaves are numbered within their source
(``common.numbered``, so that a source with most rows lies in many tasks) and grouped into blocks of 256 consecutive ones.  A
block is an ordered array of digests that collapses by two levels within one row: ``sequence`` counts the runs of 16,
``transform`` and ``slice`` take each run and hash it.  The roots of blocks are the nodes of the next round, 256 times fewer,
until each source has one, its subroot.  Subroots, ordered by source, collapse the same way into the root.

Paths go down as the digests went up: each block takes the path of its root, found a round later, and puts the siblings of its
own two levels before it.  A leaf's path lives only inside its block's row, where ``aggregate`` folds a leaf and its siblings into
the root; what leaves the row are digests.

A digest is SHA-256 as lowercase hexadecimal text; a parent is the digest of its children's texts, joined.

Defined results
* a field that is null is ``-``, else its UTF-8 bytes' count, ``:`` and its value, so an empty text differs from null;
* the null source is a source of its own, the first; the empty one is the next;
* rows of a source ascend by doc_id, a null id first, and rows with equal id by their leaves, so repeated rows have proofs of
  their own but equal digests;
* a lone row is its own subroot, a lone subroot the root; without siblings a proof is the digest of the empty text;
* texts of any length are hashed whole; rows without an id are not tampered with in ``attested``;
* no rows: no rows.  Other columns are neither read nor needed.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined, lower_ascii, numbered, scratch, stored

#: Children of a node; nodes of a block, which spans two levels.
RUN, BLOCK = 16, 256
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def canonical(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: dict[str, Column]) -> Column:
    return digest(F.concat(*[canonical(v) for v in values.values()]))


def _parents(nodes: Column) -> Column:
    """The digests of each run of consecutive nodes."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / RUN).cast("int"))
    return F.transform(runs, lambda k: digest(F.array_join(F.slice(nodes, k * RUN + 1, RUN), "")))


def _siblings(nodes: Column, p: Column) -> Column:
    """What stands to the left and to the right of node ``p`` in its run."""
    first = p - p % RUN
    return F.struct(F.array_join(F.slice(nodes, first + 1, p - first), "").alias("left"), F.array_join(F.slice(nodes, p + 2, first + RUN - 1 - p), "").alias("right"))


def folded(node: Column, path: Column) -> Column:
    """The root that a node and its path (array of left and right) give."""
    return F.aggregate(path, node, lambda below, level: digest(F.concat(level["left"], below, level["right"])))


def proof(path: Column) -> Column:
    """The digest of all siblings of a path."""
    return digest(F.array_join(F.transform(path, lambda level: F.concat(level["left"], level["right"])), ""))


def _blocks(nodes: DataFrame, key: list[str], held: list[str], name: str) -> DataFrame:
    """(key, block, total, levels, node, ``held``, inner, top) of nodes (key, at, total, node, held): arrays of a block's nodes and of the level above, and its root."""
    rows = nodes.groupBy(*key, F.floor(F.col("at") / BLOCK).alias("block"))
    rows = rows.agg(F.first("total").alias("total"), F.sort_array(F.collect_list(F.struct("at", "node", *held))).alias("rows"))  # BLOCK rows at most
    levels = F.when(F.col("total") <= 1, 0).when(F.col("total") <= RUN, 1).otherwise(2)
    rows = rows.select(*key, "block", "total", levels.alias("levels"), *[F.col(f"rows.{c}").alias(c) for c in ("node", *held)])
    rows = rows.withColumn("inner", F.when(F.col("levels") > 0, _parents(F.col("node"))))
    top = F.when(F.col("levels") == 0, F.get("node", F.lit(0))).when(F.col("levels") == 1, F.get("inner", F.lit(0))).otherwise(F.get(_parents(F.col("inner")), F.lit(0)))
    return stored(rows.withColumn("top", top), name)


def _rise(nodes: DataFrame, key: list[str], held: list[str], name: str) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each round, until every key has one node; and those nodes (key, node)."""
    rounds: list[DataFrame] = []
    while True:
        rounds.append(_blocks(nodes, key, held, f"{name}-{len(rounds)}"))
        nodes = rounds[-1].select(*key, F.col("block").alias("at"), F.ceil(F.col("total") / BLOCK).alias("total"), F.col("top").alias("node"))
        held = []
        if (nodes.agg(F.max("total")).first()[0] or 1) == 1:
            return rounds, nodes.select(*key, "node")


def _paths(p: Column) -> Column:
    """The path of node ``p`` of a block, with that of the block's root, ``above``, after it."""
    own, outer = _siblings(F.col("node"), p), _siblings(F.col("inner"), F.floor(p / RUN).cast("int"))
    return F.when(F.col("levels") == 0, F.col("above")).when(F.col("levels") == 1, F.concat(F.array(own), F.col("above"))).otherwise(F.concat(F.array(own, outer), F.col("above")))


def _positions() -> Column:
    return F.sequence(F.lit(0), F.size("node") - 1)


def _descend(rounds: list[DataFrame], above: DataFrame, key: list[str], more: list[str]) -> DataFrame:
    """(key, at, above, more) of the nodes of the first of ``rounds``, from (key, at, above, more) of what the last one gives."""
    for blocks in reversed(rounds):
        rows = joined(blocks, above.withColumnRenamed("at", "block"), [*key, "block"])
        found = F.transform(_positions(), lambda p: F.struct((F.col("block") * BLOCK + p).alias("at"), _paths(p).alias("above")))
        above = rows.select(*key, *more, F.explode(found).alias("_n")).select(*key, "_n.at", "_n.above", *more)
    return above


@dataclasses.dataclass
class Manifest:
    """``leaves`` are blocks of (doc_id, node, held columns) with ``above``, the path of the block's root, and subroot; ``subroots`` (source, node); the root is null without rows."""

    leaves: DataFrame
    subroots: DataFrame
    root: str | None


def manifest(rows: DataFrame, held: tuple[str, ...] = ()) -> Manifest:
    """The tree over rows (doc_id, source, node, and columns ``held``), a leaf each."""
    spark = rows.sparkSession
    with scratch(spark) as kept:
        nodes = numbered(rows, ["source"], ["doc_id", "node"], "at", "total", "merkle-leaves")
        rounds, subroots = _rise(nodes, ["source"], ["doc_id", *held], "merkle-source")
        subroots = stored(subroots, "merkle-subroots")
        sources = numbered(subroots, [], ["source"], "at", "total", "merkle-sources")
        upper, roots = _rise(sources, [], ["source"], "merkle-root")
        root = roots.first()
        # down again: the root has no siblings
        empty = F.array().cast("array<struct<left:string,right:string>>")
        above = _descend(upper[1:], roots.select(F.lit(0).cast("long").alias("at"), empty.alias("above")), [], [])
        last = joined(upper[0], above.withColumnRenamed("at", "block"), ["block"])
        found = F.transform(_positions(), lambda p: F.struct(F.get("source", p).alias("source"), F.get("node", p).alias("subroot"), _paths(p).alias("above")))
        sources = last.select(F.explode(found).alias("_n")).select("_n.source", F.lit(0).cast("long").alias("at"), "_n.above", "_n.subroot")
        above = stored(_descend(rounds[1:], sources, ["source"], ["subroot"]), "merkle-above")
        leaves = joined(rounds[0], above.withColumnRenamed("at", "block"), ["source", "block"])
        kept += [rounds[0], above, subroots]
    return Manifest(leaves, subroots, root["node"] if root else None)


def proofs(tree: Manifest, made: dict[str, Callable[..., Column]] | None = None, held: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, leaf, subroot, root, path) of every row; or, in place of the path, columns ``made`` by functions of leaf, path and ``held``.

    With ``made``, long paths stay within the rows of blocks.
    """
    made = made or {"path": lambda node, path, *_: path}

    def known(p: Column) -> Column:
        return F.struct(F.get("doc_id", p).alias("doc_id"), F.get("node", p).alias("leaf"), _paths(p).alias("path"), *[F.get(h, p).alias(h) for h in held])

    def shown(x: Column) -> Column:
        return F.struct(x["doc_id"].alias("doc_id"), x["leaf"].alias("leaf"), *[f(x["leaf"], x["path"], *[x[h] for h in held]).alias(k) for k, f in made.items()])

    rows = tree.leaves.select("subroot", F.explode(F.transform(F.transform(_positions(), known), shown)).alias("_r"))
    return rows.select("_r.doc_id", "_r.leaf", "subroot", F.lit(tree.root).cast("string").alias("root"), *[F.col(f"_r.{k}").alias(k) for k in made])


def attested(docs: DataFrame, every: int = 5) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, and what a check against tampered rows finds: folded_root and verified.

    Where ``every`` divides crc32 of the decimal doc_id, the checked row has its text's A-Z in lower case.
    """
    values = {c: F.col(c) for c in FIELDS}
    touched = F.crc32(F.col("doc_id").cast("string")) % every == 0
    changed = F.when(touched & (lower_ascii(F.col("text")) != F.col("text")), leaf(values | {"text": lower_ascii(F.col("text"))}))
    rows = stored(docs.select("doc_id", "source", leaf(values).alias("node"), changed.alias("changed")), "merkle-rows")
    made = {"proof_sha256": lambda node, path, new: proof(path), "folded_root": lambda node, path, new: folded(F.coalesce(new, node), path)}
    out = proofs(manifest(rows, ("changed",)), made, ("changed",))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: crc32 of a text of digits: eight steps for each byte, the first of which takes it in.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295)"


def _sql_leaf(text: str) -> str:
    part = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    return f"sha256({' || '.join(part(text if c == 'text' else c) for c in FIELDS)})"


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The tree level by level: tier 0 are sources, tier 1 is what their subroots make.
ORACLE_SQL = f"""WITH RECURSIVE rows AS (
  SELECT doc_id, source, {_sql_leaf('text')} AS leaf, {_sql_leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} AS lowered, coalesce({_CRC} % 5 = 0, false) AS touched FROM documents),
leaves AS (SELECT *, row_number() OVER () AS r, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS m FROM rows),
low AS (SELECT 0 AS k, source, i, leaf AS d, m FROM leaves
  UNION ALL SELECT k + 1, source, i // 16, sha256(string_agg(d, '' ORDER BY i)), (m + 15) // 16 FROM low WHERE m > 1 GROUP BY k, source, i // 16, m),
subs AS (SELECT source, d, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS i, count(*) OVER () AS m FROM low WHERE m = 1),
high AS (SELECT 0 AS k, i, d, m FROM subs
  UNION ALL SELECT k + 1, i // 16, sha256(string_agg(d, '' ORDER BY i)), (m + 15) // 16 FROM high WHERE m > 1 GROUP BY k, i // 16, m),
near AS (
  SELECT l.r, n.k AS step, n.i AS pos, l.i // CAST(pow(16, n.k) AS BIGINT) AS own, n.d FROM leaves l JOIN low n ON n.source IS NOT DISTINCT FROM l.source AND n.m > 1 AND n.i // 16 = l.i // CAST(pow(16, n.k + 1) AS BIGINT)
  UNION ALL SELECT l.r, 100 + n.k, n.i, s.i // CAST(pow(16, n.k) AS BIGINT), n.d FROM leaves l JOIN subs s ON s.source IS NOT DISTINCT FROM l.source JOIN high n ON n.m > 1 AND n.i // 16 = s.i // CAST(pow(16, n.k + 1) AS BIGINT)),
steps AS (SELECT r, row_number() OVER (PARTITION BY r ORDER BY step) AS s, coalesce(string_agg(d, '' ORDER BY pos) FILTER (WHERE pos < own), '') AS l, coalesce(string_agg(d, '' ORDER BY pos) FILTER (WHERE pos > own), '') AS h FROM near GROUP BY r, step),
fold AS (SELECT r, 0 AS s, CASE WHEN touched THEN lowered ELSE leaf END AS d FROM leaves
  UNION ALL SELECT f.r, f.s + 1, sha256(x.l || f.d || x.h) FROM fold f JOIN steps x ON x.r = f.r AND x.s = f.s + 1),
ends AS (SELECT r, arg_max(d, s) AS d FROM fold GROUP BY r),
proofs AS (SELECT r, string_agg(l || h, '' ORDER BY s) AS p FROM steps GROUP BY r)
SELECT l.doc_id, l.leaf, s.d AS subroot, t.d AS root, sha256(coalesce(p.p, '')) AS proof_sha256, e.d AS folded_root, e.d = t.d AS verified
FROM leaves l JOIN subs s ON s.source IS NOT DISTINCT FROM l.source JOIN (SELECT d FROM high WHERE m = 1) t ON true JOIN ends e ON e.r = l.r LEFT JOIN proofs p ON p.r = l.r"""
