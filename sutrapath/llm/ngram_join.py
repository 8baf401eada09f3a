"""N-gram Jaccard join: documents whose sets of word shingles are alike, by a grouped prefix join.

Method.  A document's set is its distinct shingles.  Shingles have one global order, rare ones first:
by a class of document frequency (a hashed table of frequent shingles, whose width follows the number
of documents up to a fixed bound) and then by hash.  Two sets can reach the threshold only if their
prefixes in that order share a shingle, the shorter one already within its shorter index prefix.

1. Documents with equal sets are one node.  Nodes with equal prefix and size are one group.
2. Groups meet in the postings of their prefix shingles.  Size and position bound the possible overlap;
   entries that no partner in the posting can satisfy go before anything is paired.
3. In each posting all groups are paired with its pivot, the group whose shingle stands earliest (it has
   fewest rare shingles and is closest to what the others were copied from); members are paired with
   their group.  Pairs are verified on whole sets, links contracted to components.
4. What still stands in different components within one posting is paired in full, groups expanded into
   their members, verified, and contracted again.  So no link is lost, and copies never meet
   all with all, as they are in one component by then.

Defined results
* null, empty or blank text: n_shingles 0, linked with nothing, its own component;
* fewer words than a shingle: the whole sequence is the one shingle;
* doc_id is taken as unique: rows with equal id and text are one document; of rows with equal id and
  different texts each has its own set, and those that are the least id of their set count as one node;
* null doc_id: the row keeps its set size, has no component and links nothing;
* no rows: no rows.  Columns other than doc_id and text are neither read nor needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, carried, mix64, segment_sums, stored, text_slices, trim, word_hashes
from .components import components

SLICE = 4 << 20
#: A hashed shingle counts as frequent from this many occurrences on; shingles that are counted together.
FREQUENT, AT_ONCE = 6, 2_000_000
#: Rows that Python functions get at a time.
BATCH_ROWS = 1000
#: Most rows of a side that is broadcast, 8 bytes each; larger sides are shuffled.
BROADCAST_ROWS = 1_000_000


def shingle_hashes(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every shingle of each text, in a row, and the text it is of."""
    words = Words(texts, "ascii")
    token, n = word_hashes(words.distinct)[words.code], words.counts
    many = np.where(n >= width, n - width + 1, 0)
    row = np.repeat(np.arange(words.rows), many)
    at = words.starts[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    factor = np.uint64(0x9E3779B97F4A7C15)
    value = np.full(len(row), width, dtype=np.uint64)
    for j in range(width):
        value *= factor
        value += token[at + j]
    few = np.flatnonzero((n > 0) & (n < width))
    if len(few):  # the whole sequence of a short text
        short = n[few].astype(np.uint64)
        for j in range(width - 1):
            inside = j < n[few]
            short = np.where(inside, short * factor + token[np.minimum(words.starts[few] + j, len(token) - 1)], short)
        value, row = np.concatenate([value, short]), np.concatenate([row, few])
    return mix64(value), row


def shingle_sets(texts: pa.Array, width: int, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text in the global order, in a row; and where each text's begin (n + 1).

    A shingle is a number of 64 bits: its frequency class in the first 8, then 56 bits of its hash; so numbers
    are in the global order.
    """
    value, row = shingle_hashes(texts, width)
    value = (classes[value & np.uint64(len(classes) - 1)].astype(np.uint64) << np.uint64(56)) | (value >> np.uint64(8))
    order = np.argsort(value)
    value, row = value[order], row[order]
    order = np.argsort(row.astype(np.uint16) if len(texts) < 1 << 16 else row, kind="stable")
    value, row = value[order], row[order]
    fresh = np.ones(len(value), dtype=bool)
    fresh[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[fresh], np.concatenate([[0], np.cumsum(np.bincount(row[fresh], minlength=len(texts)))])


def frequency_classes(docs: DataFrame, width: int, cells: int) -> np.ndarray:
    """For each hash cell, 0 or the logarithm of how often a frequent shingle of it occurs.

    Only shingles that occur twice among ``AT_ONCE`` of a task are counted: the classes order shingles and decide
    cost, not results.  The table has ``cells`` bytes, whatever the number of documents.
    """

    def counted(parts: list[np.ndarray]) -> pa.RecordBatch:
        value = np.sort(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.uint64)
        begin = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, np.int64)
        count = np.diff(np.append(begin, len(value)))
        value, count = value[begin[count > 1]], count[count > 1]
        return pa.RecordBatch.from_arrays([pa.array((value & np.uint64(cells - 1)).astype(np.int64)), pa.array(count)], ["cell", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for part in text_slices(batch, limit=SLICE):
                parts.append(shingle_hashes(part.column("text"), width)[0])
                held += len(parts[-1])
                if held >= AT_ONCE:
                    yield counted(parts)
                    parts, held = [], 0
        yield counted(parts)

    found = docs.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    found = stored(found.select("cell", F.floor(F.log2("n") * 4).cast("int").alias("class")), "join-frequent", BATCH_ROWS).toArrow()
    classes = np.zeros(cells, dtype=np.uint8)
    classes[found.column("cell").to_numpy()] = np.minimum(found.column("class").to_numpy(), 255)
    return classes


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap with any partner at the threshold: ceil(t n)."""
    return (percent * n + 99) // 100


def signatures(docs: DataFrame, classes: np.ndarray, width: int, percent: int) -> DataFrame:
    """(doc_id, n, h1, h2, p1, p2, prefix): set size, 128-bit hashes of the set and of its prefix, and the prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, limit=SLICE):
                value, starts = shingle_sets(part.column("text"), width, classes)
                n = np.diff(starts)
                length = np.where(n > 0, n - least_overlap(n, percent) + 1, 0)
                prefix = value[np.arange(len(value)) - np.repeat(starts[:-1], n) < np.repeat(length, n)]
                offsets = np.concatenate([[0], np.cumsum(length)])
                prints = [segment_sums(mix64(x ^ np.uint64(salt)), at) for x, at in ((value, starts), (prefix, offsets)) for salt in (0, 0xA5A5A5A5A5A5A5A5)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n), *(pa.array(x.astype(np.uint64).view(np.int64)) for x in prints), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(prefix.view(np.int64)))],
                    ["doc_id", "n", "h1", "h2", "p1", "p2", "prefix"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, h1 long, h2 long, p1 long, p2 long, prefix array<long>")


def _reach(n1: Column, n2: Column, percent: int) -> Column:
    """Least overlap of two sets at the threshold: ceil(t (n1 + n2) / (1 + t))."""
    return F.ceil(percent * (n1 + n2) / F.lit(100.0 + percent) - 1e-9)


def _possible(n1: Column, i1: Column, n2: Column, i2: Column, percent: int) -> Column:
    """Whether sizes allow the threshold, and the overlap too if the shingle at positions i1 and i2 is the first common one."""
    sizes = (100 * F.least(n1, n2)) >= (percent * F.greatest(n1, n2))
    return sizes & (F.least(n1 - i1, n2 - i2) + 1 >= _reach(n1, n2, percent))


def _small(table: DataFrame) -> DataFrame:
    """A stored table, marked for broadcast where it is small enough."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _some(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("_node")).union(pairs.select(F.col("b"))).distinct()


def plausible(signed: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their prefixes leave possible, as a stored table.

    Up to the lesser of the two last prefix shingles both sets are known: the overlap is at most what they have
    in common up to there and the lesser rest.
    """
    wanted = _small(stored(_some(pairs), "join-nodes"))
    known = signed.select("doc_id", "n", "prefix").join(wanted, F.col("doc_id") == F.col("_node"), "left_semi")
    one, two = (known.select(F.col("doc_id").alias(f"_{k}"), F.col("n").alias(f"n{k}"), F.col("prefix").alias(f"p{k}")) for k in ("a", "b"))
    both = pairs.select("a", "b").join(one, F.col("a") == F.col("_a")).join(two, F.col("b") == F.col("_b")).select("a", "b", "na", "nb", "pa", "pb")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, lists = [batch.column(c).to_numpy() for c in ("na", "nb")], []
            for c in ("pa", "pb"):
                column = batch.column(c)
                lists.append((column.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])))
            keep = np.zeros(len(batch), dtype=bool)
            for k in range(len(batch)):
                x, y = (values[at[k] : at[k + 1]] for values, at in lists)
                last = min(x[-1], y[-1])
                i, j = np.searchsorted(x, last, side="right"), np.searchsorted(y, last, side="right")
                common = int((y[np.minimum(np.searchsorted(y[:j], x[:i]), j - 1)] == x[:i]).sum()) if i and j else 0
                most = common + min(size[0][k] - i, size[1][k] - j)
                keep[k] = 100 * most >= percent * (size[0][k] + size[1][k] - most)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))

    return stored(both.mapInArrow(check, "a long, b long").distinct(), "join-plausible", batch_rows=200)


def verified(docs: DataFrame, pairs: DataFrame, classes: np.ndarray, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of doc_ids whose whole sets reach the threshold, as a stored table."""
    wanted = _small(stored(_some(pairs), "join-nodes"))
    chosen = docs.select("doc_id", "text").join(wanted, F.col("doc_id") == F.col("_node"), "left_semi")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, limit=SLICE):
                value, starts = shingle_sets(part.column("text"), width, classes)
                data = [value[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "shingles"])

    sets = stored(chosen.mapInArrow(pack, "doc_id long, shingles binary").groupBy("doc_id").agg(F.max("shingles").alias("shingles")), "join-sets", BATCH_ROWS)
    one, two = (sets.select(F.col("doc_id").alias(f"_{k}"), F.col("shingles").alias(k)) for k in ("sa", "sb"))
    both = pairs.select("a", "b").join(one, F.col("a") == F.col("_sa")).join(two, F.col("b") == F.col("_sb")).select("a", "b", "sa", "sb")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                x, y = (x, y) if len(x) <= len(y) else (y, x)
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0
                keep.append(100 * common >= percent * (len(x) + len(y) - common) and common > 0)
            trim()
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return stored(both.mapInArrow(check, "a long, b long"), "join-links", batch_rows=50)


def join(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """The operator: (doc_id, n_shingles, component_id) for every row; doc_id is a whole number.

    Links are pairs with 100 * intersection >= ``percent`` * union.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cells = 1 << int(np.clip(np.ceil(np.log2(max(1, docs.count()) * 16)), 16, 24))
    classes = frequency_classes(docs, width, cells)
    signed = stored(signatures(docs, classes, width, percent), "join-signatures", BATCH_ROWS)
    key, alike = ["n", "h1", "h2"], ["n", "p1", "p2"]
    nodes = signed.where("n > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("node"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    nodes = stored(nodes, "join-classes")
    groups = stored(nodes.groupBy(*alike).agg(F.min("node").alias("gid")), "join-groups")
    members = nodes.select(*alike, "node").join(groups.withColumnsRenamed({k: f"_{k}" for k in alike}), [F.col(k) == F.col(f"_{k}") for k in alike]).select("gid", "node")
    members = stored(members, "join-members")

    # postings: position from 1 in the order of the prefix, and whether it lies in the index prefix
    lead = signed.select("doc_id", "n", *[F.col(k).alias(f"_{k}") for k in ("h1", "h2")], "prefix").where("n > 0")
    lead = lead.join(_small(groups.select(F.col("gid").alias("_gid"))), F.col("doc_id") == F.col("_gid"), "left_semi")
    at = lead.select(F.col("doc_id").alias("gid"), F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("i", "token")).withColumn("i", F.col("i") + 1)
    indexed = F.col("i") <= F.col("n") - _reach(F.col("n"), F.col("n"), percent) + 1
    posting = at.groupBy("token").agg(F.count("*").alias("m"), F.min(F.when(indexed, F.col("n"))).alias("least"))
    posting = stored(posting.where("m > 1 and least is not null").select(F.col("token").alias("_token"), "least"), "join-tokens")
    partner = F.greatest(F.col("least"), F.ceil(percent * F.col("n") / F.lit(100.0) - 1e-9))
    entries = at.join(posting, F.col("token") == F.col("_token")).where(F.col("n") - F.col("i") + 1 >= _reach(F.col("n"), partner, percent))
    entries = stored(entries.select("token", "gid", "n", "i", indexed.alias("indexed")).distinct(), "join-entries")
    pivot = entries.groupBy("token").agg(F.count("*").alias("m"), F.min(F.struct((F.col("i") / F.col("n")).alias("share"), "gid", "n", "i")).alias("pivot"))
    pivot = stored(pivot.where("m > 1").select(F.col("token").alias("_token"), F.col("pivot.gid").alias("pgid"), F.col("pivot.n").alias("pn"), F.col("pivot.i").alias("pi")), "join-pivots")

    star = entries.join(pivot, F.col("token") == F.col("_token")).where(F.col("gid") != F.col("pgid"))
    star = star.where(_possible(F.col("n"), F.col("i"), F.col("pn"), F.col("pi"), percent)).select(F.col("pgid").alias("a"), F.col("gid").alias("b"))
    inside = members.where("gid <> node").select(F.col("gid").alias("a"), F.col("node").alias("b"))
    tried = stored(star.union(inside).distinct(), "join-pairs")
    links = verified(docs, plausible(signed, tried, percent), classes, width, percent)
    found = components(links)

    # what stands in different components within a posting, or apart from its group, is paired in full
    place = found.withColumnsRenamed({"node": "_node", "component": "_component"})

    def placed(table: DataFrame, node: str) -> DataFrame:
        return table.join(place, F.col(node) == F.col("_node"), "left").withColumn("component", F.coalesce("_component", node)).drop("_node", "_component")

    spread = stored(placed(members, "node"), "join-placed")
    # a group that isn't whole in one component counts as mixed
    whole = spread.groupBy("gid").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"))
    whole = stored(whole, "join-whole").withColumnRenamed("gid", "_gid")
    rest = entries.select("token", "gid", "n", "i", "indexed").join(whole, F.col("gid") == F.col("_gid")).drop("_gid")
    rest = stored(rest, "join-rest")
    mixed = rest.groupBy("token").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select(F.col("token").alias("_token"))
    rest = stored(rest.join(mixed, F.col("token") == F.col("_token"), "left_semi"), "join-mixed")
    again = None
    if not rest.isEmpty():
        other = rest.select("token", *[F.col(c).alias(f"o_{c}") for c in ("gid", "n", "i", "indexed", "low", "high")])
        apart = (F.col("low") != F.col("o_low")) | (F.col("low") != F.col("high")) | (F.col("o_low") != F.col("o_high"))
        met = rest.join(other, "token").where((F.col("gid") < F.col("o_gid")) & apart & (F.col("indexed") | F.col("o_indexed")) & _possible(F.col("n"), F.col("i"), F.col("o_n"), F.col("o_i"), percent))
        met = stored(met.select("gid", "o_gid").distinct(), "join-met")
        left, right = spread.select(F.col("gid").alias("_g1"), F.col("node").alias("a"), F.col("component").alias("c1")), spread.select(F.col("gid").alias("_g2"), F.col("node").alias("b"), F.col("component").alias("c2"))
        again = met.join(left, F.col("gid") == F.col("_g1")).join(right, F.col("o_gid") == F.col("_g2")).where("c1 <> c2").select("a", "b")
    loose = whole.where("low <> high").select("_gid")
    if not loose.isEmpty():
        own = stored(spread.join(loose, F.col("gid") == F.col("_gid"), "left_semi"), "join-loose")
        pairs = own.select("gid", F.col("node").alias("a"), F.col("component").alias("c1")).join(own.select(F.col("gid").alias("_g"), F.col("node").alias("b"), F.col("component").alias("c2")), (F.col("gid") == F.col("_g")) & (F.col("a") < F.col("b")) & (F.col("c1") != F.col("c2"))).select("a", "b")
        again = pairs if again is None else again.union(pairs)
    if again is not None:
        again = stored(again.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "join-again")
        again = again.join(tried.select(F.least("a", "b").alias("_a"), F.greatest("a", "b").alias("_b")), (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left_anti")
        again = stored(again, "join-untried")
        if not again.isEmpty():
            more = verified(docs, plausible(signed, again, percent), classes, width, percent)
            if not more.isEmpty():
                found = components(links.union(more))

    of = nodes.join(found.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select(*[F.col(k).alias(f"_{k}") for k in key], F.coalesce("component", "node").alias("component"))
    of = stored(of, "join-components")
    out = signed.select("doc_id", *key).join(of, [F.col(k) == F.col(f"_{k}") for k in key], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """``docs`` with one document of each component, the one with the least id; rows without an id stay.

    Of rows with equal id and text one stays.
    """
    found = stored(join(docs, width, percent).where("doc_id is not null"), "join-result")
    ids = found.groupBy("doc_id").agg(F.max((F.col("doc_id") == F.col("component_id")).cast("int")).alias("stays"), F.count("*").alias("times"))
    other = carried(docs)
    ids = stored(ids.where("stays = 0 or times > 1").withColumnRenamed("doc_id", other), "join-gone")
    gone, twice = (_small(ids.where(f"stays = {k}").select(other)) for k in (0, 1))
    key = F.col("doc_id").cast("long") == F.col(other)
    out = docs.join(gone, key, "left_anti")
    if twice.isEmpty():
        return out
    again = out.join(twice, key, "left_semi").dropDuplicates(["doc_id", "text"])
    return out.join(twice, key, "left_anti").unionByName(again)


#: DuckDB equivalent for ``join(documents)``: every pair that shares a shingle, then components.
ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_distinct([array_to_string(list_slice(words, i, i + 3), ' ') FOR i IN generate_series(1, len(words) - 3)]) END AS shingles
  FROM words
), items AS (
  SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM sets
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS common
  FROM items a JOIN items b ON a.shingle = b.shingle AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
), links AS (
  SELECT a, b FROM shared WHERE 100 * common >= 85 * (na + nb - common)
  UNION ALL SELECT b, a FROM shared WHERE 100 * common >= 85 * (na + nb - common)
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sets
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a
)
SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, min(r.other) AS component_id
FROM sets s JOIN reach r ON s.doc_id = r.doc_id
GROUP BY s.doc_id, s.shingles"""
