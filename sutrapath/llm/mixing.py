"""Mixing sources to target weights.

Method.  Each source's documents are dealt by hash into blocks of bounded size.  A source takes its
target in words as whole passes over its blocks and then further blocks in a permuted order; of the
last block it takes documents in hash order, up to the one that comes nearest to the target.  How many
blocks it draws so is its exact quota.  A splitting tree partitions the quotas among the output shards:
at each node the quotas of all sources are split between the left and the right half of the shards by
one multivariate-hypergeometric draw.  A shard then draws its quota of blocks: the draws of a source
are in a permuted order, and each shard takes the next run of it, so no draw is in two shards.  A
document is in the mix as often as shards have drawn it: ``taken`` is its size for each of those shards.
Within a shard copies are shuffled by a hash of their own (``mixed_documents`` lays them out so).

The tree is worked out on the driver, over at most ``STRATA`` quotas: sources are dealt by hash over
strata, a stratum's quota is that of all its sources, and its draws are permuted together, which
shares them among its sources as draws of the tree would.  Ranks and running sums have two levels, over
ranges of the permuting hash and within one, so no source is one task.

Defined results
* sizes are words, 0 for null or empty texts; a source without words has target 0 and takes nothing;
* a null source is a source of its own, last in order;
* documents are taken whole, so a source misses its target by half a document at most;
* rows with equal doc_id and size in one source are drawn alike, as often as each other;
* reruns agree: all choices come from hashes of ids and a seed;
* no rows: no rows.  Other columns are neither read nor needed.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, word_count

MOST_REPEATS = 3
#: Quotas that the tree splits at most; leading bits of a hash by which ranks and running sums are worked out first.
STRATA, CHUNK_BITS = 4096, 12
#: numpy draws from populations below this size.
NUMPY_POPULATION = 1_000_000_000


def _numbered(sources: DataFrame) -> DataFrame:
    """Adds ``nth``, from 0, by source (code points, null last): places within range partitions, after the rows of those before."""
    parts = stored(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id()), "mix-numbered")
    before = Window.partitionBy().orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    offsets = parts.groupBy(F.col("_part").alias("_p")).agg(F.count("*").alias("_rows")).select("_p", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last()))
    return parts.withColumn("_own", own).join(F.broadcast(offsets), F.col("_part") == F.col("_p")).withColumn("nth", F.col("_own") + F.col("_offset") - 1).drop("_part", "_p", "_rows", "_own", "_offset")


def targets(sources: DataFrame, most: int = MOST_REPEATS) -> DataFrame:
    """Adds ``weight`` and ``target`` to (source, source_size, ...): shares by weight 1, 2, 3, ... of all words, stopped at ``most`` times the size.

    The excess of stopped sources goes to the others by weight, until none is above: a round is one aggregate.
    """
    weighed = stored(_numbered(sources).withColumn("weight", (F.col("nth") % 3 + 1).cast("long")).drop("nth"), "mix-weighed")
    stop, level, stopped = most * F.col("source_size"), 0.0, -1
    while True:
        over = stop < F.lit(level) * F.col("weight")
        row = weighed.agg(F.sum("source_size").alias("words"), F.count_if(over).alias("stopped"), F.sum(F.when(over, stop).otherwise(0)).alias("held"), F.sum(F.when(over, 0).otherwise(F.col("weight"))).alias("weights")).first()
        if row["stopped"] == stopped or not row["weights"]:
            break
        stopped, level = row["stopped"], (row["words"] - row["held"]) / row["weights"]
    return weighed.withColumn("target", F.least(stop.cast("double"), F.lit(level) * F.col("weight")))


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many of ``sample`` draws without return are good, for populations of any size.

    Beyond numpy's limit by inversion: probabilities follow from that of the mode by their exact ratios,
    over the range outside which they vanish in double precision.
    """
    if good + bad < NUMPY_POPULATION:
        return int(rng.hypergeometric(good, bad, sample))
    low, high = max(0, sample - bad), min(good, sample)
    mode = min(high, max(low, (sample + 1) * (good + 1) // (good + bad + 2)))
    share = good / (good + bad)
    reach = int(40 * math.sqrt(sample * share * (1 - share) * (good + bad - sample) / (good + bad - 1)) + 100)
    low, high = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(low, high, dtype=np.float64)
    ratio = np.log(good - k) + np.log(sample - k) - np.log(k + 1) - np.log(bad - sample + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(ratio)])
    upto = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(upto, rng.random() * upto[-1], side="right"))


def split_quotas(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """(shards, quotas): the splitting tree over exact quotas; shards get equal totals to within one draw a level."""
    rng, out = np.random.default_rng(seed), np.zeros((shards, len(quotas)), dtype=np.int64)
    todo = [(0, shards, [int(q) for q in quotas])]
    while todo:
        lo, hi, left = todo.pop()
        if hi - lo == 1:
            out[lo] = left
            continue
        middle, rest = (lo + hi) // 2, sum(left)
        share = rest * (middle - lo) // (hi - lo)
        drawn = []
        for quota in left:
            rest -= quota
            drawn.append(hypergeometric(rng, quota, rest, share) if quota and share else 0)
            share -= drawn[-1]
        todo += [(lo, middle, drawn), (middle, hi, [q - d for q, d in zip(left, drawn, strict=True)])]
    return out


def _hash(seed: int, *columns: str | Column) -> Column:
    return F.xxhash64(*columns, F.lit(seed))


def _chunk(order: str) -> Column:
    return F.shiftright(F.col(order), 64 - CHUNK_BITS).cast("int")


def _running(rows: DataFrame, key: list[str], order: str, value: str, ties: list[str]) -> DataFrame:
    """Adds ``upto``, the sum of ``value`` over the rows of ``key`` up to this one, by the hash ``order``: over chunks of it, then within."""
    rows = rows.withColumn("_chunk", _chunk(order))
    sums = rows.groupBy(*key, "_chunk").agg(F.sum(value).alias("_words"))
    before = Window.partitionBy(*key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)  # 2^CHUNK_BITS rows at most
    sums = sums.withColumn("_before", F.coalesce(F.sum("_words").over(before), F.lit(0))).drop("_words")
    own = Window.partitionBy(*key, "_chunk").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    named = sums.withColumnsRenamed({k: f"_{k}" for k in key} | {"_chunk": "_c"})
    same = F.col("_chunk") == F.col("_c")
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.withColumn("_own", F.sum(value).over(own)).join(named, same).withColumn("upto", F.col("_own") + F.col("_before")).drop("_chunk", "_own", "_before", "_c", *[f"_{k}" for k in key])


def mix(docs: DataFrame, shards: int = 16, block_docs: int = 512, most: int = MOST_REPEATS, seed: int = 5, tree_seed: int = 5, rows: DataFrame | None = None) -> DataFrame:
    """The operator: every document with size, source_size, target, ``shards``, those that have drawn it, and taken, its words in all of them.

    ``rows`` (doc_id, source, size and others), where given, are the same documents with columns that stay.
    """
    spark = docs.sparkSession
    sizes = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    sources = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")), most)
    sources = (
        sources.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("docs") / block_docs)))
        .withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("rest", F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long"))
    )
    sources = stored(sources.select("source", "source_size", "target", "blocks", "passes", "rest"), "mix-sources")

    def place(rows: DataFrame) -> DataFrame:
        own = sources.select(F.col("source").alias("_source"), "source_size", "target", "blocks", "passes", "rest")
        rows = rows.join(own, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        return rows.withColumn("block", F.pmod(_hash(seed, "doc_id", "size"), F.col("blocks"))).withColumn("order", _hash(seed + 1, "doc_id", "size"))

    # quotas: passes over all blocks, and blocks in permuted order until the rest is met
    placed = place(sizes)
    blocks = placed.groupBy("source", "block").agg(F.sum("size").alias("words"), F.first("passes").alias("passes"), F.first("rest").alias("rest")).withColumn("permuted", _hash(seed + 2, "source", "block"))
    blocks = (
        _running(blocks, ["source"], "permuted", "words", ["block"])
        .withColumn("room", F.col("rest") - F.col("upto") + F.col("words"))
        .withColumn("draws", (F.col("passes") + (F.col("room") > 0).cast("int")).cast("long"))
        .withColumn("part", F.col("room").between(F.lit(1), F.col("words") - 1))
        .withColumn("stratum", F.pmod(_hash(seed + 3, "source"), F.lit(STRATA)).cast("int"))
    )
    blocks = stored(blocks.select("source", "stratum", "block", "words", "room", "draws", "part"), "mix-blocks")

    # the last block of a source: documents in hash order, as many as come nearest to its room
    last = blocks.where("part").select(F.col("source").alias("_source"), F.col("block").alias("_block"), F.col("room").alias("_room"))
    inside = placed.select("source", "block", "order", "size").join(last, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block")))
    inside = inside.groupBy("source", "block", "order", "_room").agg(F.sum("size").alias("words"))
    inside = inside.withColumn("upto", F.sum("words").over(Window.partitionBy("source", "block").orderBy("order").rowsBetween(Window.unboundedPreceding, 0)))
    cut = inside.where(F.col("upto") - F.col("words") / 2 <= F.col("_room")).groupBy("source", "block").agg(F.max("order").alias("cut"))

    # the tree shares the quotas among shards; each shard draws the next run of a stratum's permuted draws
    quotas = blocks.groupBy("stratum").agg(F.sum("draws").alias("draws")).orderBy("stratum").collect()  # STRATA rows at most
    upto = split_quotas([r["draws"] for r in quotas], shards, tree_seed).cumsum(0).T.tolist()
    runs = spark.createDataFrame([(r["stratum"], u) for r, u in zip(quotas, upto, strict=True)], "_s int, runs array<long>")
    drawn = blocks.where("draws > 0").select("source", "stratum", "block", "part", "draws", F.explode(F.sequence(F.lit(1).cast("long"), F.col("draws"))).alias("nth"))
    drawn = drawn.withColumn("permuted", _hash(seed + 4, "source", "block", "nth")).withColumn("one", F.lit(1).cast("long"))
    drawn = _running(drawn, ["stratum"], "permuted", "one", ["source", "block", "nth"]).join(F.broadcast(runs), F.col("stratum") == F.col("_s"))
    # a source's last draw is the one in part
    draw = F.struct((F.col("part") & (F.col("nth") == F.col("draws"))).alias("part"), "nth", F.size(F.filter("runs", lambda u: u < F.col("upto"))).alias("shard"))
    plan = drawn.groupBy("source", "block").agg(F.sort_array(F.collect_list(draw)).alias("drawn"))  # ``most`` draws at most
    plan = plan.withColumnsRenamed({"source": "_source", "block": "_block"}).join(cut.withColumnsRenamed({"source": "_s2", "block": "_b2"}), F.col("_source").eqNullSafe(F.col("_s2")) & (F.col("_block") == F.col("_b2")), "left").drop("_s2", "_b2")
    plan = stored(plan, "mix-plan")
    out = placed if rows is None else place(rows)
    out = out.join(plan, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block")), "left")
    held = F.coalesce(F.transform(F.filter("drawn", lambda d: ~d["part"] | F.coalesce(F.col("order") <= F.col("cut"), F.lit(False))), lambda d: d["shard"]), F.array().cast("array<int>"))
    more = [] if rows is None else [c for c in rows.columns if c not in ("doc_id", "source", "size")]
    out = out.withColumn("shards", held)
    return out.select("doc_id", "source", "size", *more, "source_size", "target", (F.size("shards") * F.col("size")).cast("long").alias("taken"), "shards")


def mixed_documents(docs: DataFrame, shards: int = 16, piece_bytes: int = 24 << 20, most_pieces: int = 100_000, seed: int = 5) -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document whole, once for each shard that has drawn it.

    Shards are cut by hash into parts, of which some make a partition of about ``piece_bytes`` of text, with ``most_pieces``
    partitions at most; copies within one are in the order of the shard and of a hash of shard, document and
    copy.  Documents without words are in no shard's mix.
    """
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.struct(*docs.columns).alias("_row"))
    out = mix(docs, shards, seed=seed, rows=rows).where("size > 0").select("_row", "source_size", F.posexplode("shards").alias("_copy", "_shard"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    pieces = min(most_pieces, -(-size // piece_bytes) or 1)
    out = out.withColumn("_order", _hash(seed + 5, "_shard", "_copy", "_row.doc_id", F.xxhash64("_row.text")))
    part = F.pmod("_order", F.lit(-(-8 * pieces // shards)))  # several parts in each partition, so that they are alike in size
    out = out.repartition(pieces, F.col("_shard"), part).sortWithinPartitions("_shard", "_order")
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
