"""Merkle manifest, sharding, ranked search: brute force over whole tables, and odd rows."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sutrapath.llm import common, lexical, merkle, sharding


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lowered(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def first_null(value):
    return (value is not None, value if value is not None else 0)


def leaf_of(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def walk(tree, i):
    """(left, right) of each level from node i up."""
    for nodes in tree[:-1]:
        first = i - i % 16
        yield nodes[first:i], nodes[i + 1 : first + 16]
        i //= 16


def manifest_by_hand(rows):
    sources = collections.defaultdict(list)
    for r in rows:
        sources[r["source"]].append((leaf_of(r, r["text"]), r))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        sources[name].sort(key=lambda x: (first_null(x[1]["doc_id"]), x[0]))
        trees[name] = levels([leaf for leaf, _ in sources[name]])
    top = levels([trees[name][-1][0] for name in names])
    out = []
    for k, name in enumerate(names):
        for i, (leaf, r) in enumerate(sources[name]):
            path = [*walk(trees[name], i), *walk(top, k)]
            touched = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
            node = leaf_of(r, lowered(r["text"])) if touched else leaf
            for left, right in path:
                node = h("".join([*left, node, *right]))
            out.append((r["doc_id"], leaf, trees[name][-1][0], top[-1][0], h("".join("".join(a + b) for a, b in path)), node, node == top[-1][0]))
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_manifest_odd_rows(odd, none):
    got = merkle.attested(odd)
    assert ordered(got.collect()) == ordered(manifest_by_hand(odd.collect()))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert merkle.attested(none).count() == 0
    lone = odd.where("doc_id = 12")
    (row,) = merkle.attested(lone).collect()
    assert row["leaf"] == row["subroot"] == row["root"] and row["proof_sha256"] == h("")


@pytest.mark.parametrize("sizes", [(1, 16, 17), (255, 256, 257), (4097, 2, 1), tuple([1] * 300)])
def test_manifest_shapes(spark, sizes):
    """Sources of sizes around those of runs and blocks, more sources than a block holds, one with most rows."""
    rows = [(100_000 * s + i, f"Text {i % 7}", "en", f"s{s:03}", i) for s, n in enumerate(sizes) for i in range(n)]
    random.Random(5).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert ordered(merkle.attested(docs).collect()) == ordered(manifest_by_hand(docs.collect()))


def test_paths_fold_to_the_root(small):
    rows = small.select("doc_id", "source", merkle.leaf({c: F.col(c) for c in merkle.FIELDS}).alias("node"))
    tree = merkle.manifest(rows)
    shown = merkle.proofs(tree).withColumn("again", merkle.folded(F.col("leaf"), F.col("path"))).withColumn("other", merkle.folded(merkle.digest(F.col("leaf")), F.col("path")))
    assert shown.count() == small.count() and shown.where("again <> root or other = root").count() == 0


def test_numbered_without_a_task_for_a_key(spark):
    """One key with nearly all rows lies in several partitions, and its places are gapless."""
    rows = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.col("id").cast("string")).alias("k"), (F.col("id") * 7919 % 20_011).alias("v"))
    with common.settings(spark, {"spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        got = common.numbered(rows, ["k"], ["v"], "at", "total", "test-numbered")
    hot = got.where("k is null").orderBy("v").collect()
    assert [r["at"] for r in hot] == list(range(18_000)) and {r["total"] for r in hot} == {18_000}
    assert got.where("k is not null and (at <> 0 or total <> 1)").count() == 0
    assert len(got.inputFiles()) > 2


# --- sharding ------------------------------------------------------------------------------------


def check_shards(docs, got, shards=40):
    rows, by_id = got.collect(), collections.Counter()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    slots, groups, loads = collections.defaultdict(list), {}, [0] * shards
    for r in rows:
        text = texts[r["doc_id"]]
        assert r["size"] == len((text or "").encode()) + 16 and r["law"] == "bytes" and r["grown_shard"] is None
        assert r["text_crc32"] == (None if text is None else zlib.crc32(text.encode()))
        assert groups.setdefault(text, r["shard"]) == r["shard"]
        slots[r["shard"]].append(r["slot"])
        loads[r["shard"]] += r["size"]
        by_id[r["doc_id"]] += 1
    assert by_id == collections.Counter(r["doc_id"] for r in docs.collect())
    assert all(sorted(s) == list(range(len(s))) and 0 <= k < shards for k, s in slots.items())
    return loads


def test_shards_odd_rows(odd, none):
    loads = check_shards(odd, sharding.shard(odd))
    assert sorted(loads)[-1] == 200_016 and sharding.shard(none).count() == 0


def test_one_schedule_is_the_textbook_one(small):
    """Where every group is large, the shards are those of the plain algorithm."""
    groups = collections.Counter()
    for r in small.collect():
        groups[r["text"]] += len(r["text"].encode()) + 16
    order = sorted(groups, key=lambda t: (-groups[t], hashlib.sha256(t.encode()).digest()))
    loads, chosen = [0] * 40, {}
    for text in order:
        chosen[text] = loads.index(min(loads))
        loads[chosen[text]] += groups[text]
    got = sharding.shard(small).select("doc_id", "shard").collect()
    texts = {r["doc_id"]: r["text"] for r in small.collect()}
    assert all(chosen[texts[r["doc_id"]]] == r["shard"] for r in got)


def test_tasks_share_the_room(spark):
    """A copy in a third of the rows, and other groups scheduled by several tasks: nothing is torn, the others are level."""
    rows = [(i, "copy of one text " * 20 if i % 3 == 0 else f"text {i} " + "x" * (i * 37 % 400)) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    loads = sorted(check_shards(docs, sharding.shard(docs, large=64, task_groups=500)))
    level = sum(loads[:-1]) / 39
    assert loads[-1] == 2000 * (17 * 20 + 16) > 2 * level
    assert loads[0] > 0.97 * level and loads[-2] < 1.03 * level


def test_schedule_and_level():
    assert sharding.schedule([5, 4, 3, 3, 3], [0, 0]) == [0, 1, 1, 0, 1]
    assert sharding.level([10, 0, 0], 8) == 4 and sharding.level([1, 1], 2) == 2 and sharding.level([0, 9], 0) == 0


def test_written_shards(spark, odd, tmp_path):
    sharding.write(odd, str(tmp_path / "shards"), shards=4)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert ordered(back.select(odd.columns).collect()) == ordered(odd.collect())
    assert set(back.columns) - set(odd.columns) == {"_shard_"}  # the rows have a column of the usual name
    assert back.groupBy("text").agg(F.count_distinct("_shard_").alias("n")).where("n > 1").count() == 0


# --- ranked search -------------------------------------------------------------------------------


def ranked_by_hand(docs, queries, most=10):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(t or ""))
    held = [(d, collections.Counter(terms(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    total, words, df = len(held), sum(n for _, _, n in held), collections.Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in queries:
        found = []
        for d, c, n in held:
            m = 10 + 90 * n * total // words
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(found)[:most])]
    return out


def searched(spark, docs, queries, **options):
    left, right = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "item_id long, text string")
    return ordered(lexical.search(left, right, **options).collect())


def test_search_odd_rows(spark, odd, none):
    queries = [(1, "The CAT and the dog, the house"), (2, None), (3, ""), (4, "nothingofthesort"), (5, "word शेती"), (None, "one id"), (1, "Katze")]
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    asked = spark.createDataFrame(queries, "item_id long, text string").withColumn("row", F.lit("clash")).withColumn("term", F.lit(1))
    assert ordered(lexical.search(odd, asked).collect()) == ordered(ranked_by_hand(docs, queries))
    assert lexical.search(none, asked).count() == 0 and lexical.search(odd, asked.limit(0)).count() == 0


def test_search_ties_and_hot_terms(spark):
    """Terms in all documents, in most, and in few; many documents alike, so that ranks are decided by doc_id; fewer than ten found."""
    draw = random.Random(3)
    docs = []
    for i in range(1200):
        text = ["all", *(["most"] if i % 4 else []), *(["third"] * (1 + i % 2) if i % 3 == 0 else [])]
        text += [f"w{int(draw.paretovariate(0.7)) % 300}" for _ in range(draw.randrange(1, 40))]
        docs.append((5000 - i, " ".join(text) if i % 5 else "all most same passage of text"))
    queries = [(q, " ".join(["all", "most", "third", *[f"w{draw.randrange(300)}" for _ in range(q % 9)]])) for q in range(25)]
    queries += [(30, "same passage"), (31, "w299"), (32, "all"), (33, "all most third same passage of text w1 w2 w3")]
    assert searched(spark, docs, queries) == ordered(ranked_by_hand(docs, queries))
    assert searched(spark, docs, queries, most=3) == ordered(ranked_by_hand(docs, queries, 3))
