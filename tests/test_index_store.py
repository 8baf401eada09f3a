"""The written index: segments, tombstones, compaction, skipped blocks; tables that batches are merged into."""

from __future__ import annotations

import math
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from sutrapath.operators import index, ranks, search, segments
from sutrapath.sources import manifest
from sutrapath.streaming import ingest
from sutrapath.streaming.keyed import KeyedTable

POSTINGS = "term string, page_id long, tf long"


def made(spark, seed, ids, words=60):
    """Postings of pages of few words, frequent ones in most pages; some words begin with others."""
    draw, rows = random.Random(seed), []
    for page in ids:
        counts = {}
        for _ in range(draw.randrange(1, 25)):
            word = "w" + str(min(words - 1, int(draw.paretovariate(0.6))))
            counts[word] = counts.get(word, 0) + 1
        rows += [(w, page, n) for w, n in counts.items()]
    postings = spark.createDataFrame(rows, POSTINGS)
    return segments.documents_of(postings, spark.createDataFrame([(i,) for i in ids], "page_id long")), postings


def held(postings):
    return {(r["term"], r["page_id"], r["tf"]) for r in postings.select("term", "page_id", "tf").collect()}


def by_hand(rows, pages, clusters, prefix, most=None, every=False):
    """BM25 of each query term over (term, page, tf), as plain loops."""
    lengths = dict.fromkeys(pages, 0)
    for _, page, tf in rows:
        lengths[page] += tf
    average = sum(lengths.values()) / len(lengths)
    score, hit = dict.fromkeys(pages, 0.0), {p: set() for p in pages}
    for c, terms in enumerate(clusters):
        for t in terms:
            tfs = {}
            for term, page, tf in rows:
                if term.startswith(t) if prefix else term == t:
                    tfs[page] = tfs.get(page, 0) + tf
            weight = max(math.log((len(pages) - len(tfs) + 0.5) / (len(tfs) + 0.5)), 1e-6)
            for page, tf in tfs.items():
                score[page] += weight * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * lengths[page] / average))
                hit[page].add(c)
    found = [(p, len(hit[p]), round(score[p], 6)) for p in pages if hit[p] and (not every or len(hit[p]) == len(clusters))]
    return sorted(found, key=lambda r: (-r[2], r[0]))[:most]


def agree(frame, wanted):
    got = sorted(((r["doc_id"], r["clusters_hit"], r["bm25"]) for r in frame.collect()), key=lambda r: (-r[2], r[0]))
    assert [r[:2] for r in got] == [r[:2] for r in wanted] and all(abs(a[2] - b[2]) < 1.5e-6 for a, b in zip(got, wanted, strict=True))


QUERIES = [[["w1", "w2"], ["w3"]], [["w10"], ["w7"]], [["nothing"], ["w5"]]]


def test_segments_equal_a_new_index(spark, tmp_path):
    """Base, two segments with changed pages, removed ones: as if built anew; compaction changes no answer and only crowded buckets."""
    path = str(tmp_path / "index")
    store = segments.Store.create(*made(spark, 1, range(300)), path)
    store = store.add(*made(spark, 2, range(250, 330)))
    store = store.add(*made(spark, 3, [0, 1, 2, 500]), removed=spark.createDataFrame([(7,), (9999,)], "page_id long"))
    first, second, third = made(spark, 1, range(300))[1], made(spark, 2, range(250, 330))[1], made(spark, 3, [0, 1, 2, 500])[1]
    rows = {r for r in held(first) if r[1] < 250 and r[1] not in (0, 1, 2, 7)} | held(second) | held(third)
    pages = [i for i in [*range(330), 500] if i != 7]

    def same(index, queries=QUERIES[:1]):
        assert held(index.live_postings()) == rows
        assert index.state["n"] == len(pages) == index.documents().count() and index.state["words"] == sum(r[2] for r in rows)
        for n, clusters in enumerate(queries):
            agree(index.matches(clusters, n % 2 == 0), by_hand(rows, pages, clusters, n % 2 == 0))
            agree(index.best(clusters, 20, n % 2 == 1), by_hand(rows, pages, clusters, True, 20, n % 2 == 1))

    same(segments.Store.open(spark, path), QUERIES)
    files = {b: sorted(p for p in store.postings([b]).inputFiles()) for b in range(16)}
    held_by = {b: store.holders(b) for b in range(16)}
    small = store.compact(3)
    crowded = [b for b in range(16) if len(held_by[b]) >= 3]
    assert crowded and all(len(small.holders(b)) <= 1 for b in crowded)
    assert all(sorted(small.postings([b]).inputFiles()) == files[b] for b in range(16) if b not in crowded)
    same(small)
    # one segment for all: no tombstone is left, and older files go
    one = small.compact(2).compact(2)
    same(one)
    again = one.add(*made(spark, 3, [0, 1, 2, 500])).compact(2)
    same(again)
    again.vacuum()
    same(segments.Store.open(spark, path))
    assert len(manifest.versions(spark, path)) == manifest.KEPT
    assert len(os.listdir(tmp_path / "index" / "dictionary")) < again.state["next"]


def test_blocks_are_skipped(spark, tmp_path):
    """The best pages of terms with many blocks are those of a full read, though most blocks aren't read."""
    draw, rows = random.Random(4), []
    for page in range(6000):
        rows.append(("common", page, 1 + (page % 97 == 0) * 9))
        if page % 3 == 0:
            rows.append(("third", page, 1 + page % 2))
        if page % 40 == 0:
            rows.append(("rare", page, 1 + page % 5))
        rows += [(f"x{draw.randrange(500)}", page, 1 + draw.randrange(6)) for _ in range(draw.randrange(1, 6))]
    rows = list({(t, p): (t, p, n) for t, p, n in rows}.values())
    postings = spark.createDataFrame(rows, POSTINGS)
    store = segments.Store.create(segments.documents_of(postings), postings, str(tmp_path / "index"))
    pages = list(range(6000))
    for clusters, every in (([["rare"], ["third"]], False), ([["third"]], False), ([["third"]], True)):
        terms = [t for c in clusters for t in c]
        agree(store.best(clusters, 30, every, False), by_hand(rows, pages, clusters, False, 30, every))
        matched = store.matched(terms, False)
        chosen = store.promising(matched, clusters, store.frequencies(matched, terms, False), False, 30, every)
        assert chosen is not None and chosen.count() < matched.where("block >= 0").count()
    # retrieval is that over the texts
    plan = store.postings([3])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]


def test_retrieval_equals_that_over_texts(spark, small_docs, tmp_path):
    postings = search.postings(small_docs).withColumnRenamed("doc_id", "page_id")
    store = segments.Store.create(segments.documents_of(postings, small_docs.select(F.col("doc_id").alias("page_id"))), postings, str(tmp_path / "index"))
    for clusters in ([["erthi", "thing"], ["anin", "onat"]], [["zzqqx"], ["anin"]], [["the"]]):
        key = lambda r: (r["doc_id"], r["level"], r["clusters_hit"], round(r["bm25"], 5))
        assert sorted(map(key, store.retrieve(clusters).collect())) == sorted(map(key, search.retrieve(small_docs, clusters).collect()))


def test_empty_index(spark, tmp_path):
    none = spark.createDataFrame([], POSTINGS)
    store = segments.Store.create(segments.documents_of(none), none, str(tmp_path / "index"))
    assert store.best([["a"]]).count() == 0 and store.matches([["a"]]).count() == 0
    store = store.add(*made(spark, 1, [1, 2]))
    assert store.documents().count() == 2
    with pytest.raises(ValueError, match="already"):
        segments.Store.create(segments.documents_of(none), none, str(tmp_path / "index"))


def test_two_writers(spark, tmp_path):
    store = segments.Store.create(*made(spark, 1, range(5)), str(tmp_path / "index"))
    store.add(*made(spark, 2, [9]))
    with pytest.raises(RuntimeError, match="another writer"):
        store.add(*made(spark, 3, [10]))


# --- ranks ---------------------------------------------------------------------------------------------------


def test_ranks_and_running_sums(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 7).alias("k"), (F.col("id") * 7919 % 3001).alias("v"), (F.col("id") % 5).alias("cost"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ranks.numbered(rows, ["k"], [F.col("v").desc()], "at", "total", {"spent": "cost"}).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    wanted, groups = [], {}
    for r in rows.collect():
        groups.setdefault(r["k"], []).append((r["v"], r["cost"]))
    for k, values in groups.items():
        spent = 0
        for i, (v, cost) in enumerate(sorted(values, reverse=True)):
            spent += cost
            wanted.append((k, v, i, len(values), spent))
    assert sorted(((r["k"], r["v"], r["at"], r["total"], r["spent"]) for r in got), key=repr) == sorted(wanted, key=repr)


# --- tables by key, streams ----------------------------------------------------------------------------------


def last(batch, known):
    rows = batch if known is None else batch.unionByName(known)
    return rows.groupBy("k").agg(F.max("v").alias("v"))


def test_keyed_table(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], 8)
    batch = lambda *rows: spark.createDataFrame(rows, "k string, v long")
    state = lambda: {r["k"]: r["v"] for r in table.read().collect()}
    assert table.read() is None
    table.merge(batch(*[(f"k{i}", i) for i in range(40)]), 0, last)
    before = table.state()["held"]
    touched = table.merge(batch(("k1", 100), ("new", 7)), 1, last)
    assert state()["k1"] == 100 and state()["new"] == 7 and len(state()) == 41
    assert {b for b, v in table.state()["held"].items() if before.get(b) != v} == {str(b) for b in touched} and len(touched) <= 2
    assert sorted((r["k"], r["v"]) for r in table.changes(1).collect()) == [("k1", 100), ("new", 7)]
    # a batch that comes again changes nothing; folders that no kept version names go
    assert table.merge(batch(("k1", 999)), 1, last) == [] and state()["k1"] == 100
    for n in range(2, 6):
        table.merge(batch(*[(f"k{i}", 1000 * n + i) for i in range(40)]), n, last)
    assert len(manifest.versions(spark, table.path)) == 2 and len(os.listdir(tmp_path / "t" / "data")) <= 3
    assert state()["k39"] == 5039
    assert table.merge(batch(), 6, last) == [] and table.changes(6) is None and len(state()) == 41


ITEMS = "url string, title string, published_at timestamp"


def items(spark, *rows):
    return spark.createDataFrame(rows, "url string, title string, at string").select("url", "title", F.col("at").cast("timestamp").alias("published_at"))


def test_feeds_reach_the_index_once(spark, tmp_path):
    """Batches of feed items: new pages and filled titles are found, titled pages stay; a lost writer's batch is made good."""
    source, pages_path, index_path = (str(tmp_path / n) for n in ("in", "pages", "index"))
    items(spark, ("https://a.in/x", "", "2026-10-01"), ("https://a.in/kanda-bhav", "कांदा बाजारभाव आज", "2026-10-01"), ("https://a.in/x", None, "2026-10-02")).write.parquet(source)
    run = lambda: ingest.live_index(ingest.feed_stream(spark, source, spark.read.parquet(source).schema), pages_path, index_path, str(tmp_path / "check"), buckets=4)
    run()
    pages = KeyedTable(spark, pages_path, ["url"])
    titles = lambda: {r["url"]: r["title"] for r in pages.read().collect()}
    assert titles() == {"https://a.in/x": None, "https://a.in/kanda-bhav": "कांदा बाजारभाव आज"}
    items(spark, ("https://a.in/x", "demat account", "2026-10-03"), ("https://a.in/kanda-bhav", "other", "2026-10-03"), ("https://b.in/new", "demat news", "2026-10-03")).write.mode("append").parquet(source)
    run()
    run()  # nothing new
    assert titles() == {"https://a.in/x": "demat account", "https://a.in/kanda-bhav": "कांदा बाजारभाव आज", "https://b.in/new": "demat news"}
    store = segments.Store.open(spark, index_path)
    assert store.matches([["demat"]]).count() == 2 and store.matches([["kanda"]]).count() == 1
    built = index.build(pages.read())
    assert held(store.live_postings()) == held(built.postings)
    # the pages took batch 2, the index was lost before it did
    batch = items(spark, ("https://c.in/late", "demat late", "2026-10-04"))
    pages.merge(ingest.fresh_pages(batch), 2, ingest.merge_pages)
    ingest.refresh(batch, 2, pages, index_path)
    ingest.refresh(batch, 2, pages, index_path)
    store = segments.Store.open(spark, index_path)
    assert store.matches([["demat"]]).count() == 3 and held(store.live_postings()) == held(index.build(pages.read()).postings)


def test_ingest_by_time(spark, tmp_path):
    """With a processing-time trigger the query polls until it is stopped."""
    source = str(tmp_path / "in")
    rows = lambda *r: spark.createDataFrame(r, "k string, v long")
    rows(("a", 1)).write.parquet(source)
    query = ingest.ingest(ingest.feed_stream(spark, source, spark.read.parquet(source).schema), str(tmp_path / "t"), str(tmp_path / "check"), last, ["k"], every="1 second", buckets=4)
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"])
    try:
        for n, more in ((1, [("b", 2)]), (2, [])):
            for _ in range(120):
                found = table.read()
                if found is not None and found.count() == n:
                    break
                time.sleep(0.5)
            assert table.read().count() == n
            if more:
                rows(*more).write.mode("append").parquet(source)
    finally:
        query.stop()


def test_counted_words_are_an_index(spark, small_docs, tmp_path):
    """Words counted row by row are those of the postings; the index needs nothing else, and its blocks of a term go from high impact to low."""
    more = spark.createDataFrame([(-1, None), (-2, ""), (-3, "a b a")], "doc_id long, text string")
    docs = small_docs.select("doc_id", "text").unionByName(more)
    counted = search.counted(docs)
    store = segments.Store.create(counted, None, str(tmp_path / "index"))
    assert held(store.live_postings()) == {(r["term"], r["doc_id"], r["tf"]) for r in search.postings(docs).collect()}
    assert {(r["page_id"], r["dl"]) for r in counted.where("page_id < 0").collect()} == {(-1, 0), (-2, 0), (-3, 3)} and store.state["n"] == docs.count()
    last = {}
    for r in sorted(store.postings(list(range(16))).collect(), key=lambda r: (r["term"], r["block"])):
        worth = [tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / store.average)) for tf, dl in zip(r["tfs"], r["dls"], strict=True)]
        assert len(worth) <= segments.BLOCK and worth[0] <= last.get(r["term"], 9.0) + 1e-3
        last[r["term"]] = worth[-1]
    assert sum(r["n"] for r in store.dictionary().collect()) == search.postings(docs).count()
    # a second segment and a compaction from documents alone
    again = store.add(search.counted(more.where("doc_id = -3").withColumn("text", F.lit("c c")))).compact(2)
    assert held(again.live_postings().where("page_id = -3")) == {("c", -3, 2)} and again.documents().count() == docs.count()
