from __future__ import annotations

import collections
import os
import re

import corpus_pipeline
from sutrapath.llm.common import shared_dir, stored
from tests.llm.test_documents import check_packing, targets


def test_stages(spark, small):
    docs, kept = small, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, "/root/testdata/sf0.001"), "test")
        assert out.columns == small.columns
        kept[name], docs = out, out
    before = {r["doc_id"]: r["text"] for r in small.collect()}
    for name in ("language_id", "quality", "ngram_join"):
        assert all(before[r["doc_id"]] == r["text"] for r in kept[name].collect())
    assert kept["quality"].count() <= kept["language_id"].count() <= small.count()
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    rows = kept["ngram_join"].collect()
    want, got, largest = targets(collections.Counter(r["source"] for r in rows for _ in range(size(r)))), collections.Counter(), collections.Counter()
    for r in kept["mixing"].collect():
        assert before[r["doc_id"]] == r["text"]
        got[r["source"]] += size(r)
    for r in rows:
        largest[r["source"]] = max(largest[r["source"]], size(r))
    assert all(abs(want[s] - got[s]) <= largest[s] / 2 + 1 for s in want)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in docs.collect()}


def test_near_duplicates_leave_one(spark, small):
    from tests.llm.test_documents import linked

    docs = [(r["doc_id"], r["text"]) for r in small.collect()]
    want = {i for i, (_, c) in linked(docs, 5, 80).items() if i == c}
    assert {r["doc_id"] for r in corpus_pipeline.unlike(spark, small, "").collect()} == want


def test_odd_rows_by_stage(spark, odd):
    """Nulls, texts without letters, repeated rows, very long texts and clashing columns, through every stage."""
    docs, ids = odd, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, "/root/testdata/sf0.001"), "test")
        assert docs.columns == odd.columns
        ids[name] = collections.Counter(r["doc_id"] for r in docs.collect())
    every = collections.Counter(r["doc_id"] for r in odd.collect())
    assert ids["language_id"] == {i: n for i, n in every.items() if i not in (3, 4, 5, 6)}  # without letters
    assert ids["quality"] <= ids["language_id"]
    assert set(ids["ngram_join"]) == set(ids["quality"]) - {2} and ids["ngram_join"][7] == 1  # 2 is 1 again
    assert set(ids["mixing"]) <= set(ids["ngram_join"]) and max(ids["mixing"].values()) <= 3
    texts = collections.defaultdict(list)
    for r in docs.collect():
        texts[r["doc_id"]].append(r["text"])
    check_packing(texts, corpus_pipeline.packed(spark, docs, "").collect())


def test_empty_table(spark, none):
    docs = none
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, "/root/testdata/sf0.001"), "test")
        assert docs.count() == 0


def test_run_leaves_no_tables_of_stages(spark):
    """What stages store goes with them; the table that the last one reads stays."""
    held = lambda: {p for p in os.listdir(shared_dir(spark)) if p.startswith("sutrapath-")}
    before = held()
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {p.rsplit("-", 1)[0] for p in held() - before} == {"sutrapath-pipeline-mixing", "sutrapath-pieces"} and out.count() > 0
