"""Language identification, quality, language model."""

from __future__ import annotations

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sutrapath.llm import language_id, lm_scoring, quality
from sutrapath.llm.common import Words, word_hashes

SF = "/root/testdata/sf0.01"


def fold(i, n):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n


def test_words_kernel():
    words = Words(pa.array(["  A b\ta\n", None, "", "é B"]), "ascii")
    assert [words.distinct[int(c)].as_py() for c in words.code] == ["a", "b", "a", "é", "b"]
    assert words.starts.tolist() == [0, 3, 3, 3, 5]
    many = pa.array([f"w{i}" for i in range(20_000)] + ["x" * n for n in range(1, 300)])
    assert len(np.unique(word_hashes(many))) == len(many)


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = [r for r in language_id.identify_documents(docs).collect() if r["held_out"]]
    assert len(rows) > 150
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in rows) / len(rows) > 0.98


def test_language_spans(spark):
    sample = [("the house and the dog of the man", "en")] * 5 + [("der Hund und das Haus von dem Mann nicht", "de")] * 5 + [("शेती हवामान आणि बाजार", "mr")]
    model = language_id.train(sample)
    docs = spark.createDataFrame([(1, "the dog and the house of the man der Hund und das Haus von dem Mann"), (2, "शेती बाजार"), (3, "12 !?"), (4, None), (5, "δοκιμή")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language_id.identify(docs, model, penalty=3.0).collect()}
    assert [(s["lang"], s["start"], s["words"]) for s in got[1]["spans"]] == [("en", 0, 8), ("de", 8, 8)]
    assert (got[2]["lang_pred"], got[2]["score"]) == ("mr", 1.0)
    assert all((got[k]["lang_pred"], got[k]["score"]) == ("und", 0.0) for k in (3, 4))
    assert (got[5]["lang_pred"], got[5]["score"]) == ("de", 0.0)  # a script that training never saw


def test_viterbi_is_optimal():
    rng = np.random.default_rng(0)
    scores, starts = rng.normal(0, 2, (40, 3)), np.array([0, 7, 7, 12, 40])
    label = language_id.viterbi(scores, starts, 1.5)
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        best = np.zeros(3)
        for t in range(a, b):
            best = scores[t] + (np.maximum(best, best.max() - 1.5) if t > a else 0)
        if b > a:
            mine = sum(scores[t, label[t]] for t in range(a, b)) - 1.5 * sum(label[t] != label[t - 1] for t in range(a + 1, b))
            assert mine == pytest.approx(best.max())


def test_more_languages_than_a_byte_counts(spark):
    """300 languages of one word each: every text gets its own."""
    word = lambda k: "".join(chr(97 + k // 26**j % 26) for j in range(3)) * 3
    names = [f"l{k:03}" for k in range(300)]
    model = language_id.train([(word(k) + " " + word(k), n) for k, n in enumerate(names)])
    docs = spark.createDataFrame([(k, " ".join([word(k)] * 6)) for k in range(300)], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, model).collect()} == dict(enumerate(names))
    # switches to and from high numbers
    scores = np.full((20, 300), -9.0)
    scores[:10, 299], scores[10:, 255] = 0, 0
    assert language_id.viterbi(scores, np.array([0, 20]), 3.0).tolist() == [299] * 10 + [255] * 10


def test_language_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, "word " * (10 + i % 7), "ab"[i % 2]) for i in range(400)] + [(1000, "x" * 90_000, "a")], "doc_id long, text string, lang string")
    sample = language_id.sample_rows(docs, 8000)
    assert 4000 < sum(len(t) for t, _ in sample) <= 8000 and {x for _, x in sample} == {"a", "b"}
    assert len(language_id.sample_rows(docs, 1 << 20)) == 401


def test_language_odd_rows(odd, none):
    rows = language_id.identify_documents(odd).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert all(by[k]["lang_pred"] == "und" for k in (3, 4, 5, 6))
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert language_id.identify_documents(none).count() == 0
    kept = language_id.keep_identified(odd)
    assert kept.columns == odd.columns and {3, 4, 5, 6}.isdisjoint(r["doc_id"] for r in kept.collect())


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = [r for r in quality.classify_documents(docs, labels).collect() if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in rows) / len(rows) > 0.95


def test_quality_equals_definition(spark):
    """Scores by definition: the mean of the words' feature vectors plus that of the bigrams', softmax over the classes."""
    rng = np.random.default_rng(3)
    sample = [(" ".join(rng.choice(["a", "bb", "ccc", "dog", "é"], 12)), int(k % 4 > 0)) for k in range(80)]
    model = quality.train(sample, totals=[10, 990], buckets=1 << 8, dim=4)
    texts = ["a bb ccc", "dog dog dog dog", "é", "", None, "  a\n", "ccc " * 3000]
    got = {r["doc_id"]: r["score"] for r in quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for k, text in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        hidden = np.zeros(4)
        if words:
            ids = [i for w in words for i in quality.ngram_features(pa.array([w]), quality.ORDERS, 1 << 8)[0]]
            hidden = model.vector[ids].mean(axis=0)
        if len(words) > 1:
            value = [int(word_hashes(pa.array([w]))[0]) & 255 for w in words]
            hidden = hidden + model.vector[[256 + (x ^ y) for x, y in zip(value, value[1:])]].mean(axis=0)
        logit = hidden @ model.output + model.bias
        p = np.exp(logit - logit.max())
        assert got[k] == pytest.approx(p[1] / p.sum(), rel=1e-9)


def test_quality_shares_do_not_depend_on_the_bound(spark):
    """A text without words scores the share of label 1 among all labels, however many are in the sample."""
    docs = spark.createDataFrame([(i, "good words here" if i % 10 else "BAD!! BAD!!") for i in range(600)] + [(1000, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(600)], "doc_id long, quality int")
    for most in (2000, 50):
        score = {r["doc_id"]: r["score"] for r in quality.classify_documents(docs, labels, most=most).collect()}[1000]
        assert 0.85 < score < 0.95


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (7, 0), (12, 1), (10, 0), (99, 1), (None, 1), (1, None)], "doc_id long, quality int")
    rows = quality.classify_documents(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert quality.classify_documents(none, labels).count() == 0
    no = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.classify_documents(odd, no).collect()} == {0.5}


def katz(rows):
    """The model by definition, over dictionaries."""
    tokens = {i: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + ["</s>"] for i, (_, t) in enumerate(rows)}
    uni, bi = collections.Counter(), collections.defaultdict(collections.Counter)
    for i, (doc_id, _) in enumerate(rows):
        if fold(doc_id, 10):
            uni.update(tokens[i])
            for a, b in zip(["<s>", *tokens[i]], tokens[i], strict=False):
                bi[a][b] += 1
    n, v = sum(uni.values()), len(uni)
    base = lambda w: (uni[w] + 0.1) / (n + 0.1 * (v + 1))
    times = collections.Counter(c for x in bi.values() for c in x.values())
    d = lm_scoring.discounts([times[r] for r in range(1, lm_scoring.CUT + 2)])
    keep = lambda c: d[c - 1] if c <= lm_scoring.CUT else c * (1 - lm_scoring.EPSILON)

    def p(a, b):
        after = bi.get(a)
        if not after:
            return base(b)
        total = sum(after.values())
        if b in after:
            return keep(after[b]) / total
        return (1 - sum(map(keep, after.values())) / total) / (1 - sum(map(base, after))) * base(b)

    assert sum(p("<s>", w) for w in uni) + p("<s>", "never seen") == pytest.approx(1)
    return [(len(t), sum(w in uni for w in t), sum(math.log10(base(w)) for w in t), sum(math.log10(p(a, b)) for a, b in zip(["<s>", *t], t, strict=False))) for t in tokens.values()], n


@pytest.mark.parametrize("bucket", [1_000_000, 500])
def test_katz_equals_definition(small, bucket):
    rows = [(r["doc_id"], r["text"]) for r in small.collect()]
    want, n = katz(rows)
    got = {r["doc_id"]: r for r in lm_scoring.score_documents(small, bucket_tokens=bucket, least_buckets=4).collect()}
    assert len(got) == len(rows)
    for (doc_id, _), (tokens, known, base, score) in zip(rows, want, strict=True):
        r = got[doc_id]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (tokens, known, n, fold(doc_id, 10) == 0)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-9)


def test_katz_frequent_in_held_out_rows_only(spark):
    """A word and a bigram that only held-out rows have, often enough to be dealt apart, and a context that training never saw."""
    held = [i for i in range(400) if fold(i, 10) == 0]
    rows = [(i, "odd odd thing " * 40 if i in held[:20] else f"some words of row {i % 7} and the end") for i in range(400)]
    want, n = katz(rows)
    got = {r["doc_id"]: r for r in lm_scoring.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), bucket_tokens=300, least_buckets=4).collect()}
    for (doc_id, _), (tokens, known, base, score) in zip(rows, want, strict=True):
        r = got[doc_id]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (tokens, known, n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-9)


def test_katz_odd_rows(odd, none):
    rows = lm_scoring.score_documents(odd).collect()
    assert len(rows) == odd.count()
    assert all(r["n_tokens"] == 1 for r in rows if r["doc_id"] in (3, 4, 5))
    assert lm_scoring.score_documents(none).count() == 0
    only = lm_scoring.score_documents(odd.where("doc_id is null or doc_id = 4"))
    assert {r["n_tokens"] for r in only.collect()} == {1, 6}


def test_discounts():
    assert all(0 < d < r + 1 for r, d in enumerate(lm_scoring.discounts([100, 40, 20, 11, 7, 5])))
    assert lm_scoring.discounts([0] * 6) == [0.5, 1.5, 2.5, 3.5, 4.5]
