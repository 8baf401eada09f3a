"""Quality classifier: supervised subword embeddings.

Each word stands for hashed byte n-grams (orders 2 to 4, marked at both ends) and itself, each pair of
neighbouring words for one hashed bigram: the xor of both hashes, so pairs of a word with itself share a
feature.  Each feature has a learned vector.  A document is the mean of its words' feature vectors plus
the mean of its bigrams' vectors, a softmax over the two classes follows, and all is trained by stochastic
gradient descent in numpy on a bounded sample of labelled rows.  The sample has as many rows of each class
as there are, up to the bound; the share of the classes among all labels corrects the bias afterwards, so
scores mean the same at every size.  As the output is linear in the means, scoring needs one number per
feature: the difference of the two logits.

Defined results
* null or empty text: the score of the bias alone (how often label 1 occurs in training);
* no labelled rows: score 0.5 for every document; one class only: the bias leans to that class;
* a null doc_id joins no label; repeated rows are each scored alike; several labels of one
  document all count; other columns are neither read nor needed;
* very long texts: scored whole; only texts of up to ``TEXT_BYTES`` are in the sample, and ``SAMPLE_BYTES`` of all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, beside, carried, feature_sums, fold, mapped, ngram_features, segment_sums, stored, text_slices, trim, word_hashes

ORDERS = (2, 3, 4)
#: Bytes of a text in the sample, and of the whole sample, at most.
TEXT_BYTES, SAMPLE_BYTES = 1 << 20, 32 << 20


class Model:
    """``vector`` (2 * buckets, dim), those of words before those of bigrams, ``output`` (dim, 2), ``bias`` (2)."""

    def __init__(self, vector: np.ndarray, output: np.ndarray, bias: np.ndarray):
        self.vector, self.output, self.bias = vector, output, bias

    def difference(self) -> tuple[np.ndarray, float]:
        """Per feature, logit 1 less logit 0; and the same of the bias."""
        return (self.vector @ (self.output[:, 1] - self.output[:, 0])).astype(np.float64), float(self.bias[1] - self.bias[0])


def bigrams(words: Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashed bigrams of all rows in a row, and where each row's begin (n + 1).  ``buckets`` is a power of two."""
    if not len(words.distinct):
        return np.zeros(0, dtype=np.int64), np.zeros(words.rows + 1, dtype=np.int64)
    value = (word_hashes(words.distinct) & np.uint64(buckets - 1)).astype(np.int64)[words.code]
    pair = value[1:] ^ value[:-1]
    inside = np.ones(len(pair), dtype=bool)
    begin = words.starts[1:-1]
    inside[begin[(begin > 0) & (begin <= len(pair))] - 1] = False
    return pair[inside], np.concatenate([[0], np.cumsum(np.maximum(words.counts - 1, 0))])


def _bags(texts: list[str], buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct features and their weights: words' features add up to 1, and so do bigrams, which follow ``buckets``."""
    bags = []
    for i in range(0, len(texts), 200):
        words = Words(pa.array(texts[i : i + 200], pa.string()))
        ids, starts = ngram_features(words.distinct, ORDERS, buckets) if len(words.distinct) else (np.zeros(0, int), np.zeros(1, int))
        size = np.diff(starts)
        pairs, of = bigrams(words, buckets)
        for a, b, c, d in zip(words.starts[:-1], words.starts[1:], of[:-1], of[1:], strict=True):
            codes, times = np.unique(words.code[a:b], return_counts=True)
            if not len(codes):
                bags.append((np.zeros(0, np.int32), np.zeros(0, np.float32)))
                continue
            at = np.repeat(starts[codes] - np.concatenate([[0], np.cumsum(size[codes])[:-1]]), size[codes]) + np.arange(size[codes].sum())
            feature, back = np.unique(ids[at], return_inverse=True)
            weight = np.bincount(back, weights=np.repeat(times, size[codes]))
            pair, often = np.unique(pairs[c:d], return_counts=True)
            bags.append((np.append(feature, pair + buckets).astype(np.int32), np.append(weight / weight.sum(), often / max(1, d - c)).astype(np.float32)))
    return bags


def train(sample: list[tuple[str, int]], totals: list[int] | None = None, buckets: int = 1 << 16, dim: int = 8, epochs: int = 6, rate: float = 0.5, seed: int = 7) -> Model:
    """Stochastic gradient descent, one document a step, with a falling rate; ``totals`` are the labels of each class that the sample stands for."""
    if not sample:
        return Model(np.zeros((2 * buckets, dim)), np.zeros((dim, 2)), np.zeros(2))
    rng = np.random.default_rng(seed)
    vector, output = rng.uniform(-1 / dim, 1 / dim, (2 * buckets, dim)), rng.normal(0, 0.1, (dim, 2))
    label = np.array([y for _, y in sample], dtype=int)
    share = (np.bincount(label, minlength=2) + 0.5) / (len(label) + 1)
    bias = np.log(share)
    bags, step = _bags([t for t, _ in sample], buckets), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            now, step = rate * (1 - step / (epochs * len(bags))), step + 1
            feature, weight = bags[i]
            hidden = weight @ vector[feature]
            logit = hidden @ output + bias
            p = np.exp(logit - logit.max())
            error = p / p.sum()
            error[label[i]] -= 1
            back = output @ error
            output -= now * np.outer(hidden, error)
            bias -= 0.1 * now * error
            # the mean spreads the gradient thinly over many features: the vectors take a longer step
            vector[feature] -= (20 * now) * np.outer(weight, back)
    del bags
    trim()
    if totals:
        every = np.array(totals, dtype=float)
        bias += np.log((every + 0.5) / (every.sum() + 1)) - np.log(share)
    return Model(vector, output, bias)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> tuple[list[tuple[str, int]], list[int]]:
    """Texts of labelled rows, and how many labels of each class ``docs`` have.

    At most ``most`` labelled ids of each class, least hash first, and the texts of those ids, again by hash, as
    many rows at most and within the bounds on bytes.
    """
    labels = labels.select("doc_id", F.col(label).cast("int").alias("_label")).where("doc_id is not null and _label in (0, 1)")
    there = docs.select("doc_id").join(labels, "doc_id").distinct()
    counted = {r["_label"]: r["count"] for r in there.groupBy("_label").count().collect()}
    draw = F.xxhash64("doc_id", F.lit(17))
    chosen = [labels.where(F.col("_label") == k).orderBy(draw, "doc_id").limit(most) for k in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 * most rows of two numbers
    rows = docs.select("doc_id", "text").where(F.octet_length("text") <= TEXT_BYTES).join(ids, "doc_id")
    rows = rows.withColumn("_draw", F.xxhash64("text", "doc_id", "_label"))
    sizes = rows.orderBy("_draw").limit(2 * most).select("_draw", F.octet_length("text").alias("bytes")).collect()
    within = np.cumsum([r["bytes"] for r in sizes]) <= SAMPLE_BYTES
    if not within.any():
        return [], [counted.get(k, 0) for k in (0, 1)]
    rows = rows.where(F.col("_draw") <= sizes[int(within.sum()) - 1]["_draw"]).orderBy("_draw").limit(int(within.sum()))
    return sorted((r["text"], r["_label"]) for r in rows.select("text", "_label").collect()), [counted.get(k, 0) for k in (0, 1)]


def score(docs: DataFrame, model: Model, carry: bool = False) -> DataFrame:
    """``docs`` (doc_id, text) with score, the probability of label 1, and predicted.

    With ``carry`` all columns of ``docs`` stay, and the new ones are members of one column named by ``carried``.
    """
    made = [("score", "double"), ("predicted", "int")]
    weight, bias = model.difference()

    buckets = len(weight) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                words = Words(part.column("text"))
                logit = np.zeros(words.rows)
                if len(words.distinct):
                    per_word, size = feature_sums(words.distinct, ORDERS, weight[:buckets], buckets)
                    pairs, starts = bigrams(words, buckets)
                    logit = words.row_sums(per_word) / np.maximum(words.row_sums(size), 1) + segment_sums(weight[buckets + pairs], starts) / np.maximum(words.counts - 1, 1)
                value = 1 / (1 + np.exp(-np.clip(logit + bias, -500, 500)))
                yield beside(part, [pa.array(value), pa.array((value >= 0.5).astype(np.int32))], [k for k, _ in made], carry)

    return mapped(docs, run, made, carry)


def classify_documents(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 2000) -> DataFrame:
    """The operator: learns from labels of rows whose crc32(doc_id) mod 3 is not 1, scores every row.

    ``most`` bounds the labelled rows of each class that the driver fits on; nothing else is sampled.
    """
    model = train(*labelled_sample(docs, labels.where(fold("doc_id", 3) != 1), label, most))
    return score(docs, model).withColumn("held_out", fold("doc_id", 3) == 1)


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 2000) -> DataFrame:
    """The rows of ``docs`` that are predicted to have label 1; all columns stay as they are."""
    model = train(*labelled_sample(docs, labels.where(fold("doc_id", 3) != 1), label, most))
    kept = score(docs, model, carry=True).where(F.col(carried(docs))["predicted"] == 1)
    return stored(kept.select(*docs.columns), "good", batch_rows=1000)
