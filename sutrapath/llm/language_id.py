"""Language identification with spans for mixed-language text.

Method.  Training counts hashed byte n-grams (orders 1 to 4, words marked at both ends, and
whole words) of each language on a sample with a byte bound.  A text is cut into words.  The
script of a word (Unicode ranges of its first letter) narrows the candidate languages to those
seen with that script in training.  Each word gets a clipped log-likelihood per language; a
Viterbi pass with a switching penalty then labels spans.  The language with the most letters
wins, and ``score`` is its share of all letters.

Defined results
* null or empty text, or a text without letters: ``und``, score 0, no spans;
* a word in a script that no learned language uses says nothing: it joins the span around it;
  a text of such words only gets the language with most letters in training, with score 0;
* ties go to the language that sorts first;
* no labelled rows at all: every text is ``und``;
* repeated rows are each labelled; other columns are neither read nor needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, beside, carried, feature_sums, fold, mapped, ngram_features, segment_sums, stored, text_slices, trim

#: Unicode script ranges of letters (first, last code point).
SCRIPTS = {
    "Latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "Greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x400, 0x52F)],
    "Armenian": [(0x530, 0x58F)],
    "Hebrew": [(0x590, 0x5FF)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "Devanagari": [(0x900, 0x97F)],
    "Bengali": [(0x980, 0x9FF)],
    "Gurmukhi": [(0xA00, 0xA7F)],
    "Gujarati": [(0xA80, 0xAFF)],
    "Tamil": [(0xB80, 0xBFF)],
    "Telugu": [(0xC00, 0xC7F)],
    "Kannada": [(0xC80, 0xCFF)],
    "Malayalam": [(0xD00, 0xD7F)],
    "Thai": [(0xE00, 0xE7F)],
    "Georgian": [(0x10A0, 0x10FF)],
    "Kana": [(0x3040, 0x30FF)],
    "Han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
    "Hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
}
OTHER = len(SCRIPTS)
ORDERS = (1, 2, 3, 4)


class Model:
    """``languages`` sorted; ``weight`` (buckets, languages) float32; ``allowed`` (scripts + 1, languages); ``usual``, the one with most letters."""

    def __init__(self, languages: list[str], weight: np.ndarray, allowed: np.ndarray, usual: int = 0):
        self.languages, self.weight, self.allowed, self.usual = languages, weight, allowed, usual


def word_scripts(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Script number of each word's first letter (-1 without a letter), and its number of letters."""
    letters = pc.replace_substring_regex(words, r"[^\p{L}]+", "")
    count = pc.utf8_length(letters).to_numpy(zero_copy_only=False).astype(np.int64)
    first = pc.utf8_slice_codeunits(letters, 0, 1).to_pylist()
    point = np.fromiter((ord(c) if c else -1 for c in first), dtype=np.int64, count=len(first))
    script = np.where(point < 0, -1, OTHER)
    for k, ranges in enumerate(SCRIPTS.values()):
        for lo, hi in ranges:
            script[(point >= lo) & (point <= hi)] = k
    return script, count


def train(sample: list[tuple[str, str]], buckets: int = 1 << 16) -> Model:
    """A model from (text, language) pairs held by the driver."""
    languages = sorted({lang for _, lang in sample})
    counts, seen = np.zeros((buckets, len(languages))), np.zeros((OTHER + 1, len(languages)))
    for k, lang in enumerate(languages):
        texts = [t for t, x in sample if x == lang]
        for i in range(0, len(texts), 500):
            words = Words(pa.array(texts[i : i + 500], pa.string()), "utf8")
            if not len(words.distinct):
                continue
            tokens = np.bincount(words.code, minlength=len(words.distinct))
            script, letters = word_scripts(words.distinct)
            ids, starts = ngram_features(words.distinct, ORDERS, buckets)
            # a word that is repeated many times says less each time
            counts[:, k] += np.bincount(ids, weights=np.repeat(np.sqrt(tokens), np.diff(starts)), minlength=buckets)
            full = script >= 0
            seen[:, k] += np.bincount(script[full], weights=(tokens * letters)[full], minlength=OTHER + 1)
    share = (counts + 0.05) / (counts.sum(0) + 0.05 * buckets) if languages else counts
    weight = np.log(share)
    weight -= weight.mean(1, keepdims=True) if languages else 0
    allowed = seen >= 0.01 * np.maximum(seen.sum(0), 1)
    trim()
    return Model(languages, weight.astype(np.float32), allowed, int(seen.sum(0).argmax()) if languages else 0)


def sample_rows(docs: DataFrame, budget_bytes: int) -> list[tuple[str, str]]:
    """Labelled texts, about ``budget_bytes`` in all, an equal part of it for each language; chosen by a hash of id and text.

    Texts above a language's part are left out; of what is drawn, the first ``budget_bytes`` by that hash are taken.
    """
    docs = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    sizes = docs.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes")).collect()
    if not sizes:
        return []
    part = budget_bytes / len(sizes)
    share = F.coalesce(*[F.when(F.col("lang") == r["lang"], F.lit(min(1.0, part / max(1, r["bytes"])))) for r in sizes])
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(1 << 30)
    some = docs.where((draw < share) & (F.octet_length("text") <= part))
    # on average they are within the budget; only numbers go to the driver to find where it ends
    drawn = some.select((draw / share).alias("at"), F.octet_length("text").alias("bytes")).orderBy("at").limit(budget_bytes).collect()
    within = int((np.cumsum([r["bytes"] for r in drawn]) <= budget_bytes).sum()) if drawn else 0
    if within < len(drawn):
        some = some.where(draw / share < drawn[within]["at"])
    return [(r["text"], r["lang"]) for r in some.select("text", "lang").collect()]


def viterbi(scores: np.ndarray, starts: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word; rows are the segments of ``starts``, all advanced together, longest first."""
    n, k = scores.shape
    kind, stays = np.min_scalar_type(k), k  # labels are numbers below k, which itself says that a word has its predecessor's label
    label = np.zeros(n, dtype=kind)
    if k < 2 or not n:
        return label
    size = np.diff(starts)
    order = np.argsort(-size, kind="stable")
    first, size = starts[:-1][order], size[order]
    alive = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")  # rows with more than t words
    back = np.full((n, k), stays, dtype=kind)
    state = scores[first[: alive[0]]].astype(np.float64)
    final = np.zeros(len(size), dtype=kind)
    for t in range(1, size[0]):
        m = alive[t]
        if m < len(state):
            final[m : len(state)] = state[m:].argmax(1)
            state = state[:m]
        best = state.argmax(1)
        over = state[np.arange(m), best] - penalty
        switch = over[:, None] > state
        at = first[:m] + t
        if switch.any():
            back[at] = np.where(switch, best[:, None], stays)
            state = np.where(switch, over[:, None], state)
        state = state + scores[at]
    final[: len(state)] = state.argmax(1)
    full = np.flatnonzero(size)
    label[first[full] + size[full] - 1] = final[full]
    for t in range(size[0] - 1, 0, -1):
        m = alive[t]
        at = first[:m] + t
        now = label[at]
        came = back[at, now]
        label[at - 1] = np.where(came == stays, now, came)
    return label


def label_words(model: Model, words: Words, penalty: float, clip: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Label of each token, letters of each token, and whether it says anything."""
    value, _ = feature_sums(words.distinct, ORDERS, model.weight, len(model.weight))
    script, letters = word_scripts(words.distinct)
    allowed = np.zeros((len(script), len(model.languages)), dtype=bool)
    allowed[script >= 0] = model.allowed[script[script >= 0]]
    known = allowed.any(1)
    value -= np.where(allowed, value, -np.inf).max(1, keepdims=True, initial=-1e30)
    value = np.where(allowed, np.maximum(value, -clip), -clip)
    value[~known] = 0
    label = viterbi(value[words.code], words.starts, penalty)
    return label, letters[words.code], known[words.code]


def identify(docs: DataFrame, model: Model, penalty: float = 8.0, clip: float = 6.0, spans: bool = True, carry: bool = False) -> DataFrame:
    """``docs`` (doc_id, text) with lang_pred, score and spans (language, first word, words, letters).

    With ``carry`` all columns of ``docs`` stay, and the new ones are members of one column named by ``carried``.
    """
    packed = (model.languages, model.weight, model.allowed, model.usual)
    spans = spans and not carry
    made = [("lang_pred", "string"), ("score", "double"), *[("spans", "array<struct<lang:string,start:long,words:long,letters:long>>")] * spans]
    span_type = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("words", pa.int64()), ("letters", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*packed)
        names = np.array([*model.languages, "und"], dtype=object)
        k = len(model.languages)
        for batch in batches:
            for part in text_slices(batch):
                words = Words(part.column("text"), "utf8")
                total = np.zeros((words.rows, max(k, 1)))
                label = np.zeros(0, dtype=np.uint8)
                letters = known = np.zeros(0, dtype=np.int64)
                if k and len(words.code):
                    label, letters, known = label_words(model, words, penalty, clip)
                    for j in range(k):
                        total[:, j] = segment_sums(np.where((label == j) & known, letters, 0), words.starts)
                whole = segment_sums(letters, words.starts) if len(letters) else np.zeros(words.rows)
                sure = total.sum(1) > 0
                best = np.where(sure, total.argmax(1), np.where(whole > 0, model.usual, k) if k else k)
                score = np.where(sure, total.max(1) / np.maximum(whole, 1), 0.0)
                out = [pa.array(names[best], pa.string()), pa.array(score)]
                if spans:
                    out.append(_spans(model.languages, words, label, letters, span_type))
                yield beside(part, out, [k for k, _ in made], carry)

    return mapped(docs, run, made, carry)


def _spans(languages: list[str], words: Words, label: np.ndarray, letters: np.ndarray, kind: pa.DataType) -> pa.Array:
    if not len(label):
        return pa.array([[]] * words.rows, kind)
    row = np.repeat(np.arange(words.rows), words.counts)
    begin = np.flatnonzero(np.concatenate([[True], (label[1:] != label[:-1]) | (row[1:] != row[:-1])]))
    end = np.concatenate([begin[1:], [len(label)]])
    items = pa.StructArray.from_arrays([pa.array(languages).take(pa.array(label[begin].astype(np.int32))), pa.array(begin - words.starts[row[begin]]), pa.array(end - begin), pa.array(np.add.reduceat(letters, begin))], fields=list(kind.value_type))
    offsets = np.searchsorted(row[begin], np.arange(words.rows + 1))
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), items, type=kind)


def identify_documents(docs: DataFrame, train_bytes: int = 16 << 20, spans: bool = True) -> DataFrame:
    """The operator: learns from rows whose crc32(doc_id) mod 4 is not 2, labels every row.

    ``train_bytes`` bounds the labelled text that the driver fits on; nothing else is sampled.
    """
    model = train(sample_rows(docs.where(fold("doc_id", 4) != 2), train_bytes))
    out = identify(docs, model, spans=spans)
    return out.withColumn("held_out", fold("doc_id", 4) == 2)


def keep_identified(docs: DataFrame, least: float = 0.5, train_bytes: int = 16 << 20) -> DataFrame:
    """The rows of ``docs`` with a language that has at least ``least`` of the letters; all columns stay as they are."""
    model = train(sample_rows(docs.where(fold("doc_id", 4) != 2), train_bytes))
    found = F.col(carried(docs))
    kept = identify(docs, model, carry=True).where((found["lang_pred"] != "und") & (found["score"] >= least))
    return stored(kept.select(*docs.columns), "identified", batch_rows=1000)
