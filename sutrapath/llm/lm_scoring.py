"""Language-model scoring: a Katz back-off bigram model learned from the corpus and applied to it.

Model.  Tokens are the lower-cased words of a text and an end token; the context of the first is a
start symbol.  P0(w) = (c(w) + 0.1) / Z with Z = N + 0.1 (V + 1) is the base.  A bigram seen c12
times has P(w2|w1) = D(c12) / c(w1): Good-Turing discounts for counts up to ``CUT``, and 1 - EPSILON
of larger ones, so that every context keeps some mass.  Others back off: P(w2|w1) = a(w1) P0(w2), where
a(w1) = (1 - sum of D / c(w1)) / (1 - sum of P0) over the words seen after w1, which normalises
exactly; a context that was never seen has a = 1.

Method.  A slice of text sends its distinct bigrams, with how often they occur in training rows, to hash buckets
of their second word.  A bucket then has all of c(w2) and c(w1, w2): it sends the counts back to each slice,
bigram by bigram, and sums over the words seen after each context to a partitioned table.  The contexts'
sums, dealt by context, give back-off weights, which are looked up for the bigrams that back off.  In the
end each slice has the counts and weights of its bigrams, and adds up its documents' tokens in double
precision.  What travels is a few bytes for each distinct bigram of a slice, at any size of the corpus.

Frequent words would fill a bucket: those with more tokens than a bucket's share, in all rows, are counted
beforehand (there are at most as many as buckets), and their bigrams are dealt by both words.  Bigrams
that alone would fill a bucket are counted beforehand too.  As contexts, frequent words and the start have
their back-off weights worked out by an aggregate of their sums, and are looked up where the tokens stand.

Defined results
* null text: as the empty text, the end token alone; a null doc_id counts as the empty id;
* no training rows: N = V = 0, all tokens back off to P0 = 1;
* repeated rows count and are scored each; no rows: no rows; other columns are not read.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, fold, mix64, settings, stored, text_slices, trim, word_hashes

CUT, EPSILON, BASE = 5, 1e-3, 0.1
#: Bytes of text in a slice, and rows that a Python worker gets at a time.
SLICE, BATCH_ROWS = 8 << 20, 2000
START, END = np.uint64(0x5374617274), np.uint64(0x456E64)
#: Of a context, how many words follow it so often; words that follow it more often, and the base mass of all of them.
SUMS = (*(f"r{r}" for r in range(1, CUT + 1)), "big", "mass")
SCHEMA = "kind string, slice long, bucket long, ids array<string>, payload binary"


def _pack(**arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, protocol=5))


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def _narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the narrowest unsigned type that holds them."""
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def _slice_tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bigram tokens of a slice: hashes of its distinct symbols, and for each token its context, itself (codes) and its row.

    The last two symbols are start and end.
    """
    words = Words(texts, "ascii")
    n = len(words.distinct)
    symbols = np.concatenate([word_hashes(words.distinct), [START, END]])
    starts = words.starts + np.arange(words.rows + 1)
    second = np.full(starts[-1], n + 1, dtype=np.int32)
    inner = np.ones(starts[-1], dtype=bool)
    inner[starts[1:] - 1] = False
    second[inner] = words.code
    first = np.empty_like(second)
    first[1:] = second[:-1]
    first[starts[:-1]] = n
    return symbols, first, second, np.repeat(np.arange(words.rows, dtype=np.int32), np.diff(starts))


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix64(first * np.uint64(0x9E3779B97F4A7C15) + second)


def _lookup(keys: np.ndarray, table: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Where each key stands in the sorted ``table['key']``, and whether it is there."""
    if not len(table["key"]):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(table["key"], keys), len(table["key"]) - 1)
    return at, table["key"][at] == keys


def _rows(kind: str, at: int, items: list[tuple[int, list[str] | None, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * len(items), pa.string()), pa.array([at] * len(items), pa.int64()), pa.array([b for b, _, _ in items], pa.int64()), pa.array([i for _, i, _ in items], pa.list_(pa.string())), pa.array([p for _, _, p in items], pa.binary())],
        ["kind", "slice", "bucket", "ids", "payload"],
    )


# --- counts beforehand ----------------------------------------------------------------------


def _frequent(docs: DataFrame, bucket_tokens: int) -> tuple[int, int, int, dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Training documents and tokens, tokens of all rows; words with more than ``bucket_tokens`` tokens in all rows; and such bigrams.

    Their counts are those in training.  A word with so many tokens has at least half of them in slices where its
    share is at least half of what it is overall, so these local counts find all candidates; a second pass counts
    those exactly.
    """
    docs = docs.select("text", "train")
    size, count = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    least = bucket_tokens / max(1, size // 2 + 1 + 2 * count)  # a token has two bytes with the space after it, or is an end

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, limit=SLICE):
                words, train = Words(part.column("text"), "ascii"), part.column("train").to_numpy(zero_copy_only=False)
                count = np.append(np.bincount(words.code, minlength=len(words.distinct)), words.rows)
                keep = np.flatnonzero(count >= least / 2 * count.sum())
                keys = np.append(word_hashes(words.distinct.take(pa.array(keep[keep < len(words.distinct)]))), [END] * int((keep == len(words.distinct)).sum())).astype(np.uint64)
                sizes = [int(train.sum()), int((words.counts + 1)[train].sum()), int(count.sum())]
                yield pa.RecordBatch.from_arrays([pa.array(np.append(keys, np.zeros(3, np.uint64)).view(np.int64)), pa.array([0] * len(keys) + [1, 2, 3], pa.int32()), pa.array(count[keep].tolist() + sizes)], ["key", "kind", "count"])

    found = docs.mapInArrow(often, "key long, kind int, count long").groupBy("kind", "key").agg(F.sum("count").alias("count")).where((F.col("kind") > 0) | (F.col("count") >= bucket_tokens / 2)).collect()
    rows, tokens, every = (sum(r["count"] for r in found if r["kind"] == k) for k in (1, 2, 3))
    share = bucket_tokens / max(1, every)
    none = {"key": np.zeros(0, np.uint64), "count": np.zeros(0, np.int64)}
    found = [r for r in found if r["kind"] == 0]
    if share >= 1:
        return rows, tokens, every, none, none

    candidates = np.sort(np.array([r["key"] for r in found], dtype=np.int64).view(np.uint64))
    if not len(candidates):
        return rows, tokens, every, none, none

    def exactly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {"key": candidates}
        for batch in batches:
            for part in text_slices(batch, limit=SLICE):
                symbols, first, second, row = _slice_tokens(part.column("text"))
                train = part.column("train").to_numpy(zero_copy_only=False)[row]
                hot = _lookup(symbols, table)[1]
                count, learned = np.bincount(second, minlength=len(symbols)), np.bincount(second[train], minlength=len(symbols))
                both = hot[first] & hot[second]
                pairs, times = np.unique(first[both].astype(np.int64) * len(symbols) + second[both], return_counts=True)
                keep = times >= share / 2 * len(second)
                pairs, times, n = pairs[keep], times[keep], int(hot.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([symbols[hot], symbols[pairs % len(symbols)]]).view(np.int64)),
                        pa.array(np.concatenate([np.zeros(n, np.uint64), symbols[pairs // len(symbols)]]).view(np.int64)),
                        pa.array(np.arange(n + len(pairs)) >= n),
                        pa.array(np.concatenate([count[hot], times])),
                        pa.array(np.concatenate([learned[hot], np.zeros(len(pairs), dtype=learned.dtype)])),
                    ],
                    ["key", "first", "pair", "count", "learned"],
                )

    counted = docs.mapInArrow(exactly, "key long, first long, pair boolean, count long, learned long").groupBy("key", "first", "pair").agg(F.sum("count").alias("count"), F.sum("learned").alias("learned"))
    counted = counted.where((F.col("count") >= bucket_tokens) | (F.col("pair") & (F.col("count") >= bucket_tokens / 2))).collect()
    words = sorted((int(np.int64(r["key"]).view(np.uint64)), r["learned"]) for r in counted if not r["pair"])
    words = {"key": np.array([k for k, _ in words], dtype=np.uint64), "count": np.array([c for _, c in words], dtype=np.int64)}
    near = np.array([(r["first"], r["key"]) for r in counted if r["pair"]], dtype=np.int64).reshape(-1, 2).view(np.uint64)
    near = near[_lookup(near[:, 1], words)[1] & (_lookup(near[:, 0], words)[1] | (near[:, 0] == START))] if len(near) else near
    return rows, tokens, every, words, _count_pairs(docs, near, bucket_tokens) if len(near) else none


def _count_pairs(docs: DataFrame, pairs: np.ndarray, least: int) -> dict[str, np.ndarray]:
    """The few candidate bigrams with at least ``least`` tokens in all rows, and how many of them are in training."""
    key = _pair(pairs[:, 0].copy(), pairs[:, 1].copy())
    order = np.argsort(key)
    key, pairs = key[order], pairs[order]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, limit=SLICE):
                symbols, first, second, row = _slice_tokens(part.column("text"))
                train = part.column("train").to_numpy(zero_copy_only=False)[row]
                some = np.isin(symbols, pairs[:, 0])[first] & np.isin(symbols, pairs[:, 1])[second]
                at, there = _lookup(_pair(symbols[first[some]], symbols[second[some]]), {"key": key})
                times, learned = np.bincount(at[there], minlength=len(key)), np.bincount(at[there & train[some]], minlength=len(key))
                yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(times)), pa.array(times[times > 0]), pa.array(learned[times > 0])], ["at", "count", "learned"])

    found = {r["at"]: (r["count"], r["learned"]) for r in docs.mapInArrow(count, "at long, count long, learned long").groupBy("at").agg(F.sum("count").alias("count"), F.sum("learned").alias("learned")).collect()}
    keep = np.array([found.get(i, (0, 0))[0] >= least for i in range(len(key))])
    return {"key": key[keep], "first": pairs[keep, 0], "second": pairs[keep, 1], "count": np.array([found[i][1] for i in np.flatnonzero(keep)], dtype=np.int64)}


# --- the passes -----------------------------------------------------------------------------


def _narrow_slices(batch: pa.RecordBatch, buckets: int) -> Iterator[pa.RecordBatch]:
    """Slices of which a bucket, two symbols and a row fit into 64 bits together: a word has two bytes with the space after it."""
    for part in text_slices(batch, limit=SLICE):
        todo = [part]
        while todo:
            part = todo.pop()
            size = pc.sum(pc.fill_null(pc.binary_length(part.column("text")), 0)).as_py() or 0
            symbols = size // 2 + 3
            if len(part) > 1 and (buckets + 1) * symbols * symbols * len(part) >= 1 << 64:
                symbols = len(Words(part.column("text"), "ascii").distinct) + 2  # the bound is far from what there is
            if len(part) > 1 and (buckets + 1) * symbols * symbols * len(part) >= 1 << 64:
                half = len(part) // 2
                todo += [part.slice(half), part.slice(0, half)]
            else:
                yield part


def _deal(docs: DataFrame, buckets: int, words: dict[str, np.ndarray], pairs: dict[str, np.ndarray]) -> DataFrame:
    """A row for each slice and bucket with the slice's bigrams there, and one with the slice's ids and where its bigrams stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, made = TaskContext.get(), 0
        for batch in batches:
            for part in _narrow_slices(batch, buckets):
                at, made = ((context.partitionId() if context else 0) << 24) + made, made + 1
                train = part.column("train").to_numpy(zero_copy_only=False)
                symbols, first, second, row = _slice_tokens(part.column("text"))
                tokens = np.bincount(row, minlength=len(part))
                wide = np.uint64(len(symbols))
                key = (mix64(symbols) % np.uint64(buckets))[second]
                if len(words["key"]):
                    hot = np.flatnonzero(_lookup(symbols, words)[1][second])
                    both = _pair(symbols[first[hot]], symbols[second[hot]])
                    key[hot] = both % np.uint64(buckets)
                    if len(pairs["key"]):  # what is counted already is a bucket of its own, the last
                        key[hot[_lookup(both, pairs)[1]]] = buckets
                    del hot, both
                # bucket, second, first and row in one number: it is sorted by itself
                key *= wide
                key += second.astype(np.uint64)
                key *= wide
                key += first.astype(np.uint64)
                key *= np.uint64(len(part))
                key += row.astype(np.uint64)
                del first, second, row
                key.sort()
                rows = (key % np.uint64(len(part))).astype(np.int32)
                key //= np.uint64(len(part))
                begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
                key = key[begin]
                first = (key % wide).astype(np.int32)
                key //= wide
                second, bucket = (key % wide).astype(np.int32), key // wide
                del key
                learned = np.add.reduceat(train[rows].astype(np.int64), begin) if len(begin) else begin
                times = np.diff(np.append(begin, len(rows)))
                head = np.flatnonzero(np.concatenate([[True], (second[1:] != second[:-1]) | (bucket[1:] != bucket[:-1])])) if len(begin) else begin
                cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(begin) else begin
                stands = {"tokens": tokens, "row": rows, "times": times, "second_times": np.diff(np.append(head, len(second))), "end": symbols[second[head]] == END}
                yield _rows("ids", at, [(at % buckets, part.column("doc_id").to_pylist(), _pack(**{k: _narrow(v) if v.dtype != bool else v for k, v in stands.items()}))])
                del rows, stands
                items = []
                for where, lo, hi in zip(bucket[cut], cut, np.append(cut[1:], len(bucket)), strict=True):
                    if where == buckets:
                        known = pairs["count"][_lookup(_pair(symbols[first[lo:hi]], symbols[second[lo:hi]]), pairs)[0]]
                        heads = second[lo:hi][np.concatenate([[True], second[lo + 1 : hi] != second[lo : hi - 1]])]
                        yield _rows("counts", at, [(at % buckets, None, _counted(buckets, known, words["count"][_lookup(symbols[heads], words)[0]]))])
                        continue
                    one, one_at = np.unique(first[lo:hi], return_inverse=True)
                    starts = np.flatnonzero(np.concatenate([[True], second[lo + 1 : hi] != second[lo : hi - 1]]))
                    items.append((int(where), None, _pack(first=symbols[one], first_at=_narrow(one_at), second=symbols[second[lo:hi][starts]], second_times=_narrow(np.diff(np.append(starts, hi - lo))), learned=_narrow(learned[lo:hi]))))
                del symbols, first, second, bucket, learned, begin, times
                yield _rows("tokens", at, items)
                del items
                trim()

    return docs.select("doc_id", "text", "train").mapInArrow(run, SCHEMA)


def _counted(bucket: int, count12: np.ndarray, count2: np.ndarray) -> bytes:
    return _pack(bucket=np.array([bucket]), c12=_narrow(count12), c2=_narrow(count2))


def _evaluate(dealt: DataFrame, buckets: int, words: dict[str, np.ndarray], hot: np.ndarray) -> DataFrame:
    """Of each bucket: counts of each slice's bigrams (kind counts), sums of contexts (contexts; hot), bigrams that back off (off; hotoff), and totals."""

    def run(group: pa.Table) -> pa.Table:
        kinds = group.column("kind").to_pylist()
        out = group.filter(pa.array([k != "tokens" for k in kinds])).to_batches()
        blocks = group.filter(pa.array([k == "tokens" for k in kinds]))
        if not len(blocks):
            return pa.Table.from_batches(out, schema=group.schema)
        here = blocks.column("bucket")[0].as_py()
        slices, data = blocks.column("slice").to_pylist(), [_unpack(p.as_py()) for p in blocks.column("payload")]
        del group, blocks
        learned = np.concatenate([d["learned"] for d in data]).astype(np.int64)
        two, two_at = np.unique(np.concatenate([d["second"] for d in data]), return_inverse=True)
        heads = np.cumsum(np.concatenate([d["second_times"] for d in data]).astype(np.int64))
        count2 = np.bincount(two_at, weights=np.add.reduceat(learned, heads - np.concatenate([d["second_times"] for d in data]))).astype(np.int64)
        place, known = _lookup(two, words)
        distinct = int(((count2 > 0) & ~known).sum())
        count2[known] = words["count"][place[known]]
        head2 = count2[two_at]
        first = np.concatenate([d["first"][d["first_at"]] for d in data])
        times2 = np.concatenate([d["second_times"] for d in data])
        pair = _pair(first, np.repeat(two[two_at], times2))
        order = np.argsort(pair).astype(np.int32)
        pair = pair[order]
        fresh = np.concatenate([[True], pair[1:] != pair[:-1]])
        del pair
        head = order[fresh]
        both = np.empty(len(order), dtype=np.int32)
        both[order] = np.cumsum(fresh, dtype=np.int32) - 1
        del order, fresh
        per_type = np.bincount(both, weights=learned).astype(np.int64)
        del learned
        count12 = per_type[both]
        del both
        totals = {f"n{r}": int((per_type == r).sum()) for r in range(1, CUT + 2)} | {"distinct": distinct}
        out.append(_rows("totals", -1, [(0, None, pickle.dumps(totals))]))
        # of each context: how many words follow it how often, and their base mass
        live = per_type > 0
        one, one_at = np.unique(first[head[live]], return_inverse=True)
        times = per_type[live]
        sums = {f"r{r}": np.bincount(one_at[times == r], minlength=len(one)) for r in range(1, CUT + 1)}
        sums["big"] = np.bincount(one_at, weights=np.where(times > CUT, times, 0), minlength=len(one)).astype(np.int64)
        sums["mass"] = np.bincount(one_at, weights=np.repeat(head2, times2)[head[live]] + BASE, minlength=len(one))
        del head, live, times, one_at, times2
        frequent = np.isin(one, hot)
        out.append(_rows("hot", -1, [(0, None, _pack(key=one[frequent], **{k: v[frequent] for k, v in sums.items()}))]))
        to = mix64(one) % np.uint64(buckets)
        for b in np.unique(to[~frequent]):
            mine = (to == b) & ~frequent
            out.append(_rows("contexts", -1, [(int(b), None, _pack(key=one[mine], **{k: _narrow(v[mine]) if k != "mass" else v[mine] for k, v in sums.items()}))]))
        lo, low = 0, 0
        off: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for nth, (at, d) in enumerate(zip(slices, data, strict=True)):
            n, m = len(d["first_at"]), len(d["second"])
            c12 = count12[lo : lo + n]
            out.append(_rows("counts", at, [(0, None, _counted(here, c12, head2[low : low + m]))]))
            away = np.flatnonzero(c12 == 0)
            if len(away):
                key = first[lo : lo + n][away]
                frequent = np.isin(key, hot)
                if frequent.any():
                    out.append(_rows("hotoff", at, [(0, None, _pack(bucket=np.array([here]), key=key[frequent], index=_narrow(away[frequent])))]))
                off.append((key[~frequent], away[~frequent], np.full(int((~frequent).sum()), nth)))
            lo, low = lo + n, low + m
        del data, first, count12
        key, away, nth = (np.concatenate(x) for x in zip(*off, strict=True))
        del off
        # the bigrams of all slices whose contexts are in one bucket go there together
        to = mix64(key) % np.uint64(buckets)
        order = np.argsort(to, kind="stable")
        key, away, nth, to = key[order], away[order], nth[order], to[order]
        ends = np.append(np.flatnonzero(to[1:] != to[:-1]) + 1, len(to)) if len(to) else np.zeros(0, dtype=np.int64)
        for lo, hi in zip(np.append(0, ends[:-1]), ends, strict=True) if len(ends) else ():
            which, place = np.unique(nth[lo:hi], return_inverse=True)
            out.append(_rows("off", -1, [(int(to[lo]), None, _pack(bucket=np.array([here]), slices=np.array(slices)[which], which=_narrow(place), key=key[lo:hi], index=_narrow(away[lo:hi])))]))
        trim()
        return pa.Table.from_batches(out)

    return dealt.groupBy("bucket").applyInArrow(run, SCHEMA)


def discounts(n: list[int]) -> list[float]:
    """D(1) .. D(CUT) from n[r] = bigrams seen r times (r from 1 to CUT + 1): Good-Turing with Katz's cut.

    Where the counts of counts give no discount between 0 and 1, half a token is taken off.
    """
    out = []
    tail = (CUT + 1) * n[CUT] / n[0] if n[0] else 1.0
    for r in range(1, CUT + 1):
        d = ((r + 1) * n[r] / (r * n[r - 1]) - tail) / (1 - tail) if n[r - 1] and tail < 1 else 0.0
        out.append(d * r if 0 < d < 1 else r - 0.5)
    return out


def _weights(sums: dict[str, np.ndarray], scale: float, discount: list[float]) -> np.ndarray:
    """log10 of a(w1) c(w1) for contexts with these sums: the mass left of their tokens over the base mass of words not seen after them."""
    left = EPSILON * sums["big"] + sum(sums[f"r{r + 1}"] * (r + 1 - discount[r]) for r in range(CUT))
    return np.log10(left / (1 - sums["mass"] / scale)) if len(left) else np.zeros(0)


def _back_off(table: DataFrame, scale: float, discount: list[float]) -> DataFrame:
    """For bigrams that back off, their context's weight, sent to their slice (kind away); contexts never seen in training weigh 0."""

    def run(group: pa.Table) -> pa.Table:
        kinds = group.column("kind").to_pylist()
        data = [_unpack(p.as_py()) for p in group.column("payload")]
        own = [d for k, d in zip(kinds, data, strict=True) if k == "contexts"]
        one, at = np.unique(np.concatenate([d["key"] for d in own]) if own else np.zeros(0, np.uint64), return_inverse=True)
        total = {k: np.bincount(at, weights=np.concatenate([d[k] for d in own]), minlength=len(one)) if own else np.zeros(0) for k in SUMS}
        value = _weights(total, scale, discount)
        out = [_rows("away", -1, [])]
        off = [d for k, d in zip(kinds, data, strict=True) if k == "off"]
        if off:
            key = np.concatenate([d["key"] for d in off])
            found, there = _lookup(key, {"key": one})
            weights = np.zeros(len(found))
            weights[there] = value[found[there]]
            index, of = np.concatenate([d["index"].astype(np.int64) for d in off]), np.concatenate([d["slices"][d["which"]] for d in off])
            bucket = np.repeat([int(d["bucket"][0]) for d in off], [len(d["key"]) for d in off])
            order = np.argsort(of, kind="stable")
            begin = np.flatnonzero(np.concatenate([[True], of[order][1:] != of[order][:-1]]))
            for lo, hi in zip(begin, np.append(begin[1:], len(order)), strict=True):
                mine = order[lo:hi]
                out.append(_rows("away", int(of[mine[0]]), [(0, None, _pack(bucket=_narrow(bucket[mine]), index=_narrow(index[mine]), value=weights[mine]))]))
        return pa.Table.from_batches(out)

    return table.where("kind in ('contexts', 'off')").groupBy("bucket").applyInArrow(run, SCHEMA)


def _hot_weights(table: DataFrame, hot: np.ndarray, pairs: dict[str, np.ndarray], words: dict[str, np.ndarray], scale: float, discount: list[float]) -> dict[str, np.ndarray]:
    """The weights of frequent contexts and of the start: as many rows come to the driver as there are such contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column("payload"):
                d = _unpack(payload.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(d["key"].view(np.int64)), *[pa.array(d[k].astype(np.float64)) for k in SUMS]], ["key", *SUMS])

    kind = "key long, " + ", ".join(f"{k} double" for k in SUMS)
    rows = table.where("kind = 'hot'").select("payload").mapInArrow(run, kind).groupBy("key").agg(*[F.sum(k).alias(k) for k in SUMS]).collect()
    total = {k: np.zeros(len(hot)) for k in SUMS}
    for r in rows:
        at = int(np.searchsorted(hot, np.int64(r["key"]).view(np.uint64)))
        for k in SUMS:
            total[k][at] += r[k]
    if len(pairs["key"]):  # bigrams counted beforehand follow frequent contexts
        at, seen = np.searchsorted(hot, pairs["first"]), pairs["count"] > 0
        for r in range(1, CUT + 1):
            np.add.at(total[f"r{r}"], at[pairs["count"] == r], 1)
        np.add.at(total["big"], at, np.where(pairs["count"] > CUT, pairs["count"], 0))
        np.add.at(total["mass"], at[seen], words["count"][_lookup(pairs["second"][seen], words)[0]] + BASE)
    # a context never seen in training has no sums: it backs off with weight 1
    left = sum(total[k] for k in SUMS if k != "mass") > 0
    value = np.zeros(len(hot))
    value[left] = _weights({k: v[left] for k, v in total.items()}, scale, discount)
    return {"key": hot, "value": value}


def _score(parts: DataFrame, rows: int, scale: float, discount: list[float], hot: dict[str, np.ndarray]) -> DataFrame:
    """One row for each document: the counts and weights of its slice's bigrams, added up over its tokens."""
    unit, start = math.log10(scale), math.log10(rows) if rows else 0.0
    kept = np.log10(np.concatenate([[1.0], discount]))

    def run(group: pa.Table) -> pa.Table:
        kinds, payloads, out = group.column("kind").to_pylist(), group.column("payload"), None
        ids, at = next((x, k) for k, x in enumerate(group.column("ids").to_pylist()) if x is not None)
        stands = _unpack(payloads[at].as_py())
        found = {"counts": [], "away": [], "hotoff": []}
        for kind, payload in zip(kinds, payloads, strict=True):
            if kind in found:
                found[kind].append(_unpack(payload.as_py()))
        del group, payloads
        counts = sorted(found["counts"], key=lambda d: int(d["bucket"][0]))
        n, of = len(ids), np.repeat
        c12 = np.concatenate([d["c12"] for d in counts]).astype(np.int64) if counts else np.zeros(0, dtype=np.int64)
        c2 = np.concatenate([d["c2"] for d in counts]).astype(np.int64) if counts else np.zeros(0, dtype=np.int64)
        where, offset = np.array([int(d["bucket"][0]) for d in counts]), np.concatenate([[0], np.cumsum([len(d["c12"]) for d in counts])]).astype(np.int64)
        logged = np.log10(c2 + BASE) - unit
        # each word is also the context of what follows; contexts of tokens that back off have their count in the weight
        context = np.where((c2 > 0) & ~stands["end"], np.log10(np.maximum(c2, 1)), 0.0)
        base = of(logged, stands["second_times"])
        value = np.where(c12 > CUT, np.log10(np.maximum(c12, 1)) + math.log10(1 - EPSILON), kept[np.minimum(c12, CUT)])
        value = np.where(c12 > 0, value, base) - of(context, stands["second_times"])
        for d in (*found["away"], *found["hotoff"]):
            weight = d["value"] if "value" in d else hot["value"][np.searchsorted(hot["key"], d["key"])]
            value[offset[np.searchsorted(where, d["bucket"])] + d["index"].astype(np.int64)] += weight
        row = stands["row"].astype(np.int64)
        total = lambda v: np.bincount(row, weights=of(v, stands["times"]), minlength=n)
        known = total(of((c2 > 0).astype(np.float64), stands["second_times"]))
        out = {"doc_id": pa.array(ids, pa.string()), "tokens": pa.array(stands["tokens"].astype(np.int64)), "known": pa.array(known.astype(np.int64)), "base": pa.array(total(base)), "score": pa.array(total(value) - start), "off": pa.array(total((c12 == 0).astype(np.float64)).astype(np.int64))}
        trim()
        return pa.table(out)

    return parts.groupBy("slice").applyInArrow(run, "doc_id string, tokens long, known long, base double, score double, off long")


def score_documents(docs: DataFrame, bucket_tokens: int = 1_500_000, least_buckets: int = 16) -> DataFrame:
    """The operator: learns from rows whose crc32(doc_id) mod 10 is not 0, scores every row.

    Every token of every text counts; ``bucket_tokens`` sets how many a task holds at a time.
    """
    kind = docs.schema["doc_id"].dataType
    held = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", (fold("doc_id", 10) != 0).alias("train"))
    with settings(docs.sparkSession, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS)}):
        rows, tokens, every, words, pairs = _frequent(held, bucket_tokens)
    buckets = max(least_buckets, -(-every // bucket_tokens))
    hot = np.unique(np.append(words["key"], START))
    table = stored(_evaluate(_deal(held, buckets, words, pairs), buckets, words, hot), "lm-counts", BATCH_ROWS)
    total = [pickle.loads(r["payload"]) for r in table.where("kind = 'totals'").select("payload").collect()]  # one for each bucket
    distinct = sum(t["distinct"] for t in total) + int((words["count"] > 0).sum())
    scale = tokens + BASE * (distinct + 1)
    counts = [sum(t[f"n{r}"] for t in total) + int((pairs["count"] == r).sum()) for r in range(1, CUT + 2)]
    discount = discounts(counts)
    weights = _hot_weights(table, hot, pairs, words, scale, discount)
    parts = table.where("kind in ('ids', 'counts', 'hotoff')").unionByName(_back_off(table, scale, discount))
    out = _score(parts, rows, scale, discount, weights)
    doc_id = F.col("doc_id").cast(kind)
    return out.select(doc_id.alias("doc_id"), (fold(doc_id, 10) == 0).alias("held_out"), F.col("tokens").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score", F.col("off").alias("n_backed_off"))
