"""Packing documents into fixed-length training sequences.

Method.  Documents are tokenised and cut into pieces of at most ``capacity`` ids (every
multiple of the capacity is a cut).  The pieces are dealt at random into groups of bounded
size, and each group packs its own by first-fit decreasing: a tournament tree over the bins'
free capacities finds the first bin with room in logarithmic time.

Tokenising works on the distinct space-separated chunks of a slice of text.  The tokenizer
drops white space and none of its patterns crosses ASCII white space, so a text's ids are those
of its chunks in a row.

Defined results
* null or empty text: one piece of one id, the end id;
* repeated rows are packed each for itself (their groups follow from the row's place in the
  input, not from its contents, and are stored with the pieces before any is packed); equal lengths
  go in the order of (doc_id, start);
* no rows: no pieces.  Columns other than doc_id and text are neither read nor needed.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import Words, mix64, stored, text_slices, trim

CAPACITY = 4096
END_ID = 2
_ENCODERS: dict[str, Encoder] = {}


def public_tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: A letter or digit, then full stops and commas: the tokenizer always cuts between them.
_TAIL = r"([a-z0-9\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}])[.,]+$"


class Encoder:
    """Ids of chunks.  Those of recent words are remembered, across tasks: two generations of ``most`` words each at most."""

    def __init__(self, path: str, most: int = 500_000):
        self.tokenizer, self.most, self.young, self.old = _tokenizer(path), most, {}, {}

    def _word_ids(self, words: list[str]) -> list[bytes]:
        young, old = self.young, self.old
        fresh = []
        for word in words:
            if word not in young:
                if word in old:
                    young[word] = old[word]
                else:
                    fresh.append(word)
        for i in range(0, len(fresh), 20_000):
            part = fresh[i : i + 20_000]
            for word, found in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                young[word] = array("I", found.ids).tobytes()
        out = [young[w] for w in words]
        if len(young) > self.most:
            self.old, self.young = young, {}
        return out

    def ids(self, chunks: pa.Array) -> list[bytes]:
        """Little-endian 32-bit ids of each chunk.

        The tokenizer lower-cases what isn't the name of a special token; stops and commas after a word
        are taken by themselves, so that a word is met in one form.
        """
        words = pc.if_else(pc.match_substring(chunks, "<|"), chunks, pc.ascii_lower(chunks))
        stems = pc.replace_substring_regex(words, _TAIL, r"\1")
        coded = stems.dictionary_encode()
        found = self._word_ids(coded.dictionary.to_pylist())
        out = [found[k] for k in coded.indices.to_pylist()]
        longer = np.flatnonzero(pc.not_equal(pc.binary_length(words), pc.binary_length(stems)).to_numpy(zero_copy_only=False))
        at = pa.array(longer)
        tails = [w[len(t) :] for w, t in zip(words.take(at).to_pylist(), stems.take(at).to_pylist(), strict=True)]
        known = dict(zip(distinct := list(set(tails)), self._word_ids(distinct), strict=True))
        for k, tail in zip(longer.tolist(), tails, strict=True):
            out[k] += known[tail]
        return out


def _encoder(path: str, most: int = 500_000) -> Encoder:
    """One for each Python process, whose size may change; another tokenizer takes its place."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path, most)
    _ENCODERS[path].most = most
    return _ENCODERS[path]


def documents_ids(words: Words, encoder: Encoder, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows in a row, each row's with the end id after them; and where each row's begin (n + 1)."""
    found = encoder.ids(words.distinct)
    flat = np.frombuffer(b"".join(found), dtype="<u4")
    size = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
    begin = np.concatenate([[0], np.cumsum(size)])
    total = (words.row_sums(size) if len(found) else np.zeros(words.rows, dtype=np.int64)) + 1
    starts = np.concatenate([[0], np.cumsum(total)])
    out = np.full(starts[-1], end_id, dtype="<u4")
    if len(found):
        own = size[words.code]
        at = np.repeat(begin[words.code] - np.concatenate([[0], np.cumsum(own)[:-1]]), own) + np.arange(own.sum())
        inner = np.ones(starts[-1], dtype=bool)
        inner[starts[1:] - 1] = False
        out[inner] = flat[at]
    return out, starts


def pieces(docs: DataFrame, tokenizer_path: str, groups: int, capacity: int = CAPACITY, end_id: int = END_ID, seed: int = 11, remembered: int = 500_000, slice_bytes: int = 12 << 20, forget: bool = False) -> DataFrame:
    """The pieces of every document, each with its random group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, context, made = _encoder(tokenizer_path, remembered), TaskContext.get(), 0
        place = np.uint64(((context.partitionId() if context else 0) << 36) ^ (seed << 20))
        for batch in batches:
            for part in text_slices(batch, limit=slice_bytes):
                ids, starts = documents_ids(Words(part.column("text")), encoder, end_id)
                total = np.diff(starts)
                count = -(-total // capacity)
                row = np.repeat(np.arange(len(total)), count)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = nth * capacity
                length = np.minimum(capacity, total[row] - start)
                data, at = memoryview(ids.tobytes()), (starts[row] + start) * 4
                crc = [zlib.crc32(data[a : a + 4 * n]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                group = mix64(place + np.arange(made, made + len(row), dtype=np.uint64)) % np.uint64(groups)
                made += len(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(total[row]), pa.array(group.astype(np.int64))],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "pack_group"],
                )
        if forget:
            del encoder
            _ENCODERS.clear()
            trim()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, pack_group long")


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item; items must come longest first.

    The tournament tree is an array heap: leaf ``width + b`` is bin b's free room, each inner
    node the larger of its children, so a descent that prefers the left child ends at the first fit.
    """
    width = 1
    while width < max(1, len(lengths)):
        width *= 2
    room = [capacity] * (2 * width)
    bins, offsets = [], []
    for length in lengths:
        node = 1
        while node < width:
            node *= 2
            if room[node] < length:
                node += 1
        bins.append(node - width)
        offsets.append(capacity - room[node])
        room[node] -= length
        node //= 2
        while node:
            left, right = room[2 * node], room[2 * node + 1]
            best = left if left >= right else right
            if room[node] == best:
                break
            room[node] = best
            node //= 2
    return bins, offsets


def padded(total: int, capacity: int = CAPACITY) -> int:
    """Length of a sequence after padding: its own where that is a power of two, else the capacity."""
    return total if total & (total - 1) == 0 else capacity


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, group_docs: int = 2048, remembered: int = 500_000, slice_bytes: int = 12 << 20, batch_rows: int | None = None, forget: bool = False) -> DataFrame:
    """The operator: one row for each piece with its sequence_id and offset, and the sequence's tokens and padded length.

    ``group_docs`` is the mean number of documents in a group that one task packs at a time.  ``remembered`` words and
    ``slice_bytes`` of text at a time trade a worker's memory for its time; ``batch_rows`` bounds the documents that it gets
    at a time, and with ``forget`` it holds no tokenizer between tasks.
    """
    groups = max(1, -(-docs.count() // group_docs))
    # groups follow from a row's place in a task: they are dealt once, so a lost executor's pieces come back to the same ones
    cut = stored(pieces(docs, tokenizer_path or public_tokenizer_path(), groups, capacity, remembered=remembered, slice_bytes=slice_bytes, forget=forget), "pieces", batch_rows)

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = first_fit_decreasing(group.column("length").to_pylist(), capacity)
        bins, length = np.array(bins, dtype=np.int64), group.column("length").to_numpy()
        total = np.bincount(bins, weights=length).astype(np.int64)
        whole = np.array([padded(int(t), capacity) for t in total], dtype=np.int64)
        base = int(group.column("pack_group")[0].as_py()) << 32
        return pa.table(
            {
                **{c: group.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")},
                "sequence_id": pa.array(base + bins),
                "offset": pa.array(np.array(offsets, dtype=np.int64)),
                "sequence_tokens": pa.array(total[bins]),
                "sequence_padded": pa.array(whole[bins]),
            }
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return cut.groupBy("pack_group").applyInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, sequence_padded long")
