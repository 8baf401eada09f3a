"""Licenses, fingerprints, n-gram join, packing, mixing."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sutrapath.llm import doc_fingerprint, license_scan, mixing, ngram_join, packing
from sutrapath.llm import queries as registered
from sutrapath.llm.components import components
from tests.compare import rows as plain
from tests.compare import views

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registered.ORACLES))
def test_equals_sql(spark, name):
    mine, other = registered.QUERIES[name](spark, SF).toPandas(), views(SF).sql(registered.ORACLES[name]).df()
    assert plain(mine) == plain(other)


def test_licenses_odd_rows(odd, none):
    got = license_scan.scan(odd).collect()
    assert [(r["doc_id"], r["license_id"], r["containment"], r["first_word"]) for r in got] == [(13, "MIT", 1.0, 0)]
    assert license_scan.scan(none).count() == 0
    with pytest.raises(ValueError, match="fewer than"):
        license_scan.scan(odd, {"x": "too short"})


def test_licenses_nearly_verbatim(spark):
    text = license_scan.TEMPLATES["MIT-grant"].replace("Software without", "Program without")
    docs = spark.createDataFrame([(1, "lorem ipsum " * 33 + text + " dolor" * 50), (2, text[: len(text) // 2])], "doc_id long, text string")
    got = license_scan.scan(docs).collect()
    assert [(r["doc_id"], r["license_id"]) for r in got] == [(1, "MIT-grant")] and 0.8 <= got[0]["containment"] < 1


def test_bands_and_anchors():
    for text in license_scan.TEMPLATES.values():
        words = license_scan.template_words(text)
        shingles, window = license_scan.template_shingles(words), license_scan.window_words(words)
        n = license_scan.bands_needed(len(shingles), window, 0.8, 1e-6)
        held = math.ceil(0.8 * len(shingles))
        assert (1 - held / (window - 4 + len(shingles) - held)) ** n <= 1e-6
        marks = license_scan.anchors(shingles, 0.8)
        assert sum(not set(s.split()) & set(marks) for s in shingles) < 0.8 * len(shingles)


def units(text):
    """Digests of a text's paragraphs, by another library."""
    return {np.uint64(xxhash.xxh64_intdigest(p.encode(), seed=42)).view(np.int64).item() for p in re.findall(doc_fingerprint.PARAGRAPH, text)}


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def recover(fingerprint):
    """The digests that a printed fingerprint holds, by peeling each of its blocks."""

    def salted(key, salt):
        return xxhash.xxh64_intdigest(salt.to_bytes(4, "little"), seed=xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), seed=42))

    out = set()
    for level, cells in doc_fingerprint.cells_of(fingerprint):
        width = len(cells) // 3
        held = [(int(n), int(x), int(c)) for n, x, c in cells]
        todo = True
        while todo:
            todo = {x for n, x, c in held if n == 1 and c == salted(x, 101) & 0xFFFFFFFF}
            for x in todo:
                h, c = salted(x, level), salted(x, 101) & 0xFFFFFFFF
                for t in range(3):
                    at = t * width + (h >> 16 * t & width - 1)
                    held[at] = (held[at][0] - 1, held[at][1] ^ x, held[at][2] ^ c)
            out |= todo
        assert not any(any(cell) for cell in held)
    assert len(out) == int(fingerprint.split(" ")[0].split("/")[0])
    return out


def check_fingerprints(docs, got):
    texts = [(i, t or "") for i, t in sorted(docs)]
    by = {r["doc_id"]: r for r in got}
    for k, (i, text) in enumerate(texts):
        after = texts[(k + 1) % len(texts)][1]
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        r = by[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        own, other, following = (recover(x["fingerprint"]) if k != 1 else recover(r["edited_fingerprint"]) for k, x in enumerate((r, r, by[texts[(k + 1) % len(texts)][0]])))
        assert (own, other, following) == (units(text), units(edited), units(after))
        assert r["near_edited"] == pytest.approx(likeness(own, other)) and r["near_next"] == pytest.approx(likeness(own, following))
        if "edited_difference" in r:
            d, n = r["edited_difference"], r["next_difference"]
            assert sorted(d["plus"]) == sorted(own - other) and sorted(d["minus"]) == sorted(other - own) and sorted(n["plus"]) == sorted(own - following) and sorted(n["minus"]) == sorted(following - own)


def test_fingerprints_equal_brute_force(spark, small):
    check_fingerprints([(r["doc_id"], r["text"]) for r in small.collect()], doc_fingerprint.fingerprints(small, recovered=True).collect())


def test_insertions_move_few_paragraphs(small):
    """Cuts follow the content: a word put in front changes the paragraphs around it only."""
    text = max((r["text"] or "" for r in small.collect()), key=len).replace("\n", " ")
    before, after = units(text), units("inserted " + text)
    assert len(before) > 50 and len(before ^ after) <= 12


@pytest.mark.parametrize("first, last", [(0x4E00, 0x9FA5), (0x0E01, 0x0E2E), (0x3041, 0x3096), (0x61, 0x7A)])
def test_insertions_in_text_without_spaces(spark, first, last):
    """One letter more at the front or in the middle leaves nearly all digests, in scripts without spaces and in long runs of letters."""
    draw = np.random.default_rng(2)
    text = "".join(chr(c) for c in draw.integers(first, last + 1, 20_000))
    rows = [(0, text), (1, chr(first) + text), (2, text[:9000] + chr(first) + text[9000:])]
    frame = spark.createDataFrame(rows, "i long, t string").select("i", doc_fingerprint.digests(F.col("t")).alias("d"))
    kept = {r["i"]: set(r["d"]) for r in frame.collect()}
    assert len(kept[0]) > 80
    assert all(len(kept[0] & kept[i]) >= len(kept[0]) - 4 for i in (1, 2))


def test_difference_retries_wider(spark):
    """From a width that can't hold the difference, comparison goes on to wider sketches until they peel."""
    rng = np.random.default_rng(2)
    rows = []
    for common, left, right in [(0, 0, 0), (30, 0, 0), (500, 3, 0), (40, 40, 40), (0, 300, 280), (2000, 700, 1)]:
        keys = rng.integers(-(2**63), 2**63, common + left + right).tolist()
        rows.append((sorted(keys[: common + left]), sorted(keys[:common] + keys[common + left :])))
    frame = spark.createDataFrame(rows, "l array<long>, r array<long>")
    for r, (a, b) in zip(frame.select("l", "r", doc_fingerprint.difference(F.col("l"), F.col("r")).alias("d")).collect(), rows, strict=True):
        assert sorted(r["d"]["plus"]) == sorted(set(r["l"]) - set(r["r"])) and sorted(r["d"]["minus"]) == sorted(set(r["r"]) - set(r["l"]))


def test_fingerprints_odd_rows(spark, odd, none):
    got = doc_fingerprint.fingerprints(odd).collect()
    assert len(got) == odd.count()
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert by[1][0]["fingerprint"] == by[2][0]["fingerprint"] and len(by[7]) == 2 and by[7][0] == by[7][1] and by[3][0]["n_chars"] == 0
    assert doc_fingerprint.fingerprints(none).count() == 0
    one = doc_fingerprint.fingerprints(odd.where("doc_id = 12")).first()
    assert one["near_next"] == 1.0
    unique = [(1, "a\nb\nc"), (2, None), (3, "\n".join(map(str, range(500)))), (4, "\n".join(map(str, range(480, 900))))]
    check_fingerprints(unique, doc_fingerprint.fingerprints(spark.createDataFrame(unique, "doc_id long, text string"), recovered=True).collect())


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def linked(docs, width, percent):
    """Components by comparing all pairs."""
    sets = {i: shingles(t, width) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_join_equals_all_pairs(spark, width, percent):
    rng = np.random.default_rng(3)
    common = [f"c{i}" for i in range(60)]
    docs = []
    for family in range(12):
        base = [f"f{family}w{i}" for i in range(int(rng.integers(5, 120)))] + common * (family % 3 == 0)
        for _ in range(int(rng.integers(2, 12))):
            words = list(base)
            for _ in range(int(rng.integers(0, 4))):
                words[int(rng.integers(len(words)))] = f"e{rng.integers(10**6)}"
            docs.append((len(docs), " ".join(words)))
    docs += [(len(docs) + k, t) for k, t in enumerate(["", None, "a b", "A  b", "a b c d", "x y z w v u", "x y z w v u t"])]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(frame, width, percent).collect()}
    want = linked(docs, width, percent)
    assert got == want
    stays = {r["doc_id"] for r in ngram_join.one_of_each(frame, width, percent).collect()}
    assert stays == {i for i, (_, c) in want.items() if c == i}


def test_join_without_frequencies(spark, small, monkeypatch):
    """The order of shingles changes cost, never links."""
    monkeypatch.setattr(ngram_join, "FREQUENT", 10**9)
    docs = [(r["doc_id"], r["text"]) for r in small.collect()]
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(small).collect()} == linked(docs, 4, 85)


def test_join_odd_rows(odd, none):
    got = ngram_join.join(odd).collect()
    assert len(got) == odd.count()
    by = {r["doc_id"]: r for r in got}
    assert by[2]["component_id"] == 1 and by[3]["n_shingles"] == 0 and by[3]["component_id"] == 3 and by[None]["component_id"] is None
    assert ngram_join.join(none).count() == 0 and ngram_join.one_of_each(none).count() == 0
    kept = ngram_join.one_of_each(odd)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == odd.columns and 2 not in ids and ids.count(7) == 1 and None in ids


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (300, 200), (7, 7), (None, 1)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 300: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_first_fit_equals_scan(lengths):
    lengths = sorted(lengths, reverse=True)
    bins, offsets = packing.first_fit_decreasing(lengths, 50)
    room: list[int] = []
    for n, b, o in zip(lengths, bins, offsets, strict=True):
        k = next((i for i, r in enumerate(room) if r >= n), len(room))
        if k == len(room):
            room.append(50)
        assert (b, o) == (k, 50 - room[k])
        room[k] -= n


def check_packing(docs, got):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.public_tokenizer_path())
    pieces = collections.defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
    for doc_id, texts in docs.items():
        rows = sorted(pieces[doc_id], key=lambda r: (r["start"], r["ids_crc32"]))
        want = []
        for text in texts:
            ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_ID]
            want += [(s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], dtype="<u4").tobytes()), len(ids)) for s in range(0, len(ids), 4096)]
        assert [(r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows] == sorted(want, key=lambda w: (w[0], w[2]))
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"], r["sequence_tokens"], r["sequence_padded"]))
    for rows in sequences.values():
        at = 0
        for offset, length, total, padded in sorted(rows):
            assert offset == at
            at += length
        assert at == total <= 4096 and padded == (total if total & (total - 1) == 0 else 4096)
    return sum(r["length"] for r in got), len(sequences)


def test_packing_whole_table(small):
    docs = collections.defaultdict(list)
    for r in small.collect():
        docs[r["doc_id"]].append(r["text"])
    tokens, sequences = check_packing(docs, packing.pack(small, group_docs=50).collect())
    assert sequences <= tokens / 4096 * 1.05 + 5


def test_packing_odd_rows(spark, odd, none):
    docs = collections.defaultdict(list)
    for r in odd.collect():
        docs[r["doc_id"]].append(r["text"])
    check_packing(docs, packing.pack(odd).collect())
    assert packing.pack(none).count() == 0
    tricky = [(1, "İ. x, <|endoftext|>. DON'T <|EndOfText|>, 5. ½. ...,, É., ſ. K."), (2, "a b. c"), (3, "<|startoftext|>word.")]
    frame = spark.createDataFrame(tricky, "doc_id long, text string")
    check_packing({i: [t] for i, t in tricky}, packing.pack(frame).collect())


def targets(sizes):
    """Shares by weight, stopped at three times the size, the excess dealt again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        left, w = total - sum(3 * sizes[s] for s in stopped), sum(weight[s] for s in names if s not in stopped)
        share = {s: left * weight[s] / w for s in names if s not in stopped}
        over = {s for s, t in share.items() if t > 3 * sizes[s] + 1e-9}
        if not over:
            return {**share, **{s: 3 * sizes[s] for s in stopped}}
        stopped |= over


def check_mix(docs, got):
    sizes = collections.Counter()
    for r in docs.collect():
        sizes[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    want, taken, source = targets(sizes), collections.Counter(), {r["doc_id"]: r["source"] for r in docs.collect()}
    for r in got:
        s = source[r["doc_id"]]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        taken[s] += r["taken"]
    return {s: (want[s], taken[s]) for s in want}


def near(docs, sums):
    """Whether each source's words come within half of its largest document of its target."""
    largest = collections.Counter()
    for r in docs.collect():
        largest[r["source"]] = max(largest[r["source"]], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")))
    return all(abs(want - got) <= largest[s] / 2 + 1 for s, (want, got) in sums.items())


def test_mixing(small):
    got = mixing.mix(small, block_docs=4).collect()
    assert len(got) == small.count() and near(small, check_mix(small, got))
    drawn = collections.Counter(k for r in got for k in r["shards"])
    assert set(drawn) <= set(range(16)) and len(drawn) > 8 and all(r["taken"] == len(r["shards"]) * r["size"] for r in got)
    again = {r["doc_id"]: (r["taken"], tuple(r["shards"])) for r in mixing.mix(small, block_docs=4).collect()}
    assert again == {r["doc_id"]: (r["taken"], tuple(r["shards"])) for r in got}
    # another tree deals the same draws over shards otherwise, another number of shards too
    other, fewer = mixing.mix(small, block_docs=4, tree_seed=6).collect(), mixing.mix(small, shards=3, block_docs=4).collect()
    assert near(small, check_mix(small, other)) and {r["doc_id"]: tuple(r["shards"]) for r in other} != {i: k for i, (_, k) in again.items()}
    assert {k for r in fewer for k in r["shards"]} == {0, 1, 2}


def test_mixed_documents(small):
    """Whole documents, as often as they are drawn, with repeats apart."""
    got = mixing.mix(small).collect()
    mixed = mixing.mixed_documents(small).collect()
    texts = {r["doc_id"]: r["text"] for r in small.collect()}
    assert collections.Counter(r["doc_id"] for r in mixed) == {r["doc_id"]: len(r["shards"]) for r in got if r["shards"] and r["size"]}
    assert all(r["text"] == texts[r["doc_id"]] for r in mixed)
    ids = [r["doc_id"] for r in mixed]
    assert sum(a == b for a, b in zip(ids, ids[1:])) <= 3 and ids == [r["doc_id"] for r in mixing.mixed_documents(small).collect()]


def test_one_source_of_many(spark):
    """A source with most rows, hundreds of small ones: exact targets, sums near them, quotas whole."""
    rows = [(i, "w " * (1 + i % 7), "big" if i % 3 else f"host{i % 300}") for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(frame, block_docs=16).collect()
    assert near(frame, check_mix(frame, got))


def test_mixing_odd_rows(odd, none):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count() and near(odd, check_mix(odd, got))
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    assert mixing.mixed_documents(odd).columns == odd.columns


def test_hypergeometric_of_any_size(monkeypatch):
    """Beyond numpy's limit, draws have the distribution that numpy's have below it."""
    rng = np.random.default_rng(1)
    want = [mixing.hypergeometric(rng, 700, 1300, 400) for _ in range(4000)]
    monkeypatch.setattr(mixing, "NUMPY_POPULATION", 0)
    got = [mixing.hypergeometric(rng, 700, 1300, 400) for _ in range(4000)]
    assert abs(np.mean(got) - 140) < 0.6 and abs(np.std(got) / np.std(want) - 1) < 0.06
    assert [mixing.hypergeometric(rng, 5, 0, 3), mixing.hypergeometric(rng, 3, 4, 7)] == [3, 3]
    big = [mixing.hypergeometric(rng, 3 * 10**11, 7 * 10**11, 5 * 10**11) for _ in range(50)]
    assert abs(np.mean(big) / 1.5e11 - 1) < 1e-5 and 1e5 < np.std(big) < 4e5


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=1, max_size=6), st.integers(1, 9))
def test_splitting_tree(quotas, shards):
    out = mixing.split_quotas(quotas, shards, seed=4)
    assert out.sum(0).tolist() == quotas and (out >= 0).all()
    assert out.sum(1).max() - out.sum(1).min() <= math.ceil(math.log2(shards)) + 1 if shards > 1 else True
