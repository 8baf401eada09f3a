from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sutrapath.functions import classify as cls
from sutrapath.functions import text as tx


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "folded"),
    [("  Foo  BAR ", "foo bar"), ("शे‍ती", "शेती"), ("", ""), (None, None), ("a b", "a b")],
)
def test_fold(spark, text, folded):
    assert one(spark, text, tx.fold) == folded


def test_fold_normal_form(spark):
    assert one(spark, "É", lambda c: tx.fold(c, normal=True)) == "é"


@pytest.mark.parametrize(("text", "key"), [("मराठी शेती", "mrtst"), ("marathi sheti", "mrtst"), ("ab", "ab"), ("é", "é")])
def test_topic_key(spark, text, key):
    assert one(spark, text, tx.topic_key) == key


def test_tokens_keep_vowel_signs(spark):
    assert one(spark, "शेतकरी, कर्ज-माफी x_1", tx.tokens) == ["शेतकरी", "कर्ज", "माफी", "x_1"]


@pytest.mark.parametrize(("text", "script"), [("शेती", "devanagari"), ("abc", "latin"), ("abc शेती", "mixed"), ("!?", "other"), ("தமிழ்", "tamil"), ("", "other"), (None, None)])
def test_script_of(spark, text, script):
    assert one(spark, text, tx.script_of) == script


def test_ratio_is_null_without_text(spark):
    assert one(spark, "", tx.devanagari_ratio) is None
    assert one(spark, "शे a", tx.devanagari_ratio) == 0.5
    assert one(spark, "शे a", lambda c: tx.devanagari_ratio(c, letters_only=True)) == round(2 / 3, 4)


def test_word_boundaries(spark):
    assert one(spark, "पीक विमा का", lambda c: cls.is_question(c, "mr"))
    assert not one(spark, "कापूस", lambda c: cls.is_question(c, "mr"))


@pytest.mark.parametrize(("text", "name"), [("demat price", "transactional"), ("official login", "navigational"), ("zzz", "unclear"), ("zzz?", "informational")])
def test_intent(spark, text, name):
    assert one(spark, text, lambda c: cls.intent(c, "mr")) == name


def test_markers(spark):
    assert one(spark, "buy at best price", lambda c: cls.matched_markers(c, "transactional", "mr")) == ["buy", "price"]


def test_tristate(spark):
    for text, value in (("होय", True), (" NO ", False), ("", None), (None, None)):
        assert one(spark, text, cls.tristate) is value
    with pytest.raises(Exception, match="not a yes/no value"):
        one(spark, "maybe", cls.tristate)


def test_bands(spark):
    rows = spark.createDataFrame([(True, True, None), (None, None, True), (False, False, None), (True, None, True)], "thin boolean, weak boolean, stale boolean")
    assert [r["b"] for r in rows.select(cls.competition_band(F.col("thin"), F.col("weak"), F.col("stale")).alias("b")).collect()] == ["low", None, "very_high", "medium"]


def test_clean_url(spark):
    assert one(spark, "http://A.b//c/?utm_a=1&x=2#f", tx.clean_url) == "http://a.b/c/?x=2"
    assert one(spark, "mailto:x@y", tx.clean_url) is None


def test_composed_and_decomposed_have_one_key(spark):
    import unicodedata

    words = ["café", "Ångström", "क़लम", "안녕", "Å", "plain", "Straße"]
    rows = [(i, unicodedata.normalize(form, w)) for i, w in enumerate(words) for form in ("NFC", "NFD")] + [(9, None)]
    got = spark.createDataFrame(rows, "n int, t string").select("n", tx.dedup_key(F.col("t")).alias("k"), tx.nfc_all(F.array("t")).alias("a")).collect()
    assert len({(r["n"], r["k"]) for r in got}) == len(words) + 1
    # what the guard lets by is never changed by NFC
    assert all(unicodedata.normalize("NFC", chr(a) + chr(b)) == chr(a) + chr(b) for a in range(0x20, 0x300) for b in range(0x20, 0x300, 7))


def test_rfc_dates(spark):
    rows = [("Sun, 04 Oct 2026 20:00:00 +0530",), ("4 Oct 2026 14:30 GMT",), ("2026-10-04T14:30:00Z",), ("yesterday",), (None,), ("",)]
    got = [r["d"] for r in spark.createDataFrame(rows, "t string").select(F.unix_timestamp(tx.iso_date(F.col("t"))).alias("d")).collect()]
    assert got[0] == got[1] == got[2] == 1791124200 and got[3:] == [None, None, None]
