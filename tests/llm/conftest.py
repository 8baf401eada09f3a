from __future__ import annotations

import pytest

#: Names that operators use for columns of their own.
CLASHING = [
    "_found", "component", "_id", "_row", "_draw", "_label", "_copy", "_shard", "_order", "_words", "_node", "_token", "_mid", "_part", "_same_doc_id", "_group", "group", "node", "row", "rows", "term", "tf", "t", "at", "total", "size", "slot",
    "shard", "shards", "target", "source_size", "taken", "score", "predicted", "quality", "lang_pred", "held_out", "spans", "shingles", "n_shingles", "component_id", "gid", "prefix", "n", "key", "block", "levels", "leaf", "root", "piece", "length", "ids",
]
FIELDS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING) + ", words int"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and very long texts, repeated rows, and columns whose names operators might use."""
    rows = [
        (1, "The cat sat on the mat. It sat there all day long.\nAnd then it left the house.", "en", "a"),
        (2, "The cat sat on the mat. It sat there all day long.\nAnd then it left the house.", "en", "a"),
        (3, None, "en", "a"),
        (4, "", "de", None),
        (5, " \t\n ", None, "b"),
        (6, "12 34 !!", "fr", "b"),
        (7, "Der Hund und die Katze sind in dem Haus und nicht auf der Straße.", "de", "b"),
        (7, "Der Hund und die Katze sind in dem Haus und nicht auf der Straße.", "de", "b"),
        (None, "no id here at all", "en", "c"),
        (9, "शेती आणि हवामान", "mr", "c"),
        (10, "word " * 30_000, "en", "a"),
        (11, "x" * 200_000, None, "a"),
        (12, "one", "en", "a"),
        (13, "Released under the MIT License. " + "filler text goes here and on " * 20, "en", "d"),
    ]
    full = [(i, t, lang, s, None if t is None else len(t), *["clash"] * len(CLASHING), 1) for i, t, lang, s in rows]
    return spark.createDataFrame(full, FIELDS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], FIELDS)


@pytest.fixture(scope="session")
def small(spark):
    """The whole documents table of the smallest size."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
