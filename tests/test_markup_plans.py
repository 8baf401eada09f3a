"""Pages read tag by tag, blueprint audits, cached research, joins by blocks."""

from __future__ import annotations

import itertools
import json
import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from sutrapath.functions import markup
from sutrapath.operators import blocks, blueprint, demand, web


class Plain(HTMLParser):
    """Links as the standard library sees them."""

    def __init__(self):
        super().__init__()
        self.links, self.href, self.parts = [], None, []

    def handle_starttag(self, tag, attrs):
        found = {k: v for k, v in reversed(attrs)}
        if tag == "a" and found.get("href"):
            self.href, self.parts = found["href"], []

    def handle_data(self, data):
        if self.href is not None:
            self.parts.append(data)

    def handle_endtag(self, tag):
        if tag == "a" and self.href is not None:
            self.links.append((self.href, " ".join(" ".join(self.parts).split())))
            self.href = None


PIECES = [
    '<a href="/x">one</a>', "<A HREF='/y' class=b>two <b>bold</b></A>", "<a class=c href=/z?a=1&amp;b=2>three</a>", "<!-- <a href='/no'>no</a> -->", "<p>text &amp; more</p>", "<script>if (a<b) '<a href=\"/no\">'</script>",
    "<style>a > b {}</style>", "<a name=top>no link</a>", '<a href="">empty</a>', "<br/>", "<a title='a > b' href='/q'>four</a>", "<a href=/u>", "</a>", "<svg><svg></svg>hidden</svg>", "<noscript>hidden</noscript>", "\n \t", "a < b", "<!DOCTYPE html>",
]


def test_links_equal_another_parser():
    draw = random.Random(6)
    for _ in range(400):
        page = "".join(draw.choice(PIECES) for _ in range(draw.randrange(1, 15)))
        other = Plain()
        other.feed(page)
        other.close()
        assert [(x["href"], x["text"]) for x in markup.read(page)[3]] == other.links, page


def test_page_parts(spark):
    page = """<!-- <title>no</title> --><HTML LANG=mr-IN><head><svg><title>no</title></svg><title> A &amp;
    B </title><meta content='x "y"' name=Description><meta name=description content=second><meta property="og:image" content=i.png></head>
    <body>shown<script>hidden</script><noscript>hidden<noscript>h</noscript>still</noscript><svg/>too<style>p{}</style></body>"""
    lang, title, meta, _, text = markup.read(page)
    assert (lang, title, text) == ("mr-IN", "A & B", "A & B shown too")
    assert dict(meta) == {"description": 'x "y"', "og:image": "i.png"}
    assert markup.read(None) == markup.read("") == (None, None, [], [], "")
    assert markup.read("<script>never closed <a href=x>y</a>")[3] == [] and markup.read("<a href='x>y</a>")[3] == []
    pages = spark.createDataFrame([(1, "https://a.in/", page), (2, "https://a.in/", None)], "page_id long, url string, html string")
    rows = {r["page_id"]: r for r in web.page_meta(pages).collect()}
    assert rows[1]["description"] == 'x "y"' and rows[1]["og_image"] == "i.png" and rows[2]["title"] is None
    assert web.anchors(pages.limit(0)).count() == 0


def test_blocked_join_equals_a_join(spark):
    """A key with most rows: all pairs, and no key of the joined blocks has more than a bounded number of rows."""
    left = spark.range(900).select(F.when(F.col("id") < 700, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"), F.col("id").alias("a"))
    right = spark.range(500).select(F.when(F.col("id") < 300, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"), F.col("id").alias("b"))
    got = blocks.blocked_join(left, right, "key", most=100).select("a", "b")
    wanted = left.join(right, "key").select("a", "b")
    assert got.count() == wanted.count() and got.exceptAll(wanted).count() == 0


def test_topic_links_equal_all_pairs(spark):
    titles = ["sheti mahiti", "sheti bhav", "kanda bhav", "x", "weather today", "pune", "Loan how to", "tax", "q"]
    intents = ["informational", "howto", "freshness", "commercial", "informational", "unclear", "howto", "informational", "howto"]
    plan = spark.createDataFrame(list(zip(titles, intents, strict=True)), "primary_title string, intent string")
    from sutrapath.functions.text import topic_key

    skeleton = {r["primary_title"]: r["s"] for r in plan.select("primary_title", topic_key(F.col("primary_title")).alias("s")).collect()}
    wanted = []
    for (s, i), (t, j) in itertools.permutations(zip(titles, intents, strict=True), 2):
        near = min(len(skeleton[s]), len(skeleton[t])) >= 2 and set(skeleton[s]) & set(skeleton[t])
        if set(s.lower().split()) & set(t.lower().split()) or (near and i == "informational" and j in ("howto", "freshness", "commercial")):
            wanted.append((s, t))
    assert sorted((r["source_topic"], r["target_topic"]) for r in demand.topic_links(plan).collect()) == sorted(wanted)


# --- blueprints ----------------------------------------------------------------------------------------------


def audited(spark, intent, data, suggestions, language="mr"):
    rows = spark.createDataFrame([(intent, data if isinstance(data, str | None) else json.dumps(data, ensure_ascii=False), suggestions)], "effective_intent string, blueprint string, suggestions array<string>")
    return blueprint.audit(rows, language).first()


def test_blueprint_scores(spark):
    section = lambda h, *q: {"heading": h, "key_points": ["12 hp pump", "₹ 500"], "queries_answered": list(q)}
    full = {
        "title": "शेती पंप", "outline": [section("पंप निवड", "a", "b"), section("किंमत", "c", " c "), section("pm kisan", "d")], "faq": [{"question": "q", "answer": "a"}] * 3,
        "paisa_vasool_criteria": ["x", "y"], "verification_checklist": [{"z": 1}, {"z": 2}], "subsidy_eligibility": "yes", "product_review_schema": {"@type": "Product"},
    }
    row = audited(spark, "commercial", full, ["a", "b", "c", "d"])
    assert (row["intent_score"], row["grounding_score"], row["specificity_score"], row["schema_score"], row["vernacular_score"]) == (25, 25, 20, 15, 15)
    assert row["overall_score"] == 100 and row["grade"].startswith("A+") and row["answered_suggestions"] == ["a", "b", "c", "d"]
    assert row["metrics_detected"] == [name for _, name in blueprint.SPECIFIC] + [blueprint.NO_FLUFF]
    # blanks around a query don't make it another one
    assert row["answered_queries_count"] == 4
    poor = {"outline": [{"heading": " Overview "}], "title": "In conclusion, as we all know", "product_review_schema": {}, "subsidy_eligibility": " "}
    row = audited(spark, "commercial", poor, [f"s{i}" for i in range(40)])
    assert (row["intent_score"], row["grounding_score"], row["specificity_score"], row["schema_score"], row["vernacular_score"]) == (0, 0, 1, 0, 0)
    assert row["fluff_detected"] == ["in conclusion", "as we all know"] and row["grade"].startswith("C")
    # halves are rounded to even: 1 of 8 is 12, whose quarter is 3
    row = audited(spark, "informational", {"outline": [section("2026", "a")]}, [f"s{i}" for i in range(8)])
    assert (row["coverage_pct"], row["grounding_score"], row["intent_score"]) == (12, 3, 13)


@pytest.mark.parametrize("text", [None, "", "no json", "[]", "{}"])
def test_empty_blueprints(spark, text):
    row = audited(spark, "howto", text, None, "en")
    assert (row["intent_score"], row["grounding_score"], row["specificity_score"], row["schema_score"], row["vernacular_score"]) == (0, 25, 5, 0, 10)


# --- research ------------------------------------------------------------------------------------------------


def test_research_asks_once(spark, tmp_path):
    """What is cached isn't asked again; what wasn't measured is; scores don't depend on the cache."""
    asked = []

    def ask(queries):
        asked.append(queries.count())
        out = demand.fixture(queries, "mr")
        return out.withColumn("measured", ~F.col("query").contains("pdf")).withColumn("suggestions", F.when(F.col("measured"), F.col("suggestions")))

    seeds = spark.createDataFrame([(1, "शेती"), (2, "demat"), (3, "weather")], "seed_ord int, seed string")
    path, plain = str(tmp_path / "cache"), sorted(map(str, demand.research(seeds, ask=ask).collect()))
    lost = demand.expand(seeds).where(F.col("query").contains("pdf")).count()
    first = sorted(map(str, demand.research(seeds.where("seed_ord < 3"), ask=ask, cache_path=path).collect()))
    again = sorted(map(str, demand.research(seeds, ask=ask, cache_path=path).collect()))
    every = demand.expand(seeds).count()
    two = demand.expand(seeds.where("seed_ord < 3")).count()
    unmeasured = demand.expand(seeds.where("seed_ord < 3")).where(F.col("query").contains("pdf")).count()
    assert again == plain and set(first) < set(plain) and asked == [every, two, every - two + unmeasured]
    demand.research(seeds, ask=ask, cache_path=path).collect()
    assert asked[-1] == lost


def test_research_within_ceilings(spark):
    seeds = spark.createDataFrame([(i, s) for i, s in enumerate(["शेती", "demat", "weather", "pune"])], "seed_ord int, seed string")
    sizes = {r["seed_ord"]: r["count"] for r in demand.expand(seeds).groupBy("seed_ord").count().collect()}
    scores = demand.research(seeds, max_seeds=3, max_queries=sizes[0] + 2)
    got = {r["seed_ord"]: (r["queries_asked"], r["breadth_comparable"]) for r in scores.collect()}
    assert got == {0: (sizes[0], True), 1: (2, False)}
    assert sorted(r["seed_ord"] for r in demand.not_asked(seeds, scores).collect()) == [2, 3]
