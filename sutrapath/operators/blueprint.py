"""Audit of page blueprints: five scores and a grade, worked out from their JSON and the suggestions that were measured."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as cls
from ..functions.text import bound, contains_any

#: Phrases that say nothing, headings that fit any page, and patterns of what is specific, each with its name.
FLUFF = [
    "in this article", "in conclusion", "it is important to remember", "there are various factors", "it depends on your needs", "as we all know", "without further ado",
    "या लेखात आपण पाहणार आहोत", "निष्कर्ष म्हणून सांगायचे तर", "महत्त्वाचे म्हणजे", "इस लेख में हम जानेंगे",
]
GENERIC = ["introduction", "overview", "conclusion", "summary", "प्रस्तावना", "निष्कर्ष", "माहिती"]
SPECIFIC = [
    (r"(₹|rs\.?|inr|रुपये|कीमत|दर)", "₹ INR Pricing & Value Brackets"),
    (r"(\p{Nd}+\s*(v|ah|hp|w|l|kw|kg|volt|amp|लिटर|वॉट|तास|गुंठे|एकर|टक्के|%))", "Technical Units & Capacity (V/Ah/HP/L/%)"),
    (r"(gov\.in|mahadbt|pm|kisan|dbt|7/12|८-अ|आधार|पॅन|gst|isi|होलोग्राम)", "Official Portals & Verification Markers"),
]
NO_FLUFF = "Zero Generic AI Filler Phrases"
GRADES = [(90, "A+ (Publication Ready - High Authority)"), (80, "A (High Qualitative Consistency)"), (70, "B (Satisfactory Grounding)"), (0, "C (Requires Editorial Refinement)")]
#: Headings that stand for a part of the page, by what they hold.
HEADINGS = {
    "documents": ["कागदपत्र", "document"], "mistakes": ["चूक", "mistake", "pitfall"], "verdict": ["निष्कर्ष", "verdict"],
    "comparison": ["तुलना", "vs", "comparison"], "choice": ["निवड", "choice"], "year": ["2026"],
}
#: Suggestions that are looked at, and how many of them a page is expected to answer.
SAMPLE, EXPECTED = 35, 12

_LISTS = ["paisa_vasool_criteria", "verification_checklist", "prerequisites_and_documents", "step_sequence", "rejection_pitfalls", "comparison_matrix", "who_should_buy", "core_pillars"]
_TEXTS = ["title", "meta_description", "h1", "subsidy_eligibility", "product_review_schema", "howto_schema", "verdict_summary", "regulatory_2026_landscape"]
#: Members of other types are read as their JSON text.
SCHEMA = ", ".join([f"{t} string" for t in _TEXTS] + [f"{x} array<string>" for x in _LISTS] + ["outline array<struct<heading:string,key_points:array<string>,queries_answered:array<string>>>", "faq array<struct<question:string,q:string,answer:string,a:string>>"])


def _given(text: Column) -> Column:
    """Whether a member says anything: it is there and neither empty, false nor zero."""
    return F.coalesce(~F.trim(text).isin("", "[]", "{}", "false", "null", "0"), F.lit(False))


def _count(items: Column) -> Column:
    return F.coalesce(F.size(items), F.lit(0))


def _points(*checks: tuple[Column, int]) -> Column:
    return sum((F.when(check, points).otherwise(0) for check, points in checks), F.lit(0))


def audit(rows: DataFrame, language: str = "mr") -> DataFrame:
    """``rows`` (effective_intent, blueprint: JSON text, suggestions: array, ...) with scores, grade, and what was found.

    Text that isn't JSON, or null, is an empty blueprint.  Scores are 25 points for what the intent asks for, 25 for
    suggestions that sections answer, 20 for specifics without fluff, 15 for schemas, 15 for structure and script.
    """
    b = F.col("_b")
    empty = F.array().cast("array<string>")
    out = rows.withColumn("_b", F.coalesce(F.from_json("blueprint", SCHEMA), F.from_json(F.lit("{}"), SCHEMA)))
    words = lambda c: F.coalesce(c, F.lit(""))
    sections = F.coalesce(b["outline"], F.array().cast("array<struct<heading:string,key_points:array<string>,queries_answered:array<string>>>"))
    questions = F.coalesce(b["faq"], F.array().cast("array<struct<question:string,q:string,answer:string,a:string>>"))
    said = F.concat(
        F.array(words(b["title"]), words(b["meta_description"]), words(b["h1"])),
        F.flatten(F.transform(sections, lambda s: F.concat(F.array(words(s["heading"])), F.coalesce(s["key_points"], empty)))),
        F.flatten(F.transform(questions, lambda f: F.array(words(F.coalesce(f["question"], f["q"])), words(F.coalesce(f["answer"], f["a"]))))),
    )
    answered = F.array_distinct(F.filter(F.transform(F.flatten(F.transform(sections, lambda s: F.coalesce(s["queries_answered"], empty))), lambda q: F.trim(q)), lambda q: q != ""))
    out = out.withColumns({"_said": F.array_join(said, " "), "_heads": F.transform(sections, lambda s: words(s["heading"])), "_answered": answered, "_sections": F.size(sections), "_faq": F.size(questions)})

    intent, sections, faq = F.col("effective_intent"), F.col("_sections"), F.col("_faq")
    headed = lambda kind: F.exists("_heads", lambda h: contains_any(F.lower(h), HEADINGS[kind]))
    review = b["product_review_schema"]
    rated = F.lit(False)
    for name in ("pros", "cons", "rating"):
        rated = rated | _given(F.get_json_object(review, f"$.{name}"))
    rated = rated | F.coalesce(F.get_json_object(review, "$['@type']") == "Product", F.lit(False))
    many = lambda name: _count(b[name]) >= 2
    some = lambda name: _count(b[name]) >= 1
    by_intent = (
        F.when(intent == "commercial", _points((many("paisa_vasool_criteria"), 7), (many("verification_checklist"), 6), (_given(b["subsidy_eligibility"]), 6), (rated, 6)))
        .when(intent == "howto", _points((many("prerequisites_and_documents") | headed("documents"), 8), (many("rejection_pitfalls") | headed("mistakes"), 8), (many("step_sequence") | _given(F.get_json_object(b["howto_schema"], "$.steps")) | (sections >= 3), 9)))
        .when(intent == "comparison", _points((_given(b["verdict_summary"]) | headed("verdict"), 8), (some("comparison_matrix") | headed("comparison"), 9), (some("who_should_buy") | headed("choice"), 8)))
        .otherwise(_points((some("core_pillars") | (sections >= 4), 12), (_given(b["regulatory_2026_landscape"]) | headed("year") | (faq >= 3), 13)))
    )

    # sections answer queries; of the suggestions only how many there are decides, those that are answered are told beside
    asked = F.slice(F.coalesce("suggestions", empty), 1, SAMPLE)
    expected = F.least(F.size(asked), F.lit(EXPECTED))
    coverage = F.when(F.size(asked) == 0, 100).otherwise(F.least(F.lit(100), F.bround(F.size("_answered") / expected * 100, 0).cast("int")))
    grounding = F.when(F.size(asked) == 0, 25).otherwise(F.least(F.lit(25), F.bround(F.col("coverage_pct") / 100 * 25, 0).cast("int")))

    fluff = F.filter(F.array(*[F.lit(p) for p in FLUFF]), lambda p: F.lower("_said").contains(p))
    hits = [F.col("_said").rlike(f"(?i){pattern}") for pattern, _ in SPECIFIC]
    points = _points(*[(hit, 5) for hit in hits])
    specificity = F.when(F.size("fluff_detected") == 0, points + 5).otherwise(F.greatest(F.lit(0), points + 5 - 2 * F.size("fluff_detected")))
    metrics = F.array_compact(F.array(*[F.when(hit, F.lit(name)) for hit, (_, name) in zip(hits, SPECIFIC, strict=True)], F.when(F.size("fluff_detected") == 0, F.lit(NO_FLUFF))))

    schemas = _points((faq >= 2, 8)) + F.when((intent == "commercial") & _given(review), 7).when((intent == "howto") & (_given(b["howto_schema"]) | (sections >= 3)), 7).when(faq >= 3, 7).otherwise(0)
    generic = F.exists("_heads", lambda h: F.lower(F.trim(h)).isin(GENERIC))
    native = F.col("_said").rlike("[ऀ-ॿ]") if cls.spec(language)["consonants"] == "devanagari" else F.lit(True)
    rigor = _points((sections >= 3, 5), (~generic, 5), (native, 5))

    out = out.withColumns({"coverage_pct": coverage, "fluff_detected": fluff, "intent_score": by_intent, "schema_score": schemas, "vernacular_score": rigor})
    out = out.withColumns({"grounding_score": grounding, "specificity_score": specificity, "metrics_detected": metrics, "answered_queries_count": F.size("_answered"), "answered_suggestions": F.array_intersect(asked, F.col("_answered"))})
    total = sum((F.col(f"{k}_score") for k in ("intent", "grounding", "specificity", "schema", "vernacular")), F.lit(0))

    def grade(score: Column) -> Column:
        name = F.lit(GRADES[-1][1])
        for least, text in reversed(GRADES[:-1]):
            name = F.when(score >= least, text).otherwise(name)
        return name

    out = out.withColumn("overall_score", F.least(F.lit(100), F.greatest(F.lit(0), total))).withColumn("grade", bound(F.col("overall_score"), grade))
    return out.drop("_b", "_said", "_heads", "_answered", "_sections", "_faq")
