"""Rule-based classifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as lex
from .text import boundary_pattern, contains_any

#: Words for yes and no in observation tables.
YES = ["y", "yes", "true", "1", "होय", "हाँ", "ஆம்", "అవును", "হ্যাঁ"]
NO = ["n", "no", "false", "0", "नाही", "नहीं", "இல்லை", "కాదు", "না"]


def spec(language: str) -> dict:
    """A language's lists; an unknown code means Marathi."""
    return lex.LANGUAGES.get(language, lex.LANGUAGES["mr"])


def question_terms(language: str) -> list[str]:
    bare = [q.replace("{t}", "").strip() for q in spec(language)["questions"]]
    return list(dict.fromkeys([*lex.QUESTION_WORDS.get(language, []), *bare]))


def is_question(text: Column, language: str = "mr") -> Column:
    """Ends with a question mark, or holds a question word or phrase of the language or a romanised one."""
    roman = r"\b(?:" + "|".join(lex.ROMAN_QUESTION_WORDS) + r")\b"
    ends = F.trim(text).endswith("?") | F.trim(text).endswith("؟")
    return ends | text.rlike(boundary_pattern(question_terms(language))) | F.lower(text).rlike(rf"(?<![a-zA-Z0-9_]){roman}(?![a-zA-Z0-9_])")


def intent(text: Column, language: str = "mr") -> Column:
    """The first intent with a marker; a bare question is informational; else ``unclear``."""
    markers, out = spec(language)["markers"], None
    for name in lex.INTENTS:
        if markers.get(name):
            hit = text.rlike(boundary_pattern(markers[name]))
            out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.when(is_question(text, language), "informational").otherwise("unclear")


def matched_markers(text: Column, name: str, language: str = "mr") -> Column:
    """The markers of an intent that the text holds, in their order."""
    found = [F.when(text.rlike(boundary_pattern([m])), F.lit(m)) for m in spec(language)["markers"].get(name, [])]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def article_shape(name: Column) -> Column:
    out = None
    for k, v in lex.ARTICLE_SHAPES.items():
        out = F.when(name == k, v) if out is None else out.when(name == k, v)
    return out


def buyer_intent(text: Column) -> Column:
    """The first buyer-intent category with a token in the text; null without."""
    lower, out = F.lower(text), None
    for name, words in lex.BUYER_INTENT.items():
        hit = contains_any(lower, [w.lower() for w in words])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def tristate(cell: Column, strict: bool = True) -> Column:
    """Yes, no or blank (null) in several languages; anything else is an error, or null if not ``strict``."""
    value = F.lower(F.trim(cell))
    out = F.when(value.isNull() | (value == ""), F.lit(None).cast("boolean")).when(value.isin(YES), True).when(value.isin(NO), False)
    return out.otherwise(F.raise_error(F.concat(F.lit("not a yes/no value: "), cell)).cast("boolean")) if strict else out


def competition_band(thin: Column, weak: Column, stale: Column) -> Column:
    """Band from at least two of three recorded observations; null with fewer."""
    recorded = sum((c.isNotNull().cast("int") for c in (thin, weak, stale)), F.lit(0))
    return (
        F.when(recorded < 2, F.lit(None).cast("string"))
        .when(weak & thin, "low")
        .when(weak, "medium")
        .when(~weak & ~thin, "very_high")
        .when(~weak, "high")
        .when(thin & stale, "medium")
        .when(~thin & ~stale, "high")
        .otherwise("medium")
    )


def evidence_band(demand: Column) -> Column:
    return F.when(demand.isNull(), "insufficient").when(demand >= 0.5, "strong").when(demand >= 0.25, "moderate").otherwise("weak")


def priority_band(demand: Column, name: Column, competition: Column) -> Column:
    base = F.when(demand >= 0.5, "high").when(demand >= 0.25, "medium").otherwise("low")
    suffix = F.when(competition == "very_high", "/very-high-competition").when(competition == "high", "/high-competition").otherwise("")
    return F.when(demand.isNull(), "needs-measurement").when(name == "navigational", "skip-navigational").otherwise(F.concat(base, suffix))


#: Categories of discovered sites and the words that tell them, the first that matches counts; and of the others.
SITE_CATEGORIES = [
    ("News & Media", ["news", "बातमी", "पत्र", "वृत्त", "tv", "times", "live", "epaper"]),
    ("Finance & Career", ["finance", "शेअर", "पैसा", "नोकरी", "job", "recruitment", "bharti"]),
    ("Agriculture", ["शेती", "krushi", "agri", "मंडी", "बाजार"]),
    ("Government", ["gov", "शासन", "महा", "योजना"]),
    ("Community & Literature", ["साहित्य", "कविता", "कथा", "ज्ञान", "कोश"]),
]
OTHER_CATEGORY = "Blogs & General"


def site_category(title: Column, host: Column) -> Column:
    """Category of a discovered site by words of its title or domain, first match counts."""
    both, out = F.concat_ws("\n", F.lower(title), F.lower(host)), F.lit(OTHER_CATEGORY)
    for name, words in reversed(SITE_CATEGORIES):
        out = F.when(contains_any(both, words), name).otherwise(out)
    return out
