"""Text kernel as column expressions: folding, keys, tokens, scripts, dates.

Python's ``\\w`` is spelt as an explicit class (letters, numbers, underscore, and all of the
Indic blocks, whose vowel signs would otherwise split words); white space likewise.
Null in, null out, except where stated.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from . import lexicons as lex

SPACE = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WORD = r"[\p{L}\p{N}_\x{0900}-\x{0D7F}]"
NOT_WORD = r"[^\p{L}\p{N}_\x{0900}-\x{0D7F}]"

#: No character before U+0300 changes under NFC by itself or with another such one: combining marks begin there.
MAY_CHANGE = r"[^\x{0000}-\x{02FF}]"


def nfc(text: Column) -> Column:
    """Unicode NFC.  Spark has no such function: texts that it can change pass through Arrow."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.str.normalize("NFC")

    return F.coalesce(F.pandas_udf(run, StringType())(F.when(text.rlike(MAY_CHANGE), text)), text)


def nfc_all(texts: Column) -> Column:
    """Unicode NFC of each text of an array, for use before a lambda, which can't call Python."""

    def run(lists: pd.Series) -> pd.Series:
        return lists.map(lambda x: None if x is None else [None if t is None else unicodedata.normalize("NFC", t) for t in x])

    return F.coalesce(F.pandas_udf(run, ArrayType(StringType()))(F.when(F.exists(texts, lambda t: t.rlike(MAY_CHANGE)), texts)), texts)


def fold(text: Column, normal: bool = True) -> Column:
    """Trimmed, lower-case, NFC, without zero-width joiners, white space runs as one space; without ``normal`` for texts in NFC."""
    text = F.lower(F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", ""))
    text = F.regexp_replace(nfc(text) if normal else text, r"[\x{200C}\x{200D}]", "")
    return F.regexp_replace(text, f"{SPACE}+", " ")


def dedup_key(text: Column, normal: bool = True) -> Column:
    """The folded text without spaces and punctuation."""
    return F.regexp_replace(fold(text, normal), f"{NOT_WORD}+", "")


def sibling_key(text: Column, normal: bool = True) -> Column:
    """Latin letters and digits of the folded text, Devanagari consonants transliterated."""
    return F.regexp_replace(F.translate(fold(text, normal), lex.DEVANAGARI_LETTERS, lex.LATIN_LETTERS), "[^a-z0-9]", "")


def topic_key(text: Column, normal: bool = True) -> Column:
    """Consonant skeleton that spellings in either script share; short ones fall back to the sibling or dedup key."""
    key = sibling_key(text, normal)
    bare = F.regexp_replace(F.regexp_replace(key, "[aeiouh]", ""), r"(.)\1+", "$1")
    return F.when(F.length(bare) >= 4, bare).when(F.length(key) >= 2, key).otherwise(dedup_key(text, normal))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(fold(text), F.lit(f"{WORD}+"), F.lit(0))


def boundary_pattern(terms: list[str]) -> str:
    """A case-insensitive pattern of any of the terms as whole words."""
    inner = "|".join(re.escape(t).replace("\\ ", " ").replace("\\-", "-") for t in terms)
    return rf"(?i)(^|{NOT_WORD})(?:{inner})($|{NOT_WORD})"


def _range(script: str) -> str:
    lo, hi = lex.SCRIPT_RANGES[script]
    return rf"\x{{{lo:04X}}}-\x{{{hi:04X}}}"


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with ``value`` computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, rf"{SPACE}|\p{{P}}", "")


def _count(bare: Column, script: str) -> Column:
    return F.length(F.regexp_replace(bare, f"[^{_range(script)}]", ""))


def script_counts(text: Column) -> dict[str, Column]:
    """Characters of each script, white space and punctuation left out."""
    return {s: _count(_bare(text), s) for s in lex.SCRIPT_RANGES}


def script_of(text: Column) -> Column:
    """The script of at least 85 % of the classified characters, ``mixed`` or ``other`` (none)."""
    names = F.array(*[F.lit(s) for s in lex.SCRIPT_RANGES])

    def verdict(counts: Column) -> Column:
        total, top = F.aggregate(counts, F.lit(0), lambda a, n: a + n), F.array_max(counts)
        return F.when(total == 0, "other").when(top / total >= 0.85, F.element_at(names, F.array_position(counts, top).cast("int"))).otherwise("mixed")

    counts = bound(_bare(text), lambda bare: F.array(*[_count(bare, s) for s in lex.SCRIPT_RANGES]))
    return F.when(text.isNotNull(), bound(counts, verdict))


def devanagari_ratio(text: Column, letters_only: bool = False) -> Column:
    """Share of Devanagari among classified characters, 4 places; null without any.

    The Latin range begins at the space, so spaces, digits and punctuation count as Latin unless ``letters_only``.
    """
    every = F.length(F.regexp_replace(text, "[^" + "".join(_range(s) for s in lex.SCRIPT_RANGES) + "]", ""))
    if letters_only:
        every = F.length(F.regexp_replace(text, r"[^\p{L}\p{M}]", ""))
    return F.when(every > 0, F.round(F.length(F.regexp_replace(text, f"[^{_range('devanagari')}]", "")) / every, 4))


def first_match(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The tag of the first rule whose pattern occurs, ignoring case."""
    out = None
    for pattern, tag in rules:
        hit = text.rlike(f"(?i){pattern}")
        out = F.when(hit, tag) if out is None else out.when(hit, tag)
    return out.otherwise(default)


def _literal(term: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", term, flags=re.ASCII) if term.isascii() else re.escape(term).replace("\\ ", " ")


def contains_any(text: Column, terms: list[str]) -> Column:
    """Whether any of the terms occurs; one pattern, so that the expression stays small."""
    return text.rlike("|".join(_literal(t) for t in terms)) if terms else F.lit(False)


# --- URLs and dates ---------------------------------------------------------------------------


def domain(url: Column) -> Column:
    """Host of a URL: lower case, without port and a leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)", 1)), r"^www\.", "")


def clean_url(url: Column) -> Column:
    """Absolute http(s) URLs without fragment, tracking parameters and double slashes; others null."""
    scheme, host = F.regexp_extract(url, r"^(https?)://", 1), F.lower(F.regexp_extract(url, r"^https?://([^/?#]+)", 1))
    path = F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(r"^(utm_[^=]*|fbclid|gclid|ref|mc_cid)(=|$)"))
    path = F.regexp_replace(F.when(path == "", "/").otherwise(path), "/+", "/")
    return F.when((scheme != "") & (host != ""), F.concat(scheme, F.lit("://"), host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def relative_time(at: Column, as_of: Column) -> Column:
    """Elapsed time in Marathi words, after a week the date; ``as_of`` is a parameter, never a fixed clock."""
    seconds = F.unix_timestamp(as_of) - F.unix_timestamp(at)
    words = lex.ELAPSED
    ago = lambda unit, word: F.concat(F.floor(seconds / unit).cast("string"), F.lit(f" {word}"))
    return (
        F.when(at.isNull(), words["today"])
        .when(seconds < 0, words["now"])
        .when(seconds < 600, words["new"])
        .when(seconds < 3600, ago(60, words["minutes"]))
        .when(seconds < 86400, ago(3600, words["hours"]))
        .when(seconds < 2 * 86400, words["yesterday"])
        .when(seconds < 7 * 86400, ago(86400, words["days"]))
        .otherwise(native_date(at))
    )


def recent(at: Column, as_of: Column, days: int = 5) -> Column:
    """Whether a time lies within the last ``days`` days."""
    return F.coalesce(F.datediff(F.to_date(as_of), F.to_date(at)).between(0, days), F.lit(False))


def iso_date(text: Column) -> Column:
    """RFC 822 dates (Sun, 04 Oct 2026 20:00:00 +0530) and ISO ones as a timestamp; null for others."""
    day = F.regexp_extract(text, r"^\s*(?:[A-Za-z]{3},\s*)?(\d{1,2}\s+[A-Za-z]{3}\s+\d{4}\s+\d{2}:\d{2}(?::\d{2})?)", 1)
    zone = F.regexp_replace(F.regexp_extract(text, r"([+-]\d{2}:?\d{2}|GMT|UTC?|Z)\s*$", 1), "^(GMT|UTC?|Z|)$", "+00:00")
    clock = F.regexp_replace(F.regexp_replace(day, r"\s+", " "), r"( \d{2}:\d{2})$", "$1:00")
    rfc = F.try_to_timestamp(F.concat_ws(" ", clock, F.regexp_replace(zone, r"^([+-]\d{2}):?(\d{2})$", "$1:$2")), F.lit("d MMM yyyy HH:mm:ss xxx"))
    return F.coalesce(F.when(day != "", rfc), F.try_to_timestamp(F.trim(text)))


def native_date(at: Column) -> Column:
    """Day, month name and year in Marathi."""
    digits = lambda c: F.translate(c.cast("string"), "0123456789", "०१२३४५६७८९")
    return F.concat_ws(" ", digits(F.dayofmonth(at)), F.element_at(F.array(*[F.lit(m) for m in lex.MONTHS]), F.month(at)), digits(F.year(at)))
