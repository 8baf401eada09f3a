"""Result pages: links, weak domains, dates, and the three-state signals that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import competition_band
from ..functions.text import domain
from .web import html_hrefs

#: Domains that anyone can write on.
WEAK_DOMAINS = ["quora.com", "stackoverflow.com", "stackexchange.com", "reddit.com", "answers.com", "wiki.answers.com", "yahoo.com", "yahoo.co.in", "indiatimes.com", "timesofindia.indiatimes.com", "digitalmarketingcommunity.com", "medium.com", "blogspot.com", "wordpress.com", "wixsite.com", "weebly.com", "tumblr.com", "pinterest.com", "hubpages.com", "ezinearticles.com", "slideshare.net", "scribd.com", "academia.edu", "justanswer.com", "ask.com", "allexperts.com", "answerbag.com", "merriam-webster.com", "dictionary.com", "facebook.com", "instagram.com", "linkedin.com", "twitter.com", "x.com"]
WEAK = "(?i)(" + "|".join(d.replace(".", r"\.") for d in WEAK_DOMAINS) + ")"
DATED = r"(?i)\b(19|20)\d{2}\b|\b\d+\s+(day|days|week|weeks|month|months|year|years)\s+ago\b"


def result_links(pages: DataFrame, most: int = 20) -> DataFrame:
    """(query, n, url): the first ``most`` outgoing links of each page (query, html), query strings cut, each once."""
    links = F.transform(F.filter(html_hrefs(F.col("html")), lambda h: h.rlike("(?i)^https?://") & ~h.rlike(r"(?i)^https?://([^/]*\.)?(google|gstatic|googleusercontent)\.")), lambda h: F.regexp_replace(h, "[?#].*", ""))
    return pages.select("query", F.posexplode(F.slice(F.array_distinct(links), 1, most)).alias("n", "url")).withColumn("n", F.col("n") + 1)


def is_own(host: Column, own: list[str]) -> Column:
    out = F.lit(False)
    for d in own:
        out = out | (host == d) | host.endswith(f".{d}")
    return out


def observe(pages: DataFrame, own: list[str] | None = None) -> DataFrame:
    """(query, thin, weak, stale, own, band, notes) of result pages: null where a page says nothing about it; ``notes`` are the counts behind it.

    A page that asks for proof of being human shows no results: all its signals are null, and ``notes`` says so.
    """
    links = result_links(pages).withColumn("host", domain(F.col("url")))
    counts = links.groupBy("query").agg(F.count("*").alias("links"), F.count_if(F.col("host").rlike(WEAK)).alias("weak_links"), F.count_if(is_own(F.col("host"), own or [])).alias("own_links"))
    rows = pages.select("query", F.col("html").rlike(DATED).alias("dated"), F.col("html").rlike("(?i)ago").alias("ago"), F.coalesce(blocked(F.col("html")), F.lit(False)).alias("blocked")).join(counts, "query", "left").fillna(0, ["links", "weak_links", "own_links"])
    shown, dates = ~F.col("blocked"), F.col("dated") | F.col("ago")
    thin = F.when(shown & (F.col("links") < 3), True).when(shown & (F.col("links") >= 8), False)
    own_shown = F.when(shown & F.lit(own is not None), F.col("own_links") > 0)
    count = lambda name, c: F.concat(F.lit(f"{name}="), F.col(c).cast("string"))
    notes = F.concat_ws("; ", count("auto:organic", "links"), count("weak", "weak_links"), F.when(F.col("dated"), "dates=seen"), F.when(F.col("own_links") > 0, count("own", "own_links")), F.when(~shown, "captcha=detected"))
    out = rows.select("query", thin.alias("thin"), F.when(shown, F.col("weak_links") > 0).alias("weak"), F.when(shown & dates, True).alias("stale"), own_shown.alias("own"), notes.alias("notes"))
    return out.withColumn("band", competition_band(F.col("thin"), F.col("weak"), F.col("stale")))


#: What such a page says.
BLOCKED = "recaptcha|captcha|unusual traffic|prove you're not a robot|security check|detected unusual activity"


def blocked(html: Column) -> Column:
    """Whether a page asks for proof of being human instead of giving results."""
    return F.lower(html).rlike(BLOCKED)


def fill_blanks(recorded: DataFrame, automatic: DataFrame) -> DataFrame:
    """Recorded observations (ord, keyword, thin, weak, stale, own, notes), blanks filled from automatic ones of the same keyword.

    ``filled`` counts the cells that came so; notes are joined where any did.  Keywords meet as they are read: trimmed, in small letters.
    """
    cells = ["thin", "weak", "stale", "own"]
    key = lambda c: F.lower(F.trim(F.col(c)))
    found = automatic.groupBy(key("query").alias("_q")).agg(F.min_by(F.struct(*cells, "notes"), F.struct("query", "notes")).alias("_a"))  # one of each keyword
    took = sum((F.when(F.col(c).isNull() & F.col(f"_a.{c}").isNotNull(), 1).otherwise(0) for c in cells), F.lit(0))
    notes = F.when(took > 0, F.concat_ws("; ", F.nullif("notes", F.lit("")), "_a.notes")).otherwise(F.col("notes"))
    rows = recorded.join(found, key("keyword") == F.col("_q"), "left")
    return rows.select("ord", "keyword", *[F.coalesce(c, f"_a.{c}").alias(c) for c in cells], took.alias("filled"), notes.alias("notes"))
