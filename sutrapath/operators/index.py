"""The search index of pages: enriched terms, written in segments (``segments``), and search over it."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify as cls
from ..functions import lexicons as lex
from ..functions.stem import vocabulary, word_list
from ..functions.text import contains_any, fold, native_date, recent
from ..sources.shared import cut
from . import search
from .segments import Store, documents_of


@dataclasses.dataclass
class Index:
    """``documents`` (page_id, dl, terms) and ``postings`` (term, page_id, tf), as worked out from pages."""

    documents: DataFrame
    postings: DataFrame

    def write(self, path: str) -> Store:
        """The first segment of a written index."""
        return Store.create(self.documents, self.postings, path)


def index_text(pages: DataFrame, websites: DataFrame | None = None) -> DataFrame:
    """(page_id, text) of pages (page_id, title, path, domain): title, words of the path, domain; pages without a title at the root are left out.

    With ``websites`` (domain, category) the category's words too, and only pages of such sites.
    """
    plain = F.coalesce(F.try_url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), F.col("path"), F.lit(""))
    shown = pages.where("title is not null or path <> '/'")
    parts = [F.coalesce("title", F.lit("")), F.regexp_replace(plain, "[-_/]+", " "), F.col("domain")]
    if websites is not None:
        sites = websites.groupBy(F.col("domain").alias("_site")).agg(F.min("category").alias("_category"))
        shown, parts = shown.join(sites, F.col("domain") == F.col("_site")), [*parts, F.col("_category")]
    return shown.select("page_id", F.concat_ws(" ", *parts).alias("text"))


def build(pages: DataFrame, websites: DataFrame | None = None) -> Index:
    """The index of pages (page_id, title, path, domain), with the categories of their sites: words meet the vocabulary once for each distinct word."""
    words = index_text(pages, websites).select("page_id", F.explode(word_list(F.col("text"))).alias("word")).where(F.length("word") >= 2).groupBy("page_id", "word").agg(F.count("*").alias("times"))
    words = cut(words)
    terms = vocabulary(words.select("word").distinct())
    # a term that several words of a page stand for is there as often as all of them
    postings = cut(words.join(terms, "word").groupBy("term", "page_id").agg(F.sum("times").alias("tf")))
    return Index(documents_of(postings), postings)


def maintain(store: Store, pages: DataFrame, websites: DataFrame | None = None) -> Store:
    """The written index with new and changed pages as a segment: what it held of them goes, all else stays as it is."""
    fresh = build(pages, websites)
    return store.add(fresh.documents, fresh.postings, removed=pages)


def page_filters(category: str | None, freshness: str | None, as_of: Column) -> list[Column]:
    """The filters of a search in the order in which they are kept: category, then how old a page's own date may be."""
    out = []
    if category and category != "all":
        out.append(F.coalesce(F.lower("category").contains(category.lower()), F.lit(False)))
    days = {"24h": 2, "week": 7, "month": 34}.get(freshness or "")
    if days:
        out.append(F.coalesce(F.to_date("lastmod") >= F.date_sub(F.to_date(as_of), days), F.lit(False)))
    return out


def search_index(store: Store, pages: DataFrame, websites: DataFrame, query: str, as_of: Column, category: str | None = None, freshness: str | None = None, sort_by: str = "relevance", limit: int = 25, freshness_wanted: bool = False) -> DataFrame:
    """Results of a query over a written index, best first: pages (page_id, url, title, path, domain, lastmod, fetched_at, ratio) joined with websites (domain, category, pagerank, authority, ratio).

    Retrieval keeps the best 150 by the order asked for (relevance, date, pagerank); the hybrid score ranks those.  Without a
    result the freshness filter goes, then the category too; ``dropped`` says how many went.
    """
    clusters = search.clusters_of(store.spark, query)
    sites = websites.select(F.col("domain").alias("_d"), "category", "pagerank", "authority", F.col("ratio").alias("_site_ratio"))
    known = pages.join(sites, F.col("domain") == F.col("_d")).select(
        F.col("page_id").alias("_p"), "url", "title", F.coalesce("path", F.lit("")).alias("path"), "domain", "category", "lastmod", F.coalesce("lastmod", "fetched_at").alias("at"),
        F.coalesce("pagerank", F.lit(0.01)).alias("pagerank"), F.coalesce("authority", F.lit(0.0)).alias("authority"), F.coalesce("ratio", "_site_ratio", F.lit(0.5)).alias("ratio"),
    )
    found = cut(store.matches(search.cluster_terms(clusters)).join(known, F.col("doc_id") == F.col("_p")))
    filters, dropped, kept = page_filters(category, freshness, as_of), 0, found
    for dropped in range(len(filters) + 1):
        kept = found
        for f in filters[: len(filters) - dropped]:
            kept = kept.where(f)
        if dropped == len(filters) or not kept.isEmpty():
            break
    order = {"date": [F.col("at").desc_nulls_last()], "pagerank": [F.col("pagerank").desc()]}.get(sort_by, [])
    best = search.tiers(kept, len(clusters), order=order)
    rows = best.join(store.documents().select(F.col("page_id").alias("_i"), "terms"), F.col("doc_id") == F.col("_i"))
    scores = search.hybrid(evidence(rows, query, clusters, as_of, freshness_wanted))
    first = {"date": [F.col("at").desc_nulls_last()], "pagerank": [F.round("pagerank", 4).desc()]}.get(sort_by, [])
    # 300 rows at most, two times what each level keeps
    shown = scores.withColumn("total_found", F.count("*").over(Window.partitionBy())).orderBy(*first, F.col("score").desc(), "doc_id").limit(limit)
    return result_rows(shown).withColumn("dropped", F.lit(dropped))


def evidence(rows: DataFrame, query: str, clusters: list[list[str]], as_of: Column, freshness_wanted: bool) -> DataFrame:
    """Rows (title, path, terms, at, ...) with what the hybrid score needs: coverage, title_hit, entity, recent, freshness_wanted; and haystack."""
    plain = F.lower(F.coalesce(F.try_url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), F.col("path")))
    title = F.coalesce("title", F.lit(""))
    rows = rows.withColumns({"haystack": F.lower(F.concat_ws(" ", title, plain, "path", F.array_join("terms", " "))), "_shown": F.lower(F.concat_ws(" ", title, plain))})
    hits = sum((contains_any(F.col("haystack"), [t.lower() for t in terms]).cast("int") for terms in clusters), F.lit(0))
    asked = rows.sparkSession.createDataFrame([(query,)], "q string").select(fold(F.col("q"))).first()[0] or ""
    words = [w for w in asked.split() if w not in lex.STOPWORDS]
    entity = F.lit(0.0)
    for wanted, present, boost in lex.ENTITY_BOOSTS:
        if any(w in asked for w in wanted):
            entity = entity + F.when(contains_any(F.col("haystack"), present), boost).otherwise(0.0)
    now = freshness_wanted or any(w in asked for w in lex.FRESH_WORDS)
    return rows.withColumns({"coverage": hits / F.lit(float(len(clusters) or 1)), "title_hit": contains_any(F.col("_shown"), words), "entity": entity, "recent": recent(F.col("at"), as_of), "freshness_wanted": F.lit(now)}).drop("_shown")


def snippet(domain: Column, category: Column, haystack: Column) -> Column:
    """A site's name and the sentence of the first kind of page that category, domain or words point to."""
    text = F.lit(lex.SNIPPET_OTHER)
    for categories, sites, words, sentence in reversed(lex.SNIPPETS):
        hit = category.isin(categories) | contains_any(haystack, words)
        text = F.when(F.coalesce(hit | contains_any(domain, sites) if sites else hit, F.lit(False)), sentence).otherwise(text)
    return F.concat(search.publisher(domain), F.lit(" — "), text)


def result_rows(rows: DataFrame) -> DataFrame:
    """Result cards of scored rows."""
    name, shown = search.publisher(F.col("domain")), search.headline(F.col("title"))
    title = F.when(F.length(shown) >= 4, F.concat(shown, F.lit(" | "), name)).otherwise(F.coalesce(F.nullif("title", F.lit("")), name))
    return rows.select(
        "doc_id", "url", title.alias("title"), "domain", "category", snippet(F.col("domain"), F.col("category"), F.col("haystack")).alias("snippet"), F.round(F.col("ratio") * 100, 1).alias("ratio"), F.round("pagerank", 4).alias("pagerank"), F.round("authority", 4).alias("authority"),
        "total_found", "score", F.round("coverage", 2).alias("coverage"), "tier", (F.col("coverage") < 0.8).alias("partial_match"), "level", "at", native_date(F.col("at")).alias("formatted_date"), "recent", "bm25_norm",
    )


#: What is said when filters had to go, and what sections are called in it.
NO_FRESH = "निवडलेल्या कालमर्यादेत निकाल आढळले नाहीत, म्हणून सर्व काळातील निकाल दाखवत आहोत."
NO_SECTION = ("'", "' विभागात निकाल आढळले नाहीत, म्हणून संपूर्ण मराठी इंटरनेटवरील निकाल खाली दाखवले आहेत.")
SECTIONS = {"news": "बातम्या", "finance": "अर्थव्यवस्था", "mpsc": "स्पर्धा परीक्षा", "agri": "कृषी", "gov": "शासकीय", "knowledge": "ज्ञानकोश"}


def notice(category: str | None, freshness: str | None, dropped: int) -> str | None:
    """What is said of ``dropped`` filters: the time goes first, the section only after it."""
    timed = freshness in ("24h", "week", "month")
    if category and category != "all" and dropped > int(timed):
        return SECTIONS.get(category, category).join(NO_SECTION)
    return NO_FRESH if dropped else None


def respond(store: Store, pages: DataFrame, websites: DataFrame, query: str, as_of: Column, **options) -> tuple[DataFrame, DataFrame]:
    """The results of a query, and one row about it: folded query, intent with its labels, how many were found, tier, notice of filters that went, related queries, answer card."""
    text, spark = F.col("query"), store.spark
    about = spark.createDataFrame([(query,)], "query string").withColumn("clean_query", fold(text))
    clean = F.col("clean_query")
    label = lambda table: F.coalesce(*[F.when(F.col("intent") == k, v) for k, v in table.items()], F.lit(table["unclear"]))
    about = cut(about.withColumn("intent", F.when(clean == "", "unclear").otherwise(cls.intent(clean))).withColumn("is_question", (clean != "") & cls.is_question(clean)))
    results = cut(search_index(store, pages, websites, query, as_of, **{"freshness_wanted": about.first()["intent"] == "freshness"} | options))
    seen = results.agg(F.max("total_found").alias("n"), F.max("level").alias("level"), F.max("dropped").alias("dropped")).first()
    said = notice(options.get("category"), options.get("freshness"), seen["dropped"] or 0)
    about = about.select(
        "query", "clean_query", "intent", label(lex.INTENT_LABELS).alias("intent_label"), label(lex.SHAPE_LABELS).alias("shape_label"), "is_question", F.lit(seen["n"] or 0).cast("long").alias("total_found"),
        F.lit("relaxed" if seen["level"] == 2 else "exact").alias("tier_used"), F.lit(said).cast("string").alias("notice"), search.related(text).alias("related"), search.answer_card(text).alias("answer_card"),
    )
    return results, about
