"""Web extraction and table maintenance: pages, links, sitemaps, feeds, robots files, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as lex
from ..functions import markup
from ..functions.text import clean_url, devanagari_ratio, domain, iso_date
from ..sources.shared import cut

_SKIPPED = r"(?is)<(script|style|noscript|svg)\b.*?</\1\s*>"


def html_title(html: Column) -> Column:
    found = F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))
    return F.when(found != "", found)


def html_language(html: Column) -> Column:
    found = F.regexp_extract(html, r"""(?is)<html[^>]*?\blang\s*=\s*["']([^"']*)["']""", 1)
    return F.when(found != "", found)


def html_meta(html: Column, name: str) -> Column:
    found = F.regexp_extract(html, rf"""(?is)<meta[^>]*(?:name|property)\s*=\s*["']{name}["'][^>]*content\s*=\s*["']([^"']*)["']""", 1)
    return F.when(found != "", found)


def visible_text(html: Column) -> Column:
    """Text outside tags, scripts and styles, white space runs as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(html, _SKIPPED, " "), "(?s)<[^>]*>", " "), r"\s+", " "))


def html_hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), F.lit(1))


def resolve(base: Column, href: Column) -> Column:
    """An absolute URL of a link: absolute, host-relative, root-relative and plain relative ones; others null."""
    root, folder = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1), F.regexp_extract(base, r"^(https?://[^/?#]+(?:/[^?#]*/|/)?)", 1)
    href = F.trim(href)
    joined = (
        F.when(href.rlike(r"(?i)^(#|javascript:|mailto:|tel:|data:|whatsapp:)") | (href == ""), F.lit(None).cast("string"))
        .when(href.rlike(r"(?i)^https?://"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, "^(https?:)", 1), href))
        .when(href.startswith("/"), F.concat(root, href))
        .otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), href))
    )
    return clean_url(joined)


def page_facts(pages: DataFrame) -> DataFrame:
    """(page_id, domain, title, html_lang, ratio, is_marathi) of pages (page_id, url, html)."""
    text = visible_text(F.col("html"))
    out = pages.select("page_id", domain(F.col("url")).alias("domain"), html_title(F.col("html")).alias("title"), html_language(F.col("html")).alias("html_lang"), devanagari_ratio(text).alias("ratio"))
    # no text, no verdict
    return out.withColumn("is_marathi", F.when(F.col("ratio").isNotNull(), (F.col("ratio") >= 0.4) | F.coalesce(F.col("html_lang").contains("mr"), F.lit(False))))


def page_links(pages: DataFrame) -> DataFrame:
    """(source_url, target_url, source_domain, target_domain, is_internal): each link between two URLs once, however many pages were saved of the first."""
    links = pages.select(F.col("url").alias("source_url"), F.explode(F.array_distinct(F.transform(html_hrefs(F.col("html")), lambda h: resolve(F.col("url"), h)))).alias("target_url"))
    links = links.where("target_url is not null and target_url <> source_url").distinct()
    links = links.withColumns({"source_domain": domain(F.col("source_url")), "target_domain": domain(F.col("target_url"))})
    return links.withColumn("is_internal", F.col("source_domain") == F.col("target_domain"))


def insert_or_ignore(existing: DataFrame, new: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """``existing`` and the first row (by ``order``) of each new key that it doesn't have."""
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")
    return existing.unionByName(first.join(existing.select(*key), key, "left_anti"))


def upsert(existing: DataFrame, new: DataFrame, key: list[str], arrival: str, keep_old: list[str] = [], overwrite: list[str] = []) -> DataFrame:
    """Merge by key, column by column: the latest known value wins, of ``keep_old`` columns the old one; null never overwrites, but in ``overwrite`` columns.

    Of values that arrived at one time the greatest wins (in ``keep_old`` columns the least), whatever order tasks end in.
    """
    columns = [c for c in existing.columns if c not in key]
    old = existing.withColumn("_at", F.lit(None).cast(new.schema[arrival].dataType))
    rows = old.unionByName(new.select(*existing.columns, F.col(arrival).alias("_at")))

    def pick(c: str) -> Column:
        order = F.struct(F.col("_at").isNotNull().alias("fresh"), "_at", F.col(c).isNotNull().alias("known"), c)
        known = order if c in overwrite else F.when(F.col(c).isNotNull(), order)
        return (F.min_by(c, known) if c in keep_old else F.max_by(c, known)).alias(c)

    return rows.groupBy(*key).agg(*[pick(c) for c in columns])


#: Platforms, known by how their domains end.
PLATFORM_SUFFIXES = ["google.com", "facebook.com", "twitter.com", "x.com", "instagram.com", "youtube.com", "whatsapp.com", "apple.com", "amazon.com", "cloudflare.com", ".doubleclick.net", ".googlesyndication.com", ".akamai.net", ".cloudfront.net"]


def discovery(links: DataFrame, sites: DataFrame, most: int | None = None) -> DataFrame:
    """(target_domain, in_refs, sample_url): linked domains that no site has, most referred first; known platforms left out."""
    found = links.where(~F.col("is_internal")).join(sites.select(F.col("domain").alias("_d")), F.col("target_domain") == F.col("_d"), "left_anti")
    found = found.where(~F.col("target_domain").isin(lex.IGNORED_DOMAINS))
    for suffix in PLATFORM_SUFFIXES:
        found = found.where(~F.col("target_domain").endswith(suffix))
    out = found.groupBy("target_domain").agg(F.count("*").alias("in_refs"), F.min("target_url").alias("sample_url")).orderBy(F.col("in_refs").desc(), "target_domain")
    return out if most is None else out.limit(most)


def site_ratio(pages: DataFrame) -> DataFrame:
    """(domain, ratio, verified): mean of the measured pages, 4 places, verified from 0.35; null where none is measured."""
    out = pages.groupBy("domain").agg(F.round(F.avg("ratio"), 4).alias("ratio"))
    return out.withColumn("verified", F.col("ratio") >= 0.35)


def summary(pages: DataFrame, links: DataFrame) -> DataFrame:
    """One row of counts over pages and links."""
    a = pages.agg(F.count("*").alias("pages"), F.count_if(F.col("title").isNotNull()).alias("titled"), F.countDistinct("domain").alias("domains"), F.count_if(F.col("ratio").isNotNull()).alias("measured"))
    return a.crossJoin(links.agg(F.count("*").alias("links"), F.count_if("is_internal").alias("internal"), F.count_if(~F.col("is_internal")).alias("external")))  # one row each


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """(url, n, sitemap) of robots files (url, body): Sitemap lines in order, each once, resolved."""
    lines = robots.select("url", F.posexplode(F.split("body", r"\r?\n")).alias("line_no", "line"))
    found = F.trim(F.regexp_extract("line", r"(?i)^\s*sitemap:\s*([^#]+)", 1))
    lines = lines.withColumn("sitemap", resolve(F.col("url"), found)).where("sitemap is not null")
    first = lines.groupBy("url", "sitemap").agg(F.min("line_no").alias("line_no"))
    return first.select("url", F.row_number().over(Window.partitionBy("url").orderBy("line_no")).alias("n"), "sitemap")


def sitemap_entries(files: DataFrame) -> DataFrame:
    """(url, kind, loc, lastmod) of XML files (url, xml): index, urlset or feed; malformed ones by their <loc> elements."""
    local = lambda *names: "//*[" + " or ".join(f"local-name()='{n}'" for n in names) + "]"
    kind = F.when(F.col("xml").rlike(r"(?i)<(\w+:)?sitemapindex\b"), "index").when(F.col("xml").rlike(r"(?i)<(\w+:)?urlset\b"), "urlset").when(F.col("xml").rlike(r"(?i)<(rss|feed)\b"), "feed").otherwise("unknown")
    blocks = F.regexp_extract_all("xml", F.lit(r"(?is)<(?:\w+:)?(?:sitemap|url|item|entry)\b[^>]*>.*?</(?:\w+:)?(?:sitemap|url|item|entry)\s*>"), F.lit(0))
    rows = files.select("url", kind.alias("kind"), F.explode(blocks).alias("block"))
    loc = F.coalesce(_element("block", "loc"), _element("block", "link"), _nonempty(F.regexp_extract("block", r"""(?is)<link\b[^>]*href\s*=\s*["']([^"']+)["']""", 1)))
    return rows.select("url", "kind", loc.alias("loc"), F.coalesce(_element("block", "lastmod"), _element("block", "pubDate"), _element("block", "updated")).alias("lastmod"), F.coalesce(_element("block", "title")).alias("title")).where("loc is not null")


#: What the reader of XML may skip before the first element; kinds of sitemap by that element's name.
_PROLOGUE = r"(?s)^(?:\uFEFF|\s|<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>)*<(?:[\w.-]+:)?([\w.-]+)"
SITEMAP_KINDS = {"sitemapindex": "sitemapindex", "urlset": "urlset", "rss": "feed", "feed": "feed"}


def sitemap_scan(files: DataFrame) -> DataFrame:
    """(url, kind, n, loc, lastmod, priority, title, error) of XML files (url, xml): each entry; of a file without any, one row with ``loc`` null.

    Kinds are sitemapindex, urlset, feed, unknown (another root: an error, no entries) and error.  What is not well-formed gives the
    bare <loc> elements that are left, by ``sitemap_rescue``'s rule; none left, or null, is an error.  A priority that is no number is null.
    """
    parsed = F.from_xml("xml", "_bad string, _rest array<string>", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    root = F.regexp_extract("xml", _PROLOGUE, 1)
    kinds = F.create_map(*[F.lit(x) for kv in SITEMAP_KINDS.items() for x in kv])
    rows = files.select("url", "xml", F.coalesce(parsed["_bad"].isNotNull(), F.lit(True)).alias("_broken"), F.coalesce(F.try_element_at(kinds, root), F.lit("unknown")).alias("kind"))
    none = F.lit(None).cast("string")
    whole = rows.where("not _broken and xml is not null")
    names = F.when(F.col("kind") == "sitemapindex", "sitemap").when(F.col("kind") == "urlset", "url").when(F.col("kind") == "feed", "(?:item|entry)")
    pattern = F.concat(F.lit(r"(?is)<(?:\w+:)?"), names, F.lit(r"(?=[\s>/])[^>]*>.*?</(?:\w+:)?"), names, F.lit(r"\s*>"))
    whole = whole.select("url", "kind", F.posexplode_outer(F.when(F.col("kind") != "unknown", F.regexp_extract_all("xml", pattern, F.lit(0)))).alias("n", "block"))
    link = F.coalesce(_element("block", "link"), _nonempty(F.regexp_extract("block", r"""(?is)<link\b[^>]*href\s*=\s*["']([^"']+)["']""", 1)))
    loc = unescape(F.when(F.col("kind") == "feed", link).otherwise(_element("block", "loc")))
    entries = whole.select(
        "url", "kind", "n", loc.alias("loc"), F.coalesce(_element("block", "lastmod"), _element("block", "pubDate"), _element("block", "updated")).alias("lastmod"),
        F.expr("try_cast(nullif(trim(regexp_extract(block, '(?is)<(?:[a-z]+:)?priority[^>]*>(.*?)<', 1)), '') as double)").alias("priority"), unescape(_element("block", "title")).alias("title"),
        F.when(F.col("kind") == "unknown", "unknown root").alias("error"),
    ).where("loc is not null or n is null")
    left = sitemap_rescue(rows.where("_broken or xml is null").select("url", F.coalesce("xml", F.lit("")).alias("xml")))
    left = left.select("url", "kind", "n", "loc", none.alias("lastmod"), F.lit(None).cast("double").alias("priority"), none.alias("title"), F.when(F.col("kind") == "error", "not well-formed").alias("error"))
    return entries.unionByName(left)


def sitemap_states(scan: DataFrame) -> DataFrame:
    """(sitemap_url, domain, kind, children, urls, error): one row for each scanned file; children are those of an index, urls those of other kinds."""
    entries, index = F.col("loc").isNotNull(), F.col("kind") == "sitemapindex"
    out = scan.groupBy(F.col("url").alias("sitemap_url")).agg(F.min("kind").alias("kind"), F.count_if(entries & index).alias("children"), F.count_if(entries & ~index).alias("urls"), F.min("error").alias("error"))
    return out.withColumn("domain", domain(F.col("sitemap_url")))


def _nonempty(c: Column) -> Column:
    return F.when(c != "", c)


def _element(block: str, name: str) -> Column:
    return _nonempty(F.trim(F.regexp_replace(F.regexp_extract(block, rf"(?is)<(?:\w+:)?{name}\b[^>]*>(.*?)</(?:\w+:)?{name}\s*>", 1), r"<!\[CDATA\[|\]\]>", "")))


def published_dates(pages: DataFrame) -> DataFrame:
    """(page_id, published, source, confidence): JSON-LD before <time> before meta; NONE without any."""
    html = F.col("html")
    ld = _nonempty(F.regexp_extract(html, r"""(?is)<script[^>]*application/ld\+json[^>]*>.*?"datePublished"\s*:\s*"([^"]+)".*?</script>""", 1))
    time = _nonempty(F.regexp_extract(html, r"""(?is)<time[^>]*datetime=["']([^"']+)["']""", 1))
    meta = F.coalesce(html_meta(html, "article:published_time"), html_meta(html, "date"))
    source = F.when(ld.isNotNull(), "JSON-LD").when(time.isNotNull(), "TIME").when(meta.isNotNull(), "META").otherwise("NONE")
    confidence = F.when(source == "JSON-LD", "HIGH").when(source.isin("TIME", "META"), "MEDIUM").otherwise("NONE")
    return pages.select("page_id", F.coalesce(ld, time, meta).alias("published"), source.alias("source"), confidence.alias("confidence"))


def reachable_sitemaps(start: DataFrame, index: DataFrame, most: int = 500) -> DataFrame:
    """(url, depth): sitemaps reached from ``start`` (url) through ``index`` (url, child), each once, nearest first, ``most`` at most.

    Breadth first: each round joins the frontier with the index and leaves out what was seen.
    """
    seen = cut(start.select("url").distinct().withColumn("depth", F.lit(0)))
    frontier, depth = seen, 0
    while not frontier.isEmpty() and seen.count() < most:
        depth += 1
        found = frontier.join(index, "url").select(F.col("child").alias("url")).distinct().join(seen, "url", "left_anti")
        frontier = cut(found.withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(frontier)
    return seen.orderBy("depth", "url").limit(most)


#: Endings that a content system adds to the last part of a path, one after the other; what is shown of a page without words.
SLUG_ENDINGS = [r"(?i)\.(cms|html|shtml|php|aspx?)$", r"-\d+$", r"-[a-z0-9]{5,15}$", r"-(ssb|zws|rat|ak|pp|dc|ab)\d*.*$"]
NO_WORDS, MONEY_SITE, OTHER_SITE = "अधिकृत मराठी माहिती", "शेअर बाजार व अर्थविषस्तर माहिती", "शेती व शेतकरी संबंधित विशेष वृत्त"
#: Letters of a slug word's beginning that a dictionary is asked for, at least.
LEAST_PREFIX = 4


def slug_words(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(word, native) of distinct words (word) by a dictionary (slug, native): the word itself, a number as it is, else the longest beginning of four letters or more."""
    known = dictionary.groupBy(F.col("slug").alias("_slug")).agg(F.min("native").alias("native"))
    begins = F.when(F.length("word") >= LEAST_PREFIX, F.transform(F.sequence(F.lit(LEAST_PREFIX), F.length("word")), lambda n: F.substring(F.col("word"), F.lit(1), n)))
    tried = words.select("word", F.explode(F.array_distinct(F.concat(F.array("word"), F.coalesce(begins, F.array().cast("array<string>"))))).alias("_begin"))
    found = tried.join(known, F.col("_begin") == F.col("_slug")).groupBy("word").agg(F.max_by("native", F.length("_begin")).alias("native"))
    numbers = words.where(F.col("word").rlike(r"^\p{Nd}+$")).select("word", F.col("word").alias("native"))
    return found.unionByName(numbers.join(found.select("word"), "word", "left_anti"))


def path_words(pages: DataFrame) -> DataFrame:
    """``pages`` (path, ...) with _plain, the path without escapes and outer slashes, and _words of its last part without endings."""
    plain = F.coalesce(F.try_url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), F.col("path"), F.lit(""))
    rows = pages.withColumn("_plain", F.regexp_replace(plain, "^/+|/+$", ""))
    slug = F.element_at(F.split(F.regexp_replace("_plain", SLUG_ENDINGS[0], ""), "/"), -1)
    for pattern in SLUG_ENDINGS[1:]:
        slug = F.regexp_replace(slug, pattern, "")
    return rows.withColumn("_words", F.filter(F.split(F.lower(slug), "[-_]+"), lambda w: w != ""))


def slug_titles(pages: DataFrame, dictionary: DataFrame, names: Column | None = None) -> DataFrame:
    """(page_id, title) of pages (page_id, path, domain): a native title from the path's last part, with the site's name (``names``, else its domain).

    Devanagari parts are taken as they are; of others the words that a dictionary (slug, native) knows, two at least.
    """
    brand = F.coalesce(names, F.col("domain")) if names is not None else F.col("domain")
    rows = path_words(pages.select("page_id", "path", "domain", brand.alias("_brand")))
    latin = rows.where(~F.col("_plain").rlike("[ऀ-ॿ]")).select("page_id", F.posexplode("_words").alias("_n", "word"))
    native = slug_words(latin.select("word").distinct(), dictionary).withColumnRenamed("word", "_word")
    told = latin.join(native, F.col("word") == F.col("_word")).groupBy(F.col("page_id").alias("_page")).agg(F.sort_array(F.collect_list(F.struct("_n", "native"))).alias("_told"))  # words of one path
    rows = rows.join(told, F.col("page_id") == F.col("_page"), "left")
    other = F.when(F.col("domain").contains("arthasakshar") | F.col("domain").contains("paisa"), MONEY_SITE).otherwise(OTHER_SITE)
    shown = (
        F.when(F.col("_plain").rlike("[ऀ-ॿ]"), F.concat(F.trim(F.translate(F.element_at(F.split("_plain", "/"), -1), "-_", "  ")), F.lit(" | "), "_brand"))
        .when(F.size("_words") == 0, F.concat("_brand", F.lit(f" — {NO_WORDS}")))
        .when(F.size("_told") >= 2, F.concat(F.array_join(F.col("_told.native"), " "), F.lit(" | "), "_brand"))
        .otherwise(F.concat("_brand", F.lit(" — "), other))
    )
    return rows.select("page_id", shown.alias("title"))


def write_back(sites: DataFrame, scores: DataFrame, key: str = "domain", keep: list[str] = []) -> DataFrame:
    """``sites`` with the columns of ``scores``, which overwrite, empty ones too, but not in ``keep`` columns; sites without a score stay as they are."""
    new = [c for c in scores.columns if c != key]
    found = scores.withColumnsRenamed({key: "_k", **{c: f"_{c}" for c in new}})
    out = sites.join(found, F.col(key) == F.col("_k"), "left")

    def value(c: str) -> Column:
        known = F.coalesce(f"_{c}", c) if c in keep else F.when(F.col("_k").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c))
        return known.alias(c)

    return out.select(*[value(c) if c in new else F.col(c) for c in sites.columns], *[F.col(f"_{c}").alias(c) for c in new if c not in sites.columns])


def lookup(sites: DataFrame, name: str) -> DataFrame:
    """The site of a domain."""
    return sites.where(F.col("domain") == name)


def unvisited(pages: DataFrame, most: int) -> DataFrame:
    """Of each site its first ``most`` pages (domain, url, status_code) by URL that have no status yet."""
    order = F.row_number().over(Window.partitionBy("domain").orderBy("url"))
    return pages.where("status_code is null").withColumn("_n", order).where(F.col("_n") <= most).drop("_n")


#: Entities of XML and the non-breaking space.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def unescape(text: Column) -> Column:
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def plain_summary(text: Column, most: int = 200) -> Column:
    """A description without entities and tags, cut to ``most`` characters; null without any."""
    return _nonempty(F.substring(F.trim(F.regexp_replace(unescape(text), "<[^>]+>", "")), 1, most))


def page_meta(pages: DataFrame) -> DataFrame:
    """(page_id, title, description, og_title, og_image): what a page says of itself, entities taken back; og:title where there is no title."""
    rows, meta = markup.parsed(pages, ["page_id"]), lambda name: F.try_element_at("meta", F.lit(name))
    return rows.select("page_id", F.coalesce("title", meta("og:title")).alias("title"), F.coalesce(meta("description"), meta("og:description")).alias("description"), meta("og:title").alias("og_title"), meta("og:image").alias("og_image"))


def anchors(pages: DataFrame) -> DataFrame:
    """(source_url, target_url, anchor_text, is_internal, pages): a page's links to other pages, with the text of the first to each; sub-domains are internal.

    ``pages`` says how many rows of that URL hold the link, where it was saved more than once.
    """
    tags = F.transform("anchors", lambda a: F.struct(resolve(F.col("url"), a["href"]).alias("target_url"), a["text"].alias("text")))
    rows = markup.parsed(pages, ["url"]).select(F.col("url").alias("source_url"), tags.alias("_tags"))
    rows = rows.select("source_url", F.col("_tags.target_url").alias("_targets"), F.posexplode("_tags").alias("n", "tag"))
    rows = rows.select("source_url", "n", "tag.target_url", F.col("tag.text").alias("anchor_text"), (F.array_position("_targets", F.col("tag.target_url")) == F.col("n") + 1).alias("_first"))
    rows = rows.where("target_url is not null and target_url <> source_url")
    first = rows.groupBy("source_url", "target_url").agg(F.min_by("anchor_text", "n").alias("anchor_text"), F.count_if("_first").alias("pages"))
    a, b = domain(F.col("source_url")), domain(F.col("target_url"))
    internal = (a == b) | b.endswith(F.concat(F.lit("."), a)) | a.endswith(F.concat(F.lit("."), b))
    return first.select("source_url", "target_url", "anchor_text", internal.alias("is_internal"), "pages")


def discovery_verdict(facts: DataFrame, least: float = 0.2) -> DataFrame:
    """``facts`` (page_id, title, html_lang, ratio, ...) with ``accepted`` and ``reason``: by the script's share, the language, or the title."""
    reason = F.when(F.col("ratio") >= least, "ratio").when(F.col("html_lang").contains("mr"), "language").when(F.col("title").rlike("[ऀ-ॿ]"), "title")
    return facts.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNotNull())


def feed_items(files: DataFrame, as_of: Column) -> DataFrame:
    """(feed, kind, url, title, published_at, summary) of feeds and news sitemaps (url, xml): entries with a link and a title.

    News sitemaps take the publication date, else the last change; a date that is missing or in no known form is ``as_of``.
    """
    news = F.col("xml").rlike(r"(?i)<(\w+:)?urlset\b")
    blocks = F.regexp_extract_all("xml", F.lit(r"(?is)<(?:\w+:)?(?:url|item|entry)\b[^>]*>.*?</(?:\w+:)?(?:url|item|entry)\s*>"), F.lit(0))
    rows = files.select(F.col("url").alias("feed"), F.when(news, "news").otherwise("feed").alias("kind"), F.explode(blocks).alias("block"))
    link = F.coalesce(_element("block", "loc"), _element("block", "link"), _nonempty(F.regexp_extract("block", r"""(?is)<link\b[^>]*href\s*=\s*["']([^"']+)["']""", 1)))
    date = F.coalesce(_element("block", "publication_date"), _element("block", "pubDate"), _element("block", "updated"), _element("block", "lastmod"))
    rows = rows.select("feed", "kind", link.alias("url"), _nonempty(F.trim(unescape(_element("block", "title")))).alias("title"), F.coalesce(iso_date(date), as_of).alias("published_at"), plain_summary(F.coalesce(_element("block", "description"), _element("block", "summary"))).alias("summary"))
    return rows.where("url is not null and title is not null")


def sitemap_rescue(files: DataFrame) -> DataFrame:
    """(url, kind, loc, n) of files (url, xml) by their bare <loc> elements: an index if one of the first five is an XML file and there is a <sitemap>; error without any."""
    locs = F.regexp_extract_all("xml", F.lit(r"(?i)<loc>\s*(https?://[^\s<>]+)\s*</loc>"), F.lit(1))
    index = F.exists(F.slice("_locs", 1, 5), lambda u: F.lower(u).contains(".xml")) & F.lower("xml").contains("<sitemap>")
    rows = files.withColumn("_locs", locs)
    kind = F.when(F.size("_locs") == 0, "error").when(index, "sitemapindex").otherwise("urlset")
    return rows.select("url", kind.alias("kind"), F.posexplode_outer("_locs").alias("n", "loc"))
