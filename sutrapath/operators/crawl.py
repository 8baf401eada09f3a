"""A crawl over saved files: typed tables of sites, sitemaps, pages and links, sites found through links, counts over all."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import site_category
from ..sources.shared import cut
from . import web


@dataclasses.dataclass
class Crawl:
    """``websites``, ``sitemaps`` (by file), ``entries`` (of sitemaps), ``pages`` and ``links`` of saved files."""

    websites: DataFrame
    sitemaps: DataFrame
    entries: DataFrame
    pages: DataFrame
    links: DataFrame

    def write(self, path: str) -> None:
        """Each table as Parquet in a folder of its name."""
        for f in dataclasses.fields(self):
            getattr(self, f.name).write.mode("errorifexists").parquet(f"{path}/{f.name}")


def read(pages: DataFrame, files: DataFrame | None = None) -> Crawl:
    """The tables of saved pages (page_id, url, html) and sitemaps (url, xml).

    A site (domain, title, category, ratio, verified, pages_crawled, sitemap_status, total_sitemap_urls) is any domain of a page or a
    sitemap.  Its title is that of its front page, the titled one with the shortest URL.  Its sitemaps are found where one of them has
    entries, in error where only errors are left, else none.  Page URLs without a domain belong to no site.
    """
    facts = cut(web.page_facts(pages).join(pages.select(F.col("page_id").alias("_p"), "url"), F.col("page_id") == F.col("_p")).drop("_p"))
    if files is None:
        files = pages.sparkSession.createDataFrame([], "url string, xml string")
    entries = cut(web.sitemap_scan(files))
    sitemaps = cut(web.sitemap_states(entries))
    front = F.struct(F.length("url"), "url", "page_id")
    known = facts.where("domain <> ''").groupBy("domain").agg(F.min_by("title", F.when(F.col("title").isNotNull(), front)).alias("title"), F.round(F.avg("ratio"), 4).alias("ratio"), F.count("*").alias("pages_crawled"))
    urls = sitemaps.where("domain <> ''").groupBy(F.col("domain").alias("_d")).agg(F.sum("urls").alias("urls"), F.max(F.col("urls") + F.col("children")).alias("most"), F.count("error").alias("errors"))
    sites = known.join(urls, F.col("domain") == F.col("_d"), "full").withColumn("domain", F.coalesce("domain", "_d"))
    status = F.when(F.col("most") > 0, "found").when(F.col("errors") > 0, "error").otherwise("none")
    websites = sites.select(
        "domain", "title", site_category(F.col("title"), F.col("domain")).alias("category"), "ratio", (F.col("ratio") >= 0.35).alias("verified"), F.coalesce("pages_crawled", F.lit(0)).alias("pages_crawled"),
        status.alias("sitemap_status"), F.coalesce("urls", F.lit(0)).alias("total_sitemap_urls"),
    )
    return Crawl(cut(websites), sitemaps, entries, facts, cut(web.page_links(pages)))


def summary(crawl: Crawl) -> DataFrame:
    """One row: the eight counts over a crawl's tables and the sum of the URLs that sitemaps list."""
    sites = crawl.websites.agg(
        F.count("*").alias("total_domains"), F.count_if("verified").alias("verified_domains"), F.count_if(F.col("sitemap_status") == "found").alias("domains_with_sitemaps"),
        F.coalesce(F.sum("total_sitemap_urls"), F.lit(0)).alias("total_sitemap_urls"),
    )
    links = crawl.links.agg(F.count("*").alias("total_links"), F.count_if("is_internal").alias("internal_links"), F.count_if(~F.col("is_internal")).alias("external_links"))
    one = [crawl.sitemaps.agg(F.count("*").alias("total_sitemaps")), crawl.pages.agg(F.count("*").alias("total_pages")), links]
    for row in one:
        sites = sites.crossJoin(row)  # one row each
    return sites


def widen(crawl: Crawl, known: DataFrame, rounds: int = 1, least: float = 0.2, most: int | None = None) -> DataFrame:
    """(domain, category, reason, in_refs, round): sites that the pages of ``known`` ones (domain) link to, and those of the sites found so, for ``rounds`` rounds.

    A candidate (``web.discovery``, ``most`` a round) becomes a site if its front page among the saved ones passes
    ``web.discovery_verdict``; one without a saved page is not judged.  ``in_refs`` are the links of the round that found it.
    """
    order = F.row_number().over(Window.partitionBy("domain").orderBy(F.length("url"), "url", "page_id"))
    front = crawl.pages.where("domain <> ''").withColumn("_n", order).where("_n = 1").drop("_n")
    judged = web.discovery_verdict(front, least).where("accepted").select(F.col("domain").alias("_d"), "reason", site_category(F.col("title"), F.col("domain")).alias("category"))
    seen, out = known.select("domain").distinct(), None
    frontier = seen
    for n in range(1, rounds + 1):
        near = crawl.links.join(frontier.select(F.col("domain").alias("_s")), F.col("source_domain") == F.col("_s"), "left_semi")
        found = web.discovery(near, seen, most).join(judged, F.col("target_domain") == F.col("_d"))
        new = cut(found.select(F.col("target_domain").alias("domain"), "category", "reason", "in_refs", F.lit(n).alias("round")))
        out = new if out is None else out.unionByName(new)
        frontier, seen = new.select("domain"), seen.unionByName(new.select("domain"))
        if new.isEmpty():
            break
    return out


def site(crawl: Crawl, name: str) -> DataFrame:
    """A site's row with how many links go out of its pages and come in from others."""
    links = crawl.links.where(~F.col("is_internal") & ((F.col("source_domain") == name) | (F.col("target_domain") == name)))
    counts = links.agg(F.count_if(F.col("source_domain") == name).alias("links_out"), F.count_if(F.col("target_domain") == name).alias("links_in"))
    return web.lookup(crawl.websites, name).crossJoin(counts)  # one row
