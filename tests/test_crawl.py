"""Saved files as a crawl: sitemaps whole and broken, sites, counts, sites found through links, and the commands."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sutrapath import cli
from sutrapath.operators import crawl, serp, web
from sutrapath.sources import files as readers

FILES = [
    ("http://a.in/i.xml", "﻿<?xml version='1.0'?><!-- urlset --><sitemapindex><sitemap><loc> http://a.in/1.xml?a=1&amp;b=2 </loc></sitemap></sitemapindex>"),
    ("http://a.in/u.xml", "<urlset><url><loc>http://a.in/p</loc><priority>0.8</priority></url><url><loc>http://a.in/q</loc><priority>high</priority></url><url><lastmod>2026-01-01</lastmod></url></urlset>"),
    ("http://a.in/empty.xml", "<urlset></urlset>"),
    ("http://b.in/cut.xml", "<urlset><url><loc>http://b.in/x</loc><lastmod>2026-01-01</lastmod></url><url><loc>http://b.in/y</loc>"),
    ("http://b.in/index.xml", "<sitemapindex><sitemap><loc>http://b.in/1.xml</loc>"),
    ("http://c.in/text.xml", "not found"),
    ("http://c.in/page.xml", "<html><urlset/></html>"),
    ("http://c.in/null.xml", None),
    ("http://d.in/atom.xml", "<feed><entry><title>A &amp; B</title><link href='http://d.in/e'/><updated>2026-10-01</updated></entry></feed>"),
]
PAGES = [
    (1, "http://a.in/", '<title>शेती</title><a href="http://b.in/">b</a><a href="http://c.in/z">c</a><a href="/p">p</a>'),
    (2, "http://b.in/", '<title>बातमी</title><a href="http://d.in/">d</a>'),
    (3, "http://c.in/", "<title>Only Latin</title><p>words</p>"),
    (4, "http://d.in/", '<html lang="mr"><title>x</title></html>'),
    (5, None, "<p>nowhere</p>"),
]


@pytest.fixture(scope="module")
def sitemaps(spark):
    return spark.createDataFrame(FILES, "url string, xml string")


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string")


def test_scan(sitemaps):
    rows = {}
    for r in web.sitemap_scan(sitemaps).collect():
        rows.setdefault(r["url"][7:], []).append((r["kind"], r["loc"], r["lastmod"], r["priority"], r["title"], r["error"]))
    assert rows["a.in/i.xml"] == [("sitemapindex", "http://a.in/1.xml?a=1&b=2", None, None, None, None)]
    assert sorted(rows["a.in/u.xml"]) == [("urlset", "http://a.in/p", None, 0.8, None, None), ("urlset", "http://a.in/q", None, None, None, None)]
    assert rows["a.in/empty.xml"] == [("urlset", None, None, None, None, None)]
    # what is broken gives its bare <loc> elements, and nothing that stands beside them
    assert sorted(rows["b.in/cut.xml"]) == [("urlset", "http://b.in/x", None, None, None, None), ("urlset", "http://b.in/y", None, None, None, None)]
    assert rows["b.in/index.xml"] == [("sitemapindex", "http://b.in/1.xml", None, None, None, None)]
    assert rows["c.in/text.xml"] == rows["c.in/null.xml"] == [("error", None, None, None, None, "not well-formed")]
    assert rows["c.in/page.xml"] == [("unknown", None, None, None, None, "unknown root")]
    assert rows["d.in/atom.xml"] == [("feed", "http://d.in/e", "2026-10-01", None, "A & B", None)]


def test_sites_and_summary(pages, sitemaps):
    found = crawl.read(pages, sitemaps)
    sites = {r["domain"]: (r["category"], r["pages_crawled"], r["sitemap_status"], r["total_sitemap_urls"]) for r in found.websites.collect()}
    assert sites == {"a.in": ("Agriculture", 1, "found", 2), "b.in": ("News & Media", 1, "found", 2), "c.in": ("Blogs & General", 1, "error", 0), "d.in": ("Blogs & General", 1, "found", 1)}
    total = crawl.summary(found).first().asDict()
    assert total == {"total_domains": 4, "verified_domains": 2, "domains_with_sitemaps": 3, "total_sitemap_urls": 5, "total_sitemaps": 9, "total_pages": 5, "total_links": 4, "internal_links": 1, "external_links": 3}
    one = crawl.site(found, "a.in").first()
    assert (one["links_out"], one["links_in"]) == (2, 0)


def test_without_rows(spark, pages, sitemaps):
    nothing = crawl.read(pages.limit(0), sitemaps.limit(0))
    assert nothing.websites.count() == 0
    assert set(crawl.summary(nothing).first().asDict().values()) == {0}
    assert crawl.read(pages).websites.where("sitemap_status = 'none'").count() == 4
    assert crawl.read(pages.limit(0), sitemaps).websites.where("pages_crawled = 0").count() == 4


def test_widen_goes_through_accepted_sites_only(spark, pages):
    found = crawl.read(pages)
    start = spark.createDataFrame([("a.in",)], "domain string")
    rows = {(r["domain"], r["reason"], r["round"]) for r in crawl.widen(found, start, rounds=5).collect()}
    assert rows == {("b.in", "ratio", 1), ("d.in", "language", 2)}
    assert crawl.widen(found, start, rounds=1).count() == 1


def test_blocked_pages_say_nothing_and_blanks_are_filled(spark):
    seen = serp.observe(spark.createDataFrame([("q1", "<p>CAPTCHA</p>"), ("q2", '<a href="https://quora.com/x">2 days ago</a>'), ("Q2 ", "<p></p>")], "query string, html string"), ["own.in"])
    first = {r["query"]: r for r in seen.collect()}["q1"]
    assert [first[c] for c in ("thin", "weak", "stale", "own")] == [None] * 4 and first["notes"] == "auto:organic=0; weak=0; captcha=detected"
    mine = spark.createDataFrame([(1, "q1", None, None, None, None, "n"), (2, "Q2", False, None, None, True, ""), (3, "q3", None, None, None, None, None)], "ord int, keyword string, thin boolean, weak boolean, stale boolean, own boolean, notes string")
    rows = {r["ord"]: r for r in serp.fill_blanks(mine, seen.where("query <> 'Q2 '")).collect()}
    assert rows[1]["filled"] == 0 and rows[1]["notes"] == "n"
    assert (rows[2]["thin"], rows[2]["weak"], rows[2]["stale"], rows[2]["own"], rows[2]["filled"]) == (False, True, True, True, 2)
    assert rows[2]["notes"] == "auto:organic=1; weak=1; dates=seen" and rows[3]["notes"] is None
    assert serp.fill_blanks(mine, seen).count() == 3


def test_commands(spark, pages, tmp_path, capsys):
    saved, seeds = str(tmp_path / "pages"), tmp_path / "seeds.txt"
    pages.write.parquet(saved)
    folder = tmp_path / "xml"
    folder.mkdir()
    (folder / "u.xml").write_text(FILES[1][1])
    cli.main(["crawl", saved, str(tmp_path / "web"), "--sitemaps", str(folder), "--known", "a.in", "--rounds", "2"])
    assert "total_domains" in capsys.readouterr().out
    assert spark.read.parquet(str(tmp_path / "web" / "links")).count() == 4
    assert {r["domain"] for r in spark.read.parquet(str(tmp_path / "web" / "found")).collect()} == {"b.in", "d.in"}
    snapshots, export = str(tmp_path / "snapshots"), str(tmp_path / "export")
    for _ in range(2):
        cli.main(["graph", str(tmp_path / "web" / "websites"), str(tmp_path / "web" / "links"), "--snapshots", snapshots])
    rows = spark.read.parquet(snapshots)
    assert rows.count() == 2 and rows.where("edges = 3 and total_domains = 4").count() == 2
    cli.main(["graph", str(tmp_path / "web" / "websites"), str(tmp_path / "web" / "links"), "--export", export])
    assert spark.read.json(f"{export}/nodes").count() == 4 and spark.read.json(f"{export}/edges").count() == 3
    seeds.write_text("शेती\nhow to farm\n")
    cli.main(["serp-template", str(seeds), str(tmp_path / "template")])
    assert readers.observations(spark, str(tmp_path / "template")).where("thin is null").count() == 2
    with pytest.raises(Exception, match="exist"):
        cli.main(["serp-template", str(seeds), str(tmp_path / "template")])
    results = str(tmp_path / "results")
    spark.createDataFrame([("शेती", '<a href="https://quora.com/x">a</a>')], "query string, html string").write.parquet(results)
    cli.main(["serp", results, str(tmp_path / "filled"), "--recorded", str(tmp_path / "template")])
    told = {r["keyword"]: r["weak_domains"] for r in spark.read.option("header", True).csv(str(tmp_path / "filled")).collect()}
    assert told == {"शेती": "yes", "how to farm": None}
