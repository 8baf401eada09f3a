from __future__ import annotations

import datetime
import json

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sutrapath.functions import lexicons as lex
from sutrapath.operators import crawl, demand, graph, search, web
from sutrapath.plans import queries as plans
from sutrapath.sources import files, sinks
from sutrapath.streaming import ingest
from sutrapath.streaming.keyed import KeyedTable


def test_page_links(spark):
    html = '<html lang="mr"><title> A  b </title><script>x</script><a href="/p?utm_x=1">1</a><a href="q">2</a><a href="/p">3</a><a href="#f">4</a><a href="mailto:x">5</a><a href="https://www.other.in/z">6</a>'
    pages = spark.createDataFrame([(1, "https://www.site.in/d/e", html), (2, "https://b.in/", None)], "page_id long, url string, html string")
    got = sorted((r["target_url"], r["is_internal"]) for r in web.page_links(pages).collect())
    assert got == [("https://www.other.in/z", False), ("https://www.site.in/d/q", True), ("https://www.site.in/p", True)]
    facts = {r["page_id"]: r for r in web.page_facts(pages).collect()}
    assert facts[1]["title"] == "A b" and facts[1]["is_marathi"] and facts[2]["ratio"] is None and facts[2]["is_marathi"] is None


def test_sitemaps_feeds_and_robots(spark):
    rows = [
        ("i", "<sitemapindex><sitemap><loc>http://a/1.xml</loc></sitemap></sitemapindex>"),
        ("u", "<urlset xmlns='x'><url><loc> http://a/p </loc><lastmod>2026-01-02</lastmod></url><url><loc>http://a/q</loc></url></urlset>"),
        ("f", "<rss><channel><item><title><![CDATA[T]]></title><link>http://a/n</link><pubDate>Mon</pubDate></item></channel></rss>"),
        ("b", "<urlset><url><loc>http://a/broken</loc></url"),
    ]
    got = sorted((r["url"], r["kind"], r["loc"], r["lastmod"]) for r in web.sitemap_entries(spark.createDataFrame(rows, "url string, xml string")).collect())
    assert got == [("f", "feed", "http://a/n", "Mon"), ("i", "index", "http://a/1.xml", None), ("u", "urlset", "http://a/p", "2026-01-02"), ("u", "urlset", "http://a/q", None)]
    robots = spark.createDataFrame([("https://a.in/robots.txt", "# x\nSITEMAP: /s.xml\nsitemap: https://a.in/s.xml\nSitemap: t.xml # n\n")], "url string, body string")
    assert [(r["n"], r["sitemap"]) for r in web.robots_sitemaps(robots).orderBy("n").collect()] == [(1, "https://a.in/s.xml"), (2, "https://a.in/t.xml")]


def test_published_dates(spark):
    rows = [
        (1, '<script type="application/ld+json">{"datePublished": "2026-01-01"}</script><time datetime="2025-01-01">'),
        (2, '<time datetime="2025-01-01"></time><meta name="date" content="2024-01-01">'),
        (3, '<meta property="article:published_time" content="2024-01-01">'),
        (4, "nothing"),
    ]
    got = {r["page_id"]: (r["published"], r["source"], r["confidence"]) for r in web.published_dates(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    assert got == {1: ("2026-01-01", "JSON-LD", "HIGH"), 2: ("2025-01-01", "TIME", "MEDIUM"), 3: ("2024-01-01", "META", "MEDIUM"), 4: (None, "NONE", "NONE")}


def test_upsert_never_forgets(spark):
    old = spark.createDataFrame([("a", "t", "c"), ("b", None, "c")], "url string, title string, category string")
    new = spark.createDataFrame([("a", None, "d", 1), ("b", "x", "d", 1), ("b", "y", None, 2), ("n", None, "e", 1)], "url string, title string, category string, at int")
    got = {r["url"]: (r["title"], r["category"]) for r in web.upsert(old, new, ["url"], "at", keep_old=["category"]).collect()}
    assert got == {"a": ("t", "c"), "b": ("y", "c"), "n": (None, "e")}


def test_readers(spark, tmp_path):
    (tmp_path / "seeds.txt").write_text("# no\n\n शेती \nx\n", encoding="utf-8")
    assert [(r["seed_ord"], r["seed"]) for r in files.seeds(spark, str(tmp_path / "seeds.txt")).collect()] == [(1, "शेती"), (2, "x")]
    (tmp_path / "r.json").write_text(json.dumps({"x": ["x a", "x b"], "y": []}))
    table = files.recorded_suggestions(spark, str(tmp_path / "r.json"))
    queries = spark.createDataFrame([("x",), ("y",), ("z",)], "query string")
    got = {r["query"]: (r["measured"], r["suggestions"]) for r in demand.recorded(queries, table).collect()}
    assert got == {"x": (True, ["x a", "x b"]), "y": (True, []), "z": (False, None)}
    (tmp_path / "o.csv").write_text("keyword,top_results_stale,thin_results,weak_domains,own_sites_ranking,notes\nk,yes,,no,,n\n")
    row = files.observations(spark, str(tmp_path / "o.csv")).first()
    assert (row["stale"], row["thin"], row["weak"]) == (True, None, False)


def test_reports(spark, tmp_path):
    seeds = spark.createDataFrame([(1, "शेती"), (2, "demat account")], "seed_ord long, seed string")
    scores = demand.research(seeds)
    lines = [r["line"] for r in sinks.markdown_lines(scores).collect()]
    assert len(lines) == 2 and all(line.startswith("| ") for line in lines)
    assert json.loads(sinks.json_rows(scores).orderBy("seed_ord").first()["json"])["seed"] == "शेती"
    sinks.write_template(seeds, str(tmp_path / "t"))
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_template(seeds, str(tmp_path / "t"))


def test_unmeasured_is_not_zero(spark):
    seeds = spark.createDataFrame([(1, "x")], "seed_ord long, seed string")
    nothing = spark.createDataFrame([], "query string, suggestions array<string>")
    row = demand.research(seeds, table=nothing).first()
    assert row["demand"] is None and row["priority_band"] == "needs-measurement" and row["coverage"] is None


def test_streams(spark, tmp_path):
    rows = [("u1", "t", "2024-01-01 00:00:00"), ("u1", "t", "2024-01-01 00:05:00"), ("u2", None, "2024-01-01 01:10:00")]
    items = spark.createDataFrame(rows, "url string, title string, at string").selectExpr("url", "title", "timestamp(at) AS published_at")
    items.write.parquet(str(tmp_path / "feed"))
    stream = ingest.feed_stream(spark, str(tmp_path / "feed"), items.schema)
    assert ingest.run_to_memory(ingest.first_seen(stream, "url", "published_at"), "first_seen").count() == 2
    counted = ingest.run_to_memory(ingest.window_counts(stream, "published_at", "url"), "counted", "complete")
    assert sorted((r["url"], r["n"]) for r in counted.collect()) == [("u1", 2), ("u2", 1)]
    merged = ingest.merge_titles(items, spark.createDataFrame([("u1", None), ("u0", "old")], "url string, title string"))
    assert {r["url"]: r["title"] for r in merged.collect()} == {"u0": "old", "u1": "t", "u2": None}


def test_suggestion_cache(spark, tmp_path):
    from sutrapath.sources import cache

    results = spark.createDataFrame([("Sheti ", True, ["a"]), ("x", False, None), ("y", True, [])], "query string, measured boolean, suggestions array<string>")
    cache.write(results, str(tmp_path / "c"), "mr", "in")
    hits, misses = cache.look_up(spark.createDataFrame([("sheti",), ("x",), ("y",)], "query string"), cache.read(spark, str(tmp_path / "c"), "mr", "in"))
    assert {r["query"]: r["suggestions"] for r in hits.collect()} == {"sheti": ["a"], "y": []}
    assert [r["query"] for r in misses.collect()] == ["x"]
    assert cache.read(spark, str(tmp_path / "c"), "hi", "in").count() == 0


def test_reachable_sitemaps(spark):
    index = spark.createDataFrame([("r", "a"), ("r", "b"), ("a", "c"), ("c", "r"), ("z", "y")], "url string, child string")
    got = [(r["url"], r["depth"]) for r in web.reachable_sitemaps(spark.createDataFrame([("r",)], "url string"), index).collect()]
    assert got == [("r", 0), ("a", 1), ("b", 1), ("c", 2)]


def test_slug_titles_and_write_back(spark):
    from pyspark.sql import functions as F

    paths = ["/news/kanda-bhav-12345.html", "/%E0%A4%B6%E0%A5%87%E0%A4%A4%E0%A5%80-%E0%A4%A8%E0%A5%8B%E0%A4%82%E0%A4%A6", "/x", None, "/kandabhav-bhav-market", "/kan-2026-bhav_x.cms", "/-", "/paisa"]
    rows = spark.createDataFrame([(i, p, "paisa.in" if i == 7 else "a.in") for i, p in enumerate(paths)], "page_id int, path string, domain string")
    words = spark.createDataFrame([("kanda", "कांदा"), ("kand", "खंड"), ("bhav", "भाव"), ("ka", "का")], "slug string, native string")
    got = [r["title"] for r in web.slug_titles(rows, words).orderBy("page_id").collect()]
    none, other = f"a.in — {web.NO_WORDS}", f"a.in — {web.OTHER_SITE}"
    # the last word of five letters or more goes as an ending; the longest beginning counts, of four letters at least
    assert got == ["कांदा भाव | a.in", "शेती नोंद | a.in", other, none, "कांदा भाव | a.in", "2026 भाव | a.in", none, f"paisa.in — {web.MONEY_SITE}"]
    sites = spark.createDataFrame([("a", 0.1), ("b", 0.2)], "domain string, pagerank double")
    out = web.write_back(sites, spark.createDataFrame([("a", 0.9, 1.0)], "domain string, pagerank double, hub double"))
    assert {r["domain"]: (r["pagerank"], r["hub"]) for r in out.collect()} == {"a": (0.9, 1.0), "b": (0.2, None)}


def test_gzip_is_known_by_its_first_bytes(spark, tmp_path):
    import gzip

    (tmp_path / "plain.xml").write_bytes("<a>ok</a>".encode())
    (tmp_path / "packed.xml").write_bytes(gzip.compress("<a>शेती</a>".encode()))
    (tmp_path / "broken.gz").write_bytes(b"\x1f\x8bnot really")
    got = {r["url"].rsplit("/", 1)[1]: r["html"] for r in files.raw_pages(spark, str(tmp_path)).collect()}
    assert got["plain.xml"] == "<a>ok</a>" and got["packed.xml"] == "<a>शेती</a>" and "not really" in got["broken.gz"]


def test_result_blocks_and_observations(spark, tmp_path):
    html = "".join(f'<div class="MjjYud"><a href="https://www.s{i}.in/p"><h3>T <b>{i}</b></h3></a></div>' for i in range(12))
    rows = files.result_blocks(spark.createDataFrame([("q", html), ("none", "")], "query string, html string")).collect()
    assert len(rows) == 10 and (rows[0]["rank"], rows[0]["domain"], rows[0]["title"]) == (1, "s0.in", "T 0")
    cells = sinks.observation_rows(spark.createDataFrame([("q", True, False, None, False)], "query string, thin boolean, weak boolean, stale boolean, own boolean")).first()
    assert (cells["thin_results"], cells["weak_domains"], cells["top_results_stale"], cells["own_sites_ranking"]) == ("yes", "no", "", "no")


def test_live_responses(spark):
    rows = [("a", 200, '["a", ["x", "y"]]'), ("b", 200, '["b", []]'), ("c", 200, "{}"), ("d", 429, "[]"), ("e", None, None)]
    got = {r["query"]: (r["suggestions"], r["measured"], r["error"]) for r in files.live_suggestions(spark.createDataFrame(rows, "query string, status int, body string")).collect()}
    assert got == {"a": (["x", "y"], True, None), "b": ([], True, None), "c": (None, False, "protocol"), "d": (None, False, "status 429"), "e": (None, False, "status none")}


def test_sources_by_name(spark, tmp_path):
    queries = spark.createDataFrame([(0, "s", 1, "q1", "head", "head"), (0, "s", 2, "q2", "modifier", "m")], "seed_ord int, seed string, q_ord int, query string, kind string, tag string")
    (tmp_path / "r.json").write_text('{"q1": ["a"]}')
    recorded = {r["query"]: r["measured"] for r in files.suggestions(queries, "recorded", path=str(tmp_path / "r.json")).collect()}
    assert recorded == {"q1": True, "q2": False} and all(r["measured"] for r in files.suggestions(queries, "recorded").collect())
    with pytest.raises(ValueError, match="no such source"):
        files.suggestions(queries, "other")


def test_reports(spark, tmp_path):
    scores = spark.createDataFrame([(0, "b", 0.5, True, 1.0, "high", "howto", 0.1, 0.2, 0.3, None, None, None, 3, 1, 1, 0), (1, "a", None, False, 0.0, "needs-measurement", "unclear", None, None, None, None, None, None, 0, 1, 0, 0)], "seed_ord int, seed string, demand double, demand_complete boolean, measured_mass double, priority_band string, intent string, breadth double, coverage double, density double, depth double, competition_band string, script_affinity double, suggestions_seen long, queries_asked long, queries_measured long, queries_absent long")
    found = spark.createDataFrame([(0, n, f"s{n:02}") for n in range(1, 31)], "seed_ord int, n int, suggestion string")
    lines = [r["line"] for r in sinks.markdown_report(scores, "fixture", found, scores.where("seed_ord = 1"), truncated=True).collect()]
    assert sinks.BANNERS["fixture"] in lines and sinks.TRUNCATED in lines and "- `a`" in lines and lines[-1] == "- s08"
    assert "| `b` | **0.500** | `high` | howto | 0.100 | 0.200 | 0.300 | ⊥ | unmeasured | 3 |" in lines
    sinks.write_lines(sinks.markdown_report(scores, "live"), str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report")).count() == 10
    rows = [json.loads(r["json"]) for r in sinks.json_rows(scores, found).orderBy("seed_ord").collect()]
    assert len(rows[0]["signals"]["discovered"]) == 20 and rows[1]["signals"]["discovered"] == []
    csv = sinks.csv_rows(scores).collect()
    assert len(csv[0].asDict()) == 15 and csv[1]["demand"] == "" and csv[0]["demand_complete"] == "True"
    for day in ("2026-01-01", "2026-01-02"):
        sinks.append_snapshot(spark.createDataFrame([(5,)], "total_domains int"), str(tmp_path / "snapshots"), F.lit(day).cast("timestamp"))
    assert spark.read.parquet(str(tmp_path / "snapshots")).count() == 2
    sinks.write_dates(found, str(tmp_path / "dates.json"))
    assert spark.read.json(str(tmp_path / "dates.json")).count() == 30


def test_ingest_is_idempotent(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "url string, title string, published_at timestamp"
    spark.createDataFrame([("u1", "", "2026-01-01"), ("u2", "two", "2026-01-01")], "url string, title string, at string").select("url", "title", F.col("at").cast("timestamp").alias("published_at")).write.parquet(source)

    def merge(batch, old):
        old = old if old is not None else spark.createDataFrame([("u1", "kept")], "url string, title string")
        return ingest.merge_titles(batch, old)

    for _ in range(2):  # the second run has nothing new
        ingest.ingest(ingest.feed_stream(spark, source, spark.read.parquet(source).schema), str(tmp_path / "table"), str(tmp_path / "check"), merge, ["url"], buckets=1)
    assert {r["url"]: r["title"] for r in KeyedTable(spark, str(tmp_path / "table"), ["url"]).read().collect()} == {"u1": "kept", "u2": "two"}


def test_upsert_settles_equal_times(spark):
    old = spark.createDataFrame([("u", None)], "url string, title string")
    new = spark.createDataFrame([("u", t, 1) for t in ("a", "c", "b")], "url string, title string, at int")
    assert web.upsert(old, new, ["url"], "at").first()["title"] == "c"
    gone = spark.createDataFrame([("u", None, 2)], "url string, title string, at int")
    assert web.upsert(web.upsert(old, new, ["url"], "at"), gone, ["url"], "at", overwrite=["title"]).first()["title"] is None


def test_links_of_pages_saved_twice(spark):
    """A page that was saved twice has each link once."""
    html = '<a href="/p">1</a><a href="https://www.other.in/z">2</a>'
    pages = spark.createDataFrame([(1, "https://site.in/d", html), (2, "https://site.in/d", html + '<a href="/q">3</a>')], "page_id long, url string, html string")
    links = web.page_links(pages)
    assert sorted(r["target_url"] for r in links.collect()) == ["https://site.in/p", "https://site.in/q", "https://www.other.in/z"]
    assert graph.link_matrix(links).where("is_internal").first()["link_count"] == 2
    assert web.summary(web.page_facts(pages), links).first()["links"] == 3
    assert crawl.summary(crawl.read(pages)).first()["total_links"] == 3


def test_directory_rounds_as_sql_does(spark):
    """Halves of the last place: page ranks that only a decimal's digits put at a half."""
    balances = [500 + 1000 * j for j in range(-100, 1000)]
    sites = spark.createDataFrame([(f"s{i}", lex.DIRECTORY[0][3][0], "t", c / 100 / 100000, 1, 1) for i, c in enumerate(balances)], "domain string, category string, title string, pagerank double, sitemap_urls long, pages_crawled long")
    got = {r["domain"]: r["pagerank"] for r in search.directory(sites).collect()}
    duck = duckdb.sql(f"SELECT i, round(b / 100 / 100000, 4) AS r FROM (SELECT unnest({balances}) AS b, unnest(range({len(balances)})) AS i)").fetchall()
    assert {f"s{i}": r for i, r in duck} == got


def test_added_link_counts_for_each_page(spark, tmp_path):
    """Two pages of one URL, each with the added link: two rows of it, other links once."""
    html = '<body><a href="/p">1</a><a href="/p">again</a></body>'
    pages = spark.createDataFrame([(1, "https://site.in/d", html), (2, "https://site.in/d", html)], "page_id long, url string, html string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted((r["target_url"], r["anchor_text"]) for r in plans.web_anchors_odd(spark, str(tmp_path)).collect())
    assert got == [("https://extra.in/p", "Extra link")] * 2 + [("https://site.in/p", "1")]
    assert {(r["target_url"], r["pages"]) for r in web.anchors(pages).collect()} == {("https://site.in/p", 2)}


def test_first_arrival_wins(spark, tmp_path):
    """Of rows of one key and place the one that comes first in the table is inserted, though larger files are read first."""
    folder = tmp_path / "lineitem.parquet"
    folder.mkdir()
    schema = pa.schema([("l_orderkey", pa.int64()), ("l_partkey", pa.int64()), ("l_linenumber", pa.int32()), ("l_linestatus", pa.string())])
    write = lambda name, rows: pq.write_table(pa.Table.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["l_orderkey", "l_partkey", "l_linenumber", "l_linestatus"]).cast(schema), folder / name)
    write("a.parquet", [(1, 5, 2, "O"), (3, 5, 1, "O")])
    write("b.parquet", [(1, 5, 2, "F"), (2, 5, 2, "F"), (2, 5, 2, "O"), (3, 5, 0, "F"), *[(i, 6, 2, "F") for i in range(10, 3000)]])
    got = sorted(tuple(r) for r in plans.web_insert_or_ignore(spark, str(tmp_path)).where("t = 5").collect())
    assert got == [(1, 5, "O"), (2, 5, "F"), (3, 5, "old")]


def test_references_without_semicolon_are_text(spark):
    html = "<title>A &amp;&amp;&amp</title><meta name=description content='x &lt; y &copy &#39;q&#39; &eacute; &nosuch;'>"
    row = web.page_meta(spark.createDataFrame([(1, html)], "page_id long, html string")).first()
    assert row["title"] == "A &&&amp" and row["description"] == "x < y &copy 'q' é &nosuch;"


def test_first_event_of_a_stream(spark, tmp_path):
    """Each user's first event by time, then by number, with how many there were, over several files."""
    schema = "event_id long, user_id long, ts timestamp, props string"
    at = lambda n: datetime.datetime(2024, 1, 1, n)
    rows = [(3, 1, at(5), ""), (2, 1, at(5), ""), (1, 1, at(9), ""), (4, 2, at(1), "")]
    folder = str(tmp_path / "events")
    for row in rows:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = ingest.run_to_table(ingest.firsts(stream, "user_id", "ts", "event_id"), str(tmp_path / "out"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 2, 3), (2, 4, 1)]
    assert set(plans.st_first_seen(spark, "/root/testdata/sf0.001").columns) == {"user_id", "event_id", "times"}
