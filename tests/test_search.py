from __future__ import annotations

from pyspark.sql import functions as F

from sutrapath.functions.stem import search_tokens, stems, vocabulary
from sutrapath.operators import index, search, serp
from sutrapath.operators.segments import Store


def words(spark, *items):
    return spark.createDataFrame([(w,) for w in items], "word string")


def test_stems(spark):
    got = {r["word"]: r["s"] for r in words(spark, "शेतकऱ्यांना", "पुण्यात", "का", "शिवरायांनी").select("word", stems(F.col("word")).alias("s")).collect()}
    assert "शेतकरी" in got["शेतकऱ्यांना"] and "पुणे" in got["पुण्यात"] and got["का"] == ["का"] and "शिवाजी" in got["शिवरायांनी"]
    terms = {(r["word"], r["term"]) for r in vocabulary(words(spark, "कर्जमाफी", "डीमॅट", "महाकर्जमाफी", "x")).collect()}
    assert {("कर्जमाफी", "कर्ज"), ("कर्जमाफी", "माफी"), ("डीमॅट", "demat"), ("डीमॅट", "dmt"), ("महाकर्जमाफी", "कर्ज")} <= terms and not any(w == "x" for w, _ in terms)


def test_search_tokens(spark):
    rows = spark.createDataFrame([(1, "कर्जमाफी%20योजना"), (2, None), (3, "a"), (4, "100%zz done")], "k int, t string")
    got = {r["k"]: r["terms"] for r in search_tokens(rows, "k", "t").collect()}
    assert {"कर्ज", "माफी", "कर्जमाफी"} <= set(got[1]) and got[2] == [] and got[3] == [] and "done" in got[4]


def test_retrieval_tiers(spark):
    docs = spark.createDataFrame([(1, "डीमॅट खाते कसे उघडावे"), (2, "demat account open"), (3, "weather today"), (4, None)], "doc_id long, text string")
    clusters = search.clusters_of(spark, "डीमॅट खाते")
    got = {r["doc_id"]: r["level"] for r in search.retrieve(docs, clusters).collect()}
    assert got == {1: 1, 2: 1}
    assert search.retrieve(docs, search.clusters_of(spark, "weather डीमॅट")).count() == 3
    assert search.clusters_of(spark, " ") == [] and search.retrieve(docs, []).count() == 0
    found = search.relaxed(docs, clusters, [F.col("doc_id") > 0, F.col("doc_id") > 100])
    assert {r["dropped"] for r in found.collect()} == {1}


def test_best_are_kept_whatever_their_ids(spark):
    docs = spark.createDataFrame([(i, "word " + "other " * (400 - i)) for i in range(400)] + [(1000 + i, "else") for i in range(900)], "doc_id long, text string")
    got = [r["doc_id"] for r in search.retrieve(docs, [["word"]]).collect()]
    assert len(got) == 150 and sorted(got) == list(range(250, 400))


def small_index(spark):
    pages = spark.createDataFrame([(1, "u1", "शेती बातम्या", "/sheti-news", "a.in"), (2, "u2", None, "/demat%20account", "b.in"), (3, "u3", None, "/", "c.in")], "page_id long, url string, title string, path string, domain string")
    return pages, index.build(pages)


def test_index_written_and_read(spark, tmp_path):
    pages, built = small_index(spark)
    assert {r["page_id"] for r in built.documents.collect()} == {1, 2}
    built.write(str(tmp_path / "index"))
    found = Store.open(spark, str(tmp_path / "index")).matches(search.cluster_terms(search.clusters_of(spark, "demat")))
    assert [r["doc_id"] for r in found.collect()] == [2]


def test_index_maintained(spark, tmp_path):
    pages, built = small_index(spark)
    again = index.maintain(built.write(str(tmp_path / "index")), spark.createDataFrame([(2, "u2", "weather", "/x", "b.in"), (9, "u9", "demat", "/", "b.in")], pages.schema))
    assert [r["doc_id"] for r in again.matches(search.clusters_of(spark, "demat")).collect()] == [9]
    assert [r["doc_id"] for r in again.matches(search.clusters_of(spark, "weather")).collect()] == [2]


def test_search_response(spark, tmp_path):
    pages, built = small_index(spark)
    built = built.write(str(tmp_path / "index"))
    pages = pages.withColumns({"lastmod": F.lit("2024-01-19").cast("timestamp"), "fetched_at": F.lit(None).cast("timestamp"), "ratio": F.lit(None).cast("double")})
    sites = spark.createDataFrame([("a.in", "agri", 0.02, None, 0.9), ("b.in", "finance", None, None, None)], "domain string, category string, pagerank double, authority double, ratio double")
    as_of = F.lit("2024-01-20").cast("timestamp")
    results, about = index.respond(built, pages, sites, "शेती आज", as_of)
    row, said = results.first(), about.first()
    assert row["doc_id"] == 1 and row["title"] == "शेती बातम्या | a.in" and row["snippet"].startswith("a.in — शेती") and row["recent"] and row["formatted_date"] == "१९ जानेवारी २०२४"
    assert said["clean_query"] == "शेती आज" and len(said["related"]) == 5
    assert said["total_found"] == 1 and said["intent"] == "freshness" and said["intent_label"].startswith("📰") and said["tier_used"] == "relaxed" and said["notice"] is None
    gone = index.respond(built, pages, sites, "शेती", as_of, category="gov", freshness="24h")[1].first()
    assert gone["total_found"] == 1 and gone["notice"] == "शासकीय".join(index.NO_SECTION)
    assert index.notice("news", "week", 1) == index.NO_FRESH and index.notice(None, "week", 1) == index.NO_FRESH and index.notice("x", None, 1) == "x".join(index.NO_SECTION)
    assert index.respond(built, pages, sites, " ", as_of)[1].first()["intent"] == "unclear"
    none = index.search_index(built, pages, sites, "शेती", as_of, category="nosuch", freshness="24h").first()
    assert none["dropped"] == 2
    assert index.search_index(built, pages, sites, "", as_of).count() == 0
    cards = search.discover(pages, sites, as_of).collect()
    assert [c["page_id"] for c in cards] == [1] and cards[0]["relative_time"] == "काल" and cards[0]["is_featured"]


def test_bm25_prefers_rare_terms(spark):
    docs = spark.createDataFrame([(i, "common " * 3 + ("rare" if i == 0 else "other")) for i in range(10)], "doc_id long, text string")
    best = search.bm25(docs, ["common", "rare"]).orderBy(F.col("bm25").desc()).first()
    assert best["doc_id"] == 0 and best["matched"] == 2


def test_observations(spark):
    link = lambda u: f'<a href="{u}">x</a>'
    many = "".join(link(f"https://site{i}.in/p?q=1") for i in range(9)) + link("https://www.google.com/x")
    pages = spark.createDataFrame([("a", many + "updated 2019"), ("b", link("https://www.quora.com/x") * 2), ("c", "")], "query string, html string")
    got = {r["query"]: (r["thin"], r["weak"], r["stale"], r["own"], r["band"]) for r in serp.observe(pages, ["site1.in"]).collect()}
    assert got == {"a": (False, False, True, True, "very_high"), "b": (True, True, None, False, "low"), "c": (True, False, None, False, "high")}
    assert serp.result_links(pages).where("query = 'b'").count() == 1


def test_cli_weights(capsys):
    from sutrapath.cli import main

    main(["weights"])
    assert "breadth\t0.5" in capsys.readouterr().out


def test_cli_commands(spark, tmp_path, monkeypatch):
    from sutrapath import cli

    monkeypatch.setattr(cli, "_session", lambda: spark)
    pages = small_index(spark)[0].withColumns({"lastmod": F.lit("2024-01-19").cast("timestamp"), "fetched_at": F.lit(None).cast("timestamp"), "ratio": F.lit(None).cast("double")})
    pages.write.parquet(str(tmp_path / "pages"))
    cli.main(["index", str(tmp_path / "pages"), str(tmp_path / "index")])
    assert Store.open(spark, str(tmp_path / "index")).documents().count() == 2
    cli.main(["search", str(tmp_path / "index"), "demat"])
    spark.createDataFrame([("b.in", "finance", None, None, None)], "domain string, category string, pagerank double, authority double, ratio double").write.parquet(str(tmp_path / "sites"))
    cli.main(["search", str(tmp_path / "index"), "demat", "--pages", str(tmp_path / "pages"), "--websites", str(tmp_path / "sites")])
    spark.createDataFrame([("https://b.in/n", "demat", "2024-01-20")], "url string, title string, at string").selectExpr("url", "title", "timestamp(at) AS published_at").write.parquet(str(tmp_path / "feed"))
    cli.main(["refresh", str(tmp_path / "feed"), str(tmp_path / "stored"), str(tmp_path / "index"), str(tmp_path / "check")])
    assert Store.open(spark, str(tmp_path / "index")).documents().count() == 3
    spark.createDataFrame([("a", "x"), ("b", "x")], "domain string, category string").write.parquet(str(tmp_path / "nodes"))
    spark.createDataFrame([("a", "b")], "source_domain string, target_domain string").write.parquet(str(tmp_path / "links"))
    cli.main(["graph", str(tmp_path / "nodes"), str(tmp_path / "links"), "--out", str(tmp_path / "scored")])
    assert {"pagerank", "hub", "in_degree"} <= set(spark.read.parquet(str(tmp_path / "scored")).columns)
    spark.createDataFrame([("q", '<a href="https://www.quora.com/x">x</a>')], "query string, html string").write.parquet(str(tmp_path / "serp"))
    cli.main(["serp", str(tmp_path / "serp"), str(tmp_path / "observed")])
    assert spark.read.option("header", True).csv(str(tmp_path / "observed")).first()["weak_domains"] == "yes"


def test_bm25_splits_texts_once(spark):
    """The result is worked out from stored counts: its plan splits no text, and terms that are asked for twice count once."""
    docs = spark.createDataFrame([(1, "common rare"), (2, "common"), (3, None), (4, "Common common")], "doc_id long, text string")
    got = search.bm25(docs, ["common", "rare", "common"])
    assert "regexp_extract_all" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["doc_id"], r["matched"]) for r in got.collect()} == {(1, 2), (2, 1), (4, 1)}
