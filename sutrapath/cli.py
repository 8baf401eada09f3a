"""Command line: research, plan, weights, graph, index, refresh, search, suggest, directory, crawl, serp, serp-template, serp-dates, sitemaps."""

from __future__ import annotations

import argparse
import dataclasses

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import crawl, demand, graph, index, search, serp, web
from .operators.segments import Store
from .sources import files, sinks
from .streaming.ingest import feed_stream, live_index


def _session() -> SparkSession:
    return SparkSession.builder.appName("sutrapath").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="sutrapath")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("research", "plan"):
        c = commands.add_parser(name)
        c.add_argument("seeds")
        c.add_argument("--language", default="mr")
        c.add_argument("--recorded")
        c.add_argument("--observations")
        c.add_argument("--out")
        c.add_argument("--cache")
        c.add_argument("--max-seeds", type=int)
        c.add_argument("--max-queries", type=int)
    commands.add_parser("weights")
    c = commands.add_parser("graph")
    c.add_argument("nodes")
    c.add_argument("links")
    c.add_argument("--out")
    c.add_argument("--snapshots", help="table of snapshots that a row is added to")
    c.add_argument("--export", help="folder for nodes and edges as JSON")
    c = commands.add_parser("crawl")
    c.add_argument("pages", help="Parquet of saved pages: page_id, url, html")
    c.add_argument("out")
    c.add_argument("--sitemaps", help="saved sitemap files")
    c.add_argument("--domain", help="show one site")
    c.add_argument("--known", action="append", default=[], help="sites to find others from")
    c.add_argument("--rounds", type=int, default=1)
    c.add_argument("--max-candidates", type=int, default=100)
    c = commands.add_parser("serp-template")
    c.add_argument("seeds")
    c.add_argument("out")
    c = commands.add_parser("search")
    c.add_argument("index")
    c.add_argument("query")
    c.add_argument("--pages")
    c.add_argument("--websites")
    c.add_argument("--category")
    c.add_argument("--freshness")
    c.add_argument("--sort", default="relevance")
    c = commands.add_parser("refresh")
    c.add_argument("feed")
    c.add_argument("pages")
    c.add_argument("index")
    c.add_argument("checkpoint")
    c.add_argument("--every")
    c = commands.add_parser("index")
    c.add_argument("pages")
    c.add_argument("out")
    c.add_argument("--websites", help="sites whose categories are indexed too")
    for name in ("serp", "serp-dates"):
        c = commands.add_parser(name)
        c.add_argument("pages")
        c.add_argument("out")
        c.add_argument("--own", action="append", default=[])
        c.add_argument("--recorded", help="observation table whose blank cells are filled")
    c = commands.add_parser("sitemaps")
    c.add_argument("files")
    c = commands.add_parser("suggest")
    c.add_argument("titles")
    c.add_argument("prefix")
    c = commands.add_parser("directory")
    c.add_argument("sites")
    a = parser.parse_args(args)
    if a.command == "weights":
        for k, v in dataclasses.asdict(demand.Weights()).items():
            print(f"{k}\t{v}")
        return
    spark = _session()
    if a.command in ("research", "plan"):
        table = files.recorded_suggestions(spark, a.recorded) if a.recorded else None
        observed = files.observations(spark, a.observations) if a.observations else None
        scores = demand.research(files.seeds(spark, a.seeds), a.language, table, observed, cache_path=a.cache, max_seeds=a.max_seeds, max_queries=a.max_queries)
        if a.command == "plan":
            plan = demand.clusters(scores)
            links = demand.topic_links(plan)
            lines = sinks.plan_markdown(plan, links, demand.orphans(plan, links), a.language)
            if a.out:
                sinks.write_lines(lines, a.out)
            else:
                lines.select("line").show(5000, truncate=False)
        elif a.out:
            sinks.write_csv(sinks.csv_rows(scores), a.out)
        else:
            sinks.csv_rows(scores).show(1000, truncate=False)
    elif a.command == "graph":
        nodes, matrix = spark.read.parquet(a.nodes), graph.link_matrix(spark.read.parquet(a.links))
        edges = graph.cross_edges(matrix, nodes)
        graph.snapshot(nodes, matrix).show()
        scores = graph.pagerank(nodes, edges).join(graph.hits(nodes, edges), "domain")
        for column in ("pagerank", "authority", "hub"):
            graph.top(scores, column).show()
        if a.snapshots:
            counts = nodes.agg(F.count("*").alias("total_domains"), *[F.sum(c).alias(f"total_{c}") for c in ("pages_crawled", "total_sitemap_urls") if c in nodes.columns])
            sinks.append_snapshot(graph.record(nodes, matrix, scores, counts), a.snapshots, F.current_timestamp())
        if a.export:
            sinks.write_graph(web.write_back(nodes, scores), edges, a.export)
        if a.out:
            web.write_back(nodes, scores.join(graph.degrees(nodes, edges), "domain")).write.mode("errorifexists").parquet(a.out)
    elif a.command == "search":
        store = Store.open(spark, a.index)
        if a.pages and a.websites:
            pages, sites = spark.read.parquet(a.pages), spark.read.parquet(a.websites)
            found, about = index.respond(store, pages, sites, a.query, F.current_timestamp(), category=a.category, freshness=a.freshness, sort_by=a.sort)
            about.show(truncate=False)
            found.show(25, truncate=False)
        else:
            store.retrieve(search.clusters_of(spark, a.query)).orderBy("level", F.col("bm25").desc(), "doc_id").show(25)
    elif a.command == "refresh":
        stream = feed_stream(spark, a.feed, spark.read.parquet(a.feed).schema)
        query = live_index(stream, a.pages, a.index, a.checkpoint, a.every)
        if a.every:
            query.awaitTermination()
    elif a.command == "index":
        index.build(spark.read.parquet(a.pages), spark.read.parquet(a.websites) if a.websites else None).write(a.out)
    elif a.command == "crawl":
        saved = files.raw_pages(spark, a.sitemaps).withColumnRenamed("html", "xml") if a.sitemaps else None
        found = crawl.read(spark.read.parquet(a.pages), saved)
        found.write(a.out)
        crawl.summary(found).show(truncate=False)
        if a.domain:
            crawl.site(found, a.domain).show(truncate=False)
        if a.known:
            known = spark.createDataFrame([(d,) for d in a.known], "domain string")
            crawl.widen(found, known, a.rounds, most=a.max_candidates).write.mode("errorifexists").parquet(f"{a.out}/found")
    elif a.command == "serp":
        seen = serp.observe(spark.read.parquet(a.pages), a.own or None)
        if a.recorded:
            seen = serp.fill_blanks(files.observations(spark, a.recorded), seen).orderBy("ord").withColumnRenamed("keyword", "query")
        sinks.write_csv(sinks.observation_rows(seen), a.out)
    elif a.command == "serp-template":
        sinks.write_template(files.seeds(spark, a.seeds), a.out)
    elif a.command == "serp-dates":
        sinks.write_dates(files.result_blocks(spark.read.parquet(a.pages)), a.out)
    elif a.command == "sitemaps":
        scan = web.sitemap_scan(files.raw_pages(spark, a.files).withColumnRenamed("html", "xml"))
        web.sitemap_states(scan).orderBy("sitemap_url").show(1000, truncate=False)
        scan.where("loc is not null").orderBy("url", "n").show(1000, truncate=False)
    elif a.command == "suggest":
        search.suggest(spark.read.parquet(a.titles), a.prefix).show(truncate=False)
    else:
        search.directory(spark.read.parquet(a.sites)).orderBy("section", "rank").show(200, truncate=False)


if __name__ == "__main__":
    main()
