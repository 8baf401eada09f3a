"""Writers: reports as Markdown, CSV and JSON; graph exports; observation templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as lex
from ..operators.ranks import numbered

NOT_MEASURED = "⊥"


#: Banners of a report by mode, and of one whose budget ran out.
BANNERS = {
    "fixture": "> ⚠️ **FIXTURE RUN**: Generated from hash-deterministic synthetic data. Proves nothing about real search demand.",
    "recorded": "> ℹ️ **RECORDED RUN**: Replayed offline from verified historical responses.",
    "live": "> 🟢 **LIVE RUN**: Live Google Autocomplete probe executed.",
}
TRUNCATED = "> ⚠️ **TRUNCATED RUN**: Query ceiling was hit during expansion. Breadth scores marked with ⚠ are non-comparable."


def _optional(scores: DataFrame, name: str, default: Column) -> Column:
    return F.col(name) if name in scores.columns else default


def csv_rows(scores: DataFrame) -> DataFrame:
    """Scores as text cells: four decimals, blank where not measured, in the order of the seeds.

    ``breadth_comparable`` is true where scores don't have it: no query of the seed was left out.
    """
    number = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%.4f", F.col(c))).otherwise("").alias(c)
    truth = lambda c: F.initcap(c.cast("string"))
    count = lambda c: F.col(c).cast("string").alias(c)
    return scores.orderBy("seed_ord").select(
        "seed", number("demand"), truth(F.col("demand_complete")).alias("demand_complete"), "priority_band", "intent", number("breadth"), truth(_optional(scores, "breadth_comparable", F.lit(True))).alias("breadth_comparable"),
        *[number(c) for c in ("coverage", "density", "depth")], F.coalesce("competition_band", F.lit("")).alias("competition_band"), *[count(c) for c in ("suggestions_seen", "queries_asked", "queries_measured", "queries_absent")],
    )


def markdown_report(scores: DataFrame, mode: str, candidates: DataFrame | None = None, not_asked: DataFrame | None = None, truncated: bool = False) -> DataFrame:
    """(part, n, line): a report's lines in order: banners, scores by demand (unmeasured ones last), seeds never asked, candidates.

    ``candidates`` (seed_ord, n, suggestion) are each seed's in order: the first 8 of each, each once, 25 at most.
    """
    spark = scores.sparkSession
    number = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%.3f", F.col(c))).otherwise(NOT_MEASURED)
    head = [f"# Demand report — [{mode.upper()} MODE]", BANNERS[mode], *([TRUNCATED] if truncated else []), "", "## Measured Keywords", "| Seed | Demand | Priority | Intent | Breadth | Coverage | Density | Depth | Competition | Suggestions |", "|---|---|---|---|---|---|---|---|---|---|"]
    fixed = lambda part, lines: spark.createDataFrame([(part, i, x) for i, x in enumerate(lines)], "part int, n long, line string")
    demand = F.concat(number("demand"), F.when(F.col("demand").isNotNull() & ~F.col("demand_complete"), " (partial)").otherwise(""))
    breadth = F.concat(F.when(_optional(scores, "breadth_comparable", F.lit(True)), "").otherwise("⚠ "), number("breadth"))
    cells = [F.concat(F.lit("`"), "seed", F.lit("`")), F.concat(F.lit("**"), demand, F.lit("**")), F.concat(F.lit("`"), "priority_band", F.lit("`")), F.col("intent"), breadth, *[number(c) for c in ("coverage", "density", "depth")], F.coalesce("competition_band", F.lit("unmeasured")), F.col("suggestions_seen").cast("string")]
    placed = numbered(scores, [], [F.col("demand").desc_nulls_last(), F.col("seed_ord")], "_at")
    out = fixed(0, head).unionByName(placed.select(F.lit(1).alias("part"), (F.col("_at") + 1).alias("n"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line")))
    if not_asked is not None:
        out = out.unionByName(fixed(2, ["", "## Ceilings Hit (Never Asked)"])).unionByName(not_asked.select(F.lit(3).alias("part"), F.col("seed_ord").cast("long").alias("n"), F.concat(F.lit("- `"), "seed", F.lit("`")).alias("line")))
    out = out.unionByName(fixed(4, ["", "## Discovered Candidate Keywords (Unvalidated)"]))
    if candidates is not None:
        some = candidates.where("n <= 8").select("suggestion").distinct().orderBy("suggestion").limit(25)
        out = out.unionByName(some.select(F.lit(5).alias("part"), F.row_number().over(Window.partitionBy().orderBy("suggestion")).cast("long").alias("n"), F.concat(F.lit("- "), "suggestion").alias("line")))
    return out.orderBy("part", "n")


def json_rows(scores: DataFrame, discovered: DataFrame | None = None) -> DataFrame:
    """(seed_ord, json) of each score, with the first 20 of its discovered suggestions (seed_ord, n, suggestion)."""
    if discovered is not None:
        lists = discovered.where("n <= 20").groupBy(F.col("seed_ord").alias("_s")).agg(F.sort_array(F.collect_list(F.struct("n", "suggestion")))["suggestion"].alias("_found"))
        scores = scores.join(lists, F.col("seed_ord") == F.col("_s"), "left").drop("_s")
    found = F.coalesce(_optional(scores, "_found", F.lit(None)).cast("array<string>"), F.array().cast("array<string>"))
    signals = F.struct("suggestions_seen", _optional(scores, "breadth_comparable", F.lit(True)).alias("breadth_comparable"), "script_affinity", found.alias("discovered"))
    return scores.select("seed_ord", F.to_json(F.struct("seed", "demand", "demand_complete", "measured_mass", "priority_band", "intent", F.struct("coverage", "breadth", "depth", "density").alias("axes"), "competition_band", signals.alias("signals"))).alias("json"))


def plan_markdown(plan: DataFrame, links: DataFrame, orphans: DataFrame, language: str = "mr") -> DataFrame:
    """(part, n, line): a plan's lines in order: calendar, links between topics, topics without links."""
    spark = plan.sparkSession
    fixed = lambda part, lines: spark.createDataFrame([(part, i, x) for i, x in enumerate(lines)], "part int, n long, line string")
    shapes = F.create_map(*[F.lit(x) for kv in lex.ARTICLE_SHAPES.items() for x in kv])
    out = fixed(0, [f"# Content plan — Language: {language.upper()}", "", "## Recommended Publishing Calendar", "| Order | Topic / Title | Cluster Demand | Primary Intent | Recommended Article Shape |", "|---|---|---|---|---|"])
    row = F.concat_ws(" | ", F.concat(F.lit("| #"), F.col("publish_order").cast("string")), F.concat(F.lit("**"), "primary_title", F.lit("**")), F.format_string("%.3f", "cluster_demand"), F.concat(F.lit("`"), "intent", F.lit("`")), F.concat(F.coalesce(F.try_element_at(shapes, F.col("intent")), F.lit("")), F.lit(" |")))
    out = out.unionByName(plan.select(F.lit(1).alias("part"), F.col("publish_order").cast("long").alias("n"), row.alias("line")))
    out = out.unionByName(fixed(2, ["", "## Internal Link Architecture", "| Source Topic | Target Topic | Suggested Anchor Text |", "|---|---|---|"]))
    placed = numbered(links, [], [F.col("source_topic"), F.col("target_topic")], "_at")
    out = out.unionByName(placed.select(F.lit(3).alias("part"), (F.col("_at") + 1).alias("n"), F.concat(F.lit("| "), F.concat_ws(" | ", "source_topic", "target_topic", F.concat(F.lit("**`"), "target_topic", F.lit("`**"))), F.lit(" |")).alias("line")))
    out = out.unionByName(fixed(4, ["", "## Standalone / Pillar Topics (No Inbound Links Suggested)"]))
    return out.unionByName(orphans.select(F.lit(5).alias("part"), F.col("publish_order").cast("long").alias("n"), F.concat(F.lit("- `"), "primary_title", F.lit("`")).alias("line"))).orderBy("part", "n")


def write_lines(lines: DataFrame, path: str) -> None:
    """One text file of (part, n, line): a report is small."""
    lines.orderBy("part", "n").select("line").coalesce(1).write.mode("errorifexists").text(path)


def append_snapshot(snapshot: DataFrame, path: str, as_of: Column) -> None:
    """Adds one row of totals to the table of snapshots."""
    snapshot.withColumn("calculated_at", as_of).write.mode("append").parquet(path)


def observation_rows(observed: DataFrame) -> DataFrame:
    """Observations (query, thin, weak, stale, own) as the cells of an observation table: yes, no, or blank for not known."""
    cell = lambda c: F.when(F.col(c), "yes").when(~F.col(c), "no").otherwise("")
    return observed.select(F.col("query").alias("keyword"), cell("stale").alias("top_results_stale"), cell("thin").alias("thin_results"), cell("weak").alias("weak_domains"), cell("own").alias("own_sites_ranking"), F.coalesce(_optional(observed, "notes", F.lit("")), F.lit("")).alias("notes"))


def write_dates(rows: DataFrame, path: str) -> None:
    """Result rows with their dates as CSV or JSON, by the path's ending."""
    if path.endswith(".json"):
        rows.write.mode("errorifexists").json(path)
    else:
        write_csv(rows, path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).mode("errorifexists").csv(path)


def write_template(seeds: DataFrame, path: str) -> None:
    """A table to be filled in by hand; an existing one is never overwritten."""
    blank = [F.lit("").alias(c) for c in ("top_results_stale", "thin_results", "weak_domains", "own_sites_ranking", "notes")]
    seeds.select(F.col("seed").alias("keyword"), *blank).write.option("header", True).mode("errorifexists").csv(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("errorifexists").json(f"{path}/nodes")
    edges.write.mode("errorifexists").json(f"{path}/edges")
