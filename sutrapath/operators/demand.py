"""Keyword demand: query expansion, suggestion sources, NULL-aware signals, scores, editorial plan.

A null is "not measured" throughout and never becomes 0.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classify as cls
from ..functions import lexicons as lex
from ..functions.text import WORD, contains_any, dedup_key, nfc_all, script_of, topic_key
from ..sources import cache
from ..sources.shared import cut
from .blocks import blocked_join
from .ranks import numbered


@dataclass(frozen=True)
class Weights:
    """Pinned weights of the four axes; they sum to 1 and are never rescaled."""

    breadth: float = 0.50
    coverage: float = 0.25
    density: float = 0.15
    depth: float = 0.10

    def __post_init__(self):
        if abs(self.breadth + self.coverage + self.density + self.depth - 1) > 1e-9:
            raise ValueError("weights must sum to 1")


def templates(spark: SparkSession, language: str, latin: bool = False, commercial: bool = False) -> DataFrame:
    """(stage, ord, kind, tag, latin_only, other_only, head, tail): what is put around a seed, in order.  A bounded table."""
    spec, rows = cls.spec(language), [(0, 0, "head", "head", None, "", "")]
    rows += [(1, i, "alphabet", c, True, "", f" {c}") for i, c in enumerate(lex.CONSONANTS["latin"])]
    rows += [(1, i, "alphabet", c, False, "", f" {c}") for i, c in enumerate(lex.CONSONANTS[spec["consonants"]])]
    if latin:
        rows += [(2, i, "alphabet", c, False, "", f" {c}") for i, c in enumerate(lex.CONSONANTS["latin"])]
    rows += [(3, i, "modifier", m, None, "", f" {m}") for i, (m, _) in enumerate(spec["modifiers"])]
    rows += [(4, i, "question", q, None, *q.split("{t}", 1)) for i, q in enumerate(spec["questions"])]
    if commercial:
        rows += [(5, i, "commercial", a, None, "", f" {m}") for i, (m, a) in enumerate(lex.COMMERCIAL.get(language, lex.COMMERCIAL["mr"]))]
    return spark.createDataFrame(rows, "stage int, ord int, kind string, tag string, for_latin boolean, head string, tail string")


def expand(seeds: DataFrame, language: str = "mr", latin: bool = False, commercial: bool = False) -> DataFrame:
    """(seed_ord, seed, q_ord, query, kind, tag) of seeds (seed_ord, seed): queries in order, each key once for a seed."""
    seeds = seeds.withColumn("seed", F.trim("seed")).where("seed <> ''").withColumn("_latin", script_of(F.col("seed")) == "latin")
    table = templates(seeds.sparkSession, language, latin, commercial)
    rows = seeds.join(F.broadcast(table), F.col("for_latin").isNull() | (F.col("for_latin") == F.col("_latin")))
    rows = rows.withColumn("query", F.trim(F.concat("head", "seed", "tail"))).where("query <> ''").withColumn("_key", dedup_key(F.col("query")))
    order = Window.partitionBy("seed_ord").orderBy("stage", "ord")
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("seed_ord", "_key").orderBy("stage", "ord"))).where("_n = 1")
    return first.select("seed_ord", "seed", F.row_number().over(order).alias("q_ord"), "query", "kind", "tag")


def expected_counts(seeds: DataFrame, language: str = "mr", latin: bool = False, commercial: bool = False) -> DataFrame:
    """(seed_ord, seed, expected): how many queries a seed has if no two are alike; modifiers count once, commercial ones only where they aren't modifiers."""
    spec = cls.spec(language)
    general = {m for m, _ in spec["modifiers"]}
    more = {m for m, _ in lex.COMMERCIAL.get(language, lex.COMMERCIAL["mr"])} - general if commercial else set()
    native = len(lex.CONSONANTS[spec["consonants"]]) + (len(lex.CONSONANTS["latin"]) if latin else 0)
    letters = F.when(script_of(F.col("seed")) == "latin", len(lex.CONSONANTS["latin"])).otherwise(native)
    return seeds.select("seed_ord", "seed", (letters + 1 + len(general) + len(spec["questions"]) + len(more)).cast("long").alias("expected"))


def admit(expansion: DataFrame, max_seeds: int | None = None, max_queries: int | None = None) -> DataFrame:
    """``expansion`` with ``admitted``: the first seeds, and queries in order up to the budget, which may end within a seed.

    What a seed may take follows from the queries of the seeds before it: running sums in two levels, over one row per seed.
    """
    sizes = expansion.groupBy("seed_ord").agg(F.count("*").alias("_size"))
    placed = numbered(sizes, [], [F.col("seed_ord")], "_rank", upto={"_upto": "_size"}).withColumnRenamed("seed_ord", "_s")
    # admitted seeds are the first ones, so what those before a seed take is the running sum
    asked = F.lit(True) if max_seeds is None else F.col("_rank") < max_seeds
    out = expansion.join(placed.withColumns({"_asked": asked, "_before": F.col("_upto") - F.col("_size")}), F.col("seed_ord") == F.col("_s"))
    fits = F.lit(True) if max_queries is None else F.col("_before") + F.col("q_ord") <= max_queries
    return out.select(*expansion.columns, (F.col("_asked") & fits).alias("admitted"))


def fixture(queries: DataFrame, language: str = "mr") -> DataFrame:
    """``queries`` (query, ...) with measured and suggestions, made from a hash of language and query."""
    spec = cls.spec(language)
    q = F.trim("query")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{language}:"), q), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    mods = F.array(*[F.lit(m) for m, _ in spec["modifiers"]])
    asks = F.array(*[F.lit(x.replace("{t}", "").strip()) for x in spec["questions"]])

    def at(items: Column, n: int, shift: int) -> Column:
        return F.element_at(items, ((F.col("_h") + shift) % n).cast("int") + 1)

    tails = [at(mods, len(spec["modifiers"]), 0), at(mods, len(spec["modifiers"]), 1), at(asks, len(spec["questions"]), 0), *[F.lit(x) for x in ("2026", "pdf", "online", "माहिती", "app", "news", "list")]]
    made = F.array_distinct(F.concat(F.array(q), *[F.array(F.concat(q, F.lit(" "), t)) for t in tails]))
    made = F.slice(made, F.lit(1), (F.col("_h") % 8).cast("int") + 3)
    empty = (q == "") | ((F.col("_h") % 10 == 0) & (F.size(F.split(q, r"\s+")) > 2))
    return queries.withColumn("_h", h).withColumn("measured", F.lit(True)).withColumn("suggestions", F.when(empty, F.array().cast("array<string>")).otherwise(made)).drop("_h")


def recorded(queries: DataFrame, table: DataFrame) -> DataFrame:
    """``queries`` with the suggestions of a recorded table (query, suggestions); a missing one is not measured, which isn't empty."""
    found = table.select(F.col("query").alias("_q"), F.col("suggestions"))
    out = queries.join(found, F.trim("query") == F.col("_q"), "left")
    return out.withColumn("measured", F.col("_q").isNotNull()).drop("_q")


def seen(results: DataFrame) -> DataFrame:
    """(seed_ord, n, suggestion, key): each seed's suggestions, those of the head first, each key once."""
    rows = results.where("measured").select("seed_ord", "q_ord", F.posexplode("suggestions").alias("pos", "suggestion")).withColumn("key", dedup_key(F.col("suggestion")))
    order = Window.partitionBy("seed_ord", "key").orderBy("q_ord", "pos")
    first = rows.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return first.select("seed_ord", F.row_number().over(Window.partitionBy("seed_ord").orderBy("q_ord", "pos")).alias("n"), "suggestion", "key")


def signals(results: DataFrame, language: str = "mr") -> DataFrame:
    """The demand axes and counters of each seed from results (seed_ord, seed, q_ord, query, kind, measured, suggestions)."""
    head, filled = F.col("kind") == "head", F.size("suggestions") > 0
    measured = F.coalesce(F.col("measured"), F.lit(False))
    keys = F.transform(nfc_all(F.when(head & measured, F.col("suggestions"))), lambda t: dedup_key(t, normal=False))
    rank = F.array_position(keys, dedup_key(F.col("seed")))
    base = results.groupBy("seed_ord", "seed").agg(
        F.max(F.when(head & measured, F.when(filled, 1.0).otherwise(0.0))).alias("coverage"),
        (F.count_if(~head & measured & filled) / F.nullif(F.count_if(~head & measured), F.lit(0))).alias("breadth"),
        F.max(F.when(head & measured & filled, rank)).alias("_rank"),
        F.count("*").alias("queries_asked"),
        F.count_if(measured).alias("queries_measured"),
        F.count_if(measured & ~filled).alias("queries_absent"),
        F.count_if(~measured).alias("queries_failed"),
    )
    base = base.withColumn("best_rank", F.when(F.col("_rank") > 0, F.col("_rank"))).withColumn("depth", F.when(F.col("_rank") > 0, 1 / F.col("_rank")).when(F.col("_rank") == 0, 0.0)).drop("_rank")
    # the question share of the head's suggestions as they are, or of all others' once each where the head is known to be empty
    asks = F.avg(cls.is_question(F.col("suggestion"), language).cast("double"))
    own = results.where(head & measured & filled).select("seed_ord", F.explode("suggestions").alias("suggestion")).groupBy("seed_ord").agg(asks.alias("_own"))
    s = F.col("suggestion")
    pool = seen(results).select("seed_ord", "suggestion", cls.buyer_intent(s).alias("buyer"), script_of(s).alias("script"))
    of_pool = pool.groupBy("seed_ord").agg(
        asks.alias("_pool"), F.count("*").alias("suggestions_seen"), F.avg(F.col("buyer").isNotNull().cast("double")).alias("_buyer"),
        *[F.count_if(F.col("script") == name).alias(f"n_{name}") for name in ("devanagari", "latin", "mixed")],
    )
    out = base.join(own, "seed_ord", "left").join(of_pool, "seed_ord", "left").fillna(0, ["suggestions_seen", "n_devanagari", "n_latin", "n_mixed"])
    mine = script_of(F.col("seed"))
    near = F.when(mine == "devanagari", F.col("n_devanagari")).when(mine == "latin", F.col("n_latin")).when(mine == "mixed", F.col("n_mixed")).otherwise(0) + F.col("n_mixed")
    out = out.withColumn("density", F.when(F.col("coverage") == 1, F.col("_own")).when(F.col("coverage") == 0, F.col("_pool")))
    out = out.withColumn("script_affinity", F.when(F.col("suggestions_seen") > 0, near / F.col("suggestions_seen"))).withColumn("buyer_intent_score", F.coalesce("_buyer", F.lit(0.0)))
    return out.withColumn("n_other", F.col("suggestions_seen") - F.col("n_devanagari") - F.col("n_latin") - F.col("n_mixed")).drop("_own", "_pool", "_buyer")


def axis_yield(results: DataFrame) -> DataFrame:
    """(seed_ord, kind, hits, measured) of each kind of query."""
    measured = F.coalesce(F.col("measured"), F.lit(False))
    return results.groupBy("seed_ord", "kind").agg(F.count_if(measured & (F.size("suggestions") > 0)).alias("hits"), F.count_if(measured).alias("measured"))


def candidates(results: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed_ord, n, suggestion): suggestions worth research: no seed, no artefact of the alphabet, more than 3 characters."""
    known = seeds.select(dedup_key(F.col("seed")).alias("_key")).distinct()
    artefact = F.col("suggestion").rlike(rf"(?i)(\s{WORD}$)|(\s[bcdfghjklmnpqrstvwxyzक-ह]\s)")
    out = seen(results).join(known, F.col("key") == F.col("_key"), "left_anti")
    return out.where(~artefact & (F.length(F.trim("suggestion")) > 3)).select("seed_ord", "n", "suggestion")


def score(rows: DataFrame, weights: Weights = Weights()) -> DataFrame:
    """Adds demand, measured_mass, demand_complete and bands to rows with the axes, intent and competition_band."""
    axes = {a: getattr(weights, a) for a in ("breadth", "coverage", "density", "depth")}
    mass = sum((F.when(F.col(a).isNotNull(), w).otherwise(0.0) for a, w in axes.items()), F.lit(0.0))
    total = sum((F.coalesce(F.col(a) * w, F.lit(0.0)) for a, w in axes.items()), F.lit(0.0))
    out = rows.withColumn("measured_mass", mass).withColumn("demand", F.when(F.col("measured_mass") > 0, total))
    out = out.withColumn("demand_complete", F.col("measured_mass") >= 1 - 1e-5).withColumn("evidence_band", cls.evidence_band(F.col("demand")))
    return out.withColumn("priority_band", cls.priority_band(F.col("demand"), F.col("intent"), F.col("competition_band")))


def actionable(scores: DataFrame) -> DataFrame:
    """Scores that something can be done about: measured, and not looking for one site."""
    return scores.where("demand is not null and intent <> 'navigational'")


def effective_intent(scores: DataFrame, seen: DataFrame, language: str = "mr", wanted: str = "auto") -> DataFrame:
    """(seed_ord, seed, effective) of scores (seed_ord, seed, intent): what suggestions (seed_ord, suggestion) and the seed speak for.

    A ``wanted`` perspective decides by itself.  Else each suggestion is a vote, and the seed's own words are two.
    """
    if wanted in ("affiliate", "commercial", "howto", "comparison", "informational"):
        return scores.select("seed_ord", "seed", F.lit("commercial" if wanted == "affiliate" else wanted).alias("effective"))

    def votes(text: Column) -> dict[str, Column]:
        lower = F.lower(text)
        return {"buy": cls.buyer_intent(text).isNotNull(), "how": contains_any(lower, lex.HOWTO_WORDS), "versus": contains_any(lower, lex.VERSUS_WORDS)}

    pool = seen.groupBy(F.col("seed_ord").alias("_s")).agg(*[F.count_if(v).alias(f"_{k}") for k, v in votes(F.col("suggestion")).items()], F.count_if(cls.is_question(F.col("suggestion"), language)).alias("_ask"))
    out = scores.join(pool, F.col("seed_ord") == F.col("_s"), "left")
    n = {k: F.coalesce(f"_{k}", F.lit(0)) + F.when(v, 2).otherwise(0) for k, v in votes(F.col("seed")).items()}
    raw = F.col("intent")
    effective = (
        F.when(raw.isin("transactional", "commercial") | (n["buy"] >= 2), "commercial")
        .when((raw == "comparison") | (n["versus"] >= 1), "comparison")
        .when((raw == "howto") | (n["how"] >= 2), "howto")
        .when(raw.isin("informational", "freshness") | (F.coalesce("_ask", F.lit(0)) >= 3), "informational")
        .otherwise(F.when(n["buy"] > 0, "commercial").otherwise("informational"))
    )
    return out.select("seed_ord", "seed", effective.alias("effective"))


def competition(seeds: DataFrame, observations: DataFrame) -> DataFrame:
    """``seeds`` (seed_ord, seed) with the band of an observation (ord, keyword, thin, weak, stale): the last of equal keys, else the first of equal topics."""
    obs = observations.select("ord", dedup_key(F.col("keyword")).alias("_key"), topic_key(F.col("keyword")).alias("_topic"), F.struct("keyword", cls.competition_band(F.col("thin"), F.col("weak"), F.col("stale")).alias("band")).alias("o"))
    exact = obs.groupBy("_key").agg(F.max_by("o", "ord").alias("_exact"))
    topic = obs.groupBy("_topic").agg(F.min_by("o", "ord").alias("_near"))
    out = seeds.withColumns({"_k": dedup_key(F.col("seed")), "_t": topic_key(F.col("seed"))})
    out = out.join(exact, F.col("_k") == F.col("_key"), "left").join(topic, F.col("_t") == F.col("_topic"), "left")
    found = F.coalesce("_exact", "_near")
    return out.select(*seeds.columns, found["keyword"].alias("observed_keyword"), found["band"].alias("competition_band"))


def clusters(scores: DataFrame) -> DataFrame:
    """(topic_id, primary_title, intent, members, cluster_demand, publish_order) of scores (seed_ord, seed, demand, intent).

    The primary is the member with the highest demand, the first of equal ones; missing demand counts as 0 in the mean.
    """
    rows = scores.withColumn("topic_id", topic_key(F.col("seed")))
    best = F.min_by(F.struct("seed", "intent"), F.struct((-F.coalesce("demand", F.lit(-1.0))).alias("d"), "seed_ord"))
    out = rows.groupBy("topic_id").agg(best.alias("_p"), F.count("*").alias("members"), F.avg(F.coalesce("demand", F.lit(0.0))).alias("cluster_demand"), F.min("seed_ord").alias("_first"))
    # the calendar is one total order over topics: places within range partitions, after the rows of those before
    placed = numbered(out, [], [F.col("cluster_demand").desc(), F.col("_first")], "_at")
    return placed.select("topic_id", F.col("_p.seed").alias("primary_title"), F.col("_p.intent").alias("intent"), "members", "cluster_demand", (F.col("_at") + 1).cast("int").alias("publish_order"))


def topic_links(plan: DataFrame) -> DataFrame:
    """(source_topic, target_topic): topics whose titles share a word, or, from an informational page to a specific one, a letter of their skeletons.

    Skeletons meet as sets of letters: each distinct set once, however many topics have it, and topics only through pairs of
    sets.  All joins are of blocks of a bounded number of rows.  A pair is made once: through its least common word, or
    through letters where it has no word in common; so nothing has to be made distinct.
    """
    rows = plan.select(F.col("primary_title").alias("topic"), "intent", F.array_distinct(F.filter(F.split(F.lower("primary_title"), r"\s+"), lambda w: w != "")).alias("words"), topic_key(F.col("primary_title")).alias("skeleton"))
    rows = cut(rows.withColumn("letters", F.when(F.length("skeleton") >= 2, F.array_sort(F.array_distinct(F.filter(F.split("skeleton", ""), lambda x: x != ""))))).drop("skeleton"))
    names = lambda df, side: df.withColumnsRenamed({c: f"{side}_{c}" for c in df.columns if c != "key"})
    common = lambda c: F.array_min(F.array_intersect(f"source_{c}", f"target_{c}"))

    worded = rows.select("topic", "words", F.explode("words").alias("key"))
    a = blocked_join(names(worded, "source"), names(worded, "target"), "key").where(F.col("key") == common("words"))

    source, target = rows.where("intent = 'informational'"), rows.where(F.col("intent").isin("howto", "freshness", "commercial"))
    sets = lambda df: df.select("letters", F.explode("letters").alias("key"))
    distinct = lambda df: df.where("letters is not null").select("letters").distinct()
    met = blocked_join(names(sets(distinct(source)), "source"), names(sets(distinct(target)), "target"), "key").where(F.col("key") == common("letters"))
    met = met.select("source_letters", "target_letters")
    # a pair of sets is the key that topics meet by
    pair = F.struct("source_letters", "target_letters").alias("key")
    of = lambda df, side: names(df.select("topic", "words", "letters"), side).join(met.withColumnRenamed(f"{side}_letters", "_own"), F.col(f"{side}_letters") == F.col("_own"))
    b = blocked_join(of(source, "source").select("source_topic", "source_words", pair), of(target, "target").select("target_topic", "target_words", pair), "key")
    b = b.where(~F.arrays_overlap("source_words", "target_words"))
    return a.select("source_topic", "target_topic").union(b.select("source_topic", "target_topic")).where("source_topic <> target_topic")


def orphans(plan: DataFrame, links: DataFrame) -> DataFrame:
    """Topics in no link."""
    linked = links.select(F.col("source_topic").alias("_t")).union(links.select("target_topic"))
    return plan.join(linked.distinct(), F.col("primary_title") == F.col("_t"), "left_anti").select("publish_order", "primary_title")


def answers(queries: DataFrame, ask: Callable[[DataFrame], DataFrame], cache_path: str | None = None, language: str = "mr", region: str = "IN") -> DataFrame:
    """``queries`` with measured and suggestions: those that are cached from there, the others asked once and, where measured, cached."""
    if cache_path is None:
        return ask(queries)
    spark = queries.sparkSession
    hits, misses = cache.look_up(queries, cache.read(spark, cache_path, language, region))
    hits = cut(hits)  # before the table grows
    fresh = cut(ask(misses))
    if not fresh.isEmpty():
        cache.write(fresh, cache_path, language, region)
    return hits.unionByName(fresh.select(*hits.columns))


def research(
    seeds: DataFrame, language: str = "mr", table: DataFrame | None = None, observations: DataFrame | None = None, weights: Weights = Weights(), ask: Callable[[DataFrame], DataFrame] | None = None,
    cache_path: str | None = None, region: str = "IN", max_seeds: int | None = None, max_queries: int | None = None,
) -> DataFrame:
    """Seeds to scores: expansion within the ceilings, suggestions (``ask``, a recorded table, or the fixture; cached ones are not asked again), signals, intent, competition, score.

    With ceilings, seeds of which no query is asked have no row (``not_asked``), and ``breadth_comparable`` says whether all of a seed's queries were.
    """
    queries = expand(seeds, language)
    limited = max_seeds is not None or max_queries is not None
    if limited:
        queries = cut(admit(queries, max_seeds, max_queries))
        whole = queries.groupBy(F.col("seed_ord").alias("_s")).agg(F.bool_and("admitted").alias("breadth_comparable"))
        queries = queries.where("admitted").drop("admitted")
    ask = ask or ((lambda q: fixture(q, language)) if table is None else (lambda q: recorded(q, table)))
    results = answers(queries, ask, cache_path, language, region)
    out = signals(results, language).withColumn("intent", cls.intent(F.col("seed"), language))
    if limited:
        out = out.join(whole, F.col("seed_ord") == F.col("_s")).drop("_s")
    if observations is None:
        out = out.withColumn("competition_band", F.lit(None).cast("string"))
    else:
        bands = competition(seeds, observations).select(F.col("seed_ord").alias("_s"), "competition_band")
        out = out.join(bands, F.col("seed_ord") == F.col("_s"), "left").drop("_s")
    return score(out, weights)


def not_asked(seeds: DataFrame, scores: DataFrame) -> DataFrame:
    """Seeds that ceilings left out."""
    return seeds.join(scores.select(F.col("seed_ord").alias("_s")), F.col("seed_ord") == F.col("_s"), "left_anti")
