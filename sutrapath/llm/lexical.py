"""Ranked lexical search: the best documents for each of many queries, all documents scored by their terms.

Method.  A threshold-seeded join.  Texts are cut into terms and counted within their row; of these postings, those of terms that a
query has are stored with their impact, which is what the term adds to the document's score.  Each term stores its ten highest impacts:

1. the tenth of these bounds a query's tenth score from below, as ten documents have that impact at least; the documents
   themselves, scored exactly, bound it better (``floor``);
2. a query's terms are ordered by their highest impact; what all terms from one on can add together is that one's suffix bound.
   A term whose suffix bound is below the floor finds no candidates: a document without an earlier term can't be among the ten;
3. the other terms' postings give candidates with a part of their score; those whose part and the bound of all left-out
   terms stay below the floor go.  The tenth highest part is a floor too;
4. what is left is scored exactly, all terms of the query looked up, and ranked.

Nothing is dropped that could be in a result: a bound equal to the floor stays, as ties are decided by doc_id.

Postings of a document lie together, as the task that read the text wrote them, so sums over a query and a document are nearly
complete before they are shuffled.  A frequent term is joined as a small table on the other side allows (Spark broadcasts it where
it is small, else splits the hot key); its ten highest are found in each task before the shuffle.

Defined results
* terms are maximal runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower case; null and empty
  texts have none and don't count as documents; texts are cut whole;
* a term counts once in a query, however often it stands there; queries without a term of any document have no rows;
* equal scores are ranked by doc_id (null last); rows that share an id are documents of their own, and of two with equal id and
  score either may be first; queries that share an id are queries of their own;
* no documents, or no queries: no rows.  Columns other than doc_id and text, item_id and text are neither read nor needed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, scratch, stored, text_slices

#: What is no part of a term, and the constants of the score.
OTHER = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LENGTH_SHARE, SCALE = 90, 1_000_000_000


def term_rows(texts: DataFrame, key: str) -> DataFrame:
    """(row, key, term, tf) of texts (key, text): each distinct term of each row; and a row with the empty term, whose tf is the number of all terms."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                words = Words(pc.replace_substring_regex(pc.fill_null(part.column("text"), ""), OTHER, " "), lower="ascii")
                owner = np.repeat(np.arange(words.rows), words.counts)
                wide = max(1, len(words.distinct))
                pairs, tf = np.unique(owner * wide + words.code, return_counts=True)
                full = np.flatnonzero(words.counts)
                at = np.concatenate([pairs // wide, full])
                order = np.argsort(at, kind="stable")
                terms = pa.concat_arrays([words.distinct.take(pa.array(pairs % wide)).cast(pa.string()), pa.array([""] * len(full), pa.string())])
                rows = pa.array(at[order])
                counts = np.concatenate([tf, words.counts[full]])[order].astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("row").take(rows), part.column(key).take(rows), terms.take(pa.array(order)), pa.array(counts)], ["row", key, "term", "tf"])

    rows = texts.select(F.monotonically_increasing_id().alias("row"), key, "text")
    return rows.mapInArrow(run, f"row long, {key} {kind}, term string, tf long")


def _best(rows: DataFrame, by: str, order: list[Column], most: int) -> DataFrame:
    """The first ``most`` of each ``by``, as ``nth`` 1, 2, ...; each task cuts its own rows before the shuffle."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("nth") <= most)


def impact(tf: Column, measure: Column) -> Column:
    """What one unit of weight is worth in a document of that measure."""
    return F.call_function("div", tf * F.lit(SCALE), F.lit(1000).cast("long") * tf + F.lit(8).cast("long") * measure)


def search(docs: DataFrame, queries: DataFrame, most: int = 10, batch_rows: int = 2000) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``most`` highest-scoring documents (doc_id, text) for each query (item_id, text)."""
    with scratch(docs.sparkSession) as kept:
        out = stored(_search(docs, queries, most, batch_rows), "lexical-found")
        kept.append(out)
    return out


def _search(docs: DataFrame, queries: DataFrame, most: int, batch_rows: int) -> DataFrame:
    asked = stored(term_rows(queries, "item_id").where("term <> ''").select(F.col("row").alias("item"), "item_id", "term"), "lexical-asked", batch_rows)
    # numbers for the terms that queries have, and -1 for the row of a document's length
    known = asked.select("term").distinct().select("term", F.monotonically_increasing_id().alias("t"))
    known = stored(known.union(docs.sparkSession.createDataFrame([("", -1)], "term string, t long")), "lexical-terms")
    postings = stored(term_rows(docs, "doc_id").join(known, "term").select("row", "doc_id", "t", "tf"), "lexical-postings", batch_rows)

    # N, L, and what follows for documents and terms
    lengths = postings.where("t = -1")
    n, words = lengths.agg(F.count("*"), F.sum("tf")).first()
    if not n:
        return docs.sparkSession.createDataFrame([], f"item_id {queries.schema['item_id'].dataType.simpleString()}, rank int, doc_id {docs.schema['doc_id'].dataType.simpleString()}, score long")
    measure = F.lit(100 - LENGTH_SHARE).cast("long") + F.call_function("div", F.lit(LENGTH_SHARE).cast("long") * F.col("n") * F.lit(n), F.lit(words))
    df = postings.where("t >= 0").groupBy("t").agg(F.count("*").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2 * n + 2).cast("double") / (F.lit(2).cast("long") * F.col("df") + 1))).cast("long")
    weights = stored(df.select(F.col("t").alias("_t"), weight.alias("w")), "lexical-weights")
    sized = postings.where("t >= 0").join(lengths.select(F.col("row").alias("_row"), F.col("tf").alias("n")), F.col("row") == F.col("_row"))
    gain = F.col("w") * impact(F.col("tf"), measure)
    impacts = stored(sized.join(weights, F.col("t") == F.col("_t")).select("row", "doc_id", "t", gain.alias("gain")).where("gain > 0"), "lexical-impacts")

    # each term's highest impacts; queries by term
    highest = stored(_best(impacts, "t", [F.col("gain").desc(), F.col("row")], most).select(F.col("t").alias("_t"), "row", "gain", "nth"), "lexical-highest")
    marks = highest.groupBy("_t").agg(F.max("gain").alias("top"), F.coalesce(F.max(F.when(F.col("nth") == most, F.col("gain"))), F.lit(0)).alias("kth"))
    wanted = asked.join(known, "term").select("item", "t").join(marks, F.col("t") == F.col("_t")).select("item", "t", "top", "kth")
    wanted = stored(wanted, "lexical-wanted")

    def exact(pairs: DataFrame) -> DataFrame:
        """(item, row, doc_id, score) of pairs (item, row)."""
        named = wanted.select(F.col("item").alias("_item"), F.col("t").alias("_t"))
        found = impacts.join(pairs.withColumnRenamed("row", "_row"), F.col("row") == F.col("_row")).drop("_row")
        found = found.join(named, (F.col("item") == F.col("_item")) & (F.col("t") == F.col("_t")))
        return found.groupBy("item", "row").agg(F.first("doc_id").alias("doc_id"), F.sum("gain").alias("score"))

    # floors: the kth impact of a term, or the exact kth score of the documents that hold the terms' highest impacts
    seeds = wanted.join(highest.select("_t", "row"), F.col("t") == F.col("_t")).select("item", "row").distinct()
    seeded = _best(exact(stored(seeds, "lexical-seeds")), "item", [F.col("score").desc(), F.col("row")], most)
    seeded = seeded.where(F.col("nth") == most).select("item", F.col("score").alias("floor"))
    floors = wanted.select("item", F.col("kth").alias("floor")).unionByName(seeded).groupBy("item").agg(F.max("floor").alias("floor"))
    floors = stored(floors.withColumnRenamed("item", "_item"), "lexical-floors")

    # terms from the highest on, until what is left can't reach the floor
    later = Window.partitionBy("item").orderBy(F.col("top"), F.col("t").desc()).rowsBetween(Window.unboundedPreceding, 0)
    bounded = wanted.withColumn("suffix", F.sum("top").over(later)).join(floors, F.col("item") == F.col("_item"))
    reach = F.col("suffix") >= F.col("floor")
    rest = F.coalesce(F.max(F.when(~reach, F.col("suffix"))).over(Window.partitionBy("item")), F.lit(0))
    finding = stored(bounded.withColumn("rest", rest).where(reach).select("item", F.col("t").alias("_t"), "rest", "floor"), "lexical-finding")

    parts = impacts.join(finding, F.col("t") == F.col("_t")).groupBy("item", "row").agg(F.sum("gain").alias("part"), F.first("rest").alias("rest"), F.first("floor").alias("floor"))
    parts = stored(parts.where("part + rest >= floor").select("item", "row", "part", "rest"), "lexical-parts")
    higher = _best(parts, "item", [F.col("part").desc(), F.col("row")], most).where(F.col("nth") == most).select(F.col("item").alias("_item"), F.col("part").alias("_floor"))
    left = parts.join(higher, F.col("item") == F.col("_item"), "left").where("_floor is null or part + rest >= _floor").select("item", "row")
    ranked = _best(exact(stored(left, "lexical-candidates")), "item", [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")], most)
    named = asked.select(F.col("item").alias("_item"), "item_id").distinct()
    return ranked.join(named, F.col("item") == F.col("_item")).select("item_id", F.col("nth").cast("int").alias("rank"), "doc_id", "score")


def _sql_terms(text: str) -> str:
    return f"regexp_extract_all(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')"


ORACLE_SQL = f"""WITH d AS (SELECT doc_id, unnest({_sql_terms('text')}) AS term FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY doc_id, term),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY doc_id),
c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM n),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest({_sql_terms('text')}) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))))::BIGINT AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN n USING (doc_id), c GROUP BY item_id, doc_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10"""
