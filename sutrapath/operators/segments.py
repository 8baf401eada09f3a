"""A written search index that grows by segments: posting blocks in order of impact, a sorted dictionary, tombstones, compaction.

Layout below a path, ``S`` being the number of a segment:

* ``postings/seg=S/bucket=B``: a row is a block of up to 128 postings of one term, highest impact first.  Buckets are hashes of
  terms, as many as the first segment's size asks for; a term of many blocks is spread over several files of its bucket.  Blocks
  have growing numbers in that order, not consecutive ones;
* ``dictionary/seg=S``: a row for each block with its number of postings, greatest tf and least length, sorted by term, so a
  term or a prefix is one range of it; and one, with block -1 and a negative number, for each term of pages that the segment replaces;
* ``documents/seg=S``: pages with their length and terms, and how often each is there, where it's known; ``deleted/seg=S``: pages that are gone from all earlier segments;
* ``manifest``: which of these are live, how many pages and words there are (``sources.manifest``).

``add`` writes a segment with new and changed pages and touches no file that is there; ``compact`` rewrites only buckets that lie
in several segments; ``vacuum`` deletes what no kept version names.  Answers are those of an index built anew.

A search reads its terms' range of the dictionary, then only their buckets and blocks.  ``best`` skips blocks: the highest blocks
of each term are scored first, and the k-th score is a floor; a block whose greatest impact, with the most that all other
terms can add, stays below it holds no posting of any page among the best, and isn't read.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import manifest
from ..sources.shared import cut
from . import search
from .search import K1, B

#: Postings of a block; blocks of each term that are scored first; postings that ask for a bucket; steps of impact in the order of blocks.
BLOCK, SEEDED, BUCKET_ROWS, STEPS = 128, 2, 1 << 20, 10000
LEAST_BUCKETS, MOST_BUCKETS = 16, 4096
#: Scores are rounded to six places; bounds are compared with a little less.
MARGIN = 2e-6

SCHEMAS = {
    "postings": "term string, block long, pages array<long>, tfs array<long>, dls array<long>, seg int, bucket int",
    "dictionary": "term string, bucket int, block long, n long, max_tf long, min_dl long, seg int",
    "documents": "page_id long, dl long, terms array<string>, tfs array<long>, seg int",
    "deleted": "page_id long, seg int",
}


def part(tf: Column, dl: Column, average: float) -> Column:
    """What a term's frequency in a page of that length is worth, before its weight: grows with tf, falls with length."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(average or 1.0)))


def _weight(n: int, df: int) -> float:
    return max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6)


def documents_of(postings: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(page_id, dl, terms, tfs) of postings (term, page_id, tf); pages of ``ids`` without any have length 0."""
    rows = F.array_sort(F.collect_list(F.struct("term", F.col("tf").cast("long").alias("tf"))))
    out = postings.groupBy("page_id").agg(F.sum("tf").alias("dl"), rows.alias("_rows")).select("page_id", "dl", F.col("_rows.term").alias("terms"), F.col("_rows.tf").alias("tfs"))
    if ids is None:
        return out
    out = ids.select(F.col("page_id").alias("_p")).join(out, F.col("_p") == F.col("page_id"), "left")
    return out.select(F.col("_p").alias("page_id"), F.coalesce("dl", F.lit(0)).alias("dl"), F.coalesce("terms", F.array().cast("array<string>")).alias("terms"), F.coalesce("tfs", F.array().cast("array<long>")).alias("tfs"))


def postings_of(documents: DataFrame) -> DataFrame:
    """(term, page_id, tf, dl) of documents (page_id, dl, terms, tfs)."""
    return documents.select(F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf"))).alias("term", "tf"), "page_id", "dl").select("term", "page_id", "tf", "dl")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (term, block, pages, tfs, dls, bucket) of postings in order of bucket, term and impact: up to ``BLOCK`` neighbours of one term and batch, numbered by the first."""
    for batch in batches:
        if not batch.num_rows:
            continue
        term = batch.column("term").dictionary_encode()
        code, at = np.asarray(term.indices), np.arange(batch.num_rows)
        first = np.r_[True, code[1:] != code[:-1]]  # of a term
        first |= (at - np.maximum.accumulate(np.where(first, at, 0))) % BLOCK == 0
        starts = np.flatnonzero(first)
        offsets = pa.array(np.r_[starts, batch.num_rows], pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, batch.column(c)) for c in ("page_id", "tf", "dl")]
        yield pa.RecordBatch.from_arrays([batch.column("term").take(starts), batch.column("_mid").take(starts), *lists, batch.column("bucket").take(starts)], ["term", "block", "pages", "tfs", "dls", "bucket"])


@dataclasses.dataclass
class Store:
    """An index at a path, in one version."""

    spark: SparkSession
    path: str
    state: dict

    @staticmethod
    def open(spark: SparkSession, path: str) -> Store:
        return Store(spark, path, manifest.read(spark, path))

    @staticmethod
    def create(documents: DataFrame, postings: DataFrame | None, path: str, applied: int | None = None) -> Store:
        """Writes the first segment: documents (page_id, dl, terms), postings (term, page_id, tf); none where documents hold ``tfs``."""
        spark = documents.sparkSession
        if manifest.versions(spark, path):
            raise ValueError(f"there is an index at {path} already")
        documents = cut(documents)
        rows = documents.agg(F.sum(F.size("terms"))).first()[0] or 0
        wanted = 1 << max(0, math.ceil(math.log2(max(1, rows) / BUCKET_ROWS)))
        empty = {"buckets": min(MOST_BUCKETS, max(LEAST_BUCKETS, wanted)), "next": 0, "segments": {}, "n": 0, "words": 0, "applied": None}
        return Store(spark, path, empty).add(documents, postings, applied=applied)

    # --- what is live ---

    def _segments(self, kind: str) -> list[int]:
        return sorted(int(s) for s, x in self.state.get("segments", {}).items() if x[kind])

    def _read(self, kind: str, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], SCHEMAS[kind])
        return self.spark.read.schema(SCHEMAS[kind]).option("basePath", f"{self.path}/{kind}").parquet(*[f"{self.path}/{kind}/{p}" for p in paths])

    def _live(self, rows: DataFrame) -> DataFrame:
        """Rows (page_id, seg) whose page no later segment has replaced."""
        later = self._segments("deleted")
        if not later:
            return rows
        gone = self._read("deleted", [f"seg={s}" for s in later]).select(F.col("page_id").alias("_gone"), F.col("seg").alias("_at"))
        return rows.join(gone, (F.col("page_id") == F.col("_gone")) & (F.col("seg") < F.col("_at")), "left_anti")

    @property
    def average(self) -> float:
        return self.state["words"] / self.state["n"] if self.state.get("n") else 1.0

    def bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.state["buckets"])).cast("int")

    def documents(self) -> DataFrame:
        return self._live(self._read("documents", [f"seg={s}" for s in self._segments("documents")])).drop("seg")

    def dictionary(self) -> DataFrame:
        """(term, bucket, block, n, max_tf, min_dl, seg) of live blocks."""
        rows = self._read("dictionary", [f"seg={s}" for s in self._segments("dictionary")])
        for s, x in self.state.get("segments", {}).items():
            if x["out"]:
                rows = rows.where(~((F.col("seg") == int(s)) & F.col("bucket").isin(x["out"])))
        return rows

    def holders(self, bucket: int) -> list[int]:
        """The segments with live postings in a bucket."""
        return sorted(int(s) for s, x in self.state.get("segments", {}).items() if bucket in x["buckets"] and bucket not in x["out"])

    def postings(self, buckets: list[int]) -> DataFrame:
        """Blocks of some buckets: no other folder is listed or read."""
        rows = self._read("postings", [f"seg={s}/bucket={b}" for b in buckets for s in self.holders(b)])
        return rows.where(F.col("bucket").isin(buckets)) if buckets else rows

    def live_postings(self, buckets: list[int] | None = None) -> DataFrame:
        """(term, page_id, tf, dl) of live pages."""
        rows = self.postings(list(range(self.state.get("buckets", 0))) if buckets is None else buckets)
        return self._live(rows.select("term", "seg", F.inline(F.arrays_zip(F.col("pages").alias("page_id"), F.col("tfs").alias("tf"), F.col("dls").alias("dl"))).alias("page_id", "tf", "dl"))).drop("seg")

    # --- writing ---

    def _write(self, seg: int, postings: DataFrame, minus: DataFrame | None, average: float) -> list[int]:
        """The files of a segment, but for its documents, from postings (term, page_id, tf, dl); returns its buckets.

        Postings are shuffled once, into ranges of bucket, term and impact, whose tasks write their blocks.
        """
        tf, dl = F.col("tf").cast("long"), F.col("dl").cast("long")
        rows = postings.select(self.bucket(F.col("term")).alias("bucket"), "term", (part(tf, dl, average) * STEPS).cast("int").alias("_impact"), "page_id", tf.alias("tf"), dl.alias("dl"))
        by = ["bucket", "term", F.col("_impact").desc(), "page_id"]
        laid = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_mid", F.monotonically_increasing_id())
        laid.drop("_impact").mapInArrow(_packed, SCHEMAS["postings"].replace("seg int, ", "")).write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/postings/seg={seg}")
        blocks = self.spark.read.schema(SCHEMAS["postings"].replace("seg int, ", "")).parquet(f"{self.path}/postings/seg={seg}")
        known = blocks.select("term", "bucket", "block", F.size("pages").cast("long").alias("n"), F.array_max("tfs").alias("max_tf"), F.array_min("dls").alias("min_dl"))
        if minus is not None:
            none = F.lit(0).cast("long")
            known = known.unionByName(minus.select("term", self.bucket(F.col("term")).alias("bucket"), F.lit(-1).cast("long").alias("block"), (-F.col("n")).alias("n"), none.alias("max_tf"), none.alias("min_dl")))
        known.repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.mode("overwrite").parquet(f"{self.path}/dictionary/seg={seg}")
        return sorted(r[0] for r in blocks.select("bucket").distinct().collect())  # the buckets

    def _write_documents(self, seg: int, documents: DataFrame) -> DataFrame:
        """A segment's documents, written and read back; ``tfs`` is null where they don't have it."""
        tfs = F.col("tfs") if "tfs" in documents.columns else F.lit(None).cast("array<long>").alias("tfs")
        documents.select("page_id", F.col("dl").cast("long").alias("dl"), "terms", tfs).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/documents/seg={seg}")
        return self._read("documents", [f"seg={seg}"]).drop("seg")

    def add(self, documents: DataFrame, postings: DataFrame | None = None, removed: DataFrame | None = None, applied: int | None = None) -> Store:
        """The index with new and changed pages as a segment of its own, and without those of ``removed`` (page_id).

        Postings (term, page_id, tf) are those of documents (page_id, dl, terms, tfs) where none are given.
        ``applied`` is the number of the batch that brings them: one that is there already changes nothing.
        """
        if applied is not None and self.state["applied"] is not None and applied <= self.state["applied"]:
            return self
        seg = self.state["next"]
        documents = self._write_documents(seg, documents)
        ids = documents.select("page_id")
        if removed is not None:
            ids = ids.union(removed.select("page_id"))
        minus = old = None
        if self.state["segments"]:
            old = cut(self.documents().drop("tfs").join(ids.distinct(), "page_id", "left_semi"))
            minus = old.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
        new = documents.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words")).first()
        gone = old.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words")).first() if old is not None else {"n": 0, "words": 0}
        state = self.state | {"next": seg + 1, "n": self.state["n"] + new["n"] - gone["n"], "words": self.state["words"] + new["words"] - gone["words"], "applied": self.state["applied"] if applied is None else applied}
        rows = postings_of(documents) if postings is None else postings.select("term", "page_id", "tf").join(documents.select("page_id", "dl"), "page_id")
        buckets = self._write(seg, rows, minus, state["words"] / max(1, state["n"]))
        if gone["n"]:
            old.select("page_id").write.mode("overwrite").parquet(f"{self.path}/deleted/seg={seg}")
        state["segments"] = self.state["segments"] | {str(seg): {"buckets": buckets, "out": [], "documents": True, "dictionary": True, "deleted": bool(gone["n"])}}
        return Store(self.spark, self.path, manifest.commit(self.spark, self.path, state))

    def compact(self, least: int = 3) -> Store:
        """The index with buckets of ``least`` segments or more rewritten as one, others untouched; tombstones go when nothing older is left."""
        many = [b for b in range(self.state["buckets"]) if len(self.holders(b)) >= least]
        if not many:
            return self
        seg, whole = self.state["next"], len(self._segments("documents")) >= least
        documents = self._write_documents(seg, self.documents() if whole else self.spark.createDataFrame([], "page_id long, dl long, terms array<string>, tfs array<long>"))
        if whole and documents.where("tfs is null").isEmpty():
            rows = postings_of(documents).where(self.bucket(F.col("term")).isin(many))
        else:
            rows = self.live_postings(many)
        buckets = self._write(seg, rows, None, self.average)
        old = {s: x | {"out": sorted({*x["out"], *many}), "documents": x["documents"] and not whole} for s, x in self.state["segments"].items()}
        old[str(seg)] = {"buckets": buckets, "out": [], "documents": whole, "dictionary": True, "deleted": False}
        # a segment's dictionary is needed while it has entries in buckets that stay; a tombstone while anything before it does
        for x in old.values():
            x["dictionary"] = x["dictionary"] and len(x["out"]) < self.state["buckets"]
        oldest = min((int(s) for s, x in old.items() if x["documents"] or set(x["buckets"]) - set(x["out"])), default=seg)
        kept = {s: x | {"deleted": x["deleted"] and int(s) > oldest} for s, x in old.items()}
        kept = {s: x for s, x in kept.items() if x["documents"] or x["deleted"] or x["dictionary"] or set(x["buckets"]) - set(x["out"])}
        return Store(self.spark, self.path, manifest.commit(self.spark, self.path, self.state | {"next": seg + 1, "segments": kept}))

    def vacuum(self) -> list[str]:
        """Deletes files that the last versions don't name."""
        known = [Store(self.spark, self.path, s) for s in manifest.kept_versions(self.spark, self.path)]
        folders = {kind: {f"seg={s}" for k in known for s in k._segments(kind)} for kind in ("dictionary", "documents", "deleted")}
        folders["postings"] = {f"seg={s}" for k in known for s, x in k.state["segments"].items() if set(x["buckets"]) - set(x["out"])}
        return manifest.vacuum(self.spark, self.path, folders)

    # --- reading ---

    @staticmethod
    def _which(terms: list[str], prefix: bool) -> tuple[Column, Column]:
        """Whether a term of the index is meant, in a form that reaches the files, and which of ``terms`` it stands for."""
        one = lambda t: F.col("term").startswith(t) if prefix else F.col("term") == t
        hit = F.lit(False)
        for t in terms:
            hit = hit | one(t)
        return hit, F.array_compact(F.array(*[F.when(one(t), F.lit(i)) for i, t in enumerate(terms)]))

    def matched(self, terms: list[str], prefix: bool) -> DataFrame:
        """The dictionary's rows of ``terms``, or of terms that begin with them, with ``i``, which one it is."""
        hit, which = self._which(terms, prefix)
        return self.dictionary().where(hit).withColumn("i", F.explode(which))

    def hits(self, matched: DataFrame, terms: list[str], prefix: bool, skipping: bool = False) -> DataFrame:
        """(i, page_id, tf, dl) of live pages, of all blocks of the terms or, ``skipping``, of those in ``matched``."""
        hit, which = self._which(terms, prefix)
        buckets = sorted(r[0] for r in matched.where("block >= 0").select("bucket").distinct().collect())  # the buckets
        rows = self.postings(buckets).where(hit)
        if skipping:
            wanted = matched.select(F.col("seg").alias("_s"), F.col("term").alias("_t"), F.col("block").alias("_b"), "i")
            rows = rows.join(wanted, (F.col("seg") == F.col("_s")) & (F.col("term") == F.col("_t")) & (F.col("block") == F.col("_b")))
        else:
            rows = rows.withColumn("i", F.explode(which))
        flat = F.inline(F.arrays_zip(F.col("pages").alias("page_id"), F.col("tfs").alias("tf"), F.col("dls").alias("dl"))).alias("page_id", "tf", "dl")
        return self._live(rows.select("i", "seg", flat)).select("i", "page_id", "tf", "dl")

    @staticmethod
    def _by_page(hits: DataFrame, count: int) -> DataFrame:
        """(doc_id, dl, tf: an array with a number for each of the terms)."""
        tf = [F.sum(F.when(F.col("i") == i, F.col("tf")).otherwise(0)).cast("int") for i in range(count)]
        return hits.groupBy(F.col("page_id").alias("doc_id")).agg(F.first("dl").alias("dl"), F.array(*tf).alias("tf"))

    def matches(self, clusters: list[list[str]], prefix: bool = True) -> DataFrame:
        """(doc_id, clusters_hit, bm25) of all pages with a term of any cluster; their terms' blocks are read once."""
        terms = [t for c in clusters for t in c]
        if not terms or not self.state.get("n"):
            return self.spark.createDataFrame([], "doc_id long, clusters_hit int, bm25 double")
        found = self._by_page(self.hits(cut(self.matched(terms, prefix)), terms, prefix), len(terms))
        return search.scored(cut(found), clusters, self.state["n"], self.average)

    def frequencies(self, matched: DataFrame, terms: list[str], prefix: bool) -> list[int]:
        """In how many pages each of ``terms`` is: by the dictionary, or, where several terms stand for it, by the pages of their blocks."""
        held = matched.groupBy("i").agg(F.sum("n").alias("n"), F.count_distinct("term").alias("terms")).collect()  # a row for each term
        out = {r["i"]: r["n"] for r in held}
        several = [r["i"] for r in held if r["terms"] > 1]
        if several:
            pages = self.hits(matched.where(F.col("i").isin(several)), terms, prefix).where(F.col("i").isin(several)).select("i", "page_id").distinct()
            out |= {r["i"]: r["count"] for r in pages.groupBy("i").count().collect()}
        return [out.get(i, 0) for i in range(len(terms))]

    def _floor(self, scores: DataFrame, clusters: int | None, most: int) -> float | None:
        """The score of the last of the best, if there are that many."""
        if clusters is not None:
            scores = scores.where(F.col("clusters_hit") == clusters)
        best = scores.orderBy(F.col("bm25").desc()).limit(most).agg(F.count("*").alias("n"), F.min("bm25").alias("least")).first()
        return best["least"] if best["n"] == most else None

    def promising(self, matched: DataFrame, clusters: list[list[str]], df: list[int], prefix: bool, most: int, every: bool) -> DataFrame | None:
        """Of ``matched`` the blocks that may hold postings of the ``most`` best pages; null where all have to be read."""
        terms = [t for c in clusters for t in c]
        tops = matched.where("block >= 0").groupBy("i", "term").agg(F.max(part(F.col("max_tf"), F.col("min_dl"), self.average)).alias("top"), F.count("*").alias("blocks"))
        each = {r["i"]: r for r in tops.groupBy("i").agg(F.sum("top").alias("top"), F.max("blocks").alias("blocks")).collect()}
        if max((r["blocks"] for r in each.values()), default=0) <= SEEDED:
            return None
        ahead = F.row_number().over(Window.partitionBy("seg", "i", "term").orderBy("block"))  # blocks of the query's terms
        first = self.hits(cut(matched.where("block >= 0").withColumn("_n", ahead).where(F.col("_n") <= SEEDED).drop("_n")), terms, prefix, skipping=True)
        scores = search.scored(cut(self._by_page(first, len(terms))), clusters, self.state["n"], self.average, df)
        floor = self._floor(scores, len(clusters) if every else None, most)
        if floor is None:
            return None
        weights = [_weight(self.state["n"], d) for d in df]
        reach = [w * min(K1 + 1, each[i]["top"]) if i in each else 0.0 for i, w in enumerate(weights)]
        table = self.spark.createDataFrame([(i, w, each[i]["top"] if i in each else 0.0, sum(reach) - reach[i]) for i, w in enumerate(weights)], "_i int, weight double, all_tops double, others double")
        rows = matched.where("block >= 0").join(F.broadcast(table), F.col("i") == F.col("_i"))  # a row for each term of the query
        rows = rows.join(tops.select(F.col("i").alias("_j"), F.col("term").alias("_t"), "top"), (F.col("i") == F.col("_j")) & (F.col("term") == F.col("_t")))
        own = F.least(F.lit(K1 + 1), F.col("all_tops") - F.col("top") + part(F.col("max_tf"), F.col("min_dl"), self.average))
        return rows.where(F.col("weight") * own + F.col("others") >= floor - MARGIN).select(*matched.columns)

    def best(self, clusters: list[list[str]], most: int = 150, every: bool = False, prefix: bool = True) -> DataFrame:
        """(doc_id, clusters_hit, bm25) of the ``most`` best pages with a term of any cluster, or of ``every`` one; ties go by doc_id."""
        terms = [t for c in clusters for t in c]
        if not terms or not self.state.get("n"):
            return self.spark.createDataFrame([], "doc_id long, clusters_hit int, bm25 double")
        matched = cut(self.matched(terms, prefix))
        df = self.frequencies(matched, terms, prefix)
        chosen = self.promising(matched, clusters, df, prefix, most, every)
        hits = self.hits(matched, terms, prefix) if chosen is None else self.hits(cut(chosen), terms, prefix, skipping=True)
        scores = search.scored(cut(self._by_page(hits, len(terms))), clusters, self.state["n"], self.average, df)
        if every:
            scores = scores.where(F.col("clusters_hit") == len(clusters))
        return scores.orderBy(F.col("bm25").desc(), "doc_id").limit(most)

    def retrieve(self, clusters: list[list[str]], most: int = 150, least: int = 5) -> DataFrame:
        """(doc_id, level, clusters_hit, bm25): the best pages with all clusters (level 1), and with fewer than ``least`` such, with any (level 2)."""
        chosen = search.cluster_terms(clusters)
        full = cut(self.best(chosen, most, every=True))
        out = full.select("doc_id", F.lit(1).alias("level"), "clusters_hit", "bm25")
        if len(clusters) > 1 and len(full.take(least)) < least:
            more = self.best(chosen, most).where(F.col("clusters_hit") < len(clusters))
            out = out.unionByName(more.select("doc_id", F.lit(2).alias("level"), "clusters_hit", "bm25"))
        return out

    def bm25(self, terms: list[str]) -> DataFrame:
        """(doc_id, matched, bm25) of all pages with any of the terms, as whole words."""
        return self.matches([[t] for t in terms], prefix=False).select("doc_id", F.col("clusters_hit").cast("long").alias("matched"), "bm25")
