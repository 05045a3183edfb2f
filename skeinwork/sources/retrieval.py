"""Stored postings and vectors of texts: what retrieval reads, written once with the texts' version.

``texts`` (slab, place, id, len, words, counts) has each text's words and how often it has them; a slab is at most SLAB texts
that follow each other where they are read, and a text goes by its place in one.  ``postings`` (bucket, term, slab, n, most, list)
is partitioned by a hash of the term and sorted within.  A row is a slab's part of a word's list: its size, the highest weight in
it, and the texts' places, counts and lengths, as one binary (``Stored.table`` shows three arrays); a slab that several tasks read
has several such rows.  A question reads the lists of its own words alone:

1. the rows' highest weights give a bound on the score of every slab; the slabs with the highest bounds are scored, and the k-th best of
   their texts is a floor for all;
2. slabs under the floor are left out; of the words, those that even together stay under the floor can't bring a text in by
   themselves (MaxScore), so their lists are read for texts alone that other words bring near enough.

``vectors`` (cell, id, embedding, square, ...) is partitioned by the nearest centre of a coarse quantiser (k-means on at
most about SAMPLE vectors); ``cells`` (cell, centre, n, least) has the smallest cosine within each.  A search reads the
PROBED closest cells; an exact one then reads all cells whose members' angle to the centre allows the k-th best score.
Vectors of zeros and nulls are in cell -1 and score 0.

Both searches give what ``search.bm25`` and ``search.top_k`` give on the texts themselves.  Ids are unique.  With a filter
(a frame of values of a column), only rows it lists are scored; document frequencies stay those of all texts.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import search
from ..runtime import map_arrow, written
from .postings import counted, counter, listed, lists_packer, unpacked

BUCKETS, SLAB, SLABS_FIRST, LISTED, PIECE = 64, 8192, 4, 1000, 200_000
SAMPLE, CELLS, PROBED, ROUNDS = 50_000, 1024, 8, 5
SLACK = 1e-6  # scores are rounded to 6 places


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _weight(avg_len: float) -> Column:
    """A posting's share of a score, without the word's rarity."""
    return F.col("tf") * (search.K1 + 1) / (F.col("tf") + search.K1 * (1 - search.B + search.B * F.col("len") / avg_len))


def _write(df: DataFrame, path: str, name: str, by: str) -> DataFrame:
    """df written below path, partitioned by a column, with its schema beside it, as an empty table has no files."""
    spark = df.sparkSession
    spark.createDataFrame([(df.schema.json(),)], "json string").coalesce(1).write.parquet(f"{path}/schemas/{name}")
    df.write.partitionBy(by).parquet(f"{path}/{name}")
    return spark.read.schema(df.schema).parquet(f"{path}/{name}")


def write_postings(texts: DataFrame, path: str, buckets: int = BUCKETS, slab: int = SLAB) -> None:
    """Write texts, postings and stats of texts (id, text) below path."""
    spark = texts.sparkSession
    number = F.monotonically_increasing_id()  # of one pass: the table is what all others are made of
    plain = texts.select("id", number.alias("number"), F.lower("text").alias("text"))
    shaped = map_arrow(plain, counter(slab), f"slab long, place short, id {texts.schema['id'].dataType.simpleString()}, len int, words string, counts binary")
    shaped.write.parquet(f"{path}/texts")
    kept = spark.read.schema(shaped.schema).parquet(f"{path}/texts")
    kept.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len")).withColumn("buckets", F.lit(buckets)).coalesce(1).write.parquet(f"{path}/stats")
    stats = spark.read.parquet(f"{path}/stats").first()
    pieces = max(1, stats.n_docs // PIECE)  # a bucket is split by slab, so that a task sorts no more as the table grows
    # a row is shuffled for each word of a slab, not for each posting
    lists = map_arrow(kept.select("slab", "place", "len", "words", "counts"), lists_packer(stats.avg_len or 1.0), "term string, slab long, n int, most double, list binary")
    lists = lists.withColumn("bucket", _bucket(F.col("term"), buckets)).repartition(buckets * pieces, "bucket", F.pmod(F.xxhash64("slab"), F.lit(pieces)))
    _write(lists.sortWithinPartitions("bucket", "term", "slab"), path, "postings", "bucket")


def write_vectors(vectors: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE) -> None:
    """Write vectors and cells of vectors (id, embedding, any further columns) below path."""
    spark = vectors.sparkSession
    e = F.col("embedding")
    squared = written(vectors.withColumn("square", F.coalesce(search.dot(e, e), F.lit(0.0))), "vectors")  # once; it is read for each step below
    good = F.expr("square > 0 and not isnan(square) and square < double('infinity')")  # is never null
    usable = squared.where(good)
    n = usable.count()
    if n:
        some = usable.where(F.pmod(F.xxhash64("id"), F.lit(-(-n // sample))) == 0).select(array_to_vector(e.cast("array<double>")).alias("features"))
        some = usable.limit(1).select(array_to_vector(e.cast("array<double>")).alias("features")) if some.isEmpty() else some
        k = cells or min(CELLS, max(2, round(math.sqrt(n))))
        model = KMeans(k=k, distanceMeasure="cosine", initMode="random", maxIter=ROUNDS, seed=7, predictionCol="cell").fit(some)
        centres = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cell int, centre array<double>")
        placed = model.transform(usable.withColumn("features", array_to_vector(e.cast("array<double>")))).drop("features")
    else:
        centres, placed = spark.createDataFrame([], "cell int, centre array<double>"), usable.withColumn("cell", F.lit(-1))
    rest = squared.where(~good).withColumn("cell", F.lit(-1)).withColumn("square", F.lit(0.0))
    stored = _write(placed.unionByName(rest).hint("rebalance", "cell"), path, "vectors", "cell")
    to_centre = search.cosine(e, F.col("centre"), search.dot(F.col("centre"), F.col("centre")))
    spread = stored.join(F.broadcast(centres), "cell").groupBy("cell").agg(F.count("*").alias("n"), F.min(to_centre).alias("least"))  # CELLS rows
    spread.join(F.broadcast(centres), "cell").coalesce(1).write.parquet(f"{path}/cells")


class Stored:
    """The tables below a path."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.schemas = spark, path, {}

    def table(self, name: str, packed: bool = False) -> DataFrame:
        """A table; packed: the postings as they are stored."""
        if name in ("stats", "cells", "texts"):
            return self.spark.read.parquet(f"{self.path}/{name}")
        if name not in self.schemas:
            self.schemas[name] = T.StructType.fromJson(json.loads(self.spark.read.parquet(f"{self.path}/schemas/{name}").first().json))
        rows = self.spark.read.schema(self.schemas[name]).parquet(f"{self.path}/{name}")
        if name != "postings" or packed:
            return rows
        return map_arrow(rows.select("bucket", "term", "slab", "n", "most", "list"), listed, "bucket int, term string, slab long, n int, most double, place array<short>, tf array<int>, len array<int>")

    # ------------------------------------------------------------------------------------------ words
    def bm25(self, question: DataFrame, k: int = 10, keep: DataFrame | None = None) -> DataFrame:
        """(id, score) of the k best texts for the words of the one row of question (text); keep: the ids (id) to score."""
        stats = self.table("stats").first()
        terms = question.select(F.explode(F.array_distinct(search.words(F.col("text")))).alias("term")).distinct()
        asked = terms.select("term", _bucket(F.col("term"), stats.buckets).alias("bucket")).collect()  # one question's words
        lists = self.table("postings", packed=True).where(F.col("bucket").isin(sorted({r.bucket for r in asked})) & F.col("term").isin(sorted(r.term for r in asked)))
        blocks = lists.select("term", "slab", "n", "most")
        postings = map_arrow(lists.select("term", "slab", "n", "list"), unpacked, "term string, slab long, place short, tf int, len int")
        if keep is not None:
            kept = self.table("texts").select("id", "slab", "place").join(keep.select("id").distinct(), "id", "left_semi")
            postings = postings.join(kept.select("slab", "place"), ["slab", "place"], "left_semi")
        known = {r.term: r for r in blocks.groupBy("term").agg(F.sum("n").alias("df"), F.max("most").alias("most")).collect()}
        idf = {t: math.log(1 + (stats.n_docs - r.df + 0.5) / (r.df + 0.5)) for t, r in known.items()}
        if not known:
            return self.table("texts").select("id", F.lit(0.0).alias("score")).limit(0)
        rarity = F.create_map(*(F.lit(x) for kv in idf.items() for x in kv))[F.col("term")]
        rows = postings.select("slab", "place", "term", (rarity * _weight(stats.avg_len)).alias("x"))
        bounds = blocks.groupBy("slab").agg(F.sum(rarity * F.col("most")).alias("bound"))
        first = [r.slab for r in bounds.orderBy(F.desc("bound"), "slab").limit(SLABS_FIRST + 1).collect()]
        near = self._best(rows.where(F.col("slab").isin(first[:SLABS_FIRST])), k, first[:SLABS_FIRST])
        if len(first) <= SLABS_FIRST:
            return near
        found = near.collect()
        if len(found) < k:
            return self._best(rows, k)
        floor = found[-1].score - SLACK
        return self._best(self._above(rows, bounds, {t: idf[t] * r.most for t, r in known.items()}, floor), k, floor=floor)

    def _best(self, rows: DataFrame, k: int, slabs: list[int] | None = None, floor: float | None = None) -> DataFrame:
        """(id, score) of the k best texts by the sums of rows (slab, place, x); of some slabs, or above a floor, where it is known."""
        sums = rows.groupBy("slab", "place").agg(F.round(F.sum("x"), 6).alias("score"))
        sums = sums if floor is None else sums.where(F.col("score") >= floor)
        texts = self.table("texts").select("slab", "place", "id")
        texts = texts if slabs is None else texts.where(F.col("slab").isin(slabs))
        return sums.join(texts, ["slab", "place"]).select("id", "score").orderBy(F.desc("score"), "id").limit(k)

    def _above(self, rows: DataFrame, bounds: DataFrame, most: dict[str, float], floor: float) -> DataFrame:
        """The rows (slab, place, x) of all texts that may reach the floor."""
        slabs = bounds.where(F.col("bound") >= floor).select("slab")
        few = slabs.limit(LISTED + 1).collect()
        rows = rows.where(F.col("slab").isin([r.slab for r in few])) if len(few) <= LISTED else rows.join(slabs, "slab", "left_semi")
        weak, left = [], floor
        for term in sorted(most, key=lambda t: (most[t], t)):
            if most[term] >= left:
                break
            weak.append(term)
            left -= most[term]
        strong = rows.where(~F.col("term").isin(weak))
        if not weak:
            return strong.select("slab", "place", "x")
        sums = strong.groupBy("slab", "place").agg(F.sum("x").alias("x")).where(F.col("x") >= left)
        more = rows.where(F.col("term").isin(weak)).join(sums.select("slab", "place"), ["slab", "place"], "left_semi")
        return sums.select("slab", "place", "x").union(more.select("slab", "place", "x"))

    # ------------------------------------------------------------------------------------------ vectors
    def top_k(self, query: DataFrame, k: int = 5, keep: DataFrame | None = None, on: str = "id", exact: bool = True, probed: int = PROBED) -> DataFrame:
        """(id, score) of the k vectors closest to the one row of query (embedding); keep: the values of the column ``on`` to score.

        Without exact, only the probed closest cells are read."""
        asked = query.select("embedding").first()
        rows = self.table("vectors")
        rows = rows if keep is None else rows.join(keep.select(on).distinct(), on, "left_semi")
        if asked is None:
            return rows.select("id", F.lit(0.0).alias("score")).limit(0)
        q = np.array([0.0 if x is None else x for x in asked.embedding or []], float)
        wanted, length = F.lit([float(x) for x in q]), float(q @ q)
        score = F.coalesce(F.try_divide(search.dot(F.col("embedding"), wanted), F.sqrt(F.col("square") * length)), F.lit(0.0))
        best = lambda cells: rows.where(F.col("cell").isin(cells)).select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)
        closest = self._cells(q)
        first = [c for c, _, _ in closest[:probed]]
        if not exact or len(closest) < probed:
            return best([*first, -1])
        found = best([*first, -1]).collect()
        floor = found[-1].score - SLACK if len(found) == k else -math.inf
        return best([*(c for c, _, bound in closest if bound >= floor), -1])

    def _cells(self, q: np.ndarray) -> list[tuple[int, float, float]]:
        """(cell, cosine of the centre, bound on the cosine of any member), closest first; at most CELLS rows."""
        out = []
        for r in self.table("cells").collect():
            c = np.array(r.centre)
            both = math.sqrt(float(c @ c) * float(q @ q))
            near = float(c @ q) / both if both else 0.0
            angle = math.acos(max(-1.0, min(1.0, near))) - math.acos(max(-1.0, min(1.0, r.least)))
            out.append((r.cell, near, math.cos(max(0.0, angle)) + 1e-9 if both else 0.0))
        return sorted(out, key=lambda x: (-x[1], x[0]))

    def hybrid(self, question: DataFrame, k: int = 5, depth: int = 20, keep: DataFrame | None = None) -> DataFrame:
        """(id, rrf): the best texts for the one row of question (text), by stored vectors and postings, fused; keep: the ids
        (id) to look among."""
        sizes = self.table("vectors").select(F.size("embedding")).first()
        asked = search.embed(question.select(F.lit(0).alias("id"), "text"), sizes[0] if sizes else 64)
        return search.fuse(self.top_k(asked, depth, keep), self.bm25(question, depth, keep), k)


def write(texts: DataFrame, path: str, vectors: DataFrame | None = None) -> Stored:
    """Postings and vectors of texts (id, text), written below path; vectors: theirs (id, embedding), if a model made some."""
    write_postings(texts, path)
    write_vectors(embedded(texts.sparkSession, path) if vectors is None else vectors, path)
    return Stored(texts.sparkSession, path)


def embedded(spark: SparkSession, path: str, dimensions: int = 64) -> DataFrame:
    """search.embed of the texts whose postings are below path, from their counted words."""
    texts = spark.read.parquet(f"{path}/texts").select("id", "words", "counts")
    return search.embed_counts(map_arrow(texts, counted, f"id {texts.schema['id'].dataType.simpleString()}, term string, tf int"), dimensions)
