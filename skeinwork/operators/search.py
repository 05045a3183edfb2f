"""Filtered top-k retrieval: cosine over dense vectors, BM25 over words, and reciprocal rank fusion.

A vector of zeros is like nothing: its cosine with any other is 0.  ``embed`` makes vectors without a model: words fall into
dimensions, with a sign, by a hash.

BM25 has k1 = 1.2 and b = 0.75 over lower-cased words of a to z; fusion adds 1 / (60 + rank).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B, RRF = 1.2, 0.75, 60


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, bb: Column | None = None) -> Column:
    """The cosine of a and b, 0 if either is all zeros; bb: the dot product of b with itself, if it is known."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a) * (dot(b, b) if bb is None else bb))), F.lit(0.0))


def top_k(vectors: DataFrame, query: DataFrame, k: int | None = 5) -> DataFrame:
    """(id, score) of the k vectors (id, embedding) closest to the one row of query (embedding); all of them without k."""
    q = query.select(F.col("embedding").alias("wanted"), dot(F.col("embedding"), F.col("embedding")).alias("length")).limit(1)
    scored = vectors.join(F.broadcast(q)).select("id", F.round(cosine(F.col("embedding"), F.col("wanted"), F.col("length")), 6).alias("score"))  # one row: no pairing
    return scored if k is None else scored.orderBy(F.desc("score"), "id").limit(k)


def embed(texts: DataFrame, dimensions: int = 64) -> DataFrame:
    """(id, embedding) of texts (id, text): each word adds 1 or -1 to one dimension, both taken from its MD5 sum.

    A text without words (or null) is all zeros; rows that share an id are one text."""
    return embed_counts(texts.select("id", F.explode_outer(words(F.col("text"))).alias("term"), F.lit(1).alias("tf")), dimensions)


def embed_counts(counted: DataFrame, dimensions: int = 64) -> DataFrame:
    """embed of words that have been counted (id, term, tf); a text without words has a row with nulls."""
    digit = lambda at, n: F.conv(F.substring("h", at, n), 16, 10).cast("int")
    each = counted.select("id", F.md5("term").alias("h"), F.col("tf").cast("double").alias("n"))
    signed = each.select("id", (digit(1, 4) % dimensions).alias("d"), F.when(digit(5, 1) % 2 == 0, F.col("n")).otherwise(-F.col("n")).alias("x"))
    sums = [F.coalesce(F.sum(F.when(F.col("d") == i, F.col("x"))), F.lit(0.0)) for i in range(dimensions)]
    return signed.groupBy("id").agg(F.array(*sums).alias("embedding"))  # a task adds a text's words up before they are shuffled


def top_k_filtered(vectors: DataFrame, query: DataFrame, keep: DataFrame, on: str, k: int = 5) -> DataFrame:
    """top_k of the vectors whose column ``on`` is listed in keep: filtered before scoring."""
    return top_k(vectors.join(keep.select(on).distinct(), on, "left_semi"), query, k)


def rerank(candidates: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """(id, score, rank) of the best k candidates: by their scores, if they have a column ``score`` without a null, else by
    cosine."""
    if "score" in candidates.columns:
        every = candidates.agg((F.count("score") == F.count("*")).alias("every"))  # one row
        own = candidates.join(F.broadcast(every)).where("every").select("id", F.round(F.col("score"), 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)
        anew = top_k(candidates.join(F.broadcast(every)).where("not every"), query, k)
        best = own.union(anew)  # one of them is empty
    else:
        best = top_k(candidates, query, k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # k rows


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: w != "")


def bm25(texts: DataFrame, query: Column | DataFrame, k: int | None = 10) -> DataFrame:
    """(id, score) of texts (id, text) against the words of query, a one-row frame (text).

    Only the postings of the query's words are made; lengths are summed apart, so that no frame has a row for each word
    of the corpus but the wanted ones.
    """
    terms = query.select(F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    sized = texts.select("id", words(F.col("text")).alias("ws")).select("id", "ws", F.size("ws").alias("len"))
    stats = sized.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))
    hits = sized.select("id", "len", F.explode("ws").alias("term")).join(F.broadcast(terms), "term", "left_semi")
    tf = hits.groupBy("id", "len", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    scored = tf.join(F.broadcast(df), "term").join(F.broadcast(stats)).groupBy("id").agg(F.round(F.sum(idf * weight), 6).alias("score"))
    return scored if k is None else scored.orderBy(F.desc("score"), "id").limit(k)


def hybrid(texts: DataFrame, question: DataFrame, k: int = 5, depth: int = 20, vectors: DataFrame | None = None) -> DataFrame:
    """(id, rrf): the best texts (id, text) for the one row of question (text), by embeddings and by BM25, fused.  vectors:
    the texts' embeddings, if they are kept."""
    asked = embed(question.select(F.lit(0).alias("id"), "text"))
    return fuse(top_k(embed(texts) if vectors is None else vectors, asked, depth), bm25(texts, question, depth), k)


def fuse(first: DataFrame, second: DataFrame, k: int = 5) -> DataFrame:
    """(id, rrf) of two ranked lists (id, score), each of bounded length."""
    rank = lambda df, name: df.select("id", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias(name))
    part = lambda name: F.coalesce(1 / (RRF + F.col(name)), F.lit(0.0))
    both = rank(first, "r1").join(rank(second, "r2"), "id", "full")
    return both.select("id", F.round(part("r1") + part("r2"), 6).alias("rrf")).orderBy(F.desc("rrf"), "id").limit(k)
