"""Connected components of a link table, as rounds of joins; nothing is collected but two numbers a round."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import map_arrow
from . import common as C

PART = 250_000  # edges that a task contracts by itself


def contract(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertex, smallest vertex that these edges lead to) for each vertex but the smallest of its component."""
    names, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = list(range(len(names)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(ends[: len(u)].tolist(), ends[len(u) :].tolist()):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    ends = np.array([find(x) for x in range(len(root))], np.int64)
    moved = ends != np.arange(len(root))
    return names[moved], names[ends[moved]]


def _contracted(edges: DataFrame, parts: int) -> DataFrame:
    """edges, each part of them as stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for b in batches:
            us.append(b.column(0).to_numpy())
            vs.append(b.column(1).to_numpy())
            if sum(map(len, us)) > 8 * PART:  # a part may be larger than planned: keep what it comes to
                us, vs = ([x] for x in contract(np.concatenate(us), np.concatenate(vs)))
        u, v = contract(np.concatenate(us), np.concatenate(vs))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return map_arrow(edges.coalesce(parts), run, "u long, v long")


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("s")).first()
    return (r.n, r.s)


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(v, component) for every vertex of links (a, b); component is the smallest vertex that can be reached.

    First each task contracts its part of the edges, about PART of them, to stars; if there is one part, that is all.
    Else alternating large-star and small-star rounds follow: all larger neighbours of a vertex, then all smaller ones, are tied to
    the smallest.  The result is a star for each component.  Each round is written to the shared folder, so that a lost
    executor costs one round.  Vertices without a link aren't listed; nulls and links of a vertex to itself are dropped.
    """
    edges = C.table(spark, links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    parts = -(-edges.count() // PART)
    edges = C.table(spark, _contracted(edges, max(1, parts)), "edges")
    before = _state(edges) if parts > 1 else (0, None)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = C.table(spark, large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        edges = C.table(spark, small, "edges")
        now = _state(edges)
        if now == before:
            break
        before = now
    return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "v").union(edges.select(F.col("v"), F.col("v").alias("component")).distinct())
