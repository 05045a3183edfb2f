"""Exact top-k search by exhaustive term-at-a-time accumulation over integer vectors.

A vector's component x becomes floor(1024 * x); its positions are the terms, its integers the weights.  Candidates stay in
the tasks that read them, in blocks sorted by id.  A block's postings are its columns: the weights of one term, whole where
a quarter of the block has the term, else as (place, weight) pairs.  A query is a sparse row: each of its terms scatters
its weight times the postings into a dense array of the block's scores.  The best are selected by partition, ties to the
smaller id, and merged: over the blocks of a task, then over tasks by a window.

Queries go to the tasks in slices of about SLICE rows, each a broadcast of a size that doesn't grow with the data; there
is one pass over the candidates for each slice.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do those whose squared
integer length is 2**60 or more, as scores have to fit a long; components that a shorter vector lacks are zero, and an
empty vector scores 0 with all.  A row without id is a candidate, after all others in ties, and no query.  Rows that share
an id are rows of their own: each one whose id is a query's is asked, and leaves out one row with its id and vector, which
stands for itself; repeated rows give repeated results.  No rows give no rows; extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import map_arrow
from . import common as C

SCALE, LONGEST = 1024.0, 2.0**60
K, EVERY = 10, 100
BLOCK, SLICE = 16_384, 32_768
WHOLE = 4  # a posting list of a quarter of the block or more is kept whole


def integers(df: DataFrame, *others: str) -> DataFrame:
    """vec_id, v (array<int>) and the other columns of the rows (vec_id, embedding) that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(1)
            offs = col.offsets.to_numpy().astype(np.int64)
            flat = col.values.slice(offs[0], offs[-1] - offs[0]).to_numpy(zero_copy_only=False).astype(np.float64)
            offs = offs - offs[0]
            with np.errstate(all="ignore"):
                flat = np.floor(flat * SCALE)
                square = flat * flat
            bad = ~np.isfinite(square)
            square[bad] = LONGEST
            text = np.repeat(np.arange(len(col)), np.diff(offs))
            keep = (np.bincount(text, square, len(col)) < LONGEST) & col.is_valid().to_numpy(zero_copy_only=False)
            kept = flat[np.repeat(keep, np.diff(offs))].astype(np.int32)
            ends = np.concatenate([[0], np.cumsum(np.diff(offs)[keep])]).astype(np.int32)
            mask = pa.array(keep)
            cols = [b.column(0).filter(mask), pa.ListArray.from_arrays(pa.array(ends), pa.array(kept)), *(b.column(2 + i).filter(mask) for i in range(len(others)))]
            yield pa.RecordBatch.from_arrays(cols, ["vec_id", "v", *others])

    kinds = "".join(f", {o} {df.schema[o].dataType.simpleString()}" for o in others)
    return map_arrow(df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), *others), run, f"vec_id long, v array<int>{kinds}")


def dense(column: pa.ListArray, width: int = 0) -> np.ndarray:
    """The integer vectors as rows of one width, at least the given one; what a vector lacks is zero."""
    offs = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.slice(offs[0], offs[-1] - offs[0]).to_numpy(zero_copy_only=False)
    sizes = np.diff(offs)
    width = max(width, int(sizes.max(initial=0)))
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(offs[:-1] - offs[0], sizes)] = flat
    return out


def postings(block: np.ndarray) -> list[tuple[np.ndarray | None, np.ndarray]]:
    """For each term its (places, weights) within the block; the places are None where the list is whole."""
    out = []
    for column in block.T:
        at = np.flatnonzero(column)
        out.append((None, np.ascontiguousarray(column)) if WHOLE * len(at) >= len(column) else (at, column[at]))
    return out


def accumulate(query: np.ndarray, lists: list[tuple[np.ndarray | None, np.ndarray]], n: int) -> np.ndarray:
    """The dense array of n scores: term by term, the query's weight times the postings."""
    scores = np.zeros(n, np.int64)
    for term in np.flatnonzero(query[: len(lists)]):
        places, weights = lists[term]
        if places is None:
            scores += query[term] * weights
        else:
            scores[places] += query[term] * weights
    return scores


def select(scores: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores, of equal ones the first."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > least)
    return np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])


class Best:
    """The k best candidates of each query so far, with one more for the query's own row."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.ids, self.vectors, self.k = ids, vectors, k + 1
        self.found: list[tuple | None] = [None] * len(ids)  # (score, unknown, id, own) of each query

    def block(self, ids: np.ndarray, unknown: np.ndarray, block: np.ndarray) -> None:
        """Look at a block of candidates."""
        order = np.lexsort((ids, unknown))
        ids, unknown, block = ids[order], unknown[order], block[order]
        lists = postings(block)
        for q, (i, v) in enumerate(zip(self.ids, self.vectors)):
            scores = accumulate(v, lists, len(block))
            at = select(scores, self.k)
            own = (ids[at] == i) & ~unknown[at]
            for j in np.flatnonzero(own):
                row, width = block[at[j]], min(len(v), block.shape[1])
                own[j] = (row[:width] == v[:width]).all() and not row[width:].any() and not v[width:].any()
            part = (scores[at], unknown[at], ids[at], own)
            if self.found[q] is not None:
                part = tuple(np.concatenate(x) for x in zip(self.found[q], part))
            order = np.lexsort((~part[3], part[2], part[1], -part[0]))[: self.k]
            self.found[q] = tuple(x[order] for x in part)

    def rows(self, number: np.ndarray, times: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(self.ids), 10_000):
            some = [(q, f) for q, f in enumerate(self.found[lo : lo + 10_000], lo) if f is not None]
            if some:
                q = np.repeat([q for q, _ in some], [len(f[0]) for _, f in some])
                score, unknown, ids, own = (np.concatenate(x) for x in zip(*(f for _, f in some)))
                cols = [pa.array(number[q]), pa.array(self.ids[q]), pa.array(times[q]), pa.array(ids, mask=unknown), pa.array(score), pa.array(own.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(cols, ["query", "query_id", "times", "vec_id", "score", "own"])


def scores_of(candidates: DataFrame, asked: DataFrame, k: int, base: int) -> DataFrame:
    """query, query_id, times, vec_id, score, own: each task's best for the queries asked (vec_id, v, times), a bounded slice."""
    got = asked.toArrow().combine_chunks()
    column = lambda name: got.column(name).combine_chunks() if got.num_rows else pa.array([], got.schema.field(name).type)
    whole = dense(column("v")) if got.num_rows else np.zeros((0, 0), np.int64)
    shared = candidates.sparkSession.sparkContext.broadcast((column("vec_id").to_numpy(), whole, column("times").to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors, times = shared.value
        best, held = Best(ids, vectors, k), []

        def look() -> None:
            t = pa.Table.from_batches(held).combine_chunks()
            i = t.column("vec_id").combine_chunks()
            best.block(i.fill_null(0).to_numpy(), i.is_null().to_numpy(zero_copy_only=False), dense(t.column("v").combine_chunks()))
            held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                held.append(batch.slice(at, BLOCK))
                if sum(b.num_rows for b in held) >= BLOCK:
                    look()
        if held:
            look()
        yield from best.rows(base + np.arange(len(ids)), times)

    return map_arrow(candidates.select("vec_id", "v"), run, "query long, query_id long, times long, vec_id long, score long, own long")


def top(spark: SparkSession, vectors: DataFrame, k: int = K, every: int = EVERY, slice_rows: int = SLICE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows for each row (vec_id, embedding) whose id is divisible by every."""
    ints = C.table(spark, integers(vectors), "integers")
    asked = C.table(spark, ints.where(F.col("vec_id") % every == 0).groupBy("vec_id", "v").agg(F.count("*").alias("times")), "asked")
    slices = max(1, -(-asked.count() // slice_rows))
    parts = []
    for s in range(slices):
        some = asked.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(slices)) == s)
        part = scores_of(ints, some, k, s << 32)
        parts.append(C.table(spark, part, "best") if slices > 1 else part)
    best = parts[0]
    for part in parts[1:]:
        best = best.union(part)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), F.desc("own"))
    best = best.withColumn("place", F.row_number().over(order)).withColumn("owned", F.sum("own").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    others = best.where("not (own = 1 and owned = 1)").withColumn("rank", (F.col("place") - F.least("owned", F.lit(1))).cast("int")).where(F.col("rank") <= k)
    again = F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))
    return others.select("query_id", "rank", "vec_id", "score", again.alias("again")).drop("again")


def op11_term_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
