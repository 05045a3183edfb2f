"""Best-fit packing by hierarchical residual packing.

1. Every text is tokenized whole, an end id follows, and texts over the capacity are cut into pieces.
2. Each task packs its pieces by best fit, longest first.  Bins that are nearly full are done.
3. Underfull bins become items and are packed again by best fit, up a tree: each round has an eighth (FAN_IN) of the groups
   of the one before, but no group of much over UP bins, so that a task's memory is bounded.  All underfull bins go up each
   time, dealt to the groups by a hash.  It ends with the round of one group, or, on tables whose underfull bins are more
   than a group may hold, when a round has merged no more than one bin in STALLED.  No piece is ever left out.

A piece ends up with the sequence of its last bin and the sum of the places on the way.

Defined results: a null or empty text is one piece of the end id alone; rows that share a doc_id are packed row by row; an
empty table gives an empty result; extra columns are left alone.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import map_arrow, ship
from . import common as C
from .tokens import default_path, encoder

CAPACITY, END_ID = 4096, 1
SLACK = 16  # a bin with less room than this is nearly full
FAN_IN, UP = 8, 50_000
STALLED = 100
LOCAL = 500_000  # pieces that a task packs at a time


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, place in the bin) of each item and the bins' fill: longest first, each where the least room is left.

    Bins are kept by their room, and a bit set of the rooms that occur finds the best one in constant time.
    """
    order = np.argsort(-sizes, kind="stable")
    bin_of, place = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, fill = 0, []
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        above = mask >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            b, room = len(fill), capacity
            fill.append(0)
        bin_of[i], place[i] = b, fill[b]
        fill[b] += size
        room -= size
        if room:
            rooms[room].append(b)
            mask |= 1 << room
    return bin_of, place, np.array(fill, np.int64)


def going_up(fill: np.ndarray, capacity: int, slack: int = SLACK) -> np.ndarray:
    """Whether each bin is packed again a level up."""
    return capacity - fill >= slack


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, packed into local bins: bin, offset, up (the fill of a bin that goes up, on one of its pieces; else -1)."""
    tail, step = struct.pack("<I", end_id), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        held: list[list] = [[], [], [], [], []]
        made = 0

        def pack() -> pa.RecordBatch:
            nonlocal held, made
            sizes = np.array(held[3], np.int64)
            b, at, fill = best_fit(sizes, capacity)
            up = going_up(fill, capacity)
            first = np.zeros(len(b), bool)
            first[np.unique(b, return_index=True)[1]] = True
            cols = [pa.array(c, pa.int64()) for c in held] + [pa.array((task << 36) + made + b), pa.array(at), pa.array(np.where(first & up[b], fill[b], -1)), pa.array(np.full(len(b), task, np.int64))]
            made += len(fill)
            held = [[], [], [], [], []]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "up", "task"])

        for batch in C.small_batches(batches, "text_value"):
            for i, ids in zip(batch.column(0).to_pylist(), encoder(vocabulary).encode([t or "" for t in batch.column(1).to_pylist()])):
                ids += tail
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    for col, v in zip(held, (i, k, at // 4, len(part) // 4, zlib.crc32(part))):
                        col.append(v)
            if len(held[0]) >= LOCAL:
                yield pack()
        if held[0]:
            yield pack()

    schema = "doc_id long, piece long, start long, length long, ids_crc32 long, bin long, offset long, up long, task long"
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text_value")), run, schema)


def merge(spark: SparkSession, bins: DataFrame, capacity: int = CAPACITY, up_to: int = UP) -> DataFrame:
    """bin, sequence_id, place: where each underfull bin (bin, fill, task) ends up after all rounds of the tree."""

    def pack(group):
        sizes = group["fill"].to_numpy(np.int64)
        group = group.iloc[np.lexsort((group["bin"].to_numpy(), -sizes))].reset_index(drop=True)
        b, at, fill = best_fit(group["fill"].to_numpy(np.int64), capacity)
        up = going_up(fill, capacity)
        heads = group["bin"].to_numpy()[np.unique(b, return_index=True)[1]]  # a merged bin goes by its first part's number
        out = group[["bin", "task"]].assign(into=heads[b], place=at, fill=np.where(up[b] & (heads[b] == group["bin"].to_numpy()), fill[b], -1))
        return out

    ship(spark)
    first = bins.agg(F.max("task").alias("task"), F.count("*").alias("n")).first()
    groups, n, turn = (first.task or 0) + 1, first.n, 0
    where = bins.select("bin", F.col("bin").alias("now"), F.lit(0).cast("long").alias("place"))
    level = bins.select("bin", "fill")
    while True:
        groups, turn = max(-(-groups // FAN_IN), -(-n // up_to)), turn + 1
        level = level.withColumn("task", F.pmod(F.xxhash64("bin", F.lit(turn)), F.lit(max(1, groups))))
        step = C.table(spark, level.groupBy("task").applyInPandas(pack, "bin long, task long, into long, place long, fill long"), "merge")
        where = where.join(step.select(F.col("bin").alias("now"), "into", F.col("place").alias("more")), "now", "left")
        where = C.table(spark, where.select("bin", F.coalesce("into", "now").alias("now"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place")), "where")
        level = step.where("fill >= 0").select("bin", "fill")
        before, n = n, level.count()
        if groups <= 1 or n > up_to and before - n <= before // STALLED:
            return where.select("bin", F.col("now").alias("sequence_id"), "place")


def pack(spark: SparkSession, docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    local = C.table(spark, pieces(docs, vocabulary, capacity, end_id, text), "pieces")
    bins = local.where("up >= 0").select("bin", F.col("up").alias("fill"), "task")
    last = merge(spark, bins, capacity)
    out = local.join(last, "bin", "left")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("sequence_id", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("place", F.lit(0))).alias("offset"))


def op9_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, C.documents(spark, sf_dir), default_path("word_bpe_49k.json"))
