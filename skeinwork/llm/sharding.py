"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Equal texts are a group, and groups are placed where the dot product of their vector (bytes, tokens, rows, as shares of
the whole) with the shards' residual capacity is highest, largest first, in three rounds:

1. groups over 1 / (shards * HEAVY) of the whole (and over 1.5 mean groups) in any measure: at most 3 * shards * HEAVY of them, placed by the driver.
   A group over a quarter of a shard is first split into pieces by a hash of doc_id;
2. the other groups, in blocks within tasks: each block fills its share of what the first round left of each shard;
3. about RESERVE groups, held back by a hash, are placed last by the driver and level the bytes.

Law: ``bytes`` (sizes near equal).  Slots are numbered by counts of (shard, hash bucket) and within buckets.

Defined results: a null text is empty (size 16, crc32 0) and of one group with empty texts; rows that repeat are rows like
others; a null doc_id is placed too; an empty table gives an empty result; extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import map_arrow
from . import common as C

SHARDS, HEAVY, PART = 40, 64, 4
RESERVE, BLOCK, BUCKET = 2_000, 50_000, 2_000
MEASURES = ["bytes", "tokens", "rows"]


def place(units: np.ndarray, residual: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The shard of each unit (a row of measures); residual (shards by measures) is used up, unit by unit, in order."""
    out = np.zeros(len(units), np.int64)
    scaled = units * weights
    for i in range(len(units)):
        s = int((residual @ scaled[i]).argmax())
        out[i] = s
        residual[s] -= units[i]
    return out


def shard(spark: SparkSession, docs: DataFrame, shards: int = SHARDS, text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col("doc_id"), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("h1"), F.xxhash64(F.lit(1), body).alias("h2"), F.regexp_count(body, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"),
    )
    rows = C.table(spark, rows, "rows")
    groups = C.table(spark, rows.groupBy("h1", "h2").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")), "groups")
    t = groups.agg(F.count("*").alias("n"), *(F.sum(m).alias(m) for m in MEASURES)).first()
    total = np.maximum(np.array([t[m] or 0 for m in MEASURES], float), 1.0)
    share = F.greatest(*(F.col(m) / float(x) for m, x in zip(MEASURES, total)))
    groups = groups.withColumn("share", share)
    heavy_from = max(1 / (shards * HEAVY), 1.5 / max(t.n or 0, 1))  # in a small table, what is above the ordinary

    heavy = groups.where(F.col("share") > heavy_from)
    split = heavy.where((F.col("share") > 1 / (shards * PART)) & (F.col("rows") > 1)).select("h1", "h2", F.least("rows", F.ceil(F.col("share") * shards * PART)).cast("int").alias("parts"))
    split = C.table(spark, split, "split")  # at most 3 * shards * PART rows
    piece = F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("doc_id", F.lit(9)), F.col("parts"))).otherwise(0).cast("int")
    rows = rows.join(F.broadcast(split), ["h1", "h2"], "left").withColumn("piece", piece).drop("parts")
    pieces = rows.join(F.broadcast(split.select("h1", "h2")), ["h1", "h2"], "left_semi").groupBy("h1", "h2", "piece").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    large = heavy.join(F.broadcast(split.select("h1", "h2")), ["h1", "h2"], "left_anti").select("h1", "h2", F.lit(0).alias("piece"), *MEASURES).union(pieces).toPandas()
    large = large.sort_values(["bytes", "rows", "h1", "h2", "piece"], ascending=False)
    residual = np.full((shards, 3), 1.0 / shards)
    large["shard"] = place(large[MEASURES].to_numpy(float) / total, residual, np.ones(3))

    light = groups.where(F.col("share") <= heavy_from).select("h1", "h2", *MEASURES)
    every = max(1, (t.n or 0) // RESERVE)
    kept_back = F.pmod(F.xxhash64("h2", F.lit(4)), F.lit(every)) == 0
    last = light.where(kept_back).toPandas().sort_values(["bytes", "rows", "h1", "h2"], ascending=False)
    shape = ", ".join(["h1 long", "h2 long", "piece int", "shard int", *(f"{m} long" for m in MEASURES)])
    left = residual.copy() - (last[MEASURES].to_numpy(float) / total).sum(0) / shards  # what round 2 has to fill
    whole = np.maximum(left.sum(0), 1e-12)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(b: pa.Table) -> pa.RecordBatch:
            units = np.stack([b.column(m).to_numpy() for m in MEASURES], axis=1).astype(float) / total
            order = np.lexsort((b.column("h2").to_numpy(), b.column("h1").to_numpy(), -units[:, 0]))
            got = np.zeros(len(units), np.int32)
            got[order] = place(units[order], left * (units.sum(0) / whole), np.ones(3))
            cols = [b.column("h1"), b.column("h2"), pa.array(np.zeros(len(got), np.int32)), pa.array(got), *(b.column(m) for m in MEASURES)]
            return pa.Table.from_arrays(cols, ["h1", "h2", "piece", "shard", *MEASURES]).combine_chunks().to_batches()[0]

        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= BLOCK:
                yield block(pa.Table.from_batches(held).combine_chunks())
                held = []
        if sum(x.num_rows for x in held):
            yield block(pa.Table.from_batches([x for x in held if x.num_rows]).combine_chunks())

    placed = C.table(spark, map_arrow(light.where(~kept_back), run, shape), "placed")
    loads = np.zeros((shards, 3))
    for r in placed.groupBy("shard").agg(*(F.sum(m).alias(m) for m in MEASURES)).collect():
        loads[r.shard] = np.array([r[m] for m in MEASURES]) / total
    last["piece"] = 0
    last["shard"] = place(last[MEASURES].to_numpy(float) / total, residual - loads, np.array([1.0, 0.0, 0.0]))
    of_driver = [tuple(int(v) for v in r) for part in (large, last) for r in part[["h1", "h2", "piece", "shard"]].itertuples(index=False)]
    where = placed.select("h1", "h2", "piece", "shard").union(spark.createDataFrame(of_driver, "h1 long, h2 long, piece int, shard int"))

    buckets = max(1, -(-int(t.rows or 0) // (shards * BUCKET)))
    dealt = rows.join(where, ["h1", "h2", "piece"]).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "h1"), F.lit(buckets)).cast("int"))
    dealt = C.table(spark, dealt.select("doc_id", "size", "text_crc32", "shard", "bucket"), "dealt")
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    counts = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("base"))
    number = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32")) - 1
    return dealt.withColumn("number", number).join(counts, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("number")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op2_vector_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark, C.documents(spark, sf_dir))
