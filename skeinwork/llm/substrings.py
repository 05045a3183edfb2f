"""Substring dedup by level-wise doubling over word windows.

Level 1 looks at windows of half the length (25 words).  Of the 26 half windows of each whole window the one with the
smallest hash is its anchor; consecutive windows with one anchor form a run.  Equal windows have equal anchors, so a
window can only repeat in another text if its anchor does.  Anchors that occur in one text alone end here.

Level 2 doubles the survivors to the whole length (50 words).  A run whose whole context occurs in an earlier text is
settled as it stands.  Where an anchor has several contexts, each distinct context is cut into its whole windows once
(by the smallest doc_id that has it), and the windows are matched.  ``repeated_lengths`` goes on doubling, 100 words and
up, until no window survives.

A window of a text is removed if its words also start in a text with a smaller doc_id; windows are judged on the input.
Texts with equal word sequences are settled first: all but the smallest doc_id lose every word (if they have a window).

Defined results: a null or empty text has no words and the hash of the empty string; texts under the window length lose
nothing; rows that share a doc_id don't remove words of each other; an empty table gives an empty result; a null doc_id
neither removes nor loses words; extra columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import map_arrow
from . import common as C
from .minhash import texts_of

WINDOW = 50
RUN = "array<struct<fp:bigint,rh:bigint,pos:int,n:int>>"


def _anchors(wh: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: (text, anchor hash, context hash, first window, number of windows)."""
    half = window // 2
    doc, at = C.window_starts(first, window)
    empty = np.zeros(0, np.int64)
    if not len(at):
        return empty, empty.astype(np.uint64), empty.astype(np.uint64), empty, empty
    h = C.windows(wh, half)
    span = window - half + 1
    best, where = h[at], np.zeros(len(at), np.int64)
    for k in range(1, span):
        x = h[at + k]
        less = x < best
        best = np.where(less, x, best)
        where[less] = k
    pos = at + where
    new = np.ones(len(at), bool)
    new[1:] = (pos[1:] != pos[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(at)))
    start, stop = at[begin], at[begin] + count - 1 + window
    pw, inv = C.powers(C._WORD_BASE, len(wh))
    g = np.zeros(len(wh) + 1, np.uint64)
    np.cumsum(wh * pw[: len(wh)], out=g[1:])
    context = C.mix((g[stop] - g[start]) * inv[start] + (count * 64 + where[begin]).astype(np.uint64))
    return doc[begin], best[begin], context, start, count


def survey(docs: DataFrame, window: int, text: str = "text") -> DataFrame:
    """doc_id, n_words, digest of the word sequence (q1, q2), SHA-256 of the words and the text's runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.small_batches(batches, "text_value"):
            data, offs = C.utf8(b.column(1))
            _, _, wh, first = C.words(data, offs)
            n = np.diff(first)
            raw = data.tobytes()
            sha = [hashlib.sha256(b" ".join(raw[s:e].split())).hexdigest() for s, e in zip(offs[:-1], offs[1:])]
            digests = []
            for seed in (0x1F, 0x2F):
                c = np.zeros(len(wh) + 1, np.uint64)
                np.cumsum(C.mix(wh + np.uint64(seed) + C.mix(np.arange(len(wh), dtype=np.uint64) - np.repeat(first[:-1], n).astype(np.uint64) + np.uint64(seed))), out=c[1:])
                digests.append(pa.array((c[first[1:]] - c[first[:-1]]).view(np.int64)))
            doc, fp, rh, start, count = _anchors(wh, first, window)
            rows = pa.StructArray.from_arrays(
                [pa.array(fp.view(np.int64)), pa.array(rh.view(np.int64)), pa.array((start - first[:-1][doc]).astype(np.int32)), pa.array(count.astype(np.int32))], ["fp", "rh", "pos", "n"]
            )
            runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(n) + 1)).astype(np.int32)), rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n.astype(np.int64)), *digests, pa.array(sha), runs], ["doc_id", "n_words", "q1", "q2", "sha", "runs"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text_value")), run, f"doc_id long, n_words long, q1 long, q2 long, sha string, runs {RUN}")


def _cut(docs: DataFrame, window: int, text: str) -> DataFrame:
    """w, doc_id, pos: the windows of the runs that are listed beside each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.small_batches(batches, "text_value"):
            data, offs = C.utf8(b.column(1))
            _, _, wh, first = C.words(data, offs)
            h = C.windows(wh, window)
            runs = b.column(2)
            doc = np.repeat(np.arange(b.num_rows), np.diff(runs.offsets.to_numpy()))
            flat = runs.flatten()
            pos, n = flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy().astype(np.int64)
            which = np.repeat(np.arange(len(n)), n)
            at = pos[which] + np.arange(len(which)) - (np.cumsum(n) - n)[which]
            text_of = doc[which]
            ids = b.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(h[first[:-1][text_of] + at].view(np.int64)), pa.array(ids[text_of]), pa.array(at.astype(np.int32))], ["w", "doc_id", "pos"])

    return map_arrow(docs.select("doc_id", F.col(text).alias("text_value"), "runs"), run, "w long, doc_id long, pos int")


def _removed(docs: DataFrame, text: str, window: int) -> DataFrame:
    """doc_id, kept words' SHA-256, n_removed for texts with a list ``cover`` of (first window, number of windows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.small_batches(batches, "text_value"):
            data, offs = C.utf8(b.column(1))
            raw, sha, gone = data.tobytes(), [], []
            cover = b.column(2)
            lo = cover.offsets.to_numpy() - cover.offsets[0].as_py()  # a slice has its first text at any place
            flat = cover.flatten()
            pos, n = flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy().astype(np.int64)
            for i in range(b.num_rows):
                ws = raw[offs[i] : offs[i + 1]].split()
                mark = np.zeros(len(ws) + 1, np.int64)
                s, e = pos[lo[i] : lo[i + 1]], pos[lo[i] : lo[i + 1]] + n[lo[i] : lo[i + 1]] - 1 + window
                np.add.at(mark, s, 1)
                np.add.at(mark, e, -1)
                keep = np.cumsum(mark)[:-1] == 0
                gone.append(len(ws) - int(keep.sum()))
                sha.append(hashlib.sha256(b" ".join(w for w, k in zip(ws, keep.tolist()) if k)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_removed", "kept"])

    return map_arrow(docs.select("doc_id", F.col(text).alias("text_value"), "cover"), run, "doc_id long, n_removed long, kept string")


class Repeats:
    """The windows of each text that a text with a smaller doc_id has too."""

    def __init__(self, spark: SparkSession, docs: DataFrame, window: int = WINDOW, text: str = "text") -> None:
        self.spark, self.window, self.text = spark, window, text
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias(text))
        self.all = C.table(spark, survey(docs, window, text), "survey")
        same = self.all.where("n_words > 0 and doc_id is not null").groupBy("n_words", "q1", "q2").agg(F.min("doc_id").alias("rep"))
        self.classes = C.table(spark, self.all.select("doc_id", "n_words", "q1", "q2", "sha").join(same, ["n_words", "q1", "q2"], "left"), "classes")
        copies = self.classes.where(f"doc_id > rep and n_words >= {window}").select("doc_id", "sha")
        runs = self.all.where("doc_id is not null").join(copies.select("doc_id"), "doc_id", "left_anti").select("doc_id", F.inline("runs"))
        anchors = runs.groupBy("fp").agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1"), (F.min("rh") < F.max("rh")).alias("many")).where("d0 < d1").select("fp", "d0", "many")
        anchors = C.table(spark, anchors, "anchors")  # read again, so that a join can split a hot anchor's rows
        self.runs = C.table(spark, runs.join(anchors, "fp"), "runs")
        self.copies = copies

    def covered(self) -> DataFrame:
        """doc_id, pos, n: n windows from word pos on that are repeated."""
        simple = self.runs.where("not many and doc_id > d0").select("doc_id", "pos", "n")
        many = self.runs.where("many")
        first = C.table(self.spark, many.groupBy("fp", "rh").agg(F.min("doc_id").alias("c0")), "first")
        contexts = C.table(self.spark, many.join(first, ["fp", "rh"]).select("doc_id", "pos", "n", (F.col("doc_id") > F.col("c0")).alias("later")), "contexts")
        later = contexts.where("later").select("doc_id", "pos", "n")
        lists = contexts.where("not later").groupBy("doc_id").agg(F.collect_set(F.struct("pos", "n")).alias("runs"))
        ids = C.table(self.spark, lists.select("doc_id"), "ids")
        windows = C.table(self.spark, _cut(texts_of(self.docs, ids).join(lists, "doc_id"), self.window, self.text), "windows")
        found = windows.groupBy("w").agg(F.min("doc_id").alias("w0"), F.max("doc_id").alias("w1")).where("w0 < w1").select("w", "w0")
        found = C.table(self.spark, found, "found")
        hit = windows.join(found, "w").where("doc_id > w0").select("doc_id", "pos", F.lit(1).alias("n"))
        # a context's windows hold for every run with it: the others are in ``later``; its first text has the row in ``hit``
        return simple.union(later).union(hit)

    def result(self) -> DataFrame:
        """doc_id, n_words, n_removed, kept_sha256 for each row."""
        cover = C.table(self.spark, self.covered().groupBy("doc_id").agg(F.collect_set(F.struct("pos", "n")).alias("cover")), "cover")
        ids = C.table(self.spark, cover.select("doc_id").distinct(), "ids")
        partly = C.table(self.spark, _removed(texts_of(self.docs, ids).join(cover, "doc_id"), self.text, self.window), "partly")
        whole = (F.col("doc_id") > F.col("rep")) & (F.col("n_words") >= self.window)
        out = self.classes.join(partly.dropDuplicates(["doc_id"]), "doc_id", "left")
        removed = F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
        return out.select("doc_id", "n_words", removed.cast("long").alias("n_removed"), F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"))


def repeated_lengths(spark: SparkSession, docs: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """length, n_windows, n_docs: how many windows survive at each doubling of the length, until none does."""
    r = Repeats(spark, docs, window, text)
    starts = r.runs.select("doc_id", F.explode(F.sequence("pos", F.expr("pos + n - 1"))).alias("pos"))
    lists = starts.groupBy("doc_id").agg(F.collect_list(F.struct("pos", F.lit(1).alias("n"))).alias("runs"))
    level = _cut(r.docs.join(lists, "doc_id"), window, text)
    out, length = [], window
    while True:
        alive = level.groupBy("w").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a < z").select("w")
        level = C.table(spark, level.join(alive, "w", "left_semi"), "level")
        n = level.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("d")).first()
        if not n.n:
            return spark.createDataFrame(out, "length long, n_windows long, n_docs long")
        out.append((length, n.n, n.d))
        after = level.select("doc_id", (F.col("pos") - length).alias("pos"), F.col("w").alias("w2"))
        level = level.join(after, ["doc_id", "pos"]).select(F.xxhash64("w", "w2").alias("w"), "doc_id", "pos")
        length *= 2


def op8_level_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Repeats(spark, C.documents(spark, sf_dir)).result()
