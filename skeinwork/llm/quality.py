"""Quality rules with an isolation forest over rule statistics.

Every whole text gets rule statistics (one pass, vectorised).  Texts under ``MIN_WORDS`` words or mostly made of
repeated 3-word windows fail the base rules.  For the others an isolation forest is grown over ratios of those
statistics: each tree splits a subsample at random, and a row that is alone after few splits (a short mean path) is an
anomaly.  The forest is fitted on a bounded sample of rows; the threshold on its score comes from the score histogram
of *all* labelled rows.

Defined results: a null or empty text has zero counts and fails the base rules; rows with the same doc_id are judged
row by row; an empty table gives an empty result; without labels the threshold is ``DEFAULT_THRESHOLD``; extra columns
of the input are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import map_arrow
from . import common as C

MIN_WORDS = 50
TREES, SUBSAMPLE = 200, 128
SAMPLE_ROWS = 20_000  # bound on the rows that the forest is grown from
KEEP_GOOD = 0.999  # share of the labelled good rows, at least, that the threshold keeps
DEFAULT_THRESHOLD = 0.7
BINS = 2000
SYMBOLS = b"[#*$%&|<>]"[1:-1]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_punct"]
STATS = pa.schema([(c, pa.int64()) for c in COUNTS])

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[list(b"!?.,;:\"'()-")] = True


def _repeats(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item: whether its hash occurs twice in its text, and whether it isn't the first of those."""
    key = C.mix(h ^ C.mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice, later = np.zeros(len(h), bool), np.zeros(len(h), bool)
    later[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, later


def statistics(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """The counts of COUNTS for each text."""
    start, _, wh, first = C.words(data, offs)
    white = C.WHITE[data]
    chars = (~white) & ((data & 0xC0) != 0x80)
    doc3, at = C.window_starts(first, 3)
    covered = np.zeros(len(wh) + 2, bool)
    if len(at):
        twice, _ = _repeats(C.windows(wh, 3)[at], doc3)
        for k in range(3):
            covered[at[twice] + k] = True
    breaks = np.flatnonzero(data == 10)
    filled = np.flatnonzero(np.diff(offs) > 0)
    ls = np.sort(np.concatenate([offs[:-1][filled], breaks + 1]))
    le = np.sort(np.concatenate([offs[1:][filled], breaks]))
    keep = np.searchsorted(start, le) > np.searchsorted(start, ls)  # lines with a word
    ls, le = ls[keep], le[keep]
    line_doc = np.searchsorted(offs, ls, "right") - 1
    hashed = np.zeros(len(ls), np.uint64)
    for lo, hi in _line_blocks(ls, le):
        base = ls[lo]
        if hi - lo == 1 and le[lo] - base > 8 * C.BLOCK:  # one very long line: fold it block by block
            h = np.zeros(1, np.uint64)
            for a in range(int(base), int(le[lo]), C.BLOCK):
                b = min(int(le[lo]), a + C.BLOCK)
                h = C.mix(h ^ C.span_hash(C.prefix_hash(data[a:b]), np.array([0]), np.array([b - a])))
            hashed[lo] = h[0]
        else:
            p = C.prefix_hash(data[base : le[hi - 1]])
            hashed[lo:hi] = C.span_hash(p, ls[lo:hi] - base, le[lo:hi] - base)
    _, later = _repeats(hashed, line_doc)
    n = len(offs) - 1
    return [
        np.diff(first), C.sums(chars, offs), C.sums(_SYMBOL[data], offs), np.bincount(line_doc[later], minlength=n), C.sums(covered[: len(wh)], first),
        np.bincount(line_doc, minlength=n), C.sums((data >= 65) & (data <= 90), offs), C.sums(_PUNCT[data], offs),
    ]


def _line_blocks(ls: np.ndarray, le: np.ndarray) -> Iterator[tuple[int, int]]:
    lo = 0
    while lo < len(ls):
        hi = max(lo + 1, int(np.searchsorted(le, ls[lo] + C.BLOCK, "right")))
        yield lo, hi
        lo = hi


def rule_statistics(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id_col and the counts of each whole text."""
    out_schema = "id_value long, " + ", ".join(f"{c} long" for c in COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.small_batches(batches, "text_value"):
            data, offs = C.utf8(b.column(1))
            cols = [pa.array(c.astype(np.int64)) for c in statistics(data, offs)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *cols], ["id_value", *COUNTS])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("id_value"), F.col(text).alias("text_value")), run, out_schema).withColumnRenamed("id_value", id_col)


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    """Ratios in which neither the length of a text nor, much, its language shows.  Repeats count from 0.4 on only: below
    that, shared lines are ordinary."""
    c = {k: np.asarray(v, float) for k, v in counts.items()}
    chars, n = np.maximum(c["word_chars"], 1), np.maximum(c["n_words"], 1)
    return np.stack([
        np.minimum(c["n_symbols"] / chars, 0.05), np.minimum(c["n_upper"] / chars, 0.3), np.maximum(c["n_repeat_words"] / n, 0.4),
        np.maximum(c["n_dup_lines"] / np.maximum(c["n_lines"], 1), 0.4), np.minimum(c["n_punct"] / n, 1.5), np.clip(chars / n, 3, 9),
    ], axis=1)


@dataclass
class Forest:
    """Trees as flat arrays: feature (-1: leaf), cut, left child (right is the next one), path length at a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    path: np.ndarray
    norm: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path); near 1 for anomalies."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            f, cut, left = self.feature[t], self.cut[t], self.left[t]
            while True:
                go = f[node]
                inner = go >= 0
                if not inner.any():
                    break
                node = np.where(inner, left[node] + (x[rows, np.maximum(go, 0)] >= cut[node]), node)
            total += self.path[t][node]
        return 2.0 ** (-total / max(len(self.feature), 1) / self.norm)


def _expected(n: int) -> float:
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow(x: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = 11) -> Forest:
    """An isolation forest over x."""
    rng = np.random.default_rng(seed)
    size = min(subsample, len(x))
    depth = int(np.ceil(np.log2(max(size, 2))))
    width = 2 ** (depth + 1)
    f, cut = np.full((trees, width), -1), np.zeros((trees, width))
    left, path = np.zeros((trees, width), np.int64), np.zeros((trees, width))
    for t in range(trees):
        todo, used = [(0, x[rng.choice(len(x), size, replace=False)], 0)], 1
        while todo:
            node, rows, d = todo.pop()
            lo, hi = rows.min(0), rows.max(0)
            can = np.flatnonzero(hi > lo)
            if d >= depth or len(rows) <= 1 or not len(can):
                path[t, node] = d + _expected(len(rows))
                continue
            k = rng.choice(can)
            f[t, node], cut[t, node], left[t, node] = k, rng.uniform(lo[k], hi[k]), used
            side = rows[:, k] >= cut[t, node]
            if side.all() or not side.any():  # the cut fell on the border
                cut[t, node] = hi[k]
                side = rows[:, k] >= hi[k]
            todo += [(used, rows[~side], d + 1), (used + 1, rows[side], d + 1)]
            used += 2
    return Forest(f, cut, left, path, max(_expected(size), 1e-9))


def threshold_from(hist: list[tuple[int, int, int]], keep_good: float = KEEP_GOOD) -> float:
    """The lowest score above which at most 1 - keep_good of the good rows lie.  hist: (bin, good, bad)."""
    total = sum(g for _, g, _ in hist)
    if not total:
        return DEFAULT_THRESHOLD
    above, best = 0, BINS
    for b, g, _ in sorted(hist, reverse=True):
        above += g
        if above > (1 - keep_good) * total:
            break
        best = b
    return best / BINS


def judge(spark: SparkSession, docs: DataFrame, labels: DataFrame | None, keep_good: float = KEEP_GOOD, text: str = "text") -> DataFrame:
    """doc_id, the counts, base_failed, anomaly (the forest's score), threshold and kept for each row of docs."""
    stats = C.table(spark, rule_statistics(docs, text), "quality")
    whole = stats.where(f"n_words >= {MIN_WORDS}")
    share = max(1, -(-whole.count() // SAMPLE_ROWS))  # about one row of so many, by a hash of its doc_id
    sample = whole.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(share)) == 0).limit(2 * SAMPLE_ROWS).toPandas()
    if len(sample) < 2:
        scored = stats.withColumn("anomaly", F.lit(0.0))
    else:
        forest = grow(features({c: sample[c].to_numpy() for c in COUNTS}))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = features({c: b.column(c).to_numpy() for c in COUNTS})
                yield b.append_column("anomaly", pa.array(forest.score(x) if len(x) else np.zeros(0)))

        scored = C.table(spark, map_arrow(stats, run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema) + ", anomaly double"), "anomaly")
    threshold = DEFAULT_THRESHOLD
    if labels is not None:
        known = labels.where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
        hist = (
            scored.where(f"n_words >= {MIN_WORDS} and 100 * n_repeat_words <= 50 * n_words").join(known, "doc_id")
            .groupBy(F.floor(F.col("anomaly") * BINS).alias("bin")).agg(F.sum(F.expr("int(quality = 1)")).alias("good"), F.sum(F.expr("int(quality = 0)")).alias("bad"))
        ).collect()
        threshold = threshold_from([(r.bin, r.good, r.bad) for r in hist], keep_good)
    failed = F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words")
    return scored.withColumns({"threshold": F.lit(float(threshold)), "base_failed": failed, "kept": ~failed & (F.col("anomaly") < F.lit(float(threshold)))})


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark, C.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
