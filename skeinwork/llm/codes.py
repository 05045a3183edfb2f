"""Product codes of integer vectors, the nearest codebook entry found by annular norm pruning.

A codebook's entries are sorted by norm.  As | |x| - |c| | is at most the distance of x and c, only entries whose norm lies
in the interval |x| - d to |x| + d can be as near as the best one so far at distance d.  The entries around |x| in the
order are looked at first; then a binary search gives the interval that their best distance allows, and the entries of
that annulus, its borders included, are evaluated exactly, in integers.  Ties go to the lower index.

Each round is one pass over the vectors: tasks add up their parts for each entry, and what the driver gets are the sums and
counts of all entries, whose number doesn't grow with the data.

Defined results: see ``vectors.integers`` for rows that take no part; the first codebooks are the rows with the smallest
ids, then vectors, rows without id last; with fewer rows than entries there are as many entries as rows.  Vectors are padded
by zeros to the longest one's length, and to a multiple of the number of parts.  Repeated rows stay; equal labels share
label_error, nulls together; no rows give no rows; extra columns are left alone.
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
from .vectors import dense, integers

PARTS, ENTRIES, ROUNDS = 4, 256, 4
SEEDS, PAIRS = 16, 1 << 17
BROADCAST_LABELS, SALTS = 100_000, 32


class Annuli:
    """A codebook sorted by norm."""

    def __init__(self, entries: np.ndarray) -> None:
        norms = np.sqrt((entries * entries).sum(1).astype(np.float64))
        self.order = np.argsort(norms, kind="stable")
        self.norms, self.entries = norms[self.order], entries[self.order]
        self.evaluated = 0

    def _evaluate(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray, index: np.ndarray, best: np.ndarray) -> None:
        """Better index and best of each row by the entries lo to hi, exclusive, of the order."""
        counts = np.maximum(hi - lo, 0)
        ends = np.cumsum(counts)
        self.evaluated += int(ends[-1]) if len(ends) else 0
        at = 0
        while at < len(x):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            some = np.flatnonzero(counts[at:to]) + at
            at = to
            if not len(some):
                continue
            n = counts[some]
            first = np.cumsum(n) - n
            row = np.repeat(np.arange(len(some)), n)
            entry = np.arange(len(row)) - first[row] + lo[some][row]
            gap = x[some][row] - self.entries[entry]
            d = np.einsum("ij,ij->i", gap, gap)
            least = np.minimum.reduceat(d, first)
            which = np.minimum.reduceat(np.where(d == least[row], self.order[entry], len(self.order)), first)
            better = (least < best[some]) | ((least == best[some]) & (which < index[some]))
            index[some[better]], best[some[better]] = which[better], least[better]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each row."""
        norms = np.sqrt((x * x).sum(1).astype(np.float64))
        m = len(self.order)
        index, best = np.full(len(x), m, np.int64), np.full(len(x), np.iinfo(np.int64).max)
        inner = np.clip(np.searchsorted(self.norms, norms) - SEEDS // 2, 0, max(0, m - SEEDS))
        outer = np.minimum(inner + SEEDS, m)
        self._evaluate(x, inner, outer, index, best)
        reach = np.sqrt(best.astype(np.float64))
        reach += 1e-9 * (1 + norms + reach)  # more than rounding can take away
        lo, hi = np.searchsorted(self.norms, norms - reach, "left"), np.searchsorted(self.norms, norms + reach, "right")
        self._evaluate(x, lo, np.minimum(inner, hi), index, best)
        self._evaluate(x, np.maximum(outer, lo), hi, index, best)
        return index, best


def _assigned(batch: pa.RecordBatch, books: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, vectors' parts, indexes, squared distances) of the vectors of a batch."""
    parts, _, width = books.shape
    x = dense(batch.column(1), parts * width)
    for p in range(parts):
        piece = np.ascontiguousarray(x[:, p * width : (p + 1) * width])
        yield p, piece, *Annuli(books[p]).nearest(piece)


def sums(ints: DataFrame, books: np.ndarray) -> np.ndarray:
    """For each part and entry, the sums of the components of the parts assigned to it, and at the end their count."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width + 1), np.int64)
        for b in batches:
            if b.num_rows:
                for p, piece, index, _ in _assigned(b, books):
                    order = np.argsort(index, kind="stable")
                    used, first = np.unique(index[order], return_index=True)
                    total[p, used, :width] += np.add.reduceat(piece[order], first)
                    total[p, used, width] += np.diff([*first, len(order)])
        cell = np.flatnonzero(total[:, :, width].repeat(width + 1))  # cells of the entries in use
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(total.ravel()[cell])], ["cell", "total"])

    out = np.zeros(parts * entries * (width + 1), np.int64)
    rows = map_arrow(ints.select("vec_id", "v"), run, "cell long, total long").groupBy("cell").agg(F.sum("total").alias("total")).toArrow()
    out[rows.column("cell").to_numpy()] = rows.column("total").to_numpy()
    return out.reshape(books.shape[:2] + (width + 1,))


def first_books(ints: DataFrame, parts: int, entries: int) -> np.ndarray:
    """Codebooks (part, entry, component): the parts of the vectors with the smallest ids."""
    rows = ints.select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    longest = ints.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-longest // parts)
    out = np.zeros((len(rows), parts * width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r.v)] = r.v
    return np.ascontiguousarray(out.reshape(len(rows), parts, width).transpose(1, 0, 2))


def train(ints: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks after so many rounds of assigning all vectors and replacing each entry in use by floor(sum / count)."""
    books = first_books(ints, parts, entries)
    for _ in range(rounds if books.size else 0):
        total = sums(ints, books)
        count = total[:, :, -1:]
        books = np.where(count > 0, total[:, :, :-1] // np.maximum(count, 1), books)
    return books


def encode(ints: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, code, error, label of the vectors (vec_id, v, label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            index, error = zip(*(x[2:] for x in _assigned(b, books)))
            codes = ["".join(f"{i:02x}" for i in row) for row in np.stack(index, 1).tolist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes), pa.array(np.sum(error, axis=0)), b.column(2)], ["vec_id", "code", "error", "label"])

    return map_arrow(ints.select("vec_id", "v", "label"), run, f"vec_id long, code string, error long, label {ints.schema['label'].dataType.simpleString()}")


def with_label_error(spark: SparkSession, coded: DataFrame) -> DataFrame:
    """coded with label_error: the sums of few labels are broadcast; those of many are joined, a label's rows in SALTS parts."""
    of_label = C.table(spark, coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "label-errors")
    if of_label.count() <= BROADCAST_LABELS:
        return coded.join(F.broadcast(of_label), F.col("label").eqNullSafe(F.col("of"))).drop("of")
    salted = of_label.select("of", "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    dealt = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("part"))).drop("of", "part", "salt")


def compress(spark: SparkSession, vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of the vectors (vec_id, embedding, label)."""
    ints = C.table(spark, integers(vectors, "label"), "integers")
    books = train(ints, parts, entries, rounds)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    coded = C.table(spark, encode(ints, books), "coded")
    return with_label_error(spark, coded).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_annular_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
