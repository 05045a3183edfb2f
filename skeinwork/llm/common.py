"""Shared plumbing: the shared work folder, intermediate tables, Arrow text batches and vectorised word hashing.

Words everywhere are maximal runs of bytes other than 0x20 and 0x09-0x0D, which for UTF-8 is the same as
``[^\\x20\\x09-\\x0D]+`` over code points.  All hashing is seeded by constants, so a task that is run again
after an executor was lost gives the same rows.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..runtime import cache

BLOCK = 1 << 20
TARGET_BYTES, ROWS_AT_ONCE = 1 << 19, 20_000
U64 = np.uint64
_folders: dict[str, object] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or, with all executors in this process, one of our own
    where that is unset (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _own_folder()
    return root.rstrip("/")


def _own_folder() -> str:
    if "own" not in _folders:
        _folders["own"] = tempfile.mkdtemp(prefix="skeinwork-")
    return f"file://{_folders['own']}"


def new_table_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is removed when the driver's Python ends."""
    path = f"{shared_folder(spark)}/skeinwork-{name}-{uuid.uuid4().hex[:12]}"
    if not _folders.get("hook"):
        _folders["hook"] = True
        atexit.register(_clean)
    _folders.setdefault("paths", []).append((spark, path))
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for spark, path in _folders.get("paths", []):
        try:
            delete_path(spark, path)
        except Exception:  # the JVM may be gone already; the folder is scratch space
            return


def table(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: this cuts lineage and survives lost executors."""
    path = new_table_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# ---------------------------------------------------------------------------------------------- Arrow batches
def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offs = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def small_batches(batches: Iterator[pa.RecordBatch], text: str, target: int = TARGET_BYTES, rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows and about ``target`` bytes of text; a longer text comes alone."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offs = utf8(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offs, offs[at] + target, "right")) - 1
            to = min(batch.num_rows, at + rows, max(at + 1, to))
            yield batch.slice(at, to - at)
            at = to


# ---------------------------------------------------------------------------------------------- hashing
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = cache({})


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 16, 0 if have is None else 2 * len(have[0]))
        inv = pow(base, -1, 1 << 64)
        both = []
        for b in (base, inv):
            out = np.full(size, b, U64)
            out[0] = 1
            np.multiply.accumulate(out, out=out)
            both.append(out)
        have = _powers[base] = (both[0], both[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """out[i]: polynomial sum of data[:i]."""
    pw, _ = powers(_BASE, len(data))
    out = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * pw[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end] for each span, equal for equal bytes."""
    _, inv = powers(_BASE, len(prefix))
    return mix((prefix[end] - prefix[start]) * inv[start] + (end - start).astype(U64) * U64(0xA0761D6478BD642F))


def blocks(data: np.ndarray, offs: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of about ``limit`` bytes, cut at the ends of texts or, in long texts, at white space."""
    lo, n = 0, len(data)
    while lo < n:
        hi = min(n, lo + limit)
        if hi < n:
            k = int(offs[np.searchsorted(offs, hi, "right") - 1])
            if k > lo:
                hi = k
            else:
                step, at = limit, hi
                end = int(offs[np.searchsorted(offs, lo, "right")])
                while at < end:
                    white = np.flatnonzero(WHITE[data[at : min(end, at + step)]])
                    if len(white):
                        at += int(white[0])
                        break
                    at = min(end, at + step)
                hi = at
        yield lo, hi
        lo = hi


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of each word and, for each text, the index of its first word (with one more at the end)."""
    ss, es, hs = [], [], []
    for lo, hi in blocks(data, offs):
        part = data[lo:hi]
        inside = ~WHITE[part]
        cut = offs[np.searchsorted(offs, lo, "left") : np.searchsorted(offs, hi, "left")] - lo
        before = np.ones(len(part), bool)
        before[1:] = ~inside[:-1]
        before[cut] = True
        after = np.ones(len(part), bool)
        after[:-1] = ~inside[1:]
        after[cut[cut > 0] - 1] = True
        s, e = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
        hs.append(span_hash(prefix_hash(part), s, e))
        ss.append(s + lo)
        es.append(e + lo)
    join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    s, e, h = join(ss, np.int64), join(es, np.int64), join(hs, U64)
    return s, e, h, np.searchsorted(s, offs, "left")


def windows(wh: np.ndarray, k: int) -> np.ndarray:
    """Hash of words i to i+k-1 for each i up to len - k, across text borders too: the caller masks those."""
    n = len(wh) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    pw, inv = powers(_WORD_BASE, len(wh))
    g = np.zeros(len(wh) + 1, U64)
    np.cumsum(wh * pw[: len(wh)], out=g[1:])
    return mix((g[k:] - g[:n]) * inv[:n] + U64(k))


def window_starts(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, word index) of each window of k words that lies in one text."""
    counts = np.maximum(np.diff(first) - k + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    begin = np.cumsum(counts) - counts
    return doc, np.arange(len(doc)) - begin[doc] + first[:-1][doc]


def sums(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For each text the sum of flags over its range."""
    c = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=c[1:])
    return c[offs[1:]] - c[offs[:-1]]
