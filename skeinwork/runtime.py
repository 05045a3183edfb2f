"""Makes this package importable in Python workers, wherever they run."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH, UNSET = "4m", ("67108864b", "64m", "64MB")  # the session's own bound holds, but for Spark's default of 64 MB
_shipped: set[str] = set()
_caches: list[dict] = []
_running: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below spark.checkpoint.dir, which all executors share; where that is unset and all of them are in this
    process (tests), below a folder of our own, removed at the end."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if "scratch" not in _running:
            own = tempfile.TemporaryDirectory(prefix="skeinwork-", ignore_cleanup_errors=True)
            atexit.register(own.cleanup)
            _running["scratch"] = own.name
        root = f"file://{_running['scratch']}"
    return f"{root.rstrip('/')}/skeinwork-{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there, and what reads it often reads it from there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="skeinwork-src-")) / "skeinwork.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """df.mapInArrow with this package importable on the other side; a worker that waits for its next task holds no freed memory."""
    ship(df.sparkSession)
    if df.sparkSession.conf.get(BATCH_CONF) in UNSET:
        df.sparkSession.conf.set(BATCH_CONF, BATCH)

    kind = f"{fn.__module__}.{fn.__qualname__}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(kind)
        try:
            yield from fn(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def cache(of: dict) -> dict:
    """of, emptied when this worker turns to another kind of task."""
    _caches.append(of)
    return of


def begin(kind: str) -> None:
    """Empty the caches of the kind of task that this worker ran before, if it was another one."""
    if _caches and _running.get("kind") != kind:
        for c in _caches:
            c.clear()
    _running["kind"] = kind


def give_back() -> None:
    """Return this process's freed memory to the system, where its allocators can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's alone
    if trim:
        trim(0)
