"""A property graph as Parquet: one table for each kind of node and one for edges, partitioned by repo_id.

A table is written whole under a new version folder and becomes current by a marker file written last.  Markers are
numbered and the last one counts, so a reader finds a whole index at any time.  Building again makes a new version; of the
old ones the last stays, for readers that have begun with it.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _markers(spark: SparkSession, root: str, repo_id: str) -> list[str]:
    """The names of a repository's markers, oldest first: a number and a version."""
    fs, p = _fs(spark, f"{root}/{repo_id}/markers")
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def save(spark: SparkSession, root: str, repo_id: str, tables: dict[str, DataFrame], more: Callable[[str], None] | None = None) -> None:
    """Write the tables of a repository, make them current and remove versions before the last.

    more: gets the version's path once its tables are there, and may write others beside them."""
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{root}/{repo_id}/{version}/{name}")
    if more is not None:
        more(f"{root}/{repo_id}/{version}")
    old = _markers(spark, root, repo_id)
    number = int(old[-1].partition("-")[0]) + 1 if old else 0
    fs, p = _fs(spark, f"{root}/{repo_id}/markers/{number:012d}-{version}")
    fs.create(p, False).close()
    for marker in old[:-1]:
        for gone in (f"markers/{marker}", marker.partition("-")[2]):
            fs.delete(_fs(spark, f"{root}/{repo_id}/{gone}")[1], True)


def exists(spark: SparkSession, root: str, repo_id: str) -> bool:
    return bool(_markers(spark, root, repo_id))


def current(spark: SparkSession, root: str, repo_id: str) -> str:
    """The path of a repository's current version."""
    return f"{root}/{repo_id}/{_markers(spark, root, repo_id)[-1].partition('-')[2]}"


def load(spark: SparkSession, root: str, repo_id: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{current(spark, root, repo_id)}/{name}")


def reset(spark: SparkSession, root: str, repo_id: str, tables: dict[str, DataFrame]) -> int:
    """Remove what is there and save the tables anew; the number of nodes that were there."""
    n = delete(spark, root, repo_id)
    save(spark, root, repo_id, tables)
    return n


def delete(spark: SparkSession, root: str, repo_id: str, counted: str = "nodes") -> int:
    """Remove a repository; the number of its nodes.  A repository that isn't there counts as removed."""
    n = load(spark, root, repo_id, counted).count() if exists(spark, root, repo_id) else 0
    fs, p = _fs(spark, f"{root}/{repo_id}")
    fs.delete(p, True)
    return n


class Results:
    """Materialised results of a stored repository's current version, by name and parameters.  They lie in the version's
    folder, so a new version begins without any and they go with theirs."""

    def __init__(self, spark: SparkSession, root: str, repo_id: str) -> None:
        self.spark, self.path = spark, f"{current(spark, root, repo_id)}/results"

    def get(self, name: str, params: dict, make: Callable[[], DataFrame]) -> DataFrame:
        """The result that is kept for a name and parameters; where there is none, make's, which is then kept."""
        key = hashlib.sha256(json.dumps([name, params], sort_keys=True).encode()).hexdigest()[:32]
        fs, whole = _fs(self.spark, f"{self.path}/{key}/_SUCCESS")
        if not fs.exists(whole):
            make().write.mode("overwrite").parquet(f"{self.path}/{key}")
        return self.spark.read.parquet(f"{self.path}/{key}")
