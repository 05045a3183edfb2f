"""A log that arrives out of order and in part twice, put in order; rows that come too late go to a table of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import written
from .activity import marks


class Ordered:
    """A foreachBatch sink for rows with an identifier ``key`` and a time ``ts``, with tables below ``root``.

    Its watermark is the newest time of the batches before, less ``late``.  A row before it, or without time or key, goes to
    the late rows.  Of the others with one key the least row (by time, then all columns as they stand) stays until the
    watermark has passed it; so copies are dropped if they come before that, and are late rows after it.  What the watermark
    has passed is released: a batch's released rows all lie after those of the batches before, and its files are sorted.

    Columns have types with an order.  A batch's tables are written under its number, with a mark at the end; a batch that
    has its mark does nothing, and one without is written anew.  What is kept is as much as arrives within ``late``."""

    def __init__(self, root: str, key: str, ts: str = "ts", late: str = "2 hours") -> None:
        self.root, self.key, self.ts, self.late = root.rstrip("/"), key, ts, late

    def _read(self, spark: SparkSession, name: str, numbers: list[int], schema) -> DataFrame:
        paths = [f"{self.root}/{name}/{n}" for n in numbers]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark, key, ts = batch.sparkSession, self.key, self.ts
        done = marks(spark, self.root)
        if number in done:
            return
        kind = batch.schema[ts].dataType
        batch = written(batch, "arrived")
        old = self._read(spark, "done", done[-1:], "mark string").first()
        mark = F.lit(old.mark if old else None).cast(kind)
        late = F.col(ts).isNull() | F.col(key).isNull() | F.coalesce(F.col(ts) < mark, F.lit(False))
        row = F.struct(ts, *[c for c in batch.columns if c != ts])
        every = self._read(spark, "pending", done[-1:], batch.schema).unionByName(batch.where(~late))
        kept = written(every.groupBy(key).agg(F.min(row).alias("row")).select("row.*").select(*batch.columns), "kept")
        newest = batch.where(~late).agg(F.max(ts).alias("t")).select(F.greatest(F.col("t") - F.expr(f"interval {self.late}"), mark).cast("string").alias("mark")).first().mark
        passed = F.coalesce(F.col(ts) < F.lit(newest).cast(kind), F.lit(False))
        kept.where(passed).repartitionByRange(ts, key).sortWithinPartitions(ts, key).write.mode("overwrite").parquet(f"{self.root}/ordered/{number}")
        kept.where(~passed).write.mode("overwrite").parquet(f"{self.root}/pending/{number}")
        batch.where(late).write.mode("overwrite").parquet(f"{self.root}/late/{number}")
        spark.range(1).select(F.lit(newest).cast("string").alias("mark")).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/done/{number}")

    def released(self, spark: SparkSession, schema, ended: bool = False) -> DataFrame:
        """The rows released so far; those that still wait too if the log has ended."""
        done = marks(spark, self.root)
        out = self._read(spark, "ordered", done, schema)
        return out.unionByName(self._read(spark, "pending", done[-1:], schema)) if ended else out

    def late_rows(self, spark: SparkSession, schema) -> DataFrame:
        return self._read(spark, "late", marks(spark, self.root), schema)


def arrive(spark: SparkSession, folder: str, schema, sink: Ordered, states: str) -> None:
    """Give what has come into a folder of Parquet files since the last call to the sink, as a stream that ends then."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(folder)
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", states).trigger(availableNow=True).start().awaitTermination()
