"""Question sets: read, asked in batches, and laid out as samples for scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import batches
from .ask import Provider, ask

SAMPLE = "question string, answer string, sources string, contexts array<string>, ground_truth string"


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(question, ground_truth, pos, batch) of a JSON list, in batches of three."""
    rows = spark.read.json(path, schema="question string, ground_truth string", multiLine=True)
    numbered = rows.withColumn("pos", F.monotonically_increasing_id()).withColumn("all", F.lit(0))
    return batches(numbered, "all", ["pos"], 3).drop("all")


def samples(spark: SparkSession, questions: DataFrame, tables: dict[str, DataFrame], provider: Provider | None = None, attempts: int = 3) -> DataFrame:
    """One row a question (a bounded set, asked from the driver); a question that keeps failing has an empty answer."""
    out = []
    for q in questions.orderBy("pos").collect():
        got = None
        for _ in range(attempts):
            try:
                got = ask(spark, q.question, tables, provider)
                break
            except RuntimeError:
                continue
        contexts = [str(r) for r in got["rows"]] if got else []
        named = sorted({str(v) for r in (got["rows"] if got else []) for v in r.values() if isinstance(v, str) and v.endswith(".py")})
        out.append((q.question, got["answer"] if got else "", ",".join(named), contexts, q.ground_truth))
    return spark.createDataFrame(out, SAMPLE)


def recall(sampled: DataFrame) -> DataFrame:
    """(question, hit): the share of the ground truth's file names that the sources name; null where it names none."""
    wanted = F.array_distinct(F.regexp_extract_all("ground_truth", F.lit(r"(\w+\.py)"), F.lit(1)))
    found = F.size(F.filter(wanted, lambda w: F.col("sources").contains(w)))
    return sampled.select("question", F.when(F.size(wanted) > 0, found / F.size(wanted)).alias("hit"))
