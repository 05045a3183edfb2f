"""The corpus pipeline: quality rules, near-dedup, benchmark decontamination, secret scans, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept and returns a DataFrame; all but
the last return the columns of documents, whatever else they are called.  Stages are written as Parquet and read again
between each other.

Defined results: null and empty texts fail the quality rules; rows without doc_id go in the first stage; rows that share a
doc_id stay if one of them passes the quality rules, and go if none of them stays in near-dedup or one of them holds an
item; repeated rows stay repeated; an empty table gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.llm import common, decontaminate, minhash, packing, quality, secrets
from skeinwork.llm.tokens import default_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the isolation forest keep."""
    kept = quality.judge(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("kept").select("doc_id").distinct()
    return minhash.texts_of(docs, common.table(spark, kept, "kept")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity 0.8 or more."""
    kept = minhash.near_duplicates(spark, docs, k=5, percent=80).where("kept").select("doc_id").distinct()
    return minhash.texts_of(docs, common.table(spark, kept, "kept")).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return decontaminate.without_leaks(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets are replaced by a mark, and n_chars counts the new text."""
    clean = secrets.scan(docs, secrets.learn(spark, docs), redact=True)
    counted = F.when(F.size(secrets.span_names(docs)[1]) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return clean.withColumn("n_chars", counted).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(spark, docs, default_path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("best-fit packing", best_fit_packing),
]
ORACLE_SQL = None  # forests, hashing and tokenizers aren't SQL; tests/llm hold each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.table(spark, stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
