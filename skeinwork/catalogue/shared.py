"""Tables, inline rows and the graph projections of the driver's tables, each with its SQL."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import runtime
from ..sources import retrieval

_stored: dict[tuple[str, str, str], retrieval.Stored] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def sql_values(rows: list[tuple], columns: str) -> str:
    """A DuckDB relation of inline rows."""
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v).upper() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows) + f") AS t({columns})"


# ------------------------------------------------------------------------- rows for each supplier
MARK = "~"


def marked(value, names: str):
    """value (text, or tuples and lists of such) with MARK after each of the names, alternatives of a pattern."""
    if isinstance(value, (list, tuple)):
        return type(value)(marked(v, names) for v in value)
    return re.sub(rf"\b({names})\b", rf"\1{MARK}", value) if isinstance(value, str) else value


def each_supplier(spark: SparkSession, sf: str, rows: list[tuple], schema: str) -> DataFrame:
    """The rows for each supplier, with MARK in their texts replaced by its key, which is the column ``of``."""
    kind = T.DataType.fromDDL(schema)
    text = json.dumps([dict(zip(kind.names, r)) for r in rows])
    every = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("of"), F.inline(F.from_json(F.lit(text), T.ArrayType(kind))))
    key = F.col("of").cast("string")
    return every.select("of", *(F.replace(F.col(f.name), F.lit(MARK), key).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in kind.fields))


def each_supplier_sql(rows: list[tuple], columns: str) -> str:
    """each_supplier's relation in DuckDB."""
    names = [c.strip() for c in columns.split(",")]
    texts = {c for i, c in enumerate(names) if any(isinstance(r[i], str) for r in rows)}
    shown = ", ".join(f"replace({c}, '{MARK}', CAST(s_suppkey AS VARCHAR)) AS {c}" if c in texts else c for c in names)
    return f"(SELECT s_suppkey AS \"of\", {shown} FROM {sql_values(rows, columns)}, supplier)"


# ------------------------------------------------------------------------- stored postings and vectors
def _written(spark: SparkSession, sf: str, name: str, *parts: str) -> retrieval.Stored:
    """Stored retrieval tables of a folder, each part written once in an application."""
    key = (spark.sparkContext.applicationId, sf, name)
    stored = _stored.setdefault(key, retrieval.Stored(spark, runtime.scratch(spark, name)))
    for part in parts:
        if (*key, part) not in _stored:
            _WRITERS[name, part](spark, sf, stored.path)
            _stored[*key, part] = stored
    return stored


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


_WRITERS = {
    ("texts", "postings"): lambda spark, sf, path: retrieval.write_postings(_texts(spark, sf), path),
    ("texts", "vectors"): lambda spark, sf, path: retrieval.write_vectors(retrieval.embedded(spark, path), path),
    ("vectors", "vectors"): lambda spark, sf, path: retrieval.write_vectors(_vectors(spark, sf), path),
}


def stored_texts(spark: SparkSession, sf: str, *parts: str) -> retrieval.Stored:
    """documents' postings and hashed vectors."""
    return _written(spark, sf, "texts", *(parts or ("postings", "vectors")))


def stored_vectors(spark: SparkSession, sf: str) -> retrieval.Stored:
    """embeddings in the cells of a quantiser."""
    return _written(spark, sf, "vectors", "vectors")


# ------------------------------------------------------------------------- files that import files: suppliers
ALL_IMPORTS_SQL = """
suppliers AS (SELECT count(*) AS n FROM supplier),
imports AS (SELECT DISTINCT l_suppkey AS src, p_partkey % n AS dst FROM lineitem JOIN part ON l_partkey = p_partkey, suppliers),
files AS (SELECT s_suppkey AS node FROM supplier)"""
IMPORTS_SQL = """
suppliers AS (SELECT count(*) AS n FROM supplier),
imports AS (SELECT DISTINCT l_suppkey AS src, p_partkey % n AS dst FROM lineitem JOIN part ON l_partkey = p_partkey, suppliers
  WHERE l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '1997-03-01' AND l_shipdate < TIMESTAMP '1997-04-01'),
files AS (SELECT s_suppkey AS node FROM supplier)"""


def all_imports(spark: SparkSession, sf: str) -> DataFrame:
    """(src, dst): suppliers of all lines, and a supplier number made of the part's."""
    return _pairs(spark, sf, table(spark, sf, "lineitem"))


def imports(spark: SparkSession, sf: str) -> DataFrame:
    """all_imports of the returned lines of a month: the import graph whose paths are few enough to list."""
    return _pairs(spark, sf, table(spark, sf, "lineitem").where("l_returnflag = 'R' and l_shipdate >= timestamp'1997-03-01' and l_shipdate < timestamp'1997-04-01'"))


def _pairs(spark: SparkSession, sf: str, lines: DataFrame) -> DataFrame:
    n = table(spark, sf, "supplier").agg(F.count("*").alias("n"))
    parts = table(spark, sf, "part").select("p_partkey")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(F.broadcast(n)).select(F.col("l_suppkey").alias("src"), (F.col("p_partkey") % F.col("n")).alias("dst")).distinct()


def files(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node"))


# ------------------------------------------------------------------------- functions that call functions: orders
KINDS = {"1-URGENT": "http_endpoint", "2-HIGH": "app_runner", "3-MEDIUM": "cli_entry", "4-NOT SPECIFIED": "task_entry", "5-LOW": "main_block"}
_KIND_SQL = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items()) + " END"
CALLS_SQL = f"""
ordered AS (SELECT o_orderkey, o_orderpriority, lead(o_orderkey) OVER w AS nxt, row_number() OVER w AS rn FROM orders
  WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
calls AS (SELECT o_orderkey AS src, nxt AS dst, o_orderkey || '>' || nxt AS edge_id FROM ordered WHERE nxt IS NOT NULL),
entries AS (SELECT o_orderkey AS node, {_KIND_SQL} AS kind FROM ordered WHERE rn = 1),
externals AS (SELECT DISTINCT l_orderkey AS node FROM lineitem WHERE l_returnflag = 'R' AND l_quantity = 50)"""


def _kind() -> F.Column:
    return F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))[F.col("o_orderpriority")]


def _ordered(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.lead("o_orderkey").over(w).alias("nxt"), F.row_number().over(w).alias("rn"))


def calls(spark: SparkSession, sf: str) -> DataFrame:
    """(src, dst, edge_id): each order of a customer and the next."""
    return _ordered(spark, sf).where("nxt is not null").select(F.col("o_orderkey").alias("src"), F.col("nxt").alias("dst"), F.concat_ws(">", "o_orderkey", "nxt").alias("edge_id"))


def entries(spark: SparkSession, sf: str) -> DataFrame:
    """(node, kind): each customer's first order."""
    return _ordered(spark, sf).where("rn = 1").select(F.col("o_orderkey").alias("node"), _kind().alias("kind"))


def externals(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").where("l_returnflag = 'R' and l_quantity = 50").select(F.col("l_orderkey").alias("node")).distinct()


def methods(spark: SparkSession, sf: str) -> DataFrame:
    """(class, method): an order's priority and the order."""
    return table(spark, sf, "orders").select(F.col("o_orderpriority").alias("class"), F.col("o_orderkey").alias("method"))


# ------------------------------------------------------------------------- files with classes and functions
BRANDS_SQL = """
sold AS (SELECT DISTINCT l_suppkey AS path, p_brand AS brand, p_type AS kind, l_returnflag AS flag FROM lineitem JOIN part ON l_partkey = p_partkey),
classes AS (SELECT DISTINCT path, brand AS name FROM sold WHERE flag = 'R'),
functions AS (SELECT DISTINCT path, kind AS name FROM sold WHERE flag = 'N'),
marks AS (SELECT DISTINCT path, flag AS kind FROM sold WHERE kind LIKE '%A%'),
allfiles AS (SELECT s_suppkey AS path FROM supplier)"""


def brands(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """files, classes, functions and entry marks: suppliers with the brands and types that they sold."""
    sold = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("path"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), F.col("l_returnflag").alias("flag")).distinct()
    return {
        "files": table(spark, sf, "supplier").select(F.col("s_suppkey").alias("path")),
        "classes": sold.where("flag = 'R'").select("path", F.col("brand").alias("name")).distinct(),
        "functions": sold.where("flag = 'N'").select("path", F.col("kind").alias("name")).distinct(),
        "entries": sold.where("kind like '%A%'").select("path", F.col("flag").alias("kind")).distinct(),
    }
