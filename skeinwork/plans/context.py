"""Results made ready for an answer: critical files, confidence, and the context text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import fixed


def critical_files(records: DataFrame, n: int = 4) -> DataFrame:
    """(path, pos): the first n distinct files named in records (pos, value); ``path::name`` names its path."""
    path = F.when(F.col("value").contains("::"), F.substring_index("value", "::", 1)).otherwise(F.col("value"))
    named = records.select("pos", path.alias("path")).where(F.col("path").endswith(".py") | F.col("value").contains("/") & ~F.col("value").contains("::"))
    return named.groupBy("path").agg(F.min("pos").alias("pos")).orderBy("pos", "path").limit(n)


def file_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("path").union(b.select("path")).distinct()


def record_text(pos: Column, fields: dict[str, Column]) -> Column:
    """One record of the graph section: a line for each field that isn't null or an empty list."""
    lines = []
    for name, c in fields.items():
        lines.append(F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"  {name}: "), c)))
    return F.concat_ws("\n", F.concat(F.lit("\nRecord "), pos.cast("string"), F.lit(":")), *lines)


def chunk_text(path: Column, class_name: Column, function_name: Column, lo: Column, hi: Column, score: Column, text: Column) -> Column:
    """One chunk of the code section."""
    part = lambda c, other: F.coalesce(c, F.lit(other))
    head = F.concat(
        F.lit("\n["), part(path, "unknown"), F.lit(" | "), part(class_name, "module_level"), F.lit("."), part(function_name, "module_level_segment"), F.lit(" | lines "),
        part(lo.cast("string"), "?"), F.lit("-"), part(hi.cast("string"), "?"), F.lit(" | score "), fixed(score, 4), F.lit("]"),
    )
    return F.concat_ws("\n", head, text)


def section(title: str, rows: DataFrame, order: str, text: str) -> DataFrame:
    """One row (text): the titled, ordered texts of a bounded result; an empty result has an empty section."""
    kept = rows.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("x")))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda r: r.x), "\n")
    return kept.select(F.when(F.size("rows") > 0, F.concat(F.lit(f"[{title}]\n"), body)).otherwise(F.lit("")).alias("text"))


def _text_of(df: DataFrame, name: str) -> Column:
    """A field as text: a list's items, but for empty ones, are joined."""
    if df.schema[name].dataType.typeName() == "array":
        return F.array_join(F.filter(F.col(f"`{name}`").cast("array<string>"), lambda x: x.isNotNull() & (x != "")), ", ")
    return F.col(f"`{name}`").cast("string")


def context(spark: SparkSession, records: list[DataFrame], chunks: DataFrame | None) -> str:
    """The context of an answer: the graph section of the records, numbered on through all frames of bounded size, and the
    code section of chunks (path, class_name, function_name, line_start, line_end, score, text), best first."""
    parts, n = [], 0
    for df in records:
        place = F.row_number().over(Window.orderBy(F.monotonically_increasing_id())) + n
        fields = {c: _text_of(df, c) for c in df.columns}
        parts.append(df.select(place.alias("pos"), *(v.alias(f"field_{i}") for i, v in enumerate(fields.values()))).select("pos", record_text(F.col("pos"), {c: F.col(f"field_{i}") for i, c in enumerate(fields)}).alias("one")))
        n += df.count()
    sections = [section("Graph Relationships", reduce(DataFrame.union, parts), "pos", "one")] if parts else []
    if chunks is not None:
        one = chunk_text(*(F.col(c) for c in ("path", "class_name", "function_name", "line_start", "line_end", "score", "text")))
        sections.append(section("Code Chunks", chunks.select(F.struct((-F.col("score")).alias("a"), "id").alias("place"), one.alias("one")), "place", "one"))
    return "\n\n".join(t for t in (s.first().text for s in sections) if t).strip()


# ------------------------------------------------------------------------------------------------ checks of results
FALLBACK_COLUMN, LEAST_FILES = "f.path", 1


def file_names(value) -> list[str]:
    """The Python files that a value of a record names: itself, or its items."""
    return [x for x in (value if isinstance(value, (list, tuple)) else [value]) if isinstance(x, str) and x.endswith(".py")]


def checked(rows: list[dict]) -> dict:
    """is_fallback, is_meaningful, file_count, is_incomplete and the files of a bounded result."""
    named = [x for r in rows for v in r.values() for x in file_names(v)]
    fallback = len(rows) == 1 and list(rows[0]) == [FALLBACK_COLUMN]
    return {"is_fallback": fallback, "is_meaningful": bool(rows) and not fallback, "file_count": len(named), "is_incomplete": len(named) < LEAST_FILES, "files": sorted(set(named))}


def result_checks(results: DataFrame, records: DataFrame) -> DataFrame:
    """(id, is_fallback, is_meaningful, file_count, is_incomplete) of each result (id); its records: id, columns, values
    (the names of a record's columns, and a list of texts for each of them)."""
    files = F.size(F.filter(F.flatten("values"), lambda v: F.coalesce(v.endswith(".py"), F.lit(False))))
    of = records.groupBy("id").agg(F.count("*").alias("n"), F.sum(files).alias("files"), F.max(F.array_join("columns", "|")).alias("names"))
    fallback = (F.col("n") == 1) & (F.col("names") == FALLBACK_COLUMN)
    out = results.select("id").join(of, "id", "left").fillna(0, ["n", "files"]).fillna("", ["names"])
    return out.select("id", fallback.alias("is_fallback"), ((F.col("n") > 0) & ~fallback).alias("is_meaningful"), F.col("files").alias("file_count"), (F.col("files") < LEAST_FILES).alias("is_incomplete"))
