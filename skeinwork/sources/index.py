"""Indexing a source tree: facts, resolved edges, nodes and chunks as DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import name_uuid
from ..operators import chunking, resolve
from ..runtime import written
from . import code, retrieval, store


def build(spark: SparkSession, files: DataFrame, repo_id: str = "repo", reviews: DataFrame | None = None) -> dict[str, DataFrame]:
    """nodes, edges (type, src, dst, line), chunks and the fact tables of files (path, content).

    Nodes are Repo, File, Class, Function, Import and ExternalSymbol, with the properties of their label and nulls for the
    others.  reviews: entry points that a reviewer found in flagged files (``resolve.reviewed_entries``)."""
    parsed = written(code.parse(files), "parsed")
    names, imports, classes, functions = (code.facts(parsed, n) for n in ("local_names", "imports", "classes", "functions"))
    calls, bases, entries = (code.facts(parsed, n) for n in ("calls", "inheritance", "entry_points"))
    entries = entries.select("path", "qualified_name", "kind", "confidence", "reason")
    module_level = ["main_block", "app_runner"]
    marking = entries.where(~F.col("kind").isin(*module_level))
    if reviews is not None:
        found = resolve.reviewed_entries(parsed.where("entry_flagged"), reviews, functions)
        entries, marking = entries.union(found), marking.union(found.where("kind <> 'main_block'"))
    symbols = classes.select("name", "path", F.lit(0).alias("kind"), "pos").union(functions.select("name", "path", F.lit(1), "pos"))
    none = F.lit(None).cast("int").alias("line")
    file_edges = resolve.resolve_imports(names, resolve.module_index(files), resolve.name_index(symbols)).select(F.lit("IMPORTS").alias("type"), "src", "dst", none)
    resolved = resolve.resolve_calls(calls.select("caller", "callee").distinct(), functions, classes)
    kind = F.when(F.col("target_kind") == "function", "CALLS").when(F.col("target_kind") == "class", "INSTANTIATES").otherwise("CALLS_EXTERNAL")
    call_edges = calls.join(resolved, ["caller", "callee"]).select(kind.alias("type"), F.col("caller").alias("src"), F.col("target").alias("dst"), "line")
    derived = bases.select(F.concat_ws("::", "path", "class").alias("class"), "base", "line")
    parents = derived.join(resolve.resolve_inheritance(derived.select("class", "base").distinct(), classes), ["class", "base"])
    base_edges = parents.select(F.col("edge").alias("type"), F.col("class").alias("src"), F.col("target").alias("dst"), "line")
    symbol = F.concat_ws("#", "path", "module", "name")
    held = files.select(F.lit("CONTAINS").alias("type"), F.lit(repo_id).alias("src"), F.col("path").alias("dst"), none)
    named = imports.select(F.lit("IMPORTS_SYMBOL").alias("type"), F.col("path").alias("src"), symbol.alias("dst"), none)
    edges = reduce(DataFrame.union, [held, file_edges, named, call_edges, base_edges, resolve_containment(functions, classes)]).distinct()

    marks = resolve.annotate_entries(functions.select(F.col("qualified_name").alias("node")).distinct(), marking.select(F.col("qualified_name").alias("node"), F.regexp_replace("kind", "^app_runner$", "runner").alias("kind"), "confidence"))
    marks = marks.withColumn("entry_kind", F.regexp_replace("entry_kind", "^runner$", "app_runner"))
    listed = parsed.select(
        "path", F.transform("classes", lambda c: c["name"]).alias("classes"), F.transform("functions", lambda f: f["name"]).alias("functions"),
        F.filter(F.transform("imports", lambda i: i["name"]), lambda n: n != "").alias("imports"),
    )
    marked = entries.select("path", F.lit(True).alias("is_entry")).distinct()
    nodes = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [
        spark.range(1).select(F.lit(repo_id).alias("id"), F.lit("Repo").alias("label"), F.lit(repo_id).alias("name")),
        listed.join(marked, "path", "left").select(F.col("path").alias("id"), F.lit("File").alias("label"), F.element_at(F.split("path", "/"), -1).alias("name"), "path", "classes", "functions", "imports", F.coalesce("is_entry", F.lit(False)).alias("is_entry")),
        classes.select(F.col("qualified_name").alias("id"), F.lit("Class").alias("label"), "name", "path", "bases", "line_start", "line_end"),
        functions.join(marks, F.col("qualified_name") == F.col("node")).select(F.col("qualified_name").alias("id"), F.lit("Function").alias("label"), "name", "path", "class_name", "line_start", "line_end", "is_entry", "entry_kind", "entry_confidence"),
        imports.select(symbol.alias("id"), F.lit("Import").alias("label"), "name", "path", "module", "alias", "line"),
        edges.where("type in ('CALLS_EXTERNAL', 'INHERITS_EXTERNAL')").select(F.col("dst").alias("id"), F.lit("ExternalSymbol").alias("label"), F.col("dst").alias("name")),
    ]).dropDuplicates(["id", "label"])
    chunks = chunking.file_chunks(parsed)
    order = F.row_number().over(Window.partitionBy("path").orderBy("chunk_type", "line_start", "line_end"))
    chunks = chunks.withColumn("id", name_uuid(F.concat_ws(":", "path", F.coalesce("function_name", "class_name", F.lit("")), "line_start", order)))
    return {"nodes": nodes, "edges": edges, "chunks": chunks, "imports": imports, "entries": entries, "parsed": parsed}


def save(spark: SparkSession, root: str, repo_id: str, tables: dict[str, DataFrame], vectors: DataFrame | None = None) -> None:
    """Store an index as a new version, with its chunks' postings and vectors (theirs (id, embedding), if a model made some)."""

    def more(path: str) -> None:
        retrieval.write(spark.read.parquet(f"{path}/chunks").select("id", "text"), f"{path}/retrieval", vectors)

    store.save(spark, root, repo_id, tables, more)


def load(spark: SparkSession, root: str, repo_id: str) -> tuple[dict[str, DataFrame], retrieval.Stored]:
    """The current version's nodes, edges and chunks, and its stored retrieval tables."""
    path = store.current(spark, root, repo_id)
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("nodes", "edges", "chunks")}, retrieval.Stored(spark, f"{path}/retrieval")


def resolve_containment(functions: DataFrame, classes: DataFrame) -> DataFrame:
    """DEFINES_CLASS, DEFINES_FUNCTION and HAS_METHOD edges."""
    none = F.lit(None).cast("int").alias("line")
    known = classes.select("path", F.col("name").alias("class_name"), F.col("qualified_name").alias("owner")).dropDuplicates(["path", "class_name"])
    split = functions.join(known, ["path", "class_name"], "left")
    kind = F.when(F.col("owner").isNull(), "DEFINES_FUNCTION").otherwise("HAS_METHOD")
    return split.select(kind.alias("type"), F.coalesce("owner", "path").alias("src"), F.col("qualified_name").alias("dst"), none).union(classes.select(F.lit("DEFINES_CLASS"), "path", "qualified_name", none))
