"""Bounded overlapping chunks of files and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LINES, OVERLAP, SEGMENT = 100, 5, 100
MAX_CHARS, CUT_MARK = 12_000, "\n# ... truncated for embedding ..."


def windows(n: Column, size: int = MAX_LINES, overlap: int = OVERLAP) -> Column:
    """(part, start, end) of the windows over n lines: size lines each, overlap shared, the last may be shorter."""
    step = max(1, size - overlap)
    count = F.when(n <= 0, 0).otherwise(1 + F.ceil(F.greatest(n - size, F.lit(0)) / step)).cast("int")
    parts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(parts, lambda k: F.struct(k.alias("part"), (k * step).cast("int").alias("start"), F.least(k * step + size, n).cast("int").alias("end")))


def line_windows(texts: DataFrame, size: int = MAX_LINES, overlap: int = OVERLAP) -> DataFrame:
    """(id, part, start, end) of texts (id, text)."""
    lines = F.size(F.split("text", "\n"))
    return texts.where("text is not null").select("id", F.inline(windows(lines, size, overlap)))


def module_lines(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, line): non-blank lines (from 0) outside every span [start, end) of their text; a range anti join on the id."""
    each = texts.where("text is not null").select("id", F.posexplode(F.split("text", "\n")).alias("line", "content")).where(F.trim("content") != "")
    s = spans.select(F.col("id").alias("span_id"), "start", "end")
    return each.join(s, (F.col("id") == F.col("span_id")) & (F.col("line") >= F.col("start")) & (F.col("line") < F.col("end")), "left_anti").select("id", "line")


def module_segments(lines: DataFrame, size: int = SEGMENT) -> DataFrame:
    """(id, segment, start, end): runs of so many lines in order; start and end (exclusive) bound the text's slice."""
    from pyspark.sql import Window

    order = F.row_number().over(Window.partitionBy("id").orderBy("line")) - 1
    return lines.withColumn("segment", F.floor(order / size).cast("int")).groupBy("id", "segment").agg(F.min("line").alias("start"), (F.max("line") + 1).alias("end"))


def batches(rows: DataFrame, key: str, order: list[str], size: int) -> DataFrame:
    """rows with ``batch``, the number of the row's batch within its key."""
    from pyspark.sql import Window

    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1) / size).cast("int"))


def cap_text(text: Column, most: int = MAX_CHARS) -> Column:
    """text, or its first characters and a mark."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(CUT_MARK))).otherwise(text)


def file_chunks(files: DataFrame) -> DataFrame:
    """Chunks of parsed files (path, content, classes, functions as ``sources.code`` gives them).

    Classes and functions that aren't methods are cut into line windows (a function starts at its decorators), which go by
    the class's or function's name, with ``_part_`` and a number if there are several; the other lines form module segments,
    whose text is the slice from the first line to the last.
    """
    lines = files.select("path", F.split("content", "\n").alias("lines"), "classes", "functions")
    of_class = lines.select("path", "lines", F.explode("classes").alias("d"), F.col("functions").alias("all"))
    methods = F.transform(F.filter("all", lambda f: f.class_name == F.col("d.name")), lambda f: f["name"])
    of_class = of_class.select("path", "lines", F.col("d.name").alias("class_name"), F.col("d.name").alias("function_name"), F.lit("class").alias("chunk_type"), (F.col("d.line_start") - 1).alias("lo"), F.col("d.line_end").alias("hi"), methods.alias("methods"))
    own = lines.select("path", "lines", F.explode(F.filter("functions", lambda f: f.class_name.isNull())).alias("d"))
    above = F.reverse(F.slice("lines", F.lit(1), F.greatest(F.col("d.line_start") - 1, F.lit(0))))
    plain = F.array_position(F.transform(above, lambda x: ~F.ltrim(x).startswith("@")), True)
    lead = F.when(plain > 0, plain - 1).otherwise(F.size(above)).cast("int")
    none = F.lit(None).cast("array<string>")
    of_function = own.select("path", "lines", F.lit(None).cast("string").alias("class_name"), F.col("d.name").alias("function_name"), F.lit("function").alias("chunk_type"), (F.col("d.line_start") - 1 - lead).alias("lo"), F.col("d.line_end").alias("hi"), none.alias("methods"))
    cut = of_class.union(of_function).withColumn("ws", windows(F.col("hi") - F.col("lo"))).withColumn("w", F.explode("ws"))
    part = F.when(F.size("ws") > 1, F.concat(F.col("function_name"), F.lit("_part_"), F.col("w.part").cast("string"))).otherwise(F.col("function_name"))
    defined = cut.select("path", "lines", "class_name", part.alias("function_name"), "chunk_type", "methods", (F.col("lo") + F.col("w.start")).alias("start"), (F.col("lo") + F.col("w.end")).alias("end"))
    spans = lines.select(F.col("path").alias("id"), F.inline(F.transform(F.concat(F.transform("classes", lambda c: F.struct(c.line_start, c.line_end)), F.transform("functions", lambda f: F.struct(f.line_start, f.line_end))), lambda s: F.struct((s.line_start - 1).alias("start"), s.line_end.alias("end")))))
    module = module_segments(module_lines(files.select(F.col("path").alias("id"), F.col("content").alias("text")), spans))
    rest = module.join(lines.select(F.col("path").alias("id"), "lines"), "id").select(F.col("id").alias("path"), "lines", F.lit(None).cast("string").alias("class_name"), F.lit(None).cast("string").alias("function_name"), F.lit("module").alias("chunk_type"), none.alias("methods"), "start", "end")
    every = defined.unionByName(rest)
    text = cap_text(F.array_join(F.expr("slice(lines, start + 1, end - start)"), "\n"))
    return every.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), "chunk_type", "class_name", "function_name", (F.col("start") + 1).cast("int").alias("line_start"), F.col("end").cast("int").alias("line_end"), "methods", text.alias("text"))
