"""Symbol resolution as equi-joins.

Where a symbol is defined more than once the winner is fixed by path, then kind (classes before functions), then position
in the file: the first or the last of that order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _place() -> F.Column:
    return F.struct("path", "kind", "pos")


def name_index(symbols: DataFrame) -> DataFrame:
    """(name, path): the file that defines a name last.  symbols: name, path, kind (0 class, 1 function), pos."""
    return symbols.groupBy("name").agg(F.max_by("path", _place()).alias("path"))


def module_index(files: DataFrame) -> DataFrame:
    """(module, path): every dotted suffix of a Python file's path, the last path winning."""
    parts = F.split(F.regexp_replace("path", r"\.py$", ""), "/")
    suffixes = files.where(F.col("path").endswith(".py")).select("path", parts.alias("parts"))
    each = suffixes.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.array_join(F.slice("parts", i, F.size("parts")), "."))).alias("module"))
    return each.groupBy("module").agg(F.max("path").alias("path"))


def resolve_imports(imports: DataFrame, modules: DataFrame, names: DataFrame) -> DataFrame:
    """(src, dst) of imports (path, module, name): the module's file, else the file of the imported local name."""
    known = imports.where("module is not null and module <> ''").join(modules.select("module", F.col("path").alias("by_module")), "module", "left")
    known = known.join(names.select("name", F.col("path").alias("by_name")), "name", "left")
    return known.select(F.col("path").alias("src"), F.coalesce("by_module", "by_name").alias("dst")).where("dst is not null").distinct()


def resolve_calls(calls: DataFrame, functions: DataFrame, classes: DataFrame) -> DataFrame:
    """(caller, callee, target_kind, target) of calls (caller, callee).

    functions: name, qualified_name, class_name, path, pos; classes: name, qualified_name, path, pos.  In order: the exact
    function, the exact class, for ``self.`` the method of the caller's class, the last part as a function, as a class;
    else the call is external.
    """
    order = F.struct("path", "pos")
    by_name = functions.groupBy(F.col("name").alias("k")).agg(F.min_by("qualified_name", order).alias("q"))
    exact_f = by_name.union(functions.select("qualified_name", "qualified_name").distinct()).dropDuplicates(["k"])
    exact_c = classes.groupBy(F.col("name").alias("k")).agg(F.min_by("qualified_name", order).alias("q"))
    methods = functions.where("class_name is not null").groupBy("class_name", F.col("name").alias("method")).agg(F.max_by("qualified_name", order).alias("q_self"))
    owner = functions.where("class_name is not null").groupBy(F.col("qualified_name").alias("caller")).agg(F.max_by("class_name", order).alias("own_class"))
    look = lambda index, key, out: index.select(F.col("k").alias(key), F.col("q").alias(out))
    x = calls.select("caller", "callee", F.element_at(F.split("callee", r"\."), -1).alias("last")).join(owner, "caller", "left")
    x = x.withColumn("method", F.when(F.col("callee").startswith("self."), F.col("last")))
    x = x.join(look(exact_f, "callee", "f1"), "callee", "left").join(look(exact_c, "callee", "c1"), "callee", "left")
    # one key for both; calls without a class or method have keys of their own, which match nothing and lie in no one place
    x = x.withColumn("of", F.coalesce(F.concat("own_class", F.lit("\0"), "method"), F.concat(F.lit("\1"), "caller", F.lit("\0"), "callee")))
    x = x.join(methods.select(F.concat("class_name", F.lit("\0"), "method").alias("of"), "q_self"), "of", "left")
    x = x.join(look(exact_f, "last", "f2"), "last", "left").join(look(exact_c, "last", "c2"), "last", "left")
    kind = F.when(F.col("f1").isNotNull(), "function").when(F.col("c1").isNotNull(), "class").when(F.coalesce("q_self", "f2").isNotNull(), "function").when(F.col("c2").isNotNull(), "class").otherwise("external")
    return x.select("caller", "callee", kind.alias("target_kind"), F.coalesce("f1", "c1", "q_self", "f2", "c2", "callee").alias("target"))


def resolve_inheritance(inheritance: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, base, edge, target) of (class, base): INHERITS_FROM a class of that exact name, else INHERITS_EXTERNAL."""
    index = classes.groupBy(F.col("name").alias("base")).agg(F.min_by("qualified_name", F.struct("path", "pos")).alias("q"))
    return inheritance.join(index, "base", "left").select("class", "base", F.when(F.col("q").isNotNull(), "INHERITS_FROM").otherwise("INHERITS_EXTERNAL").alias("edge"), F.coalesce("q", "base").alias("target"))


def annotate_entries(nodes: DataFrame, entries: DataFrame) -> DataFrame:
    """(node, is_entry, entry_kind, and entry_confidence if entries have one) of every node; entries: node, kind, confidence.
    Module-level kinds mark no function; of several kinds the last by name counts, with its confidence."""
    extra = [F.max_by("confidence", F.struct("kind", "confidence")).alias("entry_confidence")] if "confidence" in entries.columns else []
    marks = entries.where(~F.col("kind").isin("main_block", "app_runner")).groupBy("node").agg(F.max("kind").alias("entry_kind"), *extra)
    return nodes.join(marks, "node", "left").select("node", F.col("entry_kind").isNotNull().alias("is_entry"), "entry_kind", *(["entry_confidence"] if extra else []))


def reviewed_entries(flagged: DataFrame, reviews: DataFrame, functions: DataFrame) -> DataFrame:
    """(path, qualified_name, kind, confidence, reason): entry points that a reviewer found in flagged files (path).

    reviews: path, is_entry, kind, confidence, reason, as a language model or any other source gives them.  The entry is
    the file's first function, or ``main`` in a file without one; the kind is app_runner unless it is given."""
    first = functions.groupBy("path").agg(F.min_by("qualified_name", "pos").alias("first"))
    found = reviews.where("is_entry").join(flagged.select("path").distinct(), "path", "left_semi").join(first, "path", "left")
    kind = F.when(F.length("kind") > 0, F.col("kind")).otherwise(F.lit("app_runner"))
    return found.select("path", F.coalesce("first", F.concat("path", F.lit("::main"))).alias("qualified_name"), kind.alias("kind"), "confidence", "reason")
