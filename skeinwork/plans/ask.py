"""Questions over an indexed tree: a rule-based router picks a plan, the plan builds a DataFrame.

A plan is a template's name and its parameters, never query text, so there is nothing to sanitise.  Language-model steps
are behind ``Provider``; the default one answers with the context itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import PROVIDER_FAILURES, SUBTYPE_KEYWORDS, TEMPLATE_PATTERNS
from ..operators import graph, names, search
from ..runtime import written
from ..sources.retrieval import Stored
from ..sources.store import Results
from . import context as checks

NAMES = ["source", "via", "filename"]  # parameters that are files' names
ROWS = 50  # that an answer takes of a plan
# The templates that are tried for each kind of question about the architecture, in order.
ARCHITECT_PLANS = {
    "request_flow": ["request_flow", "entry_call_chain"], "system_overview": ["system_overview", "entry_call_chain"], "dependency_map": ["dependency_map"],
    "class_interaction": ["class_interaction"], "entry_call_chain": ["entry_call_chain", "request_flow"],
}


@dataclass(frozen=True)
class Plan:
    template: str
    params: dict = field(default_factory=dict)


class Provider:
    """What a language model would do; this one needs no network and gives its context back."""

    def answer(self, question: str, context: str, history: list[dict]) -> str:
        return context

    def rewrite(self, question: str, history: list[dict]) -> str:
        return question


class Failover(Provider):
    """A second provider for errors that mean the first one failed; other errors are raised."""

    def __init__(self, first: Provider, second: Provider) -> None:
        self.first, self.second, self.used_second = first, second, False

    def _try(self, call: Callable[[Provider], str]) -> str:
        self.used_second = False
        try:
            return call(self.first)
        except Exception as error:
            seen = f"{type(error).__name__} {error}".lower()
            if not any(k in seen for k in PROVIDER_FAILURES):
                raise
            self.used_second = True
            return call(self.second)

    def answer(self, question: str, context: str, history: list[dict]) -> str:
        return self._try(lambda p: p.answer(question, context, history))

    def rewrite(self, question: str, history: list[dict]) -> str:
        return self._try(lambda p: p.rewrite(question, history))


def route(question: str) -> list[Plan]:
    """The plans for a question, best first; none means retrieval alone."""
    for name, pattern, args in TEMPLATE_PATTERNS:
        m = re.search(pattern, question, re.IGNORECASE)
        if m:
            return [Plan(name, dict(zip(args, m.groups())))]
    q = question.lower()
    for subtype, keywords in SUBTYPE_KEYWORDS:
        if any(k in q for k in keywords):
            return [Plan(t) for t in ARCHITECT_PLANS[subtype]]
    return []


def known_names(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, path) of files, classes and functions."""
    return tables["nodes"].where("label in ('File', 'Class', 'Function')").select("name", "path").distinct()


def with_known_names(spark: SparkSession, plan: Plan, tables: dict[str, DataFrame]) -> Plan:
    """plan with each file's name that isn't known replaced by the most similar one, if one is similar enough."""
    typed = [(v,) for k, v in plan.params.items() if k in NAMES]
    if not typed:
        return plan
    files = tables["nodes"].where("label = 'File'").select("name")
    found = {r.typed: r.name for r in names.resolve(spark.createDataFrame(typed, "typed string"), files).collect()}
    return Plan(plan.template, {k: found.get(v) or v if k in NAMES else v for k, v in plan.params.items()})


def execute(plan: Plan, tables: dict[str, DataFrame]) -> DataFrame:
    """The DataFrame of a plan over an index (``sources.index.build``)."""
    nodes, edges = tables["nodes"], tables["edges"]
    imports, calls = edges.where("type = 'IMPORTS'"), edges.where("type = 'CALLS'").withColumn("edge_id", F.concat_ws("|", "src", "dst", "line"))
    files = nodes.where("label = 'File'").select(F.col("path").alias("node"), "name")
    entries = nodes.where("is_entry").select(F.col("id").alias("node"), F.col("entry_kind").alias("kind"))
    # names resolve to file paths within the index
    paths = lambda name: files.where(F.col("name") == name).select("node")
    p = plan.params
    if plan.template == "multi_hop_imports":
        first = imports.join(paths(p["source"]), F.col("src") == F.col("node"), "left_semi").join(paths(p["via"]), F.col("dst") == F.col("node"), "left_semi")
        return first.select(F.col("dst").alias("mid")).distinct().join(imports, F.col("mid") == F.col("src")).select(F.col("dst").alias("file")).distinct()
    if plan.template == "leaf_nodes":
        return graph.leaf_nodes(files.select("node"), imports).select(F.col("node").alias("file"))
    if plan.template == "most_dependencies":
        return graph.most_dependencies(imports).select(F.col("node").alias("file"), "n")
    if plan.template == "direct_imports":
        return imports.join(paths(p["filename"]), F.col("src") == F.col("node"), "left_semi").select(F.col("dst").alias("file"))
    if plan.template == "reverse_lookup":
        return imports.join(paths(p["filename"]), F.col("dst") == F.col("node"), "left_semi").select(F.col("src").alias("file"))
    if plan.template == "transitive_dependencies":
        starts = paths(p["source"]).select(F.col("node").alias("start"))
        return graph.trails(graph.simple(imports), starts, 3).where("node <> start").select(F.col("node").alias("file")).distinct()
    if plan.template == "call_graph":
        callers = nodes.where((F.col("label") == "Function") & (F.col("name") == p["function_name"])).select(F.col("id").alias("node"))
        return calls.join(callers, F.col("src") == F.col("node"), "left_semi").select(F.col("dst").alias("called"), "line")
    if plan.template == "class_hierarchy":
        ids = nodes.where((F.col("label") == "Class") & (F.col("name") == p["class_name"])).select(F.col("id").alias("node"))
        return edges.where("type = 'INHERITS_FROM'").join(ids, F.col("src") == F.col("node"), "left_semi").select(F.col("dst").alias("parent"))
    members = edges.where("type = 'HAS_METHOD'").select(F.col("src").alias("class"), F.col("dst").alias("method"))
    if plan.template == "class_interaction":
        return graph.class_interaction(members, calls)
    if plan.template == "dependency_map":
        return graph.dependency_map(graph.simple(imports), files.select("node"))
    if plan.template == "entry_call_chain":
        return graph.entry_chains(calls, entries)
    if plan.template == "request_flow":
        outside = edges.where("type = 'CALLS_EXTERNAL'").select(F.col("src").alias("node"))
        return graph.request_flows(calls, entries, outside, ["http_endpoint", "app_runner"])
    of = lambda kind, label: edges.where(F.col("type") == kind).join(nodes.where(F.col("label") == label).select(F.col("id").alias("dst"), "name"), "dst").select(F.col("src").alias("path"), "name")
    if plan.template == "file_structure":
        where = paths(p["filename"])
        return graph.file_structure(of("DEFINES_CLASS", "Class"), of("DEFINES_FUNCTION", "Function")).join(where, F.col("path") == F.col("node"), "left_semi")
    if plan.template == "system_overview":
        marked = nodes.where("is_entry").select("path", F.col("entry_kind").alias("kind"))
        return graph.system_overview(files.select(F.col("node").alias("path")), of("DEFINES_CLASS", "Class"), of("DEFINES_FUNCTION", "Function"), marked)
    raise KeyError(plan.template)


def scope(spark: SparkSession, question: str, rows: list[dict], tables: dict[str, DataFrame]) -> DataFrame:
    """(path): the files to look into: those that a meaningful result, of bounded size, names, and where it names none those
    of the question."""
    seen = checks.checked(rows)
    if seen["is_meaningful"] and seen["files"]:
        return spark.createDataFrame([(f,) for f in seen["files"]], "path string")
    return names.entities(spark.createDataFrame([(question,)], "text string"), known_names(tables)).select("path").distinct()


def retrieve(spark: SparkSession, question: str, tables: dict[str, DataFrame], files: DataFrame, k: int = 5, stored: Stored | None = None) -> DataFrame:
    """(id, path, class_name, function_name, line_start, line_end, text, score) of the k best chunks by hybrid search, within the files (path) if they have chunks.

    stored: the chunks' postings and vectors; without them they are made for this question."""
    chunks = tables["chunks"].select("id", "path", "class_name", "function_name", "line_start", "line_end", "text")
    inside = written(chunks.join(files.select("path").distinct(), "path", "left_semi").select("id"), "scope")
    keep, asked = None if inside.isEmpty() else inside, spark.createDataFrame([(question,)], "text string")
    if stored is not None:
        best = stored.hybrid(asked, k, keep=keep)
    else:
        best = search.hybrid((chunks if keep is None else chunks.join(keep, "id", "left_semi")).select("id", "text"), asked, k)
    return best.join(chunks, "id").select(*chunks.columns, F.col("rrf").alias("score")).orderBy(F.desc("score"), "id")


def ask(
    spark: SparkSession, question: str, tables: dict[str, DataFrame], provider: Provider | None = None, history: list[dict] | None = None, stored: Stored | None = None, results: Results | None = None
) -> dict:
    """question, plans, rows (bounded), chunks, sources (files, best first), score (the best chunk's) and answer.

    A template without rows falls through to the next plan; chunks of the files that the rows or the question name are
    found beside them, and are all there is where no plan has rows.  stored and results: the stored version's postings and
    vectors, and the results that were kept with it."""
    provider, history = provider or Provider(), history or []
    rows, used, frames, asked = [], [], [], provider.rewrite(question, history)
    for plan in route(asked):
        plan = with_known_names(spark, plan, tables)
        make = lambda plan=plan: execute(plan, tables).limit(ROWS)
        found = make() if results is None else results.get(plan.template, plan.params, make)
        got = found.collect()
        if got:
            rows, used = rows + [r.asDict() for r in got], [*used, plan]
            frames.append(spark.createDataFrame(got, found.schema))
    best = retrieve(spark, asked, tables, scope(spark, asked, rows, tables), stored=stored)
    near = best.collect()
    found = [r.asDict() for r in near]
    context = checks.context(spark, frames, spark.createDataFrame(near, best.schema) if near else None)
    named = [*checks.checked(rows)["files"], *(r["path"] for r in found)]
    return {
        "question": question, "plans": used or [Plan("retrieval")], "rows": rows or found, "chunks": found, "sources": list(dict.fromkeys(named)),
        "score": found[0]["score"] if found else None, "answer": provider.answer(question, context, history[-8:]),
    }
