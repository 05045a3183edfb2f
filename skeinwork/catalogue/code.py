"""Queries over source code: a project for each supplier, with names of its own, is parsed and resolved; plus chunks of
documents.

The SQL of the parsed facts is rows that were derived by hand from the project, for each supplier.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking as K
from ..operators import resolve as R
from ..sources import code, index
from . import shared as S

APP = '''import os
import util.text as ut
from pkg.models import Base, User as U
from flask import Flask

app = Flask(__name__)


class Service(Base):
    def run(self, n):
        self.step(n)
        return ut.clean(n)

    def step(self, n):
        def inner():
            return helper(n)
        return inner()


@app.route("/go")
def go():
    s = Service()
    s.run(1)
    return os.getcwd()


if __name__ == "__main__":
    app.run()
'''
MODELS = '''class Base:
    pass


class User(Base, dict):
    def name(self):
        return super().get("name")
'''
TEXT = '''def helper(x):
    return clean(x)


def clean(x):
    return str(x).strip()
'''
FILES = [("app.py", APP), ("main.py", "x = 1\n"), ("pkg/models.py", MODELS), ("util/text.py", TEXT), ("README.md", "# not code\n"), ("bad.py", "def broken(:\n")]

# a second project, with command line, task and module-level entries, for the whole index
SECOND = [
    ("svc/__init__.py", "from svc.jobs import nightly\nfrom svc.cli import tool\nVERSION = 1\nNAME = 'svc'\n"),
    ("svc/cli.py", "import click\nfrom svc.jobs import nightly as job\n\n\n@click.command()\ndef tool():\n    job()\n"),
    ("svc/jobs.py", "from celery import shared_task\n\n\nclass Job(object):\n    def go(self):\n        return print(self)\n\n\n@shared_task\ndef nightly():\n    Job()\n"),
    ("serve.py", "import uvicorn\nfrom svc.jobs import Job\n\n\nclass Late(Job):\n    pass\n\n\nuvicorn.run('x')\n"), ("README.md", "# svc\n"),
]
REVIEWS = [("svc/__init__.py", True, None, 0.7, "re-exports"), ("svc/jobs.py", True, "http_endpoint", 0.9, "wasn't flagged"), ("serve.py", False, None, 0.2, "no")]


OWN = "svc|Job|nightly|tool|Late|serve|README"  # each supplier's own names in the second project


def _index(spark, sf):
    """The index of all suppliers' second projects, as one repository; built once in an application."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _built:
        files = S.each_supplier(spark, sf, S.marked(SECOND, OWN), "path string, content string").select("path", "content")
        reviews = S.each_supplier(spark, sf, S.marked(REVIEWS, OWN), "path string, is_entry boolean, kind string, confidence double, reason string").drop("of")
        _built[key] = index.build(spark, files, "all", reviews)
    return _built[key]


_built: dict[tuple[str, str], dict] = {}


def _index_nodes(spark, sf):
    joined = [F.array_join(c, ",").alias(c) for c in ("classes", "functions", "imports", "bases")]
    return _index(spark, sf)["nodes"].select("id", "label", "name", "path", *joined, "class_name", "line_start", "line_end", "is_entry", "entry_kind", "entry_confidence", "module", "alias", "line")


_NODES = [
    ("all", "Repo", "all", None, None, None, None, None, None, None, None, None, None, None, None, None, None),
    ("svc/__init__.py", "File", "__init__.py", "svc/__init__.py", "", "", "nightly,tool", None, None, None, None, True, None, None, None, None, None),
    ("svc/cli.py", "File", "cli.py", "svc/cli.py", "", "tool", "click,nightly", None, None, None, None, True, None, None, None, None, None),
    ("svc/jobs.py", "File", "jobs.py", "svc/jobs.py", "Job", "go,nightly", "shared_task", None, None, None, None, True, None, None, None, None, None),
    ("serve.py", "File", "serve.py", "serve.py", "Late", "", "uvicorn,Job", None, None, None, None, True, None, None, None, None, None),
    ("README.md", "File", "README.md", "README.md", "", "", "", None, None, None, None, False, None, None, None, None, None),
    ("svc/jobs.py::Job", "Class", "Job", "svc/jobs.py", None, None, None, "object", None, 4, 6, None, None, None, None, None, None),
    ("serve.py::Late", "Class", "Late", "serve.py", None, None, None, "Job", None, 5, 6, None, None, None, None, None, None),
    ("svc/cli.py::tool", "Function", "tool", "svc/cli.py", None, None, None, None, None, 6, 7, True, "cli_entry", 0.95, None, None, None),
    ("svc/jobs.py::Job.go", "Function", "go", "svc/jobs.py", None, None, None, None, "Job", 5, 6, False, None, None, None, None, None),
    ("svc/jobs.py::nightly", "Function", "nightly", "svc/jobs.py", None, None, None, None, None, 10, 11, True, "task_entry", 0.95, None, None, None),
    ("svc/__init__.py#svc.jobs#nightly", "Import", "nightly", "svc/__init__.py", None, None, None, None, None, None, None, None, None, None, "svc.jobs", None, 1),
    ("svc/__init__.py#svc.cli#tool", "Import", "tool", "svc/__init__.py", None, None, None, None, None, None, None, None, None, None, "svc.cli", None, 2),
    ("svc/cli.py#click#click", "Import", "click", "svc/cli.py", None, None, None, None, None, None, None, None, None, None, "click", None, 1),
    ("svc/cli.py#svc.jobs#nightly", "Import", "nightly", "svc/cli.py", None, None, None, None, None, None, None, None, None, None, "svc.jobs", "job", 2),
    ("svc/jobs.py#celery#shared_task", "Import", "shared_task", "svc/jobs.py", None, None, None, None, None, None, None, None, None, None, "celery", None, 1),
    ("serve.py#uvicorn#uvicorn", "Import", "uvicorn", "serve.py", None, None, None, None, None, None, None, None, None, None, "uvicorn", None, 1),
    ("serve.py#svc.jobs#Job", "Import", "Job", "serve.py", None, None, None, None, None, None, None, None, None, None, "svc.jobs", None, 2),
    ("job", "ExternalSymbol", "job", None, None, None, None, None, None, None, None, None, None, None, None, None, None),
    ("print", "ExternalSymbol", "print", None, None, None, None, None, None, None, None, None, None, None, None, None, None),
    ("object", "ExternalSymbol", "object", None, None, None, None, None, None, None, None, None, None, None, None, None, None),
]
_EDGES = [
    *(("CONTAINS", "all", p, None) for p, _ in SECOND), ("IMPORTS", "svc/__init__.py", "svc/jobs.py", None), ("IMPORTS", "svc/__init__.py", "svc/cli.py", None), ("IMPORTS", "svc/cli.py", "svc/jobs.py", None),
    ("IMPORTS", "serve.py", "svc/jobs.py", None), ("IMPORTS_SYMBOL", "svc/__init__.py", "svc/__init__.py#svc.jobs#nightly", None), ("IMPORTS_SYMBOL", "svc/__init__.py", "svc/__init__.py#svc.cli#tool", None),
    ("IMPORTS_SYMBOL", "svc/cli.py", "svc/cli.py#click#click", None), ("IMPORTS_SYMBOL", "svc/cli.py", "svc/cli.py#svc.jobs#nightly", None), ("IMPORTS_SYMBOL", "svc/jobs.py", "svc/jobs.py#celery#shared_task", None),
    ("IMPORTS_SYMBOL", "serve.py", "serve.py#uvicorn#uvicorn", None), ("IMPORTS_SYMBOL", "serve.py", "serve.py#svc.jobs#Job", None), ("CALLS_EXTERNAL", "svc/cli.py::tool", "job", 7),
    ("CALLS_EXTERNAL", "svc/jobs.py::Job.go", "print", 6), ("INSTANTIATES", "svc/jobs.py::nightly", "svc/jobs.py::Job", 11), ("INHERITS_EXTERNAL", "svc/jobs.py::Job", "object", 4),
    ("INHERITS_FROM", "serve.py::Late", "svc/jobs.py::Job", 5), ("DEFINES_CLASS", "svc/jobs.py", "svc/jobs.py::Job", None), ("DEFINES_CLASS", "serve.py", "serve.py::Late", None),
    ("DEFINES_FUNCTION", "svc/cli.py", "svc/cli.py::tool", None), ("DEFINES_FUNCTION", "svc/jobs.py", "svc/jobs.py::nightly", None), ("HAS_METHOD", "svc/jobs.py::Job", "svc/jobs.py::Job.go", None),
]
_MARKS = [
    ("svc/cli.py", "svc/cli.py::tool", "cli_entry", 0.95), ("svc/jobs.py", "svc/jobs.py::nightly", "task_entry", 0.95), ("serve.py", "serve.py::uvicorn.run", "app_runner", 0.95),
    ("svc/__init__.py", "svc/__init__.py::main", "app_runner", 0.7),
]


NAMES = "Service|Base|User|helper|clean"  # each supplier's own names in the first project


def _parsed(spark, sf):
    files = [(f"s{S.MARK}/{path}", S.marked(content, NAMES)) for path, content in FILES]
    return code.parse(S.each_supplier(spark, sf, files, "path string, content string"))


def _fact(name, *columns):
    return lambda spark, sf: code.facts(_parsed(spark, sf), name).select(*columns)


def _facts_sql(rows, columns):
    """Facts of the first project, whose first column begins with a path, for each supplier."""
    return f"SELECT {columns} FROM {S.each_supplier_sql([(f's{S.MARK}/{r[0]}', *r[1:]) for r in S.marked(rows, NAMES)], columns)}"


_IMPORTS = [
    ("app.py", "os", "os", None, 1), ("app.py", "util.text", "util", "ut", 2), ("app.py", "pkg.models", "Base", None, 3), ("app.py", "pkg.models", "User", "U", 3), ("app.py", "flask", "Flask", None, 4),
]
_CLASSES = [("app.py::Service", "Base", 9, 17), ("pkg/models.py::Base", "", 1, 2), ("pkg/models.py::User", "Base,dict", 5, 7)]
_FUNCTIONS = [
    ("app.py::Service.run", "Service", 10, 12), ("app.py::Service.step", "Service", 14, 17), ("app.py::inner", None, 15, 16), ("app.py::go", None, 21, 24), ("pkg/models.py::User.name", "User", 6, 7),
    ("util/text.py::helper", None, 1, 2), ("util/text.py::clean", None, 5, 6),
]
_CALLS = [
    ("app.py::Service.run", "self.step", 11), ("app.py::Service.run", "ut.clean", 12), ("app.py::Service.step", "inner", 17), ("app.py::inner", "helper", 16), ("app.py::go", "Service", 22),
    ("app.py::go", "s.run", 23), ("app.py::go", "os.getcwd", 24), ("pkg/models.py::User.name", "super.get", 7), ("pkg/models.py::User.name", "super", 7), ("util/text.py::helper", "clean", 2),
    ("util/text.py::clean", "str.strip", 6), ("util/text.py::clean", "str", 6),
]
_ENTRIES = [("app.py::__main__", "main_block"), ("app.py::go", "http_endpoint")]
_FLAGS = [("app.py", False, None, False), ("main.py", True, "entry file name", False), ("pkg/models.py", False, None, False), ("util/text.py", False, None, False), ("README.md", False, None, False), ("bad.py", False, None, True)]

# facts for the resolution joins: (path, module, name) of imports; definitions with their place
_IMP = [("a.py", "util.text", "ut"), ("a.py", "missing", "Helper"), ("a.py", None, "x"), ("b/c.py", "a", "a"), ("b/c.py", "c", "c"), ("b/c.py", "json", "loads"), ("util/text.py", "text", "clean")]
_SYM = [("Helper", "b/c.py", 0, 0), ("Helper", "a.py", 0, 1), ("clean", "util/text.py", 1, 0), ("loads", "a.py", 1, 2), ("loads", "b/c.py", 1, 0)]
_MOD = ["a.py", "b/c.py", "util/text.py", "z/util/text.py", "README.md"]
_FN = [("run", "a.py::S.run", "S", "a.py", 0), ("step", "a.py::S.step", "S", "a.py", 1), ("go", "a.py::go", None, "a.py", 2), ("step", "b.py::step", None, "b.py", 0), ("get", "b.py::T.get", "T", "b.py", 1)]
_CL = [("S", "a.py::S", "a.py", 0), ("T", "b.py::T", "b.py", 0), ("S", "b.py::S", "b.py", 1)]
_CALL = [("a.py::S.run", "self.step"), ("a.py::S.run", "step"), ("a.py::go", "S"), ("a.py::go", "obj.get"), ("a.py::go", "mod.T"), ("a.py::go", "os.getcwd"), ("a.py::go", "self.run"), ("b.py::T.get", "self.nothing"), ("b.py::T.get", "a.py::go")]
_INH = [("a.py::S", "T"), ("b.py::T", "mod.T"), ("b.py::S", "S"), ("b.py::T", "dict")]


_ANY = r"(?!py\b|self\b)[A-Za-z]\w*"
_IMP, _SYM, _MOD, _FN, _CL, _CALL, _INH = (S.marked(rows, _ANY) for rows in (_IMP, _SYM, [(m,) for m in _MOD], _FN, _CL, _CALL, _INH))


def _frame(spark, sf, rows, schema):
    return S.each_supplier(spark, sf, rows, schema).drop("of")


def _functions(spark, sf):
    return _frame(spark, sf, _FN, "name string, qualified_name string, class_name string, path string, pos int")


def _classes(spark, sf):
    return _frame(spark, sf, _CL, "name string, qualified_name string, path string, pos int")


def _resolved_imports(spark, sf):
    symbols = _frame(spark, sf, _SYM, "name string, path string, kind int, pos int")
    return R.resolve_imports(_frame(spark, sf, _IMP, "path string, module string, name string"), R.module_index(_frame(spark, sf, _MOD, "path string")), R.name_index(symbols))


def _page_paths(spark, sf):
    """Page addresses' paths as if they were Python files."""
    path = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://[^/]*/", ""), r"[?#].*$", "")
    return S.table(spark, sf, "pages").select(F.concat(F.regexp_replace(path, "/+$", ""), F.lit(".py")).alias("path"))


def _docs(spark, sf):
    return S.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


def _segments(spark, sf):
    texts = _docs(spark, sf)
    spans = texts.select("id", F.lit(0).alias("start"), F.lit(2).alias("end")).union(texts.select("id", F.lit(4), F.lit(7)))
    return K.module_lines(texts, spans)


def _windows(size, overlap):
    return lambda spark, sf: K.line_windows(_docs(spark, sf), size, overlap).select(F.col("id").alias("doc_id"), "part", "start", "end")


def _windows_sql(size, overlap):
    step = size - overlap
    return f"""WITH n AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL),
      p AS (SELECT doc_id, n, CAST(unnest(range(0, 1 + CAST(ceil(greatest(n - {size}, 0) / {step}.0) AS BIGINT))) AS INT) AS part FROM n)
      SELECT doc_id, part, CAST(part * {step} AS INT) AS start, CAST(least(part * {step} + {size}, n) AS INT) AS "end" FROM p"""


_LINES_SQL = r"""lines AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS content, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents WHERE text IS NOT NULL),
  kept AS (SELECT id, line FROM lines WHERE trim(content) <> '' AND NOT (line >= 0 AND line < 2) AND NOT (line >= 4 AND line < 7))"""

QUERIES = {
    "index_nodes": _index_nodes,
    "index_edges": lambda spark, sf: _index(spark, sf)["edges"],
    "index_entries": lambda spark, sf: _index(spark, sf)["entries"].select("path", "qualified_name", "kind", "confidence"),
    "ast_imports": _fact("imports", "path", "module", "name", "alias", "line"),
    "ast_classes": lambda spark, sf: code.facts(_parsed(spark, sf), "classes").select("qualified_name", F.array_join("bases", ",").alias("bases"), "line_start", "line_end"),
    "ast_functions": _fact("functions", "qualified_name", "class_name", "line_start", "line_end"),
    "ast_calls": _fact("calls", "caller", "callee", "line"),
    "entry_points": _fact("entry_points", "qualified_name", "kind"),
    "entry_flagged": lambda spark, sf: _parsed(spark, sf).select("path", "entry_flagged", "flag_reason", F.col("parse_error").isNotNull().alias("failed")),
    "module_suffix_index": lambda spark, sf: R.module_index(_page_paths(spark, sf)),
    "resolve_imports": _resolved_imports,
    "resolve_calls": lambda spark, sf: R.resolve_calls(_frame(spark, sf, _CALL, "caller string, callee string"), _functions(spark, sf), _classes(spark, sf)),
    "resolve_inheritance": lambda spark, sf: R.resolve_inheritance(_frame(spark, sf, _INH, "class string, base string"), _classes(spark, sf)),
    "line_windows": _windows(100, 5),
    "line_windows_small": _windows(10, 2),
    "module_lines_anti": lambda spark, sf: _segments(spark, sf).select(F.col("id").alias("doc_id"), "line"),
    "module_segments": lambda spark, sf: K.module_segments(_segments(spark, sf), 5).select(F.col("id").alias("doc_id"), "segment", "start", "end"),
    "cap_text": lambda spark, sf: _docs(spark, sf).select(F.col("id").alias("doc_id"), F.length(K.cap_text(F.col("text"))).alias("n"), F.substring(K.cap_text(F.col("text")), -20, 20).alias("ending")),
    "batching": lambda spark, sf: K.batches(_docs(spark, sf).select("id", (F.col("id") % 7).alias("k")), "k", ["id"], 4).select(F.col("id").alias("doc_id"), "k", "batch"),
}

_V = S.each_supplier_sql
_RES = f"""imp AS (SELECT * FROM {_V(_IMP, "path, module, name")}), sym AS (SELECT * FROM {_V(_SYM, "name, path, kind, pos")}), f AS (SELECT * FROM {_V(_MOD, "path")}),
  parts AS (SELECT path, string_split(regexp_replace(path, '\\.py$', ''), '/') AS p FROM f WHERE path LIKE '%.py'), suffix AS (SELECT path, unnest(range(1, len(p) + 1)) AS i, p FROM parts),
  modules AS (SELECT array_to_string(p[i:], '.') AS module, max(path) AS path FROM suffix GROUP BY 1), names AS (SELECT name, arg_max(path, (path, kind, pos)) AS path FROM sym GROUP BY name)"""
_CODE = f"""fn AS (SELECT * FROM {_V(_FN, "name, qualified_name, class_name, path, pos")}), cl AS (SELECT * FROM {_V(_CL, "name, qualified_name, path, pos")}), call AS (SELECT * FROM {_V(_CALL, "caller, callee")}),
  inh AS (SELECT * FROM {_V(_INH, "class, base")}), fi AS (SELECT name AS k, arg_min(qualified_name, (path, pos)) AS q FROM fn GROUP BY name UNION SELECT qualified_name, qualified_name FROM fn),
  ci AS (SELECT name AS k, arg_min(qualified_name, (path, pos)) AS q FROM cl GROUP BY name)"""
SQL = {
    "index_nodes": f"""SELECT DISTINCT id, label, name, path, classes, functions, imports, bases, class_name, line_start, line_end, is_entry, entry_kind, CAST(entry_confidence AS DOUBLE) AS entry_confidence, module, alias, line
      FROM {_V(S.marked(_NODES, OWN), 'id, label, name, path, classes, functions, imports, bases, class_name, line_start, line_end, is_entry, entry_kind, entry_confidence, module, alias, line')}""",
    "index_edges": f"SELECT DISTINCT type, src, dst, line FROM {_V(S.marked(_EDGES, OWN), 'type, src, dst, line')}",
    "index_entries": f"SELECT path, qualified_name, kind, CAST(confidence AS DOUBLE) AS confidence FROM {_V(S.marked(_MARKS, OWN), 'path, qualified_name, kind, confidence')}",
    "ast_imports": _facts_sql(_IMPORTS, "path, module, name, alias, line"),
    "ast_classes": _facts_sql(_CLASSES, "qualified_name, bases, line_start, line_end"),
    "ast_functions": _facts_sql(_FUNCTIONS, "qualified_name, class_name, line_start, line_end"),
    "ast_calls": _facts_sql(_CALLS, "caller, callee, line"),
    "entry_points": _facts_sql(_ENTRIES, "qualified_name, kind"),
    "entry_flagged": _facts_sql(_FLAGS, "path, entry_flagged, flag_reason, failed"),
    "module_suffix_index": r"""WITH f AS (SELECT regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*/', ''), '[?#].*$', ''), '/+$', '') || '.py' AS path FROM pages),
      parts AS (SELECT path, string_split(regexp_replace(path, '\.py$', ''), '/') AS p FROM f), suffix AS (SELECT path, unnest(range(1, len(p) + 1)) AS i, p FROM parts)
      SELECT array_to_string(p[i:], '.') AS module, max(path) AS path FROM suffix GROUP BY 1""",
    "resolve_imports": f"""WITH {_RES} SELECT DISTINCT imp.path AS src, coalesce(m.path, n.path) AS dst FROM imp LEFT JOIN modules m ON m.module = imp.module LEFT JOIN names n ON n.name = imp.name
      WHERE imp.module IS NOT NULL AND imp.module <> '' AND coalesce(m.path, n.path) IS NOT NULL""",
    "resolve_calls": f"""WITH {_CODE}, x AS (SELECT *, string_split(callee, '.')[-1] AS last, (SELECT arg_max(class_name, (path, pos)) FROM fn WHERE qualified_name = caller AND class_name IS NOT NULL) AS own FROM call),
      y AS (SELECT x.*, (SELECT q FROM fi WHERE k = callee) AS f1, (SELECT q FROM ci WHERE k = callee) AS c1,
        (SELECT arg_max(qualified_name, (path, pos)) FROM fn WHERE class_name = own AND name = last AND callee LIKE 'self.%') AS m, (SELECT q FROM fi WHERE k = last) AS f2, (SELECT q FROM ci WHERE k = last) AS c2 FROM x)
      SELECT caller, callee, CASE WHEN f1 IS NOT NULL THEN 'function' WHEN c1 IS NOT NULL THEN 'class' WHEN coalesce(m, f2) IS NOT NULL THEN 'function' WHEN c2 IS NOT NULL THEN 'class' ELSE 'external' END AS target_kind,
        coalesce(f1, c1, m, f2, c2, callee) AS target FROM y""",
    "resolve_inheritance": f"WITH {_CODE} SELECT class, base, CASE WHEN q IS NULL THEN 'INHERITS_EXTERNAL' ELSE 'INHERITS_FROM' END AS edge, coalesce(q, base) AS target FROM inh LEFT JOIN ci ON k = base",
    "line_windows": _windows_sql(100, 5),
    "line_windows_small": _windows_sql(10, 2),
    "module_lines_anti": f"WITH {_LINES_SQL} SELECT id AS doc_id, CAST(line AS INT) AS line FROM kept",
    "module_segments": f"""WITH {_LINES_SQL}, s AS (SELECT id, line, CAST(floor((row_number() OVER (PARTITION BY id ORDER BY line) - 1) / 5) AS INT) AS segment FROM kept)
      SELECT id AS doc_id, segment, CAST(min(line) AS INT) AS start, CAST(max(line) + 1 AS INT) AS "end" FROM s GROUP BY id, segment""",
    "cap_text": """WITH c AS (SELECT doc_id, CASE WHEN length(text) > 12000 THEN substr(text, 1, 12000) || chr(10) || '# ... truncated for embedding ...' ELSE text END AS t FROM documents)
      SELECT doc_id, CAST(length(t) AS INT) AS n, right(t, 20) AS ending FROM c""",
    "batching": "SELECT doc_id, doc_id % 7 AS k, CAST(floor((row_number() OVER (PARTITION BY doc_id % 7 ORDER BY doc_id) - 1) / 4) AS INT) AS batch FROM documents",
}
