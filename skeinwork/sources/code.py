"""Source trees as DataFrames: files, and the facts of their syntax trees."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship

# What marks entry points, and names that are never scanned.
ENTRY_FILES = ["main.py", "server.py", "run.py", "app.py", "wsgi.py", "asgi.py"]
HTTP_VERBS = ["get", "post", "put", "delete", "patch", "route", "head", "options", "websocket"]
RUNNER_CALLS = ["uvicorn.run", "app.run", "application.run", "celery.start", "serve.run", "hypercorn.run", "gunicorn.run"]
CLI_DECORATORS = ["click.command", "click.group", "typer.run"]
TASK_DECORATORS = ["celery.task", "shared_task", "app.task"]
IGNORED = [".git", ".gitignore", ".lock", ".venv", "__pycache__", "node_modules", ".vscode", "pyproject.toml", ".python-version", "requirements.txt"]
CONFIDENCE = 0.95

FACTS = """imports array<struct<module:string,name:string,alias:string,line:int>>,
local_names array<struct<module:string,name:string>>,
classes array<struct<name:string,qualified_name:string,bases:array<string>,line_start:int,line_end:int>>,
functions array<struct<name:string,qualified_name:string,class_name:string,line_start:int,line_end:int>>,
calls array<struct<caller:string,callee:string,line:int>>,
inheritance array<struct<class:string,base:string,line:int>>,
entry_points array<struct<qualified_name:string,name:string,kind:string,reason:string,confidence:double>>,
decorators array<string>, entry_flagged boolean, flag_reason string, parse_error string"""
_LISTS = ["imports", "local_names", "classes", "functions", "calls", "inheritance", "entry_points", "decorators"]
_DEFINITIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)


def read_tree(spark: SparkSession, root: str, prune: bool = True) -> DataFrame:
    """(path, name, content) of the Python files and README.md files under root; with prune, not within ignored folders."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "{*.py,README.md}").load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^[a-z]+:/*", "/")
    path = F.regexp_replace(F.col("path"), "^[a-z]+:/*", "/")
    out = found.select(path.substr(F.length(base) + 2, F.length(path)).alias("path"), F.col("content").cast("string").alias("content"))
    out = out.withColumn("name", F.element_at(F.split("path", "/"), -1)).where(~F.col("name").isin(*IGNORED))
    if prune:
        out = out.where(~F.arrays_overlap(F.split("path", "/"), F.array(*(F.lit(x) for x in IGNORED))))
    return out.select("path", "name", "content")


def dotted(node: ast.AST, subscripts: bool = True) -> str | None:
    """The dotted name of an expression: calls count as what they call, subscripts as what they index."""
    tail: list[str] = []
    while True:
        match node:
            case ast.Name(id=name):
                return ".".join([name, *reversed(tail)])
            case ast.Attribute(value=node, attr=attr):
                tail.append(attr)
            case ast.Call(func=node):
                pass
            case ast.Subscript(value=node) if subscripts:
                pass
            case _:
                return ".".join(reversed(tail)) or None


def _nodes_by_level(roots: list[ast.AST], stop: tuple = ()) -> Iterator[ast.AST]:
    """Nodes level by level; those of a type in stop are neither given nor entered."""
    level = list(roots)
    while level:
        level = [n for n in level if not isinstance(n, stop)] if stop else level
        yield from level
        level = [c for n in level for c in ast.iter_child_nodes(n)]


def decorator_kind(name: str) -> str | None:
    """The kind of entry point that a decorator makes of a function."""
    if name.rpartition(".")[2] in HTTP_VERBS:
        return "http_endpoint"
    if name in CLI_DECORATORS or name.endswith((".command", ".group")):
        return "cli_entry"
    if name in TASK_DECORATORS or name.endswith(".task"):
        return "task_entry"
    return None


def _is_main_guard(node: ast.AST) -> bool:
    match node:
        case ast.If(test=ast.Compare(left=ast.Name(id="__name__"), ops=[ast.Eq()], comparators=[ast.Constant(value="__main__")])):
            return True
    return False


def extract(source: str, path: str) -> dict:
    """The facts of one file; a file that can't be parsed has none but its error."""
    out: dict = {k: [] for k in _LISTS} | {"entry_flagged": False, "flag_reason": None, "parse_error": None}
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError) as error:
        return out | {"parse_error": f"{type(error).__name__}: {error}"}
    every = list(_nodes_by_level([tree]))
    owner = {f: c for c in every if isinstance(c, ast.ClassDef) for f in c.body if isinstance(f, _DEFINITIONS[:2])}
    qualify = lambda *names: f"{path}::{'.'.join(names)}"

    def function(node: ast.AST, cls: ast.ClassDef | None) -> None:
        q = qualify(cls.name, node.name) if cls else qualify(node.name)
        out["functions"].append({"name": node.name, "qualified_name": q, "class_name": cls.name if cls else None, "line_start": node.lineno, "line_end": node.end_lineno})
        for n in _nodes_by_level(node.body, _DEFINITIONS):
            if isinstance(n, ast.Call) and (callee := dotted(n.func)):
                out["calls"].append({"caller": q, "callee": callee, "line": n.lineno})

    for node in every:
        match node:
            case ast.Import(names=names):
                for a in names:
                    head = a.name.partition(".")[0]
                    out["imports"].append({"module": a.name, "name": head, "alias": a.asname, "line": node.lineno})
                    out["local_names"].append({"module": a.name, "name": a.asname or head})
            case ast.ImportFrom(module=module, names=names):
                for a in names:
                    out["imports"].append({"module": module or "", "name": a.name, "alias": a.asname, "line": node.lineno})
                    out["local_names"].append({"module": module, "name": a.asname or a.name})
            case ast.ClassDef():
                bases = [b for b in map(dotted, node.bases) if b]
                out["classes"].append({"name": node.name, "qualified_name": qualify(node.name), "bases": bases, "line_start": node.lineno, "line_end": node.end_lineno})
                out["inheritance"] += [{"class": node.name, "base": b, "line": node.lineno} for b in bases]
                for f in node.body:
                    if f in owner:
                        function(f, node)
            case ast.FunctionDef() | ast.AsyncFunctionDef() if node not in owner:
                function(node, None)
    entries = _entry_points(tree, every, owner, path, out)
    out["entry_points"] = list({(e["qualified_name"], e["kind"]): e for e in reversed(entries)}.values())[::-1]
    out["decorators"] = sorted(set(out["decorators"]))
    out["entry_flagged"], out["flag_reason"] = _review(tree, path, bool(entries))
    return out


def _entry_points(tree: ast.Module, every: list[ast.AST], owner: dict, path: str, out: dict) -> list[dict]:
    found = []

    def add(name: str, short: str, kind: str, reason: str) -> None:
        found.append({"qualified_name": f"{path}::{name}", "name": short, "kind": kind, "reason": reason, "confidence": CONFIDENCE})

    for node in tree.body:
        if _is_main_guard(node):
            add("__main__", "__main__", "main_block", "main guard")
        elif isinstance(node, ast.Expr) and isinstance(node.value, ast.Call) and (callee := dotted(node.value.func)) in RUNNER_CALLS:
            add(callee, callee.rpartition(".")[2], "app_runner", f"module-level call to {callee}")
    for node in every:
        for d in node.decorator_list if isinstance(node, _DEFINITIONS[:2]) else ():
            if not (name := dotted(d, subscripts=False)):
                continue
            out["decorators"].append(name)
            kind = decorator_kind(name)
            if kind:
                method = kind == "http_endpoint" and node in owner
                add(f"{owner[node].name}.{node.name}" if method else node.name, node.name, kind, f"decorator {name}")
    return found


def _review(tree: ast.Module, path: str, has_entries: bool) -> tuple[bool, str | None]:
    """Whether a file without entry points should be looked at, and why."""
    name = path.rpartition("/")[2]
    if has_entries:
        return False, None
    if name in ENTRY_FILES:
        return True, "entry file name"
    if name == "__init__.py" and len(tree.body) > 3 and sum(isinstance(n, (ast.Import, ast.ImportFrom)) for n in tree.body) >= 2:
        return True, "package entry"
    return False, None


def parse(files: DataFrame) -> DataFrame:
    """files (path, content) with the facts of every Python file; other files have empty facts."""
    ship(files.sparkSession)
    columns = ["path", "content", *_LISTS, "entry_flagged", "flag_reason", "parse_error"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [{"path": p, "content": c, **extract((c or "") if p.endswith(".py") else "", p)} for p, c in zip(part["path"], part["content"])]
            yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "content").mapInPandas(run, f"path string, content string, {FACTS}")


def facts(parsed: DataFrame, name: str) -> DataFrame:
    """One row a fact, with its file's path and position."""
    return parsed.select("path", F.posexplode(name).alias("pos", "x")).select("path", "pos", "x.*")
