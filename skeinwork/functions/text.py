"""Column functions over addresses, questions, messages and names."""

from __future__ import annotations

import difflib
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ------------------------------------------------------------------------------------------------ fixed values
# Question patterns in the order in which they are tried, and the names of what they capture.
TEMPLATE_PATTERNS = [
    ("multi_hop_imports", r"(?:which\s+)?files?\s+(?:does?\s+)?(\w+\.py)\s+(?:indirectly\s+)?depend(?:s|ency)?\s+on\s+through\s+(\w+\.py)", ["source", "via"]),
    ("leaf_nodes", r"leaf\s+node|no\s+import|do\s+not\s+import\s+any", []),
    ("most_dependencies", r"most\s+dependen|highest\s+dependen|most\s+import", []),
    ("direct_imports", r"(?:what\s+(?:does|do)\s+)?(\w+\.py)\s+import", ["filename"]),
    ("reverse_lookup", r"(?:which|what)\s+files?\s+import\s+(\w+\.py)", ["filename"]),
    ("transitive_dependencies", r"transitive\s+dependenc(?:y|ies).*?(\w+\.py)", ["source"]),
    ("file_structure", r"(?:structure|content|what\s+is\s+in)\s+(\w+\.py)", ["filename"]),
    ("call_graph", r"(?:what\s+(?:does|do)\s+)?(?:function\s+)?(\w+)\s+call", ["function_name"]),
    ("class_hierarchy", r"(?:what\s+(?:does|do)\s+)?(?:class\s+)?(\w+)\s+inherit", ["class_name"]),
]
# Architecture question kinds with their keywords, in the order in which they are tried.
SUBTYPE_KEYWORDS = [
    ("request_flow", ["request flow", "end-to-end", "api to", "trace the call", "call chain", "from api"]),
    ("dependency_map", ["dependency map", "module depend", "how do modules", "import chain"]),
    ("class_interaction", ["class interact", "between classes", "cross-class"]),
    ("entry_call_chain", ["entry point", "main entry", "call chain from entry", "bootstrapping"]),
    ("system_overview", ["overview", "architecture", "system", "components connected", "how are components"]),
]
# Property names that a query over the graph may use.
KNOWN_PROPERTIES = [
    "name", "path", "functions", "classes", "imports", "repo_id", "qualified_name", "class_name", "bases", "module", "alias", "line",
    "line_start", "line_end", "is_entry", "entry_kind", "entry_confidence",
]
FUNCTION_NAMES = ["path", "type", "keys", "labels", "id", "properties"]
# Words in an error that mean the language-model provider failed.
PROVIDER_FAILURES = [
    "insufficient_quota", "rate_limit", "exceeded", "capacity", "429", "503", "api key", "authentication", "unauthorized", "deactivated", "billing", "credit", "expired", "token",
    "server error",
]
# Messages to users, by the cause of an error.
USER_MESSAGES = {
    "memory": "This repository is very large and ran out of memory while indexing. Try a smaller repo.",
    "download": "We couldn't download that repository. Please double-check the URL.",
    "graph": "Couldn't save the code map. Check that your database connection is set up.",
    "vectors": "Couldn't save the search index. Check that your search storage is set up.",
    "provider": "The AI assistant isn't configured yet. Check your API key.",
    "second": "The AI assistant (fallback) encountered an error. Check your Groq API key.",
    "other": "Something went wrong while setting up your repository. Please try again.",
}


# ------------------------------------------------------------------------------------------------ addresses
def normalize_url(url: Column) -> Column:
    """Trimmed, with a scheme, without slashes at the end; an empty address stays empty."""
    t = F.trim(url)
    schemed = F.when(t.startswith("http://") | t.startswith("https://") | t.startswith("git@"), t).otherwise(F.concat(F.lit("https://"), t))
    return F.when(t == "", t).otherwise(F.regexp_replace(schemed, "/+$", ""))


def _path_parts(url: Column) -> Column:
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*", ""), r"[?#].*$", ""), r"\.git$", "")
    return F.filter(F.split(path, "/"), lambda p: p != "")


def repo_id(url: Column) -> Column:
    """``user-project`` from an address's first two path parts; null with fewer."""
    parts = _path_parts(url)
    return F.when(F.size(parts) >= 2, F.concat_ws("-", F.get(parts, F.lit(0)), F.get(parts, F.lit(1))))


def repo_short_name(url: Column) -> Column:
    """The last two path parts, joined by a slash."""
    parts = _path_parts(url)
    return F.when(F.size(parts) >= 2, F.concat_ws("/", F.element_at(parts, -2), F.element_at(parts, -1))).when(F.size(parts) == 1, F.get(parts, F.lit(0))).otherwise(F.lit(""))


# ------------------------------------------------------------------------------------------------ questions
def match_template(question: Column, compat: bool = True) -> Column:
    """(template, args) of the first pattern that a question matches.

    With compat the question is lower-cased, so captured names are too; else names keep their case.
    """
    q = F.lower(question) if compat else question
    flag = "" if compat else "(?i)"
    out = F.lit(None)
    for name, pattern, args in reversed(TEMPLATE_PATTERNS):
        got = F.concat_ws(",", *(F.regexp_extract(q, flag + pattern, i + 1) for i in range(len(args)))) if args else F.lit("")
        out = F.when(q.rlike(flag + pattern), F.struct(F.lit(name).alias("template"), got.alias("args"))).otherwise(out)
    return out


def architect_subtype(question: Column) -> Column:
    q = F.lower(question)
    out = F.lit("system_overview")
    for name, keywords in reversed(SUBTYPE_KEYWORDS):
        some = F.lit(False)
        for k in keywords:
            some = some | q.contains(k)
        out = F.when(some, F.lit(name)).otherwise(out)
    return out


def unknown_properties(query: Column) -> Column:
    """Property names of a query that the graph doesn't have; strings in the query are ignored."""
    bare = F.regexp_replace(query, r"'[^']*'|\"[^\"]*\"", "''")
    used = F.array_distinct(F.regexp_extract_all(bare, F.lit(r"\b\w+\.(\w+)\b"), F.lit(1)))
    return F.array_sort(F.array_except(used, F.array(*(F.lit(p) for p in KNOWN_PROPERTIES + FUNCTION_NAMES))))


def is_provider_failure(message: Column, kind: Column | None = None) -> Column:
    texts = [F.lower(c) for c in (message, kind) if c is not None]
    out = F.lit(False)
    for k in PROVIDER_FAILURES:
        for t in texts:
            out = out | t.contains(k)
    return out


def friendly_error(message: Column) -> Column:
    m = F.lower(message)
    has = lambda *ws: [m.contains(w) for w in ws]
    any_of = lambda cs: cs[0] if len(cs) == 1 else cs[0] | any_of(cs[1:])
    cause = (
        F.when(any_of(has("allocate memory", "onnxruntime")), "memory").when(m.contains("git") & any_of(has("clone", "failed", "not found")), "download").when(m.contains("neo4j"), "graph")
        .when(m.contains("qdrant"), "vectors").when(any_of(has("openai", "api key", "authentication")), "provider").when(m.contains("groq"), "second").otherwise("other")
    )
    table = F.create_map(*(F.lit(x) for kv in USER_MESSAGES.items() for x in kv))
    return table[cause]


def fixed(x: Column, places: int) -> Column:
    """x with so many decimals (1 to 7), the nearest to its binary value, ties to even, as C's printf has it; ``format_string``
    rounds the shortest decimal half up instead."""
    scale = 10**places
    size = F.abs(x)
    whole = F.floor(size)
    part = size - whole
    scaled = part * float(scale)
    high = part * 134217729.0 - (part * 134217729.0 - part)  # 26 bits of part, so that both products below are exact
    lost = (high * float(scale) - scaled) + (part - high) * float(scale)
    below = F.floor(scaled)
    half = scaled - below - 0.5
    up = (half > 0) | (half == 0) & ((lost > 0) | (lost == 0) & (below % 2 == 1))
    last = below + up.cast("long")
    shown = F.concat((whole + F.floor(last / scale)).cast("string"), F.lit("."), F.lpad((last % scale).cast("string"), places, "0"))
    signed = F.concat(F.when(x.cast("string").startswith("-"), "-").otherwise(""), shown)
    return F.when(size < float(1 << 62), signed).otherwise(F.format_string(f"%.{places}f", x))


def compact_number(n: Column) -> Column:
    """1234 as 1.2K."""
    return F.when(n >= 1000, F.concat(fixed(n / 1000, 1), F.lit("K"))).otherwise(n.cast("string"))


def result_confidence(question: Column, n_rows: Column) -> Column:
    """How far a result answers: 0.3 for a lone row to an indirect question, else 0.5 for one row, else rows / 5 up to 1."""
    q = F.lower(question)
    indirect = q.contains("indirectly") | q.contains("transitive") | q.contains("through")
    return F.when(n_rows == 0, F.lit(None)).when((n_rows == 1) & indirect, 0.3).when(n_rows > 1, F.least(F.lit(1.0), n_rows / 5)).otherwise(0.5)


# ------------------------------------------------------------------------------------------------ Python functions
def token_sort_ratio(a: str, b: str) -> float:
    """0 to 100: the similarity of two names with their words lower-cased and sorted."""
    x, y = (" ".join(sorted(s.lower().split())) for s in (a or "", b or ""))
    return 100.0 * difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() if x or y else 100.0


@F.pandas_udf(T.DoubleType())
def token_sort_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_sort_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.StringType())
def name_uuid(name: pd.Series) -> pd.Series:
    """The version 5 identifier of a name in the DNS space."""
    return name.map(lambda n: str(uuid.uuid5(uuid.NAMESPACE_DNS, n)))
