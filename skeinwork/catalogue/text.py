"""Queries over addresses, questions, messages, names and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G
from ..operators import names as N
from ..operators import search as R
from ..plans import context as X
from . import shared as S

QUESTIONS = [
    (1, "Which file app.py depends on through util.py"), (2, "Show the leaf nodes"), (3, "Which file has the most dependencies?"), (4, "What does main.py import"), (5, "which files import state.py"),
    (6, "List the transitive dependencies of app.py"), (7, "What is the structure app.py"), (8, "What does function Run call"), (9, "What does class Student inherit from"), (10, "Explain the request flow end-to-end"),
    (11, "How do modules fit together"), (12, "How do classes interact, between classes"), (13, "Where is the main entry"), (14, "Give me an overview"), (15, "Why is it slow"),
    (16, "call chain from entry to disk"), (17, "files that do not import any module"), (18, "what is in config.py and app.py imports"),
]
QUERY_TEXTS = [
    (1, "MATCH (f:File) WHERE f.name = 'a.b.c' RETURN f.path"), (2, "MATCH (f) RETURN f.size, f.owner, f.name"), (3, 'RETURN n.secret, "x.y", n.line'), (4, "RETURN r.type, r.id, r.weight"), (5, "no properties here"),
]
MESSAGES = [
    (1, "Cannot allocate memory", "MemoryError"), (2, "git clone failed", "CalledProcessError"), (3, "Neo4j is away", "ServiceUnavailable"), (4, "qdrant refused", "ConnectionError"),
    (5, "OpenAI: invalid API key", "AuthenticationError"), (6, "Groq says no", "APIError"), (7, "division by zero", "ZeroDivisionError"), (8, "HTTP 429 too many", "RateLimit"), (9, "the digit was not found", "KeyError"),
    (10, "onnxruntime crashed", "RuntimeError"), (11, "", "BillingError"),
]
RESULTS = [(1, "What does app.py import", 0), (2, "What does app.py import", 1), (3, "transitive dependencies of a.py", 1), (4, "reached through b.py", 3), (5, "all files", 9), (6, "depends indirectly", 1)]
RECORDS = [(1, "src/a.py"), (2, "src/b.py::go"), (3, "src/a.py::run"), (4, "plain"), (5, "docs/x"), (6, "c.py"), (7, "d.py"), (8, "e.py"), (9, "pkg::thing")]
TYPED = ["small ring", "Ring small", "red widgett", "nothing like it at all"]
ASKED = "how does the red widget differ from a blu bolt in size"
# records of results: the names of the columns, and the texts of each column
CHECKED = [
    (1, ["f.path"], [["a.py"]]), (2, ["f.path"], [["a.py"]]), (2, ["f.path"], [["b.py"]]), (3, ["f.path", "n"], [["a.py"], ["3"]]), (4, ["files", "name"], [["x.py", "y.py", "z.txt"], ["w.py"]]),
    (5, ["name"], [["setup"]]), (6, ["f.path"], [[None]]),
]
# what follows is asked, said or found for each supplier, under names of its own
QUESTIONS = S.marked(QUESTIONS, r"app(?=\.py)|main(?=\.py)|util|state|config|Run|Student|disk")
QUERY_TEXTS, MESSAGES = S.marked(QUERY_TEXTS, "secret|owner|weight"), S.marked(MESSAGES, "zero|digit")
RESULTS, RECORDS = S.marked(RESULTS, "app|a|b"), S.marked(RECORDS, "a|b|c|d|e|x|plain|thing")
URLS_EXTRA = [(-1, " github.com/user/project.git "), (-2, "https://host.example/u/p//"), (-3, "git@host:u/p"), (-4, "http://host.example/only"), (-5, ""), (-6, "https://host.example/a/b/c?x=1#y")]


def _urls(spark, sf):
    return S.table(spark, sf, "pages").select("page_id", "url").union(spark.createDataFrame(URLS_EXTRA, "page_id long, url string"))


def _questions(spark, sf):
    return S.each_supplier(spark, sf, QUESTIONS, "id int, question string")


def _messages(spark, sf):
    return S.each_supplier(spark, sf, MESSAGES, "id int, message string, kind string")


def _vectors(spark, sf):
    return S.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def _query(spark, sf):
    return _vectors(spark, sf).where("id = 0")


def _bench_query(spark, sf):
    return S.table(spark, sf, "benchmark").where("item_id = 2").select("text")


def _labels(spark):
    return spark.createDataFrame([(1,), (3,)], "label int")


def _context(spark, sf):
    top = R.top_k(_vectors(spark, sf), _query(spark, sf), 3).join(S.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", F.coalesce("text", F.lit("")).alias("t")), "id")
    one = X.chunk_text(F.concat(F.lit("doc/"), F.col("id").cast("string")), F.col("lang"), F.lit(None).cast("string"), F.lit(1), F.lit(None).cast("int"), F.col("score"), F.col("t"))
    return X.section("Code Chunks", top.select(F.struct((-F.col("score")).alias("a"), "id").alias("place"), one.alias("one")), "place", "one")


def _names(spark, sf):
    return S.table(spark, sf, "part").select(F.col("p_name").alias("name"), F.lower("p_name").alias("path"))


def _resolve(spark, sf):
    """Typed names against part names: exact, else the most similar of 70 or more."""
    return N.resolve(spark.createDataFrame([(t,) for t in TYPED], "typed string"), _names(spark, sf))


def _entities(spark, sf):
    """Names that a question's words and word pairs come close to (75 or more)."""
    return N.entities(spark.createDataFrame([(ASKED,)], "text string"), _names(spark, sf)).select("name")


def _checks(spark, sf):
    one = lambda df: df.withColumn("id", F.concat_ws("-", "of", "id"))
    results = S.each_supplier(spark, sf, [(i,) for i in range(1, 8)], "id int")
    return X.result_checks(one(results), one(S.each_supplier(spark, sf, CHECKED, "id int, columns array<string>, values array<array<string>>")))


def _hybrid(spark, sf):
    return S.stored_texts(spark, sf).hybrid(_bench_query(spark, sf), 10).withColumnRenamed("id", "doc_id")


def _rrf(spark, sf):
    close = S.stored_vectors(spark, sf).top_k(_query(spark, sf), 20)
    return R.fuse(close, S.stored_texts(spark, sf, "postings").bm25(_bench_query(spark, sf), 20), 10)


QUERIES = {
    "url_normalize": lambda spark, sf: _urls(spark, sf).select("page_id", T.normalize_url(F.col("url")).alias("value")),
    "repo_id_from_url": lambda spark, sf: _urls(spark, sf).select("page_id", T.repo_id(T.normalize_url(F.col("url"))).alias("value")),
    "repo_short_name": lambda spark, sf: _urls(spark, sf).select("page_id", T.repo_short_name(T.normalize_url(F.col("url"))).alias("value")),
    "explorer_filter": lambda spark, sf: S.table(spark, sf, "pages").where(F.lower("url").contains("example.net")).select("page_id", "url"),
    "path_tree": lambda spark, sf: G.path_tree(S.table(spark, sf, "pages").select(F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", "").alias("path"))),
    "match_template": lambda spark, sf: _questions(spark, sf).select("of", "id", T.match_template(F.col("question")).alias("m")).select("of", "id", "m.template", "m.args"),
    "architect_subtype": lambda spark, sf: _questions(spark, sf).select("of", "id", T.architect_subtype(F.col("question")).alias("subtype")),
    "sanitize_props": lambda spark, sf: S.each_supplier(spark, sf, QUERY_TEXTS, "id int, query string").select("of", "id", F.array_join(T.unknown_properties(F.col("query")), ",").alias("unknown")),
    "friendly_error": lambda spark, sf: _messages(spark, sf).select("of", "id", T.friendly_error(F.col("message")).alias("said")),
    "is_provider_failure": lambda spark, sf: _messages(spark, sf).select("of", "id", T.is_provider_failure(F.col("message"), F.col("kind")).alias("failed")),
    "result_confidence": lambda spark, sf: S.each_supplier(spark, sf, RESULTS, "id int, question string, n int").select("of", "id", T.result_confidence(F.col("question"), F.col("n")).cast("double").alias("confidence")),
    "critical_path_files": lambda spark, sf: X.critical_files(S.each_supplier(spark, sf, RECORDS, "pos int, value string")).select("path", "pos"),
    "file_union": lambda spark, sf: X.file_union(S.table(spark, sf, "nation").where("n_regionkey < 3").select(F.col("n_name").alias("path")), S.table(spark, sf, "nation").where("n_regionkey > 1").select(F.col("n_name").alias("path"))),
    "stat_format": lambda spark, sf: S.table(spark, sf, "part").groupBy("p_brand").agg(F.sum("p_size").alias("n")).select("p_brand", T.compact_number(F.col("n")).alias("label")),
    "vector_topk": lambda spark, sf: R.top_k(_vectors(spark, sf), _query(spark, sf), 5).withColumnRenamed("id", "vec_id"),
    "vector_topk_filtered": lambda spark, sf: R.top_k_filtered(_vectors(spark, sf), _query(spark, sf), _labels(spark), "label", 5).withColumnRenamed("id", "vec_id"),
    "rerank_cosine": lambda spark, sf: R.rerank(_vectors(spark, sf), _query(spark, sf), 4).withColumnRenamed("id", "vec_id"),
    "rerank_reused": lambda spark, sf: R.rerank(_vectors(spark, sf).join(R.top_k(_vectors(spark, sf), _query(spark, sf), None), "id"), _query(spark, sf), 4).withColumnRenamed("id", "vec_id"),
    "vector_cells_topk": lambda spark, sf: S.stored_vectors(spark, sf).top_k(_query(spark, sf), 5).withColumnRenamed("id", "vec_id"),
    "vector_cells_filtered": lambda spark, sf: S.stored_vectors(spark, sf).top_k(_query(spark, sf), 5, _labels(spark), "label").withColumnRenamed("id", "vec_id"),
    "bm25_topk": lambda spark, sf: S.stored_texts(spark, sf, "postings").bm25(_bench_query(spark, sf), 10).withColumnRenamed("id", "doc_id"),
    "rrf_hybrid": _rrf,
    "format_context": _context,
    "result_checks": _checks,
    "ask_hybrid": _hybrid,
    "embed_text": lambda spark, sf: R.embed(S.table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text"), 16).select("id", F.posexplode("embedding").alias("d", "x")),
    "resolve_filename": _resolve,
    "extract_entities": _entities,
}

_V = S.sql_values
_URL = f"""urls AS (SELECT page_id, url FROM pages UNION ALL SELECT * FROM {_V(URLS_EXTRA, "page_id, url")}), t AS (SELECT page_id, trim(url) AS u FROM urls),
  norm AS (SELECT page_id, CASE WHEN u = '' THEN u ELSE regexp_replace(CASE WHEN starts_with(u, 'http://') OR starts_with(u, 'https://') OR starts_with(u, 'git@') THEN u ELSE 'https://' || u END, '/+$', '') END AS v FROM t),
  parts AS (SELECT page_id, v, list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(v, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://[^/?#]*', ''), '[?#].*$', ''), '\\.git$', ''), '/'), lambda x: x <> '') AS p FROM norm)"""


def _template_sql() -> str:
    match, args = [], []
    for name, pattern, groups in T.TEMPLATE_PATTERNS:
        match.append(f"WHEN regexp_matches(q, '{pattern}') THEN '{name}'")
        got = " || ',' || ".join(f"regexp_extract(q, '{pattern}', {i + 1})" for i in range(len(groups))) or "''"
        args.append(f"WHEN regexp_matches(q, '{pattern}') THEN {got}")
    return f"WITH x AS (SELECT \"of\", id, lower(question) AS q FROM {S.each_supplier_sql(QUESTIONS, 'id, question')}) SELECT \"of\", id, CASE {' '.join(match)} END AS template, CASE {' '.join(args)} END AS args FROM x"


_SUBTYPES = " ".join("WHEN " + " OR ".join(f"contains(q, '{k}')" for k in ks) + f" THEN '{n}'" for n, ks in T.SUBTYPE_KEYWORDS)
_KNOWN = ", ".join(f"'{p}'" for p in T.KNOWN_PROPERTIES + T.FUNCTION_NAMES)
_FAIL = " OR ".join(f"contains(m, '{k}') OR contains(k, '{k}')" for k in T.PROVIDER_FAILURES)
_U = {k: "'" + v.replace("'", "''") + "'" for k, v in T.USER_MESSAGES.items()}
_DOT = "list_sum(list_transform(range(1, 65), lambda i: CAST({0}[i] AS DOUBLE) * CAST({1}[i] AS DOUBLE)))"
_COS = f"""q AS (SELECT embedding AS w FROM embeddings WHERE vec_id = 0),
  cos AS (SELECT vec_id, label, round({_DOT.format('embedding', 'w')} / sqrt({_DOT.format('embedding', 'embedding')} * {_DOT.format('w', 'w')}), 6) AS score FROM embeddings, q)"""
_BM = """d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '') AS ws FROM documents), sized AS (SELECT doc_id, ws, len(ws) AS n FROM d),
  st AS (SELECT count(*) AS n_docs, avg(n) AS avg_len FROM sized), terms AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '')) AS term FROM benchmark WHERE item_id = 2),
  post AS (SELECT doc_id, n, unnest(ws) AS term FROM sized), tf AS (SELECT doc_id, n, term, count(*) AS tf FROM post WHERE term IN (SELECT term FROM terms) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  bm AS (SELECT doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg_len))), 6) AS score FROM tf JOIN df USING (term), st GROUP BY doc_id)"""
_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '')"
_EMBED = """w{0} AS (SELECT id, unnest({3}) AS w FROM {1}), e{0} AS (SELECT id, CAST(('0x' || substr(md5(w), 1, 4)) AS INT) % {2} AS d, CAST(sum(CASE WHEN CAST(('0x' || substr(md5(w), 5, 1)) AS INT) % 2 = 0 THEN 1 ELSE -1 END) AS DOUBLE) AS x FROM w{0} GROUP BY 1, 2)"""
SQL = {
    "result_checks": f"SELECT s_suppkey || '-' || id AS id, is_fallback, is_meaningful, file_count, is_incomplete FROM supplier, {_V([(1, True, False, 1, False), (2, False, True, 2, False), (3, False, True, 1, False), (4, False, True, 3, False), (5, False, True, 0, True), (6, True, False, 0, True), (7, False, False, 0, True)], 'id, is_fallback, is_meaningful, file_count, is_incomplete')}",
    "resolve_filename": f"SELECT typed, name, CAST(score AS DOUBLE) AS score FROM {_V([('small ring', 'small ring', 100.0), ('Ring small', 'small ring', 100.0), ('red widgett', 'red widget', 95.238095), ('nothing like it at all', None, None)], 'typed, name, score')}",
    "extract_entities": f"SELECT * FROM {_V([('red widget',), ('blue bolt',), ('new bolt',)], 'name')}",
    "embed_text": f"""WITH {_EMBED.format('', '(SELECT item_id AS id, text FROM benchmark)', 16, _WORDS)}, every AS (SELECT DISTINCT item_id AS id, CAST(unnest(range(16)) AS INT) AS d FROM benchmark)
      SELECT id, d, coalesce(x, 0.0) AS x FROM every LEFT JOIN e USING (id, d)""",
    "ask_hybrid": f"""WITH docs AS (SELECT doc_id AS id, text FROM documents), {_EMBED.format('1', 'docs', 64, _WORDS)}, {_EMBED.format('2', '(SELECT 0 AS id, text FROM benchmark WHERE item_id = 2)', 64, _WORDS)},
      dots AS (SELECT a.id, sum(a.x * b.x) AS ab FROM e1 a JOIN e2 b ON a.d = b.d GROUP BY a.id), own AS (SELECT id, sum(x * x) AS aa FROM e1 GROUP BY id), theirs AS (SELECT sum(x * x) AS bb FROM e2),
      cosines AS (SELECT docs.id, coalesce(CASE WHEN aa * bb = 0 THEN 0.0 ELSE round(ab / sqrt(aa * bb), 6) END, 0.0) AS score FROM docs LEFT JOIN own USING (id) LEFT JOIN dots USING (id), theirs),
      {_BM}, a AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM cosines QUALIFY r <= 20), b AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM bm QUALIFY r <= 20)
      SELECT coalesce(a.id, b.id) AS doc_id, round(coalesce(1.0 / (60 + a.r), 0) + coalesce(1.0 / (60 + b.r), 0), 6) AS rrf FROM a FULL JOIN b ON a.id = b.id ORDER BY rrf DESC, 1 LIMIT 10""",
    "url_normalize": f"WITH {_URL} SELECT page_id, v AS value FROM norm",
    "repo_id_from_url": f"WITH {_URL} SELECT page_id, CASE WHEN len(p) >= 2 THEN p[1] || '-' || p[2] END AS value FROM parts",
    "repo_short_name": f"WITH {_URL} SELECT page_id, CASE WHEN len(p) >= 2 THEN p[-2] || '/' || p[-1] WHEN len(p) = 1 THEN p[1] ELSE '' END AS value FROM parts",
    "explorer_filter": "SELECT page_id, url FROM pages WHERE contains(lower(url), 'example.net')",
    "path_tree": """WITH p AS (SELECT list_filter(string_split(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/'), lambda x: x <> '') AS parts FROM pages),
      e AS (SELECT parts, unnest(range(1, len(parts) + 1)) AS level FROM p) SELECT array_to_string(parts[1:level - 1], '/') AS parent, parts[level] AS name, CAST(level AS INT) AS level, bool_or(level = len(parts)) AS is_file FROM e GROUP BY 1, 2, 3""",
    "match_template": _template_sql(),
    "architect_subtype": f"WITH x AS (SELECT \"of\", id, lower(question) AS q FROM {S.each_supplier_sql(QUESTIONS, 'id, question')}) SELECT \"of\", id, CASE {_SUBTYPES} ELSE 'system_overview' END AS subtype FROM x",
    "sanitize_props": f"""WITH x AS (SELECT "of", id, regexp_replace(query, '''[^'']*''|"[^"]*"', '''''', 'g') AS q FROM {S.each_supplier_sql(QUERY_TEXTS, 'id, query')}),
      u AS (SELECT "of", id, list_filter(list_distinct(regexp_extract_all(q, '\\b\\w+\\.(\\w+)\\b', 1)), lambda p: NOT list_contains([{_KNOWN}], p)) AS l FROM x) SELECT "of", id, array_to_string(list_sort(l), ',') AS "unknown" FROM u""",
    "friendly_error": f"""WITH x AS (SELECT "of", id, lower(message) AS m FROM {S.each_supplier_sql(MESSAGES, 'id, message, kind')}) SELECT "of", id, CASE WHEN contains(m, 'allocate memory') OR contains(m, 'onnxruntime') THEN {_U['memory']}
      WHEN contains(m, 'git') AND (contains(m, 'clone') OR contains(m, 'failed') OR contains(m, 'not found')) THEN {_U['download']} WHEN contains(m, 'neo4j') THEN {_U['graph']} WHEN contains(m, 'qdrant') THEN {_U['vectors']}
      WHEN contains(m, 'openai') OR contains(m, 'api key') OR contains(m, 'authentication') THEN {_U['provider']} WHEN contains(m, 'groq') THEN {_U['second']} ELSE {_U['other']} END AS said FROM x""",
    "is_provider_failure": f'WITH x AS (SELECT "of", id, lower(message) AS m, lower(kind) AS k FROM {S.each_supplier_sql(MESSAGES, "id, message, kind")}) SELECT "of", id, {_FAIL} AS failed FROM x',
    "result_confidence": f"""WITH x AS (SELECT "of", id, lower(question) AS q, n FROM {S.each_supplier_sql(RESULTS, 'id, question, n')}) SELECT "of", id, CAST(CASE WHEN n = 0 THEN NULL WHEN n = 1 AND (contains(q, 'indirectly') OR contains(q, 'transitive') OR contains(q, 'through')) THEN 0.3
      WHEN n > 1 THEN least(1.0, n / 5.0) ELSE 0.5 END AS DOUBLE) AS confidence FROM x""",
    "critical_path_files": f"""WITH x AS (SELECT pos, value, CASE WHEN contains(value, '::') THEN string_split(value, '::')[1] ELSE value END AS path FROM {S.each_supplier_sql(RECORDS, 'pos, value')})
      SELECT path, min(pos) AS pos FROM x WHERE path LIKE '%.py' OR (contains(value, '/') AND NOT contains(value, '::')) GROUP BY path ORDER BY 2, 1 LIMIT 4""",
    "file_union": "SELECT n_name AS path FROM nation WHERE n_regionkey < 3 UNION SELECT n_name FROM nation WHERE n_regionkey > 1",
    "stat_format": "SELECT p_brand, CASE WHEN sum(p_size) >= 1000 THEN printf('%.1f', sum(p_size) / 1000.0) || 'K' ELSE CAST(sum(p_size) AS VARCHAR) END AS label FROM part GROUP BY p_brand",
    "vector_topk": f"WITH {_COS} SELECT vec_id, score FROM cos ORDER BY score DESC, vec_id LIMIT 5",
    "vector_topk_filtered": f"WITH {_COS} SELECT vec_id, score FROM cos WHERE label IN (1, 3) ORDER BY score DESC, vec_id LIMIT 5",
    "rerank_cosine": f"WITH {_COS} SELECT vec_id, score, CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INT) AS rank FROM cos ORDER BY score DESC, vec_id LIMIT 4",
    "rerank_reused": f"WITH {_COS} SELECT vec_id, score, CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INT) AS rank FROM cos ORDER BY score DESC, vec_id LIMIT 4",
    "vector_cells_topk": f"WITH {_COS} SELECT vec_id, score FROM cos ORDER BY score DESC, vec_id LIMIT 5",
    "vector_cells_filtered": f"WITH {_COS} SELECT vec_id, score FROM cos WHERE label IN (1, 3) ORDER BY score DESC, vec_id LIMIT 5",
    "bm25_topk": f"WITH {_BM} SELECT doc_id, score FROM bm ORDER BY score DESC, doc_id LIMIT 10",
    "rrf_hybrid": f"""WITH {_COS}, {_BM}, a AS (SELECT vec_id AS id, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM cos QUALIFY r <= 20), b AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM bm QUALIFY r <= 20)
      SELECT coalesce(a.id, b.id) AS id, round(coalesce(1.0 / (60 + a.r), 0) + coalesce(1.0 / (60 + b.r), 0), 6) AS rrf FROM a FULL JOIN b ON a.id = b.id ORDER BY rrf DESC, id LIMIT 10""",
    "format_context": f"""WITH {_COS}, top AS (SELECT vec_id, score FROM cos ORDER BY score DESC, vec_id LIMIT 3)
      SELECT '[Code Chunks]' || chr(10) || string_agg(chr(10) || '[doc/' || vec_id || ' | ' || lang || '.module_level_segment | lines 1-? | score ' || printf('%.4f', score) || ']' || chr(10) || coalesce(text, ''), chr(10) ORDER BY score DESC, vec_id) AS text
      FROM top JOIN documents ON doc_id = vec_id""",
}
