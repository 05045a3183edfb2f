"""Queries over property graphs: the import graph of suppliers, the call graph of orders, and node exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from . import shared as S

_REC = lambda base, extra, depth: f"""trails AS (
  SELECT start{extra}, e.dst AS node, [CAST(start AS VARCHAR), CAST(e.dst AS VARCHAR)] AS chain, [CAST(e.edge_id AS VARCHAR)] AS used, 1 AS depth FROM {base} JOIN edges e ON e.src = start
  UNION ALL SELECT t.start{"".join(f", t.{x.strip()}" for x in extra.split(",") if x.strip())}, e.dst, list_append(t.chain, CAST(e.dst AS VARCHAR)), list_append(t.used, CAST(e.edge_id AS VARCHAR)), t.depth + 1
  FROM trails t JOIN edges e ON e.src = t.node WHERE t.depth < {depth} AND NOT list_contains(t.used, CAST(e.edge_id AS VARCHAR)))"""  # noqa: E731
_ID = "edges AS (SELECT src, dst, src || '>' || dst AS edge_id FROM imports)"


def _of_source(f):
    """f with the smallest node that has edges, in a frame of one row."""

    def run(spark, sf):
        e = S.all_imports(spark, sf)
        return f(e, e.agg(F.min("src")))

    return run


def _hot_target(spark, sf):
    e = S.all_imports(spark, sf)
    return G.reverse(e, e.groupBy("dst").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dst").limit(1).select("dst"))


def _two_hops(spark, sf):
    """The first edge between different nodes that goes on."""
    e = S.all_imports(spark, sf)
    first = e.where("src <> dst").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").agg(F.min(F.struct("src", "dst")).alias("x"))
    return G.multi_hop(e, first.select("x.src"), first.select("x.dst"))


def _nodes(spark, sf):
    return G.export_nodes({
        "File": S.table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")),
        "Class": S.table(spark, sf, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.lit(None).cast("string").alias("name"), F.col("r_name").alias("path")),
        "Function": S.table(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id")),
    })


def _edges(spark, sf):
    i = S.all_imports(spark, sf).select("src", "dst", F.lit("IMPORTS").alias("type"))
    c = S.calls(spark, sf).select("src", "dst", F.lit("CALLS").alias("type"))
    o = S.externals(spark, sf).select(F.col("node").alias("src"), F.lit(-1).cast("long").alias("dst"), F.lit("CALLS_EXTERNAL").alias("type"))
    nodes = S.files(spark, sf).select(F.col("node").alias("id"))
    return G.export_edges(i.union(c).union(o), nodes, ["IMPORTS", "CALLS"])


def _split(spark, sf):
    o = S.table(spark, sf, "orders").select(F.col("o_orderstatus").alias("path"), F.col("o_orderpriority").alias("class_name"), F.col("o_orderkey").alias("function"))
    known = o.where("class_name not in ('1-URGENT', '5-LOW')").select("path", F.col("class_name").alias("name")).distinct()
    return G.containment_split(o, known)


def _annotated(spark, sf):
    from ..operators.resolve import annotate_entries

    return annotate_entries(S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("node")), S.entries(spark, sf))


def _call_graph(spark, sf):
    """Calls of every function of one short name: the homonyms share an order priority."""
    m = S.methods(spark, sf).where("class = '1-URGENT'")
    return S.calls(spark, sf).join(m, F.col("src") == F.col("method"), "left_semi").select(F.col("dst").alias("called"))


def _file_index(spark, sf):
    b = S.brands(spark, sf)
    methods = b["classes"].select("path", F.concat("name", F.lit(".run")).alias("name"))
    return G.file_index(b["files"], b["classes"], b["functions"], methods)


def _both(spark, sf):
    """Two templates' results in one frame, their rows as JSON."""
    b = S.brands(spark, sf)
    structure, most = G.file_structure(b["classes"], b["functions"]), G.most_dependencies(S.all_imports(spark, sf))
    return G.as_records({"file_structure": structure, "most_dependencies": most}).select("template", "record")


QUERIES = {
    "tree_paths": lambda spark, sf: S.table(spark, sf, "nation").select(F.col("n_name").alias("path")).orderBy("path"),
    "all_files": lambda spark, sf: S.table(spark, sf, "nation").join(S.table(spark, sf, "region").where("r_name is not null"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi").select(F.col("n_name").alias("path")).orderBy("path"),
    "direct_imports": _of_source(G.direct),
    "reverse_lookup": _hot_target,
    "multi_hop_imports": _two_hops,
    "leaf_nodes": lambda spark, sf: G.leaf_nodes(S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("node")), S.calls(spark, sf)),
    "most_dependencies": lambda spark, sf: G.most_dependencies(S.imports(spark, sf)),
    "transitive_dependencies": _of_source(G.reachable),
    "dependency_map": lambda spark, sf: G.dependency_map(G.simple(S.imports(spark, sf)), S.files(spark, sf)),
    "entry_call_chain": lambda spark, sf: G.entry_chains(S.calls(spark, sf), S.entries(spark, sf)),
    "request_flow": lambda spark, sf: G.request_flows(S.calls(spark, sf), S.entries(spark, sf), S.externals(spark, sf), ["http_endpoint", "app_runner"]),
    "most_dependencies_all": lambda spark, sf: G.most_dependencies(S.all_imports(spark, sf)),
    "degree_stats_all": lambda spark, sf: G.degrees(S.files(spark, sf), S.all_imports(spark, sf)),
    "graph_counts_all": lambda spark, sf: G.counts(S.files(spark, sf), S.all_imports(spark, sf)),
    "dependency_map_all": lambda spark, sf: G.dependency_map(G.simple(S.all_imports(spark, sf)), S.files(spark, sf)),
    "import_levels": lambda spark, sf: G.longest_levels(S.files(spark, sf), S.imports(spark, sf)),
    "graph_levels_all": lambda spark, sf: G.longest_levels(S.files(spark, sf), S.all_imports(spark, sf)),
    "node_neighbors": lambda spark, sf: G.neighbours(S.all_imports(spark, sf), S.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_name").alias("name"))),
    "degree_stats": lambda spark, sf: G.degrees(S.files(spark, sf), S.imports(spark, sf)),
    "graph_roots": lambda spark, sf: G.roots(S.files(spark, sf), S.all_imports(spark, sf)),
    "graph_levels": lambda spark, sf: G.levels(S.files(spark, sf), G.simple(S.imports(spark, sf)), 4),
    "graph_counts": lambda spark, sf: G.counts(S.files(spark, sf), S.imports(spark, sf)),
    "graph_data_nodes": _nodes,
    "graph_data_edges": _edges,
    "call_graph": _call_graph,
    "class_hierarchy": lambda spark, sf: S.table(spark, sf, "nation").where("n_name like 'N%1' or n_nationkey = 7").join(S.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("class"), F.col("r_name").alias("parent")),
    "class_interaction": lambda spark, sf: G.class_interaction(S.methods(spark, sf), S.calls(spark, sf)),
    "containment_split": _split,
    "entry_annotation": _annotated,
    "file_structure": lambda spark, sf: (lambda b: G.file_structure(b["classes"], b["functions"]))(S.brands(spark, sf)),
    "system_overview": lambda spark, sf: (lambda b: G.system_overview(b["files"], b["classes"], b["functions"], b["entries"]))(S.brands(spark, sf)),
    "file_index": _file_index,
    "node_type_stats": lambda spark, sf: _nodes(spark, sf).groupBy("node_type").agg(F.count("*").alias("n")),
    "node_complexity": lambda spark, sf: (lambda b: b["files"].join(b["classes"].union(b["functions"]).groupBy("path").agg(F.count("*").alias("n")), "path", "left").select("path", F.coalesce("n", F.lit(0)).alias("size")))(S.brands(spark, sf)),
    "node_badges": lambda spark, sf: G.badges(S.brands(spark, sf)["classes"]),
    "template_union": _both,
    "delete_counts": lambda spark, sf: S.all_imports(spark, sf).groupBy((F.col("src") % 5).alias("repo")).agg(F.countDistinct("src").alias("nodes"), F.count("*").alias("edges")),
    "dir_groups": lambda spark, sf: G.groups(S.table(spark, sf, "nation").select(F.col("n_regionkey").alias("group"), F.col("n_name").alias("value")), 2),
}

_I, _A, _C, _B = S.IMPORTS_SQL, S.ALL_IMPORTS_SQL, S.CALLS_SQL, S.BRANDS_SQL
_MIN = "(SELECT min(src) FROM imports)"
_NODES = """nodes AS (SELECT CAST(n_nationkey AS VARCHAR) AS id, 'File' AS node_type, n_name AS label FROM nation
  UNION ALL SELECT 'r' || r_regionkey, 'Class', r_name FROM region UNION ALL SELECT 's' || s_suppkey, 'Function', 's' || s_suppkey FROM supplier)"""
_AGG = "array_to_string(list_sort(list(DISTINCT {0})), ',')"
SQL = {
    "tree_paths": "SELECT n_name AS path FROM nation ORDER BY path",
    "all_files": "SELECT n_name AS path FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region) ORDER BY path",
    "direct_imports": f"WITH {_A} SELECT dst AS node FROM imports WHERE src = {_MIN}",
    "reverse_lookup": f"WITH {_A} SELECT src AS node FROM imports WHERE dst = (SELECT dst FROM imports GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1)",
    "multi_hop_imports": f"WITH {_A}, via AS (SELECT dst AS v FROM imports WHERE src <> dst AND dst IN (SELECT src FROM imports) ORDER BY src, dst LIMIT 1) SELECT DISTINCT b.dst AS node FROM imports b, via WHERE b.src = v",
    "leaf_nodes": f"WITH {_C} SELECT o_orderkey AS node FROM ordered WHERE nxt IS NULL",
    "most_dependencies": f"WITH {_I} SELECT src AS node, count(DISTINCT dst) AS n FROM imports GROUP BY src ORDER BY n DESC, node LIMIT 5",
    "transitive_dependencies": f"""WITH {_A}, h1 AS (SELECT dst AS node FROM imports WHERE src = {_MIN}), h2 AS (SELECT DISTINCT dst AS node FROM imports JOIN h1 ON src = node),
      h3 AS (SELECT DISTINCT dst AS node FROM imports JOIN h2 ON src = node) SELECT DISTINCT node FROM (SELECT * FROM h1 UNION SELECT * FROM h2 UNION SELECT * FROM h3) WHERE node <> {_MIN}""",
    "dependency_map": f"WITH RECURSIVE {_I}, {_ID}, {_REC('(SELECT node AS start FROM files)', '', 4)} SELECT start, array_to_string(chain, '>') AS chain, depth FROM trails ORDER BY depth DESC, start, chain LIMIT 30",
    "entry_call_chain": f"WITH RECURSIVE {_C}, edges AS (SELECT * FROM calls), {_REC('(SELECT node AS start, kind FROM entries)', ', kind', 6)} SELECT start, kind, array_to_string(chain, '>') AS chain, depth FROM trails ORDER BY depth DESC, start, kind, chain LIMIT 15",
    "request_flow": f"""WITH RECURSIVE {_C}, edges AS (SELECT * FROM calls), {_REC("(SELECT node AS start FROM entries WHERE kind IN ('http_endpoint', 'app_runner'))", '', 6)}
      SELECT start, array_to_string(chain, '>') AS chain, depth FROM trails WHERE node NOT IN (SELECT src FROM calls) OR node IN (SELECT node FROM externals) ORDER BY depth DESC, start, chain LIMIT 10""",
    "node_neighbors": f"""WITH {_A}, both_ways AS (SELECT src AS node, 'out' AS direction, dst AS other FROM imports UNION ALL SELECT dst, 'in', src FROM imports)
      SELECT node, direction, other, s_name AS name FROM both_ways JOIN supplier ON s_suppkey = other""",
    "degree_stats": f"""WITH {_I} SELECT node, (SELECT count(*) FROM imports WHERE dst = node) AS n_in, (SELECT count(*) FROM imports WHERE src = node) AS n_out FROM files""",
    "graph_roots": f"WITH {_A}, d AS (SELECT node, (SELECT count(*) FROM imports WHERE dst = node) AS n FROM files) SELECT node FROM d WHERE n = (SELECT min(n) FROM d)",
    "graph_levels": f"""WITH RECURSIVE {_I}, {_ID}, d AS (SELECT node, (SELECT count(*) FROM imports WHERE dst = node) AS n FROM files), starts AS (SELECT node AS start FROM d WHERE n = (SELECT min(n) FROM d)),
      {_REC('starts', '', 4)} SELECT node, max(depth) AS level FROM (SELECT node, depth FROM trails UNION ALL SELECT start, 0 FROM starts) GROUP BY node""",
    "graph_counts": f"""WITH {_I} SELECT (SELECT count(*) FROM files) AS nodes, (SELECT count(*) FROM imports) AS edges_directed,
      (SELECT CAST(coalesce(sum(CASE WHEN src = dst THEN 1 ELSE 2 END), 0) AS BIGINT) FROM imports) AS edges_undirected""",
    "graph_data_nodes": f"WITH {_NODES} SELECT id, node_type, label FROM nodes",
    "graph_data_edges": f"""WITH {_A}, {_C}, every AS (SELECT src, dst, 'IMPORTS' AS type FROM imports UNION ALL SELECT src, dst, 'CALLS' FROM calls UNION ALL SELECT node, -1, 'CALLS_EXTERNAL' FROM externals)
      SELECT src, dst, type FROM every WHERE type IN ('IMPORTS', 'CALLS') AND src IN (SELECT node FROM files) AND dst IN (SELECT node FROM files)""",
    "call_graph": f"WITH {_C} SELECT dst AS called FROM calls WHERE src IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "class_hierarchy": "SELECT n_name AS class, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name LIKE 'N%1' OR n_nationkey = 7",
    "class_interaction": f"WITH {_C} SELECT a.o_orderpriority AS from_class, src AS via, b.o_orderpriority AS to_class FROM calls JOIN orders a ON src = a.o_orderkey JOIN orders b ON dst = b.o_orderkey WHERE a.o_orderpriority <> b.o_orderpriority",
    "containment_split": "SELECT o_orderstatus AS path, o_orderkey AS function, CASE WHEN o_orderpriority IN ('1-URGENT', '5-LOW') THEN 'DEFINES_FUNCTION' ELSE 'HAS_METHOD' END AS edge FROM orders",
    "entry_annotation": f"WITH {_C}, m AS (SELECT node, kind FROM entries WHERE kind NOT IN ('main_block', 'app_runner')) SELECT o_orderkey AS node, kind IS NOT NULL AS is_entry, kind AS entry_kind FROM orders LEFT JOIN m ON o_orderkey = node",
    "file_structure": f"WITH {_B}, c AS (SELECT path, {_AGG.format('name')} AS classes FROM classes GROUP BY path), f AS (SELECT path, {_AGG.format('name')} AS functions FROM functions GROUP BY path) SELECT path, classes, functions FROM c JOIN f USING (path)",
    "system_overview": f"""WITH {_B}, c AS (SELECT path, {_AGG.format('name')} AS x FROM classes GROUP BY path), f AS (SELECT path, {_AGG.format('name')} AS x FROM functions GROUP BY path),
      k AS (SELECT path, {_AGG.format('kind')} AS x FROM marks GROUP BY path) SELECT a.path, coalesce(c.x, '') AS classes, coalesce(f.x, '') AS functions, coalesce(k.x, '') AS entry_kinds
      FROM allfiles a LEFT JOIN c ON c.path = a.path LEFT JOIN f ON f.path = a.path LEFT JOIN k ON k.path = a.path""",
    "file_index": f"""WITH {_B}, c AS (SELECT path, {_AGG.format('name')} AS x, {_AGG.format("name || '.run'")} AS m FROM classes GROUP BY path), f AS (SELECT path, {_AGG.format('name')} AS x FROM functions GROUP BY path)
      SELECT a.path, coalesce(c.x, '') AS classes, concat_ws(',', f.x, c.m) AS functions FROM allfiles a LEFT JOIN c ON c.path = a.path LEFT JOIN f ON f.path = a.path""",
    "node_type_stats": f"WITH {_NODES} SELECT node_type, count(*) AS n FROM nodes GROUP BY node_type",
    "node_complexity": f"WITH {_B}, x AS (SELECT path, name FROM classes UNION ALL SELECT path, name FROM functions) SELECT path, (SELECT count(*) FROM x WHERE x.path = a.path) AS size FROM allfiles a",
    "node_badges": f"""WITH {_B}, c AS (SELECT path, list_sort(list(DISTINCT name)) AS l FROM classes GROUP BY path)
      SELECT path, array_to_string(l[1:2], ',') AS shown, CAST(greatest(len(l) - 2, 0) AS INT) AS more FROM c""",
    "template_union": f"""WITH {_B}, {_A}, c AS (SELECT path, {_AGG.format('name')} AS classes FROM classes GROUP BY path), f AS (SELECT path, {_AGG.format('name')} AS functions FROM functions GROUP BY path),
      m AS (SELECT src AS node, count(DISTINCT dst) AS n FROM imports GROUP BY src ORDER BY n DESC, node LIMIT 5)
      SELECT 'file_structure' AS template, '{{"path":' || path || ',"classes":"' || classes || '","functions":"' || functions || '"}}' AS record FROM c JOIN f USING (path)
      UNION ALL SELECT 'most_dependencies', '{{"node":' || node || ',"n":' || n || '}}' FROM m""",
    "delete_counts": f"WITH {_A} SELECT src % 5 AS repo, count(DISTINCT src) AS nodes, count(*) AS edges FROM imports GROUP BY 1",
    "dir_groups": "SELECT n_regionkey AS \"group\", min(n_name) AS lowest, max(n_name) AS highest, count(*) AS n FROM nation GROUP BY n_regionkey HAVING count(*) >= 2",
}
_LEVELS = """reach AS (SELECT src AS a, dst AS b FROM imports WHERE src <> dst UNION SELECT a, dst FROM reach JOIN imports ON b = src),
  owner AS (SELECT node, least(node, coalesce(min(r.b), node)) AS c FROM (SELECT node FROM files UNION SELECT src FROM imports UNION SELECT dst FROM imports)
    LEFT JOIN (SELECT x.a, x.b FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a) r ON r.a = node GROUP BY node),
  links AS (SELECT DISTINCT s.c AS src, d.c AS dst FROM imports JOIN owner s ON s.node = src JOIN owner d ON d.node = dst WHERE s.c <> d.c),
  far AS (SELECT c, 0 AS level FROM owner WHERE c NOT IN (SELECT dst FROM links) UNION SELECT dst, level + 1 FROM far JOIN links ON c = src)
  SELECT node, CAST(max(level) AS INT) AS level FROM files JOIN owner USING (node) JOIN far USING (c) GROUP BY node"""
SQL["import_levels"] = f"WITH RECURSIVE {_I}, {_LEVELS}"
SQL["graph_levels_all"] = f"WITH RECURSIVE {S.ALL_IMPORTS_SQL}, {_LEVELS}"
# every trail of the first start through its first four targets, in the order of the chains, which lead to more than are wanted
SQL["dependency_map_all"] = f"""WITH {S.ALL_IMPORTS_SQL}, {_ID}, h1 AS (SELECT src AS start, dst AS node, src || '>' || dst AS chain, [edge_id] AS used FROM edges WHERE src = (SELECT min(src) FROM edges) ORDER BY src || '>' || dst || '>' LIMIT 4),
  {", ".join(f"h{k + 1} AS (SELECT start, dst AS node, chain || '>' || dst AS chain, list_append(used, edge_id) AS used FROM h{k} JOIN edges ON src = node AND NOT list_contains(used, edge_id))" for k in (1, 2, 3))}
  SELECT start, chain, CAST(4 AS INT) AS depth FROM h4 ORDER BY start, chain LIMIT 30"""
SQL |= {f"{name}_all": SQL[name].replace(_I, S.ALL_IMPORTS_SQL) for name in ("most_dependencies", "degree_stats", "graph_counts")}
SQL["degree_stats_all"] = f"""WITH {S.ALL_IMPORTS_SQL}, i AS (SELECT dst AS node, count(*) AS n FROM imports GROUP BY dst), o AS (SELECT src AS node, count(*) AS n FROM imports GROUP BY src)
  SELECT node, coalesce(i.n, 0) AS n_in, coalesce(o.n, 0) AS n_out FROM files LEFT JOIN i USING (node) LEFT JOIN o USING (node)"""
