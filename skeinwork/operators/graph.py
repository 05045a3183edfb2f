"""Bounded path queries and aggregations over a property graph given as DataFrames.

Edges are (src, dst), with an ``edge_id`` where parallel edges matter.  Every result with an order or a limit breaks ties
by the whole row.  Paths are trails: no edge is used twice, nodes may be.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import written

WIDTH = 4  # prefixes that a search of trails keeps at first, for each one wanted
COLLECTED = 5_000  # up to so many, prefixes are kept as local rows
MERGED = 16  # rounds of levels after which their tables are merged


def simple(edges: DataFrame) -> DataFrame:
    """(src, dst, edge_id) without parallel edges."""
    return edges.select("src", "dst").distinct().withColumn("edge_id", F.concat_ws(">", "src", "dst"))


def _at(rows: DataFrame, column: str, node: Column | DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows whose column is the node: a value, or the value in a frame of one row and column."""
    if isinstance(node, DataFrame):
        return rows.join(F.broadcast(node.toDF("wanted")), F.col(column) == F.col("wanted"), how)  # one row
    return rows.where(F.col(column) == node if how == "left_semi" else F.col(column) != node)


def direct(edges: DataFrame, source: Column | DataFrame) -> DataFrame:
    """The targets of source's edges, one row an edge."""
    return _at(edges, "src", source).select(F.col("dst").alias("node"))


def reverse(edges: DataFrame, target: Column | DataFrame) -> DataFrame:
    """The sources of target's edges, one row an edge."""
    return _at(edges, "dst", target).select(F.col("src").alias("node"))


def multi_hop(edges: DataFrame, source: Column | DataFrame, via: Column | DataFrame) -> DataFrame:
    """Distinct nodes that source reaches through via."""
    first = _at(_at(edges, "src", source), "dst", via).select(F.col("dst").alias("mid")).distinct()
    return first.join(edges, F.col("mid") == F.col("src")).select(F.col("dst").alias("node")).distinct()


def leaf_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an outgoing edge; an edge to itself counts as one."""
    return nodes.join(edges.select(F.col("src").alias("node")), "node", "left_anti")


def most_dependencies(edges: DataFrame, n: int = 5) -> DataFrame:
    """The n nodes with most distinct targets."""
    return edges.groupBy(F.col("src").alias("node")).agg(F.countDistinct("dst").alias("n")).orderBy(F.desc("n"), "node").limit(n)


def reachable(edges: DataFrame, source: Column | DataFrame, hops: int = 3) -> DataFrame:
    """Distinct nodes other than source within so many hops: a frontier of distinct nodes grows hop by hop."""
    links = edges.select("src", "dst").distinct()
    frontier = _at(links, "src", source).select(F.col("dst").alias("node")).distinct()
    found = [frontier]
    for _ in range(hops - 1):
        frontier = frontier.join(links, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        found.append(frontier)
    return _at(reduce(DataFrame.union, found).distinct(), "node", source, "left_anti")


def trails(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, node, chain, depth): every trail of 1 to depth edges from the starts (start, with any further columns).

    The joins are unrolled, so adaptive execution plans each hop by its size and no limit on recursion applies.
    """
    hop = edges.select(F.col("src").alias("hop_src"), F.col("dst").alias("hop_dst"), F.col("edge_id").alias("hop_id"))
    extra = [c for c in starts.columns if c != "start"]
    level = starts.select("start", *extra, F.col("start").alias("node"), F.array(F.col("start").cast("string")).alias("chain"), F.array().cast("array<string>").alias("used"), F.lit(0).alias("depth"))
    out = []
    for k in range(1, depth + 1):
        level = (
            level.join(hop, F.col("node") == F.col("hop_src")).where(~F.array_contains("used", F.col("hop_id").cast("string")))
            .select("start", *extra, F.col("hop_dst").alias("node"), F.concat("chain", F.array(F.col("hop_dst").cast("string"))).alias("chain"),
                    F.concat("used", F.array(F.col("hop_id").cast("string"))).alias("used"), F.lit(k).alias("depth"))
        )
        out.append(level.drop("used"))
    return reduce(DataFrame.union, out)


def longest(edges: DataFrame, starts: DataFrame, depth: int, n: int, ends: DataFrame | None = None) -> DataFrame:
    """(start, further columns of starts, chain, depth): the n longest trails of 1 to depth edges from the starts, as text,
    ties by the whole row; with ends (node), of those that end there.  Names don't hold the separator ">".

    A bound on the way on is made from the ends back: the nodes from which an end lies exactly so many edges ahead.  Trails
    of the greatest length are searched first: in each hop only the first prefixes in the order of the result are kept, with
    their ties, and only those whose bound says that they may still get there.  What isn't kept comes after all that is,
    whatever it leads to, so the search is whole once it has n trails or has left nothing out; else it is repeated with more
    prefixes, and then goes on to the next smaller length.  The kept prefixes are few, some times n, whatever the graph is.
    """
    spark, extra = edges.sparkSession, [c for c in starts.columns if c != "start"]
    hop = edges.select(F.col("src").alias("hop_src"), F.col("dst").alias("hop_dst"), F.col("edge_id").cast("string").alias("hop_id"))
    ahead = [None if ends is None else ends.select("node").distinct()]
    for k in range(depth):
        step = hop if ahead[k] is None else hop.join(ahead[k], F.col("hop_dst") == F.col("node"), "left_semi")
        ahead.append(written(step.select(F.col("hop_src").alias("node")).distinct(), "ahead"))
    order = ["start", *extra, "key"]
    first = starts.select("start", *extra, F.col("start").alias("node"), F.col("start").cast("string").alias("chain"), F.array().cast("array<string>").alias("used"))
    found: list[tuple] = []
    for length in range(depth, 0, -1):
        kept, whole, got = WIDTH * n, False, []
        while not whole and len(got) < n - len(found):
            level, whole = _search(first, hop, ahead, length, kept, order)
            got = level.orderBy(*order).limit(n - len(found)).collect()
            kept *= 8
        found += [(*(r[c] for c in ["start", *extra, "chain"]), length) for r in got]
        if len(found) == n:
            break
    types = {f.name: f.dataType.simpleString() for f in first.schema}
    return spark.createDataFrame(found, ", ".join([*(f"`{c}` {types[c]}" for c in ["start", *extra, "chain"]), "depth int"]))


def _search(level: DataFrame, hop: DataFrame, ahead: list, length: int, kept: int, order: list[str]) -> tuple[DataFrame, bool]:
    """The first trails of a length in the order, from the first so many prefixes of each hop, and whether none was left out."""
    whole = True
    for k in range(length + 1):
        if k:
            level = level.join(hop, F.col("node") == F.col("hop_src")).where(~F.array_contains("used", F.col("hop_id"))).select(
                *order[:-1], F.col("hop_dst").alias("node"), F.concat("chain", F.lit(">"), F.col("hop_dst").cast("string")).alias("chain"), F.concat("used", F.array("hop_id")).alias("used")
            )
        if ahead[length - k] is not None:
            level = level.join(ahead[length - k], "node", "left_semi")
        # a prefix compares as the trails that it leads to do, so the separator is part of its key
        level, every = _first(level.withColumn("key", F.concat("chain", F.lit(">")) if k < length else F.col("chain")), kept, order)
        whole = whole and every
    return level, whole


def _first(rows: DataFrame, kept: int, order: list[str]) -> tuple[DataFrame, bool]:
    """The first rows in the order, with all ties of the last one, and whether that is all; few come by the driver."""
    spark, values = rows.sparkSession, lambda r: [r[c] for c in order]
    if kept > COLLECTED:
        last = rows.orderBy(*order).offset(kept - 1).limit(1).collect()
        upto = rows.where(F.struct(*order) <= F.struct(*(F.lit(v) for v in values(last[0])))) if last else rows
        return written(upto, "trails"), not last
    got = rows.orderBy(*order).limit(kept + 1).collect()
    if len(got) > kept:
        last = values(got[kept - 1])
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(order, last)])
        return spark.createDataFrame([r for r in got[:kept] if values(r) != last] + rows.where(same).collect(), rows.schema), False
    return spark.createDataFrame(got, rows.schema), True


def entry_chains(edges: DataFrame, entries: DataFrame, depth: int = 6, n: int = 15) -> DataFrame:
    """Call chains from entry points (node, kind), longest first."""
    return longest(edges, entries.select(F.col("node").alias("start"), F.col("kind")), depth, n)


def request_flows(edges: DataFrame, entries: DataFrame, externals: DataFrame, kinds: list[str], depth: int = 6, n: int = 10) -> DataFrame:
    """Call chains from entries of some kinds to nodes that call nothing, or that call something external."""
    starts = entries.where(F.col("kind").isin(*kinds)).select(F.col("node").alias("start"))
    silent = edges.select(F.col("dst").alias("node")).join(edges.select(F.col("src").alias("node")), "node", "left_anti")
    return longest(edges, starts, depth, n, silent.union(externals.select("node").join(edges.select(F.col("dst").alias("node")), "node", "left_semi")))


def dependency_map(edges: DataFrame, nodes: DataFrame, depth: int = 4, n: int = 30) -> DataFrame:
    return longest(edges, nodes.select(F.col("node").alias("start")), depth, n)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, n_in, n_out) of every node, by edges with both ends known."""
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n_in"))
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_out"))
    return nodes.join(into, "node", "left").join(out, "node", "left").fillna(0, ["n_in", "n_out"])


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with no incoming edge; if all have one, those with fewest."""
    d = degrees(nodes, edges)
    least = d.agg(F.min("n_in").alias("least"))
    return d.join(F.broadcast(least), F.col("n_in") == F.col("least")).select("node")


def levels(nodes: DataFrame, edges: DataFrame, depth: int = 4) -> DataFrame:
    """Each node's longest distance from a root by trails, up to depth; a bound, as cycles have no longest path."""
    start = roots(nodes, edges)
    far = trails(edges, start.select(F.col("node").alias("start")), depth).select("node", "depth").union(start.select("node", F.lit(0)))
    return far.groupBy("node").agg(F.max("depth").alias("level"))


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes that lie on a cycle with another one: component is the smallest of those that reach
    each other.

    Rounds of a few steps, each a join of what has changed: nodes without edges in or out are trimmed; the smallest node that
    reaches a node becomes its colour; of each colour, those that its own node can be reached from are a component.  What is
    left of a colour goes on by itself."""
    left = written(edges.where("src <> dst").select("src", "dst").distinct(), "strong")
    out = left.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    while True:
        left = _trimmed(left)
        if left.isEmpty():
            return out
        colours = _spread(left.select(F.col("src").alias("node"), F.col("src").alias("colour")).distinct(), left)
        at = lambda end: colours.select(F.col("node").alias(end), F.col("colour").alias(f"{end}_colour"))
        inner = written(left.join(at("src"), "src").join(at("dst"), "dst").where("src_colour = dst_colour").select("src", "dst", F.col("src_colour").alias("colour")), "strong")
        frontier = seen = written(colours.where("node = colour"), "strong")
        while not frontier.isEmpty():
            more = frontier.join(inner.select(F.col("dst").alias("node"), F.col("src").alias("before")), "node").select(F.col("before").alias("node"), "colour").distinct()
            frontier = written(more.join(seen, ["node", "colour"], "left_anti"), "strong")
            seen = seen.union(frontier)
        done = written(seen.select("node", F.col("colour").alias("component")), "strong")
        out = out.union(done)
        gone = done.select("node")
        left = written(inner.join(gone, F.col("src") == F.col("node"), "left_anti").join(gone, F.col("dst") == F.col("node"), "left_anti").select("src", "dst"), "strong")


def _trimmed(edges: DataFrame) -> DataFrame:
    """The edges between nodes that have edges both in and out, again and again: all that may lie on a cycle."""
    n = edges.count()
    while n:
        both = edges.select(F.col("src").alias("node")).distinct().join(edges.select(F.col("dst").alias("node")).distinct(), "node")
        edges = written(edges.join(both, F.col("src") == F.col("node"), "left_semi").join(both, F.col("dst") == F.col("node"), "left_semi"), "strong")
        n, before = edges.count(), n
        if n == before:
            break
    return edges


def _spread(colours: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, colour): the smallest colour that reaches each node; a round's joins start at the nodes that changed in the last."""
    colours = changed = written(colours, "colours")
    while not changed.isEmpty():
        sent = changed.join(edges, F.col("node") == F.col("src")).groupBy("dst").agg(F.min("colour").alias("sent")).withColumnRenamed("dst", "to")
        changed = written(colours.join(sent, F.col("node") == F.col("to")).where("sent < colour").select("node", F.col("sent").alias("colour")), "colours")
        colours = written(colours.union(changed).groupBy("node").agg(F.min("colour").alias("colour")), "colours")
    return colours


def longest_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level): the length of the longest way to each node from one that nothing leads to; nodes on a common cycle count
    as one, and an edge to itself doesn't count.

    Cycles are condensed to one node each.  Then rounds of relaxation: a round's nodes are the distinct targets of the last
    round's, and a node's level is the last round that it is in, so no path is listed and a round costs the edges of the
    nodes that changed."""
    on_cycle = written(strong_components(edges), "levels").select(F.col("node").alias("member"), "component")
    group = lambda df, c: df.join(on_cycle, F.col(c) == F.col("member"), "left").withColumn(c, F.coalesce("component", c)).drop("member", "component")
    links = written(group(group(edges.select("src", "dst"), "src"), "dst").where("src <> dst").distinct(), "levels")
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    every = group(nodes.select("node").union(ends).distinct().select(F.col("node").alias("name"), "node"), "node")
    frontier = written(every.select("node").distinct().join(links.select(F.col("dst").alias("node")), "node", "left_anti"), "levels")
    reached, turn = frontier.select("node", F.lit(0).alias("level")), 0
    while not frontier.isEmpty():
        turn += 1
        frontier = written(frontier.join(links, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct(), "levels")
        reached = reached.union(frontier.select("node", F.lit(turn).alias("level")))
        if turn % MERGED == 0:
            reached = written(reached.groupBy("node").agg(F.max("level").alias("level")), "levels")
    named = every.join(reached.groupBy("node").agg(F.max("level").alias("level")), "node").select(F.col("name").alias("node"), "level")
    return nodes.select("node").join(named, "node")


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, edges, and edges as an undirected match counts them: twice but for loops."""
    n = nodes.agg(F.count("*").alias("nodes"))
    e = edges.agg(F.count("*").alias("edges_directed"), F.coalesce(F.sum(F.when(F.col("src") == F.col("dst"), 1).otherwise(2)), F.lit(0)).alias("edges_undirected"))
    return n.join(e)  # one row each


def class_interaction(methods: DataFrame, calls: DataFrame) -> DataFrame:
    """(from_class, via, to_class) for each call between methods of different classes, one row a call."""
    a = methods.select(F.col("class").alias("from_class"), F.col("method").alias("src"))
    b = methods.select(F.col("class").alias("to_class"), F.col("method").alias("dst"))
    return calls.join(a, "src").join(b, "dst").where("from_class <> to_class").select("from_class", F.col("src").alias("via"), "to_class")


def containment_split(functions: DataFrame, classes: DataFrame) -> DataFrame:
    """(path, function, edge): HAS_METHOD where the function's class is known in its file, else DEFINES_FUNCTION."""
    known = classes.select("path", F.col("name").alias("class_name"), F.lit(True).alias("known")).distinct()
    return functions.join(known, ["path", "class_name"], "left").select("path", "function", F.when(F.col("known"), "HAS_METHOD").otherwise("DEFINES_FUNCTION").alias("edge"))


def _set(column: Column) -> Column:
    return F.array_join(F.array_sort(F.collect_set(column)), ",")


def file_structure(classes: DataFrame, functions: DataFrame) -> DataFrame:
    """(path, classes, functions) of files that have both; collected apart and joined, so the two never multiply."""
    return classes.groupBy("path").agg(_set(F.col("name")).alias("classes")).join(functions.groupBy("path").agg(_set(F.col("name")).alias("functions")), "path")


def system_overview(files: DataFrame, classes: DataFrame, functions: DataFrame, entries: DataFrame) -> DataFrame:
    """(path, classes, functions, entry_kinds) of every file; empty text where a file has none."""
    parts = [(classes, "name", "classes"), (functions, "name", "functions"), (entries, "kind", "entry_kinds")]
    out = files.select("path").distinct()
    for df, column, name in parts:
        out = out.join(df.groupBy("path").agg(_set(F.col(column)).alias(name)), "path", "left")
    return out.fillna("", [name for _, _, name in parts])


def file_index(files: DataFrame, classes: DataFrame, functions: DataFrame, methods: DataFrame) -> DataFrame:
    """(path, classes, functions): a file's own functions and then its classes' methods, each distinct."""
    out = files.select("path").distinct()
    for df, name in ((classes, "classes"), (functions, "own"), (methods, "methods")):
        out = out.join(df.groupBy("path").agg(F.array_sort(F.collect_set("name")).alias(name)), "path", "left")
    empty = F.array().cast("array<string>")
    both = F.concat(F.coalesce("own", empty), F.coalesce("methods", empty))
    return out.select("path", F.array_join(F.coalesce("classes", empty), ",").alias("classes"), F.array_join(both, ",").alias("functions"))


def neighbours(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(node, direction, other, name): both sides of every edge, with the other end's name."""
    both = edges.select(F.col("src").alias("node"), F.lit("out").alias("direction"), F.col("dst").alias("other")).union(edges.select("dst", F.lit("in"), "src"))
    return both.join(names.select(F.col("node").alias("other"), "name"), "other").select("node", "direction", "other", "name")


def export_nodes(parts: dict[str, DataFrame]) -> DataFrame:
    """Nodes of several labels in one frame: id, node_type and label (the name, else the path, else the id)."""
    shaped = []
    for label, df in parts.items():
        given = [F.col(c) for c in ("name", "path") if c in df.columns]
        shaped.append(df.select(F.col("id").cast("string").alias("id"), F.lit(label).alias("node_type"), F.coalesce(*given, F.col("id").cast("string")).alias("label")))
    return reduce(DataFrame.unionByName, shaped)


def export_edges(edges: DataFrame, nodes: DataFrame, types: list[str]) -> DataFrame:
    """Edges of some types with both ends among the nodes (id)."""
    known = nodes.select("id").distinct()
    kept = edges.where(F.col("type").isin(*types))
    return kept.join(known, F.col("src") == F.col("id"), "left_semi").join(known, F.col("dst") == F.col("id"), "left_semi").select("src", "dst", "type")


def path_tree(paths: DataFrame) -> DataFrame:
    """(parent, name, level, is_file) of each distinct prefix of the paths (path), split at slashes."""
    parts = paths.select(F.filter(F.split("path", "/"), lambda p: p != "").alias("parts")).where("size(parts) > 0")
    each = parts.select("parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("level"))
    return each.select(
        F.array_join(F.expr("slice(parts, 1, level - 1)"), "/").alias("parent"), F.element_at("parts", F.col("level")).alias("name"), "level", (F.col("level") == F.size("parts")).alias("is_file")
    ).groupBy("parent", "name", "level").agg(F.max("is_file").alias("is_file"))


def groups(members: DataFrame, least: int = 2) -> DataFrame:
    """(group, lowest, highest, n) of groups (group, value) with so many members at least."""
    return members.groupBy("group").agg(F.min("value").alias("lowest"), F.max("value").alias("highest"), F.count("*").alias("n")).where(F.col("n") >= least)


def badges(names: DataFrame, shown: int = 2) -> DataFrame:
    """(path, shown, more): a file's first names, and how many more it has."""
    every = names.groupBy("path").agg(F.array_sort(F.collect_set("name")).alias("names"))
    return every.select("path", F.array_join(F.slice("names", 1, shown), ",").alias("shown"), F.greatest(F.size("names") - shown, F.lit(0)).alias("more"))


def as_records(results: dict[str, DataFrame]) -> DataFrame:
    """(template, record): results of different shape as one bag of JSON rows."""
    return reduce(DataFrame.union, [df.select(F.lit(name).alias("template"), F.to_json(F.struct(*df.columns)).alias("record")) for name, df in results.items()])
