"""Path queries on random graphs against a brute-force walk, and properties of trails."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skeinwork.operators import graph as G


def drawn(seed, n=13, m=26):
    """A random graph: some parallel edges are dropped, loops stay; the last two nodes have no edge."""
    rng = random.Random(seed)
    names = [f"n{i:02d}" for i in range(n)]
    return names, sorted({(rng.choice(names[:-2]), rng.choice(names[:-2])) for _ in range(m)} | {(names[0], names[1]), (names[1], names[2]), (names[3], names[3])})


@pytest.fixture(scope="module", params=[1, 2])
def graph(spark, request):
    names, edges = drawn(request.param)
    return names, edges, spark.createDataFrame([(x,) for x in names], "node string"), spark.createDataFrame(edges, "src string, dst string")


def values(df, column="node"):
    return sorted(r[column] for r in df.collect())


def walks(edges, start, depth):
    """Every trail of 1 to depth edges from start, as a list of nodes."""

    def go(chain, used):
        for e in edges:
            if e[0] == chain[-1] and e not in used and len(used) < depth:
                yield [*chain, e[1]]
                yield from go([*chain, e[1]], used | {e})

    return list(go([start], frozenset()))


def test_answers(graph):
    names, pairs, nodes, edges = graph
    out = {x: sorted(d for s, d in pairs if s == x) for x in names}
    assert values(G.leaf_nodes(nodes, edges)) == [x for x in names if not out[x]]
    most = sorted(((x, len(ds)) for x, ds in out.items() if ds), key=lambda p: (-p[1], p[0]))[:5]
    assert [(r.node, r.n) for r in G.most_dependencies(edges).collect()] == most
    assert values(G.multi_hop(edges, F.lit("n00"), F.lit("n01"))) == out["n01"] != []
    assert values(G.reverse(edges, F.lit("n02"))) == sorted(s for s, d in pairs if d == "n02")
    near, frontier = set(), {"n00"}
    for _ in range(3):
        frontier = {d for s, d in pairs if s in frontier}
        near |= frontier
    assert values(G.reachable(edges, F.lit("n00"), 3)) == sorted(near - {"n00"})
    expected = Counter(len(w) - 1 for x in names for w in walks(pairs, x, 4))
    by_depth = Counter(r.depth for r in G.trails(G.simple(edges), nodes.select(F.col("node").alias("start")), 4).collect())
    assert by_depth == expected
    one = G.counts(nodes, edges).first()
    assert (one.nodes, one.edges_directed, one.edges_undirected) == (len(names), len(pairs), sum(1 if s == d else 2 for s, d in pairs))


def test_trails_use_no_edge_twice(spark):
    edges = spark.createDataFrame([("a", "b", "1"), ("a", "b", "2"), ("b", "a", "3"), ("b", "c", "4"), ("c", "c", "5")], "src string, dst string, edge_id string")
    got = Counter((r.chain and tuple(r.chain)) for r in G.trails(edges, spark.createDataFrame([("a",)], "start string"), 6).collect())

    def walk(node, used, chain):
        for s, d, i in [("a", "b", 1), ("a", "b", 2), ("b", "a", 3), ("b", "c", 4), ("c", "c", 5)]:
            if s == node and i not in used and len(chain) <= 6:
                yield (*chain, d)
                yield from walk(d, used | {i}, (*chain, d))

    assert got == Counter(walk("a", frozenset(), ("a",)))


def test_empty_graph(spark):
    nodes, edges = spark.createDataFrame([], "node string"), spark.createDataFrame([], "src string, dst string")
    assert G.degrees(nodes, edges).count() == G.roots(nodes, edges).count() == G.levels(nodes, G.simple(edges)).count() == 0
    assert G.counts(nodes, edges).first().edges_undirected == 0
