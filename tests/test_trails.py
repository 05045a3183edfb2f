"""The first of the longest trails, and levels, against listing every trail of random graphs."""

import random

import pytest
from pyspark.sql import functions as F

from skeinwork.operators import graph as G


def drawn(seed, n=9, m=20):
    """Edges (src, dst, edge_id) with parallel ones, two-cycles and loops, over names of which some begin as others do."""
    rng = random.Random(seed)
    names = [str(x) for x in rng.sample([1, 10, 2, 11, 100, 3, 12, 20, 21, 30], n)]
    return names, [(rng.choice(names), rng.choice(names[:-1]), f"e{i}") for i in range(m)]


def every_trail(edges, start, depth, used=(), chain=None):
    chain = chain or [start]
    for s, d, i in edges:
        if s == chain[-1] and i not in used and len(used) < depth:
            yield [*chain, d]
            yield from every_trail(edges, start, depth, (*used, i), [*chain, d])


def first(edges, starts, depth, n, ends=None):
    rows = [(s, k, ">".join(c), len(c) - 1) for s, k in starts for c in every_trail(edges, s, depth) if ends is None or c[-1] in ends]
    return sorted(rows, key=lambda r: (-r[3], *r[:3]))[:n]


@pytest.mark.parametrize("seed, width, collected", [(1, 4, 5000), (2, 1, 5000), (3, 1, 0), (4, 4, 0)])
def test_longest_trails(spark, monkeypatch, seed, width, collected):
    monkeypatch.setattr(G, "WIDTH", width)
    monkeypatch.setattr(G, "COLLECTED", collected)
    names, pairs = drawn(seed)
    edges = spark.createDataFrame(pairs, "src string, dst string, edge_id string")
    starts = [(x, k) for x in names[:6] for k in ("a", "b")[: 1 + int(x) % 2]] + [("nowhere", "c")]
    frame = spark.createDataFrame(starts, "start string, kind string")
    for depth, n in ((3, 7), (2, 30)):
        assert [tuple(r) for r in G.longest(edges, frame, depth, n).collect()] == first(pairs, starts, depth, n)
    ends = set(names[5:])
    got = G.longest(edges, frame, 3, 9, spark.createDataFrame([(x,) for x in ends], "node string"))
    assert [tuple(r) for r in got.collect()] == first(pairs, starts, 3, 9, ends)


def test_fewer_trails_than_wanted(spark):
    edges = spark.createDataFrame([("a", "b", "1"), ("b", "a", "2"), ("b", "c", "3")], "src string, dst string, edge_id string")
    starts = spark.createDataFrame([("a",), ("c",)], "start string")
    assert [tuple(r) for r in G.longest(edges, starts, 5, 10).collect()] == [("a", "a>b>a", 2), ("a", "a>b>c", 2), ("a", "a>b", 1)]
    assert G.longest(edges, starts.limit(0), 5, 10).count() == G.longest(edges.limit(0), starts, 5, 10).count() == 0
    assert G.longest(edges, starts, 5, 10, starts.limit(0).withColumnRenamed("start", "node")).count() == 0


def test_few_prefixes_of_a_dense_graph(spark, monkeypatch):
    kept, bound = [], G._first
    monkeypatch.setattr(G, "_first", lambda rows, k, order: (lambda out: kept.append(out[0].count()) or out)(bound(rows, k, order)))
    n = spark.range(60)
    edges = G.simple(n.select(F.col("id").alias("src")).join(n.select(F.col("id").alias("dst"))))
    got = G.dependency_map(edges, n.select(F.col("id").alias("node")), 4, 30).collect()
    assert len(got) == 30 and got[0].chain == "0>0>10>0>1" and {r.depth for r in got} == {4}  # of 700 million trails; the loop at 0 is used once
    assert max(kept) <= G.WIDTH * 30


def reached(edges):
    out = {}
    for x in {y for e in edges for y in e[:2]}:
        seen, front = set(), {x}
        while front:
            front = {d for s, d, _ in edges if s in front} - seen
            seen |= front
        out[x] = seen
    return out


@pytest.mark.parametrize("seed, n, m", [(5, 9, 9), (6, 10, 14), (7, 10, 11), (8, 10, 24)])
def test_levels(spark, seed, n, m):
    names, pairs = drawn(seed, n, m)
    edges = spark.createDataFrame([e[:2] for e in pairs], "src string, dst string")
    ways = reached(pairs)
    owner = {x: min([x, *(y for y in ways.get(x, ()) if x in ways[y])]) for x in names}
    strong = {x: owner[x] for x in names if sum(owner[y] == owner[x] for y in names) > 1}
    assert {r.node: r.component for r in G.strong_components(edges).collect()} == strong
    links = {(owner[s], owner[d]) for s, d, _ in pairs if owner[s] != owner[d]}
    far = lambda x: max((1 + far(s) for s, d in links if d == x), default=0)
    got = G.longest_levels(spark.createDataFrame([(x,) for x in names], "node string"), edges).collect()
    assert sorted((r.node, r.level) for r in got) == sorted((x, far(owner[x])) for x in names)


def test_levels_without_cycles_equal_those_of_trails(spark):
    rng = random.Random(9)
    pairs = sorted({tuple(sorted(rng.sample(range(14), 2))) for _ in range(18)})
    edges, nodes = spark.createDataFrame(pairs, "src long, dst long"), spark.range(14).withColumnRenamed("id", "node")
    by_trails = {r.node: r.level for r in G.levels(nodes, G.simple(edges), 14).collect()}
    assert {r.node: r.level for r in G.longest_levels(nodes, edges).collect()} == by_trails


def test_levels_of_a_long_chain(spark):
    edges = spark.range(20).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = G.longest_levels(spark.range(22).withColumnRenamed("id", "node"), edges).collect()
    assert {r.node: r.level for r in got} == {i: i for i in range(21)} | {21: 0}
