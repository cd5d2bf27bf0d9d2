"""Graph operators against brute force on small graphs."""

import random

import pytest
from pyspark.sql import functions as F

from chronoloom.operators import graph


def frames(spark, pairs, both=False):
    rows = pairs + [(b, a) for a, b in pairs] if both else pairs
    return spark.createDataFrame(rows, "a string, b string")


def ids(spark, names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def brute_pagerank(nodes, pairs, seeds=None, drop=False, rounds=30):
    n = len(nodes)
    t = {v: (0.99 / len(seeds) if v in seeds else 0.01 / n) if seeds else 1 / n for v in nodes}
    r = dict(t)
    out = {v: sum(a == v for a, _ in pairs) for v in nodes}
    for _ in range(rounds):
        lost = 0 if drop else sum(r[v] for v in nodes if not out[v])
        new = {v: 0.15 * t[v] + 0.85 * (sum(r[a] / out[a] for a, b in pairs if b == v) + lost / n) for v in nodes}
        if sum(abs(new[v] - r[v]) for v in nodes) < 1e-6:
            return new
        r = new
    return r


@pytest.mark.parametrize("seeds,drop", [(None, False), (["a"], False), (None, True)])
def test_pagerank(spark, seeds, drop):
    nodes, pairs = list("abcdef"), [("a", "b"), ("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "f")]
    out = graph.pagerank(frames(spark, [*pairs, ("a", "zz")]), ids(spark, nodes), ids(spark, seeds) if seeds else None, dangling="drop" if drop else "spread", rounds=12)
    got = {r.id: r.score for r in out.collect()}
    want = brute_pagerank(nodes, pairs, seeds, drop, 12)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_pagerank_empty(spark):
    assert graph.pagerank(frames(spark, []), ids(spark, [])).count() == 0


def test_reach_and_paths(spark):
    p = frames(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("a", "c"), ("x", "y"), ("d", None)])
    got = {(r.id, r.depth) for r in graph.reach(p, ids(spark, ["a"]), 5).collect()}
    assert got == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    d = {r.id: r.distance for r in graph.shortest_paths(p, ids(spark, ["a"]), ids(spark, list("abcdxy"))).collect()}
    assert d == {"a": 0, "b": 1, "c": 1, "d": 2, "x": None, "y": None}


def test_betweenness(spark):
    got = {r.id: r.score for r in graph.betweenness(frames(spark, [("a", "b"), ("b", "c")], both=True), ids(spark, list("abc"))).collect()}
    assert got == {"a": 0, "b": 1, "c": 0}
    sq = {r.id: r.score for r in graph.betweenness(frames(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a")], both=True), ids(spark, list("abcd"))).collect()}
    assert all(abs(v - 0.5) < 1e-9 for v in sq.values())


def test_communities_of_two_cliques(spark):
    e = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "xy" for i in range(5) for j in range(i)] + [("x0", "y0", 0.1)]
    g = spark.createDataFrame([(min(a, b), max(a, b), w) for a, b, w in e], "a string, b string, w double")
    rows = graph.communities(g, (1.0,)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.community, set()).add(r.id[0])
    assert len(by) == 2 and all(len(s) == 1 for s in by.values())
    labels = spark.createDataFrame([(r.id, r.community) for r in rows], "id string, community string")
    assert graph.modularity(g, labels).first()[0] > 0.45


def test_cohesion(spark):
    e = spark.createDataFrame([("1", "a", "b", None), ("2", "a", "z", None), ("3", "a", "a", None), ("4", "a", "b", 5)], "id string, from_id string, to_id string, t_valid_until long")
    m = spark.createDataFrame([("c", "a"), ("c", "b"), ("c", "b")], "community_id string, entity_id string")
    r = graph.cohesion(m, e).first()
    assert (r.internal, r.incident) == (2, 3)


def test_processes(spark):
    calls = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.9), ("c", "a", 0.9), ("a", "d", 0.4), ("x", "b", 0.6), ("b", "b", 1.0)], "a string, b string, confidence double")
    got = sorted(r.path for r in graph.trace_processes(calls, ids(spark, ["a", "x"])).collect())
    assert got == [["x", "b", "c", "a"]]
    alone = sorted(r.path for r in graph.trace_processes(calls, ids(spark, ["a"])).collect())
    assert alone == [["a", "b", "c"]]


def test_dirty_stops_at_firewall(spark):
    n = spark.createDataFrame([(i, [f"{i}.ts"], None, None) for i in "abcd"], "id string, file_paths array<string>, t_valid_until long, archived_at long")
    sym = frames(spark, [("a", "b"), ("b", "c"), ("c", "d")], both=True)
    deg = spark.createDataFrame([("b", 99)], "id string, degree long")
    got = {r.id: r.state for r in graph.dirty_nodes(spark.createDataFrame([("a.ts",)], "file string"), n, sym, deg).collect()}
    assert got == {"a": "dirty", "b": "maybe_dirty"}
    got = {r.id: r.state for r in graph.dirty_nodes(spark.createDataFrame([("a.ts",)], "file string"), n, sym, deg, firewall=100).collect()}
    assert got == {"a": "dirty", "b": "dirty", "c": "dirty"}


def test_tree_diff(spark):
    s = "name string, kind string, parent string"
    old = spark.createDataFrame([("f", "function", None), ("g", "function", "A"), ("h", "class", None), ("k", "x", None)], s)
    new = spark.createDataFrame([("f", "function", None), ("g", "function", "B"), ("h", "function", None), ("n", "class", None)], s)
    got = {r.name: r.change for r in graph.tree_diff(old, new).collect()}
    assert got == {"g": "move", "h": "update", "k": "remove", "n": "insert"}


def test_landmark_estimate(spark):
    rnd = random.Random(1)
    pairs = [(f"n{rnd.randrange(20)}", f"n{rnd.randrange(20)}") for _ in range(25)]
    n = spark.createDataFrame([(f"n{i}", i, None, None) for i in range(20)], "id string, access_count long, t_valid_until long, archived_at long")
    marks = graph.landmarks(n, frames(spark, pairs, both=True), k=4)
    est = graph.estimated_distances(marks, ids(spark, [f"n{i}" for i in range(5)])).collect()
    assert all((r.distance == 0) == (r.a == r.b) and r.distance <= 5 for r in est)


def test_entry_points(spark):
    n = spark.createDataFrame([("1", "CodeEntity", "main", ["isExported"], None, None), ("2", "CodeEntity", "handleX", None, None, None), ("3", "CodeEntity", "z", ["Route", "handler"], None, None), ("4", "Bug", "main", [], None, None)], "id string, type string, name string, tags array<string>, t_valid_until long, archived_at long")
    e = spark.createDataFrame([("e", "1", "2", "calls", None)], "id string, from_id string, to_id string, type string, t_valid_until long")
    got = {r.id: round(r.score, 6) for r in graph.entry_point_scores(n, e).collect()}
    assert got == {"1": 0.9, "2": 0.6, "3": 0.5}
    assert graph.entry_point_scores(n.limit(0), e.limit(0)).count() == 0
    assert n.select(F.count("*")).first()[0] == 4
