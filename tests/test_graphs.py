"""Graph operators against plain Python on random graphs."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from coppice.operators import graph


def random_edges(seed: int, nodes: int, count: int):
    rng = random.Random(seed)
    return sorted({(f"n{a:03}", f"n{b:03}") for a, b in ((rng.randrange(nodes), rng.randrange(nodes)) for _ in range(count)) if a != b})


def frame(spark, edges, repo="r"):
    return spark.createDataFrame([(repo, "head", a, b) for a, b in edges], "repo string, snapshot string, src string, dst string")


def walk(edges, start):
    out = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    seen, order, queue = {start: 0}, [], deque([start])
    while queue:
        node = queue.popleft()
        for nxt in sorted(out.get(node, [])):
            if nxt not in seen:
                seen[nxt] = seen[node] + 1
                order.append(nxt)
                queue.append(nxt)
    return order, seen


def components(edges):
    nodes = {n for e in edges for n in e}
    reach = {n: set(walk(edges, n)[0]) | {n} for n in nodes}
    groups = {}
    for n in nodes:
        same = {m for m in reach[n] if n in reach[m]}
        if len(same) > 1:
            groups[n] = min(same)
    return groups


@pytest.mark.parametrize("seed,nodes,count", [(1, 40, 60), (2, 60, 70)])
def test_components_and_witnesses(spark, seed, nodes, count):
    edges = random_edges(seed, nodes, count)
    df = frame(spark, edges)
    found = graph.components(df)
    want = components(edges)
    assert {r["node"]: r["component"] for r in found.collect()} == want
    rows = graph.witness_cycles(df, found).orderBy("component", "pos").collect()
    cycles = {}
    for r in rows:
        cycles.setdefault(r["component"], []).append(r["path"])
    assert set(cycles) == set(want.values())
    for name, cycle in cycles.items():
        assert cycle[0] == cycle[-1] == name and len(set(cycle[:-1])) == len(cycle) - 1
        assert all(step in set(edges) for step in zip(cycle, cycle[1:]))


def test_long_ring_and_long_tail(spark):
    n = 600
    ring = [(f"a{i:05}", f"a{(i + 1) % n:05}") for i in range(n)]
    tail = [("a00007", "t00000")] + [(f"t{i:05}", f"t{i + 1:05}") for i in range(n)]
    found = graph.components(frame(spark, ring + tail))
    assert found.count() == n
    assert [r["component"] for r in found.select("component").distinct().collect()] == ["a00000"]


def test_impact_in_walk_order(spark):
    edges = random_edges(5, 40, 90)
    df = frame(spark, edges)
    roots = df.select("repo", "snapshot", F.col("src").alias("path")).distinct()
    got = {}
    for r in graph.impact_in_order(df, roots).orderBy("root", "pos").collect():
        got.setdefault(r["root"], []).append((r["node"], r["dist"]))
    for root in {a for a, _ in edges}:
        order, dist = walk(edges, root)
        assert got.get(root, []) == [(n, dist[n]) for n in order]
    closed = {(r["root"], r["node"]) for r in graph.impact(df, roots).collect()}
    assert closed == {(root, n) for root in {a for a, _ in edges} for n in walk(edges, root)[0]}


def test_no_cycles(spark):
    assert graph.components(frame(spark, [("a", "b"), ("b", "c"), ("a", "c")])).count() == 0


def test_two_repos_do_not_mix(spark):
    both = frame(spark, [("a", "b"), ("b", "a")], "x").unionByName(frame(spark, [("a", "b")], "y"))
    assert sorted((r["repo"], r["node"]) for r in graph.components(both).collect()) == [("x", "a"), ("x", "b")]


def test_impact_counts(spark):
    edges = random_edges(8, 60, 75)
    df = frame(spark, edges).unionByName(frame(spark, [("x", "y"), ("y", "x"), ("x", "x")], "other"))
    got = {(r["repo"], r["path"]): (r["direct"], r["files"]) for r in graph.impact_counts(df).collect()}
    want = {("r", n): (sum(a == n for a, _ in edges), len(set(walk(edges, n)[0]) - {n})) for n in {x for e in edges for x in e}}
    assert got == want | {("other", "x"): (1, 1), ("other", "y"): (1, 1)}


def test_impact_pairs(spark):
    """Trees of more than 64 files, cycles and a second tree: all pairs, not their number."""
    edges = random_edges(9, 100, 130)
    df = frame(spark, edges).unionByName(frame(spark, [("x", "y"), ("y", "x"), ("x", "x")], "other"))
    rows = [tuple(r) for r in graph.impact_pairs(df).select("repo", "root", "node").collect()]
    nodes = {x for e in edges for x in e}
    assert len(nodes) > 64
    want = {("r", n, m) for n in nodes for m in set(walk(edges, n)[0]) - {n}} | {("other", "x", "y"), ("other", "y", "x")}
    assert len(rows) == len(want) and set(rows) == want


def test_every_file_lists_its_impact(spark):
    """The query's SQL asks for pairs, and its columns are theirs."""
    from coppice.plans import QUERIES

    assert "SELECT repo, root, node FROM pairs" in QUERIES["impact_of_every_file"].sql


def test_long_way_round(spark):
    """The route of a ring is laid out by doubling; distances go on over several written rounds."""
    ring = [(f"a{i:05}", f"a{(i + 1) % 11:05}") for i in range(11)]
    df = frame(spark, [*ring, ("t", "a00003")])
    members = spark.createDataFrame([("r", "head", a, "a00000") for a, _ in ring], "repo string, snapshot string, node string, component string")
    rows = graph.witness_cycles(df, members).orderBy("pos").collect()
    assert [r["path"] for r in rows] == [f"a{i % 11:05}" for i in range(12)]
    seeds = df.where("src = 't'").select("repo", "snapshot", F.col("src").alias("node"))
    got = {r["node"]: r["dist"] for r in graph.reachable(df, seeds).collect()}
    assert got == {f"a{(3 + k) % 11:05}": k + 1 for k in range(11)}


def test_steps_hold_links_and_every_node(spark):
    """A hop joins its state once: with the links, and with a row of every node to itself."""
    links = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "node long")
    got = {tuple(r) for r in graph._steps(links, nodes).select("node", "to", "own").collect()}
    assert got == {(1, 2, False), (1, 3, False), (1, 1, True), (2, 2, True), (3, 3, True)}


def test_files_with_one_number_are_numbered_anew(spark, monkeypatch):
    """Numbers are hashes: should two files share one, all get others."""
    whole, tried = graph._number, []

    def number(seed, file):
        tried.append(seed)
        return F.pmod(whole(seed, file), F.lit(3)) if seed == 0 else whole(seed, file)

    monkeypatch.setattr(graph, "_number", number)
    edges = random_edges(9, 12, 30)
    df = frame(spark, [*edges, (None, "n000"), ("n000", None)]).unionByName(frame(spark, [("n000", "n001")], None))
    nodes, links = graph._coded(df.unionByName(df))
    name = {r["id"]: r["node"] for r in nodes.collect()}
    assert len(name) == nodes.count() and max(tried) == 1
    assert sorted((name[a], name[b]) for a, b in links.collect()) == edges


def test_trees_at_rest_are_put_aside(spark):
    """A loop goes on with the trees in which something moved, and gives the rows of all."""
    state = spark.createDataFrame([(1, 1, True), (2, 1, False), (3, 2, False)], "node long, tree long, moved boolean")
    settled = graph._Settled(spark, "settled")
    going = settled.going(state)
    assert sorted(r["node"] for r in going.collect()) == [1, 2]
    assert settled.going(going.withColumn("moved", F.lit(False))) is None
    assert sorted(r["node"] for r in settled.all(state).collect()) == [1, 2, 3]


def test_components_of_trees_that_settle_apart(spark):
    """A long ring with shortcuts goes on for rounds after a short cycle beside it is found; ways in and out go at once."""
    ring = [(f"a{i:02}", f"a{(i + 1) % 40:02}") for i in range(40)] + [(f"a{i:02}", f"a{(i - 1) % 40:02}") for i in range(1, 20)]
    ways = [("w1", "w2"), ("w2", "w1"), ("w0", "w1"), ("w2", "w3"), ("w3", "w4"), ("w3", "w5"), ("w9", "w0"), ("w8", "w0")]
    df = frame(spark, ring).unionByName(frame(spark, ways, "short"))
    got = {(r["repo"], r["node"]): r["component"] for r in graph.components(df).collect()}
    assert got == {("r", a): "a00" for a, _ in ring} | {("short", "w1"): "w1", ("short", "w2"): "w1"}
