"""Communities by modularity and by labels: against plain versions, planted partitions and known optima."""

import random

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import graph


def frame(spark, edges):
    return spark.createDataFrame([(*e, "k") for e in edges], "a long, b long, weight double, community string")


def plain_modularity(edges, of, weighted=True):
    ends = {}
    for a, b, w in edges:
        for x, y in ((a, b), (b, a)):
            ends[x, y] = ends.get((x, y), 0) + w if weighted else (2 if x == y else 1)
    m = sum(ends.values())
    total = {}
    for (a, _), w in ends.items():
        total[of[a]] = total.get(of[a], 0) + w
    return sum(w for (a, b), w in ends.items() if of[a] == of[b]) / m - sum((t / m) ** 2 for t in total.values())


def parts(rows):
    out = {}
    for r in rows:
        out.setdefault(r.community, set()).add(r.node)
    assert all(min(members) == c for c, members in out.items())
    return {frozenset(p) for p in out.values()}


def planted(groups, size, inside, between, seed):
    rng = random.Random(seed)
    n = groups * size
    return [(a, b, 1.0 + rng.random()) for a in range(n) for b in range(a + 1, n) if rng.random() < (inside if a // size == b // size else between)]


def best_single_move(edges, of, weighted=True):
    """The greatest gain of moving one node to a community next to it."""
    now, near = plain_modularity(edges, of, weighted), {}
    for a, b, _ in edges:
        near.setdefault(a, set()).add(of[b])
        near.setdefault(b, set()).add(of[a])
    return max(plain_modularity(edges, of | {n: c}, weighted) - now for n in near for c in near[n])


CLIQUES = [(a, b, 1.0) for base in (0, 10, 20) for a in range(base, base + 5) for b in range(a + 1, base + 5)]


def test_cliques(spark):
    edges = [*CLIQUES, (4, 10, 0.1), (14, 20, 0.1)]
    want = {frozenset(range(b, b + 5)) for b in (0, 10, 20)}
    assert parts(graph.communities(frame(spark, edges)).collect()) == want
    got = graph.propagated(frame(spark, edges)).collect()
    assert {frozenset(r.node for r in got if r.community == c) for c in {r.community for r in got}} == want


def test_planted_partition_and_modularity(spark, weighted=False):
    edges = planted(5, 14, 0.6, 0.03, 4)
    rows = graph.communities(frame(spark, edges), weighted).collect()
    assert parts(rows) == {frozenset(range(g * 14, g * 14 + 14)) for g in range(5)}
    of = {r.node: r.community for r in rows}
    df = spark.createDataFrame(list(of.items()), "node long, community long")
    value = graph.modularity(frame(spark, edges), df, weighted)
    assert value == pytest.approx(plain_modularity(edges, of, weighted))


def test_a_ring_of_cliques_and_random_graphs(spark):
    """No single move is left that gains, and labels never do better."""
    rng = random.Random(9)
    graphs = [
        [(7 * g + a, 7 * g + b, 1.0) for g in range(8) for a in range(5) for b in range(a + 1, 5)] + [(7 * g, 7 * ((g + 1) % 8) + 1, 1.0) for g in range(8)],
        [(rng.randrange(30), rng.randrange(30), rng.choice([0.5, 1.0, 2.0])) for _ in range(90)],
    ]
    for edges in graphs:
        rows = graph.communities(frame(spark, edges)).collect()
        of = {r.node: r.community for r in rows}
        labels = {r.node: r.community for r in graph.propagated(frame(spark, edges)).collect()}
        assert plain_modularity(edges, of) >= plain_modularity(edges, labels) - 1e-9
        assert plain_modularity(edges, of) > plain_modularity(edges, {n: n for n in of})
    assert sorted(map(tuple, rows)) == sorted(map(tuple, graph.communities(frame(spark, list(reversed(graphs[1])))).collect()))
    first = graph._moved(graph._doubled(frame(spark, graphs[1]), True), 2.0 * sum(w for *_, w in graphs[1]), 0.0)
    assert best_single_move(graphs[1], {r.node: r.community for r in first.collect()}) < 1e-8


def test_a_star_loops_repeats_nulls_and_no_edges(spark):
    star = [(0, k, 1.0) for k in range(1, 9)]
    assert parts(graph.communities(frame(spark, star)).collect()) == {frozenset(range(9))}
    odd = [(1, 2, 1.0), (1, 2, 1.0), (2, 1, 1.0), (3, 3, 5.0), (4, None, 1.0), (5, 6, 0.0)]
    assert parts(graph.communities(frame(spark, odd)).collect()) == {frozenset({1, 2}), frozenset({3})}
    assert graph.communities(frame(spark, [])).collect() == [] and graph.propagated(frame(spark, [])).collect() == []
    assert graph.modularity(frame(spark, []), spark.createDataFrame([], "node long, community long")) == 0.0


def test_edges_are_worked_out_once_and_lie_together(spark):
    edges = frame(spark, [(a, b, 1.0) for a in range(20) for b in range(a)]).filter("a < b + 5").groupBy("a", "b").agg({"weight": "sum"}).withColumnRenamed("sum(weight)", "weight")
    links = graph._doubled(edges, True, 4)
    assert links._jdf.queryExecution().optimizedPlan().toString().count("Filter") <= 2 and "Union" not in links._jdf.queryExecution().optimizedPlan().toString()
    at = links.select("a", F.spark_partition_id().alias("p")).distinct().collect()
    assert len(at) == len({r.a for r in at}) == 20
    assert sorted(map(tuple, links.collect())) == sorted(map(tuple, graph._doubled(edges, True).collect()))
