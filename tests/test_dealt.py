"""Pairs and links are dealt by their number, so that what one task holds doesn't grow with the table."""

import re

from oracle import differences
from scriptorium.operators import bibliography, graph, relations
from scriptorium.plans.catalogue import ORACLES, QUERIES
from scriptorium.sources import tables

SF = "/root/testdata/sf0.001"


def rows(spark):
    return spark.createDataFrame([(g, (g * 7 + i * i) % 23) for g in range(60) for i in range(5)], "g long, i long")


def test_pairs_go_to_more_tasks_than_the_session_has_partitions(spark, monkeypatch):
    monkeypatch.setattr(tables, "TASK_ROWS", 20)
    df = rows(spark)
    pairs = graph.shared_pairs(df, "i", "g")
    assert pairs.rdd.getNumPartitions() > 20
    groups = {}
    for r in df.collect():
        groups.setdefault(r.g, set()).add(r.i)
    want = {}
    for s in groups.values():
        for a in s:
            for b in s:
                if a < b:
                    want[a, b] = want.get((a, b), 0) + 1
    assert {(r.a, r.b): r.weight for r in graph.co_occurrence(df, "i", "g").collect()} == want
    others = {i: {b for s in groups.values() if i in s for b in s} - {i} for s in groups.values() for i in s}
    found = bibliography.author_statistics(df.selectExpr("g", "i", "cast(g % 3 as int) as year"), "g", "i", "year").collect()
    assert {r.i: (r.works, r.coauthors, r.years) for r in found} == {i: (sum(i in s for s in groups.values()), len(o), sorted({g % 3 for g, s in groups.items() if i in s})) for i, o in others.items()}


def test_stored_links_are_dealt_by_their_number(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(tables, "TASK_ROWS", 20)
    links = rows(spark).selectExpr("g as source", "i as first", "i + 1 as second")
    relations.take_in(links, str(tmp_path), "one")
    found = relations.relations(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() > 4
    assert found.groupBy().sum("weight").first()[0] == links.count()


def test_authors_and_works_without_a_name_stay(spark):
    df = spark.createDataFrame([(1, None, 2000), (1, 5, 2000), (None, 5, 2001), (2, 5, None)], "k long, a long, y int")
    found = {r.a: (r.works, r.coauthors, r.years) for r in bibliography.author_statistics(df, "k", "a", "y").collect()}
    assert found == {None: (1, 0, [2000]), 5: (2, 0, [2000, 2001])}


def test_popular_targets_are_dealt_without_a_shuffle_of_pairs(spark, monkeypatch):
    monkeypatch.setattr(graph, "CELL_ROWS", 7)
    links = [(s, t) for s in range(60) for t in ("x", "p3", "p3.md", "nowhere")] + [(None, "x"), (5, None), (3, "x")]
    notes = [(n, f"p{n}.md", "x" if n % 2 else None) for n in range(40)] + [(3, "p9.md", "y"), (None, "p1.md", "x")]
    found = graph.linked_notes(spark.createDataFrame(links, "source long, target string"), spark.createDataFrame(notes, "note_id long, path string, title string"))
    want = {(s, n) for s, t in links for n, p, i in notes if None not in (s, t, n) and s != n and t in (p, p.removesuffix(".md"), i)}
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    # no row is put together with equal ones after the join
    assert not re.match(r"\s*(Aggregate|Distinct|Deduplicate)", found._jdf.queryExecution().optimizedPlan().toString())
    assert not differences(QUERIES["linked_notes"](spark, SF), ORACLES["linked_notes"], SF)
