"""Operators on small hand-computed frames."""

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import citations, context, dedup, library, search, topics


def test_citations_with_context(spark):
    text = "First.\n\nAs Éluard et al. (1924) wrote, and (Dupont & Martin, 1950b) too; Braudel, 1949 as well.\n\nAgain (Dupont & Martin, 1950b)."
    rows = citations.extract(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).collect()
    got = {(r.author, r.year): r.paragraph for r in rows}
    assert got == {("Éluard", "1924"): 1, ("Dupont & Martin", "1950b"): 1, ("Braudel", "1949"): 1}
    assert all(r.context.startswith("As Éluard") for r in rows)


def test_citation_keys_and_counts(spark):
    text = "---\ntitle: x\n---\n# Head\nSee [@a2020; @b:1, p. 3] and mail me@x.org. A note[^1] and [^2].\n\n```\n@code\n```\n\n[^1]: Text."
    df = spark.createDataFrame([("d", text)], "id string, text string")
    assert df.select(citations.citation_keys(F.col("text"))).first()[0][:2] == ["a2020", "b:1"]
    r = citations.document_counts(df, "id").first()
    assert r.notes == 2 and r.paragraphs == 1 and r.words == 13


def test_selection_and_ranking(spark):
    df = spark.createDataFrame([("1-3, 5", 4), ("all", 3), ("7, 2-1", 9), ("", 2)], "t string, n int")
    assert [r[0] for r in df.select(context.selected(F.col("t"), F.col("n"))).collect()] == [[1, 2, 3], [1, 2, 3], [7], []]
    replies = spark.createDataFrame([("[3, 1, 3, 12]", 4)], "t string, n int")
    assert replies.select(context.ranking(F.col("t"), F.col("n"))).first()[0] == [3, 1]


def test_reranking_keeps_what_is_not_named(spark):
    hits = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3), ("r", "d", 1)], "query_id string, id string, rank int")
    got = {r.id: (r.reranked, r.score) for r in context.reranked(hits, spark.createDataFrame([("q", "3")], "query_id string, text string")).collect()}
    assert got == {"c": (1, 1.0), "a": (2, pytest.approx(0.666667)), "b": (3, pytest.approx(0.333333)), "d": (1, None)}


def test_expansion_keeps_the_query_first(spark):
    got = context.expanded(spark.createDataFrame([(1, "le Constructivisme."), (2, "rien")], "query_id long, text string")).orderBy("query_id", "variant").collect()
    assert [(r.query_id, r.text) for r in got] == [(1, "le Constructivisme."), (1, "le constructivism."), (1, "le constructivist."), (2, "rien")]


def hits(spark, contents):
    rows = [("q", "which harbour", str(i), 1, i, c, 1.0 - i / 100) for i, c in enumerate(contents)]
    return spark.createDataFrame(rows, "query_id string, query string, id string, document long, place long, content string, similarity double")


@pytest.mark.parametrize("size, strategy", [(8_000, "none-small"), (20_000, "light-deduplication"), (30_000, "medium-dedup-extraction"), (60_000, "aggressive-full")])
def test_compression_levels(spark, size, strategy):
    sentence = "The harbour of town {} was built of grey stone in those long years of trade. Nothing else of note is told about that place in any of the books. "
    contents, k = [], 0
    while sum(map(len, contents)) < size:
        contents.append("".join(sentence.format(f"{k}x{i} y{k * 31 + i} z{k * 17 + i} w{k * 13 + i}") for i in range(6)))
        k += 1
    contents[1:1] = [contents[0]]
    got = context.compressed(hits(spark, contents)).orderBy("place").collect()
    assert {r.strategy for r in got} == {strategy}
    assert ("1" in {r.id for r in got}) == (strategy == "none-small")  # the copy of the first goes at every other level
    if strategy == "aggressive-full":
        assert any("[…]" in r.content for r in got) and sum(len(r.content) for r in got) < 45_000


def test_attachments_match_key_or_title(spark):
    own = spark.createDataFrame([("k1", "One"), ("k2", "Two"), ("k3", None)], "key string, title string")
    items = spark.createDataFrame([(5, "k1", "x"), (3, "y", "ONE"), (4, "z", "two"), (1, "w", None)], "item_id int, item_key string, title string")
    assert {r.key: r.item_id for r in library.with_attachments(own, items).collect()} == {"k1": 3, "k2": 4, "k3": None}


def test_allowed_lists(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "doc_id long"), spark.createDataFrame([(2,), (3,)], "doc_id long")
    assert library.allowed(None, None) is None
    assert [r[0] for r in library.allowed(a, b).collect()] == [2]
    assert library.allowed(a.limit(0), None).collect() == []


def test_near_copies_are_removed_greedily(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    chunks = [(1, 0, " ".join(words)), (1, 1, " ".join(words)), (1, 2, " ".join(words[:5])), (2, 0, " ".join(words))]
    kept = dedup.without_near_copies(spark.createDataFrame(chunks, "doc_id long, chunk_index long, content string")).collect()
    assert sorted((r.doc_id, r.chunk_index) for r in kept) == [(1, 0), (1, 2), (2, 0)]


def test_quota_and_fallback(spark):
    rows = [("q", str(i), 0.9 - i / 10, "manuscript" if i > 3 else "pdf") for i in range(6)]
    df = spark.createDataFrame(rows, "query_id string, id string, similarity double, source_type string")
    got = search.with_quota(df, 4).orderBy("rank").collect()
    assert [r.id for r in got] == ["0", "1", "2", "4"]
    assert [r.id for r in search.above_or_top(df, 0.95).orderBy("rank").collect()] == ["0", "1", "2"]
    assert search.with_quota(df, 0).collect() == []


def test_topics_are_deterministic(spark):
    rows = [(i, [1.0, 0.0] if i % 3 else [0.0, 1.0]) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, embedding array<double>")
    a, b = (sorted(map(tuple, topics.assign(df, 2).collect())) for _ in range(2))
    assert a == b and {t for k, t in a if k % 3} == {0} and {t for k, t in a if k % 3 == 0} == {1}
    assert [topics.topic_count(n) for n in (10, 50, 200, 1000)] == [3, 5, 20, 50]


def test_attachments_of_one_title_meet_no_citation_all_against_all(spark):
    own = spark.range(600).selectExpr("cast(id as string) as key", "'Same' as title")
    items = spark.range(500).selectExpr("int(id + 7) as item_id", "'x' as item_key", "'same' as title")
    found = library.with_attachments(own, items)
    assert {r.item_id for r in found.collect()} == {7} and found.count() == 600

    def rows_of(plan):
        joins = [plan] if "Join" in plan.nodeName() else []
        below = [plan.executedPlan()] if plan.nodeName() == "AdaptiveSparkPlan" else [plan.plan()] if "QueryStage" in plan.nodeName() else [plan.children().apply(i) for i in range(plan.children().size())]
        return [p.metrics().apply("numOutputRows").value() for p in joins] + [n for p in below for n in rows_of(p)]

    found.collect()
    plan = found._jdf.queryExecution().executedPlan()
    found._jdf.collectToPython()
    assert max(rows_of(plan)) <= 600
