"""Vector searches against plain loops; no pair of vectors may leave the task that multiplies but those asked for."""

import math

import pytest

from scriptorium.operators import search
from scriptorium.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows():
    made = [(i, i % 3, [math.sin(i * (j + 1)) for j in range(4)]) for i in range(90)]
    return [*made, (90, 0, made[4][2]), (91, 0, made[4][2]), (92, 1, [0.0] * 4), (93, 2, [1.0]), (94, None, made[4][2]), (95, 2, None)]


def cosine(a, b):
    if a is None or b is None or len(a) != len(b):
        return 0.0
    size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return round(sum(x * y for x, y in zip(a, b)) / size, 6) if size else 0.0


def frames(spark, rows):
    df = spark.createDataFrame(rows, "id long, kind int, embedding array<double>").repartition(3)
    return df, df.filter("id % 4 = 0").select(df.id.alias("query_id"), "embedding")


@pytest.mark.parametrize("least", [None, 0.3])
def test_nearest_by_kind(spark, rows, least):
    df, asked = frames(spark, rows)
    got = search.nearest_by_kind(df, asked, 3, least=least, own=False, counted=least is not None, block=7).collect()
    want, counts = set(), {}
    for q, _, a in rows:
        for kind in {k for _, k, _ in rows} if q % 4 == 0 else ():
            hits = sorted((-cosine(a, b), i) for i, k, b in rows if k == kind and i != q and (least is None or cosine(a, b) >= least))
            want |= {(q, kind, i, -s) for s, i in hits[:3]}
            if hits and least is not None:
                counts[q, kind] = len(hits)
    assert {(r.query_id, r.kind, r.id, r.similarity) for r in got if r.id is not None} == want
    assert {(r.query_id, r.kind): r.n for r in got if r.id is None} == counts


def test_above_or_nearest(spark, rows):
    df, asked = frames(spark, rows)
    got = {(r.query_id, r.id, r.similarity, r.rank) for r in search.above_or_nearest(df, asked, 0.97, 2, own=False, block=7).collect()}
    want = set()
    for q, _, a in rows:
        if q % 4 == 0:
            hits = sorted((-cosine(a, b), i) for i, _, b in rows if i != q)
            n = sum(-s >= 0.97 for s, _ in hits) or 2
            want |= {(q, i, -s, place + 1) for place, (s, i) in enumerate(hits[:n])}
    assert got == want


def test_variants(spark, rows):
    df, asked = frames(spark, rows)
    got = {(r.query_id, r.id): r.similarity for r in search.variants(df, asked.selectExpr("query_id div 12 as query_id", "embedding"), block=7).collect()}
    asking = [(q // 12, a) for q, _, a in rows if q % 4 == 0]
    assert got == {(g, i): max(cosine(a, b) for h, a in asking if h == g) for g, _ in asking for i, _, b in rows}


@pytest.mark.parametrize("name", ["threshold_fallback", "quota_select", "recommend", "multi_variant_search", "corpora_search", "corpora_outcomes"])
def test_no_pair_of_vectors_is_joined(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
