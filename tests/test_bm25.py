"""BM25 by blocks of queries and words against plain loops."""

import math
import random
from collections import Counter

import pytest

from scriptorium.operators import search
from scriptorium.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("k", [3, None])
def test_equals_scoring_everything(spark, monkeypatch, k):
    monkeypatch.setattr(search, "FREQUENT_WORDS", 3)
    monkeypatch.setattr(search, "ASKED_ROWS", 4)
    rng = random.Random(3)
    made = lambda n: " ".join(rng.choice("abcdefghijklmnop") * rng.choice((1, 1, 2)) for _ in range(n))
    docs = [(i, None if i == 7 else made(i % 13)) for i in range(60)]
    asked = [(i, made(1 + i % 3)) for i in range(9)] + [(9, None), (10, "absent"), (11, "a absent"), (12, "")]
    df, queries = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(asked, "query_id long, text string")
    got = {(r.query_id, r.doc_id, r.score) for r in search.bm25(df, queries, k).collect()}
    words = {i: Counter((t or "").split()) for i, t in docs}
    mean = sum(map(len, words.values())) / len(words)
    held = Counter(w for c in words.values() for w in c)
    want = set()
    for q, text in asked:
        of = Counter((text or "").split())
        hits = []
        for i, c in words.items():
            if any(w in c for w in of):
                score = sum(n * math.log((len(docs) - held[w] + 0.5) / (held[w] + 0.5) + 1) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * len(c) / mean)) for w, n in of.items() if w in c)
                if k is not None or all(w in c for w in of):
                    hits.append((-round(score, 6), i))
        want |= {(q, i, -s) for s, i in (sorted(hits)[:k] if k else hits)}
    assert got == want


def test_pairs_of_query_and_document_are_not_shuffled(spark):
    plan = QUERIES["hybrid_rrf_plain"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    scoring = [x for x in plan.split("\n") if "Exchange hashpartitioning(query_id" in x and "doc_id" in x.split("),")[0]]
    assert "MapInArrow" in plan and not scoring
