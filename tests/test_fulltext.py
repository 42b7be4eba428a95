"""Stems, and stemmed search against scoring everything in plain Python."""

import math
import re
import unicodedata
from collections import Counter

import pytest

from scriptorium.functions.stem import stem
from scriptorium.operators import fulltext
from scriptorium.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"

#: The published algorithm's own examples.
STEMS = """caresses:caress ponies:poni ties:ti caress:caress cats:cat feed:feed agreed:agre plastered:plaster bled:bled motoring:motor sing:sing
conflated:conflat troubled:troubl sized:size hopping:hop tanned:tan falling:fall hissing:hiss fizzed:fizz failing:fail filing:file happy:happi sky:sky
relational:relat conditional:condit rational:ration valenci:valenc digitizer:digit radicalli:radic vileli:vile vietnamization:vietnam operator:oper feudalism:feudal
decisiveness:decis hopefulness:hope callousness:callous formaliti:formal sensibiliti:sensibl triplicate:triplic formative:form formalize:formal electrical:electr goodness:good
revival:reviv allowance:allow gyroscopic:gyroscop adjustable:adjust replacement:replac adoption:adopt communism:commun effective:effect bowdlerize:bowdler probate:probat
rate:rate cease:ceas controll:control roll:roll as:as été:été"""


def test_stems():
    assert {w: stem(w) for w, _ in (x.split(":") for x in STEMS.split())} == dict(x.split(":") for x in STEMS.split())


def tokens(text):
    lowered = re.split(r"[^\w]+|_", unicodedata.normalize("NFC", text or "").lower())
    plain = ["".join(c for c in unicodedata.normalize("NFD", w) if unicodedata.category(c) != "Mn") for w in lowered]
    return [stem(w) for w in plain if w]


def scores(docs, query, every):
    """[(key, score)] of all documents, best first."""
    held = [(k, tokens(t)) for k, t in docs]
    asked, n = sorted(set(tokens(query))), len(docs)
    mean = sum(len(w) for _, w in held) / n
    df = Counter(s for _, w in held for s in set(w))
    out = []
    for k, w in held:
        tf = Counter(w)
        some = [s for s in asked if tf[s]]
        if some and (not every or len(some) == len(asked)):
            weigh = lambda s: max(math.log((n - df[s] + 0.5) / (df[s] + 0.5)), 0) or 1e-6
            out.append((k, sum(weigh(s) * tf[s] * 2.2 / (tf[s] + 1.2 * (0.25 + 0.75 * len(w) / mean)) for s in some)))
    return sorted(out, key=lambda x: -x[1])


@pytest.mark.parametrize("name, every", [("stemmed_search", True), ("stemmed_any", False)])
def test_equals_scoring_everything(spark, name, every):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    got = {}
    for r in QUERIES[name](spark, SF).collect():
        got.setdefault(r.query_id, []).append(r)
    for q, text in items.items():
        want = scores(docs, text, every)[:10]
        own = sorted(got.get(q, []), key=lambda r: r.rank)
        assert [r.score for r in own] == pytest.approx([s for _, s in want], abs=2e-6)
        assert all(0 < r.read <= r.held for r in own)
    assert got


def test_buckets_are_skipped_without_loss(spark, monkeypatch):
    monkeypatch.setattr(fulltext, "FIRST_BUCKETS", 2)
    docs = [(k, "running runs " * ((1 + k % 7) * (k % 3 == 0)) + "filler words " * (k % 23) + ("RÉSUMÉ " if k % 5 == 0 else "")) for k in range(300)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, stem string")
    asked = {1: "run", 2: "resumes running", 3: "nowhere run", 4: "", 5: None}
    queries = spark.createDataFrame(list(asked.items()), "query_id long, text string")
    for every in (True, False):
        got = {}
        for r in fulltext.search(fulltext.index(df, bucket_rows=4), queries, 5, every).collect():
            got.setdefault(r.query_id, []).append(r)
        for q, text in asked.items():
            want = scores(docs, text, every)[:5]
            own = sorted(got.get(q, []), key=lambda r: r.rank)
            assert [r.score for r in own] == pytest.approx([s for _, s in want], abs=2e-6)
        assert got[1][0].read < got[1][0].held / 2


def test_odd_rows_and_empty_tables(spark):
    rows = [(None, "cats"), (1, "cat"), (1, "cat"), (2, None), (3, ""), (4, "́"), (5, "dog " * 50_000)]
    queries = spark.createDataFrame([(1, "Cat's")], "query_id long, text string")
    got = fulltext.search(fulltext.index(spark.createDataFrame(rows, "doc_id long, text string")), queries, 10, False).collect()
    assert sorted((r.doc_id for r in got), key=repr) == [1, 1, None]
    empty = fulltext.index(spark.createDataFrame([], "doc_id long, text string"))
    assert fulltext.search(empty, queries).collect() == []


def test_stems_are_not_repeated_for_each_bucket_and_few_documents_come_at_once(spark, monkeypatch):
    docs = [(k, " ".join(f"w{(k * 7 + i * i) % 40}" for i in range(30))) for k in range(600)]
    queries = spark.createDataFrame([(q, " ".join(f"w{(q + i) % 40}" for i in range(12))) for q in range(30)], "query_id long, text string")
    batches, columns = [], []
    stored = fulltext.stored
    monkeypatch.setattr(fulltext, "stored", lambda df: batches.append(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) or columns.append(set(df.columns)) or stored(df))
    index = fulltext.index(spark.createDataFrame(docs, "doc_id long, text string"), bucket_rows=32)
    assert int(batches[0]) <= 1000 and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"
    got = {}
    for r in fulltext.search(index, queries, 5, False).collect():
        got.setdefault(r.query_id, []).append(r)
    for q in range(30):
        want = scores(docs, " ".join(f"w{(q + i) % 40}" for i in range(12)), False)[:5]
        assert [r.score for r in sorted(got[q], key=lambda r: r.rank)] == pytest.approx([s for _, s in want], abs=2e-6)
    # no row for each bucket, query and stem is written or sent
    assert not any({"query_id", "bucket", "stem"} <= c for c in columns)
