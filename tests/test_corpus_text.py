"""Runs of words over the ends of documents, and places in UTF-16 units."""

from collections import Counter

import pytest
from oracle import differences
from pyspark.sql import functions as F

from scriptorium.operators import notes, textometrics
from scriptorium.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["corpus_bigrams", "corpus_trigrams", "top_bigrams", "chunk_pages"])
def test_queries(spark, name):
    assert differences(QUERIES[name](spark, SF), ORACLES[name], SF) == []


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_short_and_empty_documents_pass_words_on(spark, n):
    texts = ["alpha beta", "", "gamma", None, "delta", "epsilon zeta eta theta", " ", "iota", "kappa", "lambda alpha beta gamma"] * 5
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(7)
    words = " ".join(t or "" for t in texts).split()
    want = Counter(" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
    got = {r.ngram: r["count"] for r in textometrics.corpus_ngrams(df, n, 1000).collect()}
    assert got == dict(want)
    assert textometrics.corpus_ngrams(df.limit(0), n, 5).collect() == []


def test_places_count_utf16_units(spark):
    text = "🙂 one two 🙂🙂 three four five one 🙂 six"
    chunks = [(1, 0, "🙂 one two 🙂🙂"), (1, 1, "three four"), (1, 2, "one 🙂 six"), (1, 3, "absent")]
    df = spark.createDataFrame(chunks, "doc_id long, chunk_index long, content string")
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    units = lambda x: len(x.encode("utf-16-le")) // 2
    want, at = [], 0
    for _, k, content in chunks:
        found = text.encode("utf-16-le").find(content.split(" ")[0].encode("utf-16-le"), 2 * at) // 2
        first = found if found >= 0 else at
        at = first + units(content)
        want.append((k, first, at))
    placed = notes.with_positions(df, docs)
    assert sorted((r.chunk_index, r["first"], r["last"]) for r in placed.collect()) == want
    pages = spark.createDataFrame([(1, 1, text[:8]), (1, 2, text[8:])], "doc_id long, page_number int, text string")
    got = {r.chunk_index: r.page_number for r in notes.with_pages(placed.select("doc_id", "chunk_index", F.col("first")), pages).collect()}
    assert got == {k: 1 if first < units(text[:8]) + 2 else 2 for k, first, _ in want}
