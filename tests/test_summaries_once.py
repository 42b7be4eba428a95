"""Summaries: a document stays one row, and letters of all scripts count."""

from scriptorium.operators import chunk


def test_nothing_is_shuffled_and_odd_texts_count(spark):
    texts = ["Élan vital élan ŒUVRE œuvre. Les résultats, donc résultats 42! Straße straße straße. ☂☂☂☂☂☂☂☂☂☂☂☂. short.", "", None, "- - - - - - - - - -"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df = chunk.summaries(docs)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString() and plan.count("ArrowEvalPython") == 1
    got = {(r.doc_id, r.pos): (r.sentence, r.score) for r in df.collect()}
    assert got == {
        (0, 0): ("Élan vital élan ŒUVRE œuvre.", round(9 / 5 + 1.0, 6)),
        (0, 1): ("Les résultats, donc résultats 42!", round(7 / 5 + 1.0 + 0.3, 6)),
        (0, 2): ("Straße straße straße.", 3.0 - 1.0),
        (0, 3): ("☂☂☂☂☂☂☂☂☂☂☂☂.", 0.0 - 1.0),
        (3, 0): ("- - - - - - - - - -", 0.0),
    }
