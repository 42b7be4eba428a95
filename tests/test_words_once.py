"""Texts are split once, and what their words give is written down or added up from there."""

import re

from oracle import differences
from scriptorium.operators import textometrics
from scriptorium.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def splits(df):
    """How often a plan splits texts into words."""
    return len(re.findall(r"split\(", df._jdf.queryExecution().optimizedPlan().toString()))


def test_statistics_split_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert splits(textometrics.corpus_statistics(docs)) <= 2  # words, and words with stopwords
    assert not differences(QUERIES["corpus_statistics"](spark, SF), ORACLES["corpus_statistics"], SF)
    assert textometrics.corpus_statistics(docs.limit(0)).first().asDict() == {"documents": 0, "total_words": None, "total_with_stopwords": None, "mean_words": None, "mean_vocabulary": None, "vocabulary": 0}


def test_ngrams_and_weights_split_before_storing(spark, monkeypatch):
    written, stored = [], textometrics.stored
    monkeypatch.setattr(textometrics, "stored", lambda df: written.append(splits(df)) or stored(df))
    assert not differences(QUERIES["corpus_trigrams"](spark, SF), ORACLES["corpus_trigrams"], SF)
    assert written == [1, 0]
    del written[:]
    found = QUERIES["tfidf_characteristic_words"](spark, SF)
    assert written == [1] and splits(found) == 0
    assert not differences(found, ORACLES["tfidf_characteristic_words"], SF)
