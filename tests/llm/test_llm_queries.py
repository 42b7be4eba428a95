"""The registered queries against their SQL, and the pipeline against brute force."""

import brute
import pytest
from oracle import differences
from pyspark.sql import functions as F

import corpus_pipeline
from scriptorium.llm.queries import ORACLES, QUERIES
from scriptorium.llm.storage import staged

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    assert differences(QUERIES[name](spark, SF), ORACLES[name], SF) == []


def test_a_query_for_each_operator():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 14)]


def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_op9_equals_brute_force(spark):
    rows = texts(spark)
    want = {k: sum(f) for (k, _), f in zip(rows, brute.removed(rows))}
    got = {r.doc_id: r.n_removed for r in QUERIES["op9_suffix_dedup"](spark, SF).collect()}
    assert got == want


def test_op10_equals_brute_force(spark):
    got = sorted((tuple(r) for r in QUERIES["op10_near_join"](spark, SF).collect()), key=repr)
    assert got == brute.near_duplicates(texts(spark))


def test_pipeline_stages(spark):
    """Each stage on its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "suffix_dedup", "decontamination", "packing"]
    kept = staged(stages["toxicity"](spark, docs, SF))
    assert kept.columns == columns
    labels = dict(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic").collect())
    ids = {r.doc_id for r in kept.collect()}
    marked = [k for k, y in labels.items() if y]
    clean = [k for k, y in labels.items() if y == 0]
    assert sum(k not in ids for k in marked) >= 0.9 * len(marked) and all(k in ids for k in clean)

    single = staged(stages["near_duplicates"](spark, kept, SF))
    assert single.columns == columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    classes = brute.near_duplicates(rows)
    wordless = {k for k, t in rows if not brute.words(t)}
    assert sorted(r.doc_id for r in single.collect()) == sorted({c for k, c, _ in classes if k not in wordless} | wordless)

    cut = staged(stages["suffix_dedup"](spark, single, SF))
    assert cut.columns == columns and cut.schema == docs.schema
    rows = [(r.doc_id, r.text) for r in single.collect()]
    want = {k: None if t is None else bytes(x for x, f in zip(t.encode(), flags) if not f).decode("utf-8", "ignore") for (k, t), flags in zip(rows, brute.removed(rows))}
    assert {r.doc_id: r.text for r in cut.collect()} == want
    assert all(r.text is None or r.n_chars == len(r.text) for r in cut.collect())

    clean = staged(stages["decontamination"](spark, cut, SF))
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = brute.words(r.text)
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    sizes = {len(w) for w in windows}
    hit = {k for k, t in want.items() if any(tuple(w[i : i + n]) in windows for w in [brute.words(t)] for n in sizes for i in range(len(w) - n + 1))}
    assert hit and sorted(r.doc_id for r in clean.collect()) == sorted(k for k in want if k not in hit)

    pieces = stages["packing"](spark, clean, SF).collect()
    tokens = {}
    for r in pieces:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
    assert tokens == {r.doc_id: r.doc_tokens for r in pieces} and tokens.keys() == {r.doc_id for r in clean.collect()}


def test_pipeline_with_nulls_repeats_and_clashing_columns(spark):
    words = "a few plain words that make a text of some length which is here repeated " * 2
    rows = [(1, words, "en", "s", 1, "k"), (1, words, "en", "s", 1, "k"), (2, words + "end", None, None, None, "k"), (3, None, None, None, None, None), (4, "", "en", "s", 0, "k"), (None, "other words entirely", "en", "s", 1, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, label string")
    clashing = ["_kept", "_score", "_text_hash", "_key", "_hash", "key", "row", "score", "spans", "text_hash", "class"]
    docs = docs.select("*", *[F.lit(7).alias(c) for c in clashing])
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF))
        assert name == "packing" or docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "label", *clashing]
    assert sorted({r.doc_id for r in docs.collect()}, key=repr) == [1, 3, 4, None]


def test_pipeline_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF))
    assert docs.collect() == []
