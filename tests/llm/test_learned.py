"""Language mixtures and toxicity scores: held-out quality and defined results."""

import zlib

import duckdb
import numpy as np
import pytest
from frames import ODD_ROWS, documents

from scriptorium.llm import langid, toxicity
from scriptorium.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def fold(k, n):
    return zlib.crc32(str(k).encode()) % n


def test_language_of_held_out_documents(spark):
    got = QUERIES["op3_language"](spark, SF).collect()
    truth = dict(duckdb.sql(f"select doc_id, lang from '{SF}/documents.parquet'").fetchall())
    texts = dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())
    assert len(got) == len(truth)
    assert all(r.held_out == (fold(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and truth[r.doc_id] is not None and r.lang_pred != "und" and len(texts[r.doc_id]) > 100]
    assert len(held) > 100 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.9


def test_mixtures(spark):
    rows = [("aaa bab aba bba " * 20, "x"), ("zyz yzy zzy yyz " * 20, "y"), ("mnm nmn mmn nnm " * 20, "z")] * 3 + [(None, "x"), ("text", None)]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert model.languages == ["x", "y", "z"]
    share, lettered = langid.proportions(["aba bab " * 30 + "yzy zyz " * 30, "mnm " * 50, "12 34", None], model)
    assert lettered.tolist() == [True, True, False, False]
    assert share[0][0] == pytest.approx(0.5, abs=0.05) and share[0][1] == pytest.approx(0.5, abs=0.05) and share[0][2] == 0
    assert share[1].tolist() == [0, 0, 1]
    got = {r.doc_id: r for r in langid.languages(documents(spark, [r for r in ODD_ROWS if r[0] is not None]), model).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (3, 4, 5))
    assert langid.languages(documents(spark, []), model).collect() == []


def test_language_without_learnable_rows(spark):
    model = langid.fit(spark.createDataFrame([], "text string, lang string"))
    assert {r.lang_pred for r in langid.languages(documents(spark, ODD_ROWS), model).collect()} == {"und"}


def test_mixture_of_more_than_four_languages(spark):
    words = ["aba bab ", "cdc dcd ", "efe fef ", "ghg hgh ", "iji jij ", "klk lkl "]
    model = langid.fit(spark.createDataFrame([(w * 50, w[0]) for w in words], "text string, lang string"))
    for n in (5, 6):
        share, _ = langid.proportions(["".join(w * 40 for w in words[:n])], model)
        assert share[0] == pytest.approx([1 / n] * n + [0] * (6 - n), abs=0.03)


def test_letters_beyond_the_basic_plane():
    """Adlam, Deseret, Gothic, mathematical letters and rare ideographs are letters; flags' tags and variation selectors aren't."""
    letters = ["\U0001e900\U0001e901", "\U00010400", "\U00010330", "\U0001d400", "\U00020000", "\U00030000"]
    others = ["\U0001f3f4\U000e0067\U000e0062\U000e007f", "\U000e0100", "\U0001f642", "\U0010ffff", None]
    assert langid.trigrams(letters + others)[2].tolist() == [True] * len(letters) + [False] * len(others)
    assert (langid.trigrams(["\U00010400"])[1] == langid.trigrams(["\U00010428"])[1]).all()


def test_toxicity_of_held_out_documents(spark):
    got = {r.doc_id: r for r in QUERIES["op4_toxicity"](spark, SF).collect()}
    labels = duckdb.sql(f"select doc_id, max(toxic) from '{SF}/labels.parquet' where toxic is not null group by 1").fetchall()
    assert all(r.held_out == (fold(k, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for k, r in got.items())
    held = [(got[k].score, y) for k, y in labels if k in got and got[k].held_out]
    ones, zeros = [s for s, y in held if y], [s for s, y in held if not y]
    assert ones and zeros
    auc = np.mean([(a > b) + (a == b) / 2 for a in ones for b in zeros])
    assert auc > 0.9


def labels(spark, rows):
    return spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, toxic int, key string")


def test_ftrl_learns_a_word_and_stays_sparse(spark):
    rows = [(k, f"plain words number {k % 7} here" + (" foul" if k % 3 == 0 else "")) for k in range(300)]
    docs = documents(spark, rows)
    model = toxicity.fit(docs, labels(spark, [(k, int(k % 3 == 0)) for k, _ in rows] + [(None, 1), (1, None), (0, 0)]))
    assert 0 < len(model.places) < 100
    got = {r.doc_id: r.score for r in toxicity.scores(documents(spark, [(1, "so foul it is foul"), (2, "plain words"), (3, None), (4, "")]), model).collect()}
    assert got[1] > 0.5 > got[2] and got[3] == got[4]
    both = toxicity.with_scores(docs, model, to="label")
    assert both.columns == docs.columns and both.schema["label"].dataType.simpleString() == "double"


def test_more_shards_average(spark):
    rows = [(k, "foul thing" if k % 2 else "nice thing") for k in range(200)]
    model = toxicity.fit(documents(spark, rows), labels(spark, [(k, k % 2) for k, _ in rows]), shard_rows=50)
    got = {r.doc_id: r.score for r in toxicity.scores(documents(spark, [(1, "foul"), (2, "nice")]), model).collect()}
    assert got[1] > 0.5 > got[2]


@pytest.mark.parametrize("known, score", [([], 0.0), ([(1, 1), (2, 1)], 1.0), ([(1, 0)], 0.0)])
def test_labels_of_one_kind(spark, known, score):
    docs = documents(spark, ODD_ROWS)
    model = toxicity.fit(docs, labels(spark, known))
    assert {r.score for r in toxicity.scores(docs, model).collect()} == {score}
    assert toxicity.scores(documents(spark, []), model).collect() == []
