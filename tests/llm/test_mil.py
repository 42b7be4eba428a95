"""Quality by attention over passages: gradient, pooling and features against plain versions, and held-out accuracy."""

import zlib

import duckdb
import numpy as np
import pytest
from frames import ODD_ROWS, documents

from scriptorium.llm import mil
from scriptorium.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_quality_of_held_out_documents(spark):
    got = {r.doc_id: r for r in QUERIES["op11_quality"](spark, SF).collect()}
    texts = dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())
    assert got.keys() == texts.keys()
    labels = duckdb.sql(f"select doc_id, max(quality) from '{SF}/labels.parquet' where quality is not null group by 1").fetchall()
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for k, r in got.items())
    held = [(got[k].score, y) for k, y in labels if k in got and got[k].held_out]
    ones, zeros = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([(a > b) + (a == b) / 2 for a in ones for b in zeros]) > 0.95
    assert np.mean(np.array(ones) >= 0.3) > 0.97 and np.mean(np.array(zeros) < 0.3) > 0.5


def test_passages_of_64_words():
    words = [f"w{i}" for i in range(200)]
    text = " ".join(words) + "\nend"
    found = [(o.tolist(), x) for o, x in mil.passages([text, None, "", " \n ", "one", "a b c " * 50])]
    owner = [k for o, _ in found for k in o]
    assert owner == [0, 0, 0, 0, 1, 2, 3, 4, 5, 5, 5]
    x = np.concatenate([x for _, x in found])
    assert x.shape == (11, mil.PLACES) and np.allclose(np.linalg.norm(x[:, :-1], axis=1), [1] * 11, atol=1e-3)
    assert (x[:8, -1] == 0).all() and x[8, -1] == pytest.approx(61 / 64) and x[9, -1] == 1


def test_blocks_do_not_change_scores(monkeypatch):
    texts = ["a b c d " * 300, None, "x", "other words " * 999]
    whole = mil.bag_logits(mil.initial(), texts)
    single = [mil.bag_logits(mil.initial(), [t])[0] for t in texts]
    monkeypatch.setattr(mil, "BLOCK", 2)
    assert np.allclose(whole, mil.bag_logits(mil.initial(), texts), atol=1e-5)
    assert np.allclose(whole, single, atol=1e-5)


def plain_loss(flat, bags, labels):
    """Gated attention over bags, one passage at a time."""
    p, total = mil._named(flat.astype(float)), 0.0
    for x, y in zip(bags, labels):
        h = [np.tanh(row @ p["encoder"] + p["base"]) for row in x]
        e = np.exp([float(np.sum(p["w"] * np.tanh(k @ p["v"]) / (1 + np.exp(-(k @ p["u"]))))) for k in h])
        z = sum(a * k for a, k in zip(e / e.sum(), h))
        score = 1 / (1 + np.exp(-(z @ p["out"] + p["bias"])))
        total -= np.log(score if y else 1 - score)
    return total / len(bags)


def test_gradient_equals_differences():
    rng = np.random.default_rng(1)
    bags = [rng.normal(0, 0.3, (n, mil.PLACES)) for n in (1, 3, 5)]
    labels = np.array([1.0, 0.0, 1.0])
    flat = mil.initial().astype(float) + rng.normal(0, 0.05, len(mil.initial()))
    got = mil.gradient(flat, np.repeat([0, 1, 2], [1, 3, 5]), np.concatenate(bags), labels)
    ends = np.append(0, mil._SPLITS)
    for i in [int(rng.integers(u, v)) for u, v in zip(ends[:-1], ends[1:]) for _ in range(4)]:
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        want = (plain_loss(up, bags, labels) - plain_loss(down, bags, labels)) / 2e-5
        assert got[i] == pytest.approx(want, rel=1e-3, abs=1e-6)


def labelled(spark, rows):
    return spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, quality int, key string")


def test_one_bad_passage_is_found(spark):
    good = " ".join(f"plain word{i % 13} here" for i in range(150))
    rows = [(k, good + (" &&& %%% $$$" * 30 if k % 2 else "") + f" end{k}") for k in range(120)]
    docs = documents(spark, rows)
    model = mil.fit(docs, labelled(spark, [(k, 1 - k % 2) for k, _ in rows] + [(None, 1), (1, None)]), rounds=2)
    got = {r.doc_id: r.score for r in mil.scores(documents(spark, [(1, good + " &&& %%% $$$" * 25), (2, good), (3, None), (4, ""), (5, " ")]), model).collect()}
    assert got[1] < 0.3 < got[2] and got[3] == got[4] and 0 <= got[5] <= 1


def test_shards_are_averaged_and_repeatable(spark):
    rows = [(k, "&& foul" if k % 2 else "nice text") for k in range(80)]
    docs, known = documents(spark, rows), labelled(spark, [(k, 1 - k % 2) for k, _ in rows])
    one, two = (mil.fit(docs, known, shard_rows=20, rounds=2).weights for _ in range(2))
    assert np.array_equal(one, two)
    got = mil.text_scores(mil.Model(one), ["&& foul", "nice text"])
    assert got[0] < 0.5 < got[1]


@pytest.mark.parametrize("known, score", [([], 0.5), ([(1, 1), (2, 1)], 1.0), ([(1, 0)], 0.0)])
def test_labels_of_one_kind(spark, known, score):
    model = mil.fit(documents(spark, ODD_ROWS), labelled(spark, known))
    assert {r.score for r in mil.scores(documents(spark, ODD_ROWS), model).collect()} == {score}
    assert mil.scores(documents(spark, []), model).collect() == []


def test_rows_of_all_kinds_and_long_texts(spark):
    rows = [*ODD_ROWS, (30, "many words " * 300_000)]
    model = mil.fit(documents(spark, rows), labelled(spark, [(1, 1), (6, 0), (8, 1), (9, 0), (30, 1)]), rounds=1)
    got = mil.scores(documents(spark, rows), model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
