"""Near copies within documents: a document's chunks stay one row; flags as by a plain loop."""

import random

import pyarrow as pa
from scriptorium.operators import dedup
from scriptorium.plans.catalogue import QUERIES


def plain(sets, ahead, least):
    gone = [False] * len(sets)
    for i, a in enumerate(sets):
        for j in range(i + 1, min(i + 1 + ahead, len(sets))):
            union = len(set(a) | set(sets[j]))
            if not gone[i] and union and len(set(a) & set(sets[j])) / union >= least:
                gone[j] = True
    return [not g for g in gone]


def test_flags_as_by_a_plain_loop():
    rng = random.Random(3)
    documents = [[rng.sample("abcde", rng.randrange(0, 5)) for _ in range(rng.choice([0, 1, 2, 9]))] for _ in range(700)]
    words = pa.array(documents, pa.list_(pa.list_(pa.string())))
    for ahead, least in ((4, 0.5), (1, 0.75), (4, 1.0)):
        assert dedup._kept(words, ahead, least).to_pylist() == [plain(d, ahead, least) for d in documents]
    assert dedup._kept(words.slice(0, 0), 4, 0.5).to_pylist() == []


def test_nothing_is_shuffled(spark):
    plan = QUERIES["near_copies_in_documents"](spark, "/root/testdata/sf0.001")._jdf.queryExecution()
    assert "Exchange" not in plan.executedPlan().toString() and plan.optimizedPlan().toString().count("ArrowEvalPython") == 1
