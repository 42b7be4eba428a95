"""Deltas of relations: any split gives what one batch gives, and a replay changes nothing."""

import random
from collections import Counter

import pytest
from oracle import differences

from scriptorium.operators import relations
from scriptorium.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plain(rows):
    weight, sources = Counter(), {}
    for a, b, s in rows:
        if a is not None and b is not None and s is not None and a != b:
            weight[min(a, b), max(a, b)] += 1
            sources.setdefault((min(a, b), max(a, b)), set()).add(s)
    return sorted((a, b, n, len(sources[a, b])) for (a, b), n in weight.items())


def read(spark, path):
    return sorted(tuple(r) for r in relations.relations(spark, path).collect())


def test_deltas_replays_and_folding(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice("abcde"), rng.choice("abcde"), f"s{rng.randrange(6)}") for _ in range(200)] + [(None, "a", "s"), ("a", "b", None), ("a", "b", "s0"), ("b", "a", "s0")]
    parts = [rows[:70], rows[70:150], rows[150:]]
    frames = [spark.createDataFrame(p, "first string, second string, source string") for p in parts]
    path = f"file://{tmp_path}/state"
    assert relations.relations(spark, path) is None
    assert relations.take_in(frames[0], path, "one") and not relations.take_in(frames[0], path, "one")
    assert read(spark, path) == plain(parts[0])
    relations.compact(spark, path)
    relations.compact(spark, path)
    assert [p.name for p in (tmp_path / "state").iterdir() if p.name.startswith("base")] == ["base=1"]
    assert read(spark, path) == plain(parts[0]) and not relations.take_in(frames[0], path, "one")
    assert relations.take_in(frames[1], path, "two") and relations.take_in(frames[2], path, "three-3")
    assert read(spark, path) == plain(rows)
    relations.compact(spark, path)
    assert read(spark, path) == plain(rows) and not relations.take_in(frames[1], path, "two")
    with pytest.raises(ValueError, match="not a name"):
        relations.take_in(frames[1], path, "../x")


def test_broken_writes_are_not_read(spark, tmp_path):
    df = spark.createDataFrame([("a", "b", "s")], "first string, second string, source string")
    path = f"file://{tmp_path}/state"
    relations.take_in(df, path, "one")
    relations.take_in(df, path, "two")
    (tmp_path / "state/delta=two/rows/_SUCCESS").unlink()  # as if it had broken off
    assert read(spark, path) == [("a", "b", 1, 1)]
    assert relations.take_in(df, path, "two") and read(spark, path) == [("a", "b", 2, 1)]
    relations.compact(spark, path)
    (tmp_path / "state/base=1/rows/_SUCCESS").unlink()
    assert read(spark, path) == [("a", "b", 2, 1)]
    relations.compact(spark, path)
    assert read(spark, path) == [("a", "b", 2, 1)]


def test_query(spark):
    assert differences(QUERIES["relation_upserts"](spark, SF), ORACLES["relation_upserts"], SF) == []
