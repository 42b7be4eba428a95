import random

import brute
import numpy as np
import pytest
from frames import ODD_ROWS, documents

from scriptorium.llm import near_join


def found(df, **options):
    rows = near_join.near_duplicates(df, **options).select("doc_id", "class_id", "n_links").collect()
    return sorted((tuple(r) for r in rows), key=repr)


def test_odd_rows(spark):
    rows = [r for r in ODD_ROWS if r[0] != 9]
    want = brute.near_duplicates(rows)
    assert found(documents(spark, rows)) == want


def test_empty_table(spark):
    assert found(documents(spark, [])) == []


def test_near_copies_and_chains(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows, k = [], 0
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(30, 90))]
        for _ in range(rng.randint(1, 6)):
            rows.append((k, " ".join(base)))
            k += 1
            base = list(base)
            base[rng.randrange(len(base))] = rng.choice(words)
    rows += [(k + i, "one hot text that many rows share word for word") for i in range(40)]
    assert found(documents(spark, rows)) == brute.near_duplicates(rows)


def test_large_group_in_blocks(spark, monkeypatch):
    """More different near copies than a block or a small bucket holds."""
    monkeypatch.setattr(near_join, "BLOCK", 16)
    monkeypatch.setattr(near_join, "SMALL", 8)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(70):
        own = list(base)
        own[rng.randrange(120)] = f"x{k}"
        rows.append((k, " ".join(own)))
    assert found(documents(spark, rows)) == brute.near_duplicates(rows)


def test_runs_reach_the_recall():
    assert near_join.runs_for(0.5, 0.5, 1) == 1
    n = near_join.runs_for()
    assert (1 - near_join.SIMILARITY**3) ** n <= 1.0001e-7


@pytest.mark.parametrize("n", [2, 3, 20])
def test_intersections(n):
    rng = np.random.default_rng(n)
    sets = [np.unique(rng.integers(0, 50, 30, dtype=np.uint64)) for _ in range(n)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = near_join.intersections(sets)
    for i in range(n):
        for j in range(n):
            if i != j:
                assert got[i][j] == want[i][j]


def test_results_repeat(spark):
    rows = [(k, " ".join(f"w{(k // 3) * 7 + i}" for i in range(30))) for k in range(30)]
    assert found(documents(spark, rows)) == found(documents(spark, rows[::-1]))


def test_rows_of_a_hot_key_meet_their_own_set_only(spark, monkeypatch):
    """Null keys, and one key that many rows share: texts fetched grow with the rows, not with their square."""
    refetch = near_join._refetch

    def watched(size):
        def watch(batches):
            n = 0
            for b in batches:
                n += b.num_rows
                assert n <= 1000, "texts fetched for sets that aren't theirs"
                yield b

        return lambda batches: refetch(size)(watch(batches))

    monkeypatch.setattr(near_join, "_refetch", watched)
    rows = []
    for k in range(120):
        base = [f"w{k}x{i}" for i in range(60)]
        rows += [(None if k % 2 else 7, " ".join([*base, end])) for end in ("one", "two")]
    rows += rows[:4] + [(5, rows[0][1])]
    got = found(documents(spark, rows))
    monkeypatch.undo()
    assert got == brute.near_duplicates(rows)
