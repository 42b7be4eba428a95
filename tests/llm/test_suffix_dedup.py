import random

import brute
import numpy as np
import pytest
from frames import ODD_ROWS, documents
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm import suffix_dedup
from scriptorium.llm.lyndon import suffix_array


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=60))
def test_suffix_array(text):
    text = [*text, 0]
    assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_suffix_array_of_runs_and_powers():
    for text in ([1] * 500, [1, 2] * 300, [2, 1] * 300, [1, 1, 2] * 150, [3, 1, 2, 1] * 120):
        text = [*text, 0]
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_keys_must_be_whole_numbers(spark):
    with pytest.raises(TypeError, match="whole numbers"):
        suffix_dedup.remove_repeats(spark.createDataFrame([("a", "text")], "doc_id string, text string"))


def check(spark, rows, **options):
    got = suffix_dedup.remove_repeats(documents(spark, rows), **options).collect()
    assert len(got) == len(rows)
    want = []
    for (k, t), flags in zip(rows, brute.removed(rows)):
        b = (t or "").encode()
        edges = [i for i in range(len(b) + 1) if (flags[i] if i < len(b) else 0) != (flags[i - 1] if i else 0)]
        want.append((k, len(b), tuple(zip(edges[::2], edges[1::2])), bytes(x for x, f in zip(b, flags) if not f)))
    assert sorted(((r[0], r.n_bytes, tuple((s["first"], s["last"]) for s in r.spans), bytes(r.kept)) for r in got), key=repr) == sorted(want, key=repr)


def test_odd_rows(spark):
    check(spark, ODD_ROWS)


def test_empty_table(spark):
    check(spark, [])


def test_random_texts_with_shared_passages(spark):
    rng = random.Random(3)
    passages = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(40, 200))) for _ in range(12)]
    rows = []
    for k in range(120):
        parts = []
        for _ in range(rng.randint(1, 5)):
            parts.append(rng.choice(passages)[rng.randint(0, 20) :] if rng.random() < 0.6 else "".join(rng.choice("uvwxyzé") for _ in range(rng.randint(0, 120))))
        rows.append((k if k % 17 else None, "".join(parts)))
    check(spark, rows)


def test_runs_within_and_across_documents(spark):
    check(spark, [(1, "a" * 49), (2, "a" * 50), (3, "a" * 51), (4, "a" * 500), (5, "ab" * 200), (6, "ba" * 200), (7, "a" * 49 + "b"), (8, "ab" * 24 + "a" * 300)])


def test_hot_passage(spark):
    line = "this is one very frequent line that nearly every document of the table ends with, alas"
    check(spark, [(k, f"start {k} " * 5 + line) for k in range(300)])


def fragment(rng, size):
    """A string with a 16-byte hash so low that it is the anchor of most windows around it."""
    tries = ("".join(rng.choice("ghijkl ") for _ in range(size)) for _ in range(300))
    return min(tries, key=lambda x: suffix_dedup._doubled(np.frombuffer((x + "#" * 32).encode(), np.uint8))[0][: size - 15].min())


def test_large_anchors_in_bounded_arrays(spark):
    """A fragment next to varying and to repeated text, a hot line, null and repeated keys; every anchor of some pieces is split."""
    rng = random.Random(8)
    hot, line = fragment(rng, 30), "one line of sixty bytes and more that very many rows share!!"
    word = lambda n: "".join(rng.choice("uvwxyz") for _ in range(n))
    sides = [word(40) for _ in range(6)]
    rows = []
    for k in range(250):
        left, right = (rng.choice(sides) if rng.random() < 0.4 else word(40) for _ in "ab")
        rows.append((k // 2 if k % 13 else None, left + hot + right + (line + word(9) if k % 3 else "")))
    check(spark, rows)
    check(spark, rows, group_bytes=300, array_bytes=700)
    check(spark, rows, group_bytes=0, array_bytes=1)


def test_no_group_of_a_hot_fragment_is_large(spark, monkeypatch):
    rng = random.Random(4)
    hot = fragment(rng, 40)
    decide = suffix_dedup._decide

    def watched(buckets):
        def watch(batches):
            sizes = {}
            for b in batches:
                for group, text in zip(b.column(0).to_pylist(), b.column(4).to_pylist()):
                    sizes[group] = sizes.get(group, 0) + len(text)
                yield b
            assert max(sizes.values(), default=0) <= 1 << 20, "a group of over a megabyte"

        return lambda batches: decide(buckets)(watch(batches))

    monkeypatch.setattr(suffix_dedup, "_decide", watched)
    word = lambda: "".join(rng.choices("abcdefmnopqrstuvwxyz", k=60))
    rows = [(k, word() + hot + word()) for k in range(16_000)]
    got = suffix_dedup.remove_repeats(documents(spark, rows)).selectExpr("count(*) n", "sum(size(spans)) removed").first()
    assert (got.n, got.removed) == (16_000, 0)


def test_a_copy_is_told_as_one_range(spark):
    """Ranges of neighbouring known pieces are put together where the document lies, so copies cost no row a piece."""
    text = " ".join(f"w{i * i % 9973}" for i in range(4000))
    owner, first, count, _, _ = suffix_dedup.pieces([text.encode(), text.encode()[:20000]])
    got = suffix_dedup._runs(owner, first, first + count - 1 + suffix_dedup.LENGTH)
    assert [x.tolist() for x in got] == [[0, 1], [0, 0], [len(text), 20000]]
    cut = [np.array(x) for x in ([0, 0, 0, 1], [0, 10, 200, 200], [60, 90, 260, 250])]
    assert [x.tolist() for x in suffix_dedup._runs(*cut)] == [[0, 0, 1], [0, 200, 200], [90, 260, 250]]
