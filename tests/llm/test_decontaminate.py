import random

import brute
import numpy as np
import pytest
from frames import ODD_ROWS, documents

from scriptorium.llm import decontaminate

ITEMS = [
    ("a", "the quick brown fox jumps over the lazy dog while seven wizards boil"),
    ("b", "Seven wizards boil STRANGE soup, near quiet harbours and"),
    ("c", "word"),
    ("d", None),
    ("e", " ... "),
    ("a", "one more thing"),
    (None, "été naïve 日本語 🙂"),
    ("f", "ab ab ab ab ab ab ab ab ab ab ab"),
]


def check(spark, rows, items, **options):
    benchmark = spark.createDataFrame([(*r, "x") for r in items], "item_id string, text string, key string")
    got = decontaminate.contamination(documents(spark, rows), benchmark, **options).collect()
    windows = {}
    for item, text in items:
        w = brute.words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item or "")
    sizes = {len(w) for w in windows}
    want = []
    for k, t in rows:
        w = brute.words(t)
        hit, names = [0] * len(w), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[i : i + n]))) is not None:
                    hit[i : i + n] = [1] * n
                    names |= x
        edges = [i for i in range(len(w) + 1) if (hit[i] if i < len(w) else 0) != (hit[i - 1] if i else 0)]
        want.append((k, len(w), tuple(zip(edges[::2], edges[1::2])), tuple(sorted(names))))
    assert sorted(((r[0], r.n_words, tuple((s["first"], s["last"]) for s in r.spans), tuple(r["items"])) for r in got), key=repr) == sorted(want, key=repr)


def test_odd_rows(spark):
    check(spark, ODD_ROWS, ITEMS)


def test_empty_tables(spark):
    check(spark, [], ITEMS)
    check(spark, ODD_ROWS, [])


@pytest.mark.parametrize("most_bits", [28, 15])
def test_random_texts(spark, most_bits):
    """Also with a filter that lets other shingles through."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(12)]
    text = lambda least, most: " ".join(rng.choice(words) for _ in range(rng.randint(least, most)))
    items = [(f"i{k}", text(0, 14)) for k in range(25)]
    rows = []
    for k in range(80):
        parts = [text(0, 40)]
        if k % 3 == 0:
            parts += [rng.choice(items)[1], text(0, 20)]
        rows.append((k, " ".join(parts)))
    check(spark, rows, items, most_bits=most_bits)


def test_rows_stay_apart(spark):
    """Repeated rows, null keys, and rows of one key with different texts of as many words."""
    clean, dirty = " ".join(f"c{i}" for i in range(13)), ITEMS[0][1]
    rows = [*ODD_ROWS, (2, clean), (2, dirty), (None, clean), (None, dirty), (None, clean), (20, "word " + clean)]
    check(spark, rows, ITEMS)


def test_copies_of_an_item(spark):
    check(spark, ODD_ROWS, [ITEMS[0]] * 50 + [("z", ITEMS[0][1])])


def test_a_larger_benchmark(spark):
    """Many items, of which some share most windows, and a passage that most documents hold."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    hot = text(40)
    items = [(f"i{k}", " ".join(text(rng.randint(5, 60)) + (hot if k % 5 == 0 else []))) for k in range(400)]
    rows = [(k, " ".join(text(30) + (hot[k % 7 :] if k % 4 else items[k % 400][1].split()[: 5 + k % 30]) + text(5))) for k in range(300)]
    check(spark, rows, items)


def test_filter_holds_all_shingles(spark):
    known = np.random.default_rng(1).integers(-(1 << 63), (1 << 63) - 1, 5000)
    held, bits = decontaminate._filter(spark.createDataFrame([(int(x),) for x in known], "shingle long"), 28)
    for place in decontaminate._places(known.astype(np.uint64), bits):
        assert (held[place >> 3] >> (place & 7).astype(np.uint8) & 1).all()
    assert np.unpackbits(held).mean() < 0.2
