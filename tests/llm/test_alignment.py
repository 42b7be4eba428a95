"""Alignment of two tokenizers: ids, groups and links against a plain version over whole texts."""

import hashlib
from collections import Counter

import pytest
from frames import ODD_ROWS, documents
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm import alignment
from scriptorium.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
OWN = alignment.Aligner(most_units=0)
PARTS = [" ", "  ", "\n", "\t", "\r\n", "a", "the", "é", "é", "日本", "🙂", "'s", "'", "▁", " ", "　", " ", "\x1c", "\x00", "﻿", "½", "ﬁ"]
PARTS += ["<|endoftext|>", "<s>", "<unk>", "<0x0A>", "12", ",", ".", "!!", "$$$", "|", "ing", "A", "{", "}", ");"]


def plain(text):
    """Ids of A and B over the whole text, groups as text, and all links; None without tokens."""
    if not text:
        return None
    ids = OWN.a.encode(" " + text, add_special_tokens=False).ids, OWN.b.encode(text)
    names = [[known[i] for i in x] for known, x in zip((OWN.a_bytes, OWN.b_bytes), ids)]
    if any(b"".join(x) != (" " + text).encode() for x in names):
        return None
    ends = []
    for x in names:
        at, own = 0, []
        for piece in x:
            at += len(piece)
            own.append(at)
        ends.append(own)
    groups, links, i, j, from_i, from_j = [], [], 0, 0, 0, 0
    while i < len(ends[0]):
        links.append((ids[0][i], ids[1][j]))
        p, q = ends[0][i], ends[1][j]
        i, j = i + (p <= q), j + (q <= p)
        if p == q:
            groups.append(",".join(map(str, ids[0][from_i:i])) + "|" + ",".join(map(str, ids[1][from_j:j])))
            from_i, from_j = i, j
    return len(ids[0]), len(ids[1]), groups, links


def wanted(rows):
    found = [(k, plain(t)) for k, t in rows]
    times = Counter(x for _, p in found if p for x in p[3])
    most = {}
    for (_, b), n in times.items():
        most[b] = max(n, most.get(b, 0))
    out = []
    for k, p in found:
        if not p:
            out.append((k, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = p
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((k, n_a, n_b, len(groups), len(links), sum(times[x] == most[x[1]] for x in links), sum(times[x] for x in links), digest))
    return sorted(out, key=repr)


def test_units_are_used():
    assert OWN.parts and (OWN.identity >= 0).sum() > 10_000
    assert all(OWN.a_bytes[a] == OWN.b_bytes[b] for a, b in enumerate(OWN.identity.tolist()) if b >= 0)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=14).map("".join), min_size=1, max_size=4))
def test_units_give_the_ids_of_whole_texts(texts):
    import numpy as np

    owner, seq = OWN.sequence([" " + t if t else "" for t in texts])
    for k, t in enumerate(texts):
        mine = seq[owner == k]
        want = plain(t)
        if len(mine) == 0 or set(mine.tolist()) & OWN.broken:
            assert want is None
            continue
        assert b"".join(OWN.strings[i] for i in mine)[:-1].decode() == ";".join(want[2])
        ids, pairs = OWN.ids.take(mine)[0], OWN.odd.take(mine)[0]
        links = [(a, int(OWN.identity[a])) for a in ids.tolist()] + [(p >> alignment.B_BITS, p & (1 << alignment.B_BITS) - 1) for p in pairs.tolist()]
        assert Counter(links) == Counter(want[3])
        four = OWN.counts.values[: 4 * OWN.counts.rows].reshape(-1, 4)[mine].sum(0)
        assert four.tolist() == [want[0], want[1], len(want[2]), len(want[3])] and np.all(four >= 0)


@pytest.mark.parametrize("hot", [0, 3, alignment.HOT_PAIRS])
def test_rows_of_all_kinds(spark, hot):
    rows = [*ODD_ROWS, (20, "a ▁ b"), (21, " "), (22, "x\r\ny"), (23, "word, word. (word)"), (24, "<|endoftext|> </s>")]
    got = alignment.alignment(documents(spark, rows), hot_pairs=hot)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == wanted(rows)


def test_empty_tables_and_texts(spark):
    assert alignment.alignment(documents(spark, [])).collect() == []
    assert [tuple(r) for r in alignment.alignment(documents(spark, [(1, None)])).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_units_are_forgotten_without_losing_counts(spark, monkeypatch):
    monkeypatch.setattr(alignment, "MOST_UNITS", 1)
    own = alignment.Aligner(most_units=3)
    sums = alignment._Sums(own)
    rows = [(k, f"word number {k % 5} here") for k in range(20)]
    for _, t in rows:
        if len(own.known) > own.most:
            sums.take_in()
            own.forget()
        alignment._document_rows(own, sums, [t])
    sums.take_in()
    links = Counter(x for _, t in rows for x in plain(t)[3])
    assert sums.vector.sum() + sums.times.sum() == sum(links.values())


def test_query_equals_a_plain_version(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in QUERIES["op12_alignment"](spark, SF).collect()), key=repr) == wanted(rows)
