import zlib
from array import array

import pytest
from frames import ODD_ROWS, documents
from tokenizers import Tokenizer

from scriptorium.llm import packing
from scriptorium.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))


def ids_of(tokenizer, text, end):
    return array("I", [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]).tobytes()


def check(sequences, rows, tokenizer, length=2048):
    """Every id lies in one piece, sequences are gapless, and the pieces read back are those of the packed ids."""
    want = sorted((k is None, k or 0, ids_of(tokenizer, t, 1)) for k, t in rows)
    packed = {r.sequence_id: r for r in sequences.collect()}
    got = packing.pieces(sequences).collect()
    assert len(got) == sum(len(r.pieces) for r in packed.values())
    texts, placed = {}, {}
    for r in got:
        ids = bytes(packed[r.sequence_id].ids[4 * r.offset : 4 * (r.offset + r.length)])
        assert zlib.crc32(ids) == r.ids_crc32 and len(ids) == 4 * r.length
        texts.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, ids))
        placed.setdefault(r.sequence_id, []).append((r.offset, r.length))
    found = []
    for (k, n), parts in texts.items():
        # rows of one key and length may be repeated
        starts = sorted({s for s, _ in parts})
        copies = len(parts) // len(starts)
        by_start = {s: sorted(x for t, x in parts if t == s) for s in starts}
        for c in range(copies):
            whole = b"".join(by_start[s][c] for s in starts)
            assert len(whole) == 4 * n
            found.append((k is None, k or 0, whole))
    assert sorted(found) == want
    assert placed.keys() == packed.keys()
    for k, parts in placed.items():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= length and len(packed[k].ids) == 4 * at
    return len(packed), sum(r.length for r in got)


def test_odd_rows(spark, tokenizer):
    rows = [r for r in ODD_ROWS]
    check(packing.pack(documents(spark, rows)), rows, tokenizer)


def test_empty_table(spark):
    assert packing.pack(documents(spark, [])).collect() == []


@pytest.mark.parametrize("open_windows", [1, 4, 256])
def test_many_partitions_merge(spark, tokenizer, open_windows):
    rows = [(k, f"text number {k} says this " * (k * 37 % 61)) for k in range(400)]
    got = packing.pack(documents(spark, rows).repartition(40), open_windows=open_windows)
    sequences, total = check(got, rows, tokenizer)
    if open_windows == 256:
        assert sequences == -(-total // 2048) or total / (2048 * sequences) > 0.97


def test_packer_emits_the_fullest():
    p = packing.Packer(10, 2)
    assert p.add(6, "a") is None and p.add(7, "b") is None
    assert p.add(3, "c") == ["b", "c"]  # best fit fills b's window
    assert p.add(5, "d") is None
    assert p.add(8, "e") == ["a"]  # none holds it: the fullest goes
    assert p.add(10, "f") == ["f"]
    assert sorted(p.rest()) == [["d"], ["e"]]


def test_query_over_a_table(spark, tokenizer):
    """op8 against the tokenizer over the whole smallest table."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    ids = {r.doc_id: ids_of(tokenizer, r.text, 1) for r in rows}
    got, held = {}, {}
    for r in QUERIES["op8_packing"](spark, SF).collect():
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)]) and r.doc_tokens == len(ids[r.doc_id]) // 4
        got.setdefault(r.doc_id, []).append((r.start, r.length))
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for k, x in ids.items():
        assert sum(n for _, n in got[k]) == len(x) // 4 and [s for s, _ in sorted(got[k])] == list(range(0, len(x) // 4, 2048))
    for parts in held.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:])) and sum(n for _, n in parts) <= 2048
