import hashlib
import struct

import pytest
import zstandard

from scriptorium.llm import warc

LONG = "<p>a page of some length</p>" * 60
ROWS = [(1, "u1", LONG), (2, "u2", LONG), (2, "u2", LONG), (3, "u\r\n3", "short"), (4, None, "short"), (5, "u5", None), (6, "u6", ""), (None, "u", LONG), (7, "u7", "é🙂" * 40_000), (8, "u8", "\r\n\r\nWARC/1.1\r\n\r\n" * 90)]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "k", "d", 1, "p") for r in rows], "page_id long, url string, html string, key string, digest string, first int, payload string")


def expected(rows):
    first = {}
    for k, _, h in rows:
        if k is not None and len((h or "").encode()) >= 1000:
            first[h] = max(first.get(h, k), k)
    out = []
    for k, _, h in rows:
        b = (h or "").encode()
        f = first.get(h)
        revisit = f is not None and f != k
        out.append((k, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", f if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [16 << 20, 3000])
def test_round_trip(spark, limit):
    found = warc.read_archives(warc.write_archives(pages(spark, ROWS), archive_bytes_limit=limit)).collect()
    assert not [r.error for r in found if r.error]
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=repr) == expected(ROWS)
    texts = {k: h for k, _, h in ROWS}
    assert all(bytes(r.payload) == (texts[r.page_id] or "").encode() for r in found if r.record_type == "response")


def test_empty_table(spark):
    archives = warc.write_archives(pages(spark, []))
    assert archives.collect() == [] and warc.read_archives(archives).collect() == []


def records(n):
    texts = [f"page {k} " * (50 + k) for k in range(n)]
    return [warc.record_bytes(k, f"u{k}", t.encode(), hashlib.sha1(t.encode()).hexdigest(), None) for k, t in enumerate(texts)]


def test_layout_is_one_frame_per_record_after_the_dictionary():
    data = warc.archive_bytes(records(30))
    assert struct.unpack_from("<I", data)[0] == 0x184D2A5D
    at, frames = 0, 0
    while at < len(data):
        at = warc.frame_end(data, at)
        frames += 1
    assert at == len(data) and frames == 31
    assert [x[2]["page_id"] for x in warc.records(data)] == list(range(30))


def test_plain_dictionary_frame():
    """The dictionary may stand uncompressed in its frame."""
    rows = records(20)
    trained = zstandard.train_dictionary(2048, [bytes(x) for x in rows * 10])
    codec = zstandard.ZstdCompressor(dict_data=trained)
    body = trained.as_bytes()
    data = struct.pack("<II", 0x184D2A5D, len(body)) + body + b"".join(codec.compress(x) for x in rows)
    assert [x[2]["page_id"] for x in warc.records(data)] == list(range(20))


def test_damage_is_told_and_reading_goes_on():
    rows = records(10)
    data = bytearray(warc.archive_bytes(rows))
    places = [x[0] for x in warc.records(bytes(data))]
    data[places[4] + 20] ^= 0xFF
    found = list(warc.records(bytes(data)))
    assert len(found) == 10 and found[4][3] and not any(x[3] for i, x in enumerate(found) if i != 4)
    cut = list(warc.records(bytes(data[:-5])))
    assert cut[-1][3] and not cut[-2][3]


@pytest.mark.parametrize("change", [(b"WARC/1.1", b"HTTP/1.1"), (b"Content-Length: ", b"Content-Length: 9"), (b"page 1 page", b"page 2 page"), (b"WARC-Type:", b"WARC-Type")])
def test_invalid_records(change):
    raw = records(2)[1]
    assert warc.parse_record(raw)["page_id"] == 1
    with pytest.raises((ValueError, KeyError)):
        warc.parse_record(raw.replace(*change, 1))
