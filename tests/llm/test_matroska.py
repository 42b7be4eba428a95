import hashlib
import struct
import zlib

import pytest
from frames import ODD_ROWS, documents

from scriptorium.llm import matroska as m
from scriptorium.llm.queries import QUERIES


def test_features_read_the_texts_back(spark):
    got = m.media_features(m.encode_media(documents(spark, ODD_ROWS))).collect()
    assert len(got) == len(ODD_ROWS)
    want = []
    for k, t in ODD_ROWS:
        raw = (t or "").encode()
        padded = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        want.append((k, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:])))
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.error is None and r.payload_bytes == 576 * r.n_packets for r in got)


def test_empty_table(spark):
    media = m.encode_media(documents(spark, []))
    assert m.media_features(media).collect() == m.packet_table(media).collect() == m.cue_table(media).collect() == []


def test_packet_and_cue_tables(spark):
    text = "".join(chr(97 + k % 26) for k in range(700_000))
    media = m.encode_media(documents(spark, [(1, text)]))
    data = bytes(media.first().media)
    packets = sorted(m.packet_table(media).collect(), key=lambda r: r.offset)
    assert b"".join(data[r.offset : r.offset + r.size] for r in packets).rstrip(b"\xff").decode() == text
    assert {r.lacing for r in packets} == {m.FIXED, m.XIPH, m.EBML_LACING}
    assert all(b.timestamp_ns - a.timestamp_ns == m.PACKET_NS for a, b in zip(packets, packets[1:]))
    cues = m.cue_table(media).collect()
    assert len(cues) == 1 + max(r.cluster for r in packets) > 1
    for c in cues:
        assert data[c.cluster_offset : c.cluster_offset + 4] == m.CLUSTER.to_bytes(4, "big")
        first = min(r.timestamp_ns for r in packets if r.offset > c.cluster_offset)
        assert first == c.timestamp_ns


def block(lacing, frames, tick=0, track=b"\x81"):
    return track + struct.pack(">hB", tick, 0x80 | lacing << 1) + m._lace(frames, lacing)


@pytest.mark.parametrize("lacing", [m.XIPH, m.EBML_LACING])
@pytest.mark.parametrize("sizes", [[1], [255, 255, 1], [254, 600, 0, 510, 3], [5000, 1, 70_000, 2]])
def test_lacing_of_unequal_frames(lacing, sizes):
    frames = [bytes([k + 1]) * n for k, n in enumerate(sizes)]
    cluster = m._element(m.CLUSTER, m._uint(m.TIMESTAMP, 7) + m._element(m.SIMPLE_BLOCK, block(lacing, frames)))
    data = m._HEAD + m._element(m.SEGMENT, m._INFO + m._TRACKS + cluster)
    found = m.parse(data)
    assert found["error"] is None and [data[p[5] : p[5] + p[6]] for p in found["packets"]] == frames


def test_unknown_sizes_and_block_groups():
    unknown = b"\x01" + b"\xff" * 7
    group = m._element(m.BLOCK_GROUP, m._element(m.BLOCK, block(m.NO_LACING, [b"abc"], 5)))
    cluster = lambda t: m.CLUSTER.to_bytes(4, "big") + unknown + m._uint(m.TIMESTAMP, t) + group
    data = m._HEAD + m.SEGMENT.to_bytes(4, "big") + unknown + m._INFO + m._TRACKS + cluster(10) + cluster(20)
    found = m.parse(data)
    assert found["error"] is None
    assert [(p[1], p[4]) for p in found["packets"]] == [(0, 15_000_000), (1, 25_000_000)]


def in_group(*parts):
    cluster = m._element(m.CLUSTER, m._uint(m.TIMESTAMP, 10) + m._element(m.BLOCK_GROUP, b"".join(parts)) + m._element(m.SIMPLE_BLOCK, b"\x82" + struct.pack(">hB", 9, 0) + b"z"))
    return m.parse(m._HEAD + m._element(m.SEGMENT, m._INFO + cluster))


def test_references_and_durations_of_block_groups():
    frames = m._element(m.BLOCK, block(m.FIXED, [b"abc", b"def", b"ghi"], 2))
    duration, refers = m._uint(m.BLOCK_DURATION, 6), m._element(m.REFERENCE_BLOCK, b"\xfb")
    times = [12_000_000, 14_000_000, 16_000_000]
    for parts, keyframe in (([frames, duration], True), ([duration, frames], True), ([frames, refers, duration], False), ([refers, duration, frames], False)):
        found = in_group(*parts)
        assert found["error"] is None
        assert [(p[3], p[4]) for p in found["packets"]] == [(keyframe, t) for t in times] + [(False, 19_000_000)]
    assert [p[4] for p in in_group(frames)["packets"]] == [12_000_000] * 3 + [19_000_000]


def test_query_over_a_table(spark):
    """op1 against the texts of the whole smallest table."""
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in QUERIES["op1_matroska"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for k, t in rows:
        raw = (t or "").encode()
        padded = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        media = m.write_file(padded)
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
        assert (r.media_bytes, r.media_sha256, r.n_packets) == (len(media), hashlib.sha256(media).hexdigest(), len(padded) // 576)


def test_damaged_media(spark):
    data = m.write_file(b"x" * 576 * 40)
    rows = [(1, None), (2, b""), (3, b"no media"), (4, data[:-3000]), (5, data)]
    df = spark.createDataFrame(rows, "doc_id long, media binary")
    got = {r.doc_id: r for r in m.media_features(df).collect()}
    assert all(got[k].error and not got[k].payload_bytes for k in (1, 2, 3))
    assert got[4].error and 0 < got[4].payload_bytes < 576 * 40
    assert got[5].error is None and got[5].payload_bytes == 576 * 40
    assert {r.doc_id for r in m.packet_table(df).collect()} == {4, 5}
