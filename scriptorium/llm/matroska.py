"""Matroska media columns: EBML elements, clusters, lacing and cues as packet tables.

A media column holds one Matroska file per row. ``encode_media`` stores bytes as 8-bit mono PCM
packets; ``packet_table`` and ``cue_table`` parse any such column into one row per packet or cue,
with the track, the timestamp in nanoseconds and the byte range within the file; ``media_features``
reads the samples back through those byte ranges.

Defined results: a null text is the empty text; the payload is never empty, as filler bytes 255 bring
it to a positive multiple of 576; a media value that is null or not Matroska has no packets, and its
``error`` says why; a file cut short yields the packets before the cut and an error; a very long text or
file is worked on whole, on its own. Only the key and
the named column are read, so further columns with any names do no harm; repeated rows and an empty
table give repeated rows and an empty table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.storage import slices, tidy

PACKET = 576
RATE = 48_000
PACKET_NS = PACKET * 1_000_000_000 // RATE
SCALE = 1_000_000  # nanoseconds per tick: timestamps in milliseconds
LACED = 8
BLOCKS_PER_CLUSTER = 64
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

# Element ids of the Matroska specification.
EBML, DOC_TYPE = 0x1A45DFA3, 0x4282
SEGMENT, INFO, TIMESTAMP_SCALE = 0x18538067, 0x1549A966, 0x2AD7B1
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK, BLOCK_DURATION = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB, 0x9B
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS}
VALUES = {TIMESTAMP, TIMESTAMP_SCALE, TRACK_NUMBER, DEFAULT_DURATION, CUE_TIME, CUE_TRACK, CUE_CLUSTER_POSITION, BLOCK_DURATION}
#: Elements whose start ends a cluster of unknown size.
TOP = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}


# --- writing -----------------------------------------------------------------------------------


def _size(n: int) -> bytes:
    """A data size as the shortest variable-length integer; all ones is reserved for unknown."""
    width = 1
    while n >= (1 << 7 * width) - 1:
        width += 1
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def _uint(ident: int, value: int) -> bytes:
    return _element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def _lace(frames: list[bytes], lacing: int) -> bytes:
    """The lacing head (frame count and all sizes but the last) and the frames."""
    if lacing == NO_LACING:
        return frames[0]
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if lacing == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == EBML_LACING and len(sizes) > 1:
        head += _size(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            width = 1
            while not -(1 << 7 * width - 1) < b - a < (1 << 7 * width - 1):
                width += 1
            head += (b - a + (1 << 7 * width - 1) - 1 | 1 << 7 * width).to_bytes(width, "big")
    return head + b"".join(frames)


_HEAD = _element(EBML, _uint(0x4286, 1) + _uint(0x42F7, 1) + _uint(0x42F2, 4) + _uint(0x42F3, 8) + _element(DOC_TYPE, b"matroska") + _uint(0x4287, 4) + _uint(0x4285, 2))
_INFO = _element(INFO, _uint(TIMESTAMP_SCALE, SCALE))
_TRACKS = _element(TRACKS, _element(TRACK_ENTRY, _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _element(CODEC_ID, b"A_PCM/INT/LIT") + _uint(DEFAULT_DURATION, PACKET_NS) + _element(AUDIO, _element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))))


def write_file(payload: bytes) -> bytes:
    """A Matroska file with a payload as PCM packets of 576 samples, eight to a block, lacing kinds in turn."""
    packets = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    blocks = [packets[i : i + LACED] for i in range(0, len(packets), LACED)]
    body, cues, tick = [_INFO, _TRACKS], [], 0
    at = len(_INFO) + len(_TRACKS)
    for c in range(0, len(blocks), BLOCKS_PER_CLUSTER):
        base, parts = c * LACED * PACKET_NS // SCALE, []
        for k, frames in enumerate(blocks[c : c + BLOCKS_PER_CLUSTER]):
            tick = (c + k) * LACED * PACKET_NS // SCALE - base
            lacing = (FIXED, XIPH, EBML_LACING)[k % 3] if len(frames) > 1 else NO_LACING
            parts.append(_element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", tick, 0x80 | lacing << 1) + _lace(frames, lacing)))
        cluster = _element(CLUSTER, _uint(TIMESTAMP, base) + b"".join(parts))
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, base) + _element(CUE_TRACK_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER_POSITION, at))))
        body.append(cluster)
        at += len(cluster)
    return _HEAD + _element(SEGMENT, b"".join(body) + _element(CUES, b"".join(cues)))


# --- reading -----------------------------------------------------------------------------------


def _vint(data: bytes, at: int, keep_marker: bool) -> tuple[int, int]:
    """A variable-length integer at a place and the place after it; -1 for an unknown size."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length integer at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError(f"integer cut short at byte {at}")
    value = int.from_bytes(data[at : at + width], "big")
    if keep_marker:
        return value, at + width
    value -= 1 << 7 * width
    return (-1 if value == (1 << 7 * width) - 1 else value), at + width


def elements(data: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[int, int, int, int]]:
    """The elements between two places, parents before children: id, depth, first byte of the content, byte after it."""
    stack: list[tuple[int, int]] = [(0, len(data) if end is None else end)]
    at = start
    while True:
        while len(stack) > 1 and at >= stack[-1][1]:
            stack.pop()
        if at >= stack[-1][1]:
            return
        ident, body = _vint(data, at, True)
        size, body = _vint(data, body, False)
        if ident in TOP and len(stack) > 1 and stack[-1][0] == CLUSTER:
            stack.pop()
        stop = stack[-1][1] if size < 0 else body + size
        if stop > len(data):
            if ident not in (SEGMENT, CLUSTER):
                raise ValueError(f"element {ident:X} at byte {at} is cut short")
        yield ident, len(stack) - 1, body, min(stop, len(data))
        if ident in MASTERS:
            stack.append((ident, min(stop, len(data))))
            at = body
        else:
            at = stop


def _frames(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """Byte ranges (first byte, length) of the frames of a block."""
    if lacing == NO_LACING:
        return [(at, end - at)]
    count, at, sizes = data[at] + 1, at + 1, []
    if lacing == FIXED:
        if (end - at) % count:
            raise ValueError(f"a fixed lace at byte {at} doesn't divide evenly")
        sizes = [(end - at) // count] * count
    else:
        for k in range(count - 1):
            if lacing == XIPH:
                n = 0
                while data[at] == 255:
                    n, at = n + 255, at + 1
                n, at = n + data[at], at + 1
            elif not k:
                n, at = _vint(data, at, False)
            else:
                raw, after = _vint(data, at, False)
                width = after - at
                n, at = sizes[-1] + (raw if raw >= 0 else (1 << 7 * width) - 1) - ((1 << 7 * width - 1) - 1), after
            sizes.append(n)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError(f"lace sizes at byte {at} go beyond the block")
    out = []
    for n in sizes:
        out.append((at, n))
        at += n
    return out


def parse(data: bytes | None) -> dict:
    """Packets (track, cluster, lacing, keyframe, timestamp_ns, offset, size), cues, and what went wrong, if anything.

    A block of a group is a keyframe unless the group refers to another block. Laced frames follow each
    other by their track's default duration or, without one, by their share of the block's duration.
    """
    packets, cues, error = [], [], None
    scale, durations, track, cluster, base, cue, segment = SCALE, {}, None, -1, 0, [0, 0], 0
    group: dict | None = None  # of the block group that is open

    def close() -> None:
        for first, last, number in group["blocks"]:
            step = durations.get(number) or (group["duration"] or 0) * scale // max(1, last - first)
            for k in range(first, last):
                t, c, lacing, _, at, o, n = packets[k]
                packets[k] = (t, c, lacing, not group["refers"], at + (k - first) * step, o, n)

    try:
        if not data or not data.startswith(EBML.to_bytes(4, "big")):
            raise ValueError("no EBML header")
        for ident, _, at, end in elements(data):
            if group is not None and at > group["end"]:
                close()
                group = None
            if ident in (SIMPLE_BLOCK, BLOCK):
                number, p = _vint(data, at, False)
                tick, flags = struct.unpack_from(">hB", data, p)
                lacing, first = flags >> 1 & 3, len(packets)
                step = durations.get(number, 0) if ident == SIMPLE_BLOCK or group is None else 0
                for k, (o, n) in enumerate(_frames(data, p + 3, end, lacing)):
                    packets.append((number, cluster, lacing, bool(flags & 0x80) or ident == BLOCK, (base + tick) * scale + k * step, o, n))
                if ident == BLOCK and group is not None:
                    group["blocks"].append((first, len(packets), number))
            elif ident == BLOCK_GROUP:
                group = {"end": end, "blocks": [], "refers": False, "duration": None}
            elif ident == REFERENCE_BLOCK and group is not None:
                group["refers"] = True
            elif ident in VALUES:
                value = int.from_bytes(data[at:end], "big")
                if ident == BLOCK_DURATION:
                    if group is not None:
                        group["duration"] = value
                elif ident == TIMESTAMP:
                    base = value
                elif ident == TIMESTAMP_SCALE:
                    scale = value
                elif ident == TRACK_NUMBER:
                    track = value
                elif ident == DEFAULT_DURATION:
                    durations[track] = value
                elif ident == CUE_TIME:
                    cue[0] = value
                elif ident == CUE_TRACK:
                    cue[1] = value
                else:
                    cues.append((cue[1], cue[0] * scale, segment + value))
            elif ident == CLUSTER:
                cluster += 1
            elif ident == SEGMENT:
                segment = at
    except (ValueError, IndexError, struct.error) as e:
        error = str(e)
    if group is not None:
        close()
    return {"packets": packets, "cues": cues, "error": error}


PACKET_FIELDS = ("track", "cluster", "lacing", "keyframe", "timestamp_ns", "offset", "size")


def _padded(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * ((-len(raw)) % PACKET if raw else PACKET)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, 1):
        media = pa.array([write_file(_padded(t)) for t in part.column(1).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([part.column(0), media], names=[part.schema.names[0], "media"])


def encode_media(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, media: each whole text as UTF-8, filled up with bytes 255, in a Matroska file."""
    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).cast("string").alias("text")).mapInArrow(tidy(_encode), f"{key} {kind}, media binary")


def _rows(kind: str):
    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, most_rows=64):
            found = [parse(x)[kind] for x in part.column(1).to_pylist()]
            index = pa.array(np.repeat(np.arange(part.num_rows), [len(x) for x in found]), pa.int64())
            flat = [r for x in found for r in x]
            if kind == "packets":
                types = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
                names = list(PACKET_FIELDS)
            else:
                types, names = (pa.int64(), pa.int64(), pa.int64()), ["track", "timestamp_ns", "cluster_offset"]
            columns = [pa.array([r[i] for r in flat], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([part.column(0).take(index), *columns], names=[part.schema.names[0], *names])

    return explode


def packet_table(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """One row per packet of each media value: track, cluster, lacing, keyframe, timestamp and byte range."""
    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(media).alias("media")).mapInArrow(tidy(_rows("packets")), f"{key} {kind}, track long, cluster int, lacing int, keyframe boolean, timestamp_ns long, offset long, size long")


def cue_table(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """One row per cue of each media value: track, time, and the byte at which its cluster begins."""
    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(media).alias("media")).mapInArrow(tidy(_rows("cues")), f"{key} {kind}, track long, timestamp_ns long, cluster_offset long")


def _feature(samples: np.ndarray, parsed: dict) -> str:
    x = samples.astype(np.int64) - 128
    shares = np.bincount(samples >> 5, minlength=8)
    packets = parsed["packets"]
    return f"packets={len(packets)} clusters={packets[-1][1] + 1 if packets else 0} cues={len(parsed['cues'])} last_ns={packets[-1][4] if packets else 0} sum={int(x.sum())} energy={int((x * x).sum())} crossings={int(np.count_nonzero(np.diff(x >= 0)))} bands={'/'.join(map(str, shares.tolist()))}"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, 1):
        out = []
        for x in part.column(1).to_pylist():
            parsed = parse(x)
            payload = b"".join([x[o : o + n] for *_, o, n in parsed["packets"]])
            samples = np.frombuffer(payload, np.uint8)
            media = x or b""
            out.append((len(payload.rstrip(b"\xff")), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), _feature(samples, parsed), len(parsed["packets"]), parsed["error"]))
        columns = list(zip(*out)) or [()] * 9
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=[part.schema.names[0], *FEATURES])


FEATURES = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_packets", "error")


def media_features(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """Digests and sample features of each media value, read back through its packets' byte ranges.

    UTF-8 holds no byte 255, so n_bytes, the payload without its filler, is exact.
    """
    kind = df.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_packets int, error string"
    return df.select(key, F.col(media).alias("media")).mapInArrow(tidy(_features), schema)
