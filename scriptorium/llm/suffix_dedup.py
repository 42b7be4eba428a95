"""Removal of byte strings that an earlier document has, by suffix arrays.

A byte goes if a 50-byte string that covers it also starts in a document with a smaller key. Three
filters bring together only what can match; suffix arrays decide, except for whole pieces that have the
same anchor and the same 63-bit hash (step 2): they count as one text that several documents hold, and go
without a comparison of bytes. Two different pieces pass for one with a probability of 2 ** -63 for each
pair of different pieces of one anchor: in 100 TB there are some 10 ** 14 such pairs, so a wrong removal
has a chance of about one in 100,000.

1. Every 50-byte string (window) is assigned to the least 16-byte hash in it, its anchor; the strings of
   one anchor in a row form a piece of at most 84 bytes. Equal windows have equal anchors. Anchor and
   piece hashes go, packed, to the anchor's bucket (those of equal pieces of one task once).
2. There a piece that a smaller key has too is *known*: all its windows go. Anchors with one piece only
   are done. Of the other pieces one holder each is *asked* for its bytes; verdicts return to the
   documents.
3. The asked pieces of an anchor meet. Windows whose hash occurs in one of them only are cut off; the
   rest goes, each distinct text once, into a suffix array (see lyndon.py). Equal windows are neighbours
   in it; compared byte by byte, each run of equal ones gives its least key, and the windows of larger
   keys go.
4. An anchor with more than GROUP_BYTES of asked pieces is decided in two steps. Where its pieces lie they
   go, some ARRAY_BYTES at once, into suffix arrays; what no smaller key of the same array has is dealt
   anew, each window by its hash, and meets the other arrays' windows of that hash. Equal windows still
   meet, and a window that all documents have comes once from each array.

Texts cross the network twice, compressed; everything else is hashes. A hot passage is reduced to one
row per task before any shuffle.

Keys must be whole numbers (an error says so), as documents are ranked by them.

Defined results: a null text is empty; texts under 50 bytes stay whole; a very long text is worked on
whole, on its own; matches never cross documents;
rows of one key never remove from each other; a null key counts as larger than all others; an empty
table gives no rows; columns that aren't named are ignored.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.lyndon import suffix_array
from scriptorium.llm.storage import slices, staged, tidy
from scriptorium.llm.text import _BYTE, mix

LENGTH, ANCHOR = 50, 16
SPAN = LENGTH - ANCHOR + 1
FLUSH_PIECES, ARRAY_BYTES, GROUP_BYTES = 600_000, 128 << 10, 1 << 20
NONE = np.iinfo(np.int64).max  # stands for a null key
#: Bytes that one suffix array has, unless one group has more.
SUFFIXES = 8 << 10
ODD = np.uint64(0x9E3779B97F4A7C15)


def _doubled(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all 16-byte and all 32-byte strings."""
    h, n, out = _BYTE[data], 1, []
    while n < 32:
        h = mix(h[:-n] * ODD + h[n:] + np.uint64(n))
        n *= 2
        out.append(h)
    return out[-2], out[-1]


def _window_hashes(h16: np.ndarray, h32: np.ndarray) -> np.ndarray:
    n = len(h32) - (LENGTH - 32)
    return mix(h32[:n] * ODD + h32[LENGTH - 32 :][:n])


def pieces(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """The pieces of some texts: number of the text, first window, windows, anchor hash, piece hash."""
    at = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < LENGTH:
        z = np.empty(0, np.int64)
        return z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    h16, h32 = _doubled(data)
    least, n = h16, 1
    while 2 * n <= SPAN:
        least = np.minimum(least[:-n], least[n:])
        n *= 2
    windows = len(data) - LENGTH + 1
    least = np.minimum(least[:windows], least[SPAN - n :][:windows])
    owner = np.repeat(np.arange(len(texts)), np.diff(at))[:windows]
    valid = np.arange(windows) + LENGTH <= at[owner + 1]
    new = np.ones(windows, bool)
    new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new)
    place = np.arange(windows) - first[np.cumsum(new) - 1]
    new |= place % SPAN == 0
    first = np.flatnonzero(new & valid)
    ends = np.minimum(np.append(np.flatnonzero(new), windows)[np.searchsorted(np.flatnonzero(new), first) + 1], at[owner[first] + 1] - LENGTH + 1)
    count = ends - first
    stop = ends - 1 + LENGTH
    whole = mix(mix(h32[first] * ODD + h32[np.minimum(first + 26, stop - 32)]) * ODD + h32[stop - 32] + count.astype(np.uint64))
    return owner[first], first - at[owner[first]], count, least[first], whole & ~np.uint64(1)


def _utf8(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _keys(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column, NONE).to_numpy(zero_copy_only=False)


def _pack(**arrays: np.ndarray) -> bytes:
    """Arrays of one length (or lengths of their own) as bytes with a JSON head."""
    head = json.dumps([[k, x.dtype.str, len(x)] for k, x in arrays.items()]).encode()
    return len(head).to_bytes(4, "little") + head + b"".join(x.tobytes() for x in arrays.values())


def _unpack(raw: bytes) -> dict[str, np.ndarray]:
    n = int.from_bytes(raw[:4], "little")
    at, out = 4 + n, {}
    for k, kind, size in json.loads(raw[4 : 4 + n]):
        out[k] = np.frombuffer(raw, np.dtype(kind), size, at)
        at += out[k].nbytes
    return out


def _pack_keys(keys: np.ndarray) -> dict[str, np.ndarray]:
    """Keys as 32-bit distances from the least, where they fit."""
    if not len(keys):
        return {"key": keys}
    real = keys[keys != NONE]
    least = real.min() if len(real) else 0
    if len(real) == len(keys) and int(real.max()) - int(least) < 1 << 32:
        return {"base": np.array([least]), "near": (keys - least).astype(np.uint32)}
    return {"key": keys}


def _unpack_keys(x: dict[str, np.ndarray]) -> np.ndarray:
    return x["key"] if "key" in x else x["near"].astype(np.int64) + x["base"][0]


def _pack_anchors(anchors: np.ndarray) -> dict[str, np.ndarray]:
    """The lower 40 bits, as the bucket tells most of the others. Anchors that fall together by that only have more pieces asked for."""
    return {"low": anchors.astype(np.uint32), "high": (anchors >> np.uint64(32)).astype(np.uint8)}


def _unpack_anchors(x: dict[str, np.ndarray]) -> np.ndarray:
    return x["a_low"].astype(np.uint64) | x["a_high"].astype(np.uint64) << np.uint64(32)


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Marks the rows of sorted columns that differ from the row before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


MESSAGE = "bucket int, payload binary"


def _messages(buckets: np.ndarray, rows: dict[str, np.ndarray], kind: str) -> list[tuple[int, bytes]]:
    order = np.argsort(buckets, kind="stable")
    buckets = buckets[order]
    starts = np.flatnonzero(_firsts(buckets))
    out = []
    for u, v in zip(starts.tolist(), [*starts[1:].tolist(), len(buckets)]):
        k = order[u:v]
        out.append((int(buckets[u]), _pack(**{f"{kind}_{n}": x[k] for n, x in rows.items() if n != "key"}, **{f"{kind}_{n}": x for n, x in _pack_keys(rows["key"][k]).items()})))
    return out


def _message_batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "payload"])


def _bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)


def _key_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(keys.astype(np.uint64) * ODD) % np.uint64(buckets)).astype(np.int32)


def _announce(buckets: int):
    """Anchor and piece hashes of documents, for the anchors' buckets. Pieces that a task has twice stay home but for the least key: they are known."""

    def flush(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key, anchor, piece = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((key, piece, anchor))
        key, anchor, piece = key[order], anchor[order], piece[order]
        new = _firsts(anchor, piece)
        least = key[new][np.cumsum(new) - 1]
        known = key > least
        rows = _messages(_bucket_of(anchor[new], buckets), {"key": key[new], **_pack_anchors(anchor[new]), "piece": piece[new]}, "a")
        if known.any():
            k, p = key[known], piece[known]
            rows += _messages(_key_bucket(k, buckets), {"key": k, "piece": p}, "k")
        return _message_batch(rows)

    def announce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in slices(batches, 1):
            owner, _, _, anchor, piece = pieces(_utf8(part.column(1)))
            if len(owner):
                held.append((_keys(part.column(0))[owner], anchor, piece))
                size += len(owner)
            if size >= FLUSH_PIECES:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return announce


def _runs_by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    current, held = None, []
    for b in batches:
        for bucket, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if bucket != current and held:
                yield current, held
                held = []
            current = bucket
            held.append(payload)
    if held:
        yield current, held


def _verdicts(buckets: int):
    """For each key, its pieces that are known (lowest bit 0) and those it is asked for (1)."""

    def flush(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        key, piece = (np.concatenate(x) for x in zip(*held))
        return _message_batch(_messages(_key_bucket(key, buckets), {"key": key, "piece": piece}, "v"))

    def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, payloads in _runs_by_bucket(batches):
            parts = [_unpack(p) for p in payloads]
            announced = [p for p in parts if "a_piece" in p]
            held += [(_unpack_keys({n[2:]: x for n, x in p.items() if n[0] == "k"}), p["k_piece"]) for p in parts if "k_piece" in p]
            if announced:
                anchor, piece = np.concatenate([_unpack_anchors(p) for p in announced]), np.concatenate([p["a_piece"] for p in announced])
                key = np.concatenate([_unpack_keys({n[2:]: x for n, x in p.items() if n[0] == "a"}) for p in announced])
                order = np.lexsort((key, piece, anchor))
                key, anchor, piece = key[order], anchor[order], piece[order]
                new = _firsts(anchor, piece)
                least = key[new][np.cumsum(new) - 1]
                known = key > least
                # holders of the distinct pieces of anchors that documents of different keys have
                a, p, k = anchor[new], piece[new], key[new]
                group = np.flatnonzero(_firsts(a))
                low, high = np.minimum.reduceat(k, group), np.maximum.reduceat(k, group)
                asked = np.repeat(low < high, np.diff(np.append(group, len(a))))
                held += [(key[known], piece[known]), (k[asked], p[asked] | np.uint64(1))]
            size = sum(len(k) for k, _ in held)
            if size >= FLUSH_PIECES:
                yield flush(held)
                held = []
        if size:
            yield flush(held) if held else _message_batch([])

    return verdicts


def _blobs(buckets: int):
    """Documents by key bucket, compressed: keys (null as the largest), text hashes, lengths and texts."""

    def blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = zstandard.ZstdCompressor(level=1)
        for b in batches:
            for part in (b.slice(i, 4096) for i in range(0, b.num_rows, 4096)):
                keys, hashes, texts = _keys(part.column(0)), part.column(2).to_numpy(zero_copy_only=False), _utf8(part.column(1))
                bucket = _key_bucket(keys, buckets)
                rows = []
                for k in np.unique(bucket).tolist():
                    at = np.flatnonzero(bucket == k)
                    own = [texts[i] for i in at.tolist()]
                    raw = _pack(d_key=keys[at], d_hash=hashes[at], d_size=np.array([len(x) for x in own], np.int64))
                    rows.append((k, len(raw).to_bytes(4, "little") + raw + codec.compress(b"".join(own))))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array(np.ones(len(rows), np.int8)), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "kind", "payload"])

    return blobs


def _documents(blob: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    n = int.from_bytes(blob[:4], "little")
    head, raw = _unpack(blob[4 : 4 + n]), zstandard.ZstdDecompressor().decompress(blob[4 + n :])
    at = np.cumsum(np.append(0, head["d_size"])).tolist()
    return head["d_key"], head["d_hash"], [raw[u:v] for u, v in itertools.pairwise(at)]


def _by_bucket(docs: DataFrame, messages: DataFrame, buckets: int, partitions: int) -> DataFrame:
    """Messages (kind 0) before the documents (kind 1) of each bucket."""
    texts = docs.mapInArrow(tidy(_blobs(buckets)), "bucket int, kind byte, payload binary")
    told = messages.select("bucket", F.lit(0).cast("byte").alias("kind"), "payload")
    return told.unionByName(texts).repartition(partitions, "bucket").sortWithinPartitions("bucket", "kind")


def _bucket_messages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[dict], bytes]]:
    """(messages of the bucket, document blob) for each blob."""
    current, told = None, []
    for b in batches:
        for bucket, kind, payload in zip(*(c.to_pylist() for c in b.columns)):
            if bucket != current:
                current, told = bucket, []
            if kind == 0:
                told.append(_unpack(payload))
            else:
                yield told, payload


#: firsts holds every place, as 64-bit integers, at which the document has the piece.
RANGES = "bucket int, payload binary, anchor long, key long, hash long, firsts binary, text binary"


def _lookup(keys: np.ndarray, values: np.ndarray):
    """A function that tells which (key, value) pairs are among these, which are sorted by key, then value."""
    some_keys, some_values = np.unique(keys), np.unique(values)
    pairs = np.searchsorted(some_keys, keys) * len(some_values) + np.searchsorted(some_values, values)

    def among(k: np.ndarray, v: np.ndarray) -> np.ndarray:
        i = np.minimum(np.searchsorted(some_keys, k), len(some_keys) - 1)
        j = np.minimum(np.searchsorted(some_values, v), len(some_values) - 1)
        at = np.minimum(np.searchsorted(pairs, i * len(some_values) + j), len(pairs) - 1)
        return (some_keys[i] == k) & (some_values[j] == v) & (pairs[at] == i * len(some_values) + j)

    return among


def _runs(owner: np.ndarray, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of some texts, in order, with those that touch put together: a copy gives one range, not one a piece."""
    new = np.ones(len(first), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (first[1:] > stop[:-1])
    return owner[new], first[new], stop[np.append(new[1:], True)]


def _answers(buckets: int):
    """Known pieces as byte ranges for the documents, and the texts of the asked pieces."""

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, keys, values = None, np.empty(0, np.int64), np.empty(0, np.uint64)
        for told, blob in _bucket_messages(batches):
            if told is not last:
                last = told
                keys = np.concatenate([_unpack_keys({n[2:]: x for n, x in m.items()}) for m in told]) if told else np.empty(0, np.int64)
                values = np.concatenate([m["v_piece"] for m in told]) if told else np.empty(0, np.uint64)
                order = np.lexsort((values, keys))
                keys, values = keys[order], values[order]
                told_of = _lookup(keys, values)
            if not len(keys):
                continue
            doc_keys, hashes, texts = _documents(blob)
            out: list[tuple] = []
            ranges: list[tuple[np.ndarray, ...]] = []
            low, high = np.searchsorted(keys, doc_keys), np.searchsorted(keys, doc_keys, "right")
            some = np.flatnonzero(high > low)
            if not len(some):
                continue
            owner, first, count, anchor, piece = pieces([texts[i] for i in some.tolist()])
            owner = some[owner]
            known = told_of(doc_keys[owner], piece)
            if known.any():
                i, u, v = _runs(owner[known], first[known], first[known] + count[known] - 1 + LENGTH)
                ranges.append((doc_keys[i], hashes[i], u, v))
            at = np.flatnonzero(told_of(doc_keys[owner], piece | np.uint64(1)))
            at = at[np.lexsort((piece[at], owner[at]))]
            starts = np.flatnonzero(_firsts(owner[at], piece[at])) if len(at) else at
            for low_at, high_at in zip(starts.tolist(), [*starts[1:].tolist(), len(at)]):
                j = at[low_at]
                i, f = int(owner[j]), int(first[j])
                places = first[at[low_at:high_at]].astype(np.int64).tobytes()
                out.append((int(anchor[j].astype(np.int64)), int(doc_keys[i]), int(hashes[i]), places, texts[i][f : f + int(count[j]) - 1 + LENGTH]))
            if ranges:
                key, digest, u, v = (np.concatenate(x) for x in zip(*ranges))
                rows = _messages(_key_bucket(key, buckets), {"key": key, "hash": digest, "first": u, "last": v}, "r")
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), *(pa.nulls(len(rows), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=[c.split()[0] for c in RANGES.split(", ")])
            if out:
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.nulls(len(out), pa.int32()), pa.nulls(len(out), pa.binary()), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())))], names=[c.split()[0] for c in RANGES.split(", ")])

    return answers


def repeated_windows(groups: list[tuple[int, bytes, int]]) -> list[np.ndarray]:
    """For each (key, text, group): which of its 50-byte windows a text of its group with a smaller key has.

    Suffix arrays over the distinct texts' windows that may repeat, whole groups at a time.
    """
    flags = [np.zeros(len(t) - LENGTH + 1, bool) for _, t, _ in groups]
    # windows whose hash one text of the group alone has are cut off
    data = np.frombuffer(b"".join(t for _, t, _ in groups), np.uint8)
    sizes = np.array([len(t) for _, t, _ in groups])
    at = np.cumsum(np.append(0, sizes))
    h16, h32 = _doubled(data)
    hashes = _window_hashes(h16, h32)
    owner = np.repeat(np.arange(len(groups)), sizes)[: len(hashes)]
    where = np.flatnonzero(np.arange(len(hashes)) + LENGTH <= at[owner + 1])
    group = np.array([g for _, _, g in groups])
    h, o = hashes[where] + group[owner[where]].astype(np.uint64) * ODD, owner[where]
    order = np.lexsort((o, h))
    new = _firsts(h[order])
    starts = np.flatnonzero(new)
    several = np.minimum.reduceat(o[order], starts) < np.maximum.reduceat(o[order], starts)
    kept = np.zeros(len(hashes) + 1, bool)
    kept[where[order[several[np.cumsum(new) - 1]]]] = True
    # maximal runs of windows left, each distinct text once
    edge = np.flatnonzero(kept & ~np.concatenate([[False], kept[:-1]]) | kept & np.concatenate([[True], owner[1:] != owner[:-1], [True]]))
    texts: dict[int, dict[bytes, list[tuple[int, int, int]]]] = {}
    stops = np.flatnonzero(~kept)
    ends = stops[np.searchsorted(stops, edge)]  # the first window after each run that is cut off or in another text
    owners = owner[edge]
    ends = np.minimum(ends, at[owners + 1] - LENGTH + 1)
    for u, v, i in zip(edge.tolist(), ends.tolist(), owners.tolist()):
        place = u - int(at[i])
        raw = groups[i][1][place : v - int(at[i]) - 1 + LENGTH]
        texts.setdefault(groups[i][2], {}).setdefault(raw, []).append((groups[i][0], i, place))
    # groups are apart, so they are dealt to several small arrays, which are faster than a large one
    part: list[dict[bytes, list[tuple[int, int, int]]]] = []
    size = 0
    for of_group in texts.values():
        if size and size + sum(map(len, of_group)) > SUFFIXES:
            _decide_windows(part, flags)
            part, size = [], 0
        part.append(of_group)
        size += sum(map(len, of_group))
    if part:
        _decide_windows(part, flags)
    return flags


def _decide_windows(groups: list[dict[bytes, list[tuple[int, int, int]]]], flags: list[np.ndarray]) -> None:
    """One suffix array over the distinct texts of some groups; sets the flags of the windows that a smaller key has."""
    begin, least, of_group, parts = [], [], [], []
    at = 0
    for g, texts in enumerate(groups):
        for raw, holders in texts.items():
            begin.append(at)
            least.append(min(h[0] for h in holders))
            of_group.append(g)
            parts.append(raw)
            at += len(raw) + 1
    # symbols from 2 on, each text ended by 1, all by 0
    values = np.zeros(at + 1, np.uint16)
    values[:at] = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
    values[:at] += 2
    begins = np.array(begin)
    ends = np.append(begins[1:], at) - 1
    values[ends] = 1
    array = np.array(suffix_array(values))
    text_of = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, at)))
    text_of = np.append(text_of, len(begins) - 1)
    window = np.arange(at + 1) + LENGTH <= ends[text_of]
    window[-1] = False
    ranked = array[window[array]]
    view = np.lib.stride_tricks.sliding_window_view(values, LENGTH)
    groups_of = np.array(of_group)[text_of[ranked]]
    same = np.zeros(len(ranked), bool)
    for i in range(0, len(ranked) - 1, 1 << 14):
        j = min(i + (1 << 14), len(ranked) - 1)
        same[i + 1 : j + 1] = (view[ranked[i:j]] == view[ranked[i + 1 : j + 1]]).all(axis=1)
    run = np.cumsum(~same) - 1
    # within a run of equal windows, groups are apart
    split = np.lexsort((groups_of, run))
    ranked, run, groups_of = ranked[split], run[split], groups_of[split]
    new = _firsts(run, groups_of)
    smallest = np.minimum.reduceat(np.array(least)[text_of[ranked]], np.flatnonzero(new))[np.cumsum(new) - 1]
    low = np.full(at + 1, NONE, np.int64)
    low[ranked] = smallest
    for b, e, holders in zip(begin, ends.tolist(), (h for texts in groups for h in texts.values())):
        n = e - b - LENGTH + 1
        for key, i, u in holders:
            flags[i][u : u + n] |= low[b : b + n] < key


def _range_rows(rows: list[tuple], flags: list[np.ndarray]) -> list[tuple[int, int, int, int]]:
    """(key, hash, first, last) of the flagged windows of (group, key, hash, firsts, text) rows."""
    # all flags in a row, one unflagged place between those of two rows
    begins = np.cumsum([0, *(len(f) + 1 for f in flags)])
    every = np.zeros(begins[-1] + 1, np.int8)
    for u, f in zip((begins[:-1] + 1).tolist(), flags):
        every[u : u + len(f)] = f
    edge = np.flatnonzero(every[1:] != every[:-1])
    owner = np.searchsorted(begins, edge[::2], "right") - 1
    out = []
    for i, u, v in zip(owner.tolist(), (edge[::2] - begins[owner]).tolist(), (edge[1::2] - begins[owner]).tolist()):
        _, key, digest, firsts, _ = rows[i]
        out += [(key, digest, first + u, first + v - 1 + LENGTH) for first in np.frombuffer(firsts, np.int64).tolist()]
    return out


def _range_messages(ranges: list[tuple[int, int, int, int]], buckets: int) -> list[tuple[int, bytes]]:
    if not ranges:
        return []
    key, digest, u, v = (np.array(c, np.int64) for c in zip(*ranges))
    return _messages(_key_bucket(key, buckets), {"key": key, "hash": digest, "first": u, "last": v}, "r")


def _decide(buckets: int):
    """Suffix arrays over the asked pieces, whole groups (anchors, or hashes of windows) at a time."""

    def flush(rows: list[tuple]) -> pa.RecordBatch | None:
        flags = repeated_windows([(key, text, group) for group, key, _, _, text in rows])
        out = _range_messages(_range_rows(rows, flags), buckets)
        return _message_batch(out) if out else None

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        group: list[tuple] = []
        size = current = 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if group and row[0] != current:
                    held += group if len(group) > 1 else []
                    size += sum(len(r[4]) for r in group) if len(group) > 1 else 0
                    group = []
                    if size >= ARRAY_BYTES:
                        if (out := flush(held)) is not None:
                            yield out
                        held, size = [], 0
                current = row[0]
                group.append(row)
        held += group if len(group) > 1 else []
        if held and (out := flush(held)) is not None:
            yield out

    return decide


def _thin(buckets: int, array_bytes: int):
    """Suffix arrays over bounded parts of large anchors: the ranges found, and the other windows, each by its hash."""

    def flush(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        flags = repeated_windows([(key, text, anchor) for anchor, key, _, _, text in rows])
        if told := _range_messages(_range_rows(rows, flags), buckets):
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in told], pa.int32()), pa.array([r[1] for r in told], pa.binary()), *(pa.nulls(len(told), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=[c.split()[0] for c in RANGES.split(", ")])
        h16, h32 = _doubled(np.frombuffer(b"".join(r[4] for r in rows), np.uint8))
        hashes = _window_hashes(h16, h32).astype(np.int64)
        at, out = 0, []
        for (_, key, digest, firsts, text), f in zip(rows, flags):
            places = np.frombuffer(firsts, np.int64)
            out += [(int(hashes[at + u]), key, digest, (places + u).tobytes(), text[u : u + LENGTH]) for u in np.flatnonzero(~f).tolist()]
            at += len(text)
        if out:
            yield pa.RecordBatch.from_arrays([pa.nulls(len(out), pa.int32()), pa.nulls(len(out), pa.binary()), *(pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())))], names=[c.split()[0] for c in RANGES.split(", ")])

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                held.append(row)
                size += len(row[4])
                if size >= array_bytes:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return thin


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, told_by = None, {}
    for told, blob in _bucket_messages(batches):
        if told is not last:
            last, told_by = told, {}
            if told:
                keys = np.concatenate([_unpack_keys({n[2:]: x for n, x in m.items() if n in ("r_key", "r_base", "r_near")}) for m in told])
                digest, first, stop = (np.concatenate([m[f"r_{n}"] for m in told]) for n in ("hash", "first", "last"))
                order = np.lexsort((first, digest, keys))
                keys, digest, first, stop = keys[order], digest[order], first[order], stop[order]
                starts = np.flatnonzero(_firsts(keys, digest)).tolist()
                told_by = {(int(keys[u]), int(digest[u])): (first[u:v], stop[u:v]) for u, v in zip(starts, [*starts[1:], len(keys)])}
        keys, hashes, texts = _documents(blob)
        rows = []
        for key, digest, text in zip(keys.tolist(), hashes.tolist(), texts):
            spans, kept = [], text
            if (found := told_by.get((key, digest))) is not None:
                first, stop = found[0], np.maximum.accumulate(found[1])
                new = np.ones(len(first), bool)
                new[1:] = first[1:] > stop[:-1]
                spans = list(zip(first[new].tolist(), stop[np.append(np.flatnonzero(new)[1:], len(first)) - 1].tolist()))
                at, parts = 0, []
                for u, v in spans:
                    parts.append(text[at:u])
                    at = v
                kept = b"".join([*parts, text[at:]])
            rows.append((None if key == NONE else key, digest, len(text), [{"first": u, "last": v} for u, v in spans], kept))
        columns = list(zip(*rows))
        span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), span, pa.binary()))], names=["key", "text_hash", "n_bytes", "spans", "kept"])


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", group_bytes: int = GROUP_BYTES, array_bytes: int = ARRAY_BYTES) -> DataFrame:
    """One row per row: key, text_hash (xxhash64 of the text), n_bytes, spans (first byte, byte after the last) removed, kept bytes."""
    spark = df.sparkSession
    if not isinstance(df.schema[key].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"{key} must be a column of whole numbers, not {df.schema[key].dataType.simpleString()}")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 4 * partitions
    docs = df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"), F.xxhash64(text).alias("text_hash"))
    announced = docs.select("key", "text").mapInArrow(tidy(_announce(buckets)), MESSAGE)
    verdicts = announced.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(_verdicts(buckets)), MESSAGE)
    answered = staged(_by_bucket(docs, verdicts, buckets, partitions).mapInArrow(tidy(_answers(buckets)), RANGES))
    asked = answered.filter("text is not null").select("anchor", "key", "hash", "firsts", "text")
    told = answered.filter("payload is not null").select("bucket", "payload")
    sizes = asked.groupBy("anchor").agg(F.sum(F.octet_length("text")).alias("n")).filter(f"n > {group_bytes}").select("anchor")
    large = [r["anchor"] for r in sizes.collect()]  # at most one for each group_bytes of asked pieces
    if large:
        hot = F.broadcast(spark.createDataFrame([(x,) for x in large], "anchor long"))
        parts = asked.join(hot, "anchor", "left_semi").select(*asked.columns).sortWithinPartitions("anchor")
        thinned = staged(parts.mapInArrow(tidy(_thin(buckets, array_bytes)), RANGES))
        told = told.unionByName(thinned.filter("payload is not null").select("bucket", "payload"))
        asked = asked.join(hot, "anchor", "left_anti").select(*asked.columns).unionByName(thinned.filter("text is not null").select(*asked.columns))
    decided = asked.repartition(partitions, "anchor").sortWithinPartitions("anchor", "key").mapInArrow(tidy(_decide(buckets)), MESSAGE)
    ranges = told.unionByName(decided)
    out = _by_bucket(docs, ranges, buckets, partitions).mapInArrow(tidy(_remove), "key long, text_hash long, n_bytes long, spans array<struct<first:bigint,last:bigint>>, kept binary")
    return out.withColumnRenamed("key", key)
