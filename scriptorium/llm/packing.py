"""Bounded-space online packing of documents into fixed windows of tokens.

Each partition keeps a fixed number of open windows. A document gives full windows while it can; its
rest goes to the open window with the least room that holds it (best fit). When none does, the fullest
window is emitted and the rest opens a new one. The windows still open at the end of the partitions are
merged in rounds: those of several partitions meet in one task, which packs their pieces again, longest
first, under the same rule; the last round emits all.

``pack`` gives the packed sequences, each with its ids and the pieces they come from; ``pieces`` reads the
pieces back from the packed ids.

Defined results: a null text is the empty document, which is its end id alone; every id lies in one
piece; repeated rows are packed as separate documents; a very long text is encoded on its own and gives
full windows; an empty table gives no sequences; columns that aren't named are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.storage import slices, staged, tidy

OPEN_WINDOWS, MERGED = 256, 16
#: Words that a worker remembers while it packs.
MEMORY_BYTES = 256 << 20


class Packer:
    """Open windows by room left; items are (length, anything)."""

    def __init__(self, capacity: int, most_open: int) -> None:
        self.capacity, self.most_open = capacity, most_open
        self.rooms: list[tuple[int, int]] = []  # (room, number of the window), ascending
        self.items: dict[int, list] = {}
        self.made = 0

    def add(self, length: int, item: object) -> list | None:
        """Place an item; gives the items of a window that is emitted for it, if any."""
        if length == self.capacity:
            return [item]
        out = None
        k = bisect.bisect_left(self.rooms, (length, -1))
        if k < len(self.rooms):
            room, window = self.rooms.pop(k)
        else:
            if len(self.rooms) >= self.most_open:
                out = self.items.pop(self.rooms.pop(0)[1])
            room, window = self.capacity, self.made
            self.items[window] = []
            self.made += 1
        self.items[window].append(item)
        if room > length:
            bisect.insort(self.rooms, (room - length, window))
            return out
        full = self.items.pop(window)
        return full if out is None else out + [None] + full

    def rest(self) -> list[list]:
        left = [self.items[w] for _, w in self.rooms]
        self.rooms, self.items = [], {}
        return left


def _windows(emitted: list | None) -> list[list]:
    """The windows of Packer.add's result, which parts two by None."""
    if emitted is None:
        return []
    if None in emitted:
        k = emitted.index(None)
        return [emitted[:k], emitted[k + 1 :]]
    return [emitted]


PIECE_FIELDS = ("key", "start", "length", "offset", "doc_tokens")


def _batch(windows: list[tuple[int, list]], key_type: pa.DataType, task: int | None) -> pa.RecordBatch:
    """Rows of (sequence_id, items); an item is (key, start, tokens of its document, ids)."""
    items = [x for _, w in windows for x in w]
    length = np.array([len(x[3]) // 4 for x in items], np.int64)
    counts = np.array([len(w) for _, w in windows], np.int64)
    ends, at = np.cumsum(length), np.cumsum(np.append(0, counts))
    offset = ends - length - np.repeat(np.append(0, ends)[at[:-1]], counts)
    struct = pa.StructArray.from_arrays([pa.array([x[0] for x in items], key_type), pa.array([x[1] for x in items], pa.int64()), pa.array(length), pa.array(offset), pa.array([x[2] for x in items], pa.int64())], names=list(PIECE_FIELDS))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([n for n, _ in windows], pa.int64()),
            pa.array([b"".join([x[3] for x in w]) for _, w in windows], pa.binary()),
            pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), struct),
            pa.array([task] * len(windows), pa.int32()),
        ],
        names=["sequence_id", "ids", "pieces", "task"],
    )


def _numbered(windows: list[list], base: int, number: int) -> list[tuple[int, list]]:
    return [(base + number + k, w) for k, w in enumerate(windows)]


def _pack_texts(length: int, most_open: int, end_id: int, tokenizer: str | None, memory_bytes: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from scriptorium.llm.tokens import encoder

        codec, task = encoder(tokenizer, memory_bytes), TaskContext.get().partitionId()
        packer, base, number = Packer(length, most_open), task << 32, 0
        tail, kind = np.array([end_id], "<u4").tobytes(), None
        for part in slices(batches, 1):
            kind, windows = part.schema.field(0).type, []
            for key, ids in zip(part.column(0).to_pylist(), codec.encode_all(part.column(1).to_pylist())):
                ids += tail
                n = len(ids) // 4
                for start in range(0, n, length):
                    piece = ids[4 * start : 4 * (start + length)]
                    windows += _windows(packer.add(len(piece) // 4, (key, start, n, piece)))
            if windows:
                yield _batch(_numbered(windows, base, number), kind, None)
                number += len(windows)
        if left := packer.rest():
            yield _batch(_numbered(left, base, number), kind, task)

    return pack


def _items(part: pa.RecordBatch) -> Iterator[tuple]:
    """The items of windows' rows."""
    for ids, pieces in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
        for p in pieces:
            yield p["key"], p["start"], p["doc_tokens"], ids[4 * p["offset"] : 4 * (p["offset"] + p["length"])]


def _merge(length: int, most_open: int, level: int, last: bool):
    """Pack the windows of each group anew; a group has MERGED partitions' open windows at most."""

    def merged(group: int, items: list[tuple], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        items.sort(key=lambda x: (-len(x[3]), x[0] is None, x[0] if x[0] is not None else 0, x[1], x[3]))
        packer, base = Packer(length, most_open), level << 56 | group << 32
        done = [w for x in items for w in _windows(packer.add(len(x[3]) // 4, x))]
        left = packer.rest()
        for task, windows, number in ((None, done, 0), (None if last else group, left, len(done))):
            if windows:
                yield _batch(_numbered(windows, base, number), kind, task)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group, kind = [], None, None
        for b in batches:
            kind = b.schema.field(2).type.value_type.field(0).type
            tasks = b.column(3).to_pylist()
            starts = [i for i, t in enumerate(tasks) if not i or t != tasks[i - 1]]
            for u, v in zip(starts, [*starts[1:], len(tasks)]):
                if held and tasks[u] != group:
                    yield from merged(group, held, kind)
                    held = []
                group = tasks[u]
                held += _items(b.slice(u, v - u))
        if held:
            yield from merged(group, held, kind)

    return merge


def pack(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = 2048, end_id: int = 1, tokenizer: str | None = None, open_windows: int = OPEN_WINDOWS, memory_bytes: int = MEMORY_BYTES) -> DataFrame:
    """One row per sequence: sequence_id, ids (little-endian, unsigned 32-bit), pieces (key, start, length, offset, doc_tokens)."""
    kind = df.schema[key].dataType.simpleString()
    schema = f"sequence_id long, ids binary, pieces array<struct<key:{kind},start:bigint,length:bigint,offset:bigint,doc_tokens:bigint>>, task int"
    texts = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    first = staged(texts.mapInArrow(tidy(_pack_texts(length, open_windows, end_id, tokenizer, memory_bytes)), schema))
    out, level = first.filter("task is null"), 0
    left = first.filter("task is not null")
    tasks = (left.agg(F.max("task")).first()[0] or 0) + 1
    last = False
    while not last:
        level += 1
        tasks = -(-tasks // MERGED)
        last = tasks <= 1
        grouped = left.withColumn("task", F.expr(f"cast(task div {MERGED} as int)")).repartition(tasks, "task").sortWithinPartitions("task")
        merged = staged(grouped.mapInArrow(tidy(_merge(length, open_windows, level, last)), schema))
        out, left = out.unionByName(merged.filter("task is null")), merged.filter("task is not null")
    return out.drop("task")


def pieces(sequences: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per piece of packed sequences: key, start, length, ids_crc32 (of its ids in the sequence), doc_tokens, sequence_id, offset."""
    ids = lambda p: F.substring("ids", (4 * p["offset"] + 1).cast("int"), (4 * p["length"]).cast("int"))
    summed = F.transform("pieces", lambda p: F.struct(p["key"].alias("key"), p["start"].alias("start"), p["length"].alias("length"), F.crc32(ids(p)).alias("ids_crc32"), p["doc_tokens"].alias("doc_tokens"), p["offset"].alias("offset")))
    exploded = sequences.select("sequence_id", F.explode(summed).alias("p"))
    return exploded.select(F.col("p.key").alias(key), "p.start", "p.length", "p.ids_crc32", "p.doc_tokens", "sequence_id", "p.offset")
