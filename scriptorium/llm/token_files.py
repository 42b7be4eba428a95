"""Token ids as Parquet list columns, in ascending key order, for selective reads.

``write_token_files`` encodes texts and writes two tables below a folder: ``tokens`` (shard, key,
local_start, n_tokens, ids) with one file per key range, dictionary-encoded ids, delta-encoded
positions, fixed row-group and page sizes and the page index that Parquet writers add; and ``shards``
(shard, base), the ids before each file. Readers take columns and key ranges only: ``read_metadata``
never touches the ids, ``read_tokens`` gets pushed-down key filters.

Defined results: a null text is empty and has the end id alone; a null key comes first; rows of one
key are ordered by text; a very long text is encoded on its own and is one row; an empty table gives empty
tables; columns that aren't named are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.llm.storage import slices, tidy

ROW_GROUP_BYTES, PAGE_BYTES = 32 << 20, 256 << 10
#: Words that a worker remembers; less than elsewhere, as the task also sorts and writes.
MEMORY_BYTES = 160 << 20


def _encode(end_id: int, tokenizer: str | None):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from scriptorium.llm.tokens import encoder

        codec, shard, at = encoder(tokenizer, MEMORY_BYTES), TaskContext.get().partitionId(), 0
        tail = np.array([end_id], "<u4").tobytes()
        for part in slices(batches, 1):
            ids = [x + tail for x in codec.encode_all(part.column(1).to_pylist())]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            ends = np.cumsum(n)
            values = pa.array(np.frombuffer(b"".join(ids), np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), shard, np.int32)), part.column(0), pa.array(at + ends - n), pa.array(n), lists],
                names=["shard", "key", "local_start", "n_tokens", "ids"],
            )
            at += int(ends[-1])

    return encode


def write_token_files(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", end_id: int = 2, tokenizer: str | None = None, files: int | None = None, row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES) -> None:
    """Write the token and shard tables of a text column below a folder.

    Unless ``files`` says how many, ranges are joined until they have Spark's advisory partition size, so their
    number follows the data.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    # rows of a hot key are dealt by the beginnings of their texts, which keeps the order by key and text
    by = ("key", F.substring("text", 1, 24))
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    ranged = (rows.repartitionByRange(files, *by) if files else rows.repartitionByRange(*by)).sortWithinPartitions("key", "text")
    encoded = ranged.mapInArrow(tidy(_encode(end_id, tokenizer)), f"shard int, key {kind}, local_start long, n_tokens long, ids array<int>")
    options = {
        "parquet.block.size": str(row_group_bytes),
        "parquet.page.size": str(page_bytes),
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.enable.dictionary": "false",
        "parquet.enable.dictionary#ids.list.element": "true",
        "parquet.enable.dictionary#shard": "true",
    }
    encoded.write.options(**options).parquet(f"{path}/tokens")
    sums = spark.read.parquet(f"{path}/tokens").groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # one row per file
    sums.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("base")).coalesce(1).write.parquet(f"{path}/shards")


def read_metadata(spark: SparkSession, path: str, key: str = "doc_id", columns: tuple[str, ...] = ()) -> DataFrame:
    """key, start, n_tokens (and further named columns) of each document; ids are read only if named."""
    tokens = spark.read.parquet(f"{path}/tokens").select("shard", "key", "local_start", "n_tokens", *columns)
    shards = spark.read.parquet(f"{path}/shards")
    return tokens.join(shards, "shard").select(F.col("key").alias(key), (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", *columns)


def read_tokens(spark: SparkSession, path: str, first: int, last: int, key: str = "doc_id") -> DataFrame:
    """key, start, n_tokens, ids of the documents with keys from first to last: other row groups and pages are skipped."""
    return read_metadata(spark, path, key, ("ids",)).filter(F.col(key).between(first, last))


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column(b.num_columns - 1)
        offsets = lists.offsets.to_numpy()
        data = memoryview(lists.values.to_numpy()).cast("B")
        sums = [zlib.crc32(data[4 * u : 4 * v]) for u, v in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sums, pa.int64())], names=[*b.schema.names[:-1], "ids_crc32"])


def with_crc32(df: DataFrame, ids: str = "ids") -> DataFrame:
    """Replace a list of ids by the unsigned CRC-32 of those ids as little-endian 32-bit integers."""
    kept = df.select(*[c for c in df.columns if c not in (ids, "ids_crc32")], ids)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != ids)
    return kept.mapInArrow(_crc, f"{schema}, ids_crc32 long")
