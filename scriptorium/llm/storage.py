"""Shared storage for intermediate tables: they cut lineage and outlive a lost executor."""

from __future__ import annotations

import ctypes
import itertools
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, below the warehouse of a local session. Clusters must name the folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    return f"{base.rstrip('/')}/scriptorium-{uuid.uuid4().hex}"


#: Bytes of text that a task works on at once. A longer text is a slice of its own, so memory is bounded by it and the longest text.
SLICE_BYTES, SLICE_ROWS = 768 << 10, 1024


def slices(batches: Iterator[pa.RecordBatch], column: int, most_bytes: int = SLICE_BYTES, most_rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Parts of batches with about so many bytes of a text or binary column, and so many rows at most."""
    for b in batches:
        if not b.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(sizes) - sizes) // most_bytes
        starts = np.flatnonzero(np.diff(part, prepend=-1)).tolist()
        for u, v in itertools.pairwise([*starts, b.num_rows]):
            for i in range(u, v, most_rows):
                yield b.slice(i, min(v - i, most_rows))


def tidy(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function after which a worker, kept for further tasks, gives the memory it has freed back to the system."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # a C library without it
            pass

    return run


def staged(df: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
    """Write a frame to the shared folder as Parquet and read it back."""
    path = shared_folder(df.sparkSession)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spare_name() -> str:
    """A column name that no table has."""
    return f"_{uuid.uuid4().hex}"
