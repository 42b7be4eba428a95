"""Bursts of events as transactions: a micro-batch is written whole and once, or not at all.

Tasks write their events, and beside them each session's counts, into a folder for pending files. Only the commit of the
whole micro-batch moves both below ``events/burst=N`` and ``counts/burst=N`` and then writes the mark
``commits/N.json``; readers take bursts that have a mark. A failed task, a failed micro-batch and a driver that is lost
before the mark leave nothing that is read; a micro-batch that is run again after its mark is dropped.

Paths are URIs of a file system that all executors share.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from itertools import islice

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

BATCH_ROWS = 10_000
KINDS = ("events", "counts")


@dataclass
class _Written(WriterCommitMessage):
    files: tuple[str, ...]
    rows: int


def _place(path: str) -> tuple[fs.FileSystem, str]:
    system, root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    return system, root.rstrip("/")


class BurstSink(DataSource):
    """Options: path, session (the column whose rows are counted)."""

    @classmethod
    def name(cls) -> str:
        return "burst_log"

    def streamWriter(self, schema: T.StructType, overwrite: bool) -> DataSourceStreamWriter:
        return BurstWriter(self.options["path"], self.options["session"], schema)


class BurstWriter(DataSourceStreamWriter):
    def __init__(self, path: str, session: str, schema: T.StructType) -> None:
        self.path, self.session, self.schema = path, session, schema

    def write(self, iterator: Iterator[Row]) -> _Written:
        system, root = _place(self.path)
        system.create_dir(f"{root}/pending", recursive=True)
        name, counts, rows = uuid.uuid4().hex, Counter(), 0
        arrow = to_arrow_schema(self.schema)
        files = [f"{root}/pending/{name}.{kind}.parquet" for kind in KINDS]
        writer = None
        try:
            while some := list(islice(iterator, BATCH_ROWS)):
                writer = writer or pq.ParquetWriter(files[0], arrow, filesystem=system)
                writer.write_table(pa.table([pa.array([self._stored(r[i]) for r in some], f.type) for i, f in enumerate(arrow)], schema=arrow))
                counts.update(r[self.session] for r in some)
                rows += len(some)
        finally:
            if writer:
                writer.close()
        if not rows:
            return _Written((), 0)
        keys = list(counts)
        kind = arrow.field(self.session).type
        pq.write_table(pa.table({self.session: pa.array(keys, kind), "n": pa.array([counts[k] for k in keys], pa.int64())}), files[1], filesystem=system)
        return _Written(tuple(files), rows)

    @staticmethod
    def _stored(x):
        """Times come as local ones without a zone."""
        return x.astimezone(timezone.utc) if isinstance(x, datetime) else x

    def commit(self, messages: list[_Written | None], batchId: int) -> None:
        system, root = _place(self.path)
        mark = f"{root}/commits/{batchId}.json"
        files = [f for m in messages if m for f in m.files]
        if system.get_file_info(mark).type != fs.FileType.NotFound:  # this micro-batch is there already
            self._drop(system, files)
            return
        for kind in KINDS:
            folder = f"{root}/{kind}/burst={batchId}"
            if system.get_file_info(folder).type != fs.FileType.NotFound:  # of a commit that broke off
                system.delete_dir(folder)
            own = [f for f in files if f.endswith(f".{kind}.parquet")]
            if own:
                system.create_dir(folder, recursive=True)
            for f in own:
                system.move(f, f"{folder}/{f.rpartition('/')[2]}")
        system.create_dir(f"{root}/commits", recursive=True)
        with system.open_output_stream(f"{root}/pending/{batchId}.mark") as out:
            out.write(json.dumps({"burst": batchId, "rows": sum(m.rows for m in messages if m)}).encode())
        system.move(f"{root}/pending/{batchId}.mark", mark)

    def abort(self, messages: list[_Written | None], batchId: int) -> None:
        self._drop(_place(self.path)[0], [f for m in messages if m for f in m.files])

    @staticmethod
    def _drop(system: fs.FileSystem, files: list[str]) -> None:
        for f in files:
            if system.get_file_info(f).type != fs.FileType.NotFound:
                system.delete_file(f)


def append_bursts(events: DataFrame, path: str, session: str) -> None:
    """Append all events that are there now, each micro-batch as one transaction; progress is kept below the path."""
    events.sparkSession.dataSource.register(BurstSink)
    system, root = _place(path)
    system.create_dir(f"{root}/pending", recursive=True)
    writer = events.writeStream.format(BurstSink.name()).option("path", path).option("session", session)
    writer.option("checkpointLocation", f"{path}/progress").outputMode("append").trigger(availableNow=True).start().awaitTermination()


def _committed(spark: SparkSession, path: str, kind: str, schema: T.StructType) -> DataFrame:
    system, root = _place(path)
    known = T.StructType([*schema, T.StructField("burst", T.LongType())])
    if any(system.get_file_info(f"{root}/{x}").type == fs.FileType.NotFound for x in (kind, "commits")):
        return spark.createDataFrame([], known)
    marks = spark.read.schema("burst long, rows long").json(f"{path}/commits")
    return spark.read.schema(known).parquet(f"{path}/{kind}").join(marks, "burst", "left_semi").select(*known.names)


def read_bursts(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The events of committed bursts, with the burst's number."""
    return _committed(spark, path, "events", schema)


def session_counts(spark: SparkSession, path: str, session: T.StructField) -> DataFrame:
    """(session, n, bursts): the events of each session in committed bursts, from the counts that were kept with them."""
    rows = _committed(spark, path, "counts", T.StructType([session, T.StructField("n", T.LongType())]))
    return rows.groupBy(session.name).agg(F.sum("n").alias("n"), F.count_distinct("burst").alias("bursts"))
