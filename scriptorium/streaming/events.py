"""Event streams: closed sessions, windowed counts, debounced changes, changed contents, batch totals.

All take a streaming frame and give one; the state of every key ends with the watermark, but for
``changed_contents``, which keeps one hash a key (or drops it after ``forget_after_ms`` without news).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_table_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A Parquet table as a stream of its files; the schema is that of the files now there."""
    folder, _, name = path.rstrip("/").rpartition("/")
    files = spark.read.parquet(path)
    reader = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", files_per_batch)
    if files.inputFiles()[0].rstrip("/").endswith(f"/{name}"):  # the table is one file: a stream reads folders only
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def read_log_stream(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = ("kind", "at")) -> DataFrame:
    """JSON lines as they are appended; rows that can't be read or lack a required field are left out."""
    rows = spark.readStream.schema(schema).option("mode", "PERMISSIVE").json(path)
    return rows.filter(" and ".join(f"`{c}` is not null" for c in required))


def timed(events: DataFrame, at: str, late: str) -> DataFrame:
    """Times without zone are taken in the session's zone, as watermarks need it."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)


def closed_sessions(events: DataFrame, user: str, at: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user, started, ended, events) of sessions that the watermark has passed; ended is the last event's time."""
    grouped = timed(events, at, late).groupBy(user, F.session_window(at, gap).alias("session")).agg(F.count(F.lit(1)).alias("events"))
    return grouped.select(user, F.col("session.start").alias("started"), (F.col("session.end") - F.expr(f"interval '{gap}'")).alias("ended"), "events")


def windowed_counts(events: DataFrame, by: str, at: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(by, began, events) of tumbling windows that the watermark has passed."""
    grouped = timed(events, at, late).groupBy(by, F.window(at, width).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return grouped.select(by, F.col("w.start").alias("began"), "events")


def with_timers(spark: SparkSession) -> None:
    """State with timers lives in this store; the session keeps the setting, running queries keep theirs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Debounce(StatefulProcessor):
    """Holds the last row of a key until the key has been quiet; rows end with the time at which they are due."""

    def __init__(self, order: list[int], schema: T.StructType) -> None:
        self.order, self.schema = order, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.schema)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        last = self.held.get() if self.held.exists() else None
        for frame in rows:
            for row in frame.itertuples(index=False, name=None):  # columns by place, as names may have been changed
                row = tuple(None if pd.isna(x) else x.to_pydatetime() if isinstance(x, pd.Timestamp) else x for x in row)
                if last is None or self._place(row) >= self._place(last):
                    last = row
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.held.update(last)
        self.handle.registerTimer(last[-1])
        return iter(())

    def _place(self, row: tuple) -> tuple:
        return (row[-1], *((row[i] is not None, row[i] if row[i] is not None else 0) for i in self.order))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        row = self.held.get()
        self.held.clear()
        yield pd.DataFrame([row[:-1]], columns=self.schema.names[:-1])

    def close(self) -> None:
        pass


def debounced(changes: DataFrame, key: str, at: str, quiet_ms: int = 2000, late: str = "0 seconds") -> DataFrame:
    """The last change of each burst of a key: it comes out once the key has had no other for so long, by the time of events.

    A change is held, and its timer set anew by each later one; of changes at one time that which is greater in the
    other columns, in their order, is the last. Changes without a time or key are left out. Needs with_timers. A key's
    last change comes out when the watermark, which events of any key move on, passes its timer.
    """
    kept = timed(changes, at, late).filter(F.col(at).isNotNull() & F.col(key).isNotNull())
    due = kept.withColumn("_due", F.unix_millis(at) + quiet_ms)
    out = T.StructType([T.StructField(f.name, f.dataType) for f in kept.schema])
    order = [i for i, f in enumerate(out) if f.name not in (key, at) and isinstance(f.dataType, (T.StringType, T.NumericType))]
    state = T.StructType([*out, T.StructField("_due", T.LongType())])
    return due.groupBy(key).transformWithStateInPandas(_Debounce(order, state), out, "append", "eventTime")


def changed_contents(docs: DataFrame, key: str, content: str, forget_after_ms: int | None = None) -> DataFrame:
    """(key, status) of each key of a batch: new, changed or unchanged against the hash seen last. Of several rows of a key the last counts."""
    kind = docs.schema[key].dataType.simpleString()

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = None
        for frame in frames:
            last = frame[content].iloc[-1]
        now = hashlib.sha256(("" if last is None else last).encode("utf-8", "surrogatepass")).hexdigest()
        status = "new" if not state.exists else "unchanged" if state.get[0] == now else "changed"
        state.update((now,))
        if forget_after_ms:
            state.setTimeoutDuration(forget_after_ms)
        yield pd.DataFrame({key: [group[0]], "status": [status]})

    timeout = GroupStateTimeout.ProcessingTimeTimeout if forget_after_ms else GroupStateTimeout.NoTimeout
    return docs.select(key, content).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, status string", "hash string", "append", timeout)


def run_available(stream: DataFrame, path: str) -> None:
    """Append all that is there now to a Parquet table below a folder that also holds the progress; a lost executor's tasks are run again."""
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/progress").option("path", f"{path}/rows").trigger(availableNow=True).start()
    query.awaitTermination()


def batch_totals(calls: DataFrame, path: str, batch: str = "batch_id") -> None:
    """Sum the calls of each micro-batch into rows of (batch, calls, tokens), written once per micro-batch even if it is retried."""

    def write(df: DataFrame, number: int) -> None:
        df.groupBy(batch).agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens")).write.mode("overwrite").parquet(f"{path}/rows/micro_batch={number}")

    calls.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start().awaitTermination()
