"""Streaming queries: all that is there now is run through the stream, and its table read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scriptorium.plans.registry import query
from scriptorium.sources.tables import shared_folder
from scriptorium.streaming import events as stream


def _run(spark: SparkSession, frame: DataFrame) -> DataFrame:
    path = shared_folder(spark)
    stream.run_available(frame, path)
    return spark.read.schema(frame.schema).parquet(f"{path}/rows")


#: A session or window comes out once the watermark, an hour behind the latest event, has passed its end.
WATERMARK = "(select date_trunc('millisecond', max(ts)) - interval 1 hour from events)"


@query(
    "streamed_sessions",
    f"""with f as (select user_id, ts, case when ts - lag(ts) over w <= interval 30 minute then 0 else 1 end as new from events window w as (partition by user_id order by ts)),
    s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as n from f),
    g as (select user_id, min(ts) as started, max(ts) as ended, count(*) as events from s group by user_id, n)
    select user_id, started, ended, events from g where ended + interval 30 minute <= {WATERMARK}""",
)
def streamed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = stream.read_table_stream(spark, f"{sf_dir.rstrip('/')}/events.parquet")
    found = _run(spark, stream.closed_sessions(events, "user_id", "ts"))
    return found.selectExpr("user_id", "cast(started as timestamp_ntz) as started", "cast(ended as timestamp_ntz) as ended", "events")


@query("streamed_hourly_counts", f"select event_type, began, count(*) as events from (select event_type, date_trunc('hour', ts) as began from events) where began + interval 1 hour <= {WATERMARK} group by event_type, began")
def streamed_hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = stream.read_table_stream(spark, f"{sf_dir.rstrip('/')}/events.parquet")
    found = _run(spark, stream.windowed_counts(events, "event_type", "ts"))
    return found.selectExpr("event_type", "cast(began as timestamp_ntz) as began", "events")
