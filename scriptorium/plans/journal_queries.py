"""Session and usage queries over events, and chat queries over conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as ft
from scriptorium.operators import journal
from scriptorium.plans.registry import query
from scriptorium.sources.tables import table

#: Events as calls: tokens are the value rounded down, three providers by number, clicks and views are local.
CALLS = """calls as (
    select event_id as id, user_id, ts as "at", event_type as mode, 'p' || (event_id % 3) as provider, event_type in ('click', 'view') as is_local,
        coalesce(case when event_id % 4 <> 0 then cast(floor(value) as bigint) end, cast(floor(value / 2) as bigint) + coalesce(case when event_id % 8 = 0 then 1 end, 0)) as tokens,
        cast(json_extract_string(props, '$.k') as bigint) as k from events
), flagged as (
    select *, case when "at" - lag("at") over (partition by user_id order by "at", id) <= interval 30 minute then 0 else 1 end as new from calls
), sessions as (
    select * exclude (new), user_id || ':' || sum(new) over (partition by user_id order by "at", id rows unbounded preceding) as session_id from flagged
)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    total = F.when(F.col("event_id") % 4 != 0, F.floor("value"))
    tokens = journal.tokens(total, F.floor(F.col("value") / 2), F.when(F.col("event_id") % 8 == 0, 1))
    return e.select(
        F.col("event_id").alias("id"),
        "user_id",
        F.col("ts").alias("at"),
        F.col("event_type").alias("mode"),
        F.concat(F.lit("p"), (F.col("event_id") % 3).cast("string")).alias("provider"),
        F.col("event_type").isin("click", "view").alias("is_local"),
        tokens.cast("long").alias("tokens"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = journal.gap_sessions(calls(spark, sf_dir), "user_id")
    return found.withColumn("session_id", F.concat_ws(":", F.col("user_id").cast("string"), F.col("session").cast("string"))).drop("session")


@query("events_between", "select event_id, ts, event_type from events where event_type = 'click' and ts >= timestamp '2024-01-03' and ts < timestamp '2024-01-10'")
def events_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A half-open time range and a type; both reach the scan."""
    e = table(spark, sf_dir, "events")
    return journal.between(e, "2024-01-03 00:00:00", "2024-01-10 00:00:00", "ts", event_type="click").select("event_id", "ts", "event_type")


@query("usage_by_provider", f"with {CALLS} select provider, count(*) as calls, cast(sum(tokens) as bigint) as tokens, cast(sum(case when is_local then tokens else 0 end) as bigint) as local_tokens from calls group by provider")
def usage_by_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.usage_by(calls(spark, sf_dir), "provider")


@query("usage_by_mode", f"with {CALLS} select mode, count(*) as calls, cast(sum(tokens) as bigint) as tokens, cast(sum(case when is_local then tokens else 0 end) as bigint) as local_tokens from calls group by mode")
def usage_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.usage_by(calls(spark, sf_dir), "mode")


@query(
    "usage_sessions",
    f"""with {CALLS}, links as (select distinct session_id from sessions where k = 7),
    g as (select session_id, min("at") as started, max("at") as ended, count(*) as events, cast(sum(tokens) as bigint) as tokens, list_sort(list(distinct mode)) as modes, list_sort(list(distinct provider)) as providers from sessions group by session_id)
    select session_id, started, ended, events, tokens, array_to_string(modes, ',') as modes, array_to_string(providers, ',') as providers, l.session_id is not null as covered,
        events >= 3 or tokens >= 1000 as substantial, (events >= 3 or tokens >= 1000) and l.session_id is null as violation from g left join links l using (session_id)""",
)
def usage_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by gaps of 30 minutes; decisions link to those with a k of 7."""
    s = sessions(spark, sf_dir)
    found = journal.session_summary(s, s.filter("k = 7").select("session_id"))
    return found.withColumn("modes", F.array_join("modes", ",")).withColumn("providers", F.array_join("providers", ","))


@query(
    "usage_summary",
    f"""with {CALLS} select count(*) as calls, count(distinct session_id) as sessions, cast(sum(tokens) as bigint) as tokens, cast(sum(case when is_local then tokens else 0 end) as bigint) as local_tokens, min("at") as first_at, max("at") as last_at from sessions""",
)
def usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_distinct("session_id").alias("sessions"),
        F.sum("tokens").alias("tokens"),
        F.sum(F.when(F.col("is_local"), F.col("tokens")).otherwise(0)).alias("local_tokens"),
        F.min("at").alias("first_at"),
        F.max("at").alias("last_at"),
    )


DECISIONS = "case k % 6 when 0 then 'accepted' when 1 then 'accepted' when 2 then 'rejected' when 3 then 'modified' when 4 then 'invalidated' else 'expired' end"


@query(
    "adjudication_rates",
    f"""with {CALLS}, d as (select mode, {DECISIONS} as decision from calls),
    g as (select mode, count(*) filter (decision = 'accepted') as accepted, count(*) filter (decision = 'rejected') as rejected, count(*) filter (decision = 'modified') as modified,
        count(*) filter (decision = 'invalidated') as invalidated, count(*) filter (decision = 'expired') as expired from d group by mode)
    select *, accepted + rejected + modified as judged, round(accepted / nullif(accepted + rejected + modified, 0), 6) as rate from g""",
)
def adjudication_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.adjudications(calls(spark, sf_dir).withColumn("decision", F.expr(DECISIONS)), "mode")


@query("events_by_iso_week", "select isoyear(ts) || '-W' || lpad(cast(weekofyear(ts) as varchar), 2, '0') as week, event_type, count(*) as events from events group by all")
def events_by_iso_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(journal.iso_week(F.col("ts")).alias("week"), "event_type").agg(F.count(F.lit(1)).alias("events"))


@query(
    "weekly_report",
    "select week, string_agg('- ' || event_type || ': ' || n, chr(10) order by n desc, event_type) as report from (select isoyear(ts) || '-W' || lpad(cast(weekofyear(ts) as varchar), 2, '0') as week, event_type, count(*) as n from events group by all) group by week",
)
def weekly_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One Markdown list a week."""
    counts = events_by_iso_week(spark, sf_dir)
    line = F.concat(F.lit("- "), "event_type", F.lit(": "), F.col("events").cast("string"))
    rows = F.array_sort(F.collect_list(F.struct((-F.col("events")).alias("least"), "event_type", line.alias("line"))))
    return counts.groupBy("week").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("report"))


@query("daily_activity", "select strftime(ts, '%Y-%m-%d') as day, count(*) as events, count(distinct user_id) as users, round(cast(sum(cast(value as decimal(20, 4))) as double) / count(value), 4) as mean_value from events group by 1")
def daily_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("users"), F.round(F.sum(F.col("value").cast("decimal(20,4)")).cast("double") / F.count("value"), 4).alias("mean_value"))


@query(
    "history_statistics",
    f"""with {CALLS}, s as (select session_id, date_diff('millisecond', min("at"), max("at")) as ms, count(*) as n from sessions group by session_id)
    select count(*) as sessions, round(coalesce(avg(nullif(ms, 0)), 0), 3) as mean_ms, max(n) as most_events from s""",
)
def history_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions and their mean length; sessions of one event have none."""
    micro = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    ms = F.floor(micro("ended") / 1000) - F.floor(micro("started") / 1000)
    s = sessions(spark, sf_dir).groupBy("session_id").agg(F.min("at").alias("started"), F.max("at").alias("ended"), F.count(F.lit(1)).alias("n"))
    return s.agg(F.count(F.lit(1)).alias("sessions"), F.round(F.coalesce(F.avg(F.nullif(ms, F.lit(0))), F.lit(0.0)), 3).alias("mean_ms"), F.max("n").alias("most_events"))


@query(
    "zero_filled_kinds",
    "select kind, cast(count(event_id) as bigint) as count from (values ('click'), ('view'), ('error'), ('purchase'), ('absent')) t(kind) left join events on event_type = kind and value > 50 group by kind",
)
def zero_filled_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "events").filter("value > 50").groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("count"))
    return journal.zero_filled(counts, "kind", ["click", "view", "error", "purchase", "absent"])


@query(
    "call_batches",
    f"with {CALLS} select id // 100 as batch_id, count(*) as calls, cast(sum(tokens) as bigint) as tokens, cast(sum(k) as bigint) as duration_ms, bool_or(k > 97) as tokens_estimated from calls group by 1",
)
def call_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calls(spark, sf_dir).withColumns({"batch_id": F.expr("id div 100"), "duration_ms": F.col("k"), "tokens_estimated": F.col("k") > 97})
    return journal.batches(rows)


@query(
    "anonymised_users",
    "with r as (select user_id, row_number() over (order by user_id) as rank from (select distinct user_id from events)) select event_id, 'user-' || case when rank <= 26 then chr(cast(64 + rank as integer)) else cast(rank as varchar) end as user_id from events join r using (user_id)",
)
def anonymised_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.aliases(table(spark, sf_dir, "events").select("event_id", "user_id"), "user_id", "user")


@query(
    "event_json",
    "select event_id, json_extract_string(props, '$.k') as k, event_type from events where cast(json_extract_string(props, '$.k') as integer) >= 90",
)
def event_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), "event_type")
    return e.filter(F.expr("try_cast(k as int)") >= 90)


@query(
    "nearest_lower_percentiles",
    "select event_type, list_sort(list(value))[cast(floor(0.5 * (count(*) - 1)) as integer) + 1] as p50, list_sort(list(value))[cast(floor(0.95 * (count(*) - 1)) as integer) + 1] as p95 from events group by event_type",
)
def nearest_lower_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks within sorted values of a type, not arrays of them, so any number of rows will do."""
    e = table(spark, sf_dir, "events").select("event_type", "event_id", "value")
    w = Window.partitionBy("event_type")
    placed = e.withColumn("pos", F.row_number().over(w.orderBy("value", "event_id")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    pick = lambda p: F.max(F.when(F.col("pos") == F.floor(F.lit(p) * (F.col("n") - 1)), F.col("value")))
    return placed.groupBy("event_type").agg(pick(0.5).alias("p50"), pick(0.95).alias("p95"))


@query("chat_turns", "select role, count(*) as turns, count(distinct conv_id) as conversations, cast(sum(length(text)) as bigint) as characters, cast(sum(cast(ceil(length(text) / 4) as bigint)) as bigint) as token_estimate from conversations group by role")
def chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("role").agg(
        F.count(F.lit(1)).alias("turns"),
        F.count_distinct("conv_id").alias("conversations"),
        F.sum(F.length("text").cast("long")).alias("characters"),
        F.sum(ft.token_estimate(F.col("text"))).alias("token_estimate"),
    )


@query(
    "compaction_plan",
    r"""with s as (select *, cast(ceil(length(coalesce(text, '')) / 4) as bigint) as tokens from conversations),
    t as (select *, sum(tokens) over (partition by conv_id) as total, count(*) filter (role = 'user') over (partition by conv_id order by turn desc rows unbounded preceding) as left_ from s)
    select conv_id, turn, total <= 1024 * 0.7 or role = 'system' or left_ < 4 or (left_ = 4 and role = 'user') or regexp_matches(text, '\[@[^\]]+\]|\(\p{Lu}\p{L}+,? \d{4}\)') as kept from t""",
)
def compaction_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return journal.compaction(table(spark, sf_dir, "conversations"), window=1024).select("conv_id", "turn", "kept")


@query(
    "journal_export",
    """select * from (select 'event' as type, cast(event_id as varchar) as id, strftime(ts, '%Y-%m-%dT%H:%M:%S') as at, event_type as label from events
    union all select 'decision', cast(o_orderkey as varchar), strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'), o_orderstatus from orders
    union all select 'adjudication', cast(doc_id as varchar), null, case quality when 1 then 'accepted' else 'rejected' end from labels)""",
)
def journal_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tagged union of three record kinds; as JSON lines it is sources.export.json_lines."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    e = table(spark, sf_dir, "events").select(F.lit("event").alias("type"), F.col("event_id").cast("string").alias("id"), iso("ts").alias("at"), F.col("event_type").alias("label"))
    o = table(spark, sf_dir, "orders").select(F.lit("decision").alias("type"), F.col("o_orderkey").cast("string").alias("id"), iso("o_orderdate").alias("at"), F.col("o_orderstatus").alias("label"))
    lab = table(spark, sf_dir, "labels").select(F.lit("adjudication").alias("type"), F.col("doc_id").cast("string").alias("id"), F.lit(None).cast("string").alias("at"), F.when(F.col("quality") == 1, "accepted").otherwise("rejected").alias("label"))
    return e.unionByName(o).unionByName(lab)
