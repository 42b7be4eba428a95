"""Session and usage analytics over event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def between(events: DataFrame, first: str | None = None, last: str | None = None, at: str = "at", **equal: object) -> DataFrame:
    """Events with the given values whose time is in [first, last)."""
    out = events
    if first is not None:
        out = out.filter(F.col(at) >= F.lit(first).cast("timestamp_ntz"))
    if last is not None:
        out = out.filter(F.col(at) < F.lit(last).cast("timestamp_ntz"))
    for name, value in equal.items():
        if value is not None:
            out = out.filter(F.col(name) == value)
    return out


def tokens(total: Column, prompt: Column, completion: Column) -> Column:
    """The total, or else prompt and completion tokens, a missing one as 0."""
    return F.coalesce(total, F.coalesce(prompt, F.lit(0)) + F.coalesce(completion, F.lit(0)))


def gap_sessions(events: DataFrame, user: str, at: str = "at", key: str = "id", minutes: int = 30, also: tuple[str, ...] = ()) -> DataFrame:
    """Number each user's sessions: a new one begins after a gap of more than so many minutes, or where a column of ``also`` changes."""
    w = Window.partitionBy(user).orderBy(at, key)
    new = F.col(at) - F.lag(at).over(w) > F.expr(f"interval '{minutes}' minute")
    for c in also:
        new = new | (F.col(c) != F.lag(c).over(w))
    flagged = events.withColumn("new_session", F.coalesce(new, F.lit(True)).cast("long"))
    return flagged.withColumn("session", F.sum("new_session").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new_session")


def usage_by(events: DataFrame, by: str) -> DataFrame:
    """Calls, tokens and those on local models, by a column, most tokens first."""
    grouped = events.groupBy(by).agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"), F.sum(F.when(F.col("is_local"), F.col("tokens")).otherwise(0)).alias("local_tokens"))
    return grouped.orderBy(F.desc("tokens"), by)


def session_summary(events: DataFrame, links: DataFrame, session: str = "session_id", least_events: int = 3, least_tokens: int = 1000) -> DataFrame:
    """Each session's span, sorted distinct modes and providers, and whether it is substantial, covered by a decision, or a violation (substantial, not covered)."""
    grouped = events.groupBy(session).agg(
        F.min("at").alias("started"),
        F.max("at").alias("ended"),
        F.count(F.lit(1)).alias("events"),
        F.sum("tokens").alias("tokens"),
        F.array_sort(F.collect_set("mode")).alias("modes"),
        F.array_sort(F.collect_set("provider")).alias("providers"),
    )
    covered = links.select(session).distinct().withColumn("linked", F.lit(True))
    substantial = (F.col("events") >= least_events) | (F.col("tokens") >= least_tokens)
    joined = grouped.join(covered, session, "left").withColumn("covered", F.coalesce("linked", F.lit(False))).drop("linked")
    return joined.withColumn("substantial", substantial).withColumn("violation", substantial & ~F.col("covered"))


def adjudications(rows: DataFrame, by: str, decision: str = "decision") -> DataFrame:
    """Counts of decisions and the rate of accepted ones among judged ones (null where none is judged), most judged first."""
    count = lambda x: F.count_if(F.col(decision) == x).alias(x)
    grouped = rows.groupBy(by).agg(*[count(x) for x in ("accepted", "rejected", "modified", "invalidated", "expired")])
    judged = F.col("accepted") + F.col("rejected") + F.col("modified")
    out = grouped.withColumn("judged", judged).withColumn("rate", F.round(F.try_divide("accepted", "judged"), 6))
    return out.orderBy(F.desc("judged"), by)


def iso_week(at: Column) -> Column:
    """YYYY-Www by the rule of the week's Thursday."""
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), at), F.weekofyear(at))


def zero_filled(counts: DataFrame, by: str, values: list[str], count: str = "count") -> DataFrame:
    """One row for each of the values, 0 where there is none."""
    spark = counts.sparkSession
    every = spark.createDataFrame([(v,) for v in values], f"{by} string")
    return F.broadcast(every).join(counts, by, "left").withColumn(count, F.coalesce(count, F.lit(0)).cast("long"))


def aliases(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Replace a column by prefix-A, prefix-B, ... in sorted order of its distinct values, after Z by prefix-27, ..."""
    # one row per distinct value is ranked, in one task; values are names of workspaces or corpora, a few by nature
    rank = F.row_number().over(Window.orderBy(column))
    named = df.select(column).distinct().filter(F.col(column).isNotNull()).withColumn("rank", rank)
    alias = F.concat(F.lit(f"{prefix}-"), F.when(F.col("rank") <= 26, F.char(F.col("rank") + 64)).otherwise(F.col("rank").cast("string")))
    return df.join(named.select(column, alias.alias("alias")), column, "left").withColumn(column, F.col("alias")).drop("alias")


def batches(events: DataFrame, batch: str = "batch_id") -> DataFrame:
    """One row of a batch's calls: how many, their tokens and time, and whether any count was estimated."""
    return events.groupBy(batch).agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"), F.sum("duration_ms").alias("duration_ms"), F.bool_or("tokens_estimated").alias("tokens_estimated"))


def compaction(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", window: int = 8192, share: float = 0.7, kept_turns: int = 4) -> DataFrame:
    """Per message: whether a conversation over 0.7 of the window keeps it: system messages, all from the fourth last user turn on, and texts with citations."""
    from scriptorium.functions import text as ft

    whole = Window.partitionBy(conversation)
    later = whole.orderBy(F.desc(turn)).rowsBetween(Window.unboundedPreceding, 0)
    sized = messages.withColumn("tokens", ft.token_estimate(ft.present("text"))).withColumn("total", F.sum("tokens").over(whole))
    turns = sized.withColumn("user_turns_left", F.sum((F.col("role") == "user").cast("long")).over(later))
    after_last = (F.col("user_turns_left") < kept_turns) | ((F.col("user_turns_left") == kept_turns) & (F.col("role") == "user"))
    needed = F.col("total") > window * share
    cited = F.col("text").rlike(r"\[@[^\]]+\]|\(\p{Lu}\p{L}+,? \d{4}\)")
    return turns.withColumn("kept", ~needed | (F.col("role") == "system") | after_last | F.coalesce(cited, F.lit(False)))
