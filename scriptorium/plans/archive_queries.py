"""Archive items, session reports, and the ingest of pages over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import text as ft
from scriptorium.operators import archive
from scriptorium.plans.registry import query
from scriptorium.sources.tables import table


@query("order_by_key", "select o_orderkey, o_custkey, o_orderstatus from orders where o_orderkey = 7")
def order_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point lookup: the filter reaches the scan."""
    return table(spark, sf_dir, "orders").filter("o_orderkey = 7").select("o_orderkey", "o_custkey", "o_orderstatus")


@query(
    "archive_items",
    """with lines as (select l_orderkey, l_linenumber, min(l_partkey) as l_partkey, min(l_returnflag) as l_returnflag, min(l_linestatus) as l_linestatus from lineitem group by 1, 2),
    f as (select l_orderkey as item_id, string_agg(name || '=' || value, ';' order by name) as fields from (
        select l_orderkey, case when l_linenumber % 2 = 0 then 'date' else 'title' end as name, max_by(cast(l_partkey as varchar), l_linenumber) as value from lines group by all) group by 1),
    t as (select l_orderkey as item_id, string_agg(l_returnflag, ';' order by l_returnflag) as tags from (select distinct l_orderkey, l_returnflag from lines) group by 1),
    n as (select l_orderkey as item_id, count(*) filter (l_linestatus = 'O') as notes from lines group by 1),
    p as (select l_orderkey as item_id, string_agg(cast(l_linenumber as varchar), ';' order by -l_linenumber) as photos, sum(case when l_partkey % 2 = 0 then 50 else 100 end) as widths from lines group by 1)
    select o_orderkey as item_id, case when o_custkey % 2 = 0 then 't' || o_orderstatus else 'https://tropy.org/v1/templates/generic' end as template, coalesce(fields, '') as fields, coalesce(tags, '') as tags, coalesce(notes, 0) as notes, coalesce(photos, '') as photos, coalesce(widths, 0)::bigint as widths
    from orders left join f on f.item_id = o_orderkey left join t on t.item_id = o_orderkey left join n on n.item_id = o_orderkey left join p on p.item_id = o_orderkey""",
)
def archive_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as items; their lines as fields, tags, notes, photos in reverse order, and a selection of each photo."""
    orders, every = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    lines = every.groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_partkey", "l_returnflag", "l_linestatus")])
    item, n = F.col("l_orderkey").alias("item_id"), F.col("l_linenumber")
    photo = F.col("l_orderkey") * 100 + n
    found = archive.archive_items(
        orders.select(F.col("o_orderkey").alias("item_id")),
        orders.filter("o_custkey % 2 = 0").select(F.col("o_orderkey").alias("item_id"), F.concat(F.lit("t"), "o_orderstatus").alias("template"), F.lit(None).cast("string").alias("type")),
        lines.select(item, F.when(n % 2 == 0, "http://x/terms/date").otherwise("http://x#title").alias("property"), n.alias("value_id"), F.col("l_partkey").cast("string").alias("value")),
        lines.select(item, F.col("l_returnflag").alias("tag")).distinct(),
        lines.select(F.col("l_orderkey").alias("owner"), photo.alias("note_id"), F.lit("note").alias("text"), F.when(F.col("l_linestatus") != "O", F.lit("2020")).alias("deleted")).unionByName(lines.select((-photo).alias("owner"), photo.alias("note_id"), F.lit("photo").alias("text"), F.lit(None).cast("string").alias("deleted"))),
        lines.select(item, (-photo).alias("photo_id"), (-n).alias("position"), F.concat(F.lit("/a/b/"), n.cast("string")).alias("path"), F.lit("").alias("filename")),
        lines.select((-photo).alias("photo_id"), (-photo - 10_000_000_000).alias("selection_id"), F.lit(1).alias("x"), F.lit(None).cast("int").alias("y")),
        lines.filter("l_partkey % 2 = 0").select((-photo - 10_000_000_000).alias("image_id"), F.lit(50).alias("width"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("int").alias("angle")),
    )
    pairs = F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    widths = F.aggregate("photos", F.lit(0).cast("long"), lambda a, p: a + F.aggregate(p["selections"], F.lit(0).cast("long"), lambda b, s: b + s["width"]))
    return found.select(
        "item_id",
        "template",
        F.coalesce(F.array_join(pairs, ";"), F.lit("")).alias("fields"),
        F.array_join("tags", ";").alias("tags"),
        F.size("notes").cast("long").alias("notes"),
        F.coalesce(F.array_join(F.transform("photos", lambda p: p["filename"]), ";"), F.lit("")).alias("photos"),
        F.coalesce(widths, F.lit(0)).cast("long").alias("widths"),
    )


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("kind"))


_SESSIONS = """s as (select user_id as session_id, min(ts) as started, max(ts) as ended, count(*) as n, string_agg('- **' || strftime(ts, '%H:%M:%S') || '** - ' || event_type || chr(10), '' order by ts, event_type) as lines from events group by 1),
    d as (select *, case when ended > started then cast(round((floor(epoch(ended)) - floor(epoch(started))) / 60) as bigint) || ' minutes' else 'N/A' end as duration from s)"""


@query(
    "session_reports",
    f"""with {_SESSIONS} select session_id, md5('# Research Session Report' || chr(10) || chr(10) || '**Session ID:** ' || session_id || chr(10) || '**Started:** ' || strftime(started, '%Y-%m-%d %H:%M:%S') || chr(10) || '**Ended:** ' || strftime(ended, '%Y-%m-%d %H:%M:%S') || chr(10)
        || '**Duration:** ' || duration || chr(10) || '**Total Events:** ' || n || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Timeline' || chr(10) || chr(10) || lines || chr(10)) as report_md5 from d""",
)
def session_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as sessions, reported in Markdown."""
    return archive.session_reports(_sessions(spark, sf_dir)).select("session_id", F.md5("report").alias("report_md5"))


@query(
    "session_reports_latex",
    rf"""with {_SESSIONS} select session_id, md5('\section{{Research Session Report}}' || chr(10) || chr(10) || '\subsection{{Session Information}}' || chr(10) || chr(10) || '\begin{{itemize}}' || chr(10) || '  \item Session ID: \texttt{{' || session_id || '}}' || chr(10) || '  \item Started: ' || strftime(started, '%Y-%m-%d %H:%M:%S') || chr(10)
        || '  \item Ended: ' || strftime(ended, '%Y-%m-%d %H:%M:%S') || chr(10) || '  \item Duration: ' || duration || chr(10) || '  \item Total Events: ' || n || chr(10) || '\end{{itemize}}' || chr(10) || chr(10)) as report_md5 from d""",
)
def session_reports_latex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.session_reports(_sessions(spark, sf_dir), form="latex").select("session_id", F.md5("report").alias("report_md5"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of fifty books."""
    return table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("book"), F.col("doc_id").alias("page_number"), "text")


@query("preprocessed_pages")
def preprocessed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of cleaned pages; look-around patterns, so a test holds them instead of SQL."""
    return archive.preprocess_statistics(archive.preprocessed(_pages(spark, sf_dir), "book"), "book")


@query("ingested_books")
def ingested_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages cleaned, joined, cut, rated and told once."""
    return archive.ingested(_pages(spark, sf_dir), "book").withColumn("content", F.md5("content"))


@query(
    "page_chunks",
    r"""with recursive p as (select doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10) || chr(10)), lambda t: list_filter(string_split_regex(t, '\s+'), lambda w: w <> '')), lambda t: true) as x from documents),
    f as (
        select doc_id, x, 0 as i, []::varchar[] as held, null::varchar[] as emitted, false as ended from p
        union all
        select doc_id, x, i + 1, case when ended then held when i >= len(x) then held when len(held) + len(x[i + 1]) > 300 and len(held) > 0 then list_concat(held[greatest(len(held) - 50 + 1, 1) : len(held)], x[i + 1]) else list_concat(held, x[i + 1]) end,
            case when i >= len(x) then case when len(held) >= 50 then held end when len(held) + len(x[i + 1]) > 300 and len(held) > 0 then held end, i >= len(x) from f where not ended
    )
    select doc_id, row_number() over (partition by doc_id order by i) - 1 as chunk_index, len(emitted) as n_words, md5(array_to_string(emitted, ' ')) as content_md5 from f where emitted is not null""",
)
def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one page."""
    pages = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page_number"), "text")
    return archive.page_chunks(pages).select("doc_id", "chunk_index", "n_words", F.md5("content").alias("content_md5"))


@query("segments_in_order", "select conv_id, turn, length(coalesce(text, '')) as n_chars from conversations order by conv_id, turn")
def segments_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as segments in the order of their first line."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length(ft.present("text")).cast("long").alias("n_chars")).orderBy("conv_id", "turn")


@query(
    "collection_sync",
    """with i as (select l_suppkey % 20 as collection, case l_returnflag when 'A' then 'attachment' when 'R' then 'note' else 'book' end as item_type, l_orderkey * 10 + l_linenumber as item from lineitem)
    select collection, item_type, count(*) as items, count(*) filter (item_type not in ('attachment', 'note')) as bibliographic from i group by all""",
)
def collection_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of collections by type, and which are neither attachments nor notes."""
    kind = F.when(F.col("l_returnflag") == "A", "attachment").when(F.col("l_returnflag") == "R", "note").otherwise("book")
    items = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("collection"), kind.alias("item_type"))
    return items.groupBy("collection", "item_type").agg(F.count(F.lit(1)).alias("items"), F.count_if(~F.col("item_type").isin("attachment", "note")).alias("bibliographic"))
