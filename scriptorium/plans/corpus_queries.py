"""Citations, manuscripts, library upkeep, query expansion, topics and compression over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import text as ft
from scriptorium.operators import chunk, citations, context, density, library, neighbour_graph, search, topics
from scriptorium.plans.registry import query
from scriptorium.sources import bibtex, logs, vault
from scriptorium.sources.tables import stored, table

_SQL = lambda s: s.replace("'", "''")

#: Documents hold no citations, keys or links of their own, so some are put after each text.
CITED = """coalesce(text, '') || ' As Durand (' || (1900 + doc_id % 120) || ') and (Martin and Petit, ' || (1950 + doc_id % 70) || 'a) say.'"""

_FOUND = " union ".join(f"select doc_id, unnest(regexp_extract_all(t, '{_SQL(s)}', 1)) as author, unnest(regexp_extract_all(t, '{_SQL(s)}', 2)) as year from d" for s in citations.SHAPES)


def _cited() -> Column:
    return F.concat(ft.present("text"), F.lit(" As Durand ("), (1900 + F.col("doc_id") % 120).cast("string"), F.lit(") and (Martin and Petit, "), (1950 + F.col("doc_id") % 70).cast("string"), F.lit("a) say."))


@query("citations_extracted", f"with d as (select doc_id, {CITED} as t from documents) select distinct doc_id, author, year from ({_FOUND})")
def citations_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", _cited().alias("text"))
    return citations.extract(docs).select("doc_id", "author", "year")


@query(
    "citation_statistics",
    f"""with d as (select doc_id, {CITED} as t from documents), c as (select distinct doc_id, author, year from ({_FOUND})), y as (select *, try_cast(year[1:4] as int) as n from c)
    select count(*) as citations, count(distinct author) as authors, min(n) filter (n between 1500 and 2100) as first_year, max(n) filter (n between 1500 and 2100) as last_year, count(*) as with_context from y""",
)
def citation_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.statistics(citations.extract(table(spark, sf_dir, "documents").select("doc_id", _cited().alias("text"))))


@query(
    "citation_matches",
    """with d as (select n_nationkey as doc_id, lower(n_name) as author, cast(1990 + n_regionkey as varchar) as year, n_name from nation),
    c as (select s_suppkey as citation_id, lower(n_name[1:4]) as author, cast(1990 + n_regionkey as varchar) as year from supplier join nation on s_nationkey = n_nationkey)
    select citation_id, min(doc_id) as doc_id from c join d using (year) where contains(regexp_replace(d.author, '[^a-z]', '', 'g'), c.author) or contains(c.author, regexp_replace(d.author, '[^a-z]', '', 'g'))
        or string_split(d.author, ' ')[1] = c.author group by citation_id""",
)
def citation_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers cite their nation by the first letters of its name."""
    nation = table(spark, sf_dir, "nation")
    year = (1990 + F.col("n_regionkey")).cast("string")
    docs = nation.select(F.col("n_nationkey").alias("doc_id"), F.col("n_name").alias("author"), year.alias("year"))
    cited = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("citation_id"), F.substring("n_name", 1, 4).alias("author"), F.concat(year, F.lit("a")).alias("year"))
    return citations.match_documents(cited, docs)


KEYED = "coalesce(text, '') || ' see @key' || (doc_id % 50) || ', @other.key; and @key' || (doc_id % 50) || '.'"


def _keyed() -> Column:
    key = (F.col("doc_id") % 50).cast("string")
    return F.concat(ft.present("text"), F.lit(" see @key"), key, F.lit(", @other.key; and @key"), key, F.lit("."))


@query(
    "missing_citation_keys",
    f"""with u as (select source as chapter, unnest(regexp_extract_all({KEYED}, '{_SQL(citations.KEY)}', 1)) as key from documents)
    select key, array_to_string(list_sort(list(distinct chapter)), ',') as chapters, count(*) as uses from u where key not in (select 'key' || n from range(40) t(n)) group by key""",
)
def missing_citation_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as chapters; the bibliography has forty of the fifty keys."""
    chapters = table(spark, sf_dir, "documents").select(F.col("source").alias("chapter"), _keyed().alias("text"))
    bibliography = spark.range(40).select(F.concat(F.lit("key"), F.col("id").cast("string")).alias("key"))
    return citations.missing_keys(chapters, bibliography).withColumn("chapters", F.array_join("chapters", ","))


@query(
    "note_numbers",
    """with c as (select conv_id, turn, unnest(['n' || (turn % 3), 'm' || turn]) as label, unnest([0, 1]) as place from conversations)
    select conv_id, turn, label, row_number() over (partition by conv_id order by turn, place) as number from c""",
)
def note_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as works whose turns call two notes each."""
    turns = table(spark, sf_dir, "conversations")
    text = F.concat(F.lit("a[^n"), (F.col("turn") % 3).cast("string"), F.lit("] b[^m"), F.col("turn").cast("string"), F.lit("] c[^n"), (F.col("turn") % 3).cast("string"), F.lit("]\n[^n1]: text"))
    return citations.note_numbers(turns.select("conv_id", "turn", text.alias("text")), "conv_id", "turn")


@query("works_assembled", "select conv_id, count(*) as chapters, md5(string_agg(coalesce(text, ''), chr(10) || chr(10) order by turn, coalesce(text, ''))) as digest from conversations group by conv_id")
def works_assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = citations.assembled(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    return found.select("conv_id", "chapters", F.md5("text").alias("digest"))


@query("document_counts")
def document_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.document_counts(table(spark, sf_dir, "documents"), "doc_id")


@query(
    "attachments_enriched",
    """with i as (select p_partkey as item_id, 'x' || p_partkey as item_key, upper(p_name) as title from part where p_partkey % 3 = 0
        union all select p_partkey + 1000000000, cast(p_partkey as varchar), 'other' from part where p_partkey % 5 = 0),
    m as (select cast(p_partkey as varchar) as key, item_id from part join i on item_key = cast(p_partkey as varchar) union all select cast(p_partkey as varchar), item_id from part join i on lower(p_name) = lower(title)),
    f as (select key, min(item_id) as item_id from m group by key)
    select cast(p_partkey as varchar) as key, item_id from part left join f on key = cast(p_partkey as varchar)""",
)
def attachments_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some parts are found by name, some by key."""
    part = table(spark, sf_dir, "part")
    by_name = part.filter("p_partkey % 3 = 0").select(F.col("p_partkey").cast("long").alias("item_id"), F.concat(F.lit("x"), F.col("p_partkey").cast("string")).alias("item_key"), F.upper("p_name").alias("title"))
    by_key = part.filter("p_partkey % 5 = 0").select((F.col("p_partkey").cast("long") + 1000000000).alias("item_id"), F.col("p_partkey").cast("string").alias("item_key"), F.lit("other").alias("title"))
    own = part.select(F.col("p_partkey").cast("string").alias("key"), F.col("p_name").alias("title"))
    return library.with_attachments(own, by_name.unionByName(by_key)).select("key", "item_id")


@query("dominant_dimension", "select len(embedding) as dimension, count(*) as vectors from embeddings where embedding is not null group by 1 order by vectors desc, min(vec_id) limit 1")
def dominant_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.dominant_dimension(table(spark, sf_dir, "embeddings"), "vec_id")


@query("orphan_files", "select count(*) as files, cast(sum(o_orderkey % 1000) as bigint) as bytes from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def orphan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files that returned items link to, with other slashes and capitals."""
    files = table(spark, sf_dir, "orders").select(F.concat(F.lit("/F/"), F.col("o_orderkey").cast("string")).alias("path"), (F.col("o_orderkey") % 1000).alias("size"))
    linked = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.concat(F.lit("\\f\\"), F.col("l_orderkey").cast("string")).alias("path"))
    return library.orphan_files(files, linked).agg(F.count(F.lit(1)).alias("files"), F.sum("size").cast("long").alias("bytes"))


@query(
    "changed_files",
    "select c_custkey, case when c_custkey % 7 = 0 then 'missing' else 'modified' end as reason from customer where c_custkey % 7 = 0 or c_custkey % 11 = 0",
)
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    stored = rows.select("c_custkey", F.md5("c_name").alias("digest"))
    now = rows.filter("c_custkey % 7 <> 0").select("c_custkey", F.md5(F.when(F.col("c_custkey") % 11 == 0, F.upper("c_name")).otherwise(F.col("c_name"))).alias("digest"))
    return library.changed_files(stored, now, "c_custkey")


@query(
    "merged_attachments",
    "select c_custkey, c_name || case when c_custkey % 3 = 0 then ' new' else '' end as title, c_custkey % 2 = 0 and c_custkey % 5 <> 0 as downloaded from customer",
)
def merged_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    local = rows.filter("c_custkey % 5 <> 0").select("c_custkey", (F.col("c_custkey") % 2 == 0).alias("downloaded"))
    remote = rows.select("c_custkey", F.concat("c_name", F.when(F.col("c_custkey") % 3 == 0, " new").otherwise("")).alias("title"), F.lit(False).alias("downloaded"))
    return library.merged_attachments(local, remote, "c_custkey")


@query(
    "index_health",
    """with s as (select source, count(*) as stored from documents group by source), i as (select source, count(*) as indexed from documents where doc_id % 10 < 9 or source = 'web' group by source)
    select s.source, stored, coalesce(indexed, 0) as indexed, abs(stored - coalesce(indexed, 0)) > stored * 0.1::double as rebuild from s left join i on s.source is not distinct from i.source where s.source is not null""",
)
def index_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("source is not null")
    return library.index_health(docs, docs.filter("doc_id % 10 < 9 or source = 'web'"), "source")


@query("redacted_customers", "select c_custkey, sha256(c_name) as sha256, length(c_name) as length from customer")
def redacted_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return library.redacted(table(spark, sf_dir, "customer"), ["c_name"]).select("c_custkey", "c_name.sha256", "c_name.length")


_TERMS = [(t, o) for t, others in context.TERMS.items() for o in others]


@query(
    "expanded_queries",
    "with q as (select item_id, case when length(text) % 2 = 0 then 'Constructivisme et ' else 'la Métacognition: ' end || text as text from benchmark), v as (select item_id, text, 0 as k from q"
    + "".join(f" union all select item_id, regexp_replace(text, '{_SQL(t)}', '{_SQL(o)}', 'gi'), {k + 1} from q where contains(lower(text), '{_SQL(t)}')" for k, (t, o) in enumerate(_TERMS))
    + ") select item_id, row_number() over (partition by item_id order by k) - 1 as variant, text from v",
)
def expanded_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.when(F.length("text") % 2 == 0, "Constructivisme et ").otherwise("la Métacognition: ")
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.concat(start, "text").alias("text"))
    return context.expanded(asked, key="item_id").withColumn("variant", F.col("variant").cast("long"))


@query(
    "parsed_rankings",
    """select o_orderkey, array_to_string(list_filter(r, lambda x, i: x between 1 and 9 and list_position(r, x) = i), ',') as ranking from (
        select o_orderkey, [o_orderkey % 13, o_custkey % 11, o_orderkey % 13, 4, o_custkey % 3] as r from orders)""",
)
def parsed_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies that name numbers, some out of range, some twice."""
    number = lambda c, n: (F.col(c) % n).cast("string")
    reply = F.concat(F.lit("Best: "), number("o_orderkey", 13), F.lit(", "), number("o_custkey", 11), F.lit(" > ["), number("o_orderkey", 13), F.lit("] 4; "), number("o_custkey", 3))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(context.ranking(reply, F.lit(9)), ",").alias("ranking"))


@query("density_topics")
def density_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of the embedded documents by density, each with its size and first words; -1 are documents in no topic."""
    vectors = stored(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"))
    near = neighbour_graph.search(neighbour_graph.build(vectors, 64), vectors.select(F.col("id").alias("query_id"), "embedding"), 11, 64)
    edges = near.filter("query_id <> id").select(F.col("query_id").alias("a"), F.col("id").alias("b"), (1 - F.col("similarity")).alias("distance"))
    found = stored(density.clusters(stored(edges), vectors.select(F.col("id").alias("node")), 5, 5).select(F.col("node").alias("doc_id"), F.col("cluster").alias("topic")))
    sizes = found.groupBy("topic").agg(F.count(F.lit(1)).alias("documents"))
    named = topics.labels(topics.keywords(table(spark, sf_dir, "documents"), found))
    return sizes.join(named, "topic", "left")


@query("topics")
def topics_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of the embedded documents, each with its size and first words."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    found = topics.assign(vectors, 20)
    sizes = found.groupBy("topic").agg(F.count(F.lit(1)).alias("documents"))
    named = topics.labels(topics.keywords(table(spark, sf_dir, "documents"), found))
    return sizes.join(named, "topic", "left")


@query("compressed_context")
def compressed_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the best BM25 hits of each benchmark item, cut to 20,000 characters."""
    docs = table(spark, sf_dir, "documents")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    best = search.bm25(docs, asked, 10)
    parts = chunk.fixed_chunks(docs.join(best.select("doc_id").distinct(), "doc_id", "left_semi")).withColumnRenamed("content", "body")
    hits = best.join(parts, "doc_id").join(asked.withColumnRenamed("text", "query"), "query_id")
    ready = hits.select("query_id", "query", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")).alias("id"), F.col("doc_id").alias("document"), (F.col("rank") * 10000 + F.col("chunk_index")).alias("place"), F.col("body").alias("content"), F.col("score").alias("similarity"))
    return context.compressed(ready).select("query_id", "id", "place", "strategy", F.md5("content").alias("content"))


@query(
    "note_links",
    "select doc_id, 'Note ' || (doc_id % 10) as target, case when doc_id % 2 = 0 then 'Part' end as heading, case when doc_id % 3 = 0 then 'shown' end as display from documents",
)
def note_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    link = F.concat(F.lit(" [[Note "), (F.col("doc_id") % 10).cast("string"), F.when(F.col("doc_id") % 2 == 0, "#Part").otherwise(""), F.when(F.col("doc_id") % 3 == 0, "|shown").otherwise(""), F.lit("]]"))
    text = F.concat(F.regexp_replace(ft.present("text"), r"[\[\]]", ""), link)
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(vault.links(text)).alias("l")).select("doc_id", "l.*")


@query("bibtex_round_trip", "select cast(p_partkey as varchar) as id, 'book' as type, p_name || ' & co_' as title, cast(1900 + p_size as varchar) as year, p_brand as author from part")
def bibtex_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written as BibTeX entries, one file's text each, and parsed again."""
    part = table(spark, sf_dir, "part")
    rows = part.select(F.col("p_partkey").cast("string").alias("id"), F.lit("book").alias("type"), F.concat("p_name", F.lit(" & co_")).alias("title"), (1900 + F.col("p_size")).cast("string").alias("year"), F.col("p_brand").alias("author"))
    files = bibtex.as_bibtex(rows).select(F.lit("memory").alias("path"), F.col("value").alias("text"))
    return bibtex.parse_bibtex(files).select("id", "type", "title", "year", "author")


@query("log_retention", "select ts < timestamp '2024-01-15' as expired, count(*) as lines from events group by 1")
def log_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON lines, split at a cutoff."""
    lines = table(spark, sf_dir, "events").select(F.to_json(F.struct(F.col("ts").cast("string").alias("at"), "event_type")).alias("value"))
    kept, expired = logs.split_by_age(lines, "2024-01-15 00:00:00")
    count = lambda df, flag: df.agg(F.count(F.lit(1)).alias("lines")).select(F.lit(flag).alias("expired"), "lines")
    return count(kept, False).unionByName(count(expired, True))
