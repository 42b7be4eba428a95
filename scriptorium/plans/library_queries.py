"""Bibliography, facets, hierarchies, change and merge queries over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.operators import bibliography as bib
from scriptorium.plans.registry import query
from scriptorium.sources.tables import table


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))


@query("publications_by_year", "select cast(year(o_orderdate) as varchar) as year, count(*) as count, round(100.0 * count(*) / sum(count(*)) over (), 1) as percent from orders group by 1")
def publications_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bib.by_year(_orders(spark, sf_dir), "year")


@query("share_by_type", "select p_type, count(*) as count, round(100.0 * count(*) / sum(count(*)) over (), 1) as percent from part group by 1")
def share_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bib.shares(table(spark, sf_dir, "part"), "p_type")


@query("timeline_cumulative", "select year, annual, cast(sum(annual) over (order by year) as bigint) as cumulative from (select year(o_orderdate) as year, count(*) as annual from orders group by 1)")
def timeline_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bib.timeline(_orders(spark, sf_dir), "year").select(F.col("year").cast("long").alias("year"), "annual", "cumulative")


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("topic_timeline_pivot", "select cast(year(o_orderdate) as bigint) as year, " + ", ".join(f"nullif(count(*) filter (o_orderpriority = '{p}'), 0) as topic_{i}" for i, p in enumerate(PRIORITIES)) + " from orders group by 1")
def topic_timeline_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), F.col("o_orderpriority")) - 1
    return bib.pivoted(_orders(spark, sf_dir).withColumns({"topic": place, "year": F.col("year").cast("long")}), "year", "topic", list(range(5)), "topic_")


@query(
    "coauthors",
    """with r as (select distinct l_orderkey, l_suppkey as author, year(l_shipdate) as year from lineitem),
    p as (select a.author, count(distinct b.author) as coauthors from (select distinct l_orderkey, author from r) a join (select distinct l_orderkey, author from r) b on a.l_orderkey = b.l_orderkey and a.author <> b.author group by 1)
    select author, count(distinct l_orderkey) as works, coalesce(any_value(coauthors), 0) as coauthors, array_to_string(list_sort(list(distinct year)), ',') as years from r left join p using (author) group by author""",
)
def coauthors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as authors of orders."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("author"), F.year("l_shipdate").alias("year"))
    return bib.author_statistics(rows, "l_orderkey", "author", "year").withColumn("years", F.array_join("years", ","))


@query("author_split", "select trim(a) as author, count(*) as count from (select unnest(string_split_regex(p_name || ' and ' || p_brand, '\\s+and\\s+|,|;')) as a from part) where trim(a) <> '' group by 1 order by count desc, author limit 10")
def author_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.explode(bib.split_authors(F.concat("p_name", F.lit(" and "), "p_brand"))).alias("author"))
    return names.groupBy("author").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "author").limit(10)


@query(
    "coverage",
    "select field, filled, round(100.0 * filled / n, 1) as percent from (select count(*) as n, count(*) filter (text <> '') as text, count(*) filter (lang <> '') as lang, count(*) filter (source <> '') as source from documents) unpivot (filled for field in (text, lang, source))",
)
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bib.coverage(table(spark, sf_dir, "documents"), ["text", "lang", "source"])


@query("corpus_overview", "select count(*) as documents, count(distinct lang) as languages, array_to_string(list_sort(list(distinct lang)), ',') as lang_list, count(distinct source) as sources, min(n_chars) as shortest, max(n_chars) as longest from documents")
def corpus_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_distinct("lang").alias("languages"),
        F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("lang_list"),
        F.count_distinct("source").alias("sources"),
        F.min("n_chars").alias("shortest"),
        F.max("n_chars").alias("longest"),
    )


@query(
    "ocr_report",
    """select source, count(*) as pages, round(avg(quality), 6) as mean_quality, min(quality) as worst, max(quality) as best, cast(sum(n_chars) as bigint) as characters,
        count(*) filter (n_chars < 1000) as short, count(*) filter (n_chars >= 1000 and n_chars < 5000) as medium, count(*) filter (n_chars >= 5000) as long
    from documents left join labels using (doc_id) group by source""",
)
def ocr_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, means and a histogram by source; labels stand for page quality."""
    joined = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    n = F.col("n_chars")
    return joined.groupBy("source").agg(
        F.count(F.lit(1)).alias("pages"),
        F.round(F.avg("quality"), 6).alias("mean_quality"),
        F.min("quality").alias("worst"),
        F.max("quality").alias("best"),
        F.sum("n_chars").alias("characters"),
        F.count_if(n < 1000).alias("short"),
        F.count_if((n >= 1000) & (n < 5000)).alias("medium"),
        F.count_if(n >= 5000).alias("long"),
    )


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source", F.array("lang", "source", F.when(F.col("n_chars") > 5000, "long").otherwise("short")).alias("tags"))


TAGGED = "t as (select doc_id, n_chars, source, [lang, source, case when n_chars > 5000 then 'long' else 'short' end] as tags from documents)"


@query("faceted_any", f"with {TAGGED} select doc_id, n_chars from t where contains(lower(source), 'src1') and list_has_any(tags, ['fr', 'long'])")
def faceted_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bib.faceted(_tagged(spark, sf_dir), "SRC1", ("source",), any_of=["fr", "long"]).select("doc_id", "n_chars")


@query("faceted_all", f"with {TAGGED} select doc_id, n_chars from t where list_has_all(tags, ['fr', 'short']) and source = 'src3'")
def faceted_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bib.faceted(_tagged(spark, sf_dir), all_of=["fr", "short"], source="src3").select("doc_id", "n_chars")


@query("tag_counts", f"with {TAGGED} select tag, count(*) as count from (select unnest(tags) as tag from t) group by tag")
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bib.tag_counts(_tagged(spark, sf_dir))


@query("files_by_entry", "select coalesce(nullif(source, 'src0'), cast(doc_id as varchar)) as entry, count(*) as files, min(doc_id) as first, md5(array_to_string(list_sort(list(doc_id)), ',')) as ids from documents group by 1")
def files_by_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by entry key, else by their own id."""
    entry = F.coalesce(F.nullif(F.col("source"), F.lit("src0")), F.col("doc_id").cast("string"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",")
    return table(spark, sf_dir, "documents").groupBy(entry.alias("entry")).agg(F.count(F.lit(1)).alias("files"), F.min("doc_id").alias("first"), F.md5(ids).alias("ids"))


# --- hierarchies: regions hold nations, nations hold customers -----------------------------------

TREE = """tree as (select 'r' || r_regionkey as key, r_name as name, null as parent from region
    union all select 'n' || n_nationkey, n_name, 'r' || n_regionkey from nation
    union all select 'c' || c_custkey, c_name, 'n' || c_nationkey from customer)"""


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    node = lambda t, letter, k, name, up, parent: table(spark, sf_dir, t).select(F.concat(F.lit(letter), F.col(k).cast("string")).alias("key"), F.col(name).alias("name"), (F.concat(F.lit(up), F.col(parent).cast("string")) if parent else F.lit(None).cast("string")).alias("parent"))
    return node("region", "r", "r_regionkey", "r_name", "", None).unionByName(node("nation", "n", "n_nationkey", "n_name", "r", "n_regionkey")).unionByName(node("customer", "c", "c_custkey", "c_name", "n", "c_nationkey"))


@query(
    "hierarchy_closure",
    f"""with recursive {TREE}, c as (select key, 0 as level from tree where key in ('r1', 'r3') union all select t.key, c.level + 1 from tree t join c on t.parent = c.key)
    select key, cast(level as bigint) as level from c""",
)
def hierarchy_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _tree(spark, sf_dir)
    return bib.closure(nodes, nodes.filter(F.col("key").isin("r1", "r3"))).select("key", F.col("level").cast("long").alias("level"))


@query(
    "hierarchy_ordered",
    f"""with recursive {TREE}, c as (select key, name, parent, 0 as level, name || chr(1) || key as path from tree where parent is null
        union all select t.key, t.name, t.parent, c.level + 1, c.path || chr(2) || t.name || chr(1) || t.key from tree t join c on t.parent = c.key)
    select key, name, cast(level as bigint) as level, row_number() over (order by path) as place from c""",
)
def hierarchy_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = bib.depth_first(_tree(spark, sf_dir))
    return ordered.select("key", "name", F.col("level").cast("long").alias("level"), F.row_number().over(Window.orderBy("path")).cast("long").alias("place"))


# --- change and merge ------------------------------------------------------------------------------

LOCAL = "l as (select c_custkey as key, c_name as name, c_mktsegment as segment, c_acctbal as balance from customer where c_custkey % 10 <> 0)"
REMOTE = "r as (select c_custkey as key, case when c_custkey % 7 = 0 then c_name || ' II' else upper(c_name) end as name, case when c_custkey % 11 = 0 then 'OTHER' else c_mktsegment end as segment, c_acctbal as balance from customer where c_custkey % 13 <> 0)"


def _local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").filter("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))


def _remote(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("c_custkey") % 7 == 0, F.concat("c_name", F.lit(" II"))).otherwise(F.upper("c_name"))
    segment = F.when(F.col("c_custkey") % 11 == 0, "OTHER").otherwise(F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").filter("c_custkey % 13 <> 0").select(F.col("c_custkey").alias("key"), name.alias("name"), segment.alias("segment"), F.col("c_acctbal").alias("balance"))


@query(
    "diff_status",
    f"""with {LOCAL}, {REMOTE}, j as (select coalesce(l.key, r.key) as key, l.key is null as a, r.key is null as d, lower(trim(l.name)) <> lower(trim(r.name)) as n, lower(trim(l.segment)) <> lower(trim(r.segment)) as s from l full outer join r on l.key = r.key)
    select key, case when a then 'added' when d then 'deleted' when n or s then 'modified' else 'unchanged' end as status,
        concat_ws(',', case when n then 'name' end, case when s then 'segment' end) as changed from j""",
)
def diff_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bib.differences(_local(spark, sf_dir), _remote(spark, sf_dir), "key", ["name", "segment", "balance"]).withColumn("changed", F.array_join("changed", ","))


@query("merge_remote", f"with {LOCAL}, {REMOTE} select r.key, r.name, coalesce(l.segment, r.segment) as segment, r.balance from r left join l using (key)")
def merge_remote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bib.apply_remote(_local(spark, sf_dir), _remote(spark, sf_dir), "key", ("segment",))


@query("merge_local", f"with {LOCAL}, {REMOTE} select * from l union all select * from r where key not in (select key from l)")
def merge_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bib.apply_local(_local(spark, sf_dir), _remote(spark, sf_dir), "key")


@query("merge_chosen", f"with {LOCAL}, {REMOTE} select * from l where not (key % 3 = 0) union all select * from r where key % 3 = 0")
def merge_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    choices = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 3 == 0, "remote").otherwise("local").alias("choice"))
    return bib.apply_choices(_local(spark, sf_dir), _remote(spark, sf_dir), choices, "key")


@query(
    "layered_override",
    f"""with {LOCAL}, {REMOTE}, u as (select *, 'project' as layer, 1 as p from l where key % 2 = 0 union all select *, 'builtin', 3 from r)
    select key, name, segment, balance, layer from (select *, row_number() over (partition by key order by p) as n from u) where n = 1""",
)
def layered_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _local(spark, sf_dir).filter("key % 2 = 0").withColumn("layer", F.lit("project")).unionByName(_remote(spark, sf_dir).withColumn("layer", F.lit("builtin")))
    return bib.layered(rows, "key", "layer", ["project", "global", "builtin"])


@query("latest_rows", "select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as n from events) where n = 1")
def latest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return bib.latest(rows, ["user_id", "event_type"], "ts", "event_id").drop("ts")


@query("replaced_children", "select l_orderkey, l_linenumber, l_partkey from lineitem where l_orderkey % 4 <> 0 union all select o_orderkey, 1, 0 from orders where o_orderkey % 4 = 0")
def replaced_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    children = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    new = table(spark, sf_dir, "orders").filter("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(0).cast("long").alias("l_partkey"))
    every = children.join(table(spark, sf_dir, "orders").filter("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_anti").filter("l_orderkey % 4 <> 0")
    return bib.replace_children(every, new, "l_orderkey")


@query("cascade_delete", "select l_orderkey, l_linenumber from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'P')")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return bib.without_parents(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), gone, "l_orderkey")


@query("orphans", "select e.vec_id, e.label from embeddings e where not exists (select 1 from labels l where l.doc_id = e.vec_id)")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bib.orphans(table(spark, sf_dir, "embeddings").select("vec_id", "label"), table(spark, sf_dir, "labels"), "vec_id", "doc_id")


@query("legacy_import", f"with {LOCAL}, {REMOTE} select * from l union all select * from r where key not in (select key from l)")
def legacy_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bib.imported(_local(spark, sf_dir), _remote(spark, sf_dir), "key")


@query(
    "incremental_status",
    "select doc_id, case when doc_id % 9 = 0 then 'new' when doc_id % 11 = 0 then 'vanished' when doc_id % 5 = 0 and text <> '' then 'changed' else 'unchanged' end as status from documents where not (doc_id % 9 = 0 and doc_id % 11 = 0)",
)
def incremental_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against a stored index: some unknown to it, some gone, some with another content."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = docs.filter("doc_id % 9 <> 0").select("doc_id", F.sha2(F.when((F.col("doc_id") % 5 == 0) & (F.col("doc_id") % 11 != 0), "").otherwise(F.col("text")), 256).alias("hash"))
    current = docs.filter("doc_id % 11 <> 0").select("doc_id", F.col("text").alias("content"))
    return bib.changed_contents(stored, current, "doc_id")


@query("wide_items", "select id, name, balance from (select c_custkey as id, c_name as name, cast(c_nationkey as varchar) as balance from customer)")
def wide_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as entity-attribute-value rows and back."""
    c = table(spark, sf_dir, "customer")
    values = c.select(F.col("c_custkey").alias("item_id"), F.lit("name").alias("field"), F.col("c_name").alias("value")).unionByName(c.select(F.col("c_custkey").alias("item_id"), F.lit("balance").alias("field"), F.col("c_nationkey").cast("string").alias("value")))
    return bib.wide_items(values).select(F.col("item_id").alias("id"), F.col("fields")["name"].alias("name"), F.col("fields")["balance"].alias("balance"))


@query("ordered_creators", "select l_orderkey, array_to_string(list(l_partkey order by l_linenumber, l_partkey), ',') as parts from lineitem group by l_orderkey")
def ordered_creators(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bib.ordered_list(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_linenumber"], "l_partkey", "parts")
    return rows.select("l_orderkey", F.array_join(F.transform("parts", lambda x: x.cast("string")), ",").alias("parts"))


@query("paged_items", "select p_partkey, p_name from part where p_type = 'ECONOMY' order by p_name, p_partkey limit 25 offset 50")
def paged_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter("p_type = 'ECONOMY'").select("p_partkey", "p_name").orderBy("p_name", "p_partkey").offset(50).limit(25)


@query("documents_with_counts", "select o_orderkey, o_orderstatus, coalesce(n, 0) as chunks from orders left join (select l_orderkey, count(*) as n from lineitem group by 1) on l_orderkey = o_orderkey")
def documents_with_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents with the number of their children, in one join."""
    counts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    joined = table(spark, sf_dir, "orders").join(counts, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("o_orderkey", "o_orderstatus", F.coalesce("n", F.lit(0)).cast("long").alias("chunks"))


@query("title_or_key_match", "select n_nationkey, min(c_custkey) as first from nation join customer on c_nationkey = n_nationkey or lower(c_mktsegment) = lower(n_name) group by 1")
def title_or_key_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An either-or match as the union of two equi joins."""
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    by_key = n.join(c, F.col("c_nationkey") == F.col("n_nationkey")).select("n_nationkey", "c_custkey")
    by_title = n.join(c, F.lower("c_mktsegment") == F.lower("n_name")).select("n_nationkey", "c_custkey")
    return by_key.unionByName(by_title).groupBy("n_nationkey").agg(F.min("c_custkey").alias("first"))
