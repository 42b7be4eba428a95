"""Primary sources, search over several corpora, entity replies and small library functions over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import text as ft
from scriptorium.operators import chunk, context, dedup, entities, library, search, sources, topics
from scriptorium.plans.registry import query
from scriptorium.plans.search_queries import HYBRID, SEARCH_WORDS, _hybrid, _vector_queries, _vectors
from scriptorium.plans.text_queries import CHUNKS, CONTENT_FORM, QUALITY
from scriptorium.sources.tables import stored, table

# --- items and sources ---------------------------------------------------------------------------


def _items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as items and their lines as notes of items, photos and selections."""
    orders = table(spark, sf_dir, "orders")
    items = orders.select(
        F.col("o_orderkey").alias("item_id"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"),
        F.when(F.col("o_custkey") % 2 == 0, F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).alias("creator"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.when(F.col("o_orderkey") % 3 == 0, F.lit("")).otherwise(F.col("o_orderpriority")).alias("archive"),
        F.lit(None).cast("string").alias("collection"),
    )
    n = F.col("l_linenumber")
    notes = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("item_id"),
        F.when(n % 3 != 0, n % 4).alias("photo"),
        F.when(n % 3 == 2, n % 2).alias("selection"),
        n.alias("place"),
        F.when(F.col("l_partkey") % 5 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" note "), F.col("l_partkey").cast("string"), F.lit(" "))).alias("text"),
    )
    return items, notes


@query(
    "item_texts",
    r"""with n as (select l_orderkey as item_id, case when l_linenumber % 3 <> 0 then l_linenumber % 4 end as photo, case when l_linenumber % 3 = 2 then l_linenumber % 2 end as selection, l_linenumber as place,
        case when l_partkey % 5 = 0 then '  ' else ' note ' || l_partkey || ' ' end as text from lineitem),
    g as (select item_id, string_agg(text, chr(10) || chr(10) order by coalesce(photo, -1), coalesce(selection, -1), place, text) as every,
        string_agg(trim(text), chr(10) || chr(10) order by coalesce(photo, -1), coalesce(selection, -1), place, text) filter (trim(text) <> '') as filled,
        count(*) filter (trim(text) <> '' and photo is null) as item_notes, count(*) filter (trim(text) <> '' and photo is not null and selection is null) as photo_notes,
        count(*) filter (trim(text) <> '' and photo is not null and selection is not null) as selection_notes, count(*) filter (trim(text) <> '') as total from n group by item_id)
    select o_orderkey as item_id, md5(concat_ws(chr(10) || chr(10), 'Order ' || o_orderkey, case when o_custkey % 2 = 0 then 'Créateur: c' || o_custkey end, 'Date: ' || strftime(o_orderdate, '%Y-%m-%d'), case when o_orderkey % 3 <> 0 then 'Archive: ' || o_orderpriority end, every)) as text_md5,
        md5(coalesce(filled, '')) as notes_md5, coalesce(item_notes, 0) as item_notes, coalesce(photo_notes, 0) as photo_notes, coalesce(selection_notes, 0) as selection_notes, coalesce(total, 0) as total
    from orders left join g on item_id = o_orderkey""",
)
def item_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sources.item_texts(*_items(spark, sf_dir))
    return found.select("item_id", F.md5("text").alias("text_md5"), F.md5("notes_only").alias("notes_md5"), "item_notes", "photo_notes", "selection_notes", "total")


_SOURCE = "'Titre: Source ' || doc_id || chr(10) || chr(10) || case when doc_id % 2 = 0 then 'Auteur: a' || doc_id || chr(10) else '' end || case when source is null or source = '' then '' else 'Archive: ' || source || chr(10) end || chr(10) || coalesce(text, '')"

_INDEX = (
    f"with src as (select doc_id, {_SOURCE} as text from documents),"
    + CHUNKS.replace("from documents", "from src")
    + ", "
    + QUALITY.replace("select doc_id, list_transform", "select doc_id, chunk_index, list_transform").replace("coalesce(text, '')", "content").replace("from documents", "from chunks").replace("doc_id, unnest(w)", "doc_id, chunk_index, unnest(w)").replace("select doc_id, sum(c", "select doc_id, chunk_index, sum(c").replace("select doc_id, word, count(*) as c", "select doc_id, chunk_index, word, count(*) as c").replace("group by doc_id)", "group by doc_id, chunk_index)").replace("select doc_id, len(w) as words", "select doc_id, chunk_index, len(w) as words").replace("using (doc_id)", "using (doc_id, chunk_index)")
    + f", h as (select doc_id, chunk_index, md5({CONTENT_FORM.format('content')}) as hash, md5(content) as content_md5, score from quality join chunks using (doc_id, chunk_index) where rejected is null)"
    + " select doc_id as source_id, chunk_index, content_md5, score from (select *, row_number() over (partition by doc_id, hash order by chunk_index) as n from h) where n = 1"
)


@query("index_sources", _INDEX)
def index_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as primary sources: lines of fields and the text, in chunks that pass and are told once."""
    docs = table(spark, sf_dir, "documents")
    none, number = F.lit(None).cast("string"), F.col("doc_id").cast("string")
    given = docs.select(F.col("doc_id").alias("source_id"), F.concat(F.lit("Source "), number).alias("title"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("a"), number)).alias("creator"), none.alias("date"), F.col("source").alias("archive"), none.alias("collection"), F.col("text").alias("transcription"))
    return sources.index_sources(given).select("source_id", "chunk_index", F.md5("content").alias("content_md5"), "score")


# --- search --------------------------------------------------------------------------------------

_FUSED = f"""{HYBRID}, kw as (select query_id, list_distinct(list_filter({SEARCH_WORDS.format("text")}, lambda x: length(x) > 4)) as keywords from q),
    boosted as (select f.query_id, f.id, coalesce(dense_similarity, 0.0) as similarity, round(case when len(list_filter(keywords, lambda k: contains(lower(coalesce(d.text, '')), k))) > 0 then 2 * f.score else f.score end, 9) as score from fused f join kw using (query_id) left join documents d on d.doc_id = f.id),
    best as (select *, row_number() over (partition by query_id order by score desc, id) as rank from boosted)"""


@query("hybrid_sources", f"with {_FUSED} select * from best where rank <= 10")
def hybrid_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form for primary sources: words of over four letters double a score, the similarity is the dense one."""
    docs, texts, _, dense, sparse = _hybrid(spark, sf_dir)
    return sources.fused_sources(dense, sparse, docs, texts, 10).withColumn("rank", F.col("rank").cast("long"))


@query(
    "fused_threshold",
    f"""with {_FUSED}, t as (select * from best where rank <= 20), m as (select *, max(score) over (partition by query_id) as top from t)
    select query_id, id, score, row_number() over (partition by query_id order by score desc, id) as rank from m where score >= 0.005 or (top < 0.005 and rank <= 10) qualify row_number() over (partition by query_id order by score desc, id) <= 10""",
)
def fused_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cosine threshold of 0.2 over fused scores."""
    docs, texts, _, dense, sparse = _hybrid(spark, sf_dir)
    best = sources.fused_sources(dense, sparse, docs, texts, 20).select("query_id", "id", "score")
    return sources.above_fused(best, 0.2, 10).select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


_CORPORA = """q as (select vec_id as query_id, embedding as asked from embeddings where vec_id % 20 = 0),
    d as (select query_id, vec_id as id, case when vec_id % 4 = 0 then 'manuscript' when vec_id % 4 = 1 then 'primary' else 'secondary' end as source_type, round(list_cosine_similarity(embedding::double[], asked::double[]), 6) as similarity from embeddings, q where vec_id <> query_id),
    h as (select * from d where similarity >= 0.3),
    numbered as (select *, row_number() over (partition by query_id, source_type = 'manuscript' order by similarity desc, id) as of_kind from h),
    held as (select *, source_type = 'manuscript' and of_kind <= 3 as kept from numbered),
    placed as (select *, count(*) filter (kept) over (partition by query_id) as taken, row_number() over (partition by query_id, kept order by similarity desc, id) as place from held),
    chosen as (select * from placed where kept or place <= 10 - taken)"""


def _in_corpora(spark: SparkSession, sf_dir: str, counted: bool = False) -> tuple[DataFrame, DataFrame]:
    kind = F.when(F.col("id") % 4 == 0, "manuscript").when(F.col("id") % 4 == 1, "primary").otherwise("secondary")
    asked = _vector_queries(spark, sf_dir)
    found = search.nearest_by_kind(_vectors(spark, sf_dir).withColumn("kind", kind), asked, 10, least=0.3, own=False, counted=counted)
    return sources.in_corpora(stored(found) if counted else found, ["manuscript", "primary", "secondary"], asked, 10)


@query("corpora_search", f"with {_CORPORA} select query_id, id, similarity, source_type, row_number() over (partition by query_id order by similarity desc, id) as rank from chosen")
def corpora_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three corpora in one list, places kept for one of them."""
    return _in_corpora(spark, sf_dir)[0].select("query_id", "id", "similarity", "source_type", F.col("rank").cast("long").alias("rank"))


@query(
    "corpora_outcomes",
    f"""with {_CORPORA}, n as (select query_id, unnest(['manuscript', 'primary', 'secondary']) as source_type from q),
    c as (select query_id, source_type, count(*) as hits, max(similarity) as best from h group by all), u as (select query_id, source_type, count(*) as used from chosen group by all)
    select query_id, source_type, case when coalesce(hits, 0) > 0 then 'found' else 'empty' end as outcome, coalesce(hits, 0) as hits, coalesce(used, 0) as used, best from n left join c using (query_id, source_type) left join u using (query_id, source_type)""",
)
def corpora_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_corpora(spark, sf_dir, counted=True)[1]


@query(
    "near_known_chunks",
    f"""with {CHUNKS}, s as (select doc_id, chunk_index, list_distinct(list_filter(string_split_regex({CONTENT_FORM.format("content")}, '\\s+'), lambda x: length(x) > 2)) as w from chunks),
    k as (select w as v from s where doc_id % 20 = 0), c as (select doc_id, chunk_index, w from s where doc_id % 20 <> 0)
    select doc_id, chunk_index, coalesce(bool_or(len(list_intersect(w, v)) / nullif(len(w) + len(v) - len(list_intersect(w, v)), 0) >= 0.85), false) as near from c, k group by all""",
)
def near_known_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of other documents against those of documents whose id is divisible by 20."""
    chunks = chunk.fixed_chunks(table(spark, sf_dir, "documents")).withColumn("id", F.struct("doc_id", "chunk_index"))
    found = sources.near_any(chunks.filter("doc_id % 20 <> 0"), chunks.filter("doc_id % 20 = 0"))
    return found.select("id.doc_id", "id.chunk_index", "near")


# --- entities ------------------------------------------------------------------------------------


@query(
    "reply_entities",
    """with r as (select event_id, user_id, event_type, event_id % 5 as k from events),
    e as (select event_id, 'User ' || user_id as name, 'PERSON' as kind, 'did ' || event_type as context from r where k in (0, 1, 3)
        union all select event_id, 'Day', 'DATE', '' from r where k = 0
        union all select event_id, 'User ' || user_id, 'EVENT', '' from r where k = 2
        union all select event_id, 'User ' || user_id, 'PERSON', '' from r where k = 4
        union all select event_id, 'Place', 'LOCATION', '' from r where k = 4)
    select * from e""",
)
def reply_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies with words around a JSON list, with items of odd types, with a list that isn't closed, with a name that is a number, and with a context that isn't a text."""
    event = table(spark, sf_dir, "events")
    user, kind, case = F.concat(F.lit("User "), F.col("user_id").cast("string")), F.col("event_type"), F.col("event_id") % 5
    person = F.concat(F.lit('{"name": " '), user, F.lit('", "type": "person", "context": "did '), kind, F.lit('"}'))
    text = (
        F.when(case == 0, F.concat(F.lit("Here: ["), person, F.lit(',\n{"name": "Day", "type": "DATE", "context": null}, {"name": "", "type": "DATE"}] done')))
        .when(case == 1, F.concat(F.lit("["), person, F.lit(', {"name": "x", "type": "thing"}, null, 7]')))
        .when(case == 2, F.concat(F.lit('[{"name": "'), user, F.lit('", "type": "thing", "context": "cut')))
        .when(case == 3, F.concat(F.lit("["), person, F.lit(', {"name": 5, "type": "PERSON"}, {"name": "y", "type": ["DATE"]}]')))
        .otherwise(F.concat(F.lit('[{"name": "'), user, F.lit('", "type": "Person", "context": {"a": 1}}, {"name": "Place", "type": "location"}]')))
    )
    return sources.reply_entities(event.select("event_id", text.alias("text")), "event_id")


@query(
    "entity_contexts",
    """with e as (select s_suppkey as entity_id, s_name as name, lower(s_name) as normalized from supplier),
    m as (select l_orderkey * 10 + l_linenumber as mention_id, l_suppkey as entity_id, l_orderkey as source_id, l_returnflag || ' context' as context from lineitem),
    p as (select 0 as place, m.*, name, o_orderpriority as title, 'primary' as corpus from m join e using (entity_id) left join orders on o_orderkey = source_id and o_orderkey % 2 = 0 where contains(normalized, '00001')),
    s as (select 1 as place, p_partkey as mention_id, p_partkey % 10 + 1 as entity_id, p_partkey as source_id, p_type as context, name, p_name as title, 'secondary' as corpus from part join e on e.entity_id = p_partkey % 10 + 1 where contains(normalized, '00001'))
    select mention_id, entity_id, name, 'ORGANIZATION' as kind, source_id, title, corpus, context from (select * from p union all by name select * from s) order by place, mention_id limit 200""",
)
def entity_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as entities of orders and of parts; some orders have no title."""
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("name"), F.lower("s_name").alias("normalized"), F.lit("ORGANIZATION").alias("kind"))
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("mention_id"), F.col("l_suppkey").alias("entity_id"), F.col("l_orderkey").alias("source_id"), F.concat("l_returnflag", F.lit(" context")).alias("context"))
    titles = table(spark, sf_dir, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("source_id"), F.col("o_orderpriority").alias("title"))
    part = table(spark, sf_dir, "part")
    in_parts = part.select(F.col("p_partkey").alias("mention_id"), (F.col("p_partkey") % 10 + 1).alias("entity_id"), F.col("p_partkey").alias("source_id"), F.col("p_type").alias("context"))
    corpora = {"primary": (supplier, lines, titles), "secondary": (supplier, in_parts, part.select(F.col("p_partkey").alias("source_id"), F.col("p_name").alias("title")))}
    return sources.entity_context(corpora, "00001", 200)


@query(
    "same_names",
    """with n as (select c_custkey as id, lower(c_name) as a, case c_custkey % 4 when 0 then lower(c_name) when 1 then 'customer' when 2 then 'other name' else '' end as b, case when c_custkey % 3 = 0 then 'PERSON' when c_custkey % 3 = 1 then 'LOCATION' else 'ORGANIZATION' end as kind from customer),
    p as (select *, list_filter(string_split_regex(a, '[\\s#-]+'), lambda x: length(x) > 1) as pa, list_filter(string_split_regex(b, '[\\s#-]+'), lambda x: length(x) > 1) as pb from n)
    select id, a <> '' and b <> '' and (a = b or case when kind = 'PERSON' then id % 4 = 1 when kind = 'LOCATION' then false else id % 4 = 1 end) as same from p""",
)
def same_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers under their name, its first part, another and none."""
    name, n = F.lower(F.regexp_replace("c_name", "#", " ")), F.col("c_custkey")
    other = F.when(n % 4 == 0, name).when(n % 4 == 1, F.lit("customer")).when(n % 4 == 2, F.lit("other name")).otherwise("")
    kind = F.when(n % 3 == 0, "PERSON").when(n % 3 == 1, "LOCATION").otherwise("ORGANIZATION")
    return table(spark, sf_dir, "customer").select(n.alias("id"), entities.same_entity(name, other, kind).alias("same"))


@query("node_sizes", "select l_suppkey as node, count(*) as mentions, round(least(8.0, 2 + log2(count(*))), 6) as size from lineitem group by 1")
def node_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("node")).agg(F.count(F.lit(1)).alias("mentions"))
    return counts.withColumn("size", F.round(sources.node_size(F.col("mentions")), 6))


# --- dates, keys, matches ------------------------------------------------------------------------


@query(
    "parsed_dates",
    """select o_orderkey, case when o_orderkey % 4 <> 3 then o_orderdate::timestamp end as at, case when o_orderkey % 4 <> 3 then strftime(o_orderdate, '%Y') end as year from orders""",
)
def parsed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as PDF files write them and as free text."""
    n = F.col("o_orderkey")
    raw = F.when(n % 4 == 3, F.lit("D:2020")).otherwise(F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.lit("Z")))
    free = F.when(n % 4 == 3, F.lit("n. d.")).otherwise(F.concat(F.lit("printed "), F.date_format("o_orderdate", "yyyy"), F.lit(", again 2099")))
    return table(spark, sf_dir, "orders").select("o_orderkey", sources.pdf_date(raw).cast("timestamp_ntz").alias("at"), sources.year_of(free).alias("year"))


@query(
    "cache_keys",
    """with d as (select doc_id, coalesce(text, '') as t from documents),
    h as (select doc_id, t, list_reduce(list_prepend(0::bigint, list_transform(string_split(t, ''), lambda c: case when c = '' then 0 else ord(c) end)::bigint[]), lambda h, c: (h * 31 + c) % 4294967296) as h from d)
    select doc_id, case when length(t) <= 100 then trim(lower(t)) else 'hash_' || (case when h >= 2147483648 then h - 4294967296 else h end) || '_' || length(t) end as key from h""",
)
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", sources.cache_key(ft.present("text")).alias("key"))


@query(
    "capped_matches",
    f"""with f as (select doc_id, translate(lower(coalesce(text, '')), '{ft.ACCENTED}', '{ft.PLAIN}') as f from documents), n as (select doc_id, (length(f) - length(replace(f, 'en', ''))) // 2 as n, strpos(f, 'en') - 1 as first from f where contains(f, 'en'))
    select doc_id, least(n, 200) as matches, n > 200 as truncated, first from n""",
)
def capped_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most two hundred places of a string in a document are listed, with word of further ones: the feature of an editor's search."""
    found = sources.matches(table(spark, sf_dir, "documents"), "en")
    return found.select("doc_id", "matches", "truncated", F.get("places", F.lit(0)).cast("long").alias("first"))


# --- collections, ideas, topics ------------------------------------------------------------------


@query(
    "collection_summaries",
    """with i as (select s_nationkey as collection, s_suppkey as item from supplier), c as (select l_suppkey as parent, l_partkey from lineitem where l_returnflag = 'R' and l_linestatus = 'F'),
    g as (select collection, count(*) as items, sum(n) as pdfs from (select collection, item, count(parent) as n from i left join c on item = parent group by all) group by collection)
    select n_nationkey as collection, n_name as name, coalesce(items, 0) as items, coalesce(pdfs, 0)::bigint as pdfs from nation left join g on collection = n_nationkey""",
)
def collection_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as collections of suppliers; some lines as PDF attachments."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("collection"), F.col("n_name").alias("name"))
    items = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("collection"), F.col("s_suppkey").alias("item"))
    kind, content = F.when(F.col("l_returnflag") == "R", "attachment").otherwise("note"), F.when(F.col("l_linestatus") == "F", "application/pdf").otherwise("text/html")
    children = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("parent"), kind.alias("item_type"), content.alias("content_type"))
    return sources.collection_summary(nations, items, children)


@query(
    "idea_graph_nodes",
    """with i as (select doc_id as idea, source as title from documents), l as (select distinct doc_id as source, doc_id * 2 as target from documents)
    select idea as node, 'idea' as kind, title as label from i union all select distinct target, 'citation', cast(target as varchar) from l where target not in (select idea from i)""",
)
def idea_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    nodes, _ = sources.idea_graph(docs.select(F.col("doc_id").alias("idea"), F.col("source").alias("title")), docs.select(F.col("doc_id").alias("idea"), (F.col("doc_id") * 2).alias("target")))
    return nodes.withColumn("label", F.col("label").cast("string"))


@query("stream_columns", "select year(o_orderdate)::int as year, nullif(count(*) filter (o_orderkey % 3 = 0), 0) as topic_0, nullif(count(*) filter (o_orderkey % 3 = 1), 0) as topic_1, nullif(count(*) filter (o_orderkey % 3 = 2), 0) as topic_2, null::bigint as topic_3 from orders group by 1")
def stream_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").cast("string").alias("year"), (F.col("o_orderkey") % 3).alias("topic")).agg(F.count(F.lit(1)).alias("count"))
    words = spark.createDataFrame([(0, 1, "a")], "topic long, place long, word string")
    return sources.stream_columns(counts, words, [0, 1, 2, 3])[0]


@query("topic_labels", "select s_nationkey::bigint as topic, array_to_string((list(s_name order by s_suppkey))[1:3], ', ') as label from supplier group by 1")
def topic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as the words of their nation's topic."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")).cast("long")
    words = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("topic"), place.alias("place"), F.col("s_name").alias("word"))
    return topics.labels(words, 3)


@query("topic_documents", "select label::bigint as topic, count(*) as documents, md5(array_to_string(list_sort(list(vec_id)), ',')) as keys_md5 from embeddings where label >= 0 group by 1")
def topic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sources.topic_documents(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").cast("long").alias("topic")))
    return found.select("topic", "documents", F.md5(F.array_join(F.transform("keys", lambda k: k.cast("string")), ",")).alias("keys_md5"))


@query("decisions_between", "select o_orderkey as id, o_orderdate as date, o_orderstatus as status from orders where o_orderdate >= '1995-01-01' and o_orderdate < '1996-01-01' and o_orderstatus = 'F' order by o_orderdate, o_orderkey")
def decisions_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of a status in a range of days, by date; the filters reach the scan."""
    from scriptorium.operators import journal

    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("date"), F.col("o_orderstatus").alias("status"))
    return journal.between(rows, "1995-01-01", "1996-01-01", at="date", status="F").orderBy("date", "id")


# --- upkeep helpers ------------------------------------------------------------------------------


@query("metadata_merged", "select p_partkey as key, case when p_partkey % 3 = 0 then 'm' || p_partkey else p_name end as name, case when p_partkey % 3 = 0 and p_partkey % 2 = 0 then 'b' else p_brand end as brand from part")
def metadata_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    metadata = part.filter("key % 3 = 0").select("key", F.concat(F.lit("m"), F.col("key").cast("string")).alias("name"), F.when(F.col("key") % 2 == 0, F.lit("b")).alias("brand"))
    return library.with_metadata(part, metadata, "key", ["name", "brand"])


@query("rekeyed_metadata", "select p_partkey, coalesce(case when p_partkey % 2 = 0 then 'z' || p_partkey end, p_name) as key from part")
def rekeyed_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("z"), F.col("p_partkey").cast("string"))).alias("zotero_key"), F.col("p_name").alias("id"))
    return library.rekeyed(rows, "zotero_key", "id").select("p_partkey", "key")


@query("collection_members", "select distinct l_partkey as doc_id, l_suppkey % 7 as collection from lineitem join part on p_partkey = l_partkey where p_partkey % 4 <> 0")
def collection_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_partkey").cast("string")).alias("bibtex_key"))
    members = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("bibtex_key"), (F.col("l_suppkey") % 7).alias("collection"))
    return library.members_of(docs, members)


@query("projects_to_sync", "select c_custkey as project from customer where c_custkey % 5 = 0 or c_custkey % 7 = 0")
def projects_to_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects whose path moved (every fifth) or whose file is newer (every seventh)."""
    n = F.col("c_custkey")
    customer = table(spark, sf_dir, "customer")
    projects = customer.select(n.alias("project"), F.concat(F.lit("/p/"), n.cast("string")).alias("path"), F.lit(100).alias("synced"))
    files = customer.select(n.alias("project"), F.concat(F.when(n % 5 == 0, F.lit("/moved/")).otherwise("/p/"), n.cast("string")).alias("path"), F.when(n % 7 == 0, 101).otherwise(99).alias("modified"))
    return library.needs_sync(projects, files)


@query("latest_runs", "select o_custkey, o_orderkey, o_orderdate from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) = 1")
def latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return library.latest_analysis(runs, "o_custkey", "o_orderdate", "o_orderkey")


@query("vanished_rows", "select o_orderkey, o_orderstatus from orders where o_orderkey % 6 = 0")
def vanished_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return library.first_unseen(orders, orders.filter("o_orderkey % 6 <> 0"), "o_orderkey")


@query("spellings_once", "select p_partkey as id, case when p_partkey % 2 = 0 then lower(p_brand) || '|x' else p_brand || '|' || lower(p_type) end as tags from part where p_partkey % 2 = 0 or lower(p_brand) <> lower(p_type)")
def spellings_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.operators import bibliography

    n = F.col("p_partkey")
    tags = F.when(n % 2 == 0, F.array(F.lower("p_brand"), F.upper("p_brand"), F.lit("x"), F.lit("X"))).otherwise(F.array(F.col("p_brand"), F.lower("p_type"), F.upper("p_type"), F.lower("p_brand")))
    found = bibliography.first_spellings(table(spark, sf_dir, "part").select(n.alias("id"), tags.alias("tags")), "id", "tags")
    return found.withColumn("tags", F.array_join("tags", "|"))


@query(
    "display_strings",
    """select doc_id, md5(case when doc_id % 3 = 0 then coalesce(source, '') else 'a' || doc_id || ' (' || (1900 + doc_id % 100) || ')' end) as shown, md5(case when length(text) > 4000 then substr(text, 1, 4000) || '…' else text end) as cut,
        case when doc_id % 5 = 0 then 1000 + doc_id when doc_id % 5 = 1 then 128000 when doc_id % 5 = 2 then 32768 else 8192 end as window_size from documents where source is not null or doc_id % 3 <> 0""",
)
def display_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    model = F.when(n % 5 == 1, "big-model").when(n % 5 == 2, "mid-model-7b").otherwise("tiny")
    override = F.when(n % 5 == 0, 1000 + n).otherwise(F.lit(0))
    author, year = F.when(n % 3 != 0, F.concat(F.lit("a"), n.cast("string"))), (1900 + n % 100).cast("string")
    docs = table(spark, sf_dir, "documents").filter("source is not null or doc_id % 3 <> 0")
    return docs.select("doc_id", F.md5(ft.display_name(author, year, F.col("source"))).alias("shown"), F.md5(ft.truncated(F.col("text"))).alias("cut"), ft.context_window(model, override, [("^big", 128_000), ("7b$", 32_768)]).cast("long").alias("window_size"))


@query(
    "chunks_in_context",
    f"with {CHUNKS} select doc_id, chunk_index, md5('[Doc: ' || source || ' | Section: ' || lang || ']' || chr(10) || chr(10) || content) as content_md5 from chunks join documents using (doc_id) where source is not null and lang is not null",
)
def chunks_in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    joined = chunk.fixed_chunks(docs).join(docs.filter("source is not null and lang is not null").select("doc_id", "source", "lang"), "doc_id")
    return chunk.with_context(joined, "source", "lang").select("doc_id", "chunk_index", F.md5("content").alias("content_md5"))


@query("metric_changes", "select k, round(recall_b - recall_a, 6) as recall, round(mrr_b - mrr_a, 6) as mrr from (select l_linenumber::bigint as k, avg(l_quantity) as recall_a, avg(l_tax) as mrr_a from lineitem where l_orderkey % 2 = 0 group by 1) join (select l_linenumber::bigint as k, avg(l_quantity) as recall_b, avg(l_tax) as mrr_b from lineitem where l_orderkey % 2 = 1 group by 1) using (k)")
def metric_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = lambda n: table(spark, sf_dir, "lineitem").filter(f"l_orderkey % 2 = {n}").groupBy(F.col("l_linenumber").cast("long").alias("k")).agg(F.avg("l_quantity").alias("recall"), F.avg("l_tax").alias("mrr"))
    found = context.metric_differences(run(0), run(1))
    return found.select("k", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"))
