"""Retrieval queries over documents, embeddings and benchmark items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import text as ft
from scriptorium.functions import vectors as fv
from scriptorium.operators import fulltext, neighbour_graph, search
from scriptorium.plans.registry import query
from scriptorium.sources.tables import stored, table

#: SQL for the words of a text, as search_words, okapi_words.
SEARCH_WORDS = r"list_filter(string_split(trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda x: x <> '')"
OKAPI_WORDS = r"list_filter(string_split_regex(lower(coalesce({0}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: length(x) >= 2)"


def bm25_sql(words: str, length: str, queries: str, k1: float = 1.5, b: float = 0.75) -> str:
    """CTEs ending in scored(query_id, doc_id, score); queries must be a CTE body with query_id, text."""
    return f"""
q as ({queries}),
terms as (select query_id, term, count(*) as weight from (select query_id, unnest({words.format("text")}) as term from q) group by all),
tokens as (select doc_id, {words.format("text")} as w from documents),
sized as (select doc_id, w, {length} as length from tokens),
whole as (select count(*) as n, avg(length) as mean_length from sized),
postings as (
    select doc_id, length, term, count(*) as tf from (select doc_id, length, unnest(w) as term from sized)
    where term in (select term from terms) group by all
),
dfs as (select term, count(*) as df from postings group by term),
scored as (
    select query_id, doc_id, round(sum(weight * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * length / mean_length))), 6) as score
    from postings join terms using (term) join dfs using (term), whole group by query_id, doc_id
)"""


FREQUENT = f"""select 0 as query_id, string_agg(term, ' ' order by term) as text from (
    select term, count(*) as c from (select unnest({SEARCH_WORDS.format("text")}) as term from documents) where length(term) >= 6 group by term order by c desc, term limit 3)"""
ITEMS = "select item_id as query_id, text from benchmark"


def _frequent_query(docs: DataFrame) -> DataFrame:
    """One query of the three most frequent words of six letters and more."""
    words = docs.select(F.explode_outer(ft.search_words(ft.present("text"))).alias("term")).filter("length(term) >= 6")
    top = words.groupBy("term").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "term").limit(3)
    return top.agg(F.array_join(F.array_sort(F.collect_list("term")), " ").alias("text")).select(F.lit(0).cast("long").alias("query_id"), "text")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(
    "bm25_topk",
    f"with {bm25_sql(SEARCH_WORDS, 'len(list_distinct(w))', FREQUENT)} select doc_id, lang, source, score, row_number() over (order by score desc, doc_id) as rank from scored join documents using (doc_id) order by score desc, doc_id limit 10",
)
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    best = search.bm25(docs, _frequent_query(docs), 10)
    return docs.select("doc_id", "lang", "source").join(F.broadcast(best), "doc_id").select("doc_id", "lang", "source", "score", F.col("rank").cast("long").alias("rank"))


@query(
    "okapi_topk",
    f"with {bm25_sql(OKAPI_WORDS, 'len(w)', ITEMS)} select * from (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from scored) where rank <= 10",
)
def okapi_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.bm25(table(spark, sf_dir, "documents"), _items(spark, sf_dir), 10, words=ft.okapi_words, distinct_length=False)
    return found.withColumn("rank", F.col("rank").cast("long"))


@query(
    "conjunctive_search",
    f"""with {bm25_sql(SEARCH_WORDS, 'len(list_distinct(w))', ITEMS, 1.2)},
    asked as (select query_id, list_distinct({SEARCH_WORDS.format("text")}) as asked from q)
    select query_id, doc_id, score from scored join asked using (query_id) join tokens using (doc_id) where list_has_all(w, asked)""",
)
def conjunctive_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(table(spark, sf_dir, "documents"), _items(spark, sf_dir), None, k1=1.2)


RELEVANT = "select item_id as query_id, doc_id from benchmark b join documents d on contains(d.text, b.text)"


@query(
    "retrieval_eval",
    f"""with {bm25_sql(SEARCH_WORDS, 'len(list_distinct(w))', ITEMS)},
    hits as (select query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id) as rank from scored),
    relevant as ({RELEVANT}),
    firsts as (select query_id, min(rank) as first from (select distinct query_id from relevant) left join (select h.* from hits h join relevant using (query_id, doc_id)) using (query_id) group by query_id)
    select k, round(avg(case when first <= k then 1.0 else 0.0 end), 6) as recall, round(avg(coalesce(1.0 / first, 0.0)), 6) as mrr from firsts, (values (1), (5), (10)) as t(k) group by k""",
)
def retrieval_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 against the documents that hold a benchmark item word for word."""
    docs, items = table(spark, sf_dir, "documents"), _items(spark, sf_dir)
    relevant = stored(search.holding(docs, items))
    return search.evaluate(search.first_ranks(docs, items, relevant), relevant)


@query(
    "search_with_stats",
    f"""with {bm25_sql(SEARCH_WORDS, 'len(list_distinct(w))', ITEMS)},
    hits as (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from scored)
    select source, count(*) as hits, count(distinct query_id) as queries, max(score) as best from hits join documents using (doc_id) where rank <= 50 group by source""",
)
def search_with_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hits = search.bm25(docs, _items(spark, sf_dir), 50)
    return hits.join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("query_id").alias("queries"), F.max("score").alias("best"))


@query(
    "lexical_search",
    """select doc_id, length(text) - length(replace(lower(text), 'ing', '')) as matched, source from documents
    where contains(lower(text), 'ing') and lang = 'en' order by matched desc, source desc, doc_id limit 20""",
)
def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substring search with the count of matched characters, several sort keys, and a filter that reaches the scan."""
    docs = table(spark, sf_dir, "documents").filter(F.col("lang") == "en")
    content = F.lower("text")
    found = docs.filter(content.contains("ing")).select("doc_id", (F.length("text") - F.length(F.replace(content, F.lit("ing"), F.lit("")))).cast("long").alias("matched"), "source")
    return found.orderBy(F.desc("matched"), F.desc("source"), "doc_id").limit(20)


DENSE = """q as (select vec_id as query_id, embedding as asked from embeddings where vec_id % 20 = 0),
dense as (select query_id, vec_id as id, label, round(list_cosine_similarity(embedding::double[], asked::double[]), 6) as similarity from embeddings, q)"""


def _vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20 asks."""
    return table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


@query(
    "cosine_topk",
    f"with {DENSE} select * from (select query_id, id, similarity, row_number() over (partition by query_id order by similarity desc, id) as rank from dense) where rank <= 10",
)
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return search.nearest(vectors, _vector_queries(spark, sf_dir), 10).withColumn("rank", F.col("rank").cast("long"))


@query(
    "threshold_fallback",
    f"""with {DENSE}, numbered as (select query_id, id, similarity, row_number() over (partition by query_id order by similarity desc, id) as rank, max(similarity) over (partition by query_id) as best from dense where id <> query_id)
    select query_id, id, similarity, rank from numbered where similarity >= 0.35 or (best < 0.35 and rank <= 3)""",
)
def threshold_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.above_or_nearest(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir), 0.35, own=False).withColumn("rank", F.col("rank").cast("long"))


@query(
    "quota_select",
    f"""with {DENSE}, kinds as (select *, case when id % 4 = 0 then 'manuscript' else 'secondary' end as source_type from dense where id <> query_id),
    numbered as (select *, row_number() over (partition by query_id, source_type = 'manuscript' order by similarity desc, id) as of_kind from kinds),
    held as (select *, source_type = 'manuscript' and of_kind <= 3 as kept from numbered),
    placed as (select *, count(*) filter (kept) over (partition by query_id) as taken, row_number() over (partition by query_id, kept order by similarity desc, id) as place from held)
    select query_id, id, similarity, source_type, row_number() over (partition by query_id order by similarity desc, id) as rank from placed where kept or place <= 10 - taken""",
)
def quota_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = _vectors(spark, sf_dir).withColumn("kind", F.when(F.col("id") % 4 == 0, "manuscript").otherwise("secondary"))
    best = search.nearest_by_kind(kinds, _vector_queries(spark, sf_dir), 10, own=False)  # more than ten of a kind are never chosen
    return search.with_quota(best.select("query_id", "id", "similarity", F.col("kind").alias("source_type")), 10).withColumn("rank", F.col("rank").cast("long"))


@query(
    "group_similarity",
    """with u as (select label, embedding::double[] as e from embeddings), n as (select label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as n from u),
    p as (select label, unnest(e) / n as x, unnest(generate_series(1, len(e))) as pos from n where n > 0),
    m as (select label, pos, avg(x) as x from p group by all)
    select a.label as a, b.label as b, round(sum(a.x * b.x), 6) as similarity from m a join m b on a.pos = b.pos and a.label < b.label group by all having round(sum(a.x * b.x), 6) >= 0.0""",
)
def group_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.group_similarity(table(spark, sf_dir, "embeddings"), "label", 0.0)


@query(
    "mean_pool",
    """with p as (select label, unnest(embedding::double[]) as x, unnest(generate_series(1, len(embedding))) as pos from embeddings)
    select label, pos, round(avg(x), 6) as mean from p group by all""",
)
def mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = search.mean_vectors(table(spark, sf_dir, "embeddings"), "label")
    return means.select("label", F.posexplode("mean").alias("at", "x")).select("label", (F.col("at") + 1).cast("long").alias("pos"), F.round("x", 6).alias("mean"))


@query(
    "vector_checks",
    """select len(embedding) as dimension, count(*) as vectors, count(*) filter (len(embedding) = 64 and len(list_filter(embedding, lambda x: isnan(x) or isinf(x))) = 0) as usable from embeddings group by 1""",
)
def vector_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors by dimension, and those of the expected one with finite values only."""
    return table(spark, sf_dir, "embeddings").groupBy(F.size("embedding").cast("long").alias("dimension")).agg(F.count(F.lit(1)).alias("vectors"), F.count_if(fv.usable(F.col("embedding"), 64)).alias("usable"))


HYBRID = f"""{bm25_sql(SEARCH_WORDS, 'len(list_distinct(w))', "select d.doc_id as query_id, d.text from documents d join embeddings e on e.vec_id = d.doc_id where e.vec_id % 20 = 0")},
asks as (select vec_id as query_id, embedding as asked from embeddings where vec_id % 20 = 0),
dense as (select query_id, vec_id as id, round(list_cosine_similarity(embedding::double[], asked::double[]), 6) as similarity from embeddings, asks),
dr as (select * from (select *, row_number() over (partition by query_id order by similarity desc, id) as rank from dense) where rank <= 50),
sr as (select * from (select query_id, doc_id as id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from scored) where rank <= 50),
fused as (
    select coalesce(dr.query_id, sr.query_id) as query_id, coalesce(dr.id, sr.id) as id, dr.similarity as dense_similarity,
        greatest(coalesce(dr.similarity, 0.0), case when sr.rank <= 50 then greatest(0.15, 0.7 - 0.02 * (sr.rank - 1)) else 0.0 end) as similarity,
        coalesce(0.6 / (60 + dr.rank), 0.0) + coalesce(0.4 / (60 + sr.rank), 0.0) as score
    from dr full outer join sr on dr.query_id = sr.query_id and dr.id = sr.id
)"""


def _hybrid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Documents, asking texts, fused list, dense list, sparse list."""
    docs, asked = table(spark, sf_dir, "documents"), _vector_queries(spark, sf_dir)
    texts = stored(docs.join(search.small(asked.select("query_id")), F.col("doc_id") == F.col("query_id")).select("query_id", "text"))
    sparse = search.bm25(docs, texts, 50).withColumnRenamed("doc_id", "id")
    dense = search.nearest(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), asked, 50)
    return docs, texts, search.fuse(dense, sparse), dense, sparse


@query(
    "hybrid_rrf",
    f"""with {HYBRID},
    kw as (select query_id, list_distinct(list_concat(list_transform(list_filter(string_split_regex(text, '[^\\p{{L}}\\p{{N}}]+'), lambda x: regexp_full_match(x, '\\p{{Lu}}{{2,6}}')), lambda x: lower(x)), list_filter(string_split_regex(lower(text), '[^\\p{{L}}]+'), lambda x: length(x) >= 5))) as keywords from q),
    boosted as (select f.query_id, f.id, f.similarity, len(list_filter(keywords, lambda k: contains(lower(coalesce(d.text, '')), k))) > 0 as is_exact, f.score from fused f join kw using (query_id) left join documents d on d.doc_id = f.id)
    select query_id, id, round(similarity, 6) as similarity, is_exact, round(case when is_exact then 2 * score else score end, 9) as score, rank from (
        select *, row_number() over (partition by query_id order by round(case when is_exact then 2 * score else score end, 9) desc, id) as rank from boosted) where rank <= 10""",
)
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents asking by their vector and text: fused ranks, doubled where a keyword occurs."""
    docs, texts, fused, _, _ = _hybrid(spark, sf_dir)
    boosted = search.boost_exact(fused, docs, texts).withColumn("score", F.round("score", 9))
    return search.top(boosted, 10, "score", "id").select("query_id", "id", F.round("similarity", 6).alias("similarity"), "is_exact", "score", F.col("rank").cast("long").alias("rank"))


@query(
    "hybrid_rrf_plain",
    f"""with {HYBRID} select * from (select query_id, id, dense_similarity, round(score, 9) as score, row_number() over (partition by query_id order by round(score, 9) desc, id) as rank from fused) where rank <= 10""",
)
def hybrid_rrf_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the boost, and the dense similarity as it is: the form for primary sources, notes and manuscripts."""
    _, _, fused, _, _ = _hybrid(spark, sf_dir)
    rounded = fused.withColumn("score", F.round("score", 9))
    return search.top(rounded, 10, "score", "id").select("query_id", "id", "dense_similarity", "score", F.col("rank").cast("long").alias("rank"))


@query(
    "multi_variant_search",
    """with v as (select vec_id // 100 as query_id, vec_id as variant, embedding as asked from embeddings where vec_id % 20 = 0),
    d as (select query_id, vec_id as id, round(list_cosine_similarity(embedding::double[], asked::double[]), 6) as similarity from embeddings, v)
    select query_id, id, max(similarity) as similarity from d group by all""",
)
def multi_variant_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The asking vectors of one hundred ids are variants of one query; each hit keeps its best similarity."""
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.filter("vec_id % 20 = 0").select(F.expr("vec_id div 100").alias("query_id"), "embedding")
    return search.variants(vectors.select(F.col("vec_id").alias("id"), "embedding"), asked)


@query(
    "recommend",
    f"""with {DENSE} select * from (
        select query_id, label, id, similarity, row_number() over (partition by query_id, label order by similarity desc, id) as rn from dense where id <> query_id and similarity >= 0.1) where rn = 1""",
)
def recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vector of each label for each asking vector."""
    best = search.nearest_by_kind(_vectors(spark, sf_dir).withColumnRenamed("label", "kind"), _vector_queries(spark, sf_dir), 1, least=0.1, own=False)
    return best.select("query_id", F.col("kind").alias("label"), "id", "similarity", F.lit(1).cast("long").alias("rn"))


@query("approximate_neighbours")
def approximate_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours by the graph index; a test holds their recall and their comparisons against cosine_topk."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    index = neighbour_graph.build(vectors, 64)
    return neighbour_graph.search(index, _vector_queries(spark, sf_dir), 10, 64)


@query("stemmed_search")
def stemmed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents with every stem of a benchmark item, from the index in blocks."""
    return fulltext.search(fulltext.index(table(spark, sf_dir, "documents")), _items(spark, sf_dir), 10)


@query("stemmed_any")
def stemmed_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents with any stem of a benchmark item, and the share of postings read for them."""
    return fulltext.search(fulltext.index(table(spark, sf_dir, "documents")), _items(spark, sf_dir), 10, every=False)
