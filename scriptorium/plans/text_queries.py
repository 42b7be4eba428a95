"""Text statistics, quality, cleaning, chunking and duplicate queries over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import text as ft
from scriptorium.operators import chunk, dedup, textometrics
from scriptorium.plans.registry import query
from scriptorium.sources.tables import table


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


FORM = rf"trim(regexp_replace(regexp_replace(translate(lower({{0}}), '‘’', ''''''), '[^{ft.WORD_CHARACTERS}\s''\-]', ' ', 'g'), '\s+', ' ', 'g'))"
NO_LINKS = r"regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(?i)(?:https?|ftp)://[^\s]+', ' ', 'g'), '(?i)\b(?:doi[:\s]*)?10\.\d{4,}(?:\.\d+)*/[^\s]+', ' ', 'g'), '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}', ' ', 'g')"
WORDS = rf"list_filter(string_split({FORM.format(NO_LINKS)}, ' '), lambda x: length(x) >= 2 and x not in ({_quoted(dict.fromkeys([*ft.STOPWORDS, *ft.URL_PARTS]))}) and not regexp_matches(x, '^(\d{{4,}}|[a-z]\d+|\d+[a-z]+)$'))"
ALL_WORDS = rf"list_filter(string_split({FORM.format('coalesce(text, chr(32))')}, ' '), lambda x: x <> '')"


@query(
    "text_statistics",
    f"""with t as (select doc_id, {WORDS} as w, {ALL_WORDS} as every from documents)
    select doc_id, len(w) as total_words, len(list_distinct(w)) as unique_words, len(every) as total_with_stopwords,
        round(case when len(w) = 0 then 0.0 else len(list_distinct(w)) / len(w) end, 6) as richness from t""",
)
def text_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textometrics.text_statistics(table(spark, sf_dir, "documents"))


@query(
    "corpus_statistics",
    f"""with t as (select {WORDS} as w, {ALL_WORDS} as every from documents)
    select count(*) as documents, sum(len(w))::bigint as total_words, sum(len(every))::bigint as total_with_stopwords, round(avg(len(w)), 6) as mean_words,
        round(avg(len(list_distinct(w))), 6) as mean_vocabulary, (select count(distinct x) from (select unnest(w) as x from t)) as vocabulary from t""",
)
def corpus_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textometrics.corpus_statistics(table(spark, sf_dir, "documents"))


@query(
    "top_words",
    f"""with t as (select unnest({WORDS}) as word from documents), n as (select count(*) as n from t)
    select word, count(*) as count, round(count(*) / any_value(n), 9) as frequency from t, n group by word order by count desc, word limit 50""",
)
def top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = textometrics.word_counts(table(spark, sf_dir, "documents"))
    total = counts.agg(F.sum("count").alias("n"))
    best = counts.orderBy(F.desc("count"), "word").limit(50)
    return best.crossJoin(F.broadcast(total)).select("word", "count", F.round(F.col("count") / F.col("n"), 9).alias("frequency"))


@query("word_frequency_distribution", f"select c as occurrences, count(*) as words from (select word, count(*) as c from (select unnest({WORDS}) as word from documents) group by word) group by c")
def word_frequency_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = textometrics.word_counts(table(spark, sf_dir, "documents"))
    return counts.groupBy(F.col("count").alias("occurrences")).agg(F.count(F.lit(1)).alias("words"))


def _ngram_sql(n: int) -> str:
    return f"""with t as (select {WORDS} as w from documents)
    select ngram, count(*) as count from (select array_to_string(w[i : i + {n - 1}], ' ') as ngram from (select w, unnest(generate_series(1, len(w) - {n - 1})) as i from t where len(w) >= {n})) group by ngram order by count desc, ngram limit 50"""


@query("top_bigrams", _ngram_sql(2))
def top_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textometrics.top_ngrams(table(spark, sf_dir, "documents"), 2, 50)


@query("top_trigrams", _ngram_sql(3))
def top_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textometrics.top_ngrams(table(spark, sf_dir, "documents"), 3, 50)


def _corpus_ngram_sql(n: int) -> str:
    later = "".join(f", lead(word, {i}) over (order by doc_id, i) as w{i}" for i in range(1, n))
    joined = "".join(f" || ' ' || w{i}" for i in range(1, n))
    return f"""with t as (select doc_id, {WORDS} as w from documents), u as (select doc_id, unnest(w) as word, unnest(generate_series(1, len(w))) as i from t where len(w) > 0),
    s as (select word{later} from u)
    select word{joined} as ngram, count(*) as count from s where w{n - 1} is not null group by ngram order by count desc, ngram limit 50"""


@query("corpus_bigrams", _corpus_ngram_sql(2))
def corpus_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus read as one text: pairs go on over the ends of documents."""
    return textometrics.corpus_ngrams(table(spark, sf_dir, "documents"), 2, 50)


@query("corpus_trigrams", _corpus_ngram_sql(3))
def corpus_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textometrics.corpus_ngrams(table(spark, sf_dir, "documents"), 3, 50)


@query(
    "tfidf_characteristic_words",
    f"""with t as (select doc_id, {WORDS} as w from documents), c as (select doc_id, word, count(*) as c, any_value(n) as total from (select doc_id, len(w) as n, unnest(w) as word from t) group by doc_id, word),
    d as (select word, count(*) as df from c group by word),
    s as (select doc_id, word, round(c / total * ln((select count(*) from documents) / df), 9) as tfidf from c join d using (word))
    select * from (select *, row_number() over (partition by doc_id order by tfidf desc, word) as rank from s) where rank <= 10""",
)
def tfidf_characteristic_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textometrics.tfidf(table(spark, sf_dir, "documents"))


QUALITY = r"""
b as (select doc_id, list_transform(list_filter(list_transform(string_split_regex(coalesce(text, ''), '\s+'), lambda x: regexp_replace(x, '[^\p{L}\p{N}]', '', 'g')), lambda x: x <> ''), lambda x: lower(x)) as w,
    len(regexp_extract_all(coalesce(text, ''), '[.!?;]+(\s|$)')) as sentences from documents),
m as (select doc_id, sum(c * log2(c)) as mass, sum(c * length(word)) as letters, count(*) as uniq from (select doc_id, word, count(*) as c from (select doc_id, unnest(w) as word from b) group by all) group by doc_id),
s as (select doc_id, len(w) as words, sentences,
    round(case when len(w) < 2 or uniq < 2 then 0.0 else least(1.0, (log2(len(w)) - mass / len(w)) / log2(uniq)) end, 6) as entropy,
    round(case when len(w) = 0 then 0.0 else uniq / len(w) end, 6) as unique_ratio, round(case when len(w) = 0 then 0.0 else letters / len(w) end, 6) as mean_length
    from b left join m using (doc_id)),
quality as (select *, round(0.35 * entropy + 0.25 * unique_ratio + 0.2 * greatest(0.0, 1 - abs(mean_length - 6) / 10) + 0.2 * least(1.0, sentences / 5), 6) as score,
    case when words < 20 then 'too_few_words' when sentences < 1 then 'too_few_sentences' when entropy < 0.3 then 'low_entropy' when unique_ratio < 0.4 then 'low_unique_ratio'
        when mean_length < 2 then 'short_words' when mean_length > 20 then 'long_words' end as rejected from s)
"""


@query("chunk_quality", f"with {QUALITY} select * from quality")
def chunk_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textometrics.quality(table(spark, sf_dir, "documents"))


@query("quality_rejection_counts", f"with {QUALITY} select coalesce(rejected, 'passed') as outcome, count(*) as documents, round(count(*) / sum(count(*)) over (), 6) as share from quality group by 1")
def quality_rejection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = textometrics.quality(table(spark, sf_dir, "documents")).groupBy(F.coalesce("rejected", F.lit("passed")).alias("outcome")).agg(F.count(F.lit(1)).alias("documents"))
    total = counts.agg(F.sum("documents").alias("n"))
    return counts.crossJoin(F.broadcast(total)).select("outcome", "documents", F.round(F.col("documents") / F.col("n"), 6).alias("share"))


@query("quality_vs_labels", f"with {QUALITY} select l.quality as label, rejected is null as passed, count(*) as documents, round(avg(score), 6) as mean_score from quality join labels l using (doc_id) group by all")
def quality_vs_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = textometrics.quality(table(spark, sf_dir, "documents")).join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    return joined.groupBy("label", F.isnull("rejected").alias("passed")).agg(F.count(F.lit(1)).alias("documents"), F.round(F.avg("score"), 6).alias("mean_score"))


@query(
    "lang_detect_confusion",
    f"""with t as (select lang, string_split_regex(lower(substr(text, 1, 5000)), '[^\\p{{L}}\\p{{N}}_]+') as w from documents),
    s as (select lang, len(list_filter(w, lambda x: x in ({_quoted(ft.FRENCH_MARKERS)}))) as f, len(list_filter(w, lambda x: x in ({_quoted(ft.ENGLISH_MARKERS)}))) as e from t)
    select lang, case when f > e * 1.2 then 'fr' when e > f * 1.2 then 'en' else 'unknown' end as detected, count(*) as documents from s group by all""",
)
def lang_detect_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang", ft.detected_language(F.col("text")).alias("detected")).agg(F.count(F.lit(1)).alias("documents"))


@query(
    "clean_chunk_text",
    r"select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\n{3,}', chr(10) || chr(10), 'g'), ' {2,}', ' ', 'g'), '[\x00-\x1F\x7F]', '', 'g'), '^\s+|\s+$', '', 'g')) as cleaned from documents",
)
def clean_chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(ft.clean_chunk(ft.present("text"))).alias("cleaned"))


@query("clean_ocr_text")
def clean_ocr_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanner clean-up and page numbers; look-around patterns, so tests hold examples instead of SQL."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(ft.drop_page_numbers(ft.clean_ocr(ft.present("text")))).alias("cleaned"))


@query(
    "keyword_counts",
    r"""with k as (select unnest(list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}]+'), lambda x: length(x) >= 5))) as keyword from documents)
    select keyword, count(*) as documents from k group by keyword order by documents desc, keyword limit 100""",
)
def keyword_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array_distinct(F.filter(F.split(F.lower(ft.present("text")), r"[^\p{L}]+"), lambda w: F.length(w) >= 5))
    exploded = table(spark, sf_dir, "documents").select(F.explode_outer(words).alias("keyword")).filter("keyword is not null")
    return exploded.groupBy("keyword").agg(F.count(F.lit(1)).alias("documents")).orderBy(F.desc("documents"), "keyword").limit(100)


@query(
    "folded_search",
    f"""select doc_id, (length(f) - length(replace(f, 'ement', ''))) // 5 as matches, substr(text, greatest(1, strpos(f, 'ement') - 32), 85) as excerpt
    from (select doc_id, text, translate(lower(text), '{ft.ACCENTED}', '{ft.PLAIN}') as f from documents) where contains(f, 'ement')""",
)
def folded_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accent-free search for a string, with the count of matches and the first one's surroundings."""
    folded = table(spark, sf_dir, "documents").select("doc_id", "text", ft.fold_accents(F.col("text")).alias("f")).filter(F.col("f").contains("ement"))
    count = ((F.length("f") - F.length(F.replace("f", F.lit("ement"), F.lit("")))) / 5).cast("long")
    return folded.select("doc_id", count.alias("matches"), F.substring("text", F.greatest(F.lit(1), F.locate("ement", "f") - 32), F.lit(85)).alias("excerpt"))


@query(
    "snippets",
    r"""with f as (select doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) as t from documents)
    select doc_id, case when length(t) <= 150 then t else regexp_replace(substr(t, 1, 150), '\s+\S*$', '') || '…' end as snippet from f""",
)
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", ft.snippet(ft.present("text")).alias("snippet"))


CHUNKS = r"""
w as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') as w from documents),
st as (select doc_id, w, len(w) as n, unnest(generate_series(0, len(w) - 1, 250)) as first from w where len(w) > 0),
en as (select *, least(first + 300, n) as stop0 from st),
tl as (select *, list_filter(generate_series(greatest(stop0 - 50, first + 1), stop0), lambda i: regexp_matches(coalesce(w[i + 1], ''), '[.!?]$')) as tail from en),
sp as (select *, case when stop0 < n and len(tail) > 0 then list_max(tail) + 1 else stop0 end as stop from tl),
chunks as (select doc_id, row_number() over (partition by doc_id order by first) - 1 as chunk_index, first as first_word, stop - first as n_words, array_to_string(w[first + 1 : stop], ' ') as content
    from sp where stop - first >= 50 or stop >= n)
"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk.fixed_chunks(table(spark, sf_dir, "documents"))


@query("fixed_chunks", f"with {CHUNKS} select doc_id, chunk_index, first_word, n_words, md5(content) as content_md5 from chunks")
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).withColumn("content_md5", F.md5("content")).drop("content")


@query("chunk_stats", f"with {CHUNKS} select count(*) as chunks, cast(floor(avg(n_words)) as bigint) as mean_words, min(n_words) as least_words, max(n_words) as most_words, cast(sum(n_words) as bigint) as total_words from chunks")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("chunks"),
        F.floor(F.avg("n_words")).alias("mean_words"),
        F.min("n_words").alias("least_words"),
        F.max("n_words").alias("most_words"),
        F.sum("n_words").alias("total_words"),
    )


CONTENT_FORM = r"regexp_replace(regexp_replace(regexp_replace(lower({0}), '\s+', ' ', 'g'), '[^\p{{L}}\p{{N}}\s]', '', 'g'), '^\s+|\s+$', '', 'g')"


@query(
    "exact_duplicates",
    f"""with h as (select doc_id, md5({CONTENT_FORM.format("coalesce(text, '')")}) as hash from documents)
    select doc_id, hash, min(doc_id) over (partition by hash) as first, count(*) over (partition by hash) as copies from h""",
)
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_groups(table(spark, sf_dir, "documents"))


@query(
    "jaccard_neighbours",
    f"""with {CHUNKS}, s as (select doc_id, chunk_index, list_distinct(list_filter(string_split_regex({CONTENT_FORM.format("content")}, '\\s+'), lambda x: length(x) > 2)) as w from chunks)
    select a.doc_id as doc_id, a.chunk_index as a, b.chunk_index as b, round(coalesce(len(list_intersect(a.w, b.w)) / nullif(len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)), 0), 0.0), 6) as similarity
    from s a join s b on a.doc_id = b.doc_id and b.chunk_index between a.chunk_index + 1 and a.chunk_index + 4""",
)
def jaccard_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.neighbour_pairs(_chunks(spark, sf_dir))


@query("hash_across_documents", f"with {CHUNKS}, h as (select doc_id, md5({CONTENT_FORM.format('content')}) as hash from chunks) select hash, count(distinct doc_id) as documents, count(*) as chunks from h group by hash having count(distinct doc_id) > 1")
def hash_across_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.across_documents(_chunks(spark, sf_dir))


@query("near_copies_in_documents")
def near_copies_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greedy fold over each document's chunks, which stay one row; tests hold it against a plain loop."""
    kept = dedup.lists_without_near_copies(chunk.chunk_lists(table(spark, sf_dir, "documents")))
    return kept.select("doc_id", F.explode_outer("chunks").alias("c")).filter("c is not null").select("doc_id", "c.chunk_index", "c.n_words")


@query("section_chunks")
def section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of sections packed; a test holds them against a plain loop."""
    return chunk.section_chunks(table(spark, sf_dir, "documents")).withColumn("content", F.md5("content"))


@query("embedding_borders")
def embedding_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Borders in each label's sequence of vectors; tests hold them against a plain loop."""
    return chunk.similarity_borders(table(spark, sf_dir, "embeddings"), "label", "vec_id")


@query("bordered_chunks")
def bordered_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sentences of their label's sequence, between the borders of its vectors; a test holds them against a plain loop."""
    borders = embedding_borders(spark, sf_dir)
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    sentences = table(spark, sf_dir, "documents").join(vectors, F.col("doc_id") == F.col("vec_id")).select("label", "vec_id", ft.snippet(ft.present("text")).alias("text"))
    return chunk.bordered_chunks(sentences, borders, "label", "vec_id").withColumn("content", F.md5("content"))


@query("summaries")
def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best sentences of each document; a test holds them against a plain loop."""
    return chunk.summaries(table(spark, sf_dir, "documents")).withColumn("sentence", F.md5("sentence"))


@query(
    "running_heads",
    r"""with l as (select doc_id % 50 as book, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as content, unnest(generate_series(0, len(string_split(coalesce(text, ''), chr(10))) - 1)) as pos, len(string_split(coalesce(text, ''), chr(10))) as n from documents),
    f as (select *, trim(regexp_replace(regexp_replace(lower(content), '\d+', '#', 'g'), '\s+', ' ', 'g')) as form from l),
    e as (select *, row_number() over (partition by book, doc_id order by pos) as up, row_number() over (partition by book, doc_id order by pos desc) as down from f where trim(content) <> ''),
    c as (select book, form, count(distinct doc_id) as on_pages from e where (up <= 2 or down <= 2) and length(form) > 3 group by all),
    r as (select book, form from c join (select doc_id % 50 as book, count(*) as pages from documents group by 1 having count(*) >= 3) using (book) where on_pages >= ceil(pages * 0.1)),
    k as (select f.book, f.doc_id, pos, content from f left join r on r.book = f.book and r.form = f.form and (pos < 2 or pos >= n - 2) where r.form is null),
    t as (select book, doc_id, string_agg(content, chr(10) order by pos) as text from k group by all)
    select d.doc_id % 50 as book, d.doc_id as page_number, md5(coalesce(t.text, '')) as text_md5 from documents d left join t on t.doc_id = d.doc_id""",
)
def running_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of fifty books: lines that recur at page edges go."""
    pages = table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("book"), F.col("doc_id").alias("page_number"), "text")
    return chunk.without_running_heads(pages, "book", "page_number", 0.1).select("book", "page_number", F.md5("text").alias("text_md5"))
