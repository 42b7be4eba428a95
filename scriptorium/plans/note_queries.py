"""Notes, chapters, segments, positions and pages over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import text as ft
from scriptorium.operators import chunk, notes
from scriptorium.plans.registry import query
from scriptorium.plans.text_queries import CHUNKS
from scriptorium.sources.tables import table

#: Documents have no headings of their own, so each text becomes a note of an opening and two sections.
NOTE = "'Opening ' || doc_id || chr(10) || chr(10) || '# First' || chr(10) || coalesce(text, '') || chr(10) || '## Second' || chr(10) || substr(coalesce(text, ''), 1, 300)"

SECTIONS = f"""
nl as (select doc_id, unnest(string_split(t, chr(10))) as raw, unnest(generate_series(0, len(string_split(t, chr(10))) - 1)) as n from (select doc_id, {NOTE} as t from documents)),
np as (select *, regexp_matches(raw, '^(#{{1,6}})\\s+(.+)$') as head, coalesce(sum(length(raw) + 1) over (partition by doc_id order by n rows between unbounded preceding and 1 preceding), 0) as place from nl),
ns as (select *, sum(head::int) over (partition by doc_id order by n) as section from np),
sections as (select doc_id, section, max(case when head then trim(regexp_extract(raw, '^(#{{1,6}})\\s+(.+)$', 2)) end) as title, min(place)::bigint as position, min(n) + 1 as line, string_agg(raw, chr(10) order by n) as content from ns group by doc_id, section)
"""


def _sql_cut(text: str, position: str, least: str, most: int = 2000, back: int = 200) -> str:
    """The cut of a piece that begins at a position."""
    end = f"least({position} + {most}, length({text}))"
    window = f"substr({text}, greatest({least}, {end} - {back}) + 1, {end} - greatest({least}, {end} - {back}))"
    last = lambda mark: f"case when strpos(reverse({window}), reverse({mark})) = 0 then -1 else length({window}) - strpos(reverse({window}), reverse({mark})) - 1 end"
    best = f"greatest({last('chr(10) || chr(10)')}, {last(chr(39) + '. ' + chr(39))}, {last(chr(39) + '! ' + chr(39))}, {last(chr(39) + '? ' + chr(39))})"
    return f"case when {end} < length({text}) and {best} > 0 then {end} - length({window}) + {best} + 2 else {end} end"


STRIPPED = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _note(docs: DataFrame) -> DataFrame:
    text: Column = F.concat(F.lit("Opening "), F.col("doc_id").cast("string"), F.lit("\n\n# First\n"), ft.present("text"), F.lit("\n## Second\n"), F.substring(ft.present("text"), 1, 300))
    return docs.select("doc_id", text.alias("text"))


@query("note_sections", f"with {SECTIONS} select doc_id, section::bigint as section, title, position, line, md5(content) as content_md5 from sections")
def note_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = notes.sections(_note(table(spark, sf_dir, "documents")), "doc_id")
    return found.select("doc_id", "section", "title", "position", "line", F.md5("content").alias("content_md5"))


@query(
    "note_chunks",
    f"""with recursive {SECTIONS}, b as (select doc_id, section, title, position, {STRIPPED.format('content')} as t from sections),
    c as (
        select doc_id, section, 0 as part, title, position, t, 0::bigint as first, case when length(t) <= 2000 then length(t) else {_sql_cut('t', '0', '0')} end as last from b where t <> ''
        union all select doc_id, section, part + 1, title, position, t, last - 200, {_sql_cut('t', '(last - 200)', '0')} from c where last < length(t) and last - 200 > 0
    )
    select doc_id, row_number() over (partition by doc_id order by section, part) - 1 as chunk_index, title, position + first as first, position + last as last, md5({STRIPPED.format('substr(t, first + 1, last - first)')}) as content_md5 from c""",
)
def note_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = notes.note_chunks(_note(table(spark, sf_dir, "documents")), "doc_id")
    return found.select("doc_id", "chunk_index", "title", "first", "last", F.md5("content").alias("content_md5"))


@query("chapter_chunks")
def chapter_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prose of chapters in pieces; a test holds them against a plain loop."""
    return notes.chapter_chunks(_note(table(spark, sf_dir, "documents")), "doc_id").withColumn("content", F.md5("content"))


@query(
    "text_parts",
    f"""with recursive d as (select doc_id, coalesce(text, '') as t from documents),
    c as (
        select doc_id, t, 0 as part, 0::bigint as first, case when length(t) <= 3000 then length(t) else {{0}} end as last from d
        union all select doc_id, t, part + 1, last, {{1}} from c where last < length(t)
    )
    select doc_id, part, md5(case when length(t) <= 3000 then t else {STRIPPED.format('substr(t, first + 1, last - first)')} end) as content_md5 from c""".format(
        *[
            rf"case when least({p} + 3000, length(t)) < length(t) and length(regexp_extract(substr(t, greatest({p}, least({p} + 3000, length(t)) - 200) + 1, least({p} + 3000, length(t)) - greatest({p}, least({p} + 3000, length(t)) - 200)), '(?s)^(.*[.!?])\s', 1)) > 0 "
            rf"then greatest({p}, least({p} + 3000, length(t)) - 200) + length(regexp_extract(substr(t, greatest({p}, least({p} + 3000, length(t)) - 200) + 1, least({p} + 3000, length(t)) - greatest({p}, least({p} + 3000, length(t)) - 200)), '(?s)^(.*[.!?])\s', 1)) else least({p} + 3000, length(t)) end"
            for p in ("0", "last")
        ]
    ),
)
def text_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.parts(table(spark, sf_dir, "documents")).select("doc_id", "part", F.md5("content").alias("content_md5"))


@query(
    "paragraph_segments",
    rf"""with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as raw, unnest(generate_series(0, len(string_split(coalesce(text, ''), chr(10))) - 1)) as n from documents),
    b as (select *, {STRIPPED.format('raw')} = '' as blank from l), r as (select *, sum(blank::int) over (partition by doc_id order by n) as run from b)
    select doc_id, min(n) as first_line, max(n) as last_line, md5({STRIPPED.format("string_agg(raw, chr(10) order by n)")}) as content_md5 from r where not blank group by doc_id, run""",
)
def paragraph_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = notes.paragraphs(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "first_line", "last_line", F.md5("content").alias("content_md5"))


@query(
    "section_segments",
    rf"""with {SECTIONS}, s as (select *, coalesce(title, 'Introduction') as name, line - 1 as first_line, line - 2 + len(string_split(content, chr(10))) as last_line,
        {STRIPPED.format("case when title is null then content else substr(content, strpos(content, chr(10)) + 1) end")} as body from sections)
    select doc_id, name as title, first_line, last_line, md5(body) as content_md5 from s where body <> ''""",
)
def section_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = notes.section_segments(_note(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "title", "first_line", "last_line", F.md5("content").alias("content_md5"))


@query(
    "chunk_pages",
    f"""with recursive {CHUNKS}, k as (select doc_id, chunk_index, content from chunks), d as (select doc_id, coalesce(text, '') as t from documents),
    p as (
        select doc_id, k.chunk_index, content, t, strpos(t, string_split(content, ' ')[1]) - 1 as found, 0::bigint as since from k join d using (doc_id) where chunk_index = 0
        union all select k.doc_id, k.chunk_index, k.content, p.t, case when strpos(substr(p.t, e + 1), string_split(k.content, ' ')[1]) = 0 then -1 else strpos(substr(p.t, e + 1), string_split(k.content, ' ')[1]) + e - 1 end, e
        from (select *, case when found < 0 then since else found end + length(content) as e from p) p join k on k.doc_id = p.doc_id and k.chunk_index = p.chunk_index + 1
    ), q as (select doc_id, chunk_index, case when found < 0 then since else found end as first, length(content) as n, t from p)
    select doc_id, chunk_index, first, first + n as last, least(first // 1002 + 1, greatest(1, (length(t) + 999) // 1000)) as page_number from q""",
)
def chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with their places, and pages of a thousand characters."""
    docs = table(spark, sf_dir, "documents")
    numbers = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.length(ft.present("text")) / 1000).cast("int")))
    pages = docs.select("doc_id", F.explode(numbers).alias("page_number"), ft.present("text").alias("t")).select("doc_id", "page_number", F.expr("substring(t, (page_number - 1) * 1000 + 1, 1000)").alias("text"))
    placed = notes.with_positions(chunk.fixed_chunks(docs), docs)
    return notes.with_pages(placed, pages).select("doc_id", "chunk_index", "first", "last", F.col("page_number").cast("long").alias("page_number"))


@query(
    "deck_slides",
    """with s as (select doc_id, unnest(['Slide ' || doc_id, coalesce(source, ''), coalesce(lang, '')]) as content, unnest([0, 1, 2]) as slide from documents)
    select doc_id, slide, case when slide = 0 then 'Slide ' || doc_id end as title, md5(case when slide = 0 then '# Slide ' || doc_id when slide = 1 then trim('```' || chr(10) || '---' || chr(10) || '```' || chr(10) || content) else content end) as content_md5 from s""",
)
def deck_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decks of three slides, with dashes in the front matter and in code."""
    show = lambda c: F.coalesce(F.col(c), F.lit(""))
    text = F.concat(F.lit("---\ntitle: x\n---\n# Slide "), F.col("doc_id").cast("string"), F.lit("\n---\n```\n---\n```\n"), show("source"), F.lit("\n---\n"), show("lang"))
    found = notes.slides(table(spark, sf_dir, "documents").select("doc_id", text.alias("text")), "doc_id")
    return found.select("doc_id", "slide", "title", F.md5("content").alias("content_md5"))


@query("sentence_segments")
def sentence_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of all documents with their lines, in the order of first lines."""
    found = notes.sentence_segments(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "place", "first_line", "last_line", F.md5("content").alias("content_md5")).orderBy("doc_id", "first_line", "place")


@query("split_sentences")
def split_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many sentences each document has for compression and for summaries, and a digest of them."""
    split = table(spark, sf_dir, "documents").select("doc_id", ft.historian_sentences(ft.present("text")).alias("h"), ft.summary_sentences(ft.present("text")).alias("s"))
    digest = lambda c: F.md5(F.array_join(c, "\n\n"))
    return split.select("doc_id", F.size("h").alias("n_historian"), digest("h").alias("historian_md5"), F.size("s").alias("n_summary"), digest("s").alias("summary_md5"))
