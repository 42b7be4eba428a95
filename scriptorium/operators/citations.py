"""Citations: extraction from texts, matching with documents, statistics; keys and notes of manuscripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as ft

# The shapes of citations in a text, each with an author and a year.
NAME = "[A-ZÀÂÄÆÇÉÈÊËÏÎÔŒÙÛÜ][a-zàâäæçéèêëïîôœùûü]+"
JOINED = rf"{NAME}(?:\s+(?:et\s+al\.|et\s+collaborateurs|&|and)\s+{NAME})*"
YEAR = r"\d{4}[a-z]?"
BEFORE = r"(?:^|[^\p{L}\p{N}_])"
SHAPES = [
    rf"(?i)\(({JOINED}),?\s+({YEAR})\)",
    rf"{BEFORE}({JOINED})\s*[,(]\s*({YEAR})\s*\)?",
    rf"{BEFORE}({NAME}\s+(?:et|and|&)\s+{NAME})\s*\(\s*({YEAR})\s*\)",
    rf"(?i){BEFORE}({NAME})\s+(?:et\s+al\.|et\s+collaborateurs)\s*\(\s*({YEAR})\s*\)",
]


def found_in(text: Column) -> Column:
    """Array of (author, year) by every shape; one place may fit several shapes."""

    def by(shape: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(shape), 0), lambda x: F.struct(F.regexp_extract(x, shape, 1).alias("author"), F.regexp_extract(x, shape, 2).alias("year")))

    return F.concat(*[by(s.replace("(?i)", "(?iu)")) for s in SHAPES])


def extract(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, author, year, paragraph, context): each author and year of a document once, with up to 300 characters of the first paragraph that has it."""
    paragraphs = docs.select(key, F.posexplode(F.split(ft.present(text), r"\n\s*\n")).alias("paragraph", "p"))
    rows = paragraphs.select(key, "paragraph", F.substring(ft.strip(F.col("p")), 1, 300).alias("context"), F.explode(found_in(F.col("p"))).alias("c"))
    first = rows.groupBy(key, "c.author", "c.year").agg(F.min(F.struct("paragraph", "context")).alias("at"))
    return first.select(key, "author", "year", F.col("at.paragraph").cast("long").alias("paragraph"), "at.context")


def match_documents(citations: DataFrame, documents: DataFrame, citation: str = "citation_id", document: str = "doc_id") -> DataFrame:
    """(citation, document): a document of the same year whose author contains, is contained in or shares the first word with the cited one; the least key wins."""
    cited = citations.select(citation, ft.author_form(F.col("author")).alias("a"), ft.first_author(F.col("author")).alias("af"), F.regexp_replace("year", "[a-z]", "").alias("year"))
    known = documents.filter("author is not null and year is not null").select(document, ft.author_form(F.col("author")).alias("b"), ft.first_author(F.col("author")).alias("bf"), F.col("year").cast("string").alias("year"))
    fits = F.col("b").contains(F.col("a")) | F.col("a").contains(F.col("b")) | (F.col("af") == F.col("bf"))
    return cited.join(known, "year").filter(fits).groupBy(citation).agg(F.min(document).alias(document))


def statistics(citations: DataFrame) -> DataFrame:
    """One row: citations, authors, first and last year from 1500 to 2100, and how many have a context."""
    year = F.try_to_number(F.substring("year", 1, 4), F.lit("9999")).cast("int")
    valid = F.when(year.between(1500, 2100), year)
    return citations.agg(F.count(F.lit(1)).alias("citations"), F.count_distinct("author").alias("authors"), F.min(valid).alias("first_year"), F.max(valid).alias("last_year"), F.count_if(F.col("context") != "").alias("with_context"))


KEY = r"(?:^|[^\p{L}\p{N}@])@([\p{L}\p{N}_](?:[\p{L}\p{N}_:.#$%&+?<>~/-]*[\p{L}\p{N}_])?)"
NOTE = r"\[\^([^\]\s]+)\](?!:)"


def citation_keys(text: Column) -> Column:
    """The keys of @key citations in order, repeats included."""
    return F.regexp_extract_all(text, F.lit(KEY), 1)


def missing_keys(chapters: DataFrame, bibliography: DataFrame, chapter: str = "chapter", text: str = "text", key: str = "key") -> DataFrame:
    """(key, chapters, uses) of keys that are cited and not in the bibliography."""
    used = chapters.select(chapter, F.explode_outer(citation_keys(ft.present(text))).alias(key)).filter(F.col(key).isNotNull())
    absent = used.groupBy(chapter, key).agg(F.count(F.lit(1)).alias("n")).join(bibliography.select(key).distinct(), key, "left_anti")
    return absent.groupBy(key).agg(F.array_sort(F.collect_set(chapter)).alias("chapters"), F.sum("n").alias("uses"))


def note_numbers(chapters: DataFrame, work: str, chapter: str, text: str = "text") -> DataFrame:
    """(work, chapter, label, number) of footnotes, numbered through a work in the order of their first call."""
    calls = chapters.select(work, chapter, F.posexplode(F.array_distinct(F.regexp_extract_all(ft.present(text), F.lit(NOTE), 1))).alias("at", "label"))
    number = F.row_number().over(Window.partitionBy(work).orderBy(chapter, "at"))
    return calls.select(work, chapter, "label", number.cast("long").alias("number"))


def assembled(chapters: DataFrame, work: str, order: str, text: str = "text", mark: str = "\n\n") -> DataFrame:
    """(work, chapters, text) of works whose chapters are joined in order. A work is one row, so it must fit one."""
    rows = chapters.groupBy(work).agg(F.array_sort(F.collect_list(F.struct(F.col(order), ft.present(text).alias("t")))).alias("c"))
    return rows.select(work, F.size("c").cast("long").alias("chapters"), F.array_join(F.transform("c", lambda x: x["t"]), mark).alias("text"))


def prose(text: Column) -> Column:
    """Markdown without front matter, code, notes, links' targets and marks."""
    text = F.regexp_replace(text, r"(?s)^---\n.*?\n---\n", "")
    text = F.regexp_replace(text, r"(?s)```.*?```", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"`[^`\n]*`", " "), r"(?m)^\[\^[^\]]+\]:.*$", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"!\[[^\]]*\]\([^)]*\)", " "), r"\[([^\]^][^\]]*)\]\([^)]*\)", "$1")
    return F.regexp_replace(F.regexp_replace(text, r"\[\^[^\]]+\]", ""), r"(?m)^#{1,6}[ \t]+|[*_~]{1,3}", "")


def document_counts(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, words, characters, paragraphs, citations, notes) of the prose."""
    t, p = ft.present(text), prose(ft.present(text))
    words = ft.without_empty(F.split(p, r"\s+"))
    return docs.select(
        key,
        F.size(words).cast("long").alias("words"),
        F.length(ft.strip(p)).cast("long").alias("characters"),
        F.size(F.filter(F.split(p, r"\n\s*\n"), lambda x: ft.strip(x) != "")).cast("long").alias("paragraphs"),
        F.size(citation_keys(t)).cast("long").alias("citations"),
        F.size(F.array_distinct(F.regexp_extract_all(t, F.lit(NOTE), 1))).cast("long").alias("notes"),
    )
