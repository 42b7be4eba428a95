"""Documents to chunks: fixed windows, sections, embedding borders, notes; and summaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as ft


def chunk_lists(docs: DataFrame, key: str = "doc_id", most: int = 300, overlap: int = 50, least: int = 50) -> DataFrame:
    """(key, chunks), an array of (chunk_index, first_word, n_words, content): windows of ``most`` words starting every most - overlap.

    A window ends after the last word of its final 50 that ends a sentence, if there is one; a window under
    ``least`` words is kept only if it ends the text.
    """
    words = ft.without_empty(F.split(ft.present("text"), r"\s+"))
    base = docs.select(key, words.alias("w"))
    # every step works on arrays within the row, so nothing is shuffled and a chunk holds its own words only
    firsts = base.withColumn("x", F.expr(f"transform(filter(sequence(0, greatest(size(w) - 1, 0), {most - overlap}), f -> f < size(w)), f -> named_struct('first', f, 'end', least(f + {most}, size(w))))"))
    # the place (0-based) of the last word that ends a sentence in the final 50, the word at the end itself included
    tail = "array_max(filter(sequence(greatest(c.end - 50, c.first + 1), c.end), i -> coalesce(get(w, i), '') rlike '[.!?]$'))"
    cut = firsts.withColumn("x", F.expr(f"transform(x, c -> named_struct('first', c.first, 'stop', if(c.end < size(w), coalesce({tail} + 1, c.end), c.end)))"))
    kept = cut.withColumn("x", F.expr(f"filter(x, c -> c.stop - c.first >= {least} or c.stop >= size(w))"))
    numbered = "named_struct('chunk_index', cast(i as bigint), 'first_word', cast(c.first as bigint), 'n_words', cast(c.stop - c.first as bigint), 'content', array_join(slice(w, c.first + 1, c.stop - c.first), ' '))"
    return kept.select(key, F.expr(f"transform(x, (c, i) -> {numbered})").alias("chunks"))


def fixed_chunks(docs: DataFrame, key: str = "doc_id", most: int = 300, overlap: int = 50, least: int = 50) -> DataFrame:
    """(key, chunk_index, first_word, n_words, content): the chunks of the lists as rows."""
    return chunk_lists(docs, key, most, overlap, least).select(key, F.explode_outer("chunks").alias("c")).filter("c is not null").select(key, "c.*")


def with_context(chunks: DataFrame, title: str, section: str | None = None) -> DataFrame:
    """Put '[Doc: title | Section: section]' before the content."""
    parts = [F.concat(F.lit("Doc: "), F.col(title))] + ([F.concat(F.lit("Section: "), F.col(section))] if section else [])
    return chunks.withColumn("content", F.concat(F.lit("["), F.concat_ws(" | ", *parts), F.lit("]\n\n"), F.col("content")))


def lines_of(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, line, content), lines from 1."""
    return docs.select(key, F.posexplode(F.split(ft.present("text"), "\n")).alias("line", "content")).withColumn("line", F.col("line") + 1)


#: Header names, and words that give a section its type, in the order they are tried.
COMMON_HEADERS = "ABSTRACT INTRODUCTION METHODOLOGY METHODS RESULTS DISCUSSION CONCLUSION REFERENCES BIBLIOGRAPHY ACKNOWLEDGMENTS".split()
SECTION_WORDS = {
    "abstract": "abstract résumé summary",
    "introduction": "introduction background context",
    "methodology": "method méthodologie approach design",
    "results": "result résultat finding analysis analyse",
    "discussion": "discussion interpretation implication",
    "conclusion": "conclusion summary closing",
    "references": "reference bibliograph citation",
}


def sections(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, section, title, level, kind, content): text between header lines; what stands before the first is section 0."""
    line = F.trim(F.col("content"))
    markdown, numbered, roman = r"^(#{1,6})\s+(.+)$", r"^(\d+(?:\.\d+)*)\.\s+([A-Z][^.]{2,50})$", r"^([IVX]+)\.\s+([A-Z][^.]{2,50})$"
    capitals = line.rlike(r"^[A-Z][A-Z\s]{5,50}$") & (F.length(line) < 60) & line.rlike("|".join(COMMON_HEADERS))
    title = (
        F.when(line.rlike(markdown), F.regexp_extract(line, markdown, 2))
        .when(line.rlike(numbered), F.regexp_extract(line, numbered, 2))
        .when(line.rlike(roman), F.regexp_extract(line, roman, 2))
        .when(capitals, line)
    )
    level = F.when(line.rlike(markdown), F.length(F.regexp_extract(line, markdown, 1))).when(line.rlike(numbered), F.size(F.split(F.regexp_extract(line, numbered, 1), r"\."))).otherwise(1)
    w = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines_of(docs, key).withColumn("title", title).withColumn("level", level).withColumn("section", F.sum(F.col("title").isNotNull().cast("long")).over(w))
    body = F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("line", "title", "content"))), lambda x: x["title"].isNull()), lambda x: x["content"]), "\n")
    grouped = marked.groupBy(key, "section").agg(F.max("title").alias("title"), F.max(F.when(F.col("title").isNotNull(), F.col("level"))).cast("long").alias("level"), body.alias("content"))
    kind, lowered = None, F.lower("title")
    for name, words in SECTION_WORDS.items():
        kind = (F if kind is None else kind).when(lowered.rlike("|".join(words.split())), name)
    return grouped.withColumn("kind", kind.otherwise("content"))


def _packed(most: int, overlap: int):
    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                held, first, index = [], True, 0
                for paragraph in [p.split() for p in row.content.split("\n\n") if p.strip()]:
                    if held and len(held) + len(paragraph) > most:
                        out.append((row.key, row.section, row.title, row.kind, index, len(held), " ".join(held)))
                        index, held = index + 1, held[-overlap:] if overlap else []
                    held += paragraph
                    while len(held) > most:
                        out.append((row.key, row.section, row.title, row.kind, index, most, " ".join(held[:most])))
                        index, held = index + 1, held[most - overlap :]
                if held:
                    out.append((row.key, row.section, row.title, row.kind, index, len(held), " ".join(held)))
            yield pd.DataFrame(out, columns=["key", "section", "title", "kind", "chunk_index", "n_words", "content"])

    return pack


def section_chunks(docs: DataFrame, key: str = "doc_id", most: int = 300, overlap: int = 20) -> DataFrame:
    """Paragraphs of each section packed into chunks; reference sections are left out, text before the first header is kept."""
    kept = sections(docs, key).filter("kind <> 'references'").select(F.col(key).alias("key"), "section", "title", "kind", "content")
    kind = docs.schema[key].dataType.simpleString()
    return kept.mapInPandas(_packed(most, overlap), f"key {kind}, section long, title string, kind string, chunk_index long, n_words long, content string").withColumnRenamed("key", key)


def similarity_borders(vectors: DataFrame, group: str, order: str, embedding: str = "embedding", window: int = 3, least_gap: int = 3) -> DataFrame:
    """Places in a sequence of vectors where a new chunk begins: (group, order, similarity).

    The mean vectors of windows that begin one after the other are compared; behind a window whose similarity to
    the next is under min(0.7, mean - 0.1) there is a border. Of borders nearer than ``least_gap`` the more
    confident stays, the first of equal ones; confidence is the drop below the mean over 0.3, 1 at most. Sequences
    under two windows have none. A sequence is a document, so its windows and this fold are one group.
    """
    from scriptorium.functions import vectors as fv

    w = Window.partitionBy(group).orderBy(order)
    mean = lambda vs: F.aggregate(F.slice(vs, 2, window), F.transform(F.element_at(vs, 1), lambda x: x.cast("double")), lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    placed = vectors.select(
        group,
        (F.row_number().over(w) - 1 + window).alias("pos"),
        F.lead(order, window).over(w).alias(order),
        F.collect_list(embedding).over(w.rowsBetween(0, window - 1)).alias("a"),
        F.collect_list(embedding).over(w.rowsBetween(1, window)).alias("b"),
        F.count(F.lit(1)).over(Window.partitionBy(group)).alias("n"),
    )
    scored = placed.filter((F.size("b") == window) & (F.col("n") >= 2 * window)).select(group, "pos", order, F.round(fv.cosine(mean(F.col("a")), mean(F.col("b"))), 6).alias("similarity"))
    rated = scored.withColumn("drop", F.avg("similarity").over(Window.partitionBy(group)) - F.col("similarity"))
    low = rated.filter(F.col("similarity") < F.least(F.lit(0.7), F.col("drop") + F.col("similarity") - 0.1)).withColumn("sure", F.least(F.lit(1.0), F.col("drop") / 0.3))
    listed = low.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("pos", order, "similarity", "sure"))).alias("x"))
    folded = F.expr(f"""
        aggregate(slice(x, 2, greatest(size(x) - 1, 0)), slice(x, 1, 1), (m, y) ->
            if(y.pos - element_at(m, -1).pos >= {least_gap}, concat(m, array(y)),
               if(y.sure > element_at(m, -1).sure, concat(slice(m, 1, size(m) - 1), array(y)), m)))
    """)
    return listed.select(group, F.explode_outer(folded).alias("e")).select(group, f"e.{order}", "e.similarity")


def bordered_chunks(sentences: DataFrame, borders: DataFrame, group: str, order: str, text: str = "text", least: int = 50, most: int = 500, overlap: int = 1) -> DataFrame:
    """(group, chunk_index, first, n_words, content): sentences between borders.

    A chunk under ``least`` words is left out unless it is the last; one over ``most`` is split before it exceeds
    80 % of that, with the last ``overlap`` sentences told again. A document's sentences are one row's array.
    """
    marks = borders.select(group, order).distinct().withColumn("mark", F.lit(1))
    placed = sentences.join(marks, [group, order], "left").withColumn("segment", F.sum(F.coalesce("mark", F.lit(0))).over(Window.partitionBy(group).orderBy(order)))
    sized = placed.select(group, order, "segment", F.struct(F.col(order).alias("o"), F.col(text).alias("t"), F.size(F.split(F.col(text), r"\s+")).alias("n")).alias("s"))
    listed = sized.groupBy(group, "segment").agg(F.array_sort(F.collect_list("s")).alias("x")).withColumn("words", F.expr("aggregate(x, 0, (a, y) -> a + y.n)"))
    last = F.max("segment").over(Window.partitionBy(group))
    kept = listed.withColumn("last", last).filter((F.col("words") >= least) | (F.col("segment") == F.col("last")))
    target = most * 0.8
    parts = F.expr(f"""
        aggregate(sequence(0, size(x) - 1), named_struct('first', 0, 'n', 0, 'out', cast(array() as array<struct<first:int,stop:int>>)), (a, j) ->
            if(a.n + get(x, j).n > {target} and j > a.first,
               named_struct('first', greatest(a.first, j - {overlap}), 'n', aggregate(slice(x, greatest(a.first, j - {overlap}) + 1, j - greatest(a.first, j - {overlap})), 0, (b, y) -> b + y.n) + get(x, j).n, 'out', concat(a.out, array(named_struct('first', a.first, 'stop', j)))),
               named_struct('first', a.first, 'n', a.n + get(x, j).n, 'out', a.out)),
            a -> concat(a.out, array(named_struct('first', a.first, 'stop', size(x)))))
    """)
    whole = F.expr("array(named_struct('first', 0, 'stop', size(x)))")
    cut = kept.withColumn("p", F.when(F.col("words") > most, parts).otherwise(whole))
    shown = cut.select(group, "segment", F.explode_outer(F.expr("transform(p, c -> named_struct('first', get(x, c.first).o, 'n', aggregate(slice(x, c.first + 1, c.stop - c.first), 0, (a, y) -> a + y.n), 'content', array_join(transform(slice(x, c.first + 1, c.stop - c.first), y -> y.t), ' ')))")).alias("c"))
    numbered = shown.withColumn("chunk_index", (F.row_number().over(Window.partitionBy(group).orderBy("segment", "c.first")) - 1).cast("long"))
    return numbered.select(group, "chunk_index", F.col("c.first").alias("first"), F.col("c.n").cast("long").alias("n_words"), F.col("c.content").alias("content"))


def with_running_heads(pages: DataFrame, document: str = "doc_id", page: str = "page_number", share: float = 0.5) -> DataFrame:
    """Pages with _heads, the forms of lines that recur among the first or last two on at least ceil(share * pages) pages of their document, if that has three and more; else null.

    Only the forms of first and last lines are shuffled. Those that recur are few a document (each takes a share of its
    pages), so they are a list for each document, broadcast where documents with such lists are few.
    """
    from scriptorium.operators.search import small
    from scriptorium.sources.tables import stored

    filled = F.filter(F.split(ft.present("text"), "\n"), lambda x: F.trim(x) != "")
    edges = F.concat(F.slice("x", 1, 2), F.slice("x", F.greatest(F.size("x") - 1, F.lit(1)), F.lit(2)))
    forms = pages.select(document, page, filled.alias("x")).select(document, page, F.explode_outer(F.array_distinct(F.transform(edges, ft.line_form))).alias("form")).filter("length(form) > 3")
    counts = forms.groupBy(document, "form").agg(F.count_distinct(page).alias("on_pages"))
    sizes = pages.groupBy(document).agg(F.count(F.lit(1)).alias("pages")).filter("pages >= 3")
    recurring = counts.join(sizes, document).filter(F.col("on_pages") >= F.ceil(F.col("pages") * share))
    heads = stored(recurring.groupBy(document).agg(F.collect_list("form").alias("_heads")))
    return pages.join(small(heads), document, "left")


def headless(text: Column, heads: Column) -> Column:
    """A page without those of its first and last two lines whose form is among its document's heads: its lines stay in its row."""
    lines = F.split(text, "\n")
    kept = F.filter(lines, lambda x, i: ~(((i < 2) | (i >= F.size(lines) - 2)) & F.array_contains(heads, ft.line_form(x))))
    return F.when(heads.isNull(), text).otherwise(F.array_join(kept, "\n"))


def without_running_heads(pages: DataFrame, document: str = "doc_id", page: str = "page_number", share: float = 0.5) -> DataFrame:
    """Pages without lines that recur among the first or last two on at least ceil(share * pages) pages of a document of three and more."""
    marked = with_running_heads(pages, document, page, share)
    return marked.select(document, page, headless(ft.present("text"), F.col("_heads")).alias("text"))


#: Words that mark academic statements.
ACADEMIC = "results conclude demonstrate findings analysis therefore significant montre conclusion résultats analyse donc".split()


def _rated(words: pa.Array) -> pa.Array:
    """For each sentence of each document, as lists of words: how often its words are in the document on average, how many it has, and how many academic ones."""
    found = []
    for u in range(0, len(words), 256):
        part = words.slice(u, 256)
        split = part.flatten()
        each, sizes = (pc.list_value_length(x).to_numpy(zero_copy_only=False) for x in (part, split))
        coded = split.flatten().dictionary_encode("encode")
        code, sentence = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(split)), sizes)
        document, width = np.repeat(np.arange(len(part)), each), max(1, len(coded.dictionary))
        _, at, counts = np.unique(document[sentence] * width + code, return_inverse=True, return_counts=True)
        mean = np.bincount(sentence, counts[at], len(split)) / np.maximum(sizes, 1)
        own = np.flatnonzero(pc.is_in(coded.dictionary, value_set=pa.array(ACADEMIC)).to_numpy(zero_copy_only=False)[code])
        academic = np.bincount(np.unique(sentence[own] * width + code[own]) // width, minlength=len(split))
        rows = pa.StructArray.from_arrays([pa.array(mean), pa.array(sizes, pa.int32()), pa.array(academic, pa.int32())], names=["tf", "words", "academic"])
        found.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(each)]), pa.int32()), rows))
    return pa.concat_arrays(found) if found else pa.array([], pa.list_(pa.struct([("tf", pa.float64()), ("words", pa.int32()), ("academic", pa.int32())])))


def summaries(docs: DataFrame, key: str = "doc_id", most_words: int = 750) -> DataFrame:
    """(key, pos, sentence, score): the best sentences that fit a budget of words, in their order.

    Taking a sentence stops at 90 % of the budget; one that doesn't fit is passed over, so the choice is a fold.
    A document stays one row until its sentences are chosen: nothing is shuffled.
    """

    @F.arrow_udf("array<struct<tf: double, words: int, academic: int>>")
    def rated(words: pa.Array) -> pa.Array:
        return _rated(words)

    split = docs.select(key, ft.sentences(ft.present("text")).alias("s"))
    numbers = split.select(key, "s", rated(F.transform("s", ft.search_words)).alias("r"))

    def scored(sentence: Column, pos: Column) -> Column:
        r, place = F.get("r", pos), pos / F.size("s")
        score = (
            r["tf"]
            + F.when((place < 0.1) | (place >= 0.9), 1.0).otherwise(0.0)
            + 0.5 * r["academic"]
            - F.when(r["words"] < 5, 1.0).when(r["words"] > 40, 0.5).otherwise(0.0)
            + F.when(sentence.rlike(r"\d"), 0.3).otherwise(0.0)
        )
        return F.struct((-F.round(score, 6)).alias("least"), pos.alias("pos"), r["words"].alias("words"))

    ordered = numbers.select(key, "s", F.array_sort(F.transform("s", scored)).alias("x"))
    chosen = F.expr(f"""
        aggregate(x, named_struct('used', 0, 'taken', cast(array() as array<struct<pos: int, score: double>>)), (a, y) ->
            if(a.used >= {most_words * 0.9} or a.used + y.words > {most_words}, a, named_struct('used', a.used + y.words, 'taken', concat(a.taken, array(named_struct('pos', y.pos, 'score', -y.least))))),
            a -> a.taken)
    """)
    taken = ordered.select(key, "s", chosen.alias("taken"))
    # not explode: the filter of empty arrays that it implies would be worked out at the scan, with all that lies between
    shown = taken.select(key, F.explode_outer(F.transform("taken", lambda y: F.struct(y["pos"].alias("pos"), F.get("s", y["pos"]).alias("sentence"), y["score"].alias("score")))).alias("y"))
    return shown.filter("y is not null").select(key, F.col("y.pos").cast("long").alias("pos"), "y.sentence", "y.score")
