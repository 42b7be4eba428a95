"""Items of a photo archive from its tables, session reports, page preprocessing and the ingest of paged documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.functions import text as ft
from scriptorium.operators import chunk, dedup, textometrics
from scriptorium.operators.search import small
from scriptorium.sources.tables import stored

# --- items -----------------------------------------------------------------------------------------

GENERIC = "https://tropy.org/v1/templates/generic"  # fixed value: the template of items that have none


def archive_items(items: DataFrame, subjects: DataFrame, metadata: DataFrame, taggings: DataFrame, notes: DataFrame, photos: DataFrame, selections: DataFrame, images: DataFrame) -> DataFrame:
    """One row per item: item_id, template, type, fields (map), tags, notes, photos by position with their notes and selections.

    A field is named by what follows the last slash or hash of its property; of several values that of the last
    value_id counts. Deleted notes are left out; a selection's missing sizes are 100, its missing angle 0.
    ``notes`` has owner, note_id, text, deleted; owners are items, photos and selections.
    """
    name = F.regexp_extract("property", r"[/#]([^/#]+)$", 1)
    named = metadata.select("item_id", name.alias("name"), "value_id", "value").filter("name <> '' and coalesce(value, '') <> ''")
    last = named.groupBy("item_id", "name").agg(F.max_by("value", "value_id").alias("value"))
    fields = last.groupBy("item_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("fields"))
    tags = taggings.groupBy("item_id").agg(F.array_sort(F.collect_list("tag")).alias("tags"))
    kept = notes.filter("deleted is null").groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("note_id", F.coalesce("text", F.lit("")).alias("text")))).alias("notes"))
    none = "cast(array() as array<struct<note_id:bigint,text:string>>)"
    with_notes = lambda df, key: df.join(kept, F.col(key) == F.col("owner"), "left").withColumn("notes", F.coalesce("notes", F.expr(none))).drop("owner")
    sized = selections.join(images, F.col("selection_id") == F.col("image_id"), "left")
    default = lambda c, value: F.coalesce(F.col(c), F.lit(value)).alias(c)
    shapes = with_notes(sized, "selection_id").select("photo_id", F.struct("selection_id", default("x", 0), default("y", 0), default("width", 100), default("height", 100), default("angle", 0), "notes").alias("s"))
    chosen = shapes.groupBy("photo_id").agg(F.array_sort(F.collect_list("s")).alias("selections"))
    pictures = with_notes(photos, "photo_id").join(chosen, "photo_id", "left")
    filename = F.coalesce(F.nullif(F.col("filename"), F.lit("")), F.regexp_extract("path", r"([^/]+)$", 1)).alias("filename")
    listed = pictures.select("item_id", F.struct("position", "photo_id", "path", filename, F.col("notes").alias("notes"), "selections").alias("p")).groupBy("item_id").agg(F.array_sort(F.collect_list("p")).alias("photos"))
    base = items.join(subjects, "item_id", "left").withColumn("template", F.coalesce(F.nullif(F.col("template"), F.lit("")), F.lit(GENERIC)))
    joined = with_notes(base, "item_id").join(fields, "item_id", "left").join(tags, "item_id", "left").join(listed, "item_id", "left")
    return joined.select("item_id", "template", "type", "fields", F.coalesce("tags", F.expr("cast(array() as array<string>)")).alias("tags"), "notes", "photos")


# --- session reports -------------------------------------------------------------------------------


def session_reports(events: DataFrame, session: str = "session_id", at: str = "at", kind: str = "kind", form: str = "markdown") -> DataFrame:
    """(session, report): a session's length, number of events and timeline as markdown, json or latex; times are UTC."""
    listed = events.groupBy(session).agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(kind).alias("kind")))).alias("x"), F.min(at).alias("started"), F.max(at).alias("ended"), F.count(F.lit(1)).alias("n"))
    moment = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    minutes = F.round((F.unix_seconds("ended") - F.unix_seconds("started")) / 60).cast("long").cast("string")
    duration = F.when(F.col("ended") > F.col("started"), F.concat(minutes, F.lit(" minutes"))).otherwise("N/A")
    name, count = F.col(session).cast("string"), F.col("n").cast("string")
    if form == "markdown":
        lines = F.array_join(F.transform("x", lambda e: F.concat(F.lit("- **"), F.date_format(e["at"], "HH:mm:ss"), F.lit("** - "), e["kind"], F.lit("\n"))), "")
        report = F.concat(F.lit("# Research Session Report\n\n**Session ID:** "), name, F.lit("\n**Started:** "), moment("started"), F.lit("\n**Ended:** "), moment("ended"), F.lit("\n**Duration:** "), duration, F.lit("\n**Total Events:** "), count, F.lit("\n\n---\n\n## Timeline\n\n"), lines, F.lit("\n"))
    elif form == "latex":
        item = lambda label, value: F.concat(F.lit(f"  \\item {label}: "), value, F.lit("\n"))
        report = F.concat(F.lit("\\section{Research Session Report}\n\n\\subsection{Session Information}\n\n\\begin{itemize}\n"), item("Session ID", F.concat(F.lit("\\texttt{"), name, F.lit("}"))), item("Started", moment("started")), item("Ended", moment("ended")), item("Duration", duration), item("Total Events", count), F.lit("\\end{itemize}\n\n"))
    else:
        report = F.to_json(F.struct(F.struct(F.col(session).alias("id"), moment("started").alias("startedAt"), moment("ended").alias("endedAt"), F.col("n").alias("eventCount")).alias("session"), F.transform("x", lambda e: F.struct(F.date_format(e["at"], "yyyy-MM-dd HH:mm:ss").alias("timestamp"), e["kind"].alias("eventType"))).alias("events")))
    return listed.select(session, report.alias("report"))


# --- paged documents -------------------------------------------------------------------------------


def _marked(pages: DataFrame, document: str, page: str, text: str, share: float) -> DataFrame:
    source = pages.filter(F.col(document).isNotNull() & F.col(page).isNotNull()).select(document, page, ft.present(text).alias("text"))
    return chunk.with_running_heads(source, document, page, share)


def preprocessed(pages: DataFrame, document: str = "doc_id", page: str = "page_number", text: str = "text", share: float = 0.5) -> DataFrame:
    """Pages without recurring heads, page numbers and scanner noise: (document, page, text, heads_removed, numbers_removed, original_length)."""
    return _cleaned(_marked(pages, document, page, text, share), document, page)


def _cleaned(marked: DataFrame, *keys: str) -> DataFrame:
    """Pages with text and _heads cleaned, each within its row."""
    joined = marked.select(*keys, F.length("text").cast("long").alias("original_length"), F.size(F.split("text", "\n")).alias("lines"), chunk.headless(F.col("text"), F.col("_heads")).alias("headless"))
    unnumbered = joined.withColumn("unnumbered", ft.drop_page_numbers(F.col("headless")))
    heads = (F.col("lines") - F.when(F.col("headless") == "", F.when(F.col("original_length") == 0, 1).otherwise(0)).otherwise(F.size(F.split("headless", "\n")))).cast("long")
    return unnumbered.select(*keys, ft.clean_ocr(F.col("unnumbered")).alias("text"), heads.alias("heads_removed"), (F.length("unnumbered") < F.length("headless")).alias("numbers_removed"), "original_length")


def preprocess_statistics(pages: DataFrame, document: str = "doc_id") -> DataFrame:
    """(document, heads_removed, pages_unnumbered, characters_removed, original_length, processed_length) of preprocessed pages."""
    sums = pages.groupBy(document).agg(F.sum("heads_removed").alias("heads_removed"), F.count_if("numbers_removed").alias("pages_unnumbered"), F.sum("original_length").alias("original_length"), F.sum(F.length("text")).alias("processed_length"))
    return sums.withColumn("characters_removed", F.col("original_length") - F.col("processed_length")).select(document, "heads_removed", "pages_unnumbered", "characters_removed", "original_length", "processed_length")


def page_chunks(pages: DataFrame, document: str = "doc_id", page: str = "page_number", text: str = "text", most: int = 300, overlap: int = 50, least: int = 50) -> DataFrame:
    """(document, chunk_index, page, n_words, content): paragraphs of each page packed to ``most`` words, the last ``overlap`` words told again.

    The last chunk of a page is left out if it has fewer than ``least`` words. Packing is a fold over a page's paragraphs.
    """
    words = F.transform(F.split(ft.present(text), "\n\n"), lambda p: ft.without_empty(F.split(p, r"\s+")))
    listed = pages.select(document, page, words.alias("x"))
    folded = F.expr(f"""
        aggregate(x, named_struct('held', cast(array() as array<string>), 'out', cast(array() as array<array<string>>)), (a, p) ->
            if(size(a.held) + size(p) > {most} and size(a.held) > 0,
               named_struct('held', concat(slice(a.held, greatest(size(a.held) - {overlap} + 1, 1), {overlap}), p), 'out', concat(a.out, array(a.held))),
               named_struct('held', concat(a.held, p), 'out', a.out)),
            a -> if(size(a.held) >= {least}, concat(a.out, array(a.held)), a.out))
    """)
    exploded = listed.select(document, page, F.posexplode_outer(folded).alias("part", "w")).filter("w is not null")
    numbered = exploded.withColumn("chunk_index", (F.row_number().over(Window.partitionBy(document).orderBy(page, "part")) - 1).cast("long"))
    return numbered.select(document, "chunk_index", page, F.size("w").cast("long").alias("n_words"), F.array_join("w", " ").alias("content"))


def _placed(names: list[str]):
    """Pages in order with the number of their words, and how many words of their document the task has had before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, had = None, 0
        for b in batches:
            words = np.where(pc.equal(b.column(2), "").to_numpy(zero_copy_only=False), 0, pc.count_substring(b.column(2), " ").to_numpy(zero_copy_only=False) + 1).astype(np.int64)
            firsts = np.empty(len(b), np.int64)
            for i, (document, n) in enumerate(zip(b.column(1).to_pylist(), words.tolist())):
                had = had if document == now else 0
                now, firsts[i] = document, had
                had += n
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(words), pa.array(firsts)], names=names)

    return run


def _windows(names: list[str], whole: bool, step: int = 250, width: int = 301):
    """Windows of ``width`` words that begin every ``step`` words of a document, from pages whose place in it is known: those that consecutive pages of a task hold wholly, or the pieces of all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the run of pages: its document and first word, the place of the first word held, the words, the next window
        now, began, at, held, i = None, 0, 0, [], 0
        out: list[tuple] = []

        def tell(stop: int) -> None:
            nonlocal i
            first = max(i * step, at)
            if whole == (stop == i * step + width and i * step >= began):
                out.append((now, i, first, " ".join(held[first - at : stop - at])))
            i += 1

        def told(kind: pa.DataType) -> pa.RecordBatch:
            columns = [pa.array([r[c] for r in out], t) for c, t in enumerate((kind, pa.int64(), pa.int64(), pa.string()))]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        kind = None
        for b in batches:
            kind = b.schema.types[0]
            for document, body, n, place in zip(*(b.column(c).to_pylist() for c in range(4))):
                if document != now or place != at + len(held):
                    while i * step < at + len(held):
                        tell(at + len(held))
                    now, began, at, held, i = document, place, place, [], max(0, (place - width) // step + 1)
                held += body.split(" ")
                while i * step + width <= at + len(held):
                    tell(i * step + width)
                    if i * step > at:
                        held, at = held[i * step - at :], i * step
            yield told(kind)
        while i * step < at + len(held):
            tell(at + len(held))
        if out:
            yield told(kind)

    return run


def book_chunks(ordered: DataFrame, document: str) -> DataFrame:
    """(document, chunk_index, content): the fixed chunks of documents told as pages, whose words are never together in a row.

    ``ordered`` has (part, document, body): pages dealt to tasks by ranges of document and page and in order within, words with one space between. A chunk
    begins every 250 words and is decided by 301 words at most, the last of them the word behind it. A page's place in its document is the words before it in its
    task and those of the tasks before. Windows within consecutive pages are cut where they are; only pieces at the borders of runs are shuffled.
    """
    kind = ordered.schema[document].dataType
    names = ["part", document, "body", "n", "first"]
    placed = stored(ordered.mapInArrow(_placed(names), T.StructType([ordered.schema["part"], ordered.schema[document], *T.StructType.fromDDL("body string, n long, first long").fields])).filter("n > 0"))
    sums = placed.groupBy("part", document).agg(F.sum("n").alias("n"))
    before = sums.select("part", document, F.sum("n").over(Window.partitionBy(document).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    pages = placed.join(small(stored(before.filter("before is not null"))), ["part", document], "left").select(document, "body", "n", (F.col("first") + F.coalesce("before", F.lit(0))).alias("first"))
    names = [document, "chunk_index", "at", "text"]
    schema = T.StructType([T.StructField(document, kind), *T.StructType.fromDDL("chunk_index long, at long, text string").fields])
    pieces = pages.mapInArrow(_windows(names, False), schema).groupBy(document, "chunk_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), " ").alias("text"))
    windows = pages.mapInArrow(_windows(names, True), schema).select(document, "chunk_index", "text").unionByName(pieces)
    # a window as a text of its own: its first chunk
    cut = chunk.fixed_chunks(windows.select(F.struct(document, "chunk_index").alias("id"), "text"), "id").filter("chunk_index = 0")
    return cut.select(f"id.{document}", "id.chunk_index", "content")


def ingested(pages: DataFrame, document: str = "doc_id", page: str = "page_number", text: str = "text") -> DataFrame:
    """(document, chunk_index, content, score): cleaned pages as one text, in chunks that pass the quality checks, each content of a document once."""
    ranged = _marked(pages, document, page, text, 0.5).repartitionByRange(document, page).withColumn("part", F.spark_partition_id())
    body = F.array_join(ft.without_empty(F.split("text", r"\s+")), " ").alias("body")
    clean = _cleaned(ranged, "part", document, page)
    ordered = clean.select("part", document, page, body).sortWithinPartitions(document, page).select("part", document, "body")
    chunks = book_chunks(ordered, document)
    rated = textometrics.quality(chunks.select(F.struct(document, "chunk_index", "content").alias("id"), F.col("content").alias("text")), "id").filter("rejected is null")
    kept = stored(rated.select("id.*", "score", dedup.content_hash(ft.present("id.content")).alias("_hash")))
    # of contents that a document has more than once the first stays; only hashes are shuffled
    copies = stored(kept.groupBy(document, "_hash").agg(F.min("chunk_index").alias("_first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    once = kept.join(small(copies), [document, "_hash"], "left").filter("_first is null or chunk_index = _first")
    return once.select(document, "chunk_index", "content", "score")
