"""Notes and chapters: sections by headings, long texts cut at sentences, segments with lines, pages by position, slides.

Positions are code points from 0, lines are counted from 1 unless said otherwise. Cutting is a fold over one
text in array expressions; nothing leaves the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as ft
from scriptorium.operators import citations

HEADING = r"^(#{1,6})\s+(.+)$"


def _last(text: str, mark: str) -> str:
    """SQL: the last place (0-based) of a two-character mark, -1 without one."""
    return f"if(instr(reverse({text}), reverse('{mark}')) = 0, -1, length({text}) - instr(reverse({text}), reverse('{mark}')) - 1)"


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def cuts(text: str, most: int = 2000, overlap: int = 200, back: int = 200, always_on: bool = True) -> Column:
    """[(first, last)] of the pieces of a text column: ``most`` characters, cut behind the last paragraph or sentence end of the final ``back``.

    The next piece begins ``overlap`` before the cut, or at the cut if that would not be further on; without
    ``always_on`` a piece that would begin at the start or before ends the text.
    """
    best = "greatest(" + ", ".join(_last("b", m) for m in ("\\n\\n", ". ", "! ", "? ")) + ")"
    least = "a.pos" if always_on else "0"
    end = f"least(a.pos + {most}, length({text}))"
    cut = _let("e", end, _let("b", f"substring({text}, greatest({least}, e - {back}) + 1, e - greatest({least}, e - {back}))", f"if(e < length({text}) and {best} > 0, e - length(b) + {best} + 2, e)"))
    after = f"if(c - {overlap} > a.pos, c - {overlap}, c)" if always_on else f"c - {overlap}"
    done = f"c >= length({text})" + ("" if always_on else f" or c - {overlap} <= 0")
    step = _let("c", cut, f"named_struct('pos', {after}, 'done', {done}, 'out', concat(a.out, array(named_struct('first', a.pos, 'last', c))))")
    start = "named_struct('pos', 0, 'done', false, 'out', cast(array() as array<struct<first:int,last:int>>))"
    # every piece but the last goes on by most - back - overlap at least
    return F.expr(f"aggregate(sequence(0, length({text}) div {max(1, most - back - overlap)} + 1), {start}, (a, i) -> if(a.done or a.pos >= length({text}), a, {step}), a -> a.out)")


def sections(notes: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, section, title, position, line, content): text between headings, its heading included; what stands before the first is section 0."""
    heading = F.col("raw").rlike(HEADING)
    w = Window.partitionBy(key).orderBy("n")
    lines = notes.select(key, F.posexplode(F.split(ft.present(text), "\n")).alias("n", "raw"))
    placed = lines.withColumn("at", F.coalesce(F.sum(F.length("raw") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("section", F.sum(heading.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    title = F.max(F.when(heading, F.trim(F.regexp_extract("raw", HEADING, 2))))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "raw"))), lambda x: x["raw"]), "\n")
    grouped = placed.groupBy(key, "section").agg(title.alias("title"), F.min("at").cast("long").alias("position"), (F.min("n") + 1).cast("long").alias("line"), body.alias("content"))
    return grouped.select(key, F.col("section").cast("long").alias("section"), "title", "position", "line", "content")


def _numbered(pieces: DataFrame, key: str) -> DataFrame:
    return pieces.withColumn("chunk_index", (F.row_number().over(Window.partitionBy(key).orderBy("section", "part")) - 1).cast("long"))


def note_chunks(notes: DataFrame, key: str = "note_id", text: str = "text", most: int = 2000, overlap: int = 200) -> DataFrame:
    """(key, chunk_index, title, first, last, content): sections of notes, long ones cut at sentences; positions are those of the note."""
    found = sections(notes, key, text).withColumn("content", ft.strip(F.col("content"))).filter("content <> ''")
    whole = F.array(F.struct(F.lit(0).alias("first"), F.length("content").alias("last")))
    cut = found.withColumn("cuts", F.when(F.length("content") <= most, whole).otherwise(cuts("content", most, overlap, always_on=False)))
    pieces = cut.select(key, "section", "title", "position", "content", F.posexplode_outer("cuts").alias("part", "c")).filter("c is not null")
    content = ft.strip(F.substring("content", F.col("c.first") + 1, F.col("c.last") - F.col("c.first")))
    shown = pieces.select(key, "section", "part", "title", (F.col("position") + F.col("c.first")).alias("first"), (F.col("position") + F.col("c.last")).alias("last"), content.alias("content"))
    return _numbered(shown, key).select(key, "chunk_index", "title", "first", "last", "content")


def chapter_chunks(chapters: DataFrame, key: str = "chapter", text: str = "text", most: int = 2000, overlap: int = 200) -> DataFrame:
    """(key, chunk_index, title, line, content): the prose of each section of a chapter, cut at sentences; sections of a heading only are left out."""
    found = sections(chapters, key, text).withColumn("prose", citations.prose(F.col("content")))
    kept = found.filter("prose <> ''").filter(F.col("title").isNull() | (F.trim("prose") != F.trim("title")))
    whole = F.array(F.struct(F.lit(0).alias("first"), F.length("prose").alias("last")))
    cut = kept.withColumn("cuts", F.when(F.length("prose") <= most, whole).otherwise(cuts("prose", most, overlap)))
    pieces = cut.select(key, "section", "title", "line", "prose", F.posexplode_outer("cuts").alias("part", "c")).filter("c is not null")
    content = F.when(F.length("prose") <= most, F.col("prose")).otherwise(ft.strip(F.substring("prose", F.col("c.first") + 1, F.col("c.last") - F.col("c.first"))))
    return _numbered(pieces.withColumn("piece", content).filter("piece <> ''"), key).select(key, "chunk_index", "title", "line", F.col("piece").alias("content"))


def parts(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 3000, back: int = 200) -> DataFrame:
    """(key, part, content): a text in parts of ``most`` characters that end behind the last sentence end of the final ``back``; no overlap."""
    base = docs.select(key, ft.present(text).alias("t"))
    window = _let("e", f"least(a.pos + {most}, length(t))", _let("s", f"greatest(a.pos, e - {back})", _let("g", r"length(regexp_extract(substring(t, s + 1, e - s), '(?s)^(.*[.!?])\\s', 1))", "if(e < length(t) and g > 0, s + g, e)")))
    step = _let("c", window, "named_struct('pos', c, 'out', concat(a.out, array(named_struct('first', a.pos, 'last', c))))")
    folded = f"aggregate(sequence(0, length(t) div {most - back} + 1), named_struct('pos', 0, 'out', cast(array() as array<struct<first:int,last:int>>)), (a, i) -> if(a.pos >= length(t), a, {step}), a -> a.out)"
    cut = base.withColumn("cuts", F.expr(f"if(length(t) <= {most}, array(named_struct('first', 0, 'last', length(t))), {folded})"))
    exploded = cut.select(key, "t", F.posexplode_outer("cuts").alias("part", "c"))
    content = F.substring("t", F.col("c.first") + 1, F.col("c.last") - F.col("c.first"))
    return exploded.select(key, F.col("part").cast("long").alias("part"), F.when(F.length("t") <= most, content).otherwise(ft.strip(content)).alias("content"))


def paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, first_line, last_line, content): runs of lines that aren't blank; lines are counted from 0."""
    lines = docs.select(key, F.posexplode(F.split(ft.present(text), "\n")).alias("n", "raw")).withColumn("blank", ft.strip(F.col("raw")) == "")
    runs = lines.withColumn("run", F.sum(F.col("blank").cast("int")).over(Window.partitionBy(key).orderBy("n"))).filter("not blank")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "raw"))), lambda x: x["raw"]), "\n")
    return runs.groupBy(key, "run").agg(F.min("n").cast("long").alias("first_line"), F.max("n").cast("long").alias("last_line"), ft.strip(body).alias("content")).drop("run")


def section_segments(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, title, first_line, last_line, content): sections without their heading line, the opening one named Introduction; lines from 0, in order."""
    found = sections(docs, key, text)
    size = F.size(F.split("content", "\n"))
    body = ft.strip(F.when(F.col("title").isNull(), F.col("content")).otherwise(F.array_join(F.slice(F.split("content", "\n"), F.lit(2), F.greatest(size, F.lit(1))), "\n")))
    blank = F.when(F.col("title").isNull(), F.size(F.split(F.regexp_extract("content", r"^(\s*\n)?", 0), "\n")) - 1).otherwise(0)
    shown = found.select(key, F.coalesce("title", F.lit("Introduction")).alias("title"), (F.col("line") - 1 + blank).alias("first_line"), (F.col("line") - 2 + size).alias("last_line"), body.alias("content"))
    return shown.filter("content <> ''")


# Abbreviations whose point doesn't end a sentence, in the order in which they are looked for, in any case and
# also at the end of longer words. Of those with two points only the first is one, the second stands for any character.
ABBREVIATIONS = "M. Mme. Mlle. Dr. Pr. Prof. Mr. Mrs. Ms. Jr. Sr. vs. etc. cf. i.e. e.g. p. pp. vol. no. ed. eds. chap. fig. tab. op. cit. ibid.".split()
#: Each abbreviation is masked by a character that no text has; its length elsewhere is that of a mark with its number.
MASKS = [chr(0xFDD0 + i) for i in range(len(ABBREVIATIONS))]


def sentence_segments(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, place, first_line, last_line, content): sentences with about the lines they stand on, counted from 0.

    Texts are cut after sentence ends, abbreviations masked; all masked forms of an abbreviation come back as its last one. A
    sentence's first line is where the lengths of those before it, without their ends, reach among the line ends: both are
    prefix sums, merged in one sorted pass over each text. Lengths are UTF-16 units. Rows are texts of their own; null texts have no sentences.
    """
    rules = F.array(*[F.struct(F.lit("(?i)(" + a.replace(".", r"\.", 1) + ")").alias("pattern"), F.lit(m).alias("mask"), F.lit(a[: 3 if a.count(".") > 1 else len(a)].lower()).alias("shown")) for a, m in zip(ABBREVIATIONS, MASKS)])
    # a pattern is run over the texts only that have its letters; an explode of one element keeps the masked text from being made again
    base = docs.select(F.monotonically_increasing_id().alias("_row"), key, ft.present(text).alias("t"), F.lower(ft.present(text)).alias("lower"))
    masked = F.aggregate(rules, F.col("t"), lambda held, r: F.when(F.col("lower").contains(r["shown"]), F.regexp_replace(held, r["pattern"], r["mask"])).otherwise(held))
    base = base.select("_row", key, "t", F.explode(F.array(masked)).alias("masked"))
    kept = F.filter(rules, lambda r: F.col("masked").contains(r["mask"]))
    lasts = F.transform(kept, lambda r: F.struct(r["mask"].alias("mask"), F.element_at(F.regexp_extract_all(F.col("t"), r["pattern"], F.lit(1)), -1).alias("last")))
    base = base.select("_row", key, "masked", F.split("t", "\n").alias("lines"), F.explode(F.array(lasts)).alias("lasts"))
    back = F.aggregate("lasts", F.col("s.raw"), lambda held, r: F.replace(held, r["mask"], r["last"]))
    # both kinds of places in one explode: pieces between sentence ends, and lines but for the last
    event = lambda kind, i, raw: F.struct(F.lit(kind).alias("kind"), i.alias("place"), raw.alias("raw"))
    pieces = F.transform(F.split("masked", rf"[.!?]+[{ft.SPACE}]+"), lambda x, i: event(0, i, x))
    ends = F.transform(F.slice("lines", F.lit(1), F.size("lines") - 1), lambda x, i: event(1, i, x))
    events = base.select("_row", key, "lasts", F.size("lines").alias("n_lines"), F.explode(F.concat(pieces, ends)).alias("s"))
    marks = lambda some: F.length("s.raw") - F.length(F.translate("s.raw", "".join(some), ""))
    # a mark of one digit is ten long, of two digits eleven
    units = ft.utf16_length(F.col("s.raw")) + F.when(F.col("s.kind") == 1, 1).otherwise(9 * marks(MASKS[:10]) + 10 * marks(MASKS[10:]))
    content = F.when(F.col("s.kind") == 0, ft.trimmed(back))
    sized = events.select("_row", key, "n_lines", "s.kind", "s.place", units.cast("long").alias("units"), content.alias("content")).filter("kind = 1 or content <> ''").repartition("_row")  # both sums below go by row
    before = F.sum("units").over(Window.partitionBy("_row", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)) - F.when(F.col("kind") == 0, F.col("units")).otherwise(0)
    merged = sized.withColumn("at", before)
    passed = F.sum("kind").over(Window.partitionBy("_row").orderBy("at", "kind", "place").rowsBetween(Window.unboundedPreceding, 0))
    found = merged.withColumn("first_line", passed.cast("long")).filter("kind = 0")
    last = F.least(F.col("first_line") + F.size(F.split("content", "\n")) - 1, F.col("n_lines") - 1)
    return found.select(key, F.col("place").cast("long").alias("place"), "first_line", last.cast("long").alias("last_line"), "content")


def with_positions(chunks: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds first and last: where a chunk's first word stands, looked for from the end of the chunk before, and that plus its length.

    Places and lengths are UTF-16 units: characters beyond the basic plane take two. The search is a fold over the
    document's chunks in order; a word that isn't found counts from where the search began.
    """
    listed = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chunk_index", ft.padded(F.col("content")).alias("content")))).alias("x"))
    joined = listed.join(docs.select(key, ft.padded(ft.present(text)).alias("t")), key)
    found = _let("p", "locate(split(y.content, ' ')[0], t, a.at + 1) - 1", _let("f", "if(p < 0, a.at, p)", "named_struct('at', f + length(y.content), 'out', concat(a.out, array(named_struct('chunk_index', y.chunk_index, 'first', f, 'last', f + length(y.content)))))"))
    placed = joined.select(key, F.expr(f"aggregate(x, named_struct('at', 0, 'out', cast(array() as array<struct<chunk_index:bigint,first:int,last:int>>)), (a, y) -> {found}, a -> a.out)").alias("o"))
    places = placed.select(key, F.explode_outer("o").alias("o")).select(key, "o.chunk_index", F.col("o.first").cast("long").alias("first"), F.col("o.last").cast("long").alias("last"))
    return chunks.join(places, [key, "chunk_index"])


def with_pages(chunks: DataFrame, pages: DataFrame, key: str = "doc_id", page: str = "page_number", text: str = "text", gap: int = 2) -> DataFrame:
    """Adds the page that holds a chunk's first character; pages follow each other with ``gap`` characters between; beyond them it is the last page."""
    size = ft.utf16_length(ft.present(text)) + gap
    w = Window.partitionBy(key).orderBy(page)
    ends = pages.select(key, page, F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("end"))
    listed = ends.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("end", F.col(page).alias("page")))).alias("ends"))
    hit = F.coalesce(F.get(F.filter("ends", lambda e: F.col("first") < e["end"]), F.lit(0))["page"], F.element_at("ends", -1)["page"])
    return chunks.join(listed, key, "left").withColumn(page, hit).drop("ends")


def slides(decks: DataFrame, key: str = "deck", text: str = "text") -> DataFrame:
    """(key, slide, title, content): a deck between lines of three dashes, of which those in code or in the front matter don't count."""
    front = F.regexp_replace(ft.present(text), r"(?s)\A---\n.*?\n---\n", "")
    lines = decks.select(key, F.posexplode(F.split(front, "\n")).alias("n", "raw"))
    w = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    fenced = lines.withColumn("fences", F.sum(F.col("raw").rlike(r"^\s*(```|~~~)").cast("int")).over(w))
    mark = (F.trim("raw") == "---") & (F.col("fences") % 2 == 0)
    numbered = fenced.withColumn("mark", mark).withColumn("slide", F.sum(mark.cast("int")).over(w)).filter("not mark")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "raw"))), lambda x: x["raw"]), "\n")
    grouped = numbered.groupBy(key, "slide").agg(ft.strip(body).alias("content"))
    return grouped.select(key, F.col("slide").cast("long").alias("slide"), F.nullif(F.regexp_extract("content", r"(?m)^#{1,6}\s+(.+)$", 1), F.lit("")).alias("title"), "content")
