"""Folders of Markdown notes: scan, front matter, titles, links, tags, headings, sections; and note export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as ft

# Folders that hold no notes.
IGNORED = [".obsidian", ".trash", ".git", "node_modules"]
FRONT = r"(?s)^---\r?\n(.*?)\r?\n---\r?\n?"
LINK = r"\[\[([^\]|#]+)(?:#([^\]|]+))?(?:\|([^\]]+))?\]\]"
TAG = r"(?:^|\s)#([a-zA-Z0-9_/-]+)"


def read_vault(spark: SparkSession, path: str) -> DataFrame:
    """(relative_path, text, modified) of the notes below a folder; hidden and tool folders are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(path)
    base = path.rstrip("/").split("://", 1)[-1].split(":", 1)[-1].rstrip("/")
    relative = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/+", "/"), f"^{_quoted(base)}/", "")
    ignored = F.exists(F.split(relative, "/"), lambda part: part.isin(IGNORED))
    return files.select(relative.alias("relative_path"), F.decode("content", "UTF-8").alias("text"), F.col("modificationTime").alias("modified")).filter(~ignored)


def _quoted(text: str) -> str:
    return r"\Q" + text + r"\E"


def front_matter(text: Column) -> Column:
    """The YAML block at the start, '' where there is none."""
    return F.regexp_extract(text, FRONT, 1)


def body(text: Column) -> Column:
    return F.regexp_replace(text, FRONT, "")


def front_value(block: Column, name: str) -> Column:
    """A plain value of the block, without quotes; null where it is missing."""
    found = F.regexp_extract(block, rf"(?m)^{name}:[ \t]*['\"]?(.*?)['\"]?[ \t]*$", 1)
    return F.when(found != "", found)


def front_list(block: Column, name: str) -> Column:
    """A list of the block: [a, b], a comma-separated value, or '- a' lines."""
    inline = F.regexp_extract(block, rf"(?m)^{name}:[ \t]*(\S.*)$", 1)
    listed = F.split(F.regexp_replace(inline, r"[\[\]'\"]", ""), ",")
    lines = F.regexp_extract_all(F.regexp_extract(block, rf"(?m)^{name}:[ \t]*\r?\n((?:[ \t]*-[ \t].*(?:\r?\n|$))*)", 1), F.lit(r"(?m)^[ \t]*-[ \t]+['\"]?(.*?)['\"]?[ \t]*$"), 1)
    return ft.without_empty(F.transform(F.when(inline != "", listed).otherwise(lines), ft.strip))


def unique_tags(tags: Column) -> Column:
    """Without repeats, capitals ignored; the first spelling stays."""
    return F.aggregate(tags, F.array().cast("array<string>"), lambda kept, t: F.when(F.exists(kept, lambda k: F.lower(k) == F.lower(t)), kept).otherwise(F.concat(kept, F.array(t))))


def links(text: Column) -> Column:
    """Array of (target, heading, display) of [[target#heading|display]]; absent parts are null."""
    raw = F.regexp_extract_all(text, F.lit(LINK), 0)
    part = lambda x, k: F.when(F.regexp_extract(x, LINK, k) != "", ft.strip(F.regexp_extract(x, LINK, k)))
    return F.transform(raw, lambda x: F.struct(part(x, 1).alias("target"), part(x, 2).alias("heading"), part(x, 3).alias("display")))


def parse_notes(notes: DataFrame, path: str = "relative_path", text: str = "text") -> DataFrame:
    """Adds title (front matter, first level-1 heading, file name), tags, links and content_hash."""
    t = ft.present(text)
    block, own = front_matter(t), body(t)
    heading = F.regexp_extract(own, r"(?m)^#[ \t]+(.+?)[ \t]*$", 1)
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.md$", "")
    tags = F.concat(front_list(block, "tags"), F.regexp_extract_all(own, F.lit(TAG), 1))
    return notes.withColumns({"title": F.coalesce(front_value(block, "title"), F.when(heading != "", heading), name), "tags": unique_tags(tags), "links": links(own), "content_hash": F.sha2(t, 256)})


def headings(notes: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line, level, title) of headings outside fenced code, lines from 1."""
    lines = notes.select(key, F.posexplode(F.split(ft.present(text), "\n")).alias("line", "content"))
    fence = F.col("content").rlike(r"^\s*(```|~~~)")
    w = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    outside = lines.withColumn("fences", F.sum(fence.cast("int")).over(w)).filter(F.col("fences") % 2 == 0)
    form = r"^(#{1,6})[ \t]+(.+?)[ \t]*\r?$"
    return outside.filter(F.col("content").rlike(form)).select(key, (F.col("line") + 1).alias("line"), F.length(F.regexp_extract("content", form, 1)).alias("level"), F.regexp_extract("content", form, 2).alias("title"))


def as_notes(df: DataFrame, title: str, text: str, tags: str, at: str) -> DataFrame:
    """(file_name, content) of notes to export: front matter, then the text; equal names get -2, -3, ... by time."""
    slug = F.regexp_replace(F.regexp_replace(ft.fold_accents(F.lower(title)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    named = df.withColumn("_slug", F.when(slug == "", "note").otherwise(F.substring(slug, 1, 60)))
    number = F.row_number().over(Window.partitionBy("_slug").orderBy(at, title))
    content = F.concat(F.lit("---\ntitle: \""), F.replace(F.col(title), F.lit('"'), F.lit("'")), F.lit("\"\ntags: ["), F.array_join(tags, ", "), F.lit("]\n---\n\n"), ft.present(text), F.lit("\n"))
    return named.withColumn("_n", number).select(F.concat(F.col("_slug"), F.when(F.col("_n") > 1, F.concat(F.lit("-"), F.col("_n").cast("string"))).otherwise(""), F.lit(".md")).alias("file_name"), content.alias("content"))
