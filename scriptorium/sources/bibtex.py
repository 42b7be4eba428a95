"""BibTeX files: entries to rows and rows to entries."""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ("author", "editor", "year", "title", "journal", "booktitle", "publisher", "file", "keywords", "abstract", "doi", "url")

# Accent commands with the combining characters they stand for, and letters that aren't composed.
COMBINING = {"`": "̀", "'": "́", "^": "̂", "~": "̃", "=": "̄", "u": "̆", ".": "̇", '"': "̈", "r": "̊", "H": "̋", "v": "̌", "c": "̧", "k": "̨"}
LETTERS = {"ss": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "o": "ø", "O": "Ø", "l": "ł", "L": "Ł", "aa": "å", "AA": "Å", "i": "ı"}
ESCAPED = "&%$#_{}"
#: Entries handed on at once.
ROWS = 2000

_ACCENT = re.compile(r"""\{?\\([`'^~=.\"]|[uvHckr](?=[\s{]))\s*(?:\{\\?([A-Za-z])\}|\\?([A-Za-z]))\}?""")
_LETTER = re.compile(r"\{?\\(ss|ae|AE|oe|OE|aa|AA|o|O|l|L|i)(?![A-Za-z])(?:\{\})?\s?\}?")


def to_unicode(value: str) -> str:
    """Accent commands composed, escapes and braces taken off, white space collapsed."""
    value = _ACCENT.sub(lambda m: unicodedata.normalize("NFC", (m[2] or m[3]) + COMBINING[m[1]]), value)
    value = _LETTER.sub(lambda m: LETTERS[m[1]], value)
    value = re.sub(r"\\([&%$#_{}])", lambda m: chr(0xE000 + ESCAPED.index(m[1])), value)
    value = value.replace("---", "—").replace("--", "–").replace("~", " ").replace("{", "").replace("}", "")
    value = re.sub("[-]", lambda m: ESCAPED[ord(m[0]) - 0xE000], value)
    return " ".join(value.split())


def to_latex(value: Column) -> Column:
    """Escapes for the characters that BibTeX treats apart; letters stay as Unicode."""
    return F.regexp_replace(value, r"([&%$#_{}])", r"\\$1")


def _value(text: str, at: int) -> tuple[str, int]:
    """A field's value from a place on, in braces, quotes or bare, and the place after it."""
    if text[at : at + 1] == "{":
        depth, end = 1, at + 1
        while end < len(text) and depth:
            depth += (text[end] == "{") - (text[end] == "}") if text[end - 1] != "\\" else 0
            end += 1
        return text[at + 1 : end - 1], end
    if text[at : at + 1] == '"':
        depth, end = 0, at + 1
        while end < len(text) and (text[end] != '"' or depth):
            depth += (text[end] == "{") - (text[end] == "}")
            end += 1
        return text[at + 1 : end], end + 1
    m = re.compile(r"[^,}\n]*").match(text, at)
    return m[0].strip(), m.end()


_ENTRY = re.compile(r"@(\w+)\s*\{\s*([^,\s}]+)\s*,")
_FIELD = re.compile(r"\s*,?\s*([A-Za-z][\w-]*)\s*=\s*")


def entries(text: str) -> Iterator[dict]:
    """Entries with a title; comments, strings and preambles are passed over. An editor stands in for a missing author."""
    at = 0
    while (m := _ENTRY.search(text, at)) is not None:
        at = m.end()
        fields: dict[str, str] = {}
        while (f := _FIELD.match(text, at)) is not None:
            value, at = _value(text, f.end())
            fields.setdefault(f[1].lower(), to_unicode(value) if f[1].lower() != "file" else value)
        if m[1].lower() not in ("comment", "string", "preamble") and fields.get("title"):
            year = re.search(r"\d{4}", fields.get("year") or fields.get("date") or "")
            yield {"id": m[2], "type": m[1].lower()} | {k: fields.get(k) for k in FIELDS} | {"author": fields.get("author") or fields.get("editor"), "year": year[0] if year else None}


SCHEMA = "path string, id string, type string, " + ", ".join(f"{f} string" for f in FIELDS)


def _parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    found = ({"path": path} | e for frame in frames for path, text in zip(frame["path"], frame["text"]) for e in entries(text or ""))
    # a frame costs far more than an entry, and files may hold one entry or many
    while rows := list(itertools.islice(found, ROWS)):
        yield pd.DataFrame(rows, columns=columns)


def parse_bibtex(files: DataFrame) -> DataFrame:
    """One row per entry of (path, text) rows. A file is parsed by one task, files side by side."""
    return files.select("path", "text").mapInPandas(_parse, SCHEMA)


def read_bibtex(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bib").option("recursiveFileLookup", True).load(path)
    return parse_bibtex(files.select("path", F.decode("content", "UTF-8").alias("text")))


def as_bibtex(df: DataFrame) -> DataFrame:
    """(value): each row as an entry, fields that are null or empty left out; write with ``.write.text``."""
    fields = [F.when(F.col(c) != "", F.concat(F.lit(f"  {c} = {{"), to_latex(F.col(c)), F.lit("}"))) for c in df.columns if c in FIELDS]
    return df.select(F.concat(F.lit("@"), F.col("type"), F.lit("{"), F.col("id"), F.lit(",\n"), F.concat_ws(",\n", *fields), F.lit("\n}\n")).alias("value"))
