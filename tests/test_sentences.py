"""Sentence splitters and segments with lines, against loops over whole documents and odd texts."""

import hashlib
import re

import pytest

from scriptorium.functions import text as ft
from scriptorium.operators import notes
from scriptorium.plans.catalogue import QUERIES
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SPACES = "\t\n\x0b\x0c\r       　﻿" + "".join(map(chr, range(0x2000, 0x200B)))
S = f"[{SPACES}]"


def upper(c):
    return c.isupper() and c not in "ªº" and len(c) == 1


def cut_before(text, may):
    """Cuts white space after . ! ? and before a character that may begin a sentence."""
    out, at = [], 0
    for m in re.finditer(rf"(?<=[.!?]){S}+", text):
        if m.end() < len(text) and may(text[m.end()]):
            out.append(text[at : m.start()])
            at = m.end()
    return [x.strip(SPACES) for x in [*out, text[at:]]]


def historian(text):
    plain = "M|MM|Mme|Mlle|Dr|Pr|St|Ste|etc|cf|p|pp|vol|no|art|chap|fig|ibid|op|loc|trad|ms|mss|fol|t"
    held = re.sub(rf"(?:(?<![A-Za-z0-9_])(?:{plain})|(?<=[A-Za-z0-9_])éd)\.{S}+", lambda m: m[0].rstrip(SPACES) + "\0", text)
    return [x.replace("\0", " ").strip(SPACES) for x in cut_before(held, upper) if x.replace("\0", " ").strip(SPACES)]


def summary(text):
    return [x for x in cut_before(text, lambda c: "A" <= c <= "Z" or "À" <= c <= "Ü") if len(x.encode("utf-16-le")) > 40]


def segments(text):
    """Written as the rule is stated: marks with numbers, then line by line."""
    lasts, marked = {}, text
    for i, a in enumerate(notes.ABBREVIATIONS):
        def keep(m, i=i):
            lasts[i] = m[0]
            return f"__ABBR_{i}__"
        marked = re.sub(a.replace(".", r"\.", 1), keep, marked, flags=re.I | re.A)
    units = lambda x: len(x.encode("utf-16-le", "surrogatepass")) // 2
    lines, line, count, out = text.split("\n"), 0, 0, []
    for place, raw in enumerate(re.split(rf"[.!?]+{S}+", marked)):
        content = raw
        for i, last in lasts.items():
            content = content.replace(f"__ABBR_{i}__", last)
        content = content.strip(SPACES)
        if content:
            out.append((place, line, min(line + content.count("\n"), len(lines) - 1), content))
            count += units(raw)
            while line < len(lines) - 1 and count > units(lines[line]) + 1:
                count -= units(lines[line]) + 1
                line += 1
    return out


ODD = [
    None, "", " \n ", "One. Two! Three?", "M. Dupont est là. Il dort.\nOui.", "A film. THE FILM. Mr. X said no. Yes.\n\n\nEnd", "i.e. this; I.E! that. e.g. one.\nTwo lines\nhere. Next",
    "Voir p. 3, pp. 4-5, op. cit. et chap. 2. Épuisée. Été 🙂🙂🙂. 🙂 no\n🙂. A\n\nb. C", "x. Y　z. ﻿W. |SPLIT| A sentence that is long enough here. Ça va bien, merci beaucoup.", "line\n" * 300 + "end. " * 300, "Voir 2éd. Paris. L'éd. Paris.",
]


def frame(spark):
    return spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")


def test_splitters(spark):
    rows = frame(spark).select("doc_id", ft.historian_sentences(ft.present("text")), ft.summary_sentences(ft.present("text"))).collect()
    for k, h, s in rows:
        assert h == historian(ODD[k] or "")
        assert s == summary(re.sub(re.escape("|SPLIT|"), "", ODD[k] or "")) or "|SPLIT|" in (ODD[k] or "")


def test_segments_of_odd_texts(spark):
    got = {}
    for r in notes.sentence_segments(frame(spark)).orderBy("place").collect():
        got.setdefault(r.doc_id, []).append((r.place, r.first_line, r.last_line, r.content))
    for k, text in enumerate(ODD):
        assert got.get(k, []) == segments(text or ""), k


def test_repeated_rows_are_texts_of_their_own(spark):
    df = spark.createDataFrame([(1, "One.\nTwo. Three")] * 2 + [(None, "One. Two")], "doc_id long, text string")
    got = sorted((tuple(r) for r in notes.sentence_segments(df).collect()), key=repr)
    assert got == sorted([(1, *x) for x in segments("One.\nTwo. Three")] * 2 + [(None, *x) for x in segments("One. Two")], key=repr)
    assert notes.sentence_segments(df.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["sentence_segments", "split_sentences"])
def test_whole_documents(spark, name):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    got = sorted(tuple(r) for r in QUERIES[name](spark, SF).collect())
    if name == "sentence_segments":
        want = [(k, p, a, b, md5(c)) for k, t in texts.items() for p, a, b, c in segments(t)]
    else:
        want = [(k, len(historian(t)), md5("\n\n".join(historian(t))), len(summary(t)), md5("\n\n".join(summary(t)))) for k, t in texts.items()]
    assert got == sorted(want)
