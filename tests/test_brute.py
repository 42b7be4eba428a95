"""Queries without SQL against plain loops over the same tables, and the recall of approximate search."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.operators import chunk, entities, notes
from scriptorium.plans.catalogue import QUERIES

SF = "/root/testdata/sf0.001"


def rows(spark, table):
    return spark.read.parquet(f"{SF}/{table}.parquet").collect()


def md5(x):
    import hashlib

    return hashlib.md5(x.encode()).hexdigest()


def sentences_of(text):
    guarded = re.sub(r"\b(M|Mme|Dr|Prof|etc|cf|vol|pp|ed|al|p)\.", "\\1\u0001", text)
    return [s for s in (x.replace("\u0001", ".").strip(" ") for x in re.split(r"(?<=[.!?;])\s+", guarded)) if len(s) > 10]


def test_summaries(spark):
    """At most 750 words of the best sentences, in order, and a better one that would have fitted is never left out."""
    got = {}
    for r in chunk.summaries(spark.read.parquet(f"{SF}/documents.parquet")).collect():
        got.setdefault(r.doc_id, []).append((r.pos, r.sentence, r.score))
    academic = set(chunk.ACADEMIC)
    for d in rows(spark, "documents"):
        sentences = sentences_of(d.text or "")
        split = [[w for w in re.split(r"[\W_]+", s.lower()) if w] for s in sentences]
        if any(re.search(r"[^\x00-\x7F]", s) for s in sentences):
            continue  # letters beyond ASCII split differently in this plain version
        tf = Counter(w for s in split for w in s)
        scored = []
        for i, (s, w) in enumerate(zip(sentences, split)):
            place = i / len(sentences)
            score = (sum(tf[x] for x in w) / len(w) if w else 0.0) + (1.0 if place < 0.1 or place >= 0.9 else 0.0) + 0.5 * len(set(w) & academic)
            score += (-1.0 if len(w) < 5 else -0.5 if len(w) > 40 else 0.0) + (0.3 if re.search(r"\d", s) else 0.0)
            scored.append((-round(score, 6), i, len(w)))
        used, taken = 0, []
        for _, i, n in sorted(scored):
            if used < 750 * 0.9 and used + n <= 750:
                used += n
                taken.append(i)
        assert [p for p, *_ in sorted(got.get(d.doc_id, []))] == sorted(taken), d.doc_id


def test_section_chunks(spark):
    text = "before any head\n\n# Introduction\n" + "\n\n".join(f"p{k} " + "word " * 90 for k in range(6)) + "\n\n## References\n[1] gone\n1. Results Of Work\nfound\n\nMETHODS\nmade"
    got = {(r.section, r.chunk_index): r for r in chunk.section_chunks(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), most=200, overlap=10).collect() if r.doc_id == 1}
    assert [(s, i, r.kind, r.title) for (s, i), r in sorted(got.items()) if i == 0] == [(0, 0, "content", None), (1, 0, "introduction", "Introduction"), (3, 0, "results", "Results Of Work"), (4, 0, "methodology", "METHODS")]
    words, held, want = text.split("# Introduction\n")[1].split("\n\n## References")[0], [], []
    for paragraph in [p.split() for p in words.split("\n\n")]:
        if held and len(held) + len(paragraph) > 200:
            want.append(" ".join(held))
            held = held[-10:]
        held += paragraph
    assert [r.content for (s, _), r in sorted(got.items()) if s == 1] == [*want, " ".join(held)]


def borders(vectors, window=3, gap=3):
    if len(vectors) < 2 * window:
        return []
    means = [np.sum(vectors[i : i + window], axis=0) for i in range(len(vectors) - window + 1)]
    cosine = lambda a, b: float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))
    similar = [round(cosine(a, b), 6) for a, b in zip(means, means[1:])]
    mean = sum(similar) / len(similar)
    out = []
    for i, s in enumerate(similar):
        if s < min(0.7, mean - 0.1):
            sure = min(1.0, (mean - s) / 0.3)
            if out and i + window - out[-1][0] < gap:
                if sure > out[-1][1]:
                    out[-1] = (i + window, sure)
            else:
                out.append((i + window, sure))
    return [p for p, _ in out]


def test_embedding_borders_and_their_chunks(spark):
    got, sequences = {}, {}
    for r in QUERIES["embedding_borders"](spark, SF).collect():
        got.setdefault(r.label, []).append(r.vec_id)
    for r in sorted(rows(spark, "embeddings"), key=lambda r: r.vec_id):
        sequences.setdefault(r.label, []).append(r)
    for label, x in sequences.items():
        assert sorted(got.get(label, [])) == [x[p].vec_id for p in borders([np.array(r.embedding, float) for r in x])], label
    texts = spark.createDataFrame([(1, k, f"sentence {k} " + "w " * (k * 7 % 40)) for k in range(120)], "g long, k long, text string").withColumn("text", F.trim("text"))
    marks = spark.createDataFrame([(1, k) for k in (3, 5, 60, 119)], "g long, k long")
    own, want = [(k, f"sentence {k} " + "w " * (k * 7 % 40)) for k in range(120)], []
    own = [(k, t.strip()) for k, t in own]
    ends = [0, 3, 5, 60, 119, 120]
    for i, (u, v) in enumerate(zip(ends, ends[1:])):
        part, n = own[u:v], sum(len(t.split()) for _, t in own[u:v])
        if n < 50 and i < len(ends) - 2:
            continue
        held, count = [], 0
        for k, t in part if n > 500 else []:
            if count + len(t.split()) > 400 and held:
                want.append((held[0][0], " ".join(x for _, x in held)))
                held = held[-1:]
                count = sum(len(x.split()) for _, x in held)
            held.append((k, t))
            count += len(t.split())
        held = held or part
        want.append((held[0][0], " ".join(x for _, x in held)))
    found = chunk.bordered_chunks(texts, marks, "g", "k").orderBy("chunk_index").collect()
    assert [(r.first, r.content) for r in found] == want
    assert QUERIES["bordered_chunks"](spark, SF).count() > 0


def pieces(text, most=2000, overlap=200, back=200):
    if len(text) <= most:
        return [text]
    out, pos = [], 0
    while pos < len(text):
        end = cut = min(pos + most, len(text))
        if end < len(text):
            look = text[max(pos, end - back) : end]
            best = max(look.rfind(m) for m in ("\n\n", ". ", "! ", "? "))
            if best > 0:
                cut = end - len(look) + best + 2
        if piece := text[pos:cut].strip():
            out.append(piece)
        if cut >= len(text):
            break
        pos = cut - overlap if cut - overlap > pos else cut
    return out


def test_chapter_chunks(spark):
    long = "A sentence of the chapter, number {}. "
    text = "Opening words.\n\n# Only a head\n# Part *one*\n" + "".join(long.format(k) for k in range(300)) + "\n## Short\nDone [here](there)."
    got = notes.chapter_chunks(spark.createDataFrame([("c", text), ("d", None)], "chapter string, text string"), overlap=100).orderBy("chunk_index").collect()
    sections = [(None, 1, "Opening words.\n\n"), ("Part *one*", 4, "Part one\n" + "".join(long.format(k) for k in range(300)) + "\n"), ("Short", 6, "Short\nDone here.")]
    assert {(r.title, r.line) for r in got} == {(t, n) for t, n, _ in sections}
    assert [r.content.strip() for r in got] == [p.strip() for _, _, prose in sections for p in pieces(prose.rstrip("\n") if len(prose) <= 2000 else prose.rstrip("\n"), overlap=100)]


def test_clean_ocr_text(spark):
    from scriptorium.functions import text as ft

    given = ["a  b\u0007c", "l e t t e r s joined", "bars |||||||| gone", "rule ------- gone", "12 34\nkept", "page\n\n\n\n\nend", "- 7 -\ntext", "Page 12\ntext"]
    df = spark.createDataFrame([(g,) for g in given], "t string").select(ft.drop_page_numbers(ft.clean_ocr(F.col("t"))).alias("x"))
    assert [r.x.strip() for r in df.collect()] == ["a bc", "letters joined", "bars gone", "rule gone", "kept", "page\n\nend", "text", "text"]


def test_entity_statistics(spark):
    mentions = [("Paris", "LOCATION", "a"), ("paris", "LOCATION", "a longer one"), ("Dr. Martin Blum", "PERSON", "x"), ("martin blum", "PERSON", ""), ("Le XIXe siècle", "DATE", "y"), ("12 mars 1910", "DATE", "z")]
    got = {(r.kind, r.normalized): (r.mentions, r.context) for r in entities.without_copies(spark.createDataFrame(mentions, "name string, kind string, context string")).collect()}
    assert got == {("LOCATION", "paris"): (2, "a longer one"), ("PERSON", "martin blum"): (2, "x"), ("DATE", "siecle-19"): (1, "y"), ("DATE", "1910-03-12"): (1, "z")}


@pytest.mark.parametrize("n", [2, 5])
def test_entropy_by_counts_in_the_row(spark, n):
    """Counts made within a row are those of a plain count."""
    from scriptorium.functions import text as ft

    words = [f"w{k % n}" for k in range(23)]
    r = ft.with_counts(spark.createDataFrame([(words,), ([],)], "w array<string>"), "w", "c").collect()
    assert {x["word"]: x["count"] for x in r[0].c} == Counter(words) and r[1].c == []
    assert math.isclose(sum(x["count"] for x in r[0].c), len(words))


def test_preprocessing_and_ingest(spark):
    """Recurring heads and page numbers go, and what is left is cut, rated and told once."""
    from scriptorium.operators import archive

    body = [" ".join(f"{name}{w} {w}mill{name} {w}{w}hall {w}tower{name} fell." for w in map(chr, range(97, 123))) for name in ("alpha", "beta", "gamma", "delta")]
    pages = [(1, k, f"The Running Head\n{body[k]}\n{k + 1}\nfoot of the book") for k in range(4)] + [(2, 0, "too short"), (3, 0, None)]
    df = spark.createDataFrame(pages, "doc_id long, page_number long, text string")
    clean = archive.preprocessed(df)
    got = {(r.doc_id, r.page_number): r for r in clean.collect()}
    assert [got[1, k].text for k in range(4)] == body
    assert all(got[1, k].heads_removed == 2 and got[1, k].numbers_removed for k in range(4)) and got[2, 0].text == "too short" and got[3, 0].text == ""
    sums = {r.doc_id: r for r in archive.preprocess_statistics(clean).collect()}
    assert (sums[1].heads_removed, sums[1].pages_unnumbered, sums[1].processed_length) == (8, 4, sum(map(len, body)))
    assert sums[1].characters_removed == sum(len(t) for d, _, t in pages if d == 1) - sums[1].processed_length
    found = archive.ingested(df).orderBy("chunk_index").collect()
    words = "\n\n".join(body).split()
    assert {r.doc_id for r in found} == {1} and [r.chunk_index for r in found] == list(range(len(found))) and all(0 < r.score <= 1 for r in found)
    assert found[0].content.split() == words[: len(found[0].content.split())] and found[-1].content.split() == words[-len(found[-1].content.split()) :]
    assert QUERIES["ingested_books"](spark, SF).count() >= 0 and QUERIES["preprocessed_pages"](spark, SF).count() > 0
