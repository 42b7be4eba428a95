"""From a question to a context: expanded queries, parsed rankings, context compression, evaluation differences."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as ft

# Terms of a query and what they are also called.
TERMS = {
    "taxonomie de bloom": ["bloom's taxonomy", "bloom taxonomy", "blooms taxonomy"],
    "zone proximale développement": ["zone of proximal development", "zpd", "vygotsky"],
    "apprentissage significatif": ["meaningful learning", "significant learning"],
    "constructivisme": ["constructivism", "constructivist"],
    "socioconstructivisme": ["social constructivism", "socioconstructivism"],
    "métacognition": ["metacognition", "metacognitive"],
    "pédagogie active": ["active learning", "active pedagogy"],
}


def expanded(queries: DataFrame, terms: dict[str, list[str]] | None = None, key: str = "query_id", text: str = "text") -> DataFrame:
    """(key, variant, text): the query as variant 0, then one with each other name in place of each term it holds."""
    known = [(t, o) for t, others in (TERMS | (terms or {})).items() for o in others]
    lowered = F.lower(text)
    variants = [F.when(lowered.contains(t), F.regexp_replace(F.col(text), F.lit("(?iu)" + re.escape(t)), F.lit(o.replace("\\", r"\\").replace("$", r"\$")))) for t, o in known]
    return queries.select(key, F.posexplode(F.array_compact(F.array(F.col(text), *variants))).alias("variant", "text"))


def ranking(text: Column, count: Column) -> Column:
    """The numbers from 1 to count that a reply names, once each, in its order."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"\d{1,9}"), 0), lambda x: x.cast("int"))
    return F.array_distinct(F.filter(numbers, lambda x: (x >= 1) & (x <= count)))


def reranked(hits: DataFrame, rankings: DataFrame, by: str = "query_id", rank: str = "rank") -> DataFrame:
    """Adds reranked and score (n - place) / n by a reply's ranking of the ranks; what it doesn't name follows in the old order."""
    from pyspark.sql import Window

    sizes = hits.groupBy(by).agg(F.count(F.lit(1)).cast("int").alias("_n"))
    named = rankings.join(sizes, by).select(by, "_n", ranking(F.col("text"), F.col("_n")).alias("_order"))
    placed = hits.join(named, by, "left").withColumn("_at", F.array_position(F.coalesce("_order", F.array().cast("array<int>")), F.col(rank).cast("int")))
    new = F.row_number().over(Window.partitionBy(by).orderBy((F.col("_at") == 0), "_at", rank))
    out = placed.withColumn("reranked", new)
    return out.withColumn("score", F.round((F.col("_n") - F.col("reranked") + 1) / F.col("_n"), 6)).drop("_n", "_order", "_at")


def selected(text: Column, count: Column) -> Column:
    """'all', or numbers and ranges as in 1-3,5, within 1 to count, sorted and once each."""
    parts = F.regexp_extract_all(F.regexp_replace(text, r"\s", ""), F.lit(r"\d{1,9}-\d{1,9}|\d{1,9}"), 0)

    def numbers(part: Column) -> Column:
        first = F.regexp_extract(part, r"^(\d+)", 1).cast("int")
        last = F.least(F.when(part.contains("-"), F.regexp_extract(part, r"-(\d+)$", 1).cast("int")).otherwise(first), count)
        return F.when((first >= 1) & (first <= last), F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    chosen = F.array_sort(F.array_distinct(F.flatten(F.transform(parts, numbers))))
    return F.when(F.lower(F.trim(text)) == "all", F.when(count >= 1, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))).otherwise(chosen)


def metric_differences(before: DataFrame, after: DataFrame, by: str = "k") -> DataFrame:
    """(k, metric differences after - before) of two evaluations."""
    metrics = [c for c in before.columns if c != by and c in after.columns]
    a, b = before.select(by, *[F.col(m).alias(f"_{m}") for m in metrics]), after.select(by, *metrics)
    return a.join(b, by).select(by, *[F.round(F.col(m) - F.col(f"_{m}"), 6).alias(m) for m in metrics])


# --- compression: a query's hits are a few dozen chunks, so one query is one group -----------------


def _alike(a: set[str], b: set[str]) -> float:
    return len(a & b) / len(a | b)


def _deduplicated(rows: list[dict], most: float) -> list[dict]:
    kept: list[tuple[object, set[str], dict]] = []
    for r in rows:
        words = set(r["content"].lower().split())
        if not any(d == r["document"] and (words or w) and _alike(words, w) > most for d, w, _ in kept):
            kept.append((r["document"], words, r))
    return [r for *_, r in kept]


def _shortened(row: dict, query: str, keywords: list[str], least: float) -> dict:
    """Sentences of at least so much relevance, two of them at any rate, in their order; gaps are marked."""
    if row["structured"]:
        return row
    scored = []
    for i, s in enumerate(row["sentences"]):
        low = s.lower()
        score = sum(k.lower() in low for k in keywords) + 2.0 * (query.lower() in low) + max(0.0, 0.3 - 0.05 * i)
        scored.append(score * (0.5 if len(s) < 50 else 1.0))
    kept = [i for i, x in enumerate(scored) if x >= least]
    if len(kept) < 2:
        kept = sorted(sorted(range(len(scored)), key=lambda i: -scored[i])[:2])
    if not kept:
        return row
    parts, last = [], -1
    for i in kept:
        parts += (["[…]"] if i > last + 1 else []) + [row["sentences"][i]]
        last = i
    parts += ["[…]"] if last < len(scored) - 1 else []
    return row | {"content": " ".join(parts)}


def _compressed(most: int):
    def compressed(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.sort_values("place").to_dict("records")
        query, keywords = rows[0]["query"], list(rows[0]["keywords"])
        size = lambda: sum(len(r["content"]) for r in rows)
        total, strategy = size(), "none-small"
        if total > 35_000:
            strategy = "aggressive-full"
            rows = [_shortened(r, query, keywords, 0.4) for r in _deduplicated(rows, 0.80)]
            if (now := size()) > most:
                places = max(3, math.ceil(len(rows) * most / now))
                rows = sorted(rows, key=lambda r: (-r["similarity"], r["place"]))[:places]
        elif total > 25_000:
            strategy = "medium-dedup-extraction"
            rows = _deduplicated(rows, 0.85)
            if size() > most:
                rows = [_shortened(r, query, keywords, 0.3) for r in rows]
        elif total > 10_000:
            strategy = "light-deduplication"
            rows = _deduplicated(rows, 0.88)
        return pd.DataFrame([(r["query_id"], r["id"], i, r["content"], strategy) for i, r in enumerate(rows)], columns=["query_id", "id", "place", "content", "strategy"])

    return compressed


def compressed(hits: DataFrame, most: int = 20_000) -> DataFrame:
    """(query_id, id, place, content, strategy) of hits (query_id, query, id, document, place, content, similarity) cut to about so many characters.

    Up to 10,000 characters all stay; up to 25,000 near copies within a document go; up to 35,000 sentences
    that bear little on the query go too; beyond that the most similar chunks are kept last.
    """
    texts = ft.present("content")
    ready = hits.select("query_id", ft.present("query").alias("query"), "id", "document", "place", texts.alias("content"), "similarity", ft.query_keywords(ft.present("query")).alias("keywords"), ft.sentences(texts).alias("sentences"), ft.has_structured_block(texts).alias("structured"))
    kinds = {c: hits.schema[c].dataType.simpleString() for c in ("query_id", "id")}
    return ready.groupBy("query_id").applyInPandas(_compressed(most), f"query_id {kinds['query_id']}, id {kinds['id']}, place long, content string, strategy string")
