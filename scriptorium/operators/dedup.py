"""Duplicates of chunks and documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import text as ft


def content_hash(text: Column) -> Column:
    return F.md5(ft.content_form(text))


def exact_groups(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, hash, first, copies): the least key with the same content, and how many have it. Counts are combined before the shuffle."""
    hashed = df.select(key, content_hash(ft.present(text)).alias("hash"))
    groups = hashed.groupBy("hash").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("copies"))
    return hashed.join(groups, "hash")


def without_exact_copies(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The row with the least key of each content."""
    return df.join(exact_groups(df, key, text).filter(F.col(key) == F.col("first")).select(key), key, "left_semi")


def word_set(text: Column) -> Column:
    """Distinct words over two characters of the content form."""
    return F.array_distinct(F.filter(F.split(ft.content_form(text), r"\s+"), lambda w: F.length(w) > 2))


def neighbour_pairs(chunks: DataFrame, group: str = "doc_id", order: str = "chunk_index", ahead: int = 4, least: float = 0.0) -> DataFrame:
    """(group, a, b, similarity) of chunks at most ``ahead`` apart: an equi join on the place looked at, no range join."""
    sets = chunks.select(group, order, word_set(ft.present("content")).alias("w"))
    left = sets.select(group, F.col(order).alias("a"), F.col("w").alias("wa"), F.explode(F.sequence(F.col(order) + 1, F.col(order) + ahead)).alias("b"))
    right = sets.select(group, F.col(order).alias("b"), F.col("w").alias("wb"))
    pairs = left.join(right, [group, "b"]).select(group, "a", "b", F.round(ft.jaccard(F.col("wa"), F.col("wb")), 6).alias("similarity"))
    return pairs.filter(F.col("similarity") >= least)


def _kept(words: pa.Array, ahead: int, least: float) -> pa.Array:
    """For each list of word sets, which of them no kept one of the ``ahead`` before it resembles. Words are coded, and all sets compared with those a step on at once."""
    found = []
    for u in range(0, len(words), 256):
        part = words.slice(u, 256)
        sets = part.flatten()
        each, sizes = (pc.list_value_length(x).to_numpy(zero_copy_only=False) for x in (part, sets))
        coded = sets.flatten().dictionary_encode("encode")
        width, n = max(1, len(coded.dictionary)), len(sets)
        of_set = np.repeat(np.arange(n), sizes)
        group = np.repeat(np.arange(len(part)), each)
        held = np.sort(of_set * width + coded.indices.to_numpy(zero_copy_only=False))
        alike: list[tuple[int, int]] = []
        for step in range(1, min(ahead, n - 1) + 1):
            asked = held[: np.searchsorted(held, (n - step) * width)] + step * width
            at = np.minimum(np.searchsorted(held, asked), len(held) - 1)
            both = np.bincount(asked[held[at] == asked] // width - step, minlength=n)[: n - step] if len(asked) else np.zeros(n - step, np.int64)
            union = sizes[:-step] + sizes[step:] - both
            near = np.flatnonzero((group[:-step] == group[step:]) & (union > 0) & (both / np.maximum(union, 1) >= least))
            alike += zip(near.tolist(), (near + step).tolist())
        kept = np.ones(n, bool)
        for a, b in sorted(alike):  # all that can remove a come before it
            if kept[a]:
                kept[b] = False
        found.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(each)]), pa.int32()), pa.array(kept)))
    return pa.concat_arrays(found) if found else pa.array([], pa.list_(pa.bool_()))


def lists_without_near_copies(lists: DataFrame, chunks: str = "chunks", content: str = "content", ahead: int = 4, least: float = 0.85) -> DataFrame:
    """Arrays of chunks in their order without those that a kept one of the four before resembles: a fold within the row. A removed chunk removes no other."""

    @F.arrow_udf("array<boolean>")
    def kept(words: pa.Array) -> pa.Array:
        return _kept(words, ahead, least)

    sets = F.transform(F.when(F.size(chunks) > 1, F.col(chunks)).otherwise(F.slice(chunks, 1, 0)), lambda c: word_set(ft.present(c[content])))
    marked = lists.select("*", kept(sets).alias("_kept"))
    return marked.withColumn(chunks, F.filter(chunks, lambda c, i: F.coalesce(F.get("_kept", i), F.lit(True)))).drop("_kept")


def without_near_copies(chunks: DataFrame, group: str = "doc_id", order: str = "chunk_index", ahead: int = 4, least: float = 0.85) -> DataFrame:
    """The same for chunks as rows, brought together by their group."""
    rows = chunks.select(group, F.struct(*chunks.columns).alias("c"))
    by_order = lambda a, b: F.when(a[order] < b[order], -1).when(a[order] > b[order], 1).otherwise(0)
    lists = rows.groupBy(group).agg(F.array_sort(F.collect_list("c"), by_order).alias("chunks"))
    kept = lists_without_near_copies(lists, ahead=ahead, least=least)
    return kept.select(F.explode_outer("chunks").alias("c")).filter("c is not null").select("c.*")


def across_documents(chunks: DataFrame, group: str = "doc_id") -> DataFrame:
    """(hash, documents, chunks) of contents that several documents have."""
    hashed = chunks.select(group, content_hash(ft.present("content")).alias("hash"))
    return hashed.groupBy("hash").agg(F.count_distinct(group).alias("documents"), F.count(F.lit(1)).alias("chunks")).filter("documents > 1")
