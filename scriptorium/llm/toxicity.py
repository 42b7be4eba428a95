"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, word pairs and pairs with one word between, hashed to 2 ** 22 places.
Each place has its own learning rate, and the L1 term leaves most weights at exactly zero, so the model is
a short list of (place, weight) with a size bound of 2 ** 22 entries, fit to be broadcast.

Training reads a sample of at most ``most_rows`` labelled documents (by hash of the key, so it is the same
on every run), in shards that are fitted side by side and averaged; scoring reads every whole text. A very
long text is read whole as any other, on its own: a task holds the features of one slice of about a
megabyte, or of one text, and while fitting those of its shard's documents.

Defined results: a null or wordless text has no feature and gets the score of the intercept; null labels
and keys are not learned from; of several labels of one document the larger counts, and of several texts
the least is learned from; repeated rows are scored alike; without any labelled document, or with labels of one kind only, the score is the share of
label 1, 0 if there is none; an empty table gives no rows; columns that aren't named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.storage import slices, tidy
from scriptorium.llm.text import mix, word_hashes

BITS, MOST_ROWS, SHARD_ROWS, EPOCHS = 22, 24_000, 6_000, 10
ALPHA, BETA, L1, L2 = 1.0, 1.0, 10.0, 0.0
_PAIR, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass
class Model:
    places: np.ndarray
    weights: np.ndarray
    intercept: float
    constant: float | None = None


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(number of the text, place) of each feature occurrence."""
    words, at = word_hashes(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    shift = np.uint64(64 - BITS)
    pair = owner[:-1] == owner[1:]
    skip = owner[:-2] == owner[2:]
    places = np.concatenate([words >> shift, (mix(words[:-1] * _PAIR + words[1:]) >> shift)[pair], (mix(words[:-2] * _SKIP + words[2:] + _PAIR) >> shift)[skip]])
    return np.concatenate([owner, owner[:-1][pair], owner[:-2][skip]]), places.astype(np.int64)


def fit_rows(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """FTRL-proximal over rows of (distinct places, label), in the order given; places and weights that aren't zero, and the intercept."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb = nb = bias = 0.0
    for _ in range(epochs):
        for places, label in rows:
            zi, ni = z[places], n[places]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) > L1, -(zi - np.sign(zi) * L1) / ((BETA + root) / ALPHA + L2), 0.0)
            bias = -zb / ((BETA + nb**0.5) / ALPHA)
            g = 1 / (1 + np.exp(-min(max(w.sum() + bias, -30.0), 30.0))) - label
            z[places] = zi + g - (np.sqrt(ni + g * g) - root) / ALPHA * w
            n[places] = ni + g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / ALPHA * bias
            nb += g * g
    some = np.flatnonzero(np.abs(z) > L1)
    zs = z[some]
    return some, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(n[some])) / ALPHA + L2), -zb / ((BETA + nb**0.5) / ALPHA)


def _fit_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[np.ndarray, int]] = []
    for part in slices(batches, 1):
        owner, places = features(part.column(1).to_pylist())
        keys = np.unique(owner << BITS | places)
        at = np.searchsorted(keys >> BITS, np.arange(part.num_rows + 1))
        rows += [((keys[u:v] & (1 << BITS) - 1).astype(np.int32), y) for u, v, y in zip(at[:-1], at[1:], part.column(2).to_pylist())]
    if rows:
        places, weights, intercept = fit_rows(rows)
        yield pa.RecordBatch.from_arrays([pa.array([places.astype(np.int32).tobytes()]), pa.array([weights.astype(np.float32).tobytes()]), pa.array([intercept]), pa.array([len(rows)], pa.int64())], names=["places", "weights", "intercept", "rows"])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most_rows: int = MOST_ROWS, shard_rows: int = SHARD_ROWS) -> Model:
    """Learn from at most ``most_rows`` labelled documents; a shard has about ``shard_rows``, so there are most_rows / shard_rows models to average at most."""
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(F.col(label).cast("int")).alias("label"))
    chosen = known.orderBy(F.xxhash64("key"), "key").limit(most_rows).collect()  # at most most_rows pairs of numbers
    n, ones = len(chosen), sum(r["label"] for r in chosen)
    none = np.empty(0, np.int64)
    if not 0 < ones < n:
        return Model(none, none.astype(float), 0.0, ones / n if n else 0.0)
    spark = docs.sparkSession
    small = F.broadcast(spark.createDataFrame(chosen, known.schema))  # most_rows at most
    shards = max(1, round(n / shard_rows))
    texts = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = texts.join(small, "key").groupBy("key", "label").agg(F.min("text").alias("text")).select("key", "text", "label")
    dealt = rows.repartition(shards, F.pmod(F.xxhash64("key", F.lit(3)), F.lit(shards))).sortWithinPartitions(F.xxhash64("key"), "key", "text")
    fitted = dealt.mapInArrow(tidy(_fit_shard), "places binary, weights binary, intercept double, rows long").collect()
    total = sum(r["rows"] for r in fitted)
    if not total:
        return Model(none, none.astype(float), 0.0, ones / n)
    dense = np.zeros(1 << BITS)
    for r in fitted:
        dense[np.frombuffer(r["places"], np.int32)] += np.frombuffer(r["weights"], np.float32) * (r["rows"] / total)
    places = np.flatnonzero(dense)
    return Model(places, dense[places], sum(r["intercept"] * r["rows"] for r in fitted) / total)


def _slice_scores(model: Model, texts: list[str | None], dense: np.ndarray) -> np.ndarray:
    if model.constant is not None:
        return np.full(len(texts), model.constant)
    owner, places = features(texts)
    some = np.flatnonzero(dense[places])
    keys = np.unique(owner[some] << BITS | places[some])
    sums = np.bincount(keys >> BITS, dense[keys & (1 << BITS) - 1].astype(float), len(texts)) + model.intercept
    return 1 / (1 + np.exp(-np.clip(sums, -30, 30)))


def _score(model: Model, text: int, kept: list[int], names: list[str]):
    """The kept columns of each batch and the scores of a text column."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(1 << BITS, np.float32)
        dense[model.places] = model.weights
        for b in batches:
            found = [_slice_scores(model, part.column(text).to_pylist(), dense) for part in slices(iter([b]), text)]
            if found:
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), pa.array(np.concatenate(found))], names=names)

    return score


def scores(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score of every row."""
    schema = T.StructType([docs.schema[key], T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(key, F.col(text).cast("string").alias("text")).mapInArrow(tidy(lambda x: _score(shared.value, 1, [0], [key, "score"])(x)), schema)


def with_scores(docs: DataFrame, model: Model, text: str = "text", to: str = "score") -> DataFrame:
    """All rows and columns with a score each; a column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [i for i, f in enumerate(docs.schema) if f.name != to]
    schema = T.StructType([*(docs.schema[i] for i in kept), T.StructField(to, T.DoubleType())])
    at, names = docs.columns.index(text), schema.names
    strings = docs.withColumn(text, F.col(text).cast("string"))
    order = docs.columns if to in docs.columns else names
    return strings.mapInArrow(tidy(lambda x: _score(shared.value, at, kept, names)(x)), schema).select(*(f"`{c}`" for c in order))
