"""Document quality by attention-based multiple-instance learning over passages.

A document is a bag of passages of 64 words. A passage becomes logarithmic counts of hashed byte trigrams
and of trigrams of character classes, of unit length, plus the share of its word trigrams that its document has
had before, and a learned layer encodes it as a short vector. Gated attention weighs the passages,

    weight = softmax(w . (tanh(V h) * sigmoid(U h))),

and the weighted sum of the encodings is scored. Only documents have labels; encoder, gates and scorer are
learned from them together, by Adam.

Training reads a sample of at most ``most_rows`` labelled documents with texts of at most ``most_bytes`` (by
hash of the key, the same on every run), in shards; in each round all shards start from the shared weights and
their results are averaged. Scoring reads every whole text: passages are encoded in blocks, and a document's
softmax is carried on from block to block, so memory is bounded by a slice of texts or by one text.

Defined results: a null, empty or blank text is one passage without words (null and empty alike); null labels and keys are not learned
from; of several labels of one document the larger counts, of several texts the least; repeated rows are
scored alike, to six digits; without labels, or with labels of one kind only, the score is the share of label 1, and 0.5
if there is none; an empty table gives no rows; columns that aren't named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.storage import slices, staged, tidy

WORDS, RAW_PLACES, CLASS_PLACES, ENCODED, GATES = 64, 768, 256, 32, 16
MOST_ROWS, MOST_BYTES, SHARD_ROWS = 8_000, 1 << 20, 2_000
ROUNDS, STEPS, BATCH, RATE, DECAY = 4, 160, 16, 4e-3, 1e-4
PLACES = RAW_PLACES + CLASS_PLACES + 1
BLOCK = 2048

#: Byte classes: white space, line end, lower, upper, digit, beyond ASCII, and each other byte by itself.
_CLASS = np.arange(256, dtype=np.uint32) + 8
_CLASS[[9, 13, 32]], _CLASS[10], _CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4, 5, 6
_SHAPES = (("encoder", (PLACES, ENCODED)), ("base", (ENCODED,)), ("v", (ENCODED, GATES)), ("u", (ENCODED, GATES)), ("w", (GATES,)), ("out", (ENCODED,)), ("bias", ()))
_SPLITS = np.cumsum([int(np.prod(s)) for _, s in _SHAPES])


@dataclass
class Model:
    weights: np.ndarray
    constant: float | None = None


def _named(flat: np.ndarray) -> dict[str, np.ndarray]:
    return {n: x.reshape(s) for (n, s), x in zip(_SHAPES, np.split(flat, _SPLITS[:-1]))}


def initial(seed: int = 11) -> np.ndarray:
    rng = np.random.default_rng(seed)
    made = [rng.normal(0, 1 / np.sqrt(s[0]) if n != "encoder" else 0.3, s) if len(s) == 2 or n == "w" else np.zeros(s) for n, s in _SHAPES]
    made[5] = rng.normal(0, 0.3, _SHAPES[5][1])
    return np.concatenate([x.ravel() for x in made]).astype(np.float32)


def _hashed(x: np.ndarray, places: int) -> np.ndarray:
    """A place for the three values from each position on."""
    h = x[:-2] * np.uint32(0x9E3779B1) + x[1:-1] * np.uint32(0x85EBCA77) + x[2:] * np.uint32(0xC2B2AE3D)
    return ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(8)) % np.uint32(places)


def passages(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the text, features) of blocks of passages, in order."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n\n\n".join(raw) + b"\n\n\n  ", np.uint8)
    ends = np.cumsum([len(r) + 3 for r in raw])
    begins = ends - [len(r) + 3 for r in raw]
    outside = np.concatenate([ends - 2, ends - 1])  # from here, three bytes reach into the next text
    inside = data > 32
    first = np.flatnonzero(np.diff(inside, prepend=False) & inside)  # where words begin
    last = np.flatnonzero(np.diff(inside, append=False) & inside)
    owner = np.searchsorted(ends, first, "right")
    of_text = np.searchsorted(first, begins)
    ordinal = np.arange(len(first)) - of_text[owner]
    seen = _seen(data, first, last, owner)
    head = ordinal % WORDS == 0
    starts = first[head]
    starts[ordinal[head] == 0] = begins[owner[head][ordinal[head] == 0]]
    blank = np.setdiff1d(np.arange(len(raw)), owner)
    starts = np.sort(np.append(starts, begins[blank]))  # no two begin alike
    texts_of = np.searchsorted(ends, starts, "right")
    stops = np.append(starts[1:], len(data) - 2)
    words_at = np.searchsorted(first, np.append(starts, len(data)))
    sums = np.append(0, np.cumsum(seen))
    fresh = (sums[words_at[1:]] - sums[words_at[:-1]]) / np.maximum(1, np.diff(words_at))
    for i in range(0, len(starts), BLOCK):
        j = min(i + BLOCK, len(starts))
        part = data[starts[i] : stops[j - 1] + 2]
        row = np.repeat(np.arange(j - i), stops[i:j] - starts[i:j])
        beyond = outside[(outside >= starts[i]) & (outside < stops[j - 1])] - starts[i]
        x = np.empty((j - i, PLACES), np.float32)
        for places, u, values in ((RAW_PLACES, 0, part.astype(np.uint32)), (CLASS_PLACES, RAW_PLACES, _CLASS[part])):
            at = _hashed(values, places)
            at[beyond] = 0
            found = np.bincount(row * places + at, minlength=(j - i) * places)
            x[:, u : u + places] = np.log1p(found.reshape(j - i, places).astype(np.float32))
        x[:, :-1] /= np.maximum(1e-6, np.sqrt((x[:, :-1] ** 2).sum(1, keepdims=True)))
        x[:, -1] = fresh[i:j]
        yield texts_of[i:j], x


def _seen(data: np.ndarray, first: np.ndarray, last: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each word whether the three words from it on were in its text before."""
    if len(first) < 3:
        return np.zeros(len(first), bool)
    # sums of bytes by place from the right end: equal words, equal sums; multiplication wraps around
    power = np.multiply.accumulate(np.full(len(data), 0x9E3779B97F4A7C15, np.uint64))
    total = np.append(np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, dtype=np.uint64))
    back = np.multiply.accumulate(np.full(len(data), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64)), np.uint64))
    words = (total[last + 1] - total[first]) * back[first] * np.uint64(0xBF58476D1CE4E5B9)
    words ^= words >> np.uint64(31)
    three = words[:-2] * np.uint64(3) + words[1:-1] * np.uint64(0x94D049BB133111EB) + words[2:] * np.uint64(0xD6E8FEB86659FD93)
    key = (three ^ owner[:-2].astype(np.uint64) * np.uint64(0xA0761D6478BD642F)) * np.uint64(0xE7037ED1A0B428DB)
    again = np.ones(len(key), bool)
    again[np.unique(key, return_index=True)[1]] = False
    again &= owner[:-2] == owner[2:]
    return np.append(again, [False, False])


def _encode(p: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, ...]:
    h = np.tanh(x @ p["encoder"] + p["base"])
    t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
    return h, t, g, (t * g) @ p["w"]


def bag_logits(flat: np.ndarray, texts: list[str | None]) -> np.ndarray:
    """The score before the logistic function, of each text; passages are read block by block."""
    p, n = _named(flat), len(texts)
    top, norm, sums = np.full(n, -np.inf), np.zeros(n), np.zeros((n, ENCODED))
    for owner, x in passages(texts):
        h, _, _, s = _encode(p, x)
        before = top.copy()
        np.maximum.at(top, owner, s)
        keep = np.where(np.isfinite(before), np.exp(before - np.where(np.isfinite(top), top, 0)), 0.0)
        weight = np.exp(s - top[owner])
        norm = norm * keep + np.bincount(owner, weight, n)
        sums *= keep[:, None]
        np.add.at(sums, owner, h * weight[:, None])
    return sums / np.maximum(norm, 1e-30)[:, None] @ p["out"] + p["bias"]


def gradient(flat: np.ndarray, owner: np.ndarray, x: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Of the mean logistic loss of whole bags; owner counts them from 0, in order."""
    p, n = _named(flat), len(labels)
    h, t, g, s = _encode(p, x)
    at = np.searchsorted(owner, np.arange(n))
    e = np.exp(s - np.maximum.reduceat(s, at)[owner])
    a = e / np.add.reduceat(e, at)[owner]
    z = np.add.reduceat(h * a[:, None], at)
    d = (1 / (1 + np.exp(-(z @ p["out"] + p["bias"]))) - labels) / n
    dz = d[:, None] * p["out"]
    da = (dz[owner] * h).sum(1)
    ds = a * (da - np.add.reduceat(a * da, at)[owner])
    dgate = ds[:, None] * p["w"]
    dt, dg = dgate * g * (1 - t * t), dgate * t * g * (1 - g)
    dh = (a[:, None] * dz[owner] + dt @ p["v"].T + dg @ p["u"].T) * (1 - h * h)
    parts = [x.T @ dh, dh.sum(0), h.T @ dt, h.T @ dg, (t * g).T @ ds, z.T @ d, d.sum()]
    return np.concatenate([np.ravel(y) for y in parts]).astype(np.float32)


def fit_bags(flat: np.ndarray, bags: list[np.ndarray], labels: np.ndarray, steps: int, seed: int) -> np.ndarray:
    """So many steps of Adam, or one pass over the bags if that is more, from given weights."""
    rng, w = np.random.default_rng(seed), flat.astype(np.float32)
    m, v, k = np.zeros_like(w), np.zeros_like(w), 0
    while True:
        order = rng.permutation(len(bags))
        for i in range(0, len(order), BATCH):
            part = order[i : i + BATCH]
            owner = np.repeat(np.arange(len(part)), [len(bags[b]) for b in part])
            g = gradient(w, owner, np.concatenate([bags[b] for b in part]).astype(np.float32), labels[part])
            k += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w * np.float32(1 - RATE * DECAY) - np.float32(RATE) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        if k >= steps:
            return w


def _fit_shard(shared, steps: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags: list[np.ndarray] = []
        labels: list[int] = []
        for part in slices(batches, 1):
            found: list[list[np.ndarray]] = [[] for _ in range(part.num_rows)]
            for owner, x in passages(part.column(1).to_pylist()):
                for k in np.unique(owner).tolist():
                    found[k].append(x[owner == k].astype(np.float16))
            bags += [np.concatenate(f) for f in found]
            labels += part.column(2).to_pylist()
        if bags:
            w = fit_bags(shared.value, bags, np.array(labels, np.float32), steps, seed)
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()]), pa.array([len(bags)], pa.int64())], names=["weights", "rows"])

    return run


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES, shard_rows: int = SHARD_ROWS, rounds: int = ROUNDS) -> Model:
    """Learn from at most ``most_rows`` labelled documents of at most ``most_bytes`` each; there are most_rows / shard_rows shards at most."""
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(F.col(label).cast("int")).alias("label"))
    chosen = known.orderBy(F.xxhash64("key"), "key").limit(most_rows).collect()  # at most most_rows pairs of numbers
    n, ones = len(chosen), sum(r["label"] for r in chosen)
    if not 0 < ones < n:
        return Model(initial(), ones / n if n else 0.5)
    spark = docs.sparkSession
    small = F.broadcast(spark.createDataFrame(chosen, known.schema))  # most_rows at most
    texts = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).filter(F.octet_length("text") <= most_bytes)
    rows = staged(texts.join(small, "key").groupBy("key", "label").agg(F.min("text").alias("text")).select("key", "text", "label"))
    shards = max(1, round(n / shard_rows))
    dealt = rows.repartition(shards, F.pmod(F.xxhash64("key", F.lit(3)), F.lit(shards))).sortWithinPartitions(F.xxhash64("key"), "key", "text")
    weights = initial()
    odds = np.log(ones / (n - ones))
    weights[-1] = odds
    for k in range(rounds):
        shared = spark.sparkContext.broadcast(weights)
        fitted = dealt.mapInArrow(tidy(_fit_shard(shared, STEPS, k)), "weights binary, rows long").collect()
        shared.unpersist()
        total = sum(r["rows"] for r in fitted)
        if not total:
            return Model(weights, ones / n)
        weights = sum(np.frombuffer(r["weights"], np.float32) * (r["rows"] / total) for r in fitted).astype(np.float32)
    return Model(weights)


def text_scores(model: Model, texts: list[str | None]) -> np.ndarray:
    if model.constant is not None:
        return np.full(len(texts), model.constant)
    return np.round(1 / (1 + np.exp(-np.clip(bag_logits(model.weights, texts), -30, 30))), 6)


def scores(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score of every row."""
    schema = T.StructType([docs.schema[key], T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(text_scores(shared.value, part.column(1).to_pylist()))], names=schema.names)

    return docs.select(key, F.col(text).cast("string").alias("text")).mapInArrow(tidy(run), schema)
