"""Languages of documents as mixtures, by expectation-maximisation over letter n-grams.

A language is a distribution over hashed letter trigrams (lower case, anything but letters as a space),
counted over all learnable documents. A document is a mixture of languages: expectation-maximisation
estimates their proportions from the trigrams' likelihoods. Sets of languages of all sizes are compared by
log likelihood less ``PENALTY`` times the logarithm of the number of trigrams for each further language, and
the best set's proportions are the result. The sets of two and more are nested: those of the greatest
proportions in the mixture of all languages; other sets of that size are not compared.

Defined results: a text that is null or has no letter is ``und`` with score 0 and no proportions; ties
between languages go to the first in alphabetical order; without any learnable document every row is
``und``; null languages are not learned; repeated rows are predicted alike; null keys are kept; a very long
text is predicted whole, on its own; an empty table gives no rows; columns that aren't named are ignored.
A language costs 256 KB on the driver and in each task, so a table with over MOST_LANGUAGES different ones
is refused with an error rather than cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.storage import slices, tidy

BITS, BLOCK, SMOOTHING, ROUNDS, PENALTY = 15, 4096, 0.5, 25, 12.0
MOST_LANGUAGES = 512
_A, _B, _C = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)


@dataclass
class Model:
    languages: list[str]
    log_likelihood: np.ndarray  # places x languages


_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Lower-cased code points, 32 for all that aren't letters."""
    if not _LETTERS:
        _LETTERS.append(np.array([ord(c.lower()[0]) if (c := chr(i)).isalpha() else 32 for i in range(0x110000)], np.uint32))
    return _LETTERS[0]


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the text, place) of each trigram with a letter in the middle, and whether each text has a letter."""
    parts = [(t or "").encode("utf-32-le", "surrogatepass") for t in texts]
    joined = np.frombuffer(b"\x20\0\0\0".join([b"", *parts, b""]), np.uint32)
    points = _letters()[joined]
    sizes = np.array([len(x) // 4 + 1 for x in parts], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)  # a text's characters and the space after it
    middle = points[1 : 1 + len(owner)]
    is_letter = middle != 32
    h = points[: len(owner)] * _A ^ middle * _B
    h[: len(owner) - 1] ^= points[2 : 1 + len(owner)] * _C
    h[len(owner) - 1 :] ^= np.array([32], np.uint32) * _C
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    own = owner[is_letter]
    return own, (h[is_letter] >> np.uint32(32 - BITS)).astype(np.int64), np.bincount(own, minlength=len(texts)) > 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for part in slices(batches, 1):
        names = np.array(part.column(0).to_pylist(), object)
        owner, place, _ = trigrams(part.column(1).to_pylist())
        for name in set(names.tolist()):
            counts = np.bincount(place[(names == name)[owner]], minlength=1 << BITS)
            sums[name] = sums[name] + counts if name in sums else counts
    for name, x in sums.items():
        n = len(x) // BLOCK
        yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(range(n), pa.int32()), pa.array([x[k * BLOCK : (k + 1) * BLOCK].astype(np.uint32).tobytes() for k in range(n)])], names=["lang", "block", "counts"])


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[str, int], np.ndarray] = {}
    for b in batches:
        for lang, block, counts in zip(*(c.to_pylist() for c in b.columns)):
            x = np.frombuffer(counts, np.uint32).astype(np.int64)
            sums[lang, block] = sums[lang, block] + x if (lang, block) in sums else x
    if sums:
        keys = list(sums)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.int32()), pa.array([sums[k].tobytes() for k in keys])], names=["lang", "block", "counts"])


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Count trigrams by language over all rows with a language. What reaches the driver is 256 KB a language."""
    schema = "lang string, block int, counts binary"
    rows = docs.filter(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    if len(rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect()) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} different languages")
    partial = rows.mapInArrow(tidy(_count), schema)
    found = partial.repartition("lang", "block").mapInArrow(tidy(_sum), schema).collect()
    languages = sorted({r["lang"] for r in found})
    counts = np.zeros((1 << BITS, len(languages)))
    for r in found:
        counts[r["block"] * BLOCK : (r["block"] + 1) * BLOCK, languages.index(r["lang"])] = np.frombuffer(r["counts"], np.int64)
    if not languages:
        return Model([], counts)
    return Model(languages, np.log((counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * (1 << BITS))))


def _mixture(like: np.ndarray, count: np.ndarray, starts: np.ndarray, owner: np.ndarray, total: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Proportions of each text over its allowed languages; ``like`` has a row for each distinct trigram of each text."""
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(ROUNDS):
        r = like * share[owner]
        r *= (count / np.maximum(r.sum(axis=1), 1e-300))[:, None]
        share = np.add.reduceat(r, starts, axis=0) / total[:, None]
    return share


def proportions(texts: list[str | None], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (texts x languages) of the chosen sets, and which texts have a letter."""
    n = len(model.languages)
    own, place, lettered = trigrams(texts)
    out = np.zeros((len(texts), n))
    keys, count = np.unique(own << BITS | place, return_counts=True)
    if not len(keys) or not n:
        return out, lettered & bool(n)
    which, owner = np.unique(keys >> BITS, return_inverse=True)
    starts = np.flatnonzero(np.diff(owner, prepend=-1))
    logs = model.log_likelihood[keys & (1 << BITS) - 1]
    peak = logs.max(axis=1)
    like = np.exp(logs - peak[:, None])
    total = np.add.reduceat(count, starts).astype(float)
    alone = np.add.reduceat(logs * count[:, None], starts, axis=0)
    best = np.zeros((len(which), n))
    best[np.arange(len(which)), alone.argmax(axis=1)] = 1
    value = alone.max(axis=1)
    if n > 1:
        base = np.add.reduceat(peak * count, starts)
        full = _mixture(like, count, starts, owner, total, np.ones((len(which), n)))
        order = np.argsort(-full, axis=1, kind="stable")
        price = PENALTY * np.log(total + 1)

        # only texts that the mixture of all explains better than one language by the price of one more go on
        fitted = base + np.add.reduceat(np.log(np.maximum((like * full[owner]).sum(axis=1), 1e-300)) * count, starts)
        open_ = fitted - price > value
        for size in range(2, n + 1):
            if not open_.any():
                break
            allowed = np.zeros((len(which), n))
            np.put_along_axis(allowed, order[:, :size], 1, axis=1)
            k = np.flatnonzero(open_)
            rows = np.flatnonzero(open_[owner])
            sub_owner = (np.cumsum(open_) - 1)[owner[rows]]
            sub_starts = np.flatnonzero(np.diff(sub_owner, prepend=-1))
            share = _mixture(like[rows], count[rows], sub_starts, sub_owner, total[k], allowed[k])
            got = base[k] + np.add.reduceat(np.log(np.maximum((like[rows] * share[sub_owner]).sum(axis=1), 1e-300)) * count[rows], sub_starts) - price[k] * (size - 1)
            better = got > value[k]
            best[k[better]], value[k[better]] = share[better], got[better]
    out[which] = best
    return out, lettered


def _predict(model: Model):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, "und"], object)
        # a slice has a row of likelihoods for each distinct trigram of each text
        most_bytes = min(1 << 20, (4 << 20) // max(1, len(model.languages)))
        for part in slices(batches, 1, most_bytes):
            share, lettered = proportions(part.column(1).to_pylist(), model)
            top = np.where(lettered, share.argmax(axis=1), len(model.languages)) if model.languages else np.zeros(part.num_rows, int)
            score = np.where(lettered, share.max(axis=1), 0.0) if model.languages else np.zeros(part.num_rows)
            mixed = [[{"lang": model.languages[j], "share": float(row[j])} for j in np.argsort(-row, kind="stable").tolist() if row[j] > 0] for row in share]
            kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names[top].tolist(), pa.string()), pa.array(np.clip(score, 0.0, 1.0)), pa.array(mixed, kind)], names=[part.schema.names[0], "lang_pred", "score", "mixture"])

    return predict


def languages(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score (its proportion) and mixture (language, proportion) of every row."""
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(key, F.col(text).cast("string").alias("text")).mapInArrow(tidy(lambda x: _predict(shared.value)(x)), f"{key} {kind}, lang_pred string, score double, mixture array<struct<lang:string,share:double>>")
