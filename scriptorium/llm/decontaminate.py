"""Benchmark decontamination by a prefix-filtered set join.

An item's windows of ten words are sets of placed shingles (five words each; a window of fewer words is
one shingle). Documents are read once: of their shingles those that may be one of the benchmark's (a Bloom
filter of bounded size tells) are written down with their place and the words around them. Shingles are
ordered by rarity in the documents. As a window occurs only with all its shingles, its prefix is the rarest
one: documents and windows are joined on prefix shingles alone, each match fixes where the window would
begin, windows that would begin before the first or end after the last word are dropped (positional and
length bounds), and the words of the rest are compared.

The joins and counts are Spark's, so neither side needs to fit anywhere; the filter saves shuffling only.
Popular shingles are dealt over ``SALTS`` places. No text crosses the network but the words around shingles
of the benchmark.

Defined results: a null or wordless text has no words and no hits; items that are null or wordless
have no windows; a null item_id is written as the empty string; items of one id count once; repeated rows,
and rows of one key or of null keys, stay apart; a very long text is worked on whole, on its own; an empty
table of documents gives no rows, an empty benchmark no hits; columns that aren't named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.storage import slices, staged, tidy
from scriptorium.llm.text import mix, word_hashes, words_of

WINDOW, SHINGLE, SALTS = 10, 5, 8
#: Bits of the filter: 16 for each shingle of the benchmark, within these powers of two.
LEAST_BITS, MOST_BITS, BITS_EACH = 16, 28, 16
_TURNS = [np.uint64(2 * x + 1) for x in np.random.default_rng(31).integers(1, 1 << 62, 64).tolist()]


def shingles(words: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of so many words that lie within one text, and the places of their first words.

    ``words`` are the word hashes of all texts, ``at`` where each text's words begin, with the end.
    """
    n = max(0, len(words) - size + 1)
    h = np.full(n, np.uint64(size))
    for k in range(size):
        h += words[k : k + n] * _TURNS[k]
    ends = np.repeat(at[1:], np.diff(at))[:n]
    first = np.flatnonzero(np.arange(n) + size <= ends)
    return mix(h[first]), first


def _windows(window: int, shingle: int):
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            rows = []
            for item, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                words, (hashes, at) = words_of(text), word_hashes([text])
                n = min(window, len(words))
                if not n:
                    continue
                size = min(shingle, n)
                h = shingles(hashes, at, size)[0].astype(np.int64).tolist()
                rows += [(item, b" ".join(words[i : i + n]).decode(), n, h[i : i + n - size + 1]) for i in range(len(words) - n + 1)]
            columns = list(zip(*rows)) or [()] * 4
            types = (pa.string(), pa.string(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["item", "words", "n", "shingles"])

    return windows


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of the filter for each hash."""
    mask = np.uint64((1 << bits) - 1)
    return (hashes & mask).astype(np.int64), (hashes >> np.uint64(32) & mask).astype(np.int64)


BLOCK = 15  # the filter is put together in blocks of this power of two of bits


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for block, place in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if block not in held:
                held[block] = np.zeros(1 << BLOCK - 3, np.uint8)
            held[block][place >> 3 & (1 << BLOCK - 3) - 1] |= 1 << (place & 7)
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["block", "held"])


def _filter(known: DataFrame, most_bits: int) -> tuple[np.ndarray, int]:
    """A Bloom filter of a column of shingles: 32 MB at most reach the driver and the tasks."""
    n = known.count()
    bits = min(most_bits, max(LEAST_BITS, (BITS_EACH * n).bit_length()))
    place = F.explode(F.array(F.col("shingle").bitwiseAND((1 << bits) - 1), F.shiftrightunsigned("shingle", 32).bitwiseAND((1 << bits) - 1)))
    placed = known.select(place.alias("place")).select(F.shiftright("place", BLOCK).alias("block"), "place")
    partitions = int(known.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = np.zeros(1 << bits - 3, np.uint8)
    for r in placed.repartition(partitions, "block").mapInArrow(tidy(_blocks), "block long, held binary").collect():
        out[r["block"] << BLOCK - 3 : (r["block"] + 1) << BLOCK - 3] = np.frombuffer(r["held"], np.uint8)
    return out, bits


def _probe(held: np.ndarray, bits: int, sizes: list[int], window: int):
    """For each document its words' number and the shingles that the filter holds, with the words from ``before`` words earlier on."""
    kind = pa.list_(pa.struct([("shingle", pa.int64()), ("pos", pa.int32()), ("before", pa.int32()), ("context", pa.string())]))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2):
            texts = part.column(2).to_pylist()
            words, at = word_hashes(texts)
            found: dict[int, list[tuple[int, int]]] = {}
            for size in sizes:
                h, first = shingles(words, at, size)
                a, b = _places(h, bits)
                k = np.flatnonzero((held[a >> 3] >> (a & 7).astype(np.uint8) & 1) & (held[b >> 3] >> (b & 7).astype(np.uint8) & 1))
                for x, p, i in zip(h[k].astype(np.int64).tolist(), first[k].tolist(), (np.searchsorted(at, first[k], "right") - 1).tolist()):
                    found.setdefault(i, []).append((x, p - int(at[i])))
            hits = []
            for i in range(len(texts)):
                own = words_of(texts[i]) if i in found else []
                hits.append([{"shingle": x, "pos": p, "before": (n := min(p, window)), "context": b" ".join(own[p - n : p + window]).decode()} for x, p in found.get(i, ())])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(at), pa.int64()), pa.array(hits, kind)], names=["row", "key", "n_words", "hits"])

    return probe


def _met(many: DataFrame, few: DataFrame, salt: str) -> DataFrame:
    """An inner join on shingle whose popular values are dealt over SALTS places by a column of the larger side."""
    dealt = many.withColumn("salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int"))
    return dealt.join(few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["shingle", "salt"]).drop("salt")


SPANS = "array<struct<first:bigint,last:bigint>>"
#: Sorted (first, last) spans as maximal ones.
JOINED = f"""
    aggregate(array_sort(raw), cast(array() as {SPANS}), (m, s) ->
        if(size(m) > 0 and element_at(m, -1).last >= s.first,
           concat(slice(m, 1, size(m) - 1), array(named_struct('first', element_at(m, -1).first, 'last', greatest(element_at(m, -1).last, s.last)))),
           concat(m, array(s))))
"""


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, most_bits: int = MOST_BITS) -> DataFrame:
    """One row per document: key, n_words, spans (first word, word after the last) that are hit, items with occurring windows."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(item_text).cast("string").alias("text")).distinct()
    spread = items.mapInArrow(tidy(_windows(window, shingle)), "item string, words string, n int, shingles array<bigint>")
    windows = staged(spread.groupBy("words").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles"), F.collect_set("item").alias("items")).withColumn("window", F.monotonically_increasing_id()))
    sizes = sorted(r["size"] for r in windows.select(F.least("n", F.lit(shingle)).alias("size")).distinct().collect())  # at most as many as a shingle has words
    held, bits = _filter(windows.select(F.explode("shingles").alias("shingle")).distinct(), most_bits)
    shared = spark.sparkContext.broadcast(held)

    # one pass over the documents
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    hit = "array<struct<shingle:bigint,pos:int,before:int,context:string>>"
    probed = staged(rows.mapInArrow(tidy(lambda x: _probe(shared.value, bits, sizes, window)(x)), f"row long, key {kind}, n_words long, hits {hit}"))
    hits = probed.select("row", "n_words", F.explode("hits").alias("h")).select("row", "n_words", "h.*")

    # each window's rarest shingle; a window with a shingle that no document has can't occur
    counts = hits.groupBy("shingle").agg(F.count(F.lit(1)).alias("rarity"))
    placed = windows.select("window", F.size("shingles").alias("size"), F.posexplode("shingles").alias("place", "shingle"))
    rarest = _met(placed, counts, "window").groupBy("window", "size").agg(F.min(F.struct("rarity", "shingle", "place")).alias("p"), F.count(F.lit(1)).alias("there"))
    prefixes = rarest.filter("there = size").select("window", "p.shingle", "p.place").join(windows.select("window", "words", "n", "items"), "window")

    # candidates by prefix, bounds, then word by word
    candidates = _met(hits, prefixes, "row").withColumn("first", F.col("pos") - F.col("place")).filter("first >= 0 and first + n <= n_words")
    same = candidates.filter("array_join(slice(split(context, ' '), before - place + 1, n), ' ') = words")
    span = F.struct(F.col("first").cast("long").alias("first"), (F.col("first") + F.col("n")).cast("long").alias("last"))
    found = same.groupBy("row").agg(F.collect_list(span).alias("raw"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")).select("row", F.expr(JOINED).alias("spans"), "items")
    joined = probed.select("row", "key", "n_words").join(found, "row", "left")
    return joined.select(F.col("key").alias(key), "n_words", F.coalesce("spans", F.expr(f"cast(array() as {SPANS})")).alias("spans"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))
