"""N-gram Jaccard join by chosen paths.

A document is the set of its five-word shingles; documents of equal sets form one set with a count, so
copies never meet each other. Each set carries minimum hashes, that is, sampled tokens. A run sends each
set down a path: it is split off by a sampled token, and buckets that are still large are split again by
further tokens, sampled anew at each path (with one more branch for every fourth path, 1 / 0.8 branches
on average). Buckets that are small, or that three splits leave large, are compared by brute force on the
minimum hashes, the latter block against block. Runs are repeated until the recall aimed at: a similar
pair stays together on a path of d splits with probability similarity ** d, so ``runs_for`` gives their
number. What the buckets join are candidate groups; in them all pairs of sets are compared exactly on
their whole shingle sets, in blocks, and only counts and a spanning forest leave a task, never all pairs.

Defined results: one row per input row. A text of one to four words has one shingle, its words; a null
or wordless text has none, links to nothing and is its own class. class_id is the least key linked to
it directly or over others, n_links the number of other rows with similarity of at least 0.8, copies
included; repeated rows count as copies. A null key takes part in links but is never a class_id unless
all keys of the class are null. A very long text is read whole, on its own, and its set is compared like any
other. An empty table gives no rows; columns that aren't named are ignored.

A candidate group of M different sets costs M * M / 2 comparisons, in blocks of 512 that share nothing: where
all are near copies of each other, as counts of links want them all; in a chain of documents of which only
neighbours are alike, more than need be.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.graph import components
from scriptorium.llm.storage import slices, staged, tidy
from scriptorium.llm.text import mix, word_hashes

SHINGLE, SIMILARITY, RECALL = 5, 0.8, 1 - 1e-7
COORDINATES, SMALL, MOST_SPLITS, BLOCK = 128, 256, 3, 512
#: Below the similarity by five standard deviations of an estimate from 128 minimum hashes.
ESTIMATE = 0.62

_SEEDS = np.random.default_rng(19).integers(0, 1 << 32, COORDINATES, dtype=np.uint32)
_TURNS = [np.uint64(2 * x + 1) for x in np.random.default_rng(23).integers(1, 1 << 62, 64).tolist()]


def runs_for(recall: float = RECALL, similarity: float = SIMILARITY, splits: int = 3) -> int:
    """Runs after which a pair with this similarity is missed by all, each of so many splits, with probability 1 - recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**splits))


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    words, at = word_hashes(texts)
    n = max(0, len(words) - size + 1)
    grams = np.zeros(n, np.uint64)
    for k in range(size):
        grams += words[k : k + n] * _TURNS[k]
    grams = mix(grams)
    out = []
    for u, v in zip(at[:-1].tolist(), at[1:].tolist()):
        if v - u >= size:
            out.append(np.unique(grams[u : v - size + 1]))
        elif v > u:
            out.append(mix(np.array([np.sum(words[u:v] * np.array(_TURNS[: v - u]), dtype=np.uint64) + np.uint64(v - u)], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def minimum_hashes(shingles: np.ndarray) -> np.ndarray:
    """The least hash of a set under each of the coordinates' hash functions."""
    least = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(low), 4096):
        x = low[i : i + 4096, None] ^ _SEEDS
        x *= np.uint32(0x7FEB352D)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x846CA68B)
        x ^= x >> np.uint32(16)
        least = np.minimum(least, x.min(axis=0))
    return least


def _sketch(size: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2):
            sets = shingle_sets(part.column(2).to_pylist(), size)
            ids = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(ids, pa.binary()), pa.array([minimum_hashes(s).tobytes() if len(s) else None for s in sets], pa.binary())],
                names=["key", "text_hash", "members", "hashes"],
            )

    return sketch


def _split(paths: DataFrame, sets: DataFrame, level: int) -> DataFrame:
    """Send the sets of large buckets on by a token sampled at their path; every fourth path samples two."""
    branch = F.expr("explode(if(pmod(path, 4) = 0, array(0, 1), array(0)))")
    place = F.pmod(F.xxhash64("path", "branch", F.lit(level)), F.lit(COORDINATES)).cast("int")
    token = F.expr("substring(hashes, 4 * place + 1, 4)")
    return paths.join(sets.select("set", "hashes"), "set").withColumn("branch", branch).withColumn("place", place).select(F.xxhash64("path", "branch", token).alias("path"), "set")


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Runs of rows with equal leading columns; rows must be sorted by them."""
    held, current = [], None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(b.num_rows, bool)
        change[0] = True
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change).tolist()
        for u, v in zip(starts, [*starts[1:], b.num_rows]):
            key = tuple(c[u] for c in cols)
            if key != current:
                if held:
                    yield current, held
                held, current = [], key
            held.append(b.slice(u, v - u))
    if held:
        yield current, held


def _labels(similar: np.ndarray) -> np.ndarray:
    """The least member of each row's connected component of a symmetric boolean matrix."""
    n = len(similar)
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(similar, label, n).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = [], []
    for (_, i, j), parts in _grouped(batches, 3):
        ids = np.concatenate([p.column(4).to_numpy() for p in parts])
        if len(ids) < 2:
            continue
        rows = np.frombuffer(b"".join(x for p in parts for x in p.column(5).to_pylist()), np.uint32).reshape(len(ids), COORDINATES)
        if len(ids) == 2:
            if np.count_nonzero(rows[0] == rows[1]) >= ESTIMATE * COORDINATES:
                a.append(ids[0]), b.append(ids[1])
        else:
            similar = np.empty((len(ids), len(ids)), bool)
            for k in range(len(ids)):
                similar[k] = np.count_nonzero(rows == rows[k], axis=1) >= ESTIMATE * COORDINATES
            label = _labels(similar)
            k = np.flatnonzero(label != np.arange(len(ids)))
            a += ids[label[k]].tolist()
            b += ids[k].tolist()
        if len(a) >= 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            a, b = [], []
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def in_blocks(rows: DataFrame, group: str, member: str, most: int) -> DataFrame:
    """Add (i, j, own): groups over ``most`` rows are dealt into blocks, and each row goes to every pair of blocks with its own."""
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / most).cast("int")
    own = F.pmod(F.xxhash64(member, F.lit(7)), blocks).cast("int")
    dealt = rows.join(sizes, group).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("n", "other")


def _refetch(size: int):
    def refetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 4):
            sets = shingle_sets(part.column(4).to_pylist(), size)
            same = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() == m for s, m in zip(sets, part.column(3).to_pylist())]
            k = pa.array(np.flatnonzero(same))
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(k) for c in range(3)), pa.array([s.tobytes() for s, ok in zip(sets, same) if ok], pa.binary())], names=["label", "set", "n", "shingles"])

    return refetch


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of all pairwise intersections."""
    n = len(sets)
    if n == 2:
        x = np.concatenate(sets)
        x.sort()
        both = np.count_nonzero(x[1:] == x[:-1])
        return np.array([[len(sets[0]), both], [both, len(sets[1])]], np.int64)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    tokens, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(counts > 1) - 1
    shared = counts[inverse] > 1
    owner, column = owner[shared], number[inverse[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out, width = np.zeros((n, n), np.int64), 4096
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        u, v = np.searchsorted(column, [first, first + width])
        m = np.zeros((n, width), np.float32)
        m[owner[u:v], column[u:v] - first] = 1
        out += (m @ m.T).astype(np.int64)
    return out


def _verify(similarity: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int]] = []
        for (_, i, j), parts in _grouped(batches, 3):
            own, ids, counts = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in (3, 4, 5))
            sets = [np.frombuffer(x, np.uint64) for p in parts for x in p.column(6).to_pylist()]
            ids, once = np.unique(ids, return_index=True)  # a repeated row fetches its set again
            own, counts, sets = own[once], counts[once], [sets[k] for k in once]
            if len(ids) > 1:
                both, sizes = intersections(sets), np.array([len(s) for s in sets], np.int64)
                similar = both >= similarity * (sizes[:, None] + sizes[None, :] - both) - 1e-9
                np.fill_diagonal(similar, False)
                if i != j:
                    similar &= own[:, None] != own[None, :]
                label = _labels(similar)
                out += zip(ids.tolist(), ids[label].tolist(), (similar @ counts.astype(np.int64)).tolist())
            if len(out) >= 50_000:
                yield _links(out)
                out = []
        yield _links(out)

    return verify


def _links(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["set", "label", "links"])


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, similarity: float = SIMILARITY, runs: int | None = None) -> DataFrame:
    """One row per row: key, text_hash (xxhash64 of the text), class (a number, null for wordless texts), class_id, n_links."""
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = runs_for(similarity=similarity) if runs is None else runs
    docs = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    hashed = docs.select("key", F.xxhash64("text").alias("text_hash"), "text")
    rows = staged(hashed.mapInArrow(tidy(_sketch(size)), f"key {kind}, text_hash long, members binary, hashes binary"))
    # held: the least text hash of the least key, null after the others
    held = F.min(F.struct(F.col("key").isNull().alias("missing"), "key", "text_hash"))["text_hash"]
    sets = staged(
        rows.filter("members is not null").groupBy("members").agg(F.min("key").alias("first"), held.alias("held"), F.count(F.lit(1)).alias("n"), F.first("hashes").alias("hashes")).withColumn("set", F.monotonically_increasing_id())
    )

    # runs: down the paths
    starts = F.transform(F.sequence(F.lit(0), F.lit(runs - 1)), lambda r: F.xxhash64(r, F.expr("hashes").substr(4 * (r % COORDINATES) + 1, F.lit(4))))
    paths, leaves = sets.select(F.explode(starts).alias("path"), "set"), None
    for level in range(1, MOST_SPLITS + 1):
        sizes = paths.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        sized = staged(paths.join(sizes, "path"))
        last = level == MOST_SPLITS
        small = (sized if last else sized.filter(f"n <= {SMALL}")).select("path", "set")
        leaves = small if leaves is None else leaves.unionByName(small)
        if last or sized.filter(f"n > {SMALL}").isEmpty():
            break
        paths = _split(sized.filter(f"n > {SMALL}").select("path", "set"), sets, level)

    # brute force in the buckets, on minimum hashes
    dealt = in_blocks(leaves, "path", "set", BLOCK).join(sets.select("set", "hashes"), "set")
    buckets = dealt.select("path", "i", "j", "own", "set", "hashes").repartition(partitions, "path", "i", "j").sortWithinPartitions("path", "i", "j", "set")
    grouped = components(buckets.mapInArrow(tidy(_candidates), "a long, b long"))

    # exact comparison in the candidate groups
    asked = grouped.join(sets.select(F.col("set").alias("node"), "first", "held", "n", "members"), "node")
    fetched = hashed.join(asked, F.col("key").eqNullSafe(F.col("first")) & (F.col("text_hash") == F.col("held"))).select("label", F.col("node").alias("set"), "n", "members", "text").mapInArrow(tidy(_refetch(size)), "label long, set long, n long, shingles binary")
    pairs = in_blocks(fetched.withColumnRenamed("n", "copies"), "label", "set", BLOCK).select("label", "i", "j", "own", "set", "copies", "shingles")
    links = staged(pairs.repartition(partitions, "label", "i", "j").sortWithinPartitions("label", "i", "j", "set").mapInArrow(tidy(_verify(similarity)), "set long, label long, links long"))
    classes = components(links.select(F.col("set").alias("a"), F.col("label").alias("b")))

    # classes and counts of the sets, then of the rows
    named = sets.join(classes.select(F.col("node").alias("set"), "label"), "set", "left").withColumn("label", F.coalesce("label", "set"))
    least = named.groupBy("label").agg(F.min("first").alias("class_id"))
    counted = links.groupBy("set").agg(F.sum("links").alias("links"))
    known = named.join(least, "label").join(counted, "set", "left").select(F.col("members").alias("same"), F.col("label").alias("class"), "class_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"))
    found = rows.select("key", "text_hash", "members").join(known, F.col("members") == F.col("same"), "left")
    return found.select(F.col("key").alias(key), "text_hash", "class", F.when(F.col("members").isNull(), F.col("key")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
