"""Alignment of two tokenizers' ids over the same bytes, with an identity map as the fast path.

Tokenizer A is a byte-level BPE of the tokenizers library, B a sentencepiece model. Byte offsets at which
tokens of both end cut a text into groups. ``Aligner.identity`` holds, for each id of A, an id of B with the
same bytes (or -1). A group of one id each that this array joins is counted in a vector of A's vocabulary
length; only the id pairs of the other, irregular groups are shuffled as pairs.

Tokenizers run on units, not on texts. A unit begins before a space or line end that follows another
character; there A's splitter always parts and no piece of B reaches across, so ids and groups of a text
are those of its units in order. Marks after letters are units of their own where no piece of B holds that pair of
characters. A worker remembers units, ``MOST_UNITS`` at most. Models for which this doesn't hold get whole
texts as units.

``aligned`` writes one table with the rows of documents (groups, ids and pairs with counts) and those of
tasks (sums). Corpus-wide counts of pairs come from the latter. ``link_counts`` reads documents with the
identity vector and the ``HOT_PAIRS`` most frequent pairs broadcast (two arrays of a fixed length), and joins
what is left, so the join has no frequent key.

Defined results: null and empty texts, and texts whose ids' bytes differ from space and text, have no
tokens: zeros and an empty digest. Rows are told apart by their place, so repeated rows and null keys each
get their own result; ties for the highest count of a B id are all highest; an empty table gives no rows;
columns that aren't named are ignored. A very long text is a slice of its own.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.storage import slices, staged, tidy
from scriptorium.llm.tokens import BYTE_SIGNS

MOST_UNITS, HOT_PAIRS, PAIRS_A_ROW = 500_000, 1 << 18, 1 << 16
#: A pair of ids is one number, B's id in the lower bits.
B_BITS = 24
UNIT = re.compile(r"\s*\S+(?:[^\S \n]\s*\S+)*(?:[^\S \n]\s*)?|\s+")
#: A unit of letters, and marks after them.
MARKED = re.compile(r"(\s?[^\W\d_]+)([.,;:!?)%&*$#|]+)")


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each range, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter(itertools.chain.from_iterable(lists), np.int64), np.array([len(x) for x in lists], np.int64)


class _Lists:
    """A growing array of lists of numbers."""

    def __init__(self) -> None:
        self.values, self.n = np.empty(1 << 12, np.int64), 0
        self.at = np.zeros(1 << 10, np.int64)
        self.rows = 0

    def extend(self, values: np.ndarray, sizes: np.ndarray) -> None:
        while self.n + len(values) > len(self.values):
            self.values = np.concatenate([self.values, np.empty_like(self.values)])
        while self.rows + len(sizes) >= len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.values[self.n : self.n + len(values)] = values
        self.at[self.rows + 1 : self.rows + 1 + len(sizes)] = self.n + np.cumsum(sizes)
        self.n, self.rows = self.n + len(values), self.rows + len(sizes)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of the rows, and how many each has."""
        starts = self.at[rows]
        sizes = self.at[rows + 1] - starts
        return self.values[_spread(starts, sizes)], sizes


class Aligner:
    """Two tokenizers and the units seen."""

    def __init__(self, a_path: str | None = None, b_path: str | None = None, most_units: int = MOST_UNITS) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        if a_path is None or b_path is None:
            import public_tokenizers

            a_path, b_path = a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")
        self.a, self.b = Tokenizer.from_file(str(a_path)), SentencePieceProcessor(model_file=str(b_path))
        self.a.encode_special_tokens = True
        signs = {chr(BYTE_SIGNS.get(x, x)): x for x in range(256)}
        names = {i: s for s, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [bytes(signs[c] for c in names[i]) if i in names and all(c in signs for c in names[i]) else b"" for i in range(max(names) + 1)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in range(self.b.get_piece_size()) for p in [self.b.id_to_piece(i)]]
        self.a_size, self.b_size = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        own = {x: i for i, x in reversed(list(enumerate(self.b_bytes))) if not (self.b.is_control(i) or self.b.is_unknown(i) or self.b.is_byte(i))}
        own = {self.b_bytes[i]: i for i in range(len(self.b_bytes)) if self.b.is_byte(i)} | own
        self.identity = np.array([own.get(x, -1) if x else -1 for x in self.a_bytes], np.int64)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size()) if not self.b.is_byte(i)]
        #: Neighbouring characters within pieces of B: between others nothing is merged.
        self.pairs = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        file = json.loads(self.a.to_str())
        splitter = file.get("pre_tokenizer") or {}
        self.parts = (
            file.get("normalizer") is None and splitter.get("type") == "ByteLevel" and splitter.get("use_regex") and not splitter.get("add_prefix_space")
            and not any("\n" in p for p in pieces) and not any(x[1] == "▁" and not x[0].isspace() and x[0] != "▁" for x in self.pairs)
            and self.b.encode("\n") == [self.b.piece_to_id("▁"), self.b.piece_to_id("<0x0A>")]
        )
        #: Each id as digits with what may follow it.
        self.digits = [f"{i}{mark}".encode() for ids, marks in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")) for mark in marks for i in range(ids)]
        self.most = most_units
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.first, self.second = np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64)
        self.strings: list[bytes] = []
        self.counts, self.ids, self.odd = _Lists(), _Lists(), _Lists()
        self.broken: set[int] = set()

    def codes(self, units: list[str]) -> np.ndarray:
        """The number of each unit; new ones are tokenized and aligned."""
        got = list(map(self.known.get, units))
        if None in got:
            new = list({u for u, g in zip(units, got) if g is None})
            parts = {u: m.groups() for u in new if (m := MARKED.fullmatch(u)) and m[1][-1] + m[2][0] not in self.pairs} if self.parts else {}
            atoms = [u for u in {x for p in parts.values() for x in p}.union(u for u in new if u not in parts) if u not in self.known]
            base = len(self.known)
            self._add(atoms)
            both = list(parts)
            n = len(self.known)
            self.known |= dict(zip(both, range(n, n + len(both))))
            while len(self.known) > len(self.first):
                self.first, self.second = np.concatenate([self.first, self.first]), np.concatenate([self.second, self.second])
            # place in the lists of the unit, or of both of its parts
            self.first[base:n], self.second[base:n] = np.arange(len(self.strings) - len(atoms), len(self.strings)), -1
            for k, side in enumerate((self.first, self.second)):
                side[n : n + len(both)] = self.first[np.array([self.known[parts[u][k]] for u in both], np.int64)] if both else 0
            got = [self.known[u] if g is None else g for u, g in zip(units, got)]
        return np.array(got, np.int64)

    def tokenize(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ids by A and by B of all units, and how many of each every unit has.

        Units that don't begin with a space, to which B adds one, are given to B after a line end, with which nothing is merged.
        """
        spaced = [u[:1] == " " and len(u) > 1 for u in units]
        a = [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)]
        b = [x if s else x[2:] for x, s in zip(self.b.encode([u[1:] if s else "\n" + u for u, s in zip(units, spaced)], num_threads=1), spaced)]
        return *_flat(a), *_flat(b)

    def _joined(self, units: list[str], sizes: np.ndarray) -> tuple[np.ndarray, ...] | None:
        """The same for units from a space to another character: one text, cut where units end. None if bytes differ."""
        text, ends, out = "".join(units), np.cumsum(sizes), []
        whole = text.encode("utf-8", "surrogatepass")
        for ids, size, known in ((self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.a_size, self.a_bytes), (self.b.encode(text[1:]), self.b_size, self.b_bytes)):
            if b"".join([known[i] for i in ids]) != whole:
                return None
            flat = np.array(ids, np.int64)
            at = np.cumsum(size[flat])
            stops = np.searchsorted(at, ends)
            if (at[stops] != ends).any():
                return None
            out += [flat, np.diff(stops, prepend=-1)]
        return tuple(out)

    def _add(self, units: list[str]) -> None:
        """Take up new units; those that can be read as one text come first."""
        if not units:
            return
        plain = [u for u in units if u[0] == " " and len(u) > 1 and not u[-1].isspace()] if self.parts else []
        some = set(plain)
        rest = [u for u in units if u not in some]
        n = len(self.known)
        self.known |= dict(zip(plain + rest, range(n, n + len(units))))
        for i in range(0, len(plain), 4096):
            part = plain[i : i + 4096]
            sizes = np.array([len(u) if u.isascii() else len(u.encode("utf-8", "surrogatepass")) for u in part], np.int64)
            if (found := self._joined(part, sizes)) is not None:
                self._align(*found)
            else:
                self._add_checked(part)
        self._add_checked(rest)

    def _add_checked(self, units: list[str]) -> None:
        if not units:
            return
        ia, na, ib, nb = self.tokenize(units)
        fine = np.zeros(len(units), bool)
        for k, (u, i, j) in enumerate(zip(units, np.cumsum(na).tolist(), np.cumsum(nb).tolist())):
            text = u.encode("utf-8", "surrogatepass")
            fine[k] = b"".join([self.a_bytes[x] for x in ia[i - na[k] : i]]) == text == b"".join([self.b_bytes[x] for x in ib[j - nb[k] : j]])
        self.broken |= set((np.flatnonzero(~fine) + len(self.strings)).tolist())
        self._align(ia[np.repeat(fine, na)], na * fine, ib[np.repeat(fine, nb)], nb * fine)

    def _align(self, ia: np.ndarray, na: np.ndarray, ib: np.ndarray, nb: np.ndarray) -> None:
        """Cut the ids of units, one unit after the other, into groups; take up digits, counts, identical ids and pairs of each unit."""
        ends_a, ends_b = np.cumsum(self.a_size[ia]), np.cumsum(self.b_size[ib])
        at = np.searchsorted(ends_b, ends_a)
        cut_a = ends_b[np.minimum(at, len(ends_b) - 1)] == ends_a if len(ends_b) else np.zeros(0, bool)
        cut_b = np.zeros(len(ib), bool)
        cut_b[at[cut_a]] = True
        group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        groups = int(cut_a.sum())
        in_a, in_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        # digits: the ids of A, then of B, in each group
        sizes, n_a, n_b = len(self.a_bytes), len(ia), len(ib)
        order = np.empty(n_a + n_b, np.int64)
        order[np.arange(n_a) + (np.cumsum(in_b) - in_b)[group_a]] = ia + cut_a * sizes
        order[np.arange(n_b) + np.cumsum(in_a)[group_b]] = ib + 2 * sizes + cut_b * len(self.b_bytes)
        stops = np.cumsum(na + nb).tolist()
        digits, listed, before = self.digits, order.tolist(), 0
        for stop in stops:
            self.strings.append(b"".join([digits[i] for i in listed[before:stop]]))
            before = stop
        # links: the identity map's groups, and pairs of overlapping ids elsewhere
        only_b = (np.cumsum(in_b) - in_b)[group_a]
        same = (in_a[group_a] == 1) & (in_b[group_a] == 1)
        same &= self.identity[ia] == ib[np.where(same, only_b, 0)] if n_b else same
        unit_a = np.repeat(np.arange(len(na)), na)
        first = np.searchsorted(ends_b, ends_a - self.a_size[ia], "right")
        links = at - first + 1
        odd = ~same
        pairs = np.repeat(ia[odd], links[odd]) << B_BITS | ib[_spread(first[odd], links[odd])]
        self.ids.extend(ia[same], np.bincount(unit_a[same], minlength=len(na)))
        self.odd.extend(pairs, np.bincount(unit_a[odd], links[odd], len(na)).astype(np.int64))
        n_groups = np.bincount(unit_a[cut_a], minlength=len(na))
        n_links = np.bincount(unit_a, links, len(na)).astype(np.int64)
        self.counts.extend(np.stack([na, nb, n_groups, n_links], 1).ravel(), np.full(len(na), 4))

    def sequence(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of the text, place of the unit) for every unit of the texts, in order; every text has a space before it here."""
        units = [UNIT.findall(t) if self.parts else [t] for t in texts]
        codes = self.codes(list(itertools.chain.from_iterable(units)))
        owner = np.repeat(np.arange(len(texts)), [len(u) for u in units])
        both = np.stack([self.first[codes], self.second[codes]], 1).ravel() if len(codes) else np.zeros(0, np.int64)
        return np.repeat(owner, 2)[both >= 0], both[both >= 0]


def _counted(owner: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many different values each owner has, these, and how often."""
    found, times = np.unique((owner << 48) | values, return_counts=True)
    return np.bincount(found >> 48, minlength=n), found & (1 << 48) - 1, times


def _summed(pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(pairs, return_inverse=True)
    return found, np.bincount(at, times, len(found)).astype(np.int64)


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(values, kind))


DIGEST = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
LISTS = "ids array<int>, id_times array<int>, pairs array<bigint>, pair_times array<int>"
_ALIGNERS: dict[tuple, Aligner] = {}


def aligner(a_path: str | None = None, b_path: str | None = None) -> Aligner:
    """This worker's aligner of two tokenizer files."""
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


class _Sums:
    """What a task counts: a vector over A's ids, and pairs."""

    def __init__(self, own: Aligner) -> None:
        self.own, self.vector = own, np.zeros(len(own.a_bytes), np.int64)
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.used = np.zeros(0, np.int64)

    def use(self, seq: np.ndarray) -> None:
        used = np.bincount(seq, minlength=len(self.used))
        used[: len(self.used)] += self.used
        self.used = used

    def take_in(self) -> None:
        """Count the units used so far."""
        some = np.flatnonzero(self.used)
        ids, sizes = self.own.ids.take(some)
        self.vector += np.bincount(ids, np.repeat(self.used[some], sizes), len(self.vector)).astype(np.int64)
        pairs, sizes = self.own.odd.take(some)
        self.pairs, self.times = _summed(np.append(self.pairs, pairs), np.append(self.times, np.repeat(self.used[some], sizes)))
        self.used = np.zeros(0, np.int64)


def _document_rows(own: Aligner, sums: _Sums, texts: list[str | None]) -> list[pa.Array]:
    texts = [" " + t if t else "" for t in texts]
    owner, seq = own.sequence(texts)
    n = len(texts)
    if own.broken and (bad := np.unique(owner[np.isin(seq, list(own.broken))])).size:
        keep = ~np.isin(owner, bad)
        owner, seq = owner[keep], seq[keep]
    sums.use(seq)
    at = np.searchsorted(owner, np.arange(n + 1)).tolist()
    listed, strings = seq.tolist(), own.strings
    digests = [hashlib.sha256(b"".join([strings[i] for i in listed[u:v]])[:-1]).hexdigest() if v > u else "" for u, v in itertools.pairwise(at)]
    four = own.counts.values[: 4 * own.counts.rows].reshape(-1, 4)[seq]
    counts = [pa.array(np.bincount(owner, four[:, k], n).astype(np.int64)) for k in range(4)]
    ids, sizes = own.ids.take(seq)
    n_ids, ids, id_times = _counted(np.repeat(owner, sizes), ids, n)
    pairs, sizes = own.odd.take(seq)
    n_pairs, pairs, pair_times = _counted(np.repeat(owner, sizes), pairs, n)
    return [*counts, pa.array(digests, pa.string()), _lists(ids, n_ids, pa.int32()), _lists(id_times, n_ids, pa.int32()), _lists(pairs, n_pairs, pa.int64()), _lists(pair_times, n_pairs, pa.int32())]


def _align_task(a_path: str | None, b_path: str | None, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        sums, row = _Sums(own), TaskContext.get().partitionId() << 36
        for part in slices(batches, 1):
            if len(own.known) > own.most:
                sums.take_in()
                own.forget()
            found = _document_rows(own, sums, part.column(1).to_pylist())
            rows = pa.array(np.arange(row, row + part.num_rows))
            row += part.num_rows
            yield pa.RecordBatch.from_arrays([part.column(0), rows, *found, *(pa.nulls(part.num_rows, f.type) for f in list(schema)[-3:])], schema=schema)
        sums.take_in()
        for i in range(0, max(1, len(sums.pairs)), PAIRS_A_ROW):
            u, v = sums.pairs[i : i + PAIRS_A_ROW], sums.times[i : i + PAIRS_A_ROW]
            vector = sums.vector if i == 0 else []
            sent = [pa.array([x], t) for x, t in ((u, pa.list_(pa.int64())), (v, pa.list_(pa.int64())), (vector, pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, f.type) for f in list(schema)[:-3]), *sent], schema=schema)

    return run


def aligned(docs: DataFrame, key: str = "doc_id", text: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """The stored table of document rows (key, row, digest columns, lists) and task rows (sums)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), *T.StructType.fromDDL(f"row long, {DIGEST}, {LISTS}, sum_pairs array<bigint>, sum_times array<bigint>, vector array<bigint>")])
    arrow = to_arrow_schema(schema)
    plain = pa.schema([pa.field(f.name, pa.list_(f.type.value_type) if pa.types.is_list(f.type) else f.type) for f in arrow])
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return staged(rows.mapInArrow(tidy(_align_task(a_path, b_path, plain)), schema), {"compression": "zstd"})


def pair_counts(stored: DataFrame, identity: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """pair, times, best of each linked pair corpus-wide, stored; and the identity groups' counts, a vector of A's vocabulary length."""
    spark = stored.sparkSession
    tasks = stored.filter(F.col("sum_pairs").isNotNull())
    ones = tasks.select(F.posexplode("vector").alias("a", "times")).filter("times > 0").groupBy("a").agg(F.sum("times").alias("times")).collect()  # a row for each id of A at most
    vector = np.zeros(len(identity), np.int64)
    for r in ones:
        vector[r["a"]] = r["times"]
    some = np.flatnonzero(vector)
    of_identity = spark.createDataFrame(list(zip((some << B_BITS | identity[some]).tolist(), vector[some].tolist())), "pair long, times long")
    odd = tasks.select(F.explode(F.arrays_zip("sum_pairs", "sum_times")).alias("x")).select(F.col("x.sum_pairs").alias("pair"), F.col("x.sum_times").alias("times"))
    summed = odd.unionByName(of_identity).groupBy("pair").agg(F.sum("times").alias("times"))
    of_b = Window.partitionBy(F.col("pair").bitwiseAND((1 << B_BITS) - 1))  # at most A's vocabulary
    return staged(summed.select("pair", "times", (F.col("times") == F.max("times").over(of_b)).alias("best"))), vector


def _look_up(shared, schema: pa.Schema):
    """Sums over identity groups and frequent pairs of each document; the other pairs go on as lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_times, id_best, hot, hot_times, hot_best = shared.value
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                n, kept, lists = part.num_rows, part.columns[:-4], part.columns[-4:]
                owners = [np.repeat(np.arange(n), np.diff(x.offsets.to_numpy())) for x in lists[::2]]
                ids, times, pairs, pair_times = (x.flatten().to_numpy().astype(np.int64) for x in lists)
                at = np.minimum(np.searchsorted(hot, pairs), max(len(hot) - 1, 0))
                is_hot = hot[at] == pairs if len(hot) else np.zeros(len(pairs), bool)
                total = np.zeros(n, np.int64)
                best = np.zeros(n, np.int64)
                h, at = owners[1][is_hot], at[is_hot]
                for owner, many, counts, highest in ((owners[0], times, id_times[ids], id_best[ids]), (h, pair_times[is_hot], hot_times[at], hot_best[at])):
                    np.add.at(total, owner, many * counts)
                    np.add.at(best, owner, many * highest)
                rest = np.bincount(owners[1][~is_hot], minlength=n)
                yield pa.RecordBatch.from_arrays([*kept, pa.array(best), pa.array(total), _lists(pairs[~is_hot], rest, pa.int64()), _lists(pair_times[~is_hot], rest, pa.int32())], schema=schema)

    return run


def link_counts(stored: DataFrame, counts: DataFrame, identity: np.ndarray, key: str = "doc_id", hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """key, the digest columns, n_best and count_sum of each document of a stored alignment."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = stored.sparkSession
    n = len(identity)
    a, same = F.shiftright("pair", B_BITS), spark.createDataFrame([(a << B_BITS | b,) for a, b in enumerate(identity.tolist()) if b >= 0], "pair long")
    id_times, id_best = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for r in counts.join(F.broadcast(same), "pair", "left_semi").select(a.alias("a"), "times", "best").collect():  # a row for each id of A at most
        id_times[r["a"]], id_best[r["a"]] = r["times"], r["best"]
    top = counts.orderBy(F.desc("times"), "pair").limit(hot_pairs).toArrow().sort_by("pair")
    hot = [top.column(c).to_numpy().astype(np.int64) for c in ("pair", "times", "best")]
    shared = spark.sparkContext.broadcast((id_times, id_best, *hot))
    documents = stored.filter(F.col("n_a").isNotNull()).select("row", "key", *T.StructType.fromDDL(DIGEST).names, *T.StructType.fromDDL(LISTS).names)
    schema = T.StructType([*documents.schema[:-4], *T.StructType.fromDDL("n_best long, count_sum long, rest array<bigint>, rest_times array<int>")])
    arrow = pa.schema([pa.field(f.name, pa.list_(f.type.value_type) if pa.types.is_list(f.type) else f.type) for f in to_arrow_schema(schema)])
    found = staged(documents.mapInArrow(tidy(_look_up(shared, arrow)), schema))
    rest = found.filter(F.size("rest") > 0).select("row", F.explode(F.arrays_zip("rest", "rest_times")).alias("x")).select("row", F.col("x.rest").alias("pair"), F.col("x.rest_times").cast("long").alias("n"))
    more = rest.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more_sum"))
    both = found.drop("rest", "rest_times").join(more, "row", "left")
    sums = [(F.col(c) + F.coalesce(F.col(m), F.lit(0))).alias(c) for c, m in (("n_best", "more_best"), ("count_sum", "more_sum"))]
    return both.select(F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", *sums, "groups_sha256")


def alignment(docs: DataFrame, key: str = "doc_id", text: str = "text", a_path: str | None = None, b_path: str | None = None, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    identity = Aligner(a_path, b_path, 0).identity
    stored = aligned(docs, key, text, a_path, b_path)
    counts, _ = pair_counts(stored, identity)
    return link_counts(stored, counts, identity, key, hot_pairs)
