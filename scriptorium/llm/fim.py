"""Fill-in-middle transformation as a pyarrow.compute pipeline over batches.

A text is cut into units (lines with their ends). Units of a batch become one list array, which is flattened
with the number of each unit's text; ordinals within the text give every unit a role (prefix, middle or
suffix), units are filtered by role, lists are rebuilt from counts and joined, and the pieces of a text are
put together by form: ``plain`` (the text), ``psm`` (prefix, suffix, middle) or ``spm`` (suffix, prefix,
middle), each piece after its mark.

The numbers h1 to h4 that choose cuts and form are the first groups of eight hex digits of the SHA-256 of
``seed:key``, taken in Spark. ``restore`` finds the marks, which no transformed text holds, and puts the
pieces back in order; the texts are whole on both ways.

Defined results: a null text is empty; an empty text, and one that holds a mark, is plain; a null key hashes
as an empty key, so such rows all get the same numbers; repeated rows give the same output; an empty table gives no rows. Other columns stay as they are;
a column named as one of the results is replaced. A very long text is a batch of its own, of 2 GB at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.storage import slices, tidy

MARKS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM_RATE = 7, 100, 50
RESULTS = "n_units long, form string, prefix_chars long, middle_chars long, output string"
_RESTORED = "restored"


def numbers(key: Column, seed: int = SEED) -> Column:
    """h1 to h4 of a key, as an array."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def units(texts: pa.Array) -> pa.ListArray:
    """The lines of each text, with their ends; an empty text has none."""
    lines = pc.split_pattern(texts, "\n")
    flat, parent = lines.flatten(), pc.list_parent_indices(lines)
    goes_on = pa.array(np.diff(parent.to_numpy(), append=-1) == 0)  # another line of this text follows
    ended = pc.binary_join_element_wise(flat, pc.if_else(goes_on, "\n", ""), "")
    some = pc.greater(pc.binary_length(ended), 0)
    return _rebuilt(ended.filter(some), parent.filter(some), len(texts))


def _rebuilt(values: pa.Array, parent: pa.Array, n: int) -> pa.ListArray:
    counts = np.bincount(parent.to_numpy(), minlength=n)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), values)


def _marked(texts: pa.Array) -> pa.Array:
    found = [pc.match_substring(texts, m) for m in MARKS]
    return pc.or_(pc.or_(found[0], found[1]), found[2])


def transform(texts: pa.Array, h: np.ndarray, rate: int = RATE, spm_rate: int = SPM_RATE) -> list[pa.Array]:
    """n_units, form, prefix_chars, middle_chars, output of each text; h has four columns."""
    texts = pc.fill_null(texts, "")
    lists = units(texts)
    n = pc.list_value_length(lists).to_numpy().astype(np.int64)
    cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    flat, parent = lists.flatten(), pc.list_parent_indices(lists)
    owner = parent.to_numpy()
    ordinal = np.arange(len(owner)) - lists.offsets.to_numpy()[owner]
    role = (ordinal >= cuts[owner, 0]).astype(np.int8) + (ordinal >= cuts[owner, 1])
    pieces = []
    for k in range(3):
        mine = pa.array(role == k)
        pieces.append(pc.binary_join(_rebuilt(flat.filter(mine), parent.filter(mine), len(texts)), ""))
    prefix, middle, suffix = pieces
    plain = pc.or_(pc.or_(pc.equal(n, 0), _marked(texts)), pa.array(h[:, 2] % 100 >= rate))
    spm = pa.array(h[:, 3] % 100 < spm_rate)
    p, s, m = MARKS
    psm_out = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, "")
    spm_out = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, "")
    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
    output = pc.if_else(plain, texts, pc.if_else(spm, spm_out, psm_out))
    chars = [pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(x).cast(pa.int64())) for x in (prefix, middle)]
    return [pa.array(n), form, *chars, output]


def restore(outputs: pa.Array, forms: pa.Array) -> pa.Array:
    """The text of each output, by its form."""
    p, s, m = MARKS
    outputs = pc.fill_null(outputs, "")
    parts = {}
    for form, first, second in (("psm", p, s), ("spm", s, p)):
        mine = pc.equal(forms, form)
        body = pc.utf8_slice_codeunits(outputs.filter(mine), len(first))
        ahead = pc.split_pattern(body, second, max_splits=1)
        tail = pc.split_pattern(pc.list_element(ahead, 1), m, max_splits=1)
        one, two, middle = pc.list_element(ahead, 0), pc.list_element(tail, 0), pc.list_element(tail, 1)
        prefix, suffix = (one, two) if form == "psm" else (two, one)
        parts[form] = (mine, pc.binary_join_element_wise(prefix, middle, suffix, ""))
    out = outputs
    for mine, texts in parts.values():
        if len(texts):
            out = pc.replace_with_mask(out, mine, texts)
    return out


def _run(text: int, kept: list[int], rate: int, spm_rate: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            h = part.column(part.num_columns - 1).flatten().to_numpy().reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in kept), *transform(part.column(text).cast(pa.string()), h, rate, spm_rate)], names=names)

    return run


def fill_in_middle(df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """All rows and columns but the text, with n_units, form, prefix_chars, middle_chars and output."""
    added = T.StructType.fromDDL(RESULTS)
    kept = [c for c in df.columns if c != text and c not in added.names]
    rows = df.select(*[F.col(f"`{c}`") for c in kept], F.col(text).cast("string"), numbers(F.col(key), seed))
    schema = T.StructType([*(df.schema[c] for c in kept), *added])
    return rows.mapInArrow(tidy(_run(len(kept), list(range(len(kept))), rate, spm_rate, schema.names)), schema)


def with_restored(df: DataFrame, output: str = "output", form: str = "form", to: str = _RESTORED) -> DataFrame:
    """All rows and columns with the text that an output was made of."""
    schema = T.StructType([*(f for f in df.schema if f.name != to), T.StructField(to, T.StringType())])
    names, o, f = schema.names, schema.names.index(output), schema.names.index(form)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, o):
            yield pa.RecordBatch.from_arrays([*part.columns, restore(part.column(o).cast(pa.string()), part.column(f).cast(pa.string()))], names=names)

    return df.select(*[F.col(f"`{c}`") for c in names[:-1]]).mapInArrow(tidy(run), schema)
