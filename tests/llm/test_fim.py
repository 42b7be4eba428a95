"""Fill-in-middle: against a plain version, and the exact way back."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from frames import ODD_ROWS, documents
from hypothesis import given
from hypothesis import strategies as st

from scriptorium.llm import fim

TEXTS = st.lists(st.sampled_from(["a", "é🙂", "\n", "\n\n", " ", "<", "P>", "<S", ">", "<M>", "\r"]), max_size=12).map("".join)


def plain(text, h, rate=100, spm_rate=50):
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(lines[:low]), "".join(lines[low:high]), "".join(lines[high:])
    if not text or any(m in text for m in fim.MARKS) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm_rate:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@given(st.lists(st.tuples(TEXTS, st.lists(st.integers(0, 2**32 - 1), min_size=4, max_size=4)), max_size=6), st.sampled_from([100, 40]))
def test_equals_a_plain_version(rows, rate):
    texts = pa.array([t for t, _ in rows], pa.string())
    h = np.array([x for _, x in rows], np.int64).reshape(-1, 4)
    got = fim.transform(texts, h, rate)
    assert list(zip(*[x.to_pylist() for x in got])) == [plain(t, x, rate) for t, x in rows]
    assert fim.restore(got[4], got[1]).to_pylist() == texts.to_pylist()


def test_rows_of_all_kinds(spark):
    rows = [*ODD_ROWS, (20, "x<P>y\nz"), (21, "\n"), (22, "one line"), (23, "line\n" * 50_000)]
    out = fim.with_restored(fim.fill_in_middle(documents(spark, rows))).collect()
    assert len(out) == len(rows) and {r.label for r in out} == {"l"}
    texts = {}
    for k, t in rows:
        texts.setdefault(k, set()).add(t or "")
    for r in out:
        digest = hashlib.sha256(f"7:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
        assert r.restored in texts[r.doc_id]
        assert (r.n_units, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(r.restored, h)
    assert fim.fill_in_middle(documents(spark, [])).collect() == []


@pytest.mark.parametrize("column", ["form", "output", "n_units"])
def test_clashing_columns_are_replaced(spark, column):
    df = spark.createDataFrame([(1, "a\nb", "kept")], f"doc_id long, text string, {column} string")
    assert fim.fill_in_middle(df).columns.count(column) == 1
