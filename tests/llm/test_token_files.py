import random
import zlib
from array import array
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from frames import ODD_ROWS, documents
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scriptorium.llm import token_files
from scriptorium.llm.queries import QUERIES
from scriptorium.llm.storage import shared_folder
from scriptorium.llm.tokens import Encoder


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))


def ids_of(tokenizer, text):
    return array("I", [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]).tobytes()


def write(spark, rows, **options):
    path = shared_folder(spark)
    token_files.write_token_files(documents(spark, rows), path, **options)
    return path


def test_odd_rows(spark, tokenizer):
    path = write(spark, ODD_ROWS)
    got = token_files.with_crc32(token_files.read_metadata(spark, path, columns=("ids",))).collect()
    rows = sorted(ODD_ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, at = [], 0
    for k, t in rows:
        x = ids_of(tokenizer, t)
        want.append((k, at, len(x) // 4, zlib.crc32(x)))
        at += len(x) // 4
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want


def test_empty_table(spark):
    assert token_files.read_metadata(spark, write(spark, [])).collect() == []


def test_selective_reads(spark):
    rows = [(k, f"text {k} of several words") for k in range(300)]
    path = write(spark, rows, files=6)
    part = token_files.read_tokens(spark, path, 100, 103)
    assert sorted(r.doc_id for r in part.collect()) == [100, 101, 102, 103]
    plan = part._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(key,100)" in plan
    meta = token_files.read_metadata(spark, path)
    scans = [x for x in meta._jdf.queryExecution().executedPlan().toString().split("\n") if "ReadSchema" in x]
    assert scans and not any("ids" in x.split("ReadSchema")[1] for x in scans)


def test_file_layout(spark):
    rng = random.Random(1)
    texts = [(k, " ".join(str(rng.randrange(10**6)) for _ in range(100))) for k in range(2000)]
    path = write(spark, texts, files=2, row_group_bytes=64 << 10, page_bytes=4 << 10)
    files = list(Path(path.removeprefix("file://")).glob("tokens/*.parquet"))
    assert len(files) == 2
    meta = pq.ParquetFile(files[0]).metadata
    assert meta.num_row_groups > 1
    columns = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i) for i in range(meta.num_columns)}
    assert any("DICTIONARY" in e for e in columns["ids.list.element"].encodings)
    assert "DELTA_BINARY_PACKED" in columns["local_start"].encodings
    assert all(c.has_offset_index and c.has_column_index for c in columns.values() if "list" not in c.path_in_schema)


def test_encoder_equals_the_tokenizer(tokenizer):
    own = Encoder(most_bytes=2000)
    texts = ["a  b", " lead", "trail ", "x\n\ny\tz", "a b  c\r\n", "日本 語", "don't stop-now!", "🙂🙂 ok", "é é", "​ x", "", None, "tab\tand\x0bvt", "word " * 300]
    for t, got in zip(texts * 3, own.encode_all(texts) + own.encode_all(texts) + own.encode_all(texts)):
        assert got == array("I", tokenizer.encode(t or "", add_special_tokens=False).ids).tobytes(), t


def test_rows_of_a_hot_key_are_dealt_over_files(spark):
    rows = [(None if k % 3 else k, f"{k * 7919 % 1000:03d} text") for k in range(600)]
    path = write(spark, rows, files=6)
    shards = {r.shard for r in spark.read.parquet(f"{path}/tokens").filter("key is null").select("shard").collect()}
    assert len(shards) >= 3
    got = token_files.read_metadata(spark, path, columns=("ids",)).orderBy("start").collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    assert [r.doc_id for r in got] == [k for k, _ in want]
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]


def test_query_over_a_table(spark, tokenizer):
    """op5 against the tokenizer over the whole smallest table."""
    sf = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect())
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op5_token_files"](spark, sf).collect())
    at, want = 0, []
    for k, t in rows:
        ids = ids_of(tokenizer, t)
        want.append((k, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert got == want
