"""Redaction of free-shape JSON against a plain recursive version, entity replies case by case, and UTF-16 keys."""

import hashlib
import json

from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import differences
import pytest
from pyspark.sql import functions as F

from scriptorium.operators import security, sources
from scriptorium.plans.catalogue import ORACLES, QUERIES

NAMES = st.sampled_from(["query", "env", "text", "a", "b", "value"])
VALUES = st.recursive(
    st.one_of(st.none(), st.booleans(), st.integers(-5, 5), st.sampled_from([1.5, 2.0, 1e21, 1e-7]), st.sampled_from(["", "é🙂", "x"])),
    lambda inner: st.one_of(st.lists(inner, max_size=3), st.dictionaries(NAMES, inner, max_size=3)),
    max_leaves=12,
)


def plain(v):
    def shown(x):
        if isinstance(x, bool):
            return str(x).lower()
        if isinstance(x, list):
            return ",".join("" if y is None else shown(y) for y in x)
        return "[object Object]" if isinstance(x, dict) else {1.5: "1.5", 2.0: "2", 1e21: "1e+21", 1e-7: "1e-7"}.get(x, str(x)) if isinstance(x, float) else "null" if x is None else str(x)

    def mark(x):
        return None if x is None else {"sha256": hashlib.sha256(shown(x).encode()).hexdigest(), "length": len(shown(x).encode("utf-16-le")) // 2}

    if isinstance(v, list):
        return [plain(x) for x in v]
    if not isinstance(v, dict):
        return v
    return {k: {e: "[redacted]" for e in x} if k == "env" and isinstance(x, dict) else mark(x) if k in ("query", "text", "value") else plain(x) for k, x in v.items()}


@settings(max_examples=300, deadline=None)
@given(VALUES)
def test_equals_a_recursive_version(value):
    assert json.loads(security._redacted_text(json.dumps(value))) == json.loads(json.dumps(plain(value)))


def test_texts_variants_and_bad_rows(spark):
    deep = '{"a":' * 200 + '{"text": "x"}' + "}" * 200
    rows = [(1, '{"query": "q", "n": 12345678901234567890}'), (2, None), (3, "not json"), (4, "[]"), (5, deep), (6, '"query"')]
    df = spark.createDataFrame(rows, "id long, payload string")
    got = {r.id: r.payload for r in security.redacted_json(df, "payload").collect()}
    assert got[2] is None and got[3] is None and got[4] == "[]" and got[6] == '"query"' and '"n":12345678901234567890' in got[1]
    assert '"text":{"sha256"' in got[5]
    variant = df.filter("id in (1, 4)").withColumn("payload", F.parse_json("payload"))
    assert {r.id: json.loads(r.payload) for r in security.redacted_json(variant, "payload").collect()}[1]["query"]["length"] == 1


@pytest.mark.parametrize("name", ["redacted_payloads", "reply_entities", "entity_contexts"])
def test_queries(spark, name):
    assert differences(QUERIES[name](spark, "/root/testdata/sf0.001"), ORACLES[name], "/root/testdata/sf0.001") == []


def test_entity_replies(spark):
    cases = {
        '[{"name":5,"type":"PERSON"}]': [],
        '[{"name":" A ","type":"person"},{"name":"B","type":"thing"},null,3,"x",[1]]': [("A", "PERSON", "")],
        '[{"name":"A","type":"DATE","context":{"a":1}}]': [("A", "DATE", "")],
        '[{"name":"A","type":"DATE","context":"c"},{"name":"B", "type":"odd","context":7}]': [("A", "DATE", "c")],
        '[{"name":"A","type":"DATE","context":7}, {"name" : "B" , "type" : "odd"}]': [("A", "DATE", ""), ("B", "EVENT", "")],
        "[]": [],
        "no list": [],
        '"name": "A", "type": "EVENT"': [("A", "EVENT", "")],
        "[{'name': 'A', 'type': 'DATE'}]": [],
        None: [],
    }
    df = spark.createDataFrame(list(enumerate(cases)), "id long, text string")
    got = {}
    for r in sources.reply_entities(df).collect():
        got.setdefault(r.id, []).append((r.name, r.kind, r.context))
    assert [got.get(i, []) for i in range(len(cases))] == list(cases.values())


def test_cache_keys_count_utf16_units(spark):
    def want(text):
        units = text.encode("utf-16-be")
        h = 0
        for i in range(0, len(units), 2):
            h = (h * 31 + int.from_bytes(units[i : i + 2])) & 0xFFFFFFFF
        h = h - (1 << 32) if h >= 1 << 31 else h
        return text.lower().strip() if len(units) // 2 <= 100 else f"hash_{h}_{len(units) // 2}"

    texts = ["Short 🙂", "🙂" * 50, "🙂" * 51, "é" * 101, "mixed 🙂 text " * 30, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(sources.cache_key(F.col("t"))).collect()] == [want(t) for t in texts]
