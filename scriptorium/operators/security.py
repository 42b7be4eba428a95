"""Inspection of texts for injected instructions, links and odd encodings."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.functions import text as ft

# Labels, severities and patterns of the rules.
INSTRUCTIONS = [
    ("ignore_prior_instructions", "high", r"(?i)\b(ignore|disregard|forget)\b[^.]{0,40}\b(previous|prior|above|all)\b[^.]{0,40}\b(instructions?|prompts?|rules?|context)\b"),
    ("persona_flip", "high", r"(?i)\byou are now\b[^.]{0,60}\b(a|an)\b[^.]{0,40}\b(assistant|model|ai|expert)\b"),
    ("leak_request", "medium", r"(?i)\b(system prompt|instructions?)\b[^.]{0,30}\b(reveal|leak|print|show|display)\b"),
    ("jailbreak_keyword", "medium", r"(?i)\b(jailbreak|DAN mode|developer mode)\b"),
]
LINK = r"""(?i)\bhttps?://[^\s<>"'`]+"""
ENCODINGS = [("long_base64_blob", "low", r"[A-Za-z0-9+/]{120,}={0,2}"), ("zero_width_run", "medium", r"[\x{200B}-\x{200D}\x{FEFF}]{3,}")]
KINDS = ["suspicious_instruction", "external_url", "unusual_encoding", "prompt_injection_blocked"]


def _event(kind: str, pattern: Column, severity: Column, detail: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), pattern.alias("pattern"), severity.alias("severity"), detail.alias("detail"))


def scan(df: DataFrame, key: str = "id", text: str = "content") -> DataFrame:
    """(key, kind, pattern, severity, detail): one event per rule that matches, distinct link, and encoding rule that matches."""
    content, none = ft.present(text), F.lit(None).cast("string")
    rules = F.array(*[F.when(content.rlike(p), _event(KINDS[0], F.lit(name), F.lit(severity), none)) for name, severity, p in INSTRUCTIONS])
    links = F.transform(F.array_distinct(F.regexp_extract_all(content, F.lit(LINK), 0)), lambda u: _event(KINDS[1], none, none, u))
    odd = F.array(*[F.when(content.rlike(p), _event(KINDS[2], F.lit(name), F.lit(severity), F.substring(F.regexp_extract(content, p, 0), 1, 40))) for name, severity, p in ENCODINGS])
    return df.select(key, F.explode(F.array_compact(F.concat(rules, links, odd))).alias("e")).select(key, "e.*")


def blocked(events: DataFrame, mode: str, key: str = "id") -> DataFrame:
    """Keys that a mode blocks: warn none, audit those with high, block those with high or medium instructions. Links and encodings never block."""
    severities = {"warn": [], "audit": ["high"], "block": ["high", "medium"]}[mode]
    return events.filter((F.col("kind") == KINDS[0]) & F.col("severity").isin(severities)).select(key).distinct()


def statistics(events: DataFrame, at: str = "at") -> DataFrame:
    """(measure, value): counts of every kind and severity, zeros included, and the first and last time."""
    from scriptorium.operators.journal import zero_filled

    kinds = zero_filled(events.groupBy("kind").agg(F.count(F.lit(1)).alias("count")), "kind", KINDS)
    severities = zero_filled(events.filter("severity is not null").groupBy("severity").agg(F.count(F.lit(1)).alias("count")), "severity", ["low", "medium", "high"])
    times = events.agg(F.min(at).cast("string").alias("first"), F.max(at).cast("string").alias("last"))
    rows = kinds.select(F.concat(F.lit("kind:"), "kind").alias("measure"), F.col("count").cast("string").alias("value"))
    rows = rows.unionByName(severities.select(F.concat(F.lit("severity:"), "severity").alias("measure"), F.col("count").cast("string").alias("value")))
    return rows.unionByName(times.select(F.lit("first").alias("measure"), F.col("first").alias("value"))).unionByName(times.select(F.lit("last").alias("measure"), F.col("last").alias("value")))


# --- redaction -------------------------------------------------------------------------------------

# Fields whose values are replaced by digest and length, the object whose values are masked, and the mask.
SENSITIVE = frozenset("query snippet content text value context entity".split())
SECRETS, MASK = "env", "[redacted]"


def _shown(x) -> str:
    """A JSON value as scripts turn it into text."""
    if isinstance(x, str):
        return x
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, dict):
        return "[object Object]"
    if isinstance(x, list):
        return ",".join("" if y is None else _shown(y) for y in x)
    if isinstance(x, float):
        if x.is_integer() and abs(x) < 1e21:
            return str(int(x))
        digits = repr(x)
        return re.sub(r"e([+-])0*", r"e\1", digits) if "e" not in digits or abs(x) < 1e-6 or abs(x) >= 1e21 else f"{x:.20f}".rstrip("0")
    return "null" if x is None else str(x)


def _marked(x):
    if x is None:
        return None
    shown = _shown(x)
    data = shown.encode("utf-8", "replace")
    return {"sha256": hashlib.sha256(data).hexdigest(), "length": len(shown.encode("utf-16-le", "surrogatepass")) // 2}


def redacted_value(payload):
    """A JSON value with its sensitive parts replaced, at any depth; walked without recursion."""
    top: list = [payload]
    open_parts: list = [top]
    while open_parts:
        part = open_parts.pop()
        for k, v in list(part.items() if isinstance(part, dict) else enumerate(part)):
            if isinstance(part, dict) and k == SECRETS and isinstance(v, dict):
                part[k] = dict.fromkeys(v, MASK)
            elif isinstance(part, dict) and k in SENSITIVE:
                part[k] = _marked(v)
            elif isinstance(v, (dict, list)):
                open_parts.append(v)
    return top[0]


def _redacted_text(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        payload = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return json.dumps(redacted_value(payload), ensure_ascii=False, separators=(",", ":"))


def redacted_json(df: DataFrame, payload: str) -> DataFrame:
    """A column of JSON texts, or of VARIANT, as JSON texts in which fields of sensitive names hold digest and length, and values of env are masked.

    Objects and arrays are walked to any depth that the parser takes (about a thousand); texts that aren't JSON become null.
    Numbers keep their spelling but for needless digits, fields their order.
    """
    text = F.to_json(F.col(payload)) if isinstance(df.schema[payload].dataType, T.VariantType) else F.col(payload).cast("string")
    at, schema = df.columns.index(payload), T.StructType([f if f.name != payload else T.StructField(payload, T.StringType()) for f in df.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([_redacted_text(x) for x in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([found if i == at else c for i, c in enumerate(b.columns)], names=schema.names)

    return df.withColumn(payload, text).mapInArrow(run, schema)
