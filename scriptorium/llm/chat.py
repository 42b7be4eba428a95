"""Chat formatting with Spark expressions only.

Template, a message being adjacent turns of one role::

    <|im_start|>ROLE
    TEXT<|im_sep|>TEXT<|im_end|>

Inside texts ``<``, any number of ``~``, ``|`` gets one more ``~``, so no text holds ``<|``; taking
one away gives the text back. Roles are written with ``%``, ``<`` and line ends as ``%25``, ``%3C``, ``%0A``.

Defined results: turns are ordered by turn, then role, then text (as it is, not as escaped), nulls first,
so ties and repeated rows have one order and each counts; a null text or role is empty; rows of a null
conversation form one conversation; an empty table gives an empty table; columns that aren't named are
ignored. A conversation is one value of the result, so its turns must fit a row (2 GB); texts may have any
length within that. Merging is linear in the turns, and sums of lengths are taken chunk by chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(~*)\|", r"<~$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<~(~*)\|", r"<$1|")


def _role_out(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("<"), F.lit("%3C")), F.lit("\n"), F.lit("%0A"))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%3C"), F.lit("<")), F.lit("%25"), F.lit("%"))


def format_chat(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: key, n_messages, formatted, and the loss mask as (first, length) spans of code points."""
    turns = df.select(
        F.col(key).alias("key"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).alias("t"),
    )
    sorted_turns = turns.groupBy("key").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    escaped = sorted_turns.select("key", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), escape(t["text"]).alias("text"))).alias("turns"))
    # a message begins where the role differs from that of the turn before
    begun = escaped.withColumn("starts", F.expr("filter(sequence(1, size(turns)), i -> not (get(turns, i - 1).role <=> get(turns, i - 2).role))"))
    merged = begun.select("key", F.expr("transform(starts, (s, j) -> slice(turns, s, coalesce(get(starts, j + 1), size(turns) + 1) - s))").alias("messages"))
    rendered = merged.select(
        "key",
        F.transform(
            "messages",
            lambda m: F.struct(
                (F.get(m, F.lit(0))["role"] == trained_role).alias("trained"),
                F.concat(F.lit(START), _role_out(F.get(m, F.lit(0))["role"]), F.lit("\n")).alias("head"),
                F.array_join(F.transform(m, lambda t: t["text"]), SEP).alias("body"),
                F.transform(m, lambda t: F.length(t["text"])).alias("lengths"),
            ),
        ).alias("parts"),
    )
    tail = len(END) + 1
    at = rendered.withColumn("at", F.expr(_before(f"transform(parts, p -> length(p.head) + length(p.body) + {tail})")))
    placed = at.withColumn("inner", F.expr(f"transform(parts, p -> if(p.trained, {_before(f'transform(p.lengths, n -> n + {len(SEP)})')}, cast(array() as array<int>)))"))
    spans = """
        flatten(zip_with(sequence(0, size(parts) - 1), inner, (k, places) ->
            transform(places, (o, j) -> named_struct('first', get(at, k) + length(get(parts, k).head) + o, 'length', get(get(parts, k).lengths, j)))))
    """
    return placed.select(
        F.col("key").alias(key),
        F.size("parts").alias("n_messages"),
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END + "\n"))), "").alias("formatted"),
        F.expr(spans).alias("loss_spans"),
    )


def _before(lengths: str, chunk: int = 512) -> str:
    """SQL: for each of an array of lengths the sum of those before it. Arrays grow within a chunk, and by whole chunks, only."""
    none = "cast(array() as array<int>)"
    return f"""
        aggregate({lengths}, named_struct('at', 0, 'held', {none}, 'done', cast(array() as array<array<int>>)), (a, n) ->
            if(size(a.held) < {chunk - 1},
               named_struct('at', a.at + n, 'held', concat(a.held, array(a.at)), 'done', a.done),
               named_struct('at', a.at + n, 'held', {none}, 'done', concat(a.done, array(concat(a.held, array(a.at)))))),
            a -> concat(flatten(a.done), a.held))
    """


def parse_chat(df: DataFrame, key: str = "conv_id", formatted: str = "formatted", loss_spans: str = "loss_spans") -> DataFrame:
    """Read a formatted conversation back: key, turns (role, text in order) and loss_text, the unescaped text under the mask."""
    messages = F.filter(F.split(F.col(formatted), r"<\|im_end\|>\n"), lambda m: m != "")
    turns = F.flatten(
        F.transform(
            messages,
            lambda m: F.transform(
                F.split(F.substring(m, F.locate("\n", m) + 1, F.length(m)), r"<\|im_sep\|>"),
                lambda x: F.struct(_role_in(F.substring(m, F.lit(len(START) + 1), F.locate("\n", m) - len(START) - 1)).alias("role"), unescape(x).alias("text")),
            ),
        )
    )
    loss = F.array_join(F.transform(F.col(loss_spans), lambda s: unescape(F.substring(F.col(formatted), s["first"] + 1, s["length"]))), "")
    return df.select(F.col(key), turns.alias("turns"), loss.alias("loss_text"), F.length(formatted).alias("formatted_chars"))
