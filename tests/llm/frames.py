"""Small tables with what the operators must endure."""

#: Columns that no operator reads, named as the operators name their own.
EXTRA = "key string, text_hash string, label string, set int, task int, bucket int, payload string, size int, n int, class string"
EXTRAS = ("k", "h", "l", 1, 2, 3, "p", 4, 5, "c")


def documents(spark, rows, extra=True):
    """(doc_id, text) rows as a table, with further columns."""
    schema = "doc_id long, text string" + (f", {EXTRA}" if extra else "")
    return spark.createDataFrame([(*r, *EXTRAS) if extra else r for r in rows], schema)


PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards boil strange soup near quiet harbours"
ODD_ROWS = [
    (1, PASSAGE + " and one more thing"),
    (2, PASSAGE + " and one more thing"),
    (2, PASSAGE + " and one more thing"),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (None, PASSAGE + " and another end"),
    (6, "été naïve 日本語 🙂 " * 30),
    (7, "word"),
    (8, "word"),
    (9, "ab " * 60_000),
    (10, "\u0000 null byte and \x7f delete"),
]
