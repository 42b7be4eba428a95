"""Word statistics, quality scores, languages and characteristic words of corpora."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions import text as ft
from scriptorium.sources.tables import stored

Words = Callable[[Column], Column]


def word_counts(docs: DataFrame, words: Words = ft.textometric_words, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., word, count); counts are combined before the shuffle."""
    exploded = docs.select(*by, F.explode_outer(words(ft.present("text"))).alias("word")).filter("word is not null")
    return exploded.groupBy(*by, "word").agg(F.count(F.lit(1)).alias("count"))


def text_statistics(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document: words with and without stopwords, distinct words, lexical richness."""
    split = docs.select(key, ft.textometric_words(ft.present("text")).alias("words"), F.size(ft.all_words(ft.present("text"))).cast("long").alias("total_with_stopwords"))
    sized = split.select(key, F.size("words").cast("long").alias("total_words"), F.size(F.array_distinct("words")).cast("long").alias("unique_words"), "total_with_stopwords")
    return sized.withColumn("richness", F.round(F.coalesce(F.try_divide(F.col("unique_words"), F.col("total_words")), F.lit(0.0)), 6))


def corpus_statistics(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row: totals of the corpus and means per document. Distinct words are counted over the corpus."""
    split = docs.select(ft.textometric_words(ft.present("text")).alias("words"), F.size(ft.all_words(ft.present("text"))).cast("long").alias("every"))
    split = split.select("words", "every", F.array_distinct("words").alias("once"))
    row = lambda word, *n: F.struct(word.cast("string").alias("word"), *[F.coalesce(x, F.lit(0)).cast("long").alias(c) for x, c in zip(n, ("documents", "words", "every", "once"))])
    zero = [F.lit(0)] * 4
    # a row without a word for each document and one for each of its distinct words, so texts are split once
    rows = F.concat(F.array(row(F.lit(None), F.lit(1), F.size("words"), F.col("every"), F.size("once"))), F.transform("once", lambda w: row(w, *zero)))
    sums = split.select(F.explode_outer(rows).alias("x")).groupBy("x.word").agg(*[F.sum(f"x.{c}").alias(c) for c in ("documents", "words", "every", "once")])
    mean = lambda c: F.round(F.try_divide(F.sum(c).cast("double"), F.sum("documents")), 6)
    return sums.agg(
        F.coalesce(F.sum("documents"), F.lit(0)).cast("long").alias("documents"),
        F.sum("words").alias("total_words"),
        F.sum("every").alias("total_with_stopwords"),
        mean("words").alias("mean_words"),
        mean("once").alias("mean_vocabulary"),
        F.count("word").alias("vocabulary"),
    )


def _ngrams(docs: DataFrame, n: int, words: Words) -> DataFrame:
    """Each run of n words within a document."""
    w = docs.select(words(ft.present("text")).alias("w"))
    later = [F.expr(f"slice(w, {i + 1}, greatest(size(w) - {n - 1}, 0))") for i in range(n)]
    grams = later[0]
    for part in later[1:]:
        grams = F.zip_with(grams, part, lambda a, b: F.concat(a, F.lit(" "), b))
    # an outer explode: for a plain one a filter on the array would be put below, and the words split twice
    return w.select(F.explode_outer(grams).alias("ngram")).filter("ngram is not null")


def top_ngrams(docs: DataFrame, n: int, k: int, words: Words = ft.textometric_words) -> DataFrame:
    """The k most frequent runs of n words within documents."""
    return _ngrams(docs, n, words).groupBy("ngram").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "ngram").limit(k)


def _border_grams(n: int, contexts):
    """The runs of n words that end in a document and begin before it; ranges of documents come one after the other, each in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, context = None, []
        for b in batches:
            found = []
            for part, first, last in zip(*(b.column(i).to_pylist() for i in range(3))):
                if part != now:
                    now, context = part, contexts.value[part]
                both = context + first
                found += [" ".join(both[i : i + n]) for i in range(len(context)) if len(context) < i + n <= len(both)]
                context = (context + last)[-(n - 1) :]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["ngram"])

    return run


def corpus_ngrams(docs: DataFrame, n: int, k: int, key: str = "doc_id", words: Words = ft.textometric_words) -> DataFrame:
    """The k most frequent runs of n words of the corpus read as one text, documents by key: runs go on over the ends of documents.

    Runs within documents are counted as everywhere. For the others documents are put into ranges of keys, of
    which only the first and last n - 1 words of each document are written down; each range tells its last
    n - 1 words, a few words a range meet on the driver, and the ranges are then read in order, each with the words before it.
    Short documents pass on the words before them, documents without words all of them. Equal keys go by text.
    """
    if n < 2:
        return top_ngrams(docs, n, k, words)
    split = docs.select(F.col(key).alias("key"), F.xxhash64(ft.present("text")).alias("hash"), words(ft.present("text")).alias("w"))
    ends = F.struct(F.slice("w", 1, n - 1).alias("first"), F.when(F.size("w") > n - 1, F.slice("w", -(n - 1), n - 1)).otherwise(F.col("w")).alias("last"))
    # written down before keys are put into ranges, which reads twice; out of an explode, below which no filter is moved, so texts are split once
    edges = stored(split.select("key", "hash", F.explode_outer(F.array(ends)).alias("e")).filter(F.size("e.first") > 0).select("key", "hash", "e.first", "e.last"))
    ranged = stored(edges.repartitionByRange("key", "hash").sortWithinPartitions("key", "hash").select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), "first", "last"))
    # every document kept has a word, so n - 1 of them are enough for a range's last words
    backwards = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("at")))
    ends = ranged.withColumn("back", backwards).filter(F.col("back") < n).groupBy("part").agg(F.array_sort(F.collect_list(F.struct("at", "last"))).alias("x"))
    context, before = [], {}
    for part, some in sorted((r["part"], [w for x in r["x"] for w in x["last"]]) for r in ends.collect()):  # a row a range
        before[part] = context
        context = (context + some)[-(n - 1) :]
    contexts = docs.sparkSession.sparkContext.broadcast(before)
    in_order = ranged.repartition("part").sortWithinPartitions("part", "at").select("part", "first", "last")
    over = in_order.mapInArrow(_border_grams(n, contexts), "ngram string")
    inside = _ngrams(docs, n, words)
    return inside.unionByName(over).groupBy("ngram").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "ngram").limit(k)


def tfidf(docs: DataFrame, k: int = 10, key: str = "doc_id", words: Words = ft.textometric_words, salts: int = 16) -> DataFrame:
    """The k words of each document with the highest count / total * ln(documents / documents with the word).

    Words are counted within their row, once, and the counts stored. Popular words are dealt over ``salts`` places in the join, and the
    window keeps k words of a document before its shuffle.
    """
    split = docs.select(key, words(ft.present("text")).alias("words"))
    counted = stored(ft.with_counts(split, "words", "counts").select(key, F.size("words").alias("total"), "counts"))
    counts = counted.select(key, "total", F.explode_outer("counts").alias("c")).filter("c is not null").select(key, "total", "c.word", "c.count")
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    df = counts.groupBy("word").agg(F.count(F.lit(1)).alias("df")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    scored = counts.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(salts)).cast("int")).join(df, ["word", "salt"]).crossJoin(F.broadcast(n))  # one row
    score = F.round(F.col("count") / F.col("total") * F.log(F.col("n") / F.col("df")), 9)
    ranked = scored.withColumn("tfidf", score).withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("tfidf"), "word")))
    return ranked.filter(F.col("rank") <= k).select(key, "word", "tfidf", F.col("rank").cast("long").alias("rank"))


#: Weights and limits of the quality score.
LIMITS = {"entropy": 0.3, "unique_ratio": 0.4, "sentences": 1, "words": 20, "least_length": 2.0, "most_length": 20.0}


def quality(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document: entropy over log2 of the vocabulary, unique ratio, mean word length, sentences, score, first reason to reject."""
    split = docs.select(key, F.transform(ft.quality_words(ft.present("text")), F.lower).alias("w"), ft.sentence_count(ft.present("text")).cast("long").alias("sentences"))
    counted = ft.with_counts(split, "w", "counts")
    # -sum(p log2 p) = log2(n) - sum(c log2 c) / n, summed within the row
    joined = counted.select(
        key,
        "sentences",
        F.size("w").cast("long").alias("words"),
        F.size("counts").cast("long").alias("unique"),
        F.aggregate("counts", F.lit(0.0), lambda s, x: s + x["count"] * F.log2(x["count"].cast("double"))).alias("mass"),
        F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x["count"] * F.length(x["word"])).alias("letters"),
    )
    bits = F.log2("words") - F.try_divide("mass", "words")
    scored = joined.select(
        key,
        "words",
        "sentences",
        F.round(F.when((F.col("words") < 2) | (F.col("unique") < 2), 0.0).otherwise(F.least(F.lit(1.0), bits / F.log2("unique"))), 6).alias("entropy"),
        F.round(F.coalesce(F.try_divide("unique", "words"), F.lit(0.0)), 6).alias("unique_ratio"),
        F.round(F.coalesce(F.try_divide("letters", "words"), F.lit(0.0)), 6).alias("mean_length"),
    )
    score = 0.35 * F.col("entropy") + 0.25 * F.col("unique_ratio") + 0.2 * F.greatest(F.lit(0.0), 1 - F.abs(F.col("mean_length") - 6) / 10) + 0.2 * F.least(F.lit(1.0), F.col("sentences") / 5)
    reason = (
        F.when(F.col("words") < LIMITS["words"], "too_few_words")
        .when(F.col("sentences") < LIMITS["sentences"], "too_few_sentences")
        .when(F.col("entropy") < LIMITS["entropy"], "low_entropy")
        .when(F.col("unique_ratio") < LIMITS["unique_ratio"], "low_unique_ratio")
        .when(F.col("mean_length") < LIMITS["least_length"], "short_words")
        .when(F.col("mean_length") > LIMITS["most_length"], "long_words")
    )
    return scored.withColumn("score", F.round(score, 6)).withColumn("rejected", reason)
