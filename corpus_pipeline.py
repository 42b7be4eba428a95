"""The corpus pipeline: toxicity, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again as
the next one's docs; all but the last return the columns of documents.

Rows are told apart by doc_id and text, so repeated ids and null ids do no harm. Of rows that agree in
both, the near-duplicate stage keeps one. Null keys are keys of their own, null texts are empty documents, and
a very long text is worked on whole, on its own; further columns may have any names.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm import decontaminate, near_join, packing, suffix_dedup, toxicity
from scriptorium.llm.storage import spare_name, staged

BATCH_ROWS = 1000


def _with_hash(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a hash of their text, and that column's name, which no other column has."""
    name = spare_name()
    return docs.withColumn(name, F.xxhash64("text")), name


def _named(found: DataFrame, *columns: Column) -> tuple[DataFrame, list[str]]:
    """The columns under names that no other column has."""
    names = [spare_name() for _ in columns]
    return found.select(*[c.alias(n) for c, n in zip(columns, names)]), names


def _small_batches(spark: SparkSession) -> None:
    """Workers serve all stages, so they get a thousand rows at once, not ten thousand; the session keeps this setting."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5; the model learns from all labels."""
    _small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    score = spare_name()
    return toxicity.with_scores(docs, toxicity.fit(docs, labels), to=score).filter(F.col(score) < 0.5).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each class of near duplicates; wordless documents all stay."""
    _small_batches(spark)
    found = staged(near_join.near_duplicates(docs))
    row = F.struct(F.isnull("doc_id").alias("missing"), "doc_id", "text_hash")
    of_classes = found.filter(F.col("class").isNotNull()).groupBy("class").agg(F.min(row).alias("row")).select("row.doc_id", "row.text_hash")
    alone = found.filter(F.col("class").isNull()).select("doc_id", "text_hash")
    keep, (key, kept_hash) = _named(of_classes.unionByName(alone).distinct(), F.col("doc_id"), F.col("text_hash"))
    hashed, own_hash = _with_hash(docs)
    kept = hashed.join(keep, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(own_hash) == F.col(kept_hash)), "left_semi")
    if not found.groupBy("doc_id", "text_hash").count().filter("count > 1").isEmpty():
        kept = kept.dropDuplicates(["doc_id", own_hash])
    return kept.drop(own_hash)


@F.pandas_udf(T.StringType())
def _whole_characters(kept: pd.Series) -> pd.Series:
    """Bytes as text; of a character that is cut, nothing stays."""
    return kept.map(lambda x: None if x is None else bytes(x).decode("utf-8", "ignore"))


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the passages that earlier ones have; n_chars follows the text, a null text stays null."""
    _small_batches(spark)
    found = suffix_dedup.remove_repeats(docs)
    cut, (key, cut_hash, kept) = _named(found, F.col("doc_id"), F.col("text_hash"), _whole_characters("kept"))
    hashed, own_hash = _with_hash(docs)
    missing = spare_name()
    hashed = hashed.withColumn(missing, F.isnull("text")).drop("text")
    if not hashed.groupBy("doc_id", own_hash).count().filter("count > 1").isEmpty():
        cut = cut.dropDuplicates([key, cut_hash])
    joined = hashed.join(cut, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(own_hash) == F.col(cut_hash)))
    texts = joined.withColumn("text", F.when(~F.col(missing), F.col(kept)))
    return texts.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    _small_batches(spark)
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    hashed, own_hash = _with_hash(docs)
    rows = hashed.select(F.struct(F.col("doc_id").alias("key"), F.col(own_hash).alias("hash")).alias("row"), "text")
    found = decontaminate.contamination(rows, benchmark, key="row").filter(F.size("spans") > 0)
    hit, (key, hit_hash) = _named(found, F.col("row.key"), F.col("row.hash"))
    return hashed.join(hit.distinct(), F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(own_hash) == F.col(hit_hash)), "left_anti").drop(own_hash)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens; workers that have run the other stages remember fewer words."""
    _small_batches(spark)
    return packing.pieces(packing.pack(docs, memory_bytes=64 << 20))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_dedup", remove_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL can't express the learned and tokenized stages; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
