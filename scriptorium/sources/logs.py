"""JSON-lines logs: tolerant reads, appends, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_log(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = ("kind", "at"), newest: int | None = None, at: str = "at") -> DataFrame:
    """Rows of JSON lines; lines that aren't JSON and rows that lack a required field are left out. ``newest`` keeps the last rows by time."""
    rows = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    kept = rows.filter(F.col("_bad").isNull() & F.expr(" and ".join(f"`{c}` is not null" for c in required))).drop("_bad")
    return kept if newest is None else kept.orderBy(F.desc(at)).limit(newest)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def split_by_age(lines: DataFrame, cutoff: str) -> tuple[DataFrame, DataFrame]:
    """(kept, expired) raw lines: those whose at, timestamp or createdAt is before the cutoff have expired; lines without a readable time are kept."""
    at = F.coalesce(*[F.get_json_object("value", f"$.{c}") for c in ("at", "timestamp", "createdAt")])
    old = F.coalesce(F.try_to_timestamp(at) < F.lit(cutoff).cast("timestamp"), F.lit(False))
    marked = lines.withColumn("_old", old)
    return marked.filter(~F.col("_old")).drop("_old"), marked.filter("_old").drop("_old")


def rotate(spark: SparkSession, path: str, kept_to: str, archive_to: str, cutoff: str) -> None:
    """Write a log's lines that are still held to one folder and the expired ones, compressed, to another."""
    kept, expired = split_by_age(spark.read.text(path), cutoff)
    kept.write.text(kept_to)
    expired.write.option("compression", "gzip").text(archive_to)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; fields are quoted where needed, quotes doubled."""
    df.write.option("header", True).option("escape", '"').csv(path)
