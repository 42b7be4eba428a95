"""Relations between entities as a stored state that takes deltas: a weight and the set of sources of each pair.

A delta is one save: rows (first, second, source), each of which adds one to its pair's weight and its source to the pair's set. A
delta is combined by itself and written beside the state as rows (a, b, source, n), so taking it in reads nothing
else; a reader sums what was written completely. ``compact`` folds deltas into a new base whose list of deltas
says what it holds. A delta that is taken in again, before or after that, changes nothing; one that broke off is not read, and is
written anew when it comes again. Sources stay rows, so no pair's set has to fit a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.sources.tables import parts_for


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _complete(spark: SparkSession, path: str) -> bool:
    p, fs = _files(spark, f"{path}/_SUCCESS")
    return fs.exists(p)


def _listed(spark: SparkSession, path: str, kind: str) -> dict[str, str]:
    """The names of complete deltas or bases with their paths."""
    p, fs = _files(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return {n.partition("=")[2]: f"{path}/{n}" for n in names if n.startswith(f"{kind}=") and _complete(spark, f"{path}/{n}/rows")}


def _state(spark: SparkSession, path: str) -> tuple[str | None, set[str], dict[str, str]]:
    """The newest base, the deltas that it holds, and the deltas besides."""
    bases, deltas = _listed(spark, path, "base"), _listed(spark, path, "delta")
    if not bases:
        return None, set(), deltas
    newest = max(bases, key=int)
    held = {r["delta"] for r in spark.read.schema("delta string").json(f"{bases[newest]}/held").collect()}  # a row a delta
    return newest, held, {k: p for k, p in deltas.items() if k not in held}


def take_in(links: DataFrame, path: str, delta: str) -> bool:
    """Add a delta with a name of its own, made of letters, digits, - and _; whether it was new. Links of an entity with itself and nulls are left out."""
    spark = links.sparkSession
    if not delta.replace("-", "").replace("_", "").isalnum():
        raise ValueError(f"not a name for a delta: {delta}")
    _, held, open_deltas = _state(spark, path)
    if delta in held or delta in open_deltas:
        return False
    pairs = links.filter("first <> second and source is not null").select(F.least("first", "second").alias("a"), F.greatest("first", "second").alias("b"), "source")
    pairs.groupBy("a", "b", "source").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/delta={delta}/rows")
    return True


def sources(spark: SparkSession, path: str) -> DataFrame | None:
    """(a, b, source, n) of all deltas; a source may come once a delta. None before the first delta."""
    newest, _, deltas = _state(spark, path)
    parts = [*([f"{path}/base={newest}"] if newest is not None else []), *(deltas[k] for k in sorted(deltas))]
    return spark.read.parquet(*[f"{p}/rows" for p in parts]) if parts else None


def _dealt(rows: DataFrame) -> DataFrame:
    """Stored rows by pair, to tasks by their number."""
    return rows.repartition(parts_for(rows.sparkSession, rows.count()), "a", "b")


def relations(spark: SparkSession, path: str) -> DataFrame | None:
    """(a, b, weight, sources): the sum of a pair's links and the number of its different sources."""
    rows = sources(spark, path)
    if rows is None:
        return None
    once = _dealt(rows).groupBy("a", "b", "source").agg(F.sum("n").alias("n"))
    return once.groupBy("a", "b").agg(F.sum("n").alias("weight"), F.count(F.lit(1)).alias("sources"))


def compact(spark: SparkSession, path: str) -> None:
    """Fold the deltas beside the newest base into a new one. Older bases and folded deltas stay until they are removed by their owner."""
    newest, held, deltas = _state(spark, path)
    if not deltas:
        return
    base = f"{path}/base={int(newest or 0) + 1}"
    spark.createDataFrame([(k,) for k in sorted(held | set(deltas))], "delta string").coalesce(1).write.mode("overwrite").json(f"{base}/held")
    rows = _dealt(sources(spark, path)).groupBy("a", "b", "source").agg(F.sum("n").alias("n"))
    rows.write.mode("overwrite").parquet(f"{base}/rows")  # from here on the base counts
