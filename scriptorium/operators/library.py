"""Library upkeep: attachments, metadata, files, collections, index health, redaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_attachments(citations: DataFrame, items: DataFrame, key: str = "key", title: str = "title", item: str = "item_id") -> DataFrame:
    """Adds the item that has the citation's key or, case ignored, its title; the least item wins.

    The least item of each key and of each title comes first, so a citation meets one row of each, however many items share a title.
    """
    least = lambda by, to: items.filter(by.isNotNull()).groupBy(by.alias(to)).agg(F.min(item).alias(f"{to}_item"))
    own = citations.select(key, F.lower(title).alias("_title"))
    named = own.join(least(F.lower("title"), "_title"), "_title", "left").groupBy(key).agg(F.min("_title_item").alias("_title_item"))
    keyed = named.join(least(F.col("item_key"), "_key"), F.col(key) == F.col("_key"), "left")
    first = keyed.select(key, F.least("_title_item", "_key_item").alias(item))
    return citations.join(first, key, "left")


def with_metadata(citations: DataFrame, metadata: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fields of the metadata where it has them, else those of the citation."""
    m = metadata.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    return citations.join(m, key, "left").withColumns({f: F.coalesce(f"_{f}", f) for f in fields}).drop(*[f"_{f}" for f in fields])


def rekeyed(metadata: DataFrame, new: str, old: str, to: str = "key") -> DataFrame:
    """The new key where there is one, else the old."""
    return metadata.withColumn(to, F.coalesce(new, old))


def members_of(documents: DataFrame, members: DataFrame, key: str = "bibtex_key") -> DataFrame:
    """(doc_id, collection) of documents whose key a collection lists."""
    return documents.filter(F.col(key).isNotNull()).join(members.select(key, "collection").distinct(), key).select("doc_id", "collection")


def allowed(documents: DataFrame | None, collections: DataFrame | None, key: str = "doc_id") -> DataFrame | None:
    """Keys in all lists that are given; None, no filter, where none is; an empty list allows nothing."""
    lists = [x.select(key).distinct() for x in (documents, collections) if x is not None]
    if not lists:
        return None
    return lists[0] if len(lists) == 1 else lists[0].join(lists[1], key, "left_semi")


def merged_attachments(local: DataFrame, remote: DataFrame, key: str = "key", kept: str = "downloaded") -> DataFrame:
    """The remote attachments, with the local value of what was kept, false where it is new."""
    return remote.drop(kept).join(local.select(key, kept), key, "left").withColumn(kept, F.coalesce(kept, F.lit(False)))


def orphan_files(files: DataFrame, linked: DataFrame, path: str = "path") -> DataFrame:
    """Files that nothing links to; paths are compared without case and with forward slashes."""
    form = lambda c: F.lower(F.replace(F.col(c), F.lit("\\"), F.lit("/")))
    return files.withColumn("_p", form(path)).join(linked.select(form(path).alias("_p")).distinct(), "_p", "left_anti").drop("_p")


def changed_files(stored: DataFrame, files: DataFrame, path: str = "path", digest: str = "digest") -> DataFrame:
    """(path, reason): files that are missing or whose digest differs from the stored one."""
    now = files.select(path, F.col(digest).alias("_now"))
    reason = F.when(F.col("_now").isNull(), "missing").when(F.col("_now") != F.col(digest), "modified")
    return stored.join(now, path, "left").select(path, reason.alias("reason")).filter("reason is not null")


def needs_sync(projects: DataFrame, files: DataFrame, key: str = "project") -> DataFrame:
    """Projects whose path moved or whose file changed after the last sync."""
    now = files.select(key, F.col("path").alias("_path"), "modified")
    return projects.join(now, key).filter((F.col("path") != F.col("_path")) | (F.col("modified") > F.col("synced"))).select(key)


def dominant_dimension(vectors: DataFrame, key: str, embedding: str = "embedding") -> DataFrame:
    """One row: the most frequent length of the vectors; of equally frequent ones that of the least key."""
    sizes = vectors.filter(F.col(embedding).isNotNull()).groupBy(F.size(embedding).alias("dimension")).agg(F.count(F.lit(1)).alias("vectors"), F.min(key).alias("_first"))
    return sizes.orderBy(F.desc("vectors"), "_first").limit(1).select(F.col("dimension").cast("long").alias("dimension"), "vectors")


def index_health(stored: DataFrame, indexed: DataFrame, by: str, most: float = 0.1) -> DataFrame:
    """(by, stored, indexed, rebuild): an index whose size is off by more than a tenth is to be built anew."""
    a = stored.groupBy(by).agg(F.count(F.lit(1)).alias("stored"))
    b = indexed.groupBy(by).agg(F.count(F.lit(1)).alias("indexed"))
    both = a.join(b, by, "full_outer").withColumn("stored", F.coalesce("stored", F.lit(0)).cast("long")).withColumn("indexed", F.coalesce("indexed", F.lit(0)).cast("long"))
    return both.withColumn("rebuild", F.abs(F.col("stored") - F.col("indexed")) > F.col("stored") * most)


def redacted(df: DataFrame, sensitive: list[str]) -> DataFrame:
    """Sensitive text columns as their digest and length."""
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.struct(F.sha2(F.col(c), 256).alias("sha256"), F.length(c).cast("long").alias("length"))) for c in sensitive})


def first_unseen(store: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Rows of a store whose key the manifest no longer has."""
    return store.join(manifest.select(key).distinct(), key, "left_anti")


def latest_analysis(runs: DataFrame, by: str, at: str, key: str) -> DataFrame:
    """The newest run of each corpus; of runs at one time that with the least key."""
    w = Window.partitionBy(by).orderBy(F.desc(at), key)
    return runs.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
