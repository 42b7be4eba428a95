"""Bibliography statistics, facets, hierarchies, and merging of collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators.graph import shared_pairs
from scriptorium.sources.tables import parts_for, stored


def shares(df: DataFrame, by: str, digits: int = 1) -> DataFrame:
    """(by, count, percent): percent of all counted rows, to a decimal place."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count").alias("all"))
    return counts.crossJoin(F.broadcast(total)).select(by, "count", F.round(F.lit(100.0) * F.col("count") / F.col("all"), digits).alias("percent"))


def by_year(df: DataFrame, year: str) -> DataFrame:
    """Counts by year, rows without one as Unknown and last."""
    label = F.coalesce(F.col(year).cast("string"), F.lit("Unknown"))
    counts = shares(df.withColumn("_year", label), "_year").withColumnRenamed("_year", "year")
    return counts.orderBy(F.col("year") == "Unknown", F.expr("try_cast(year as int)"))


def timeline(df: DataFrame, year: str) -> DataFrame:
    """(year, annual, cumulative). Years are few; the window runs over their counts."""
    annual = df.filter(F.col(year).isNotNull()).groupBy(F.col(year).alias("year")).agg(F.count(F.lit(1)).alias("annual"))
    return annual.withColumn("cumulative", F.sum("annual").over(Window.orderBy("year").rowsBetween(Window.unboundedPreceding, 0)))


def pivoted(df: DataFrame, row: str, column: str, values: list[object], prefix: str) -> DataFrame:
    """Counts of a column's values as columns; a list of values spares the pass that finds them."""
    counts = df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1)))
    return counts.select(row, *[F.col(str(v)).alias(f"{prefix}{v}") for v in values])


def split_authors(authors: Column) -> Column:
    return F.filter(F.transform(F.split(authors, r"\s+and\s+|,|;"), lambda a: F.trim(a)), lambda a: a != "")


def author_statistics(df: DataFrame, key: str, author: str, year: str) -> DataFrame:
    """(author, works, coauthors, years) from rows of one author and work each. Works with a very long list of authors cost its square."""
    # a pair once, then counted at both of its ends
    pairs = shared_pairs(df, author, key).distinct()
    others = pairs.select(F.explode(F.array("a", "b")).alias(author)).groupBy(author).agg(F.count(F.lit(1)).alias("coauthors"))
    once = df.select(key, author).repartition(parts_for(df.sparkSession, df.count()), key).distinct()
    works = once.groupBy(author).agg(F.count(key).alias("works"))
    years = df.groupBy(F.col(author).alias("_author")).agg(F.array_sort(F.collect_set(year)).alias("years"))
    own = works.join(years, F.col(author).eqNullSafe(F.col("_author"))).join(others, author, "left")
    return own.select(author, "works", "years", F.coalesce("coauthors", F.lit(0)).cast("long").alias("coauthors"))


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: rows with a value, and their percent."""
    counted = df.agg(F.count(F.lit(1)).alias("all"), *[F.count(F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), 1)).alias(c) for c in columns])
    stacked = counted.select("all", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("filled")) for c in columns])).alias("x"))
    return stacked.select("x.field", "x.filled", F.round(F.coalesce(F.try_divide(F.lit(100.0) * F.col("x.filled"), F.col("all")), F.lit(0.0)), 1).alias("percent"))


def faceted(df: DataFrame, text: str | None = None, fields: tuple[str, ...] = (), any_of: list[str] | None = None, all_of: list[str] | None = None, tags: str = "tags", **equal: object) -> DataFrame:
    """Rows that hold a text in one of the fields, any or all of the chosen tags, and the given values."""
    out = df
    if text:
        found = None
        for f in fields:
            hit = F.coalesce(F.lower(F.col(f)).contains(text.lower()), F.lit(False))
            found = hit if found is None else found | hit
        out = out.filter(found)
    if any_of:
        out = out.filter(F.arrays_overlap(tags, F.array(*[F.lit(t) for t in any_of])))
    if all_of:
        out = out.filter(F.size(F.array_except(F.array(*[F.lit(t) for t in all_of]), tags)) == 0)
    for name, value in equal.items():
        if value is not None:
            out = out.filter(F.col(name) == value)
    return out


def tag_counts(df: DataFrame, tags: str = "tags") -> DataFrame:
    return df.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("count")).orderBy("tag")


def first_spellings(df: DataFrame, key: str, tags: str = "tags") -> DataFrame:
    """Tags without later spellings that differ in case only."""
    lowered = F.transform(tags, F.lower)
    return df.select(key, F.filter(tags, lambda t, i: F.array_position(lowered, F.lower(t)) == i + 1).alias(tags))


# --- hierarchies -------------------------------------------------------------------------------


def closure(nodes: DataFrame, roots: DataFrame, key: str = "key", parent: str = "parent") -> DataFrame:
    """(key, level, path): what can be reached from the roots, level by level until nothing is new; each node once, so cycles end. Levels are written down."""
    front = stored(roots.select(key).distinct().withColumn("level", F.lit(0)).withColumn("path", F.array(F.col(key).cast("string"))))
    seen, edges, level = front, nodes.select(key, F.col(parent).alias("_up")), 0
    while not front.isEmpty():
        level += 1
        up = front.select(F.col(key).alias("_up"), "path")
        found = edges.join(up, "_up").select(key, F.lit(level).alias("level"), F.concat("path", F.array(F.col(key).cast("string"))).alias("path"))
        front = stored(found.join(seen.select(key), key, "left_anti").groupBy(key).agg(F.min(F.struct("level", "path")).alias("x")).select(key, "x.level", "x.path"))
        seen = seen.unionByName(front)
    return seen


def depth_first(nodes: DataFrame, key: str = "key", parent: str = "parent", name: str = "name") -> DataFrame:
    """Nodes with level, ordered so that children follow their parent by name; nodes whose parent is missing vanish, and a node below itself is left out."""
    label = F.concat_ws("\u0001", F.col(name), F.col(key).cast("string"))
    front = stored(nodes.filter(F.col(parent).isNull()).select(key, name, parent, F.lit(0).alias("level"), label.alias("path"), F.array(key).alias("_above")))
    out, edges, level = front, nodes.select(key, name, parent, label.alias("_label")), 0
    while not front.isEmpty():
        level += 1
        up = front.select(F.col(key).alias("_up"), F.col("path").alias("_path"), "_above")
        below = edges.join(up, (F.col(parent) == F.col("_up")) & ~F.array_contains("_above", F.col(key)))
        front = stored(below.select(key, name, parent, F.lit(level).alias("level"), F.concat("_path", F.lit("\u0002"), "_label").alias("path"), F.concat("_above", F.array(key)).alias("_above")))
        out = out.unionByName(front)
    return out.drop("_above").orderBy("path")


# --- change and merge --------------------------------------------------------------------------


def differences(local: DataFrame, remote: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, status, changed): added, deleted, modified with the names of differing fields, or unchanged."""
    a = local.select(key, F.struct(*fields).alias("local"))
    b = remote.select(key, F.struct(*fields).alias("remote"))
    joined = a.join(b, key, "full_outer")
    norm = lambda side, f: F.lower(F.trim(F.coalesce(F.col(f"{side}.{f}").cast("string"), F.lit(""))))
    changed = F.array_compact(F.array(*[F.when(norm("local", f) != norm("remote", f), F.lit(f)) for f in fields]))
    status = F.when(F.isnull("local"), "added").when(F.isnull("remote"), "deleted").when(F.size(changed) > 0, "modified").otherwise("unchanged")
    both = F.col("local").isNotNull() & F.col("remote").isNotNull()
    return joined.select(key, status.alias("status"), F.when(both, changed).otherwise(F.array().cast("array<string>")).alias("changed"))


def apply_remote(local: DataFrame, remote: DataFrame, key: str, kept_local: tuple[str, ...] = ()) -> DataFrame:
    """The remote rows; of the named columns the local values, where there are any."""
    mine = local.select(key, *[F.col(c).alias(f"_{c}") for c in kept_local])
    out = remote.join(mine, key, "left")
    for c in kept_local:
        out = out.withColumn(c, F.coalesce(f"_{c}", c))
    return out.select(*remote.columns)


def apply_local(local: DataFrame, remote: DataFrame, key: str) -> DataFrame:
    """The local rows, and remote ones that are new."""
    return local.unionByName(remote.join(local.select(key), key, "left_anti"), allowMissingColumns=True)


def apply_choices(local: DataFrame, remote: DataFrame, choices: DataFrame, key: str) -> DataFrame:
    """For each key of ``choices`` (key, choice) the local or the remote row; other rows stay local."""
    take = choices.filter("choice = 'remote'").select(key)
    return local.join(take, key, "left_anti").unionByName(remote.join(take, key, "left_semi"), allowMissingColumns=True)


def layered(rows: DataFrame, key: str, layer: str, order: list[str]) -> DataFrame:
    """Of the rows with one key that of the first layer."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(layer))
    w = Window.partitionBy(key).orderBy(place)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def latest(rows: DataFrame, key: list[str], version: str, tie: str | None = None) -> DataFrame:
    """Upsert: of the rows with one key the newest. max_by combines before the shuffle, where a window would sort whole groups."""
    others = [c for c in rows.columns if c not in key]
    order = F.struct(version, *([tie] if tie else []))
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*others), order).alias("_row"))
    return best.select(*key, *[F.col(f"_row.{c}").alias(c) for c in others]).select(*rows.columns)


def replace_children(children: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """Children of parents that have new ones are replaced by these."""
    return children.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def without_parents(children: DataFrame, removed: DataFrame, parent: str) -> DataFrame:
    """Cascade: children of removed parents go."""
    return children.join(removed.select(parent).distinct(), parent, "left_anti")


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children without a parent; a null reference is one."""
    return children.join(parents.select(F.col(parent_key).alias("_parent")).distinct(), F.col(child_key) == F.col("_parent"), "left_anti")


def imported(existing: DataFrame, legacy: DataFrame, key: str) -> DataFrame:
    """Existing rows and those of the other source with new keys, each key once."""
    return existing.unionByName(legacy.join(existing.select(key), key, "left_anti").dropDuplicates([key]), allowMissingColumns=True)


def changed_contents(stored: DataFrame, current: DataFrame, key: str, hash_column: str = "hash", content: str = "content") -> DataFrame:
    """(key, status) of an incremental index: new, changed, unchanged, or vanished."""
    now = current.select(key, F.sha2(F.col(content), 256).alias("_now"))
    joined = stored.select(key, F.col(hash_column).alias("_then")).join(now, key, "full_outer")
    status = F.when(F.isnull("_then"), "new").when(F.isnull("_now"), "vanished").when(F.col("_then") != F.col("_now"), "changed").otherwise("unchanged")
    return joined.select(key, status.alias("status"))


def wide_items(values: DataFrame, item: str = "item_id", field: str = "field", value: str = "value") -> DataFrame:
    """Entity-attribute-value rows as a map per item; of a repeated field the least value."""
    once = values.groupBy(item, field).agg(F.min(value).alias(value))
    return once.groupBy(item).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(field, value)))).alias("fields"))


def ordered_list(rows: DataFrame, by: str, order: list[str], value: str, to: str) -> DataFrame:
    """Values of each group as an array in the order of other columns."""
    return rows.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, value))), lambda x: x[value]).alias(to))
