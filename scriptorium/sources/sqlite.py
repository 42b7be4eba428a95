"""SQLite files as partitioned Spark tables, and the library and photo archive databases kept in them.

``read_sqlite`` reads one table through a Python data source: the schema comes from the table's declaration,
columns that aren't asked for are not read, filters go into the file's own query, and ranges of rowids are
partitions that tasks read apart, each over its own read-only connection. The file must lie where all executors
see it under one path.

Defined results: values that don't fit their column's declared type are null, also for filters; tables without rowids are one partition; an empty table gives no rows.
"""

from __future__ import annotations

import re
import sqlite3
from collections.abc import Iterable, Iterator
from contextlib import closing
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from scriptorium.operators import archive

ROWS_A_PARTITION, BATCH_ROWS = 500_000, 8192
_SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
_ARROW = {T.LongType: pa.int64(), T.DoubleType: pa.float64(), T.BinaryType: pa.binary(), T.StringType: pa.string()}


def _connect(path: str) -> sqlite3.Connection:
    """A read-only connection; nothing beside the file is looked for or made."""
    local = re.sub(r"^file:(//)?(?=/)", "", path)
    return sqlite3.connect(f"file:{quote(local)}?mode=ro&immutable=1", uri=True)


def _name(x: str) -> str:
    return '"' + x.replace('"', '""') + '"'


def _kind(declared: str) -> T.DataType:
    """By the rules of type affinity; dates are text."""
    d = declared.upper()
    if "INT" in d or "BOOL" in d:
        return T.LongType()
    if any(x in d for x in ("CHAR", "CLOB", "TEXT", "DATE", "TIME")):
        return T.StringType()
    if any(x in d for x in ("REAL", "FLOA", "DOUB", "NUM", "DEC")):
        return T.DoubleType()
    return T.BinaryType() if "BLOB" in d else T.StringType()


def _value(x, kind: T.DataType):
    """A stored value as one of a column's type, or null."""
    if x is None:
        return None
    if isinstance(kind, T.StringType):
        return x if isinstance(x, str) else str(x) if isinstance(x, (int, float)) else x.decode("utf-8", "replace")
    if isinstance(kind, T.BinaryType):
        return x if isinstance(x, bytes) else str(x).encode()
    if isinstance(kind, T.LongType):
        return x if isinstance(x, int) else int(x) if isinstance(x, float) and x.is_integer() else None
    return float(x) if isinstance(x, (int, float)) else None


@dataclass
class _Range(InputPartition):
    first: int | None
    last: int | None


class SqliteSource(DataSource):
    """Options: path, table, columns (joined by line ends; all if none), rows (per partition)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> T.StructType:
        with closing(_connect(self.options["path"])) as con:
            declared = {r[1]: r[2] for r in con.execute(f"pragma table_info({_name(self.options['table'])})")}
        if not declared:
            raise ValueError(f"no table {self.options['table']} in {self.options['path']}")
        asked = self.options.get("columns", "")
        return T.StructType([T.StructField(c, _kind(declared[c])) for c in (asked.split("\n") if asked else declared)])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return (_PushingReader if self.options.get("push") == "true" else _Reader)(self.options, schema)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType) -> None:
        self.path, self.table, self.rows = options["path"], options["table"], int(options.get("rows", ROWS_A_PARTITION))
        self.schema = schema
        self.conditions: list[str] = []
        self.values: list = []

    def partitions(self) -> list[InputPartition]:
        with closing(_connect(self.path)) as con:
            try:
                low, high = con.execute(f"select min(rowid), max(rowid) from {_name(self.table)}").fetchone()
            except sqlite3.OperationalError:
                return [_Range(None, None)]
        if low is None:
            return [_Range(0, -1)]
        return [_Range(i, min(i + self.rows - 1, high)) for i in range(low, high + 1, self.rows)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        conditions, values = list(self.conditions), list(self.values)
        if partition.first is not None:
            conditions.insert(0, "rowid between ? and ?")
            values[:0] = [partition.first, partition.last]
        where = f" where {' and '.join(conditions)}" if conditions else ""
        arrow = pa.schema([(f.name, _ARROW[type(f.dataType)]) for f in self.schema])
        with closing(_connect(self.path)) as con:
            cursor = con.execute(f"select {', '.join(map(_name, self.schema.names))} from {_name(self.table)}{where}", values)
            while rows := cursor.fetchmany(BATCH_ROWS):
                columns = [pa.array([_value(x, f.dataType) for x in column], t) for f, t, column in zip(self.schema, arrow.types, zip(*rows))]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)


class _PushingReader(_Reader):
    """For sessions that let Python sources see filters; Spark refuses this method in others."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return [f for f in filters if not self._push(f)]

    def _push(self, f: Filter) -> bool:
        """Put a filter into the query, if it can be; whether Spark needn't check it again."""
        if len(getattr(f, "attribute", ())) != 1 or f.attribute[0] not in self.schema.names:
            return False
        kind, column = self.schema[f.attribute[0]].dataType, _name(f.attribute[0])
        if isinstance(kind, T.BinaryType):
            return False
        number = not isinstance(kind, T.StringType)
        # numbers that aren't of the column's kind are null; text is compared as bytes, whatever the column's collation, and checked again
        side = column if number else f"cast({column} as text) collate binary"
        if isinstance(f, IsNotNull):
            condition = f"{column} is not null"
        elif isinstance(f, EqualTo) or type(f) in _SIGNS and number:
            condition = f"{side} {_SIGNS[type(f)]} ?"
            self.values.append(f.value)
        elif isinstance(f, In):
            condition = f"{side} in ({', '.join('?' * len(f.value))})"
            self.values += f.value
        else:
            return False
        kinds = {T.LongType: "('integer')", T.DoubleType: "('integer', 'real')"}.get(type(kind))
        self.conditions.append(f"typeof({column}) in {kinds} and {condition}" if number else condition)
        return number


def read_sqlite(spark: SparkSession, path: str, table: str, columns: tuple[str, ...] = (), rows: int = ROWS_A_PARTITION) -> DataFrame:
    """A table of a SQLite file. Filters on the frame reach the file where the session lets them (spark.sql.python.filterPushdown.enabled)."""
    spark.dataSource.register(SqliteSource)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format(SqliteSource.name()).options(path=path, table=table, columns="\n".join(columns), rows=str(rows), push=push).load()


# --- library ---------------------------------------------------------------------------------------

# Kinds of items that aren't listed, kinds of libraries that are, the name of the own library.
PARTS_OF_ITEMS, LIBRARIES, OWN = ("attachment", "note"), ("user", "group"), "My Library"


def libraries(spark: SparkSession, path: str) -> DataFrame:
    """(libraryID, type, name, groupID): the own library and groups."""
    groups = read_sqlite(spark, path, "groups", ("libraryID", "name", "groupID"))
    known = read_sqlite(spark, path, "libraries", ("libraryID", "type")).filter(F.col("type").isin(*LIBRARIES))
    return known.join(groups, "libraryID", "left").select("libraryID", "type", F.coalesce("name", F.lit(OWN)).alias("name"), "groupID")


def library_collections(spark: SparkSession, path: str, library: int | None = None) -> DataFrame:
    """(key, name, parent, libraryID) of one library's collections, or of all; then those of a group have its name before theirs."""
    own = read_sqlite(spark, path, "collections", ("collectionID", "collectionName", "key", "parentCollectionID", "libraryID"))
    parents = own.select(F.col("collectionID").alias("parentCollectionID"), F.col("key").alias("parent"))
    named = own.join(parents, "parentCollectionID", "left")
    if library is not None:
        return named.filter(F.col("libraryID") == library).select("key", F.col("collectionName").alias("name"), "parent", "libraryID")
    of = libraries(spark, path).select("libraryID", "type", F.when(F.col("groupID").isNotNull(), F.col("name")).alias("group"))
    prefix = F.when((F.col("type") == "group") & (F.coalesce("group", F.lit("")) != ""), F.concat(F.lit("["), "group", F.lit("] "))).otherwise("")
    return named.join(of, "libraryID").select("key", F.concat(prefix, "collectionName").alias("name"), "parent", "libraryID")


def library_items(spark: SparkSession, path: str, library: int | None = None, collection: str | None = None, item_type: str | None = None) -> DataFrame:
    """One row per item: itemID, key, dateAdded, dateModified, itemType, fields (map), creators in order, tags, collections.

    Items of a collection, of a library, or of all libraries; deleted ones are left out, but for a
    collection's, and so are attachments and notes.
    """
    read = lambda table, *columns: read_sqlite(spark, path, table, columns)
    kinds = read("itemTypes", "itemTypeID", "typeName").filter(~F.col("typeName").isin(*PARTS_OF_ITEMS))
    items = read("items", "itemID", "itemTypeID", "libraryID", "key", "dateAdded", "dateModified")
    placed = read("collectionItems", "collectionID", "itemID").join(read("collections", "collectionID", "key").withColumnRenamed("key", "collection"), "collectionID")
    if collection is not None:
        items = items.join(placed.filter(F.col("collection") == collection).select("itemID").distinct(), "itemID", "left_semi")
    else:
        items = items.filter(F.col("libraryID") == library) if library is not None else items.join(libraries(spark, path), "libraryID", "left_semi")
        items = items.join(read("deletedItems", "itemID"), "itemID", "left_anti")
    chosen = items.join(kinds.filter(F.col("typeName") == item_type) if item_type else kinds, "itemTypeID")
    values = read("itemData", "itemID", "fieldID", "valueID").join(read("fields", "fieldID", "fieldName"), "fieldID").join(read("itemDataValues", "valueID", "value"), "valueID")
    fields = values.groupBy("itemID").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("fieldName", "value")))).alias("fields"))
    people = read("itemCreators", "itemID", "creatorID", "creatorTypeID", "orderIndex").join(read("creators", "creatorID", "firstName", "lastName"), "creatorID").join(read("creatorTypes", "creatorTypeID", "creatorType"), "creatorTypeID")
    ordered = F.array_sort(F.collect_list(F.struct("orderIndex", "firstName", "lastName", "creatorType")))
    creators = people.groupBy("itemID").agg(F.transform(ordered, lambda x: x.dropFields("orderIndex")).alias("creators"))
    tags = read("itemTags", "itemID", "tagID").join(read("tags", "tagID", "name"), "tagID").groupBy("itemID").agg(F.array_sort(F.collect_set("name")).alias("tags"))
    collections = placed.groupBy("itemID").agg(F.array_sort(F.collect_set("collection")).alias("collections"))
    joined = chosen
    for side in (fields, creators, tags, collections):
        joined = joined.join(side, "itemID", "left")
    none = lambda c, kind: F.coalesce(c, F.expr(f"cast({kind} as {dict(joined.dtypes)[c]})")).alias(c)
    return joined.select("itemID", "key", "dateAdded", "dateModified", F.col("typeName").alias("itemType"), none("fields", "map()"), none("creators", "array()"), none("tags", "array()"), none("collections", "array()"))


# --- photo archive ---------------------------------------------------------------------------------


def archive_project(spark: SparkSession, path: str) -> DataFrame:
    """The items of a photo archive's file, as archive.archive_items has them."""
    read = lambda table, *columns: read_sqlite(spark, path, table, columns)
    as_item = lambda df: df.withColumnRenamed("id", "item_id")
    metadata = as_item(read("metadata", "id", "property", "value_id")).join(read("metadata_values", "value_id", "text").withColumnRenamed("text", "value"), "value_id")
    taggings = as_item(read("taggings", "id", "tag_id")).join(read("tags", "tag_id", "name").withColumnRenamed("name", "tag"), "tag_id").select("item_id", "tag")
    return archive.archive_items(
        as_item(read("items", "id")),
        as_item(read("subjects", "id", "template", "type")),
        metadata,
        taggings,
        read("notes", "note_id", "id", "text", "deleted").withColumnRenamed("id", "owner"),
        read("photos", "id", "item_id", "path", "filename", "position").withColumnRenamed("id", "photo_id"),
        read("selections", "id", "photo_id", "x", "y").withColumnRenamed("id", "selection_id"),
        read("images", "id", "width", "height", "angle").withColumnRenamed("id", "image_id"),
    )
