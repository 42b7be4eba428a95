"""SQLite files: partitions, pushed filters and columns, and the databases of a library and a photo archive."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from scriptorium.sources import sqlite as source


@pytest.fixture
def pushing(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield spark
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def file(tmp_path, script, rows=()):
    path = str(tmp_path / "a b'.sqlite")
    con = sqlite3.connect(path)
    con.executescript(script)
    for sql, values in rows:
        con.executemany(sql, values)
    con.commit()
    con.close()
    return path


@pytest.fixture
def numbers(tmp_path):
    rows = [(k, f"n{k % 7}", k / 4, f"2020-01-{k % 28 + 1:02}", bytes([k % 256])) for k in range(1, 1001)]
    script = 'create table "odd ""name" (id integer primary key, name text collate nocase, size real, at datetime, raw blob)'
    return file(tmp_path, script, [('insert into "odd ""name" values (?, ?, ?, ?, ?)', rows), ('insert into "odd ""name" values (?, ?, ?, ?, ?)', [(5000, "N1", "much", None, "text")])])


def test_schema_partitions_and_values(spark, numbers):
    df = source.read_sqlite(spark, numbers, 'odd "name', rows=300)
    assert [t for _, t in df.dtypes] == ["bigint", "string", "double", "string", "binary"]
    assert df.rdd.getNumPartitions() == 17
    counts = df.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    assert sorted(r["count"] for r in counts) == [1, 100, 300, 300, 300]
    last = df.filter("id = 5000").first()
    assert (last.name, last.size, last.at, bytes(last.raw)) == ("N1", None, None, b"text")
    assert df.agg(F.sum("id"), F.sum("size")).first()[:] == (500500 + 5000, 500500 / 4)


def test_filters_and_columns_reach_the_file(pushing, numbers):
    df = source.read_sqlite(pushing, f"file://{numbers}", 'odd "name', ("id", "name"), rows=2000)
    found = df.filter("id >= 10 and id < 500 and name in ('n1', 'n2') and name is not null")
    plan = found._jdf.queryExecution().executedPlan().toString()
    # Spark no longer compares numbers, the file does
    assert df.columns == ["id", "name"] and "BatchScan sqlite_table" in plan and ">= 10" not in plan and "< 500" not in plan and "IN (n1,n2)" in plan
    assert sorted(r.id for r in found.collect()) == [k for k in range(10, 500) if k % 7 in (1, 2)]
    # collation of the file doesn't widen or narrow what Spark would find
    assert df.filter("name = 'n1'").count() == 143 and df.filter("name = 'N1'").count() == 1 and df.filter("name < 'a'").count() == 1
    reader = source.SqliteSource({"path": numbers, "table": 'odd "name', "push": "true"}).reader(df.schema)
    list(reader.pushFilters([source.GreaterThan(("id",), 990), source.EqualTo(("name",), "n3")]))
    batches = list(reader.read(source._Range(1, 2000)))
    assert sum(b.num_rows for b in batches) == sum(1 for k in range(991, 1001) if k % 7 == 3)


def test_tables_without_rows_or_rowids(spark, tmp_path):
    path = file(tmp_path, "create table none (a int); create table w (k text primary key, v int) without rowid; insert into w values ('x', 1), ('y', null)")
    assert source.read_sqlite(spark, path, "none").collect() == []
    assert sorted(map(tuple, source.read_sqlite(spark, path, "w").collect())) == [("x", 1), ("y", None)]
    with pytest.raises(Exception, match="no table"):
        source.read_sqlite(spark, path, "missing").collect()


LIBRARY = """
create table libraries (libraryID integer primary key, type text); insert into libraries values (1, 'user'), (2, 'group'), (3, 'feed');
create table groups (groupID integer primary key, libraryID int, name text); insert into groups values (77, 2, 'Team');
create table collections (collectionID integer primary key, collectionName text, parentCollectionID int, libraryID int, key text);
insert into collections values (1, 'Top', null, 1, 'C1'), (2, 'Sub', 1, 1, 'C2'), (3, 'Shared', null, 2, 'C3'), (4, 'Feed', null, 3, 'C4');
create table collectionItems (collectionID int, itemID int); insert into collectionItems values (1, 10), (2, 10), (1, 11), (3, 20), (1, 12);
create table itemTypes (itemTypeID integer primary key, typeName text); insert into itemTypes values (1, 'book'), (2, 'note'), (3, 'article'), (4, 'attachment');
create table items (itemID integer primary key, itemTypeID int, libraryID int, key text, dateAdded timestamp, dateModified timestamp);
insert into items values (10, 1, 1, 'I10', '2020-01-01', 'm'), (11, 3, 1, 'I11', '2020-01-02', 'm'), (12, 2, 1, 'I12', 'd', 'm'), (20, 1, 2, 'I20', 'd', 'm'), (30, 1, 3, 'I30', 'd', 'm'), (13, 4, 1, 'I13', 'd', 'm');
create table deletedItems (itemID integer primary key); insert into deletedItems values (11);
create table fields (fieldID integer primary key, fieldName text); insert into fields values (1, 'title'), (2, 'date');
create table itemDataValues (valueID integer primary key, value); insert into itemDataValues values (1, 'A Book'), (2, '1999'), (3, 2001);
create table itemData (itemID int, fieldID int, valueID int); insert into itemData values (10, 1, 1), (10, 2, 2), (20, 2, 3);
create table creators (creatorID integer primary key, firstName text, lastName text); insert into creators values (1, 'Ann', 'Bee'), (2, '', 'Sea');
create table creatorTypes (creatorTypeID integer primary key, creatorType text); insert into creatorTypes values (1, 'author'), (2, 'editor');
create table itemCreators (itemID int, creatorID int, creatorTypeID int, orderIndex int); insert into itemCreators values (10, 1, 2, 1), (10, 2, 1, 0);
create table tags (tagID integer primary key, name text); insert into tags values (1, 'z'), (2, 'a');
create table itemTags (itemID int, tagID int); insert into itemTags values (10, 1), (10, 2);
"""


def test_library(spark, tmp_path):
    path = file(tmp_path, LIBRARY)
    assert sorted(map(tuple, source.libraries(spark, path).collect())) == [(1, "user", "My Library", None), (2, "group", "Team", 77)]
    assert sorted(tuple(r) for r in source.library_collections(spark, path).select("key", "name", F.coalesce("parent", F.lit("-"))).collect()) == [("C1", "Top", "-"), ("C2", "Sub", "C1"), ("C3", "[Team] Shared", "-")]
    assert sorted(r.name for r in source.library_collections(spark, path, 2).collect()) == ["Shared"]
    items = {r.key: r for r in source.library_items(spark, path).collect()}
    assert items.keys() == {"I10", "I20"}
    book = items["I10"]
    assert book.fields == {"title": "A Book", "date": "1999"} and book.tags == ["a", "z"] and book.collections == ["C1", "C2"]
    assert [tuple(c) for c in book.creators] == [("", "Sea", "author"), ("Ann", "Bee", "editor")]
    assert items["I20"].fields == {"date": "2001"} and items["I20"].creators == [] and items["I20"].tags == []
    assert {r.key for r in source.library_items(spark, path, collection="C1").collect()} == {"I10", "I11"}
    assert {r.key for r in source.library_items(spark, path, library=2).collect()} == {"I20"}
    assert {r.key for r in source.library_items(spark, path, collection="C1", item_type="article").collect()} == {"I11"}


ARCHIVE = """
create table items (id integer primary key); insert into items values (1), (2);
create table subjects (id integer primary key, template text, type text); insert into subjects values (1, 'T', 'letter');
create table metadata (id int, property text, value_id int); insert into metadata values (1, 'http://x/terms/title', 1), (1, 'http://x/terms#date', 2), (2, 'nothing', 1);
create table metadata_values (value_id integer primary key, text text); insert into metadata_values values (1, 'A Letter'), (2, '1916');
create table tags (tag_id integer primary key, name text); insert into tags values (1, 'war');
create table taggings (tag_id int, id int); insert into taggings values (1, 1);
create table notes (note_id integer primary key, id int, text text, state text, deleted text); insert into notes values (1, 1, 'item note', null, null), (2, 5, 'photo note', null, null), (3, 1, 'gone', null, 'x'), (4, 9, 'part', null, null);
create table photos (id integer primary key, item_id int, path text, filename text, position int); insert into photos values (5, 1, '/a/b.jpg', '', 1), (6, 1, '/a/c.jpg', 'c', 0);
create table selections (id integer primary key, photo_id int, x int, y int); insert into selections values (9, 5, 3, 4);
create table images (id integer primary key, width int, height int, angle real); insert into images values (9, 20, 30, null);
"""


def test_photo_archive(spark, tmp_path):
    rows = {r.item_id: r for r in source.archive_project(spark, file(tmp_path, ARCHIVE)).collect()}
    one = rows[1]
    assert (one.template, one.type, one.fields, one.tags) == ("T", "letter", {"title": "A Letter", "date": "1916"}, ["war"])
    assert [n.text for n in one.notes] == ["item note"] and [p.filename for p in one.photos] == ["c", "b.jpg"]
    assert [n.text for n in one.photos[1].notes] == ["photo note"]
    (part,) = one.photos[1].selections
    assert (part.x, part.y, part.width, part.height, part.angle, part.notes[0].text) == (3, 4, 20, 30, 0, "part")
    assert rows[2].photos is None or rows[2].photos == []
