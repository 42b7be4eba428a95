from datetime import datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.streaming import bursts
from scriptorium.streaming import events as stream


def put(spark, folder, number, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return number


def test_sessions_close_with_the_watermark(spark, tmp_path):
    schema = "user_id long, ts string"
    rows = [(1, "2024-01-01 10:00:00"), (1, "2024-01-01 10:30:00"), (1, "2024-01-01 11:00:01"), (2, "2024-01-01 10:05:00"), (3, "2024-01-01 15:00:00")]
    put(spark, tmp_path, 0, rows, schema)
    source = stream.read_table_stream(spark, f"{tmp_path}/in")
    found = stream.closed_sessions(source.withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts")
    stream.run_available(found, str(tmp_path / "out"))
    got = sorted((r.user_id, str(r.started)[11:], str(r.ended)[11:], r.events) for r in spark.read.parquet(str(tmp_path / "out/rows")).collect())
    assert got == [(1, "10:00:00", "10:30:00", 2), (1, "11:00:01", "11:00:01", 1), (2, "10:05:00", "10:05:00", 1)]


def test_changed_contents_over_batches(spark, tmp_path):
    schema = "path string, text string"
    seen = []
    for rows in ([("a", "1"), ("b", "1")], [("a", "2"), ("b", "1"), ("c", None)], [("c", "")]):
        put(spark, tmp_path, 0, rows, schema)
        source = stream.read_table_stream(spark, f"{tmp_path}/in")
        before = len(seen)
        stream.run_available(stream.changed_contents(source, "path", "text"), str(tmp_path / "out"))
        every = sorted((r.path, r.status) for r in spark.read.parquet(str(tmp_path / "out/rows")).collect())
        for x in seen:
            every.remove(x)
        seen += every
        assert len(seen) - before == len(rows)
    assert seen == [("a", "new"), ("b", "new"), ("a", "changed"), ("b", "unchanged"), ("c", "new"), ("c", "unchanged")]


def test_debounced_gives_the_last_of_each_burst(spark, tmp_path):
    """A burst goes on over batches; each batch is one file."""
    stream.with_timers(spark)
    schema = "path string, ts string, n long"
    batches = [
        [("a", "10:00:00", 1), ("a", "10:00:01", 2), ("b", "10:00:00", 1)],
        [("a", "10:00:02", 3), ("a", "10:00:02", 5), ("a", "10:00:02", 4)],
        [("c", "10:00:10", 1)],
        [("a", "10:00:11", 6), ("d", None, 1)],
        [("e", "10:01:00", 1)],
    ]
    seen = []
    for rows in batches:
        put(spark, tmp_path, 0, [(k, t and f"2024-01-01 {t}", n) for k, t, n in rows], schema)
        source = stream.read_table_stream(spark, f"{tmp_path}/in").withColumn("ts", F.col("ts").cast("timestamp"))
        stream.run_available(stream.debounced(source, "path", "ts"), str(tmp_path / "out"))
        got = sorted((r.path, str(r.ts)[11:], r.n) for r in spark.read.parquet(str(tmp_path / "out/rows")).collect())
        seen.append(got)
    assert ("a", "10:00:02", 5) not in seen[1]
    assert seen[-1] == [("a", "10:00:02", 5), ("a", "10:00:11", 6), ("b", "10:00:00", 1), ("c", "10:00:10", 1)]


def test_batch_totals_are_written_once(spark, tmp_path):
    put(spark, tmp_path, 0, [("x", 2), ("x", 3), ("y", 1)], "batch_id string, tokens long")
    source = stream.read_table_stream(spark, f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        stream.batch_totals(source, str(tmp_path / "out"))
    got = sorted((r.batch_id, r.calls, r.tokens) for r in spark.read.parquet(str(tmp_path / "out/rows")).collect())
    assert got == [("x", 2, 5), ("y", 1, 1)]


def test_log_stream_skips_bad_rows(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log/a.jsonl").write_text('{"kind": "k", "at": "t"}\nbroken\n{"kind": "k"}\n')
    stream.run_available(stream.read_log_stream(spark, str(tmp_path / "log"), "kind string, at string"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/rows")).count() == 1


@pytest.mark.parametrize("width", ["1 hour"])
def test_windowed_counts(spark, tmp_path, width):
    put(spark, tmp_path, 0, [("a", "2024-01-01 10:10:00"), ("a", "2024-01-01 10:50:00"), ("a", "2024-01-01 14:00:00")], "kind string, ts string")
    source = stream.read_table_stream(spark, f"{tmp_path}/in").withColumn("ts", F.col("ts").cast("timestamp"))
    stream.run_available(stream.windowed_counts(source, "kind", "ts", width), str(tmp_path / "out"))
    assert [(r.kind, r.events) for r in spark.read.parquet(str(tmp_path / "out/rows")).collect()] == [("a", 2)]


def test_a_burst_is_written_whole_and_once(spark, tmp_path):
    schema = "session_id string, n long, at timestamp"
    path, flag = f"file://{tmp_path}/log", tmp_path / "broken"
    place = str(flag)

    @F.udf("long")
    def checked(n):
        import os

        if n == 13 and os.path.exists(place):
            raise ValueError("a task fails")
        return n

    def run():
        source = stream.read_table_stream(spark, f"{tmp_path}/in").withColumn("n", checked("n"))
        bursts.append_bursts(source, path, "session_id")

    def read():
        known = spark.read.parquet(f"{tmp_path}/in").schema
        rows = sorted((r.session_id, r.n) for r in bursts.read_bursts(spark, path, known).collect())
        counts = {r.session_id: (r.n, r.bursts) for r in bursts.session_counts(spark, path, known["session_id"]).collect()}
        return rows, counts

    at = datetime(2024, 1, 1)
    put(spark, tmp_path, 0, [("a", 1, at), ("a", 2, None), ("b", 3, at)], schema)
    assert bursts.read_bursts(spark, path, spark.read.parquet(f"{tmp_path}/in").schema).count() == 0
    run()
    first = ([("a", 1), ("a", 2), ("b", 3)], {"a": (2, 1), "b": (1, 1)})
    assert read() == first
    # one task of the second burst fails: others of it have written, nothing of it is read
    flag.touch()
    for k in range(4):
        put(spark, tmp_path, 0, [("c", 10 + k, at)] * 3, schema)
    with pytest.raises(Exception, match="a task fails"):
        run()
    assert read() == first
    flag.unlink()
    run()
    assert {r.at for r in bursts.read_bursts(spark, path, spark.read.parquet(f"{tmp_path}/in").schema).collect()} == {at, None}
    second = (sorted(first[0] + [("c", 10 + k) for k in range(4) for _ in range(3)]), first[1] | {"c": (12, 1)})
    assert read() == second
    run()
    assert read() == second


def test_commits_are_repeatable_and_aborts_leave_nothing(spark, tmp_path):
    schema = T.StructType.fromDDL("session_id string, n long")
    path = f"file://{tmp_path}/log"
    writer = bursts.BurstWriter(path, "session_id", schema)
    rows = [Row(session_id="a", n=1), Row(session_id=None, n=2)]
    read = lambda: sorted(((r.session_id, r.n, r.burst) for r in bursts.read_bursts(spark, path, schema).collect()), key=repr)
    writer.abort([writer.write(iter(rows)), None], 0)
    assert read() == [] and not list((tmp_path / "log/pending").iterdir())
    writer.commit([writer.write(iter(rows)), writer.write(iter([]))], 0)
    want = sorted([("a", 1, 0), (None, 2, 0)], key=repr)
    assert read() == want
    writer.commit([writer.write(iter(rows))], 0)  # the same micro-batch again
    assert read() == want and not list((tmp_path / "log/pending").iterdir())
    # a commit that broke off before its mark
    (tmp_path / "log/commits/0.json").unlink()
    assert read() == []
    writer.commit([writer.write(iter(rows))], 0)
    assert read() == want
