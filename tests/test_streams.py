"""Streams that stop and go on, rows that come late, state that expires."""

from __future__ import annotations

import json
from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import functions as F

from filmstrip.operators import folds
from filmstrip.plans import catalog
from filmstrip.streaming import events

SF = "/root/testdata/sf0.001"
START = datetime(2024, 5, 1)


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def state(spark, name, path, operator=0):
    return spark.read.format("statestore").option("operatorId", operator).load(f"{events.folder(spark, name, str(path))}/state")


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    schema = "event_id long, ts timestamp, event_type string, value double"
    at = lambda n: (n, START + timedelta(minutes=n), "view", float(n))
    put(spark, tmp_path / "in", [at(1), at(2)], schema)
    got = lambda: sorted(map(tuple, events.progress(spark, str(tmp_path / "in")).select("event_id").collect()))
    assert got() == [(1,), (2,)]
    home = Path(events.folder(spark, "progress", str(tmp_path / "in")))
    batches = sorted(p.name for p in (home / "out").glob("batch-*"))
    put(spark, tmp_path / "in", [at(3)], schema)
    assert got() == [(1,), (2,), (3,)] and got() == [(1,), (2,), (3,)]
    assert len(list((home / "out").glob("batch-*"))) == len(batches) + 1
    # no file has been read twice: each is in one batch of the source's log
    logged = [json.loads(x)["path"] for p in (home / "state/sources/0").glob("[0-9]*") for x in p.read_text().splitlines()[1:]]
    assert len(logged) == len(set(logged)) == len(list((tmp_path / "in").glob("*.parquet")))


def test_a_batch_that_runs_again_adds_nothing(spark, tmp_path):
    write = events._batch(str(tmp_path), False)
    write(spark.range(3), 7)
    write(spark.range(5), 7)
    write(spark.range(2), 8)
    rows = spark.read.option("recursiveFileLookup", True).parquet(str(tmp_path))
    assert rows.groupBy("_batch").count().orderBy("_batch").collect() == [(7, 3), (8, 2)]


def test_late_rows_are_dropped_and_closed_windows_leave(spark, tmp_path):
    schema = "event_id long, ts timestamp, event_type string"
    at = lambda n, hours: (n, START + timedelta(hours=hours), "view")
    run = lambda: {(r.start, r.n) for r in events.finished(events.late_windows(events.events(spark, str(tmp_path / "in"), 1), "1 hour", "2 hours"), "late-test", str(tmp_path / "in")).collect()}
    put(spark, tmp_path / "in", [at(1, 0), at(2, 0.5), at(3, 9)], schema)
    assert run() == {(START, 2)}
    assert {r.key[1].start for r in state(spark, "late-test", tmp_path / "in").collect()} == {START + timedelta(hours=9)}
    put(spark, tmp_path / "in", [at(4, 0.7), at(5, 9.5), at(6, 20)], schema)  # the first is late
    assert run() == {(START, 2), (START + timedelta(hours=9), 2)}
    assert {r.key[1].start for r in state(spark, "late-test", tmp_path / "in").collect()} == {START + timedelta(hours=20)}


def attempts(spark):
    return spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), folds.failure_bits(catalog._message()).alias("bits"))


def test_retries_equal_the_fold_in_any_batching(spark, tmp_path):
    data = attempts(spark)
    for n in range(3):
        data.where(f"event_id % 100 div 34 = {n}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    data = data.withColumn("part", F.floor(F.expr("event_id % 100 / 34")))
    stream = spark.readStream.schema(attempts(spark).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    done = events.finished(events.retries(stream, "user_id", "event_id", late="60 days", keep="60 days"), "retries-test", str(tmp_path / "in"), provider=events.ROCKS)
    got = {r.user_id: r.d for r in done.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.expr("event_id % 100 div 34").alias("part"), "event_id", "decision"))), lambda x: x["decision"]).alias("d")).collect()}
    want = {r.user_id: r.decisions for r in folds.retry_fold(data, ["user_id"], ["part", "event_id"], F.col("bits")).collect()}
    assert got == want


def test_files_that_gave_up_leave_the_state(spark, tmp_path):
    schema = "f long, n long, ts timestamp, message string"
    row = lambda f, n, hours, message="unknown": (f, n, START + timedelta(hours=hours), message)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stream = stream.withColumn("bits", folds.failure_bits(F.col("message")))
        return {(r.f, r.n): r.decision for r in events.finished(events.retries(stream, "f", "n", late="1 hour", keep="3 hours"), "gone", str(tmp_path / "in"), provider=events.ROCKS).collect()}

    put(spark, tmp_path / "in", [row(1, 1, 0), row(1, 2, 0.1), row(2, 3, 0, "No space left on device")], schema)
    assert run() == {(1, 1): "bail", (2, 3): "disk-space"}
    put(spark, tmp_path / "in", [row(2, 4, 2, "No space left on device"), row(1, 5, 2)], schema)  # 1 has given up
    assert run() == {(1, 1): "bail", (2, 3): "disk-space", (2, 4): "disk-space"}
    put(spark, tmp_path / "in", [row(3, 6, 50)], schema)
    run()
    put(spark, tmp_path / "in", [row(1, 7, 51)], schema)  # forgotten: a file of its own
    assert run()[1, 7] == "bail"
    left = spark.read.format("statestore").option("stateVarName", "retries").load(f"{events.folder(spark, 'gone', str(tmp_path / 'in'))}/state")
    assert {r.key[0] for r in left.collect()} == {1, 3}


def test_listings_are_planned_once_and_without_what_is_marked(spark, tmp_path):
    listing, marks = str(tmp_path / "in"), str(tmp_path / "marks")
    put(spark, listing, [("a", 1), ("b", 2), ("c", 3)], "path string, size long")
    put(spark, marks, [("b", 2), ("c", 9)], "path string, marked long")

    def run():
        new = events.unmarked(events.files(spark, listing), spark.read.schema("path string, marked long").parquet(marks), ["path"], "size", "marked")
        return sorted(map(tuple, events.finished(new.select("path", "size"), "unmarked", listing).collect()))

    assert run() == [("a", 1), ("c", 3)]
    put(spark, marks, [("d", 4)], "path string, marked long")
    put(spark, listing, [("a", 1), ("b", 2), ("d", 4), ("e", 5)], "path string, size long")
    assert run() == [("a", 1), ("c", 3), ("e", 5)]
