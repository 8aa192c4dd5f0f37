"""Markers, sweeps, events, flags, pauses and progress."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from filmstrip.operators import aggregates
from filmstrip.sinks import markers, tables
from filmstrip.sources.tables import network_mount, read_markers, read_mounts
from filmstrip.streaming import control, events


def test_markers_are_written_read_and_removed(spark, tmp_path):
    names = [f"{tmp_path}/d{n % 3}/f {n}.mkv" for n in range(9)]
    for n in range(3):
        (tmp_path / f"d{n}").mkdir()
    done = spark.createDataFrame([(x, n, 1.5 * n) for n, x in enumerate(names)], "output string, source_size bigint, duration_secs double").repartition(4)
    at = F.lit(datetime(2024, 5, 1, 12)).cast("timestamp")
    rows = tables.markers(done, at)
    assert {r.marker for r in rows.collect()} == {x + markers.SUFFIX for x in names}
    markers.write_markers(rows)
    got = {r.output: (r.source_size, r.duration_secs, r.completed_at) for r in read_markers(spark, str(tmp_path)).collect()}
    assert got == {x: (n, 1.5 * n, datetime(2024, 5, 1, 12)) for n, x in enumerate(names)}
    assert not list(tmp_path.rglob(markers.TEMPORARY + "*"))
    markers.write_markers(rows.where("source_size = 4").withColumn("source_size", F.lit(44).cast("long")))
    (tmp_path / "d0" / f"junk{markers.SUFFIX}").write_text("no marker")
    assert {r.source_size for r in read_markers(spark, str(tmp_path)).collect()} == {0, 1, 2, 3, 44, 5, 6, 7, 8}
    gone = done.where("source_size < 7").select("output").union(spark.createDataFrame([(f"{tmp_path}/none",), (None,)], "output string"))
    markers.remove_markers(gone)
    assert {r.output for r in read_markers(spark, str(tmp_path)).collect()} == {names[7], names[8]}
    left = tables.without_markers(read_markers(spark, str(tmp_path)), done.where("source_size = 7").select("output"))
    assert [r.output for r in left.collect()] == [names[8]]


def test_an_aborted_task_leaves_no_marker(spark, tmp_path):
    rows = [(f"{tmp_path}/f{n}.mkv", n, 1.0, "2024-05-01T12:00:00Z") for n in range(8)] + [(f"{tmp_path}/no/such/f.mkv", 9, 1.0, "")]
    df = spark.createDataFrame(rows, markers.ROW).repartition(3)
    with pytest.raises(Exception, match="No such file"):
        markers.write_markers(df)
    assert not list(tmp_path.iterdir())
    with pytest.raises(Exception, match="path"):
        markers.write_markers(spark.createDataFrame([*rows[:2], (None, 1, 1.0, "")], markers.ROW).coalesce(1))
    assert not list(tmp_path.iterdir())


def test_sweeps_folders_and_sizes(spark):
    files = spark.createDataFrame([("/a/.tmp_marker_1", 5), ("/a/x.mkv", 7), ("/b/.tmp_marker_2", 0)], "path string, size bigint")
    assert sorted(map(tuple, tables.sweep(files, markers.TEMPORARY).collect())) == [("/a/.tmp_marker_1", "/a", 5), ("/b/.tmp_marker_2", "/b", 0)]
    outputs = spark.createDataFrame([("/a/x.mkv",), ("/a/y.mkv",), ("/c/z.mkv",)], "output string")
    assert sorted(r.folder for r in tables.output_folders(outputs).collect()) == ["/a", "/c"]
    assert sorted(map(tuple, tables.output_sizes(outputs, files).collect())) == [("/a/x.mkv", 7), ("/a/y.mkv", 0), ("/c/z.mkv", 0)]


def test_events_and_flags(spark):
    rows = spark.createDataFrame([(3,)], "n long")
    at = F.lit(datetime(2024, 5, 1))
    got = tables.run_event(rows, "run-started", at, F.col("n"), files=F.col("n")).union(tables.run_event(rows, "transcode-failed", at, F.col("n"), why=F.lit("x"))).collect()
    assert [(r.key, r.metric, json.loads(r.data)) for r in got] == [("run-started", 3.0, {"files": 3}), ("transcode-failed", None, {"why": "x"})]
    with pytest.raises(ValueError):
        tables.run_event(rows, "no-such", at)
    dim = spark.createDataFrame([(None, None, None), (False, True, -2)], "enabled boolean, paused boolean, max_jobs int")
    assert [tuple(r) for r in tables.flags(dim).collect()] == [(True, False, 0), (False, True, 0)]


def test_mounts(spark, tmp_path):
    (tmp_path / "mounts").write_text("srv:/x /mnt/my\\040media nfs4 rw 0 0\n/dev/sda / ext4 rw\nshort line\n")
    mounts = read_mounts(spark, str(tmp_path / "mounts"))
    assert sorted(map(tuple, mounts.collect())) == [("/dev/sda", "/", "ext4"), ("srv:/x", "/mnt/my media", "nfs4")]
    paths = spark.createDataFrame([("/mnt/my media/a",), ("/mnt/other",)], "path string")
    assert {r.path: r.network_fs for r in network_mount(paths, mounts).collect()} == {"/mnt/my media/a": "nfs4", "/mnt/other": None}


class Switch:
    """Flags that change each time that a batch waits."""

    def __init__(self, folder, states):
        self.folder, self.states, self.waits = folder, list(states), 0
        folder.mkdir()
        self.next()

    def next(self, _=None):
        if _ is not None:
            self.waits += 1
        if self.states:
            (self.folder / "flags.json").write_text(json.dumps(self.states.pop(0)))


ON, PAUSED, OFF = {}, {"paused": True}, {"enabled": False, "paused": True}


@pytest.mark.parametrize(
    "states, worked, told, waits",
    [
        ([ON], True, [], 0),
        ([PAUSED, PAUSED, ON], True, ["transcoding-paused", "transcoding-resumed"], 2),
        ([PAUSED, OFF], False, ["transcoding-paused"], 1),
        ([OFF], False, [], 0),
    ],
)
def test_pause_and_switch(spark, tmp_path, states, worked, told, waits):
    switch, seen = Switch(tmp_path / "flags", states), []
    (tmp_path / "in").mkdir()
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "in/a.parquet"))

    def run():
        stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in/a.parquet"))
        batch = control.controlled(lambda df, n: seen.append((n, df.count())), str(tmp_path / "flags"), str(tmp_path / "events"), wait=switch.next)
        stream.writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    if worked:
        run()
    else:
        with pytest.raises(Exception, match="left for later"):
            run()
    assert seen == [(0, 3)] * worked and switch.waits == waits
    got = [json.loads(x)["key"] for p in sorted((tmp_path / "events").glob("*.json"), key=lambda p: p.stat().st_mtime_ns) for x in p.read_text().splitlines()] if told else []
    assert got == told
    if not worked:  # switched on again, the batch comes first
        switch.states = [ON]
        switch.next()
        run()
        assert seen == [(0, 3)]


def test_observed_progress_equals_the_aggregate(spark, tmp_path):
    rows = [(3, 10, 0.5, 120, False), (3, 10, 0.25, 0, False), (3, 10, 0.0, 99, True)]
    spark.createDataFrame(rows, "done long, total long, active double, speed long, queued boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    cols = [F.col(c) for c in ("done", "total", "active", "speed", "queued")]
    seen = control.Progress()
    listener = seen.listener()
    spark.streams.addListener(listener)
    try:
        events.finished(seen.observed(events.files(spark, str(tmp_path / "in")), *cols), "observed", str(tmp_path / "in"))
        for _ in range(100):
            if seen.latest:
                break
            import time

            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    want = aggregates.progress(spark.read.parquet(str(tmp_path / "in")), *cols).first()
    assert seen.latest == want.asDict() and seen.latest["fraction"] == 0.375
