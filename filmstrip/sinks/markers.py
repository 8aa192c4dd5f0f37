"""Completion markers: a small JSON file beside each output, written by a data source.

A task writes every marker under a temporary name and lists them in a manifest in the
shared folder; only when all tasks have ended does the commit give markers their names.
What a failed task or an aborted job wrote is taken away again, and what a lost executor
leaves carries the prefix that sweeps look for. Needs folders that all executors see."""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..shared import shared_dir

SUFFIX, TEMPORARY = ".complete", ".tmp_marker_"
ROW = "output string, source_size bigint, duration_secs double, completed_at string"


@dataclass
class Manifest(WriterCommitMessage):
    path: str


def _gone(path: str) -> None:
    try:
        os.unlink(path)
    except FileNotFoundError:
        pass


def _lines(message):
    with open(message.path, encoding="utf-8") as f:
        for line in f:
            yield json.loads(line)


class _Writer(DataSourceWriter):
    def __init__(self, folder: str, suffix: str):
        self.folder, self.suffix = folder, suffix

    def write(self, iterator):
        os.makedirs(self.folder, exist_ok=True)
        manifest = f"{self.folder}/{uuid.uuid4().hex}"
        made: list[str] = []
        try:
            with open(manifest, "w", encoding="utf-8") as listed:
                for row in iterator:
                    if row.output is None:
                        raise ValueError("a marker needs its output's path")
                    temporary = os.path.join(os.path.dirname(row.output), TEMPORARY + uuid.uuid4().hex)
                    made.append(temporary)
                    with open(temporary, "w", encoding="utf-8") as f:
                        json.dump({"source_size": row.source_size, "duration_secs": row.duration_secs, "completed_at": row.completed_at}, f)
                        f.flush()
                        os.fsync(f.fileno())
                    listed.write(json.dumps([temporary, row.output + self.suffix]) + "\n")
        except BaseException:
            for path in [*made, manifest]:
                _gone(path)
            raise
        return Manifest(manifest)

    def commit(self, messages):
        for m in filter(None, messages):
            for temporary, marker in _lines(m):
                if os.path.exists(temporary):  # else an earlier try has renamed it
                    os.replace(temporary, marker)
            _gone(m.path)

    def abort(self, messages):
        for m in filter(None, messages):
            for temporary, _ in _lines(m):
                _gone(temporary)
            _gone(m.path)


class CompletionMarkers(DataSource):
    """Options: ``folder`` for manifests, ``suffix`` of markers."""

    @classmethod
    def name(cls):
        return "completion_markers"

    def schema(self):
        return ROW

    def writer(self, schema, overwrite):
        return _Writer(self.options["folder"], self.options.get("suffix", SUFFIX))


def write_markers(rows: DataFrame, suffix: str = SUFFIX) -> None:
    """A marker for each row's output: source_size, duration_secs, completed_at (text). A
    marker that is there is replaced; an output that comes twice keeps one of the two."""
    spark = rows.sparkSession
    spark.dataSource.register(CompletionMarkers)
    folder = f"{shared_dir(spark).removeprefix('file://').removeprefix('file:')}/markers-{uuid.uuid4().hex}"
    rows.select("output", "source_size", "duration_secs", "completed_at").write.format("completion_markers").option("folder", folder).option("suffix", suffix).mode("append").save()


class _Removal(_Writer):
    def write(self, iterator):
        for row in iterator:
            _gone(row.output + self.suffix)
        return Manifest("")

    def commit(self, messages):
        pass

    def abort(self, messages):
        pass


class MarkerRemoval(CompletionMarkers):
    @classmethod
    def name(cls):
        return "completion_markers_removal"

    def schema(self):
        return "output string"

    def writer(self, schema, overwrite):
        return _Removal("", self.options.get("suffix", SUFFIX))


def remove_markers(outputs: DataFrame, suffix: str = SUFFIX) -> None:
    """Takes the markers of outputs away; one that isn't there is no error."""
    outputs.sparkSession.dataSource.register(MarkerRemoval)
    outputs.select("output").where("output is not null").write.format("completion_markers_removal").option("suffix", suffix).mode("append").save()
