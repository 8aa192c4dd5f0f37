"""Listing directories in rounds: each round lists the directories the last one found,
spread over tasks, so one deep or wide folder is no task of its own."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import is_disc_image
from ..functions.scalars import ext_lower, file_name
from ..operators.joins import first_of
from ..shared import written

SCHEMA = "path string, canonical_path string, is_file boolean, size bigint"
ARTEFACT_START, ARTEFACT_PART = ".tmp_transcode_", ".transcoded."
#: Directories of a round that one task lists.
SLICE = 500


def _entries(top: str):
    """(path, canonical path, whether a file, size) of what is in a directory; what can't
    be read, and what is neither file nor directory, is left out."""
    try:
        found = sorted(os.scandir(top), key=lambda e: e.name)
    except OSError:
        return
    for e in found:
        try:
            if e.is_dir() or e.is_file():
                yield e.path, os.path.realpath(e.path), e.is_file(), e.stat().st_size if e.is_file() else None
        except OSError:
            continue


def _listed(batches):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.string(), pa.string(), pa.bool_(), pa.int64()]
    for batch in batches:
        for top in batch.column("path").to_pylist():
            rows = list(_entries(top))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def walk(spark: SparkSession, root: str, *, per_task: int = SLICE) -> DataFrame:
    """path, canonical_path, is_file, size of the files below ``root``, or of it, if it
    is one. Links are followed; a directory is listed once, by the first path that a
    round finds (the smallest of them), so circles end where they close. What can't be
    read is left out. Needs a folder that all executors see; each round is written to
    the shared folder, so a lost executor costs its own tasks."""
    real = os.path.realpath(root)
    if os.path.isfile(root):
        return spark.createDataFrame([(root, real, True, os.path.getsize(root))], SCHEMA)
    frontier = spark.createDataFrame([(root, real)], "path string, canonical_path string")
    files, visited, many = spark.createDataFrame([], SCHEMA), frontier.select("canonical_path"), 1
    while many:
        dealt = frontier.select("path").repartition(max(1, -(-many // per_task)), "path") if many > 1 else frontier.select("path")
        found = written(dealt.mapInArrow(_listed, SCHEMA), "walk")
        files = files.union(found.where("is_file"))
        new = found.where("not is_file").groupBy("canonical_path").agg(F.min("path").alias("path")).join(visited, "canonical_path", "left_anti")
        frontier = written(new.select("path", "canonical_path"), "frontier")
        many = frontier.count()
        visited = visited.union(frontier.select("canonical_path"))
    return files


def media_files(files: DataFrame, extensions: tuple[str, ...], *, artefact_start: str = ARTEFACT_START, single: bool = False) -> DataFrame:
    """What a scan takes: wanted extensions and disc images, without artefacts of runs,
    each file once (the smallest path that leads to it), in order of path components. A
    ``single`` file that is asked for by name may be an artefact."""
    name = file_name(F.col("path"))
    artefact = name.startswith(artefact_start) | name.contains(ARTEFACT_PART)
    wanted = ext_lower(F.col("path")).isin([e.lower() for e in extensions]) | is_disc_image(F.col("path"))
    kept = files.where(F.col("is_file") & (F.lit(single) | ~artefact) & wanted)
    return first_of(kept, ["canonical_path"], [F.split("path", "/")]).orderBy(F.split("path", "/"))
