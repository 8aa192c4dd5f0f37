"""What a run leaves behind: markers, planned replacements, sweeps, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import invalid_output
from ..functions.scalars import file_name, parent
from ..operators.outputs import marker_path

# The keys of run events; the second are those with a number.
EVENTS = ["gpu-detected", "scan-completed", "transcode-started", "transcode-completed", "transcode-failed", "disk-wait", "session-limit-hit", "subtitle-retry", "auto-ramp-increased", "transcoding-paused", "transcoding-resumed", "run-started", "transcode-queued", "transcode-retry", "auto-ramp-stopped", "run-completed"]
METRICS = ["gpu-detected", "scan-completed", "transcode-started", "transcode-completed", "disk-wait", "auto-ramp-increased", "run-started", "run-completed"]


def markers(done: DataFrame, at: Column) -> DataFrame:
    """Marker rows of finished outputs: output, marker, source_size, duration_secs,
    completed_at."""
    return done.select("output", marker_path(F.col("output")).alias("marker"), "source_size", "duration_secs", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("completed_at"))


def without_markers(markers: DataFrame, removed: DataFrame, key: str = "output") -> DataFrame:
    return markers.join(removed, key, "left_anti")


def replacements(items: DataFrame) -> DataFrame:
    """Planned replacements: original, output, action, reason, bytes_saved. ``items``
    has path, output, is_disc, source_size, source_duration, out_size, out_codec and
    out_duration."""
    reason = invalid_output(F.col("out_size"), F.col("source_size"), F.col("out_codec"), F.col("source_duration"), F.col("out_duration"))
    action = F.when(F.col("is_disc"), "skip").when(F.col("reason").isNotNull(), "fail").otherwise("replace")
    saved = F.when(F.col("action") == "replace", F.greatest(F.col("source_size") - F.col("out_size"), F.lit(0))).otherwise(0)
    return items.withColumn("reason", reason).withColumn("action", action).select(F.col("path").alias("original"), "output", "action", F.when(F.col("action") == "fail", F.col("reason")).alias("reason"), saved.alias("bytes_saved"))


def sweep(files: DataFrame, prefix: str) -> DataFrame:
    """Temporary files of earlier runs, and the directories they are in."""
    return files.where(file_name(F.col("path")).startswith(prefix)).select("path", parent(F.col("path")).alias("folder"), "size")


def output_folders(outputs: DataFrame) -> DataFrame:
    return outputs.select(parent(F.col("output")).alias("folder")).distinct()


def listed(done: DataFrame) -> DataFrame:
    """Paths of finished outputs, for a pipe: sorted, each once."""
    return done.select("output").where("output is not null").distinct().orderBy("output")


def output_sizes(outputs: DataFrame, files: DataFrame) -> DataFrame:
    """``outputs`` with their size, 0 where there is no file."""
    return outputs.join(files.select(F.col("path").alias("output"), "size"), "output", "left").withColumn("size", F.coalesce("size", F.lit(0)))


def run_event(rows: DataFrame, key: str, at: Column, metric: Column | None = None, **data: Column) -> DataFrame:
    """Event rows: ts, key, metric (null for events without a number), data as JSON."""
    if key not in EVENTS:
        raise ValueError(f"no such event: {key}")
    number = metric.cast("double") if metric is not None and key in METRICS else F.lit(None).cast("double")
    return rows.select(at.alias("ts"), F.lit(key).alias("key"), number.alias("metric"), F.to_json(F.struct(*[c.alias(n) for n, c in data.items()])).alias("data"))


def emit(rows: DataFrame, path: str) -> None:
    """Appends event rows to a folder of JSON lines, which streams can read."""
    rows.write.mode("append").json(path)


def flags(dim: DataFrame) -> DataFrame:
    """Runtime flags with their defaults: enabled, not paused, no limit."""
    return dim.select(F.coalesce("enabled", F.lit(True)).alias("enabled"), F.coalesce("paused", F.lit(False)).alias("paused"), F.greatest(F.coalesce("max_jobs", F.lit(0)), F.lit(0)).alias("max_jobs"))
