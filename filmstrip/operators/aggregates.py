"""Sums over parts, runs and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import compression_ratio


def aggregate_probes(parts: DataFrame, key: list[str], *, order: Column, bitrate: Column, duration: Column, failed: Column | None = None) -> DataFrame:
    """Bitrate and duration of items in parts: the largest bitrate and the sum of
    durations; if a part failed, the first part's duration times the number of parts. An
    item of one part is what that part is."""
    failed = bitrate.isNull() | duration.isNull() if failed is None else failed
    agg = parts.groupBy(*key).agg(F.count(F.lit(1)).alias("n_parts"), F.count_if(failed).alias("_f"), F.max(F.when(~failed, bitrate)).alias("bitrate_kbps"), F.sum(F.when(~failed, duration)).alias("_sum"), F.min(F.struct(order.alias("o"), duration.alias("d"))).alias("_first"))
    whole = F.when((F.col("n_parts") > 1) & (F.col("_f") > 0), F.col("_first.d") * F.col("n_parts")).otherwise(F.col("_sum"))
    return agg.select(*key, "n_parts", "bitrate_kbps", whole.alias("duration_secs"))


def distinct_bytes(items: DataFrame, key: list[str], size: str) -> DataFrame:
    """Total size, each file once however many titles it has."""
    return items.groupBy(*key).agg(F.max(size).alias("_s")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("_s").alias("total_bytes"))


def run_summary(done: DataFrame, before: Column, after: Column, outcome: Column | None = None) -> DataFrame:
    """bytes_saved only counts what got smaller, so the share isn't the difference. With
    ``outcome`` (transcoded, skipped or error) n_skipped and n_errors too, and sums are of
    what was transcoded."""
    counts = [F.count(F.lit(1)).alias("n_transcoded")]
    if outcome is not None:
        before, after = F.when(outcome == "transcoded", before), F.when(outcome == "transcoded", after)
        counts = [F.count_if(outcome == kind).alias(name) for kind, name in (("transcoded", "n_transcoded"), ("skipped", "n_skipped"), ("error", "n_errors"))]
    s = done.agg(*counts, F.sum(before).alias("bytes_in"), F.sum(after).alias("bytes_out"), F.sum(F.when(before.isNotNull() & after.isNotNull(), F.greatest(before - after, F.lit(0)))).alias("bytes_saved"))
    return s.withColumn("saved_pct", F.when(F.col("bytes_in") == 0, 0.0).otherwise(F.col("bytes_saved") / F.col("bytes_in") * 100.0)).withColumn("compression_ratio", compression_ratio(F.col("bytes_in"), F.col("bytes_out")))


def replace_summary(rows: DataFrame, original: Column, new: Column, disc: Column, valid: Column) -> DataFrame:
    """What replacing originals would do: discs stay, invalid outputs fail."""
    ok = ~disc & valid
    return rows.agg(F.count_if(ok).alias("replaced"), F.count_if(disc).alias("skipped"), F.count_if(~disc & ~valid).alias("failed"), F.coalesce(F.sum(F.when(ok, F.greatest(original - new, F.lit(0)))), F.lit(0)).alias("bytes_saved"))


def progress(slots: DataFrame, done: Column, total: Column, active: Column, speed: Column, queued: Column) -> DataFrame:
    """Overall progress, and how many slots report which speed together."""
    s = slots.agg(F.max(done).alias("_d"), F.max(total).alias("_t"), F.sum(active).alias("_a"), F.count_if(~queued & (speed > 0)).alias("reporting"), F.coalesce(F.sum(F.when(~queued, speed)), F.lit(0)).alias("total_speed"))
    return s.select(F.when(F.col("_t") == 0, 0.0).otherwise(F.least(F.col("_d") + F.col("_a"), F.col("_t")) / F.col("_t")).alias("fraction"), "reporting", "total_speed")


def year_hint(streams: DataFrame, item: list[str], file_year: Column, title_year: Column, commentary: Column) -> DataFrame:
    """The file name's year, else the smallest in titles that aren't commentary."""
    return streams.groupBy(*item).agg(F.coalesce(F.max(file_year), F.min(F.when(~commentary, title_year))).alias("year"))
