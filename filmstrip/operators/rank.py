"""The primary audio track: a ranking with a fallback pool and tie detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ERA = 1955
ALL_COMMENTARY, TIED = "all streams look like commentary", "top candidates tie on channels and bitrate"


#: Rows that one task sorts, about.
ROWS = 1 << 20


def dealt(streams: DataFrame, item: list[str], rows: int, per_task: int = ROWS) -> DataFrame:
    """``streams``, of so many rows, dealt by item over as many tasks as they call for,
    where the session's number of shuffle partitions is too small for them."""
    parts = -(-rows // per_task)
    few = int(streams.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return streams.repartition(parts, *item) if parts > few else streams


def pick_primary(streams: DataFrame, item: list[str], *, idx: Column, channels: Column, bitrate: Column, commentary: Column, default: Column, year: Column | None = None, era: int = ERA) -> DataFrame:
    """One row per item: primary index, n_streams, ambiguous, reason.

    Commentary only counts where an item has nothing else. More channels come first, or
    fewer for years before ``era``; then more bitrate, then default tracks, then the
    first. A single stream is never ambiguous."""
    year = F.lit(None).cast("int") if year is None else year
    s = streams.select(*item, idx.alias("_i"), channels.alias("_c"), bitrate.alias("_b"), commentary.alias("_x"), default.alias("_d"), year.alias("_y"))
    # one order for all windows, so that a task sorts once: what isn't commentary comes
    # first, and the next stream only ties with the first if it is in the same pool
    sign = F.when(F.col("_y") < era, F.col("_c")).otherwise(-F.col("_c"))
    s = s.withColumn("_own", F.coalesce(~F.col("_x"), F.lit(False)))
    order = Window.partitionBy(*item).orderBy(F.desc("_own"), sign, F.desc("_b"), F.desc("_d"), "_i")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumns(
        {
            "_n": F.count(F.lit(1)).over(whole),
            "_talk": F.min(F.col("_x").cast("int")).over(whole) == 1,
            "_r": F.row_number().over(order),
            "_next": F.lead(F.struct("_own", "_c", "_b")).over(order),
        }
    )
    first = s.where("_r = 1").where(F.col("_own") | F.col("_talk") | (F.col("_n") == 1))
    tie = F.coalesce((F.col("_own") == F.col("_next._own")) & (F.col("_c") == F.col("_next._c")) & (F.col("_b") == F.col("_next._b")), F.lit(False))
    reason = F.when(F.col("_n") == 1, F.lit(None)).when(F.col("_talk"), ALL_COMMENTARY).when(tie, TIED)
    return first.select(*item, F.col("_i").alias("primary_index"), F.col("_n").alias("n_streams"), reason.isNotNull().alias("ambiguous"), reason.alias("reason"))
