"""Pause and stop of a running stream by flags that are read anew before each batch."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sinks.tables import emit, flags, run_event

FLAGS = "enabled boolean, paused boolean, max_jobs int"


class Stopped(Exception):
    """The switch is off: the batch has not been worked on and comes again later."""


def controlled(work: Callable[[DataFrame, int], None], flags_path: str, events_path: str, *, poll: float = 1.0, wait: Callable[[float], None] = time.sleep) -> Callable[[DataFrame, int], None]:
    """``work`` for foreachBatch that minds the flags (JSON lines; the last row of the
    newest file counts, none means the defaults). Off: the query stops before the batch,
    which a restart does first. Paused: the batch waits, and one event says so; another
    one says that it goes on, but not where it ends because the switch is off. Events
    are appended to ``events_path`` as JSON, with the batch's number as data."""

    def now(spark):
        rows = spark.read.schema(FLAGS).json(flags_path).withColumn("_at", F.col("_metadata.file_modification_time"))
        first = flags(rows.orderBy(F.desc("_at")).limit(1)).first()
        return (True, False) if first is None else (first.enabled, first.paused)

    def tell(spark, key, n):
        emit(run_event(spark.range(1), key, F.current_timestamp(), batch=F.lit(n)), events_path)

    def batch(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        enabled, paused = now(spark)
        told = False
        while enabled and paused:
            if not told:
                tell(spark, "transcoding-paused", n)
                told = True
            wait(poll)
            enabled, paused = now(spark)
        if not enabled:
            raise Stopped(f"batch {n} is left for later")
        if told:
            tell(spark, "transcoding-resumed", n)
        work(df, n)

    return batch


class Progress:
    """Overall progress and speed of what a stream reports, as metrics that Spark observes
    while batches run: nothing is read twice. ``latest`` has the last batch's numbers."""

    NAME = "progress"

    def __init__(self):
        self.latest: dict | None = None

    def observed(self, slots: DataFrame, done, total, active, speed, queued) -> DataFrame:
        """``slots`` with the sums observed: the same as ``aggregates.progress`` says."""
        return slots.observe(self.NAME, F.max(done).alias("done"), F.max(total).alias("total"), F.sum(active).alias("active"), F.count_if(~queued & (speed > 0)).alias("reporting"), F.coalesce(F.sum(F.when(~queued, speed)), F.lit(0)).alias("total_speed"))

    def listener(self):
        from pyspark.sql.streaming import StreamingQueryListener

        mine = self

        class Listener(StreamingQueryListener):
            def onQueryStarted(self, event):
                pass

            def onQueryProgress(self, event):
                row = event.progress.observedMetrics.get(mine.NAME)
                if row is not None and row["total"] is not None:
                    whole = row["total"]
                    mine.latest = {"fraction": min(row["done"] + row["active"], whole) / whole if whole else 0.0, "reporting": row["reporting"], "total_speed": row["total_speed"]}

            def onQueryIdle(self, event):
                pass

            def onQueryTerminated(self, event):
                pass

        return Listener()
