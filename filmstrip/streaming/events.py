"""Event streams: windows, sessions, duplicates, late rows, retries, resumed listings.

Each query reads its files as a stream and runs to the end of what is there
(availableNow). Its folder, in the shared checkpoint folder, is named by the query and
its input and holds checkpoint and result, so that a later call goes on where the last
one stopped: it reads new files only. A batch's result is a folder of its own; one that
is there already is left alone, so a batch that is run again adds nothing."""

from __future__ import annotations

import hashlib
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import IntegerType, StructType

from ..functions.scalars import progress_speed
from ..shared import exists, shared_dir

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def folder(spark: SparkSession, name: str, *inputs: str) -> str:
    """Where a query over these inputs keeps checkpoint and result."""
    return f"{shared_dir(spark)}/streams/{name}-{hashlib.sha256('|'.join(inputs).encode()).hexdigest()[:16]}"


def files(spark: SparkSession, path: str, per_batch: int | None = None) -> DataFrame:
    """Parquet files as a stream: those of a folder, or a single one."""
    schema = spark.read.parquet(path).schema
    top, _, name = path.rpartition("/")
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", False)
    if per_batch:
        raw = raw.option("maxFilesPerTrigger", per_batch)
    is_file = spark.read.format("binaryFile").load(path).select("path").limit(2).collect()
    one = len(is_file) == 1 and is_file[0][0].endswith(f"/{name}")
    return raw.option("pathGlobFilter", name).parquet(top) if one else raw.parquet(path)


def events(spark: SparkSession, path: str, per_batch: int | None = None) -> DataFrame:
    """Event files as a stream, with time on the session's clock."""
    return files(spark, path, per_batch).withColumn("ts", F.col("ts").cast("timestamp"))


@contextmanager
def _store(spark: SparkSession, provider: str | None):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    if provider:
        spark.conf.set(key, provider)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _batch(out: str, whole: bool):
    def write(df: DataFrame, n: int) -> None:
        to = f"{out}/all" if whole else f"{out}/batch-{n:012d}"
        if whole or not exists(df.sparkSession, f"{to}/_SUCCESS"):
            df.withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(to)

    return write


def finished(stream: DataFrame, name: str, *inputs: str, mode: str = "append", key: list[str] | None = None, provider: str | None = None) -> DataFrame:
    """The stream's result so far, after running to the end of its input. In update mode
    ``key`` names what tells result rows apart: the last batch's row of each holds."""
    spark = stream.sparkSession
    at = folder(spark, name, *inputs)
    with _store(spark, provider):
        query = stream.writeStream.foreachBatch(_batch(f"{at}/out", mode == "complete")).outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    schema = StructType(list(stream.schema.fields))
    if not exists(spark, f"{at}/out"):  # nothing has come yet
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema.add("_batch", IntegerType())).option("recursiveFileLookup", True).parquet(f"{at}/out")
    if key:
        rest = [c for c in stream.columns if c not in key]
        rows = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "_batch").alias("_last")).select(*key, "_last.*").select(*stream.columns)
    return rows.select(*stream.columns)


def event_windows(spark: SparkSession, path: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Windows as they fill up; only those changed by a batch are written, and what ended
    ``late`` before the newest event leaves the state."""
    e = events(spark, path).withWatermark("ts", late).groupBy("event_type", F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("total"))
    rows = e.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n", "total")
    return finished(rows, f"event-windows-{width}-{late}".replace(" ", ""), path, mode="update", key=["event_type", "window_start"])


def late_windows(e: DataFrame, width: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Windows over an event stream, closed when the watermark passes."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return e.withWatermark("ts", late).groupBy("event_type", w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("event_type", "w.start", "w.end", "n")


def sessions(spark: SparkSession, path: str, gap: str = "30 minutes") -> DataFrame:
    """All sessions, open ones too, which Spark only gives in complete mode."""
    e = events(spark, path).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    rows = e.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), F.col("w.end").cast("timestamp_ntz").alias("session_end"), "n")
    return finished(rows, f"sessions-{gap}".replace(" ", ""), path, mode="complete")


def late_counts(spark: SparkSession, path: str) -> DataFrame:
    """Sliding windows, as far as they have been filled up."""
    w = late_windows(events(spark, path), "1 hour", "1 day", "30 minutes")
    return finished(w.select("event_type", F.col("start").cast("timestamp_ntz").alias("window_start"), "n"), "late-counts", path, mode="update", key=["event_type", "window_start"])


def arrivals(rows: DataFrame, slice_: str, many: int, name: str, path: str) -> str:
    """``rows`` written as files that arrive one after the other, a slice each: input for
    streams that are to see several batches. Written once for an input."""
    spark = rows.sparkSession
    at = folder(spark, f"arrivals-{name}", path)
    for n in range(many):
        if not exists(spark, f"{at}/done-{n}/_SUCCESS"):
            rows.where(F.col(slice_) == n).drop(slice_).coalesce(1).write.mode("append").parquet(f"{at}/files")
            spark.range(1).write.mode("overwrite").parquet(f"{at}/done-{n}")
    return f"{at}/files"


SLICES, BEHIND = 8, 3


def sliced(e: DataFrame) -> DataFrame:
    """Events by the slice they arrive in: in order of their ids, but for one in 13,
    which comes three slices late."""
    most = e.agg(F.max("event_id")).first()[0] or 0
    on_time = F.floor(F.col("event_id") * SLICES / (most + 1)).cast("int")
    return e.withColumn("slice", on_time + F.when(F.col("event_id") % 13 == 0, BEHIND).otherwise(0))


def closed_windows(spark: SparkSession, path: str, late: str = "12 hours") -> DataFrame:
    """Windows that the watermark has closed, over events of which some come late: rows
    of windows that are closed already are dropped, and no window is given twice."""
    come = arrivals(sliced(spark.read.parquet(path)), "slice", SLICES + BEHIND, "sliced", path)
    w = late_windows(events(spark, come, 1), "1 hour", late)
    return finished(w.select("event_type", F.col("start").cast("timestamp_ntz").alias("window_start"), "n"), f"closed-{late}".replace(" ", ""), path)


def purchases_after_views(spark: SparkSession, path: str, within: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """A stream joined with itself: a user's purchases with the views up to ``within``
    before them. A row leaves the state when nothing that may come can match it."""
    e = events(spark, path)
    seen = e.where("event_type = 'view'").select(F.col("user_id").alias("viewer"), F.col("ts").alias("seen"), F.col("event_id").alias("view_id")).withWatermark("seen", late)
    bought = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase_id")).withWatermark("ts", late)
    near = F.expr(f"user_id = viewer and seen <= ts and seen >= ts - interval {within}")
    return finished(bought.join(seen, near).select("user_id", "purchase_id", "view_id"), f"purchases-{within}-{late}".replace(" ", ""), path)


def progress(spark: SparkSession, path: str) -> DataFrame:
    """Progress lines as a stream, as an encoder writes them, read as speeds; here their
    numbers are the events'."""
    number = F.concat((F.col("event_id") % 10).cast("string"), F.lit("."), F.lpad((F.col("event_id") % 100).cast("string"), 2, "0"))
    line = F.concat(F.lit("speed="), number, F.lit("x"))
    return finished(events(spark, path).select("event_id", progress_speed(line).alias("speed")), "progress", path)


def distinct_pairs(spark: SparkSession, path: str, late: str = "30 days") -> DataFrame:
    """Pairs as they come up first. A pair that has not been seen for ``late`` leaves the
    state; if it comes back in a later batch, it counts once in the result all the same."""
    e = events(spark, path).withWatermark("ts", late).dropDuplicatesWithinWatermark(["user_id", "event_type"])
    return finished(e.select("user_id", "event_type"), f"pairs-{late}".replace(" ", ""), path).distinct()


def unmarked(listing: DataFrame, markers: DataFrame, key: list[str], size: str, marked: str, late: str = "1 day") -> DataFrame:
    """Of arriving listings the items without a marker of their present size, each once
    while it is listed again within ``late``: a stream against a table that is read
    anew in every batch, so what was finished meanwhile is left out."""
    m = markers.select(*[F.col(k).alias(f"_m_{k}") for k in key], F.col(marked).alias("_size"))
    on = [F.col(k) == F.col(f"_m_{k}") for k in key] + [F.col(size) == F.col("_size")]
    new = listing.join(m, on, "left_anti").withColumn("_seen", F.current_timestamp())
    return new.withWatermark("_seen", late).dropDuplicatesWithinWatermark([*key, size]).drop("_seen")


MOST = 5
STATE = "disk int, audio boolean, subtitle boolean, skip boolean, session int, over boolean"


class Retries(StatefulProcessor):
    """A file's attempts with what is decided after each, by the state of the retry fold.
    A file that gave up keeps nothing but that. When the watermark is ``keep``
    milliseconds beyond a file's last attempt, a timer takes it out of the state."""

    #: Attempts that can matter: the decisions there are, and the one that gives up.
    ATTEMPTS = 2 * MOST + 3 + 1

    def __init__(self, key: str, order: str, keep: int):
        self.key, self.order, self.keep = key, order, keep

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("retries", STATE)

    def decide(self, s: list, b) -> str:
        if b.disk and s[0] < MOST:
            s[0] += 1
            return "disk-space"
        if b.audio and not s[1]:
            s[1] = True
            return "reencode-audio"
        if b.subtitle and not s[3]:
            again = s[2]
            s[2], s[3] = not again, again
            return "skip-subtitles" if again else "reencode-subtitles"
        if b.session and s[4] < MOST:
            s[4] += 1
            return "session-limit"
        s[:] = [0, False, False, False, 0, True]
        return "bail"

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        first, last = None, 0  # the earliest attempts of this batch, as many as can matter
        for frame in rows:
            last = max(last, int(frame["heard_ms"].max()))
            first = frame if first is None else pd.concat([first, frame])
            first = first.sort_values(self.order).head(self.ATTEMPTS)
        s = list(self.state.get()) if self.state.exists() else [0, False, False, False, 0, False]
        out = []
        for r in first.itertuples() if first is not None else ():
            if s[5]:
                break
            out.append((key[0], getattr(r, self.order), self.decide(s, r)))
        self.state.update(tuple(s))
        for timer in list(self.handle.listTimers()):
            last = max(last, timer - self.keep)
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.keep)
        if out:
            yield pd.DataFrame(out, columns=[self.key, self.order, "decision"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def retries(attempts: DataFrame, key: str, order: str, bits: str = "bits", at: str = "ts", *, late: str = "1 day", keep: str = "7 days") -> DataFrame:
    """The streaming twin of the retry fold: one row per attempt with its decision, the
    state kept per key. Attempts of a batch are taken in their order, those that come
    ``late`` behind the newest are dropped. Needs the RocksDB state store (``ROCKS``)."""
    flat = attempts.select(key, order, F.col(at).alias("heard"), F.unix_millis(at).alias("heard_ms"), f"{bits}.disk", f"{bits}.audio", f"{bits}.subtitle", f"{bits}.session").withWatermark("heard", late)
    kinds = dict(attempts.dtypes)
    number, unit = keep.split()
    ms = int(number) * {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")]
    return flat.groupBy(key).transformWithStateInPandas(Retries(key, order, ms), f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, decision string", "append", "EventTime")
