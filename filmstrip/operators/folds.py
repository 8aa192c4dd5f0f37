"""Decisions that depend on earlier ones: retries, ramps, caps, admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.errors import NOTHING_WRITTEN, is_audio_copy, is_disk_space, is_session_limit, is_subtitle
from ..functions.predicates import should_freeze
from . import scan

DISK_MARGIN = 2 * 1024**3
MOST = 5
#: Decisions of a file at most, and the one that gives up.
ATTEMPTS = 2 * MOST + 3 + 1
STATE = "struct<disk:int,audio:boolean,subtitle:boolean,skip:boolean,session:int,over:boolean,decisions:array<string>>"


def failure_bits(text: Column) -> Column:
    """What a retry needs to know of an attempt's message."""
    return F.struct(is_disk_space(text).alias("disk"), is_audio_copy(text).alias("audio"), (is_subtitle(text) | text.contains(NOTHING_WRITTEN)).alias("subtitle"), is_session_limit(text).alias("session"))


def retry_decision(s: Column, b: Column) -> Column:
    return (
        F.when(b["disk"] & (s["disk"] < MOST), "disk-space")
        .when(b["audio"] & ~s["audio"], "reencode-audio")
        .when(b["subtitle"] & ~s["subtitle"] & ~s["skip"], "reencode-subtitles")
        .when(b["subtitle"] & ~s["skip"], "skip-subtitles")
        .when(b["session"] & (s["session"] < MOST), "session-limit")
        .otherwise("bail")
    )


def retry_fold(attempts: DataFrame, key: list[str], order: list[str], bits: Column) -> DataFrame:
    """Per file its decisions in order of attempts, until it gives up, and the state
    after them. A file's attempts are bounded by the decisions themselves, at most 13;
    what comes after it gave up is left out of the fold, and what can only come after
    isn't gathered."""
    rows = attempts.select(*key, F.struct(*order, bits.alias("bits")).alias("a"))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("a"))).where(F.col("nth") <= ATTEMPTS)
    lists = rows.groupBy(*key).agg(F.array_sort(F.collect_list("a")).alias("a"))
    zero = F.struct(F.lit(0).alias("disk"), F.lit(False).alias("audio"), F.lit(False).alias("subtitle"), F.lit(False).alias("skip"), F.lit(0).alias("session"), F.lit(False).alias("over"), F.array().cast("array<string>").alias("decisions"))

    def step(s: Column, a: Column) -> Column:
        d = retry_decision(s, a["bits"])
        after = F.struct(
            (s["disk"] + (d == "disk-space").cast("int")).alias("disk"),
            (s["audio"] | (d == "reencode-audio")).alias("audio"),
            F.when(d == "skip-subtitles", False).otherwise(s["subtitle"] | (d == "reencode-subtitles")).alias("subtitle"),
            (s["skip"] | (d == "skip-subtitles")).alias("skip"),
            (s["session"] + (d == "session-limit").cast("int")).alias("session"),
            (d == "bail").alias("over"),
            F.concat(s["decisions"], F.array(d)).alias("decisions"),
        )
        return F.when(s["over"], s).otherwise(after)

    s = F.aggregate("a", zero.cast(STATE), lambda s, a: step(s, a).cast(STATE))
    return lists.select(*key, s.alias("s")).select(*key, "s.decisions", F.col("s.disk").alias("disk_retries"), F.col("s.session").alias("session_retries"), F.col("s.audio").alias("audio_reencoded"), F.col("s.skip").alias("subtitles_skipped"), F.col("s.over").alias("gave_up"))


def ramp_action(reporting: Column, current: Column, total: Column, baseline: Column) -> Column:
    """wait, ramp-up, stall or stall-revert; speeds may be decimals of 20 digits."""
    floor = F.floor(baseline.cast("decimal(20,0)") * F.lit(85).cast("decimal(3,0)") / F.lit(100).cast("decimal(3,0)"))
    return F.when((reporting < current) | (total == 0), "wait").when((baseline == 0) | (total > baseline), "ramp-up").when(total < floor, "stall-revert").otherwise("stall")


RAMP = "struct<current:int,baseline:bigint,ramping:boolean,last:bigint,actions:array<string>>"


def ramp_fold(ticks: DataFrame, key: list[str], *, at: Column, reporting: Column, total: Column, start: int = 1, forced: Column | None = None, every: int = 5000) -> DataFrame:
    """Per run, the actions at its ticks (at: milliseconds) and the concurrency they end
    with. A tick within ``every`` of the last ramp-up waits; a forced value overrides
    the concurrency while it is there and lets ramping start anew when it goes."""
    forced = F.lit(0) if forced is None else F.coalesce(forced, F.lit(0))
    lists = ticks.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(at.cast("bigint").alias("t"), reporting.cast("int").alias("r"), total.cast("bigint").alias("v"), forced.cast("int").alias("f")))).alias("a"))
    zero = F.struct(F.lit(start).alias("current"), F.lit(0).cast("bigint").alias("baseline"), F.lit(True).alias("ramping"), F.lit(-(10**15)).alias("last"), F.array().cast("array<string>").alias("actions")).cast(RAMP)

    def step(s: Column, x: Column) -> Column:
        action = F.when(x["f"] > 0, "forced").when(~s["ramping"], "off").when(x["t"] - s["last"] < every, "wait").otherwise(ramp_action(F.coalesce(x["r"], s["current"]), s["current"], x["v"], s["baseline"]))
        current = F.when(x["f"] > 0, x["f"]).when(action == "ramp-up", s["current"] + 1).when(action == "stall-revert", F.greatest(s["current"] - 1, F.lit(1))).otherwise(s["current"])
        return F.struct(
            current.alias("current"),
            F.when(action == "ramp-up", x["v"]).otherwise(s["baseline"]).alias("baseline"),
            F.when(action == "forced", True).when(action.startswith("stall"), False).otherwise(s["ramping"]).alias("ramping"),
            F.when(action == "ramp-up", x["t"]).otherwise(s["last"]).alias("last"),
            F.concat(s["actions"], F.array(action)).alias("actions"),
        ).cast(RAMP)

    s = F.aggregate("a", zero, step)
    return lists.select(*key, s.alias("s")).select(*key, F.col("s.actions").alias("actions"), F.col("s.current").alias("final_max"), F.col("s.baseline").alias("baseline"), F.col("s.ramping").alias("ramping"))


def running_cap(events: DataFrame, key: list[str], order: list[str], value: Column, *, ranges: int | None = None) -> DataFrame:
    """``events`` with hits so far, the smallest value so far (at least 1), and whether
    that froze the cap."""
    out = scan.scan(events, key, order, {"hits": scan.running_count(), "cap": scan.running_min(value)}, ranges=ranges)
    return out.withColumn("cap", F.greatest("cap", F.lit(1))).withColumn("frozen", should_freeze(F.col("hits")))


def admission(events: DataFrame, key: list[str], order: list[str], change: Column, most: int | None = None, *, ranges: int | None = None) -> DataFrame:
    """``events`` with how many are active after each, and whether that fits."""
    out = scan.scan(events, key, order, {"active": scan.running_sum(change)}, ranges=ranges)
    return out if most is None else out.withColumn("admitted", F.col("active") <= most)


def disk_gate(requests: DataFrame, key: list[str], order: list[str], available: Column, estimate: Column, *, release: Column | None = None, ranges: int | None = None) -> DataFrame:
    """``requests`` with what is reserved before each and whether there is room: nothing
    is reserved, or the rest keeps a margin. A row reserves its estimate and gives
    ``release`` (by default nothing) back; both are as logged, so reserved is the sum of
    what came before, at least 0."""
    change = estimate if release is None else F.coalesce(estimate, F.lit(0)) - F.coalesce(release, F.lit(0))
    out = scan.scan(requests, key, order, {"reserved": scan.running_sum(change)}, before=True, ranges=ranges)
    out = out.withColumn("reserved", F.greatest(F.coalesce("reserved", F.lit(0)), F.lit(0)))
    return out.withColumn("room", (F.col("reserved") == 0) | (F.greatest(available - F.col("reserved"), F.lit(0)) >= estimate + DISK_MARGIN))


FLAGS = {"enabled": True, "paused": False, "max_jobs": 0}


def flags_as_of(ticks: DataFrame, changes: DataFrame, key: list[str], at: str = "ts", tie: list[str] | None = None, *, ranges: int | None = None) -> DataFrame:
    """``ticks`` with the flags that hold at each: for every flag the value set last at
    or before the tick, each flag by itself; defaults where none was set or it was set
    back to null. ``changes``: the key, ``at``, flag and value (strings). An as-of join
    by union and last value, so a key of any size is spread over tasks. Of changes at
    one time the largest value holds; ``tie`` tells apart the ticks of one time."""
    tie = tie or []
    set_ = changes.groupBy(*key, at).agg(*[F.max(F.when(F.col("flag") == f, F.struct(F.lit(1).alias("set"), F.col("value").alias("to")))).alias(f"_{f}") for f in FLAGS])
    both = ticks.withColumn("_side", F.lit(1)).unionByName(set_.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    order = [at, "_side", *tie]
    out = scan.scan(both, key, order, {f: scan.running_last(F.col(f"_{f}"), order) for f in FLAGS}, ranges=ranges).where("_side = 1")
    truth = lambda f: F.coalesce(F.col(f)["to"].try_cast("boolean"), F.lit(FLAGS[f]))
    jobs = F.greatest(F.coalesce(F.col("max_jobs")["to"].try_cast("int"), F.lit(0)), F.lit(0))
    return out.select(*ticks.columns, truth("enabled").alias("enabled"), truth("paused").alias("paused"), jobs.alias("max_jobs"))


def flag_override(ticks: DataFrame, key: list[str], order: list[str], max_jobs: Column, session_hit: Column, *, slots: Column | int, ranges: int | None = None) -> DataFrame:
    """``ticks`` with what the flag for parallel jobs does at each: ``forced``, the flag
    held between 1 and the slots there are (null where it isn't set), ``rearmed``, whether
    ramping starts anew because the flag has just gone, and ``frozen``, whether session
    limits have pinned the run by then, after which nothing is rearmed."""
    held = ticks.withColumns({"_flag": F.greatest(F.coalesce(max_jobs, F.lit(0)), F.lit(0)), "_hit": F.coalesce(session_hit.cast("int"), F.lit(0))})
    out = scan.scan(held, key, order, {"_was": scan.running_last(F.col("_flag"), order), "_hits": scan.running_sum(F.col("_hit"))}, before=True, ranges=ranges)
    frozen = should_freeze(F.coalesce("_hits", F.lit(0)) + F.col("_hit"))
    most = F.greatest(F.lit(slots) if isinstance(slots, int) else slots, F.lit(1))
    rearmed = (F.col("_flag") == 0) & (F.coalesce("_was", F.lit(0)) > 0) & ~frozen
    return out.select(*ticks.columns, F.when(F.col("_flag") > 0, F.least("_flag", most)).alias("forced"), rearmed.alias("rearmed"), frozen.alias("frozen"))
