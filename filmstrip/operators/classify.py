"""The gate that decides what happens to an item: the first condition that holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REASONS = {"too_short": "duration too short", "needs_10bit": "10-bit source, but the device has no 10-bit encoder", "unwritable": "destination is not writable", "ambiguous": "ambiguous primary audio"}
OUTCOMES = ["probe-error", "skip", "skip-silent", "resumed", "transcode"]


def outcome(*, error: Column, too_short: Column, meets_target: Column, needs_10bit: Column, resumed: Column, unwritable: Column, ambiguous: Column, reasons: dict[str, Column] | None = None) -> Column:
    """struct(outcome, reason). Conditions that are null don't hold; the order is that
    of the parameters. ``reasons``: by condition, what to say instead of the plain reason,
    where it isn't null."""
    say = lambda name: F.coalesce((reasons or {}).get(name, F.lit(None).cast("string")), F.lit(REASONS[name]))
    on = lambda c: F.coalesce(c, F.lit(False))
    made = lambda kind, reason=None: F.struct(F.lit(kind).alias("outcome"), (F.lit(None).cast("string") if reason is None else reason).alias("reason"))
    return (
        F.when(error.isNotNull(), made("probe-error", error))
        .when(on(too_short), made("skip", say("too_short")))
        .when(on(meets_target), made("skip-silent"))
        .when(on(needs_10bit), made("skip", say("needs_10bit")))
        .when(on(resumed), made("resumed"))
        .when(on(unwritable), made("skip", say("unwritable")))
        .when(on(ambiguous), made("skip", say("ambiguous")))
        .otherwise(made("transcode"))
    )


def counts(items: DataFrame, outcome_col: str = "outcome", size_col: str | None = None) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n")]
    if size_col:
        aggs.append(F.sum(size_col).alias("bytes"))
    return items.groupBy(outcome_col).agg(*aggs)


def partition(items: DataFrame) -> DataFrame:
    """One row: how many items are skipped, resumed, failing, and to do."""
    n = lambda *kinds: F.count_if(F.col("outcome").isin(*kinds))
    return items.agg(n("skip", "skip-silent").alias("skipped"), n("resumed").alias("resumed"), n("probe-error").alias("errors"), n("transcode").alias("to_transcode"))
