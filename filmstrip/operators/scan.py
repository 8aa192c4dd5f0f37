"""Running sums, minima and last values over keys of any size: a two-level scan.

A window over a key puts all of its rows into one task. Here rows are dealt by ranges of
(key, order) and written with their range's number, so a large key is spread over many
ranges. What each range holds of a key is summed up, a window over those few sums (one
per key and range) gives what came before each range, and a window within (key, range)
does the rest. Only the first key of a range can have begun before it, so what came
before is a table of at most one row per range, which is what makes its broadcast safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written

RANGE = "_range"


def dealt(rows: DataFrame, key: list[str], order: list[str], ranges: int | None = None) -> DataFrame:
    """``rows`` with the number of their range; numbers follow (key, order)."""
    by = [F.col(c) for c in [*key, *order]]
    parts = rows.repartitionByRange(ranges, *by) if ranges else rows.repartitionByRange(*by)
    return written(parts.withColumn(RANGE, F.spark_partition_id()), "scan")


class Running:
    """A value that runs along the rows of a key: how it is made from rows, from what
    ranges made, and from what came before and what is within."""

    def __init__(self, value: Column, fold, both):
        self.value, self.fold, self.both = value, fold, both


def running_sum(value: Column) -> Running:
    """Null until there is a value, as sums over windows are."""
    return Running(value, F.sum, lambda a, b: F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))))


def running_count() -> Running:
    return Running(F.lit(1), F.count, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))


def running_min(value: Column) -> Running:
    return Running(value, F.min, F.least)


def running_last(value: Column, order: list[str]) -> Running:
    """The last value that isn't null; ``order`` as the scan's."""
    at = F.when(value.isNotNull(), F.struct(*[F.col(c).alias(f"o{n}") for n, c in enumerate(order)], value.alias("value")))
    return Running(at, F.max, lambda a, b: F.coalesce(b, a)["value"])


def scan(rows: DataFrame, key: list[str], order: list[str], running: dict[str, Running], *, before: bool = False, ranges: int | None = None) -> DataFrame:
    """``rows`` with a column for each running value: of the key's rows up to and with
    this one, or, with ``before``, of those before it.

    ``order`` must tell the rows of a key apart, else what ties see of each other is
    open; nulls come first, null keys are one key. An empty table gives no rows."""
    names = {n: f"_v{k}" for k, n in enumerate(running)}
    parts = dealt(rows.withColumns({v: running[n].value for n, v in names.items()}), key, order, ranges)
    sums = parts.groupBy(*key, RANGE).agg(*[running[n].fold(v).alias(v) for n, v in names.items()])
    earlier = Window.partitionBy(*key).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    first = Window.partitionBy(*key).orderBy(RANGE)
    fold_of = {n: F.sum if running[n].fold is F.count else running[n].fold for n in running}
    carried = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col(RANGE).alias("_at"), F.row_number().over(first).alias("_nth"), *[fold_of[n](v).over(earlier).alias(f"{v}_before") for n, v in names.items()]).where("_nth > 1").drop("_nth")
    same = F.col(RANGE) == F.col("_at")
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    within = Window.partitionBy(*key, RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow)
    out = parts.join(F.broadcast(carried), same, "left")  # at most one row per range
    out = out.withColumns({n: running[n].both(F.col(f"{v}_before"), running[n].fold(v).over(within)) for n, v in names.items()})
    return out.select(*[c for c in rows.columns if c not in running], *running)
