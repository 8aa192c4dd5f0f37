"""The two-level scan against plain loops, and how it deals one large key."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from filmstrip.operators import folds, scan


def rows(n=400, keys=(1, 2, 3, None), seed=1):
    r = random.Random(seed)
    return [(r.choice(keys), r.choice([None, *range(n // 3)]), i, r.choice([None, -3, 0, 5, 9])) for i in range(n)]


def plain(data, before):
    out = {}
    for key in {d[0] for d in data}:
        held, least, last, n = None, None, None, 0
        for _, at, i, v in sorted((d for d in data if d[0] == key), key=lambda d: (d[1] is not None, d[1] or 0, d[2])):
            if before:
                out[i] = (held, least, last, n)
            n += 1
            if v is not None:
                held, least, last = (held or 0) + v, v if least is None else min(least, v), v
            if not before:
                out[i] = (held, least, last, n)
    return out


@pytest.mark.parametrize("before", [False, True])
@pytest.mark.parametrize("keys", [(1, 2, 3, None), (7,), tuple(range(100))])
def test_scan(spark, keys, before):
    data = rows(keys=keys)
    df = spark.createDataFrame(data, "k long, at long, i long, v long").repartition(3)
    v, order = F.col("v"), ["at", "i"]
    out = scan.scan(df, ["k"], order, {"held": scan.running_sum(v), "least": scan.running_min(v), "last": scan.running_last(v, order), "n": scan.running_count()}, before=before, ranges=8)
    assert out.columns == ["k", "at", "i", "v", "held", "least", "last", "n"]
    assert {r.i: (r.held, r.least, r.last, r.n) for r in out.collect()} == plain(data, before)
    assert scan.scan(df.limit(0), ["k"], order, {"n": scan.running_count()}).count() == 0


def test_one_key_is_spread(spark):
    """No task has a whole key: neither a range nor the window within it."""
    df = spark.range(20_000).select(F.lit(1).alias("k"), F.col("id").alias("at"), F.lit(2).alias("v"))
    parts = scan.dealt(df, ["k"], ["at"], 16)
    sizes = [r["count"] for r in parts.groupBy(scan.RANGE).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 4000
    out = folds.admission(df, ["k"], ["at"], F.col("v"), ranges=16)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert [x for x in plan.splitlines() if x.strip(" +-:").startswith("Window") and "_range" in x.split("], [")[1]]  # over (key, range)
    assert out.where("active != 2 * (at + 1)").isEmpty()
    assert out.count() == 20_000


def test_flags(spark):
    ticks = spark.createDataFrame([(1, 5, 0), (1, 10, 1), (1, 20, 2), (2, 1, 3), (None, 9, 4), (1, 31, 5)], "run long, ts long, id long")
    changes = spark.createDataFrame([(1, 10, "paused", "true"), (1, 15, "max_jobs", "-4"), (1, 15, "enabled", "false"), (1, 30, "paused", None), (1, 30, "max_jobs", "3"), (1, 30, "max_jobs", "x"), (None, 2, "enabled", "no such"), (2, 1, "max_jobs", "2")], "run long, ts long, flag string, value string")
    got = {r.id: (r.enabled, r.paused, r.max_jobs) for r in folds.flags_as_of(ticks, changes, ["run"], "ts", ["id"], ranges=3).collect()}
    assert got == {0: (True, False, 0), 1: (True, True, 0), 2: (False, True, 0), 3: (True, False, 2), 4: (True, False, 0), 5: (False, False, 0)}


def test_disk_gate_gives_back(spark):
    g = 1024**3
    data = [(1, 1, g, 0), (1, 2, g, 0), (1, 3, 0, 2 * g), (1, 4, g, 0), (2, 1, g, None)]
    df = spark.createDataFrame(data, "k long, at long, est long, back long")
    out = folds.disk_gate(df, ["k"], ["at"], F.lit(3 * g), F.col("est"), release=F.col("back"), ranges=2)
    assert {(r.k, r["at"]): (r.reserved, r.room) for r in out.collect()} == {(1, 1): (0, True), (1, 2): (g, False), (1, 3): (2 * g, False), (1, 4): (0, True), (2, 1): (0, True)}
