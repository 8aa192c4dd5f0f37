"""A session for the library's jobs."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "filmstrip", **conf: str) -> SparkSession:
    """Adaptive plans, UTC, Arrow; what the caller or the cluster sets goes first."""
    b = SparkSession.builder.appName(name)
    for k, v in ({"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"} | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()
