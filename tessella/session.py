"""Spark session with the settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build(app: str = "tessella", master: str | None = None, **more: str) -> SparkSession:
    """A session; `more` overrides the settings.  Memory, executors and shuffle partitions are the cluster's to say."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    return b.config(map=SETTINGS | more).getOrCreate()
