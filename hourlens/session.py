"""Session settings the jobs are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    # Splits a shuffled key that is too large for one task, also in front of another shuffle.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Expressions here are built from many Column calls; per-call stack capture slows that down.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def builder(name: str = "hourlens") -> SparkSession.Builder:
    """A session builder with these settings; master and memory are the caller's."""
    out = SparkSession.builder.appName(name)
    for key, value in SETTINGS.items():
        out = out.config(key, value)
    return out
