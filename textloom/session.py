"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "textloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; `conf` entries override (dots as double underscores)."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.execution.arrow.pyspark.enabled", "true").config("spark.sql.python.filterPushdown.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
