"""A session with the settings that the operators are planned for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "larder", master: str | None = None, **settings: str) -> SparkSession:
    """AQE with skew handling on, UTC, Arrow; pass further settings with ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC",
                "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for key, value in (defaults | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
