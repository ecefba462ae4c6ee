"""The session this engine is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "ridgeline", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; further settings by name, dots written as double underscores."""
    builder = SparkSession.builder.appName(app)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for key, value in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
