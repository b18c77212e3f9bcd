"""Session with the settings that the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, app: str = "calibrant", **conf: str) -> SparkSession:
    """UTC, adaptive execution and ANSI on; anything else is the cluster's choice."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.ansi.enabled": "true"}
    for key, value in (base | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
