"""Sessions with the settings that the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "sondage", **settings: str) -> SparkSession:
    """A session; `settings` override the engine's, with __ for a dot in their names."""
    conf = SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}
    return SparkSession.builder.appName(name).config(map=conf).getOrCreate()
