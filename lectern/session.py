"""Session settings this library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "lectern", **settings: str) -> SparkSession:
    """A session with adaptive execution, Arrow transfer and UTC; settings use _ for dots in their names."""
    b = SparkSession.builder.appName(name)
    for k, v in {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.parquet.aggregatePushdown": "true",
    }.items():
        b = b.config(k, v)
    for k, v in settings.items():
        b = b.config(k.replace("_", "."), v)
    return b.getOrCreate()
