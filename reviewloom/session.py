"""Session settings the operators are designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Strict casts must fail on bad values instead of turning them into nulls.
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Joins carry no hints on tables: AQE measures a side before broadcasting it
    # and splits the partitions of a hot key when neither side fits.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def session_builder(app_name: str = "reviewloom") -> SparkSession.Builder:
    """A builder with the library's settings; master and sizes are left to the caller."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder
