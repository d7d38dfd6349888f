"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Results must not depend on the machine's time zone.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The JVM leaves larger methods uncompiled; above this size Spark's split projections are
    # several times faster (parsing nine columns in one projection is such a case).
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(app_name: str = "shelfgrade", master: str | None = None, **conf) -> SparkSession:
    """A session with the library's defaults; ``conf`` wins over them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
