"""Session settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(app: str = "ostinato", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` adds to or replaces these settings.

    Shuffle partitions are left to the cluster's configuration: adaptive execution coalesces them.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return SparkSession.builder.appName(app).config(map={**settings, **conf}).getOrCreate()
