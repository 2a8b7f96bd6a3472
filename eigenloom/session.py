"""Session settings that the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive plans split skewed joins and merge small partitions; Arrow carries matrix rows to numpy.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def session(app: str = "eigenloom", **more: str) -> SparkSession:
    """A session with SETTINGS and any further ones (dots written as two underscores)."""
    builder = SparkSession.builder.appName(app).config(map=SETTINGS)
    for key, value in more.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
