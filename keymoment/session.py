"""A Spark session with the settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "keymoment", master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """Adaptive execution with skew splitting, UTC, and shuffle partitions as given (else the cluster's)."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    b = b.config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.ui.showConsoleProgress", "false")
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
