"""Sessions: a local one with the settings the package expects, and one beside a cluster's own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: str | int = "*", app: str = "groundswell", **extra: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.log.level", "ERROR")
    )
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


# What a caller may have set at run time and a new session would not know.
_CARRIED = ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.files.maxPartitionBytes", "spark.checkpoint.dir")


def beside(spark: SparkSession, settings: dict[str, str]) -> SparkSession:
    """A session of the same application with other settings; the caller's stay as they are."""
    other = spark.newSession()
    for key in _CARRIED:
        value = spark.conf.get(key, None)
        if value is not None and other.conf.isModifiable(key):
            other.conf.set(key, value)
    for key, value in settings.items():
        other.conf.set(key, value)
    return other
