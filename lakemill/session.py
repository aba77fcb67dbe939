"""The engine's Spark session."""

from pyspark.sql import SparkSession


def session(name: str = "lakemill", **options: str) -> SparkSession:
    """A session with adaptive execution and UTC; options given (dots as double underscores) win over these."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in options.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
