"""A session with the settings that the library is written for."""

from pyspark.sql import SparkSession


def session(app: str = "lexloom", **settings: str) -> SparkSession:
    """UTC, adaptive execution and ANSI as Spark has them by default; cluster settings come from spark-submit."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
