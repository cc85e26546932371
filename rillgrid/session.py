"""The Spark session that the tests, the bench and local runs use."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(cpus: int | str = 8, partitions: int = 8, app: str = "rillgrid", **conf: str) -> SparkSession:
    """A local session in UTC with adaptive execution; ``conf`` holds further settings."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
