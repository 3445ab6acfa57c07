"""The session that tests and the bench use; a cluster brings its own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "tessera", cpus: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with adaptive execution, UTC and as many shuffle partitions as cores."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
