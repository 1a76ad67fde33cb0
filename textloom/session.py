"""A Spark session with the settings the library counts on; an existing one is taken as it is."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """AQE coalesces what is too small and splits what is skewed, so partitions are set for large inputs."""
    builder = SparkSession.builder.appName("textloom")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions or (master or "").startswith("local"):
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions or 2 * (os.cpu_count() or 4))
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
