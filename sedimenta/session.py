"""Session factory. Library code never relies on these settings for results."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def create_spark(app_name: str, master: str = "local[*]") -> SparkSession:
    """A UTC session; SPARK_SHUFFLE_PARTITIONS (16) and SPARK_DRIVER_MEMORY (4g) come from the environment."""
    return (
        SparkSession.builder.appName(app_name)
        .master(master)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", os.environ.get("SPARK_SHUFFLE_PARTITIONS", "16"))
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "4g"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
