"""Session settings for local runs. On a cluster the session is given and only read."""

from __future__ import annotations

from pyspark import SparkConf
from pyspark.sql import SparkSession


def local_session(cores: int = 8, app: str = "leafvoice", checkpoint_dir: str | None = None) -> SparkSession:
    """``checkpoint_dir`` is used only where the defaults name no folder."""
    builder = SparkSession.builder
    if checkpoint_dir and not SparkConf().get("spark.checkpoint.dir"):
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    spark = (
        builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
