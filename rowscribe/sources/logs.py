"""Log files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Lines of log files with their file and their place in it.

    A task reads one block of a file from front to back, so the start of the
    block and the row id together give the order of the lines.
    """
    lines = spark.read.text(list(paths)).withColumn("row_id", F.monotonically_increasing_id())
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        "row_id",
        F.col("value").alias("line"),
    )
