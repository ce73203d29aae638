"""Stored report rows: append, ordered scan, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rowscribe.operators.maintenance import insert_missing

BUCKETS = 100


def with_bucket(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Add the folder column that lets a scan of one report skip the others."""
    return rows.withColumn("report_bucket", F.pmod(F.xxhash64("report_id"), F.lit(buckets)).cast("int"))


def ingest_rows(spark: SparkSession, rows: DataFrame, path: str, existing: DataFrame | None) -> int:
    """Append rows that are not stored yet and say how many there were."""
    new = insert_missing(existing, rows, ["report_id", "row_number"])
    counted = Observation()
    bucketed = with_bucket(new).observe(counted, F.count(F.lit(1)).alias("inserted"))
    bucketed.write.partitionBy("report_bucket").mode("append").parquet(path)
    return counted.get["inserted"]


def report_scan(rows: DataFrame, report_id: str, buckets: int = BUCKETS) -> DataFrame:
    """Rows of one report in order; a bucketed table reads one bucket."""
    found = rows.filter(F.col("report_id") == report_id)
    if "report_bucket" in rows.columns:
        bucket = F.pmod(F.xxhash64(F.lit(report_id)), F.lit(buckets)).cast("int")
        found = found.filter(F.col("report_bucket") == bucket).drop("report_bucket")
    return found.orderBy("row_number")
