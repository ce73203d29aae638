"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # Later entries of a merged map win instead of raising.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Small stages with heavy rows (model calls, vectors) keep their parallelism.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed side even when that costs one more shuffle later on.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Partial top-k before the shuffle of rank filters (newest N per key).
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
    # Merge the sessions of one key inside a task before they are shuffled.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    # Timers and state of jobs live in the engine's store.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

#: Whether the files of a query's shuffles are removed when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings every plan of this package relies on."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach: that of ``spark.checkpoint.dir``, else one below the warehouse."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return configured.rstrip("/") if configured else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the shared folder, never reused."""
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/rowscribe-{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> bool:
    """Delete what this application wrote there; call it when its results are stored."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    return path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder once and go on from the files.

    Used where rows must not be produced twice (paid model calls, partition
    numbers). A lost executor only re-reads files, and every later plan reads
    just the columns it needs. What the write shuffled goes when it ends, and not
    when the driver happens to collect its garbage.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    _without_traces(spark, lambda: df.write.parquet(path))
    return spark.read.schema(df.schema).parquet(path)


def cut_by(df: DataFrame, column: str, buckets: int, name: str = "cut") -> DataFrame:
    """As ``cut``, in files by the hash of ``column``: what groups by it later reads them as they lie and does not shuffle them.

    Spark keeps the order of buckets with a table, so this is one, over the scratch folder.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    table = f"rowscribe_{uuid.uuid4().hex}"
    _without_traces(spark, lambda: df.write.bucketBy(buckets, column).option("path", path).format("parquet").saveAsTable(table))
    return spark.table(table)


def _without_traces(spark: SparkSession, write) -> None:
    """``write()``, after which the files of its shuffles go."""
    before = spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")
    try:
        write()
    finally:
        spark.conf.set(CLEAN_UP, before)
