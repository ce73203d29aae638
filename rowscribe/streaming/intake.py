"""Streams of sheets: profile what arrives, annotate it, look at what is ready.

Every micro-batch writes one folder named after its id and overwrites it when
it is run again, so a restart neither loses nor repeats rows.
"""

from __future__ import annotations

from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor

from rowscribe.operators import profile
from rowscribe.operators.annotate import Annotator, Embedder
from rowscribe.operators.reports import report_summary
from rowscribe.plans.annotate_report import Job, annotate_report
from rowscribe.session import configure, cut
from rowscribe.sources.sheets import WORKBOOK_GLOB, decode_workbooks, profile_workbooks


def _per_batch(stream: DataFrame, folder: str, checkpoint: str, work) -> DataStreamWriter:
    def write(batch: DataFrame, batch_id: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def profile_sheets(
    stream: DataFrame, columns: list[str], folder: str, checkpoint: str, cap: int | None = None
) -> DataStreamWriter:
    """Summaries and distinct values of every batch of sheet rows, for :func:`profile_so_far`.

    Columns that a batch shows to be beyond the cap leave no values behind.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        configure(batch.sparkSession)
        parts = profile.summaries(batch, columns).withColumn("beyond", profile.beyond(F.col("sketch"), cap))
        path = f"{folder}/parts/batch={batch_id}"
        parts.write.mode("overwrite").parquet(path)
        near = [r.column_name for r in batch.sparkSession.read.parquet(path).filter("NOT beyond").select("column_name").collect()]
        named = {c: i for i, c in enumerate(columns)}
        found = profile.distinct_values(batch, near, named) if near else batch.sparkSession.createDataFrame([], "position int, value string")
        found.write.mode("overwrite").parquet(f"{folder}/values/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def profile_so_far(spark: SparkSession, folder: str, cap: int | None = None) -> DataFrame:
    """One profile of all rows that have arrived; ``cap`` as given to :func:`profile_sheets`."""
    return profile.merged_profile(spark.read.parquet(f"{folder}/parts"), spark.read.parquet(f"{folder}/values"), cap)


_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def workbook_stream(spark: SparkSession, folder: str, max_files: int = 100, max_bytes: int | None = None) -> DataFrame:
    """Workbooks as they arrive in a folder, by default of any size."""
    files = (
        spark.readStream.format("binaryFile")
        .schema(_FILE)
        .option("pathGlobFilter", WORKBOOK_GLOB)
        .option("maxFilesPerTrigger", max_files)
        .load(folder)
    )
    return files if max_bytes is None else files.filter(F.col("length") <= max_bytes)


def profile_workbook_stream(stream: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """Profile of all sheets of arriving workbooks."""
    return _per_batch(stream, folder, checkpoint, lambda batch: profile_workbooks(decode_workbooks(batch)))


class _Buffer(StatefulProcessor):
    """Rows of a group, held as JSON until the group is whole."""

    def __init__(self, quiet: int):
        self.quiet = quiet

    def init(self, handle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "row string")

    def close(self) -> None:
        pass

    def _released(self, key: tuple) -> pd.DataFrame:
        held = [row for (row,) in self.rows.get()]
        self.rows.clear()
        return pd.DataFrame({"key": pd.Series([key[0]] * len(held), dtype=object), "packed": pd.Series(held, dtype=object)})

    def handleInputRows(self, key, rows, timerValues):
        last, ended = None, False
        for pdf in rows:
            self.rows.appendList([(row,) for row in pdf["packed"]])
            latest = int(pdf["at"].max())
            last, ended = latest if last is None else max(last, latest), ended or bool(pdf["ends"].any())
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if ended:
            yield self._released(key)
        else:
            self.handle.registerTimer(-(-last // 1000) + self.quiet)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield self._released(key)


def whole_groups(stream: DataFrame, key: str, time: str, quiet_seconds: int, ends: Column | None = None) -> DataFrame:
    """The rows of a stream, each group at once when it is whole.

    A group is whole when one of its rows is marked by ``ends``, or when the stream's
    clock (``time``, in microseconds) is ``quiet_seconds`` past its last row. Rows that
    come later are a group of their own. A group is one value and must fit into a task.
    """
    row = F.to_json(F.struct(*stream.columns), {"ignoreNullFields": "false"})
    marked = F.coalesce(F.lit(False) if ends is None else ends, F.lit(False))
    packed = stream.select(F.col(key).alias("key"), row.alias("packed"), F.col(time).cast("bigint").alias("at"), marked.alias("ends"))
    timed = packed.withColumn("clock", F.timestamp_micros("at")).withWatermark("clock", "0 seconds")
    kind = stream.schema[key].dataType.simpleString()
    whole = timed.groupBy("key").transformWithStateInPandas(_Buffer(quiet_seconds * 1000), f"key {kind}, packed string", "append", "eventTime")
    return whole.select(F.from_json("packed", stream.schema).alias("r")).select("r.*")


def annotate_stream(
    stream: DataFrame,
    job: Job,
    annotator: Annotator,
    folder: str,
    checkpoint: str,
    cache: DataFrame | None = None,
    semantic: DataFrame | None = None,
    embedder: Embedder | None = None,
) -> DataStreamWriter:
    """Annotate report rows batch by batch; finished rows are visible at once.

    All batches share one journal, so an input that comes again in a later batch, or a
    batch that is run again, asks nothing twice. Caches are read by every batch as they
    are then. A grouped job takes a stream of :func:`whole_groups`.
    """
    shared = replace(job, journal=job.journal or f"{folder}-journal")

    def write(batch: DataFrame, batch_id: int) -> None:
        # Written first: a batch with state behind it must not be evaluated twice.
        rows = cut(batch, "batch")
        if not rows.isEmpty():
            done = annotate_report(rows, shared, annotator, cache, semantic, embedder).rows
            done.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def partial_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Summary of the rows finished so far."""
    return report_summary(spark.read.parquet(folder)).withColumn("partial", F.lit(True))
