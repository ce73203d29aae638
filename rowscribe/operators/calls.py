"""Calls of user functions: a bounded number at a time, answers kept as they come.

Requests are cut into tasks of a bounded number of calls, and the tasks into waves.
A wave has at most as many tasks as may call at a time, and every task holds its
share of the limit open, so the number of open calls depends neither on the data
nor on the cluster. Tasks append their answers to a journal when they finish, each
on its own: a stopped run keeps the answers of all finished tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowscribe.session import scratch_path

#: Calls of one task: what a lost executor may have to repeat.
TASK_CALLS = 500
#: A finished task's file is moved to its place at once, not when the whole job ends.
_AT_ONCE = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}


def empty_journal(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """Make the journal at ``path`` if it is not there yet; answers in it stay."""
    spark.createDataFrame([], schema).write.mode("append").options(**_AT_ONCE).parquet(path)


def call_in_waves(
    requests: DataFrame,
    key: str,
    argument: str,
    call: Callable,
    reply: T.StructType,
    path: str,
    *,
    limit: int,
    task_calls: int = TASK_CALLS,
    stop: Column | None = None,
) -> None:
    """Append ``requests`` (without ``argument``) and the reply of ``call(argument)`` to the journal at ``path``.

    ``key`` is unique. ``call`` gives one value for each field of ``reply`` and does
    not raise; a null argument is not called and gives nulls. ``stop`` is a condition on
    the replies, counted while a wave is written: after a first wave of one request, or
    any later one, with such a reply the rest is left out. A task that is lost repeats
    its own calls only. Keep speculative execution off: it would call twice.
    """
    spark = requests.sparkSession
    tasks = max(1, min(limit, spark.sparkContext.defaultParallelism))
    windows = [limit // tasks + (slot < limit % tasks) for slot in range(tasks)]
    names, fields = [f.name for f in reply.fields], [f for f in requests.schema.fields if f.name != argument]
    schema = T.StructType([*fields, *reply.fields])

    def reply_all(batches):
        for pdf in batches:
            for slot, part in pdf.groupby("_slot"):
                with ThreadPoolExecutor(windows[slot]) as pool:
                    replies = list(pool.map(lambda a: [None] * len(names) if a is None else call(a), part[argument]))
                found = pd.DataFrame(replies, columns=names, index=part.index, dtype=object)
                yield pd.concat([part[[f.name for f in fields]], found], axis=1)

    count = requests.count()
    if not count:
        return
    # Written once, a folder of one file per wave, so that a wave lists and reads its own
    # requests only, whatever the number of waves.
    planned = scratch_path(spark, "requests")
    parts = max(1, -(-count // task_calls))
    part = F.pmod(F.xxhash64(key), F.lit(parts))
    slots = requests.withColumn("_part", part).withColumn("_slot", (F.col("_part") % tasks).cast("int"))
    wave = F.expr(f"_part div {tasks}").cast("int")
    if stop is not None:
        # One request alone tells whether there is anybody to ask.
        first = F.lit(requests.agg(F.min(F.xxhash64(key))).first()[0])
        wave = F.when(F.xxhash64(key) == first, -1).otherwise(wave)
    waves = -(-parts // tasks)
    dealt = slots.withColumn("_wave", wave).drop("_part").repartitionById(waves + 1, F.col("_wave") + 1)
    dealt.write.partitionBy("_wave").parquet(planned)
    kind = T.StructType([*requests.schema.fields, T.StructField("_slot", T.IntegerType())])
    all_waves = spark.read.schema(T.StructType([*kind.fields, T.StructField("_wave", T.IntegerType())])).parquet(planned)
    for row in all_waves.select("_wave").distinct().orderBy("_wave").collect():
        now = spark.read.schema(kind).parquet(f"{planned}/_wave={row._wave}")
        asked = now.repartitionById(tasks, F.col("_slot")).mapInPandas(reply_all, schema)
        seen = Observation()
        if stop is not None:
            asked = asked.observe(seen, F.count_if(stop).alias("stops"))
        asked.write.mode("append").options(**_AT_ONCE).parquet(path)
        if stop is not None and seen.get["stops"]:
            return
