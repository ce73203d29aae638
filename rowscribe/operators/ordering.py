"""Order-dependent work without one task per key.

Rows are spread over range partitions by key *and* order, so a key that holds
most of the rows is cut into many chunks. What has to pass from one chunk to the
next (a count, the last values) is computed from one small row per key and chunk.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowscribe.session import cut


def chunked(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Spread rows by (key, order) over range partitions and name the chunk.

    The order columns must be unique per key, so a hot key is cut into many
    chunks. Chunk numbers depend on sampled bounds; the copy is written out so
    that every later read sees the same ones.
    """
    spread = df.repartitionByRange(*keys, *order).withColumn("_chunk", F.spark_partition_id())
    return cut(spread)


def with_carry(chunks: DataFrame, keys: list[str], order: list[str], carried: dict[str, Column]) -> DataFrame:
    """Rows plus one leading row per (key, chunk) that holds the state before it.

    ``carried`` are aggregates that give the state at the end of a chunk; the
    state before a chunk is the last non-null one of the earlier chunks. Leading
    rows have ``_carry`` set.
    """
    ends = chunks.groupBy(*keys, "_chunk").agg(*[agg.alias(name) for name, agg in carried.items()])
    # One row per key and chunk: the window of a hot key has as many rows as chunks.
    earlier = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    lead = ends.select(
        *keys,
        "_chunk",
        *[F.last(name, ignorenulls=True).over(earlier).alias(name) for name in carried],
    )
    lead = lead.withColumn("_carry", F.lit(True))
    return chunks.withColumn("_carry", F.lit(False)).unionByName(lead, allowMissingColumns=True)


def carry_window(keys: list[str], order: list[str]):
    """Window of one chunk of one key with its leading row first."""
    return W.partitionBy(*keys, "_chunk").orderBy(F.desc("_carry"), *order)


def sequential_number(
    df: DataFrame, order: str | list[str], out: str, within: list[str] | None = None, start: int = 1
) -> DataFrame:
    """Number rows ``start``, ``start+1``, ... by ``order``, unique within ``within``.

    The rows are moved once, into the order they are numbered in, and written; a row
    knows its place in its partition. What lies before a partition comes from one
    small row per key and partition and is added in place.
    """
    keys, orders = within or [], [order] if isinstance(order, str) else order
    spread = df.repartitionByRange(*keys, *orders).sortWithinPartitions(*keys, *orders)
    placed = cut(spread.withColumn("_at", F.monotonically_increasing_id()), "ordered").withColumn("_chunk", F.shiftright("_at", 33))
    ends = placed.groupBy(*keys, "_chunk").agg(F.min("_at").alias("_begin"), F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy(*(keys or [F.lit(0)])).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    ends = ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_chunk").alias("_of"), "_begin", before.alias("_before"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("_chunk") == F.col("_of"))
    number = (F.col("_at") - F.col("_begin") + F.col("_before") + F.lit(start)).cast("bigint")
    return placed.join(ends, same).select(*df.columns, number.alias(out))
