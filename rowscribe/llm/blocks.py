"""Blocks of texts, and buckets of keys that blocks ask about.

An operator that compares every text with all others deals texts to blocks of
about ``BLOCK_BYTES``, sends the distinct 64-bit keys of a block to buckets, and
gets back what the bucket knows. A key that a third of all texts hold reaches
its bucket once for each block, never once for each text. A block's texts are
sorted, so a rerun after a lost executor numbers them alike.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 8 << 20


def block_count(docs: DataFrame, text: str = "text") -> int:
    """Blocks for all texts, from their counted bytes."""
    size = docs.select(F.sum(F.octet_length(text)).alias("size")).first().size or 0
    return max(1, math.ceil(size / BLOCK_BYTES))


def in_blocks(docs: DataFrame, blocks: int, text: str = "text") -> DataFrame:
    """Columns block, doc_id and text."""
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    return docs.select(F.pmod(F.xxhash64("doc_id", F.octet_length(text)), F.lit(blocks)).cast("int").alias("block"), doc_id, F.col(text).cast("string").alias("text"))


def ordered(table: pa.Table) -> pa.Table:
    """A block's rows in an order that depends on the rows alone."""
    return table.combine_chunks().sort_by([("doc_id", "ascending"), ("text", "ascending")])


def bucket_slices(hashes: np.ndarray, buckets: int):
    """(bucket, slice) of sorted hashes; bucket limits cut the range of hashes evenly."""
    owner = ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    for bucket in np.unique(owner):
        yield int(bucket), slice(int(np.searchsorted(owner, bucket)), int(np.searchsorted(owner, bucket, "right")))


def joined(column: pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """The binary values of a column as one array, and the entries in each value."""
    parts = [np.frombuffer(x.as_buffer(), kind) for x in column]
    return (np.concatenate(parts) if parts else np.zeros(0, kind)), np.array([len(p) for p in parts], np.int64)
