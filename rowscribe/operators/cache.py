"""Answer caches: exact and similarity look-up, upkeep of the cache tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowscribe import constants as K
from rowscribe.functions.validation import accepted_answer, answer_error

SEMANTIC_KEYS = [
    "provider",
    "model",
    "analysis_mode",
    "prompt_hash",
    "expected_template_hash",
    "output_schema_hash",
]
# Requests compared at a time when candidates are joined.
BLOCK_ROWS = 10_000


def exact_lookup(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests with their cached answer; both sides have unique cache keys."""
    known = cache.select(
        "cache_key",
        F.col("analysis_json").alias("cached_answer"),
        F.col("raw_json").alias("cached_raw"),
    )
    return requests.join(known, "cache_key", "left")


def check_hits(found: DataFrame, schema: dict | None, template: dict | None) -> DataFrame:
    """Check cached answers again; a broken one counts as a miss and is named."""
    hit = F.col("cached_answer").isNotNull()
    error = F.when(hit, answer_error(F.col("cached_answer"), schema, template))
    # A column of its own: the check is costly and its result is used four times.
    checked = found.withColumn("_error", error)
    note = F.concat(F.lit("cache_invalidated:"), F.substring("_error", 1, 80))
    good = hit & F.col("_error").isNull()
    return checked.withColumns(
        {
            "cache_note": F.when(good, F.lit("cache_hit")).otherwise(note),
            "invalid_hit": hit & ~good,
            "cached_answer": F.when(good, accepted_answer(F.col("cached_answer"), template)),
            "cached_raw": F.when(good, F.col("cached_raw")),
        }
    ).drop("_error")


def newest_candidates(cache: DataFrame, keys: list[str], limit: int = K.SEMANTIC_CANDIDATES) -> DataFrame:
    """The newest ``limit`` entries per key; trimmed inside each task first."""
    order = W.partitionBy(*keys).orderBy(F.desc("updated_at"), "semantic_key")
    return cache.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= limit)


def _best_matches(vectors: pd.Series, near: list) -> tuple[list, np.ndarray]:
    """Most similar candidate per vector, the newer one on a tie.

    ``near`` holds (name, vector) with the newest first. Vectors of one length
    are compared as matrices, over the common prefix with each candidate.
    """
    names, scores = np.full(len(vectors), None, dtype=object), np.full(len(vectors), np.nan)
    lengths = np.array([0 if v is None else len(v) for v in vectors])
    widths = np.array([0 if v is None else len(v) for _, v in near])
    for length in set(lengths[lengths > 0]):
        rows = np.nonzero(lengths == length)[0]
        queries = np.stack([np.asarray(vectors.iloc[i], dtype=float) for i in rows])
        found = np.zeros((len(rows), len(near)))
        for width in set(widths[widths > 0]):
            size = min(length, width)
            at = np.nonzero(widths == width)[0]
            table = np.stack([np.asarray(near[i][1], dtype=float)[:size] for i in at])
            part = queries[:, :size]
            norms = np.linalg.norm(part, axis=1)[:, None] * np.linalg.norm(table, axis=1)[None, :]
            dots = part @ table.T
            found[:, at] = np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0)
        # Rounding away the last bits makes equal vectors equal, whatever the matrix shape.
        best = np.argmax(np.round(found, 12), axis=1)
        names[rows] = [near[i][0] for i in best]
        scores[rows] = found[np.arange(len(rows)), best]
    return list(names), scores


def _scored(requests: DataFrame) -> T.StructType:
    added = [T.StructField("semantic_key", T.StringType()), T.StructField("score", T.DoubleType())]
    return T.StructType([*requests.schema.fields, *added])


def _by_join(requests: DataFrame, candidates: DataFrame, keys: list[str], block_rows: int) -> DataFrame:
    """Requests of a key in blocks of about ``block_rows``, each with its candidates.

    The candidates of a key, at most the limit, are repeated once per block, so
    a key that holds most requests is spread over as many tasks as it has blocks.
    Keys of more than one block are few, one per ``block_rows`` requests at most: they
    are broadcast, so that requests are never brought together by their key alone.
    """
    sizes = requests.groupBy(*keys).agg(F.count(F.lit(1)).alias("key_rows"))
    blocks = sizes.select(*keys, F.ceil(F.col("key_rows") / block_rows).cast("int").alias("_blocks"))
    place = F.pmod(F.xxhash64(*requests.columns), F.col("_blocks")).cast("int")
    left = requests.join(F.broadcast(blocks.filter("_blocks > 1")), keys, "left").withColumn("_block", F.coalesce(place, F.lit(0)))
    right = candidates.join(blocks, keys).withColumn(
        "_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    )

    columns = requests.columns

    def score(pdf: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[columns]
        if near.empty or pdf.empty:
            return pdf.assign(semantic_key=None, score=np.nan)
        near = near.sort_values("_rank")
        names, scores = _best_matches(pdf["embedding"], list(zip(near["semantic_key"], near["embedding"])))
        return pdf.assign(semantic_key=names, score=scores)

    # New names on one side: both sides read the same block counts.
    near_keys = [f"_near{i}" for i in range(len(keys) + 1)]
    right = right.select(*keys, "_block", "_rank", "semantic_key", "embedding").toDF(
        *near_keys, "_rank", "semantic_key", "embedding"
    )
    grouped = left.groupBy(*keys, "_block").cogroup(right.groupBy(*near_keys))
    return grouped.applyInPandas(score, _scored(requests))


def semantic_lookup(
    requests: DataFrame,
    cache: DataFrame,
    keys: list[str] | None = None,
    limit: int = K.SEMANTIC_CANDIDATES,
    threshold: float = K.SEMANTIC_THRESHOLD,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Most similar of the newest candidates per key, if similar enough.

    ``requests`` needs the key columns and ``embedding``. Candidates are joined
    by key, block by block of requests, and compared as matrices. Only the
    ``limit`` newest entries of a key are candidates; pass a larger limit to look
    further back. Adds ``semantic_key`` and ``similarity`` (four decimals), null
    where nothing is close enough.
    """
    keys = keys or SEMANTIC_KEYS
    candidates = newest_candidates(cache, keys, limit).select(*keys, "_rank", "semantic_key", "embedding")
    scored = _by_join(requests, candidates, keys, block_rows)
    close = (F.col("score") >= threshold) & (F.col("score") > 0) & ~F.isnan("score")
    return scored.withColumn("semantic_key", F.when(close, F.col("semantic_key"))).withColumn(
        "similarity", F.when(close, F.bround("score", 4))
    ).drop("score")


def semantic_key(keys: list[str], embedding: Column) -> Column:
    """Key of a similarity entry: its key columns and its vector."""
    vector = F.concat(F.lit("["), F.array_join(embedding.cast("array<string>"), ", "), F.lit("]"))
    return F.sha2(F.concat_ws("\n", *[F.col(k) for k in keys], vector), 256)


def upsert(
    table: DataFrame, fresh: DataFrame, keys: list[str], keep: dict[str, Column], order: list[str]
) -> DataFrame:
    """Last write per key wins; ``keep`` columns of an existing entry stay.

    ``keep`` maps a column to the value a new entry gets. Writes of one key are
    reduced to the last one inside each task, so keys are unique in the join.
    """
    others = [c for c in table.columns if c not in keys]
    last = fresh.groupBy(*keys).agg(
        F.max_by(F.struct(*[c for c in others if c not in keep]), F.struct(*order)).alias("_new")
    )
    both = table.withColumn("_old", F.lit(True)).join(last, keys, "full_outer")

    def value(name: str) -> Column:
        if name in keep:
            return F.when(F.col("_old"), F.col(name)).otherwise(keep[name]).alias(name)
        return F.when(F.col("_new").isNotNull(), F.col(f"_new.{name}")).otherwise(F.col(name)).alias(name)

    return both.select(*[c if c in keys else value(c) for c in table.columns])


def touch(cache: DataFrame, used: DataFrame, key: str, now: Column) -> DataFrame:
    """Add the uses of this run to ``hits``; used entries become the newest."""
    uses = used.groupBy(key).agg(F.count(F.lit(1)).alias("_uses"))
    found = cache.join(uses, key, "left")
    return (
        found.withColumn("hits", F.coalesce("hits", F.lit(0)) + F.coalesce("_uses", F.lit(0)))
        .withColumn("updated_at", F.when(F.col("_uses").isNotNull(), now).otherwise(F.col("updated_at")))
        .drop("_uses")
    )


#: Bins of one look at the times, and entries of a bin that are few enough to be ordered.
BINS, FEW = 4096, 50_000


def _place(cache: DataFrame) -> Column:
    """``updated_at`` as a whole number in the same order."""
    kind = cache.schema["updated_at"].dataType.typeName()
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return F.unix_micros(F.col("updated_at").cast("timestamp"))
    if kind in ("byte", "short", "integer", "long"):
        return F.col("updated_at").cast("bigint")
    raise TypeError(f"updated_at must be a time or a whole number, not {kind}")


def evict_oldest(cache: DataFrame, max_rows: int, key: str) -> DataFrame:
    """Keep the newest ``max_rows`` entries; a table within the limit is unchanged.

    Ties are broken by the key, entries without a time are the oldest. The cut-off is
    found by counts over bins of time, of which only the one it lies in is looked at
    again and, when it is small or a single time, ordered. What remains is one filter.
    """
    place = _place(cache)
    slim = cache.select(F.col(key), place.alias("_place"))
    all_ = slim.agg(F.count(F.lit(1)).alias("n"), F.count("_place").alias("timed"), F.min("_place").alias("low"), F.max("_place").alias("high")).first()
    surplus = all_.n - max_rows
    if surplus <= 0:
        return cache
    untimed = all_.n - all_.timed
    if surplus <= untimed:
        gone = slim.filter("_place IS NULL").orderBy(key).limit(surplus).select(key)
        return cache.join(gone, key, "left_anti")
    surplus -= untimed
    low, high, count = all_.low, all_.high, all_.timed
    while count > FEW and low < high:
        width = -(-(high - low + 1) // BINS)
        inside = slim.filter(F.col("_place").between(low, high))
        bins = inside.groupBy(F.expr(f"(_place - {low}L) div {width}L").alias("bin")).count().orderBy("bin").collect()
        for row in bins:
            if surplus <= row["count"]:
                break
            surplus -= row["count"]
        low, count = low + row.bin * width, row["count"]
        high = min(high, low + width - 1)
    # All entries before ``low`` go, and the oldest ones up to ``high``.
    gone = slim.filter(F.col("_place").between(low, high)).orderBy("_place", key).limit(surplus).select(key)
    return cache.filter(place >= low).join(gone, key, "left_anti")


def delete_keys(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """The table without the rows whose key is in ``gone``."""
    return table.join(gone.select(*keys).distinct(), keys, "left_anti")


def counters(rows: DataFrame) -> DataFrame:
    """Cache hits and misses from row warnings; rows without cache use count as neither."""
    counted = ~F.array_contains("warnings", "cache_disabled")
    hit = F.array_contains("warnings", "cache_hit")
    return rows.agg(
        F.count_if(counted & hit).alias("cache_hits"),
        F.count_if(counted & ~hit).alias("cache_misses"),
    )
