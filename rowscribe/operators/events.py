"""Progress events of jobs: change feed, throttle, fold, queue places.

Each takes ``keys`` (the job) and ``order`` (unique per job). Rows are spread by
job *and* order, so that one busy job is worked on by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowscribe import constants as K
from rowscribe.functions.text import strip
from rowscribe.operators.ordering import carry_window, chunked, with_carry
from rowscribe.session import cut

WATCHED = ["status", "processed", "total", "current_step"]
FOLDED = ["status", "processed", "total", "eta_seconds", "current_step"]


def _changes(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Live events with ``kinds``: what each one announces, nothing if unchanged."""
    ends = F.col("status").isin(K.TERMINAL_STATUSES)
    chunks = chunked(events, keys, order).withColumn("_now", F.struct(*WATCHED))
    rows = with_carry(
        chunks,
        keys,
        order,
        {
            "_state": F.max_by("_now", F.struct(*order)),
            "_ended": F.max(F.when(ends, F.lit(True))),
        },
    )
    window = carry_window(keys, order)
    state = F.when(F.col("_carry"), F.col("_state")).otherwise(F.col("_now"))
    ended = F.when(F.col("_carry"), F.col("_ended")).otherwise(ends)
    over = F.max(F.coalesce(ended, F.lit(False))).over(window.rowsBetween(W.unboundedPreceding, -1))
    seen = rows.withColumn("_before", F.lag(state).over(window)).withColumn("_over", over)
    live = seen.filter(~F.col("_carry") & ~F.coalesce("_over", F.lit(False)))
    kind = F.when(F.col("_before").isNull(), F.lit("snapshot")).when(
        ~F.col("_before").eqNullSafe(F.col("_now")), F.lit("progress")
    )
    kinds = F.array_compact(F.array(kind, F.when(ends, F.lit("done"))))
    return live.select(*events.columns, kinds.alias("kinds"))


def change_feed(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Events that differ from the one before: ``snapshot``, then ``progress``.

    A terminal status adds ``done`` and ends the feed of the job.
    """
    found = _changes(events, keys, order)
    return found.select(*events.columns, F.explode("kinds").alias("event_kind"))


def feed_with_keepalive(
    events: DataFrame, key: str, time: str, order: list[str], every_seconds: float = K.KEEPALIVE_SECONDS
) -> DataFrame:
    """The change feed plus ``keepalive`` on a look that finds it silent for too long."""
    found = cut(_changes(events, [key], order), "changes")
    emitted = paced(found, key, time, order, F.size("kinds") > 0, None, 0, every_seconds)
    kinds = F.when(F.size("kinds") > 0, F.col("kinds")).otherwise(F.array(F.lit("keepalive")))
    return emitted.select(*events.columns, F.explode(kinds).alias("event_kind"))


def silent_feed(
    events: DataFrame, key: str, time: str, order: list[str], until: Column, every_seconds: float = K.KEEPALIVE_SECONDS
) -> DataFrame:
    """The change feed plus a ``keepalive`` after every silence of ``every_seconds``, looked at or not.

    Times are in microseconds. Keep-alive rows have the key and the time at which
    they are due; a change starts the silence again, ``done`` ends it, and the last
    one is due at ``until`` at the latest. The streaming twin is ``live_feed``.
    """
    micros = int(every_seconds * 1_000_000)
    found = cut(_changes(events, [key], order).filter(F.size("kinds") > 0), "changes")
    # One row back to front: the change after each one bounds its silence.
    ahead = chunked(found.select(key, *order, F.array_contains("kinds", "done").alias("ends")), [key], order)
    first = ahead.groupBy(key, "_chunk").agg(F.min(time).alias("_first"))
    later = W.partitionBy(key).orderBy(F.desc("_chunk")).rowsBetween(W.unboundedPreceding, -1)
    first = first.select(F.col(key).alias("_key"), F.col("_chunk").alias("_of"), F.min("_first").over(later).alias("_later"))
    following = F.lead(time).over(W.partitionBy(key, "_chunk").orderBy(*order))
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_chunk") == F.col("_of"))
    spans = ahead.withColumn("_next", following).join(first, same).filter("NOT ends")
    last = F.coalesce("_next", "_later", until)
    # A long silence is cut into pieces, so that no row holds all of its times.
    pieces = spans.select(key, F.col(time).alias("_at"), F.floor((last - F.col(time)) / micros).cast("bigint").alias("_times")).filter("_times > 0")
    pieces = pieces.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("(_times - 1) div 4096"))).alias("_piece"))
    turns = F.explode(F.sequence(F.expr("_piece * 4096 + 1"), F.expr("least(_piece * 4096 + 4096, _times)"))).alias("_turn")
    kept = pieces.select(key, "_at", turns).select(key, (F.col("_at") + F.col("_turn") * micros).alias(time), F.lit("keepalive").alias("event_kind"))
    told = found.select(key, *order, F.explode("kinds").alias("event_kind"))
    return told.unionByName(kept, allowMissingColumns=True)


def fold(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """State after every event: the last value of each field that was not null.

    The percentage follows the folded counts and stays while the total is 0.
    """
    place = F.struct(*order)
    last = lambda name: F.max_by(F.col(name), F.when(F.col(name).isNotNull(), place))
    chunks = chunked(events, keys, order)
    rows = with_carry(chunks, keys, order, {f"_{n}": last(n) for n in FOLDED})
    so_far = carry_window(keys, order).rowsBetween(W.unboundedPreceding, 0)
    value = lambda n: F.when(F.col("_carry"), F.col(f"_{n}")).otherwise(F.col(n))
    folded = rows.withColumns(
        {f"_f_{n}": F.last(value(n), ignorenulls=True).over(so_far) for n in FOLDED}
    ).filter(~F.col("_carry"))
    share = F.floor(F.col("_f_processed") / F.nullif("_f_total", F.lit(0)) * 10000 + 0.5) / 100
    known = F.when(F.col("_f_total") > 0, share)
    folded = folded.withColumn("_share", known).drop("_carry", *[f"_{n}" for n in FOLDED])
    again = with_carry(folded, keys, order, {"_kept": last("_share")})
    shown = F.last(F.when(F.col("_carry"), F.col("_kept")).otherwise(F.col("_share")), ignorenulls=True)
    return (
        again.withColumn("progress_percent", shown.over(so_far))
        .filter(~F.col("_carry"))
        .select(*keys, *order, *[F.col(f"_f_{n}").alias(n) for n in FOLDED], "progress_percent")
    )


def lost_leases(
    beats: DataFrame, keys: list[str], time: str, order: list[str], lease_seconds: int = K.LEASE_SECONDS
) -> DataFrame:
    """Runs of heartbeats with no gap as long as the lease, and when each one expired.

    ``time`` is in microseconds and leads ``order``. The start of the run a row
    belongs to is carried from chunk to chunk, so one busy job is no one task.
    """
    lease = lease_seconds * 1_000_000
    rows = with_carry(chunked(beats, keys, order), keys, order, {"_last": F.max(time)})
    window = carry_window(keys, order)
    seen = F.when(F.col("_carry"), F.col("_last")).otherwise(F.col(time))
    marked = rows.withColumn("_before", F.lag(seen).over(window)).filter(~F.col("_carry"))
    fresh = F.col("_before").isNull() | (F.col(time) - F.col("_before") >= lease)
    marked = marked.withColumn("_start", F.when(fresh, F.col(time))).drop("_carry", "_last", "_before")
    again = with_carry(marked, keys, order, {"_run": F.max("_start")})
    start = F.when(F.col("_carry"), F.col("_run")).otherwise(F.col("_start"))
    so_far = carry_window(keys, order).rowsBetween(W.unboundedPreceding, 0)
    runs = again.withColumn("first_beat", F.last(start, ignorenulls=True).over(so_far))
    return (
        runs.filter(~F.col("_carry"))
        .groupBy(*keys, "first_beat")
        .agg(F.max(time).alias("last_beat"), F.count(F.lit(1)).alias("beats"))
        .withColumn("expired_at", F.col("last_beat") + lease)
    )


def _next_at(rows: DataFrame, key: str) -> DataFrame:
    """_id and _next: the first row of the key and clock whose ``_at`` reaches ``_target``.

    ``rows`` has the key, _clock, _id, _at (never falling with _id) and _target, of
    which _at may not reach its own row's. Rows and targets are laid out backwards in
    one order, so what follows a target is what was last seen before it.
    """
    points = rows.select(key, "_clock", (-F.col("_at")).alias("_back"), F.lit(0).alias("_side"), (-F.col("_id")).alias("_rank"), F.col("_id").alias("_seen"))
    asked = rows.select(key, "_clock", (-F.col("_target")).alias("_back"), F.lit(1).alias("_side"), (-F.col("_id")).alias("_rank"), F.lit(None).cast("bigint").alias("_seen"))
    keys, order = [key, "_clock"], ["_back", "_side", "_rank"]
    chunks = chunked(points.unionByName(asked), keys, order)
    last = F.max_by("_seen", F.when(F.col("_seen").isNotNull(), F.struct(*order)))
    rows = with_carry(chunks, keys, order, {"_seen": last})
    so_far = carry_window(keys, order).rowsBetween(W.unboundedPreceding, 0)
    found = rows.withColumn("_next", F.last("_seen", ignorenulls=True).over(so_far))
    return found.filter("_side = 1 AND _next IS NOT NULL").select((-F.col("_rank")).alias("_id"), "_next")


def _next_forced(rows: DataFrame, key: str) -> DataFrame:
    """_id and _next: the forced row after each one, from those of its chunk and one row per later chunk."""
    forced = F.when(F.col("_forced"), F.col("_id"))
    ends = rows.groupBy(key, "_chunk").agg(F.min(forced).alias("_first"))
    later = W.partitionBy(key).orderBy(F.desc("_chunk")).rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select(F.col(key).alias("_key"), F.col("_chunk").alias("_of"), F.min("_first").over(later).alias("_later"))
    inside = W.partitionBy(key, "_chunk").orderBy(F.desc("_id")).rowsBetween(W.unboundedPreceding, -1)
    marked = rows.withColumn("_next", F.min(forced).over(inside))
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_chunk") == F.col("_of"))
    return marked.join(ends, same).select("_id", F.coalesce("_next", "_later").alias("_next")).filter("_next IS NOT NULL")


def _reached(roots: DataFrame, links: DataFrame) -> DataFrame:
    """All _id on the chains of ``links`` (_id, _next) from ``roots``, by pointer doubling.

    After k rounds the rows less than 2**k links away are known and every link
    spans 2**k of the first ones, so rounds grow with the logarithm of the longest
    chain, and no round depends on how many rows one key has.
    """
    reached = cut(roots, "reached")
    links = cut(links, "links")
    while True:
        more = cut(reached.join(links, "_id").select(F.col("_next").alias("_id")), "reached")
        if more.isEmpty():
            return reached
        reached = reached.unionByName(more)
        ahead = links.select(F.col("_id").alias("_next"), F.col("_next").alias("_far"))
        links = cut(links.join(ahead, "_next").select("_id", F.col("_far").alias("_next")), "links")


def paced(
    events: DataFrame,
    key: str,
    time: str,
    order: list[str],
    forced: Column,
    count: Column | None,
    every_rows: int,
    every_seconds: float,
) -> DataFrame:
    """Rows to emit: forced ones, and those far enough from the last emission.

    ``time`` is in microseconds and leads ``order``. Each emission depends on the
    one before: from every row a link goes to the row that would be emitted next if
    it was emitted itself (the first that is forced, late enough, or high enough in
    ``count``, if given). The emitted rows are those on the chain from the key's
    first emission. Links are found over chunks of the key, the chain by pointer
    doubling, so a busy key is spread over all tasks at every step. A key starts
    its clock with its first row, and its count with 0; a count that falls does not
    undo an emission.
    """
    micros = int(every_seconds * 1_000_000)
    if micros <= 0 or (count is not None and every_rows <= 0):
        return events
    spread = events.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    # The id follows (key, order); written once, so that every later read sees the same.
    rows = cut(spread.withColumn("_id", F.monotonically_increasing_id()), "ordered")
    slim = rows.select(
        key,
        "_id",
        F.shiftright("_id", 33).cast("int").alias("_chunk"),
        F.col(time).cast("bigint").alias("_time"),
        F.coalesce(forced, F.lit(False)).alias("_forced"),
        *([] if count is None else [F.coalesce(count.cast("bigint"), F.lit(0)).alias("_count")]),
    )
    far = F.col("_time") >= F.col("_start") + micros
    clocks = slim.select(key, F.lit(0).alias("_clock"), "_id", F.col("_time").alias("_at"), (F.col("_time") + micros).alias("_target"))
    if count is not None:
        peaks = with_carry(slim, [key], ["_id"], {"_count": F.max("_count")})
        peak = F.max("_count").over(carry_window([key], ["_id"]).rowsBetween(W.unboundedPreceding, 0))
        slim = cut(peaks.withColumn("_count", peak).filter(~F.col("_carry")).drop("_carry"), "peaks")
        far = far | (F.col("_count") >= every_rows)
        counted = slim.select(key, F.lit(1).alias("_clock"), "_id", F.col("_count").alias("_at"), (F.col("_count") + every_rows).alias("_target"))
        clocks = clocks.unionByName(counted)
    links = _next_at(clocks, key).unionByName(_next_forced(slim, key)).groupBy("_id").agg(F.min("_next").alias("_next"))
    starts = slim.groupBy(F.col(key).alias("_key")).agg(F.min("_time").alias("_start"))
    begun = slim.join(starts, F.col(key).eqNullSafe(F.col("_key"))).filter(F.col("_forced") | far)
    roots = begun.groupBy(key).agg(F.min("_id").alias("_id")).select("_id")
    return rows.join(_reached(roots, links), "_id", "left_semi").select(*events.columns)


def throttle(
    events: DataFrame,
    key: str,
    time: str,
    order: list[str],
    every_rows: int = K.PROGRESS_EVERY_ROWS,
    every_seconds: float = K.PROGRESS_EVERY_SECONDS,
) -> DataFrame:
    """Progress rows to emit: finished, or enough rows or time since the last one."""
    finished = F.col("processed") >= F.col("total")
    return paced(events, key, time, order, finished, F.col("processed"), every_rows, every_seconds)


def queue_places(queue: DataFrame, position: str, text: str, field: str = "job_id") -> DataFrame:
    """0-based place of each id in the queue: its first entry, broken ones count."""
    node = F.try_parse_json(F.col(text))
    found = strip(F.try_variant_get(node, f"$.{field}", "string"))
    return (
        queue.select(found.alias(field), F.col(position))
        .filter(F.coalesce(field, F.lit("")) != "")
        .groupBy(field)
        .agg(F.min(position).cast("bigint").alias("queue_position"))
    )
