"""Registered queries: streams over the test tables, read until they are empty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowscribe.operators.events import lost_leases
from rowscribe.operators.rows import build_rows
from rowscribe.plans import rules
from rowscribe.plans import stand_ins as S
from rowscribe.plans.annotate_report import Job
from rowscribe.plans.catalog_annotation import GROUP_RESULT, group_result
from rowscribe.plans.catalog_events import FEED, SILENT_FEED
from rowscribe.plans.registry import Tables, query
from rowscribe.session import scratch_path
from rowscribe.streaming import events, intake

with_sql = S.with_sql


class StreamTables(Tables):
    """The same tables, each read as a stream of its file or of the files of its folder."""

    def __getattr__(self, name: str) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.folder}/{name}.parquet").schema
        # A pattern of one name: a stream takes no single file as its path, and a table may be a folder of files.
        return self.spark.readStream.schema(schema).parquet(f"{self.folder}/{name}.parque[t]")


def _streams(t: Tables) -> StreamTables:
    return StreamTables(t.spark, t.folder)


def _finish(writer) -> None:
    writer.trigger(availableNow=True).start().awaitTermination()


def _stored(stream: DataFrame, path: str) -> DataFrame:
    """All rows a stream gives, written and read again."""
    _finish(stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").outputMode("append"))
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


def _arriving(rows: DataFrame, time: str, path: str, work, batches: int = 3) -> None:
    """``work`` gets the stream of ``rows`` once for each slice of time that has arrived."""
    ends = rows.agg(F.min(time).alias("low"), F.max(time).alias("high")).first()
    low, width = ends.low or 0, ((ends.high or 0) - (ends.low or 0)) // batches + 1
    for number in range(batches):
        rows.filter(F.expr(f"({time} - {low}) div {width}") == number).write.mode("append").parquet(path)
        work(rows.sparkSession.readStream.schema(rows.schema).parquet(path), number)


def _over_batches(rows: DataFrame, time: str, path: str, work, batches: int = 3) -> DataFrame:
    """What ``work`` (from stream to stream) gives for rows that arrive in slices of time.

    Each slice is a run of its own that goes on from the state of the last one.
    """
    found = []
    _arriving(rows, time, f"{path}/in", lambda stream, _: found.append(_stored(work(stream), path)), batches)
    return found[-1]


COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@query(
    "str01_profile_intake",
    with_sql(
        r"""p AS (SELECT 'lang' AS column_name, count(*) AS total_rows, count(DISTINCT lang) AS distinct_values FROM documents
           UNION ALL SELECT 'source', count(*), count(DISTINCT source) FROM documents
           UNION ALL SELECT 'n_chars', count(*), count(DISTINCT n_chars) FROM documents
           UNION ALL SELECT 'doc_id', count(*), count(DISTINCT doc_id) FROM documents
           UNION ALL SELECT 'text', count(*), count(DISTINCT nullif(regexp_replace(text, '^\s+|\s+$', '', 'g'), '')) FROM documents)""",
        body="SELECT * FROM p",
    ),
)
def profile_intake(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "profile")
    _finish(intake.profile_sheets(_streams(t).documents, COLUMNS, path, f"{path}/log"))
    return intake.profile_so_far(t.spark, path).select("column_name", "total_rows", "distinct_values")


@query(
    "str01_capped_profile",
    with_sql(
        *[f"p{i} AS (SELECT '{c}' AS column_name, count(*) AS total_rows, count(DISTINCT NULLIF(trim(CAST({c} AS VARCHAR), {S.WS}), '')) AS n FROM documents)" for i, c in enumerate(COLUMNS)],
        body=f"SELECT column_name, total_rows, CASE WHEN n <= 900 THEN n END AS distinct_values FROM ({' UNION ALL '.join(f'SELECT * FROM p{i}' for i in range(len(COLUMNS)))})",
    ),
)
def capped_profile(t: Tables) -> DataFrame:
    """Five batches, one profile; columns of more than 900 values are only sketched."""
    path = scratch_path(t.spark, "capped")

    def work(stream: DataFrame, number: int) -> None:
        _finish(intake.profile_sheets(stream, COLUMNS, path, f"{path}/log", cap=900))

    _arriving(t.documents, "doc_id", f"{path}/in", work, 5)
    return intake.profile_so_far(t.spark, path, cap=900).select("column_name", "total_rows", "distinct_values")


@query(
    "str02_live_annotation",
    with_sql(
        S.SHEET,
        S.CLEAN,
        S.PACKED,
        "sized AS (SELECT p.*, c.lang, length(coalesce(c.review, '')) AS n, c.review IS NULL AND c.lang IS NULL AS blank FROM clean c JOIN packed p USING (row_number))",
        rules.SQL,
        body="""SELECT count(*) AS total_rows, count(*) FILTER (WHERE NOT blank AND error_text IS NULL) AS success_rows,
          count(*) FILTER (WHERE NOT blank AND error_text IS NOT NULL) AS failed_rows, true AS partial FROM annotated""",
    ),
)
def live_annotation(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "live")
    rows = build_rows(S.sheet(_streams(t)), ["lang", "review"], ["source"])
    job = Job(rules.PROMPT, rules.TEMPLATE)
    _finish(intake.annotate_stream(rows, job, rules.annotator, f"{path}/out", f"{path}/log"))
    return intake.partial_summary(t.spark, f"{path}/out")


@query("str02_groups_over_batches", GROUP_RESULT)
def groups_over_batches(t: Tables) -> DataFrame:
    """Groups whose rows arrive in three batches are asked once each, when their last row has come."""
    path = scratch_path(t.spark, "groups")
    rows = S.grouped_rows(t).withColumn("at", F.col("row_number") % 100 * 1_000_000 + 1)
    last = rows.groupBy("group_key").agg(F.max("at").alias("at"), F.lit(True).alias("ends"))
    marked = rows.join(last, ["group_key", "at"], "left")
    job = Job(rules.PROMPT, rules.TEMPLATE, group_by="conv", group_max_rows=7)

    def work(stream: DataFrame, number: int) -> None:
        whole = intake.whole_groups(stream, "group_key", "at", 3600, F.col("ends"))
        _finish(intake.annotate_stream(whole.drop("at", "ends"), job, rules.annotator, f"{path}/out", f"{path}/log"))

    _arriving(marked, "at", f"{path}/in", work)
    return group_result(t.spark.read.parquet(f"{path}/out"))


@query(
    "str03_throttled_progress",
    with_sql(
        """moves AS (SELECT user_id AS job, event_id AS seq, epoch_us(ts) AS at_us, event_id AS processed,
             event_id % 1000 = 999 AS finished, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)""",
        """walk AS (
          SELECT job, rn, seq, at_us, processed, at_us AS last_at, 0::BIGINT AS last_p, finished OR processed >= 300 AS emitted FROM moves WHERE rn = 1
          UNION ALL
          SELECT m.job, m.rn, m.seq, m.at_us, m.processed, CASE WHEN w.emitted THEN w.at_us ELSE w.last_at END,
                 CASE WHEN w.emitted THEN w.processed ELSE w.last_p END,
                 m.finished OR m.processed - (CASE WHEN w.emitted THEN w.processed ELSE w.last_p END) >= 300
                   OR m.at_us - (CASE WHEN w.emitted THEN w.at_us ELSE w.last_at END) >= 86400000000
          FROM walk w JOIN moves m ON m.job = w.job AND m.rn = w.rn + 1)""",
        body="SELECT job, seq FROM walk WHERE emitted",
    ),
)
def throttled_progress(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "throttle")
    moves = _streams(t).events.selectExpr(
        "user_id AS job",
        "event_id AS seq",
        "unix_micros(CAST(ts AS TIMESTAMP)) AS at_us",
        "event_id AS processed",
        "CASE WHEN event_id % 1000 = 999 THEN event_id ELSE event_id + 1 END AS total",
    )
    sent = events.throttled_progress(moves, "job", "at_us", ["at_us", "seq"], every_rows=300, every_seconds=86_400.0)
    return _stored(sent, path).select("job", "seq")


@query("str04_live_feed", with_sql(S.JOB_EVENTS, FEED, body="SELECT job, seq, event_kind FROM feed"))
def live_feed(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "feed")
    looks = S.job_events(_streams(t))
    # Longer than the whole table: no look finds a feed silent for that long.
    silence = 10.0 * 365 * 86_400
    return _stored(events.live_feed(looks, "job", "at_us", ["at_us", "seq"], silence, remember_seconds=silence), path).select("job", "seq", "event_kind")


@query("str04_keepalive", SILENT_FEED)
def live_feed_with_keepalive(t: Tables) -> DataFrame:
    """A silent job gets its keep-alives in the batches that bring nothing of it."""
    always = 10.0 * 365 * 86_400
    feed = lambda looks: events.live_feed(looks, "job", "at_us", ["at_us", "seq"], 86_400.0, remember_seconds=always)
    return _over_batches(S.job_events(t), "at_us", scratch_path(t.spark, "keepalive"), feed)


BEATS = """beats AS (
  SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 36000 SECOND AS fresh FROM events),
runs AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM beats)"""


@query(
    "str05_lost_heartbeats",
    with_sql(
        BEATS,
        body="""SELECT user_id, epoch_us(min(ts)) AS first_beat, epoch_us(max(ts)) AS last_beat, epoch_us(max(ts)) + 36000000000 AS expired_at, count(*) AS beats
          FROM runs GROUP BY user_id, run""",
    ),
)
def lost_heartbeats(t: Tables) -> DataFrame:
    beats = t.events.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), "event_id")
    return lost_leases(beats, ["user_id"], "at_us", ["at_us", "event_id"], 36_000)


def _in_micros(found: DataFrame) -> DataFrame:
    times = [F.unix_micros(c).alias(c) for c in ("first_beat", "last_beat", "expired_at")]
    return found.select("user_id", *times, "beats")


@query(
    "str05_lost_heartbeats_stream",
    with_sql(
        BEATS,
        body="""SELECT user_id, epoch_us(min(ts)) AS first_beat, epoch_us(max(ts)) AS last_beat, epoch_us(max(ts)) + 36000000000 AS expired_at, count(*) AS beats
          FROM runs GROUP BY user_id, run HAVING max(ts) + INTERVAL 36000 SECOND <= (SELECT date_trunc('millisecond', max(ts)) FROM events)""",
    ),
)
def lost_heartbeats_stream(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "beats")
    beats = _streams(t).events.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    lost = events.lost_heartbeats(beats.withWatermark("ts", "0 seconds"), "user_id", "ts", 36_000)
    _finish(
        lost.writeStream.format("parquet")
        .option("path", f"{path}/out")
        .option("checkpointLocation", f"{path}/log")
        .outputMode("append")
    )
    return _in_micros(t.spark.read.schema(lost.schema).parquet(f"{path}/out"))


@query("str06_first_requests", "SELECT DISTINCT user_id AS job_id FROM events")
def first_requests(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "requests")
    at = F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us")
    asked = _streams(t).events.select(F.col("user_id").alias("job_id"), at, F.lit(events.ASKED).alias("kind"))
    # No start, and a marker that outlasts the table: each id is queued once.
    return _stored(events.first_requests(asked, "job_id", "at_us", seconds=365 * 86_400), path).select("job_id")


@query(
    "str06_cleared_requests",
    with_sql(
        """asks AS (SELECT user_id AS job_id, epoch_us(ts) AS at_us, CASE WHEN event_type = 'purchase' THEN 'started' ELSE 'asked' END AS kind FROM events),
placed AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY at_us, kind) AS rn FROM asks)""",
        """walk AS (
          SELECT job_id, rn, at_us, kind = 'asked' AS queued, CASE WHEN kind = 'asked' THEN at_us END AS marked FROM placed WHERE rn = 1
          UNION ALL
          SELECT p.job_id, p.rn, p.at_us, p.kind = 'asked' AND (w.marked IS NULL OR p.at_us >= w.marked + 259200000000),
                 CASE WHEN p.kind = 'started' THEN NULL WHEN w.marked IS NULL OR p.at_us >= w.marked + 259200000000 THEN p.at_us ELSE w.marked END
          FROM walk w JOIN placed p ON p.job_id = w.job_id AND p.rn = w.rn + 1)""",
        body="SELECT job_id, at_us FROM walk WHERE queued",
    ),
)
def cleared_requests(t: Tables) -> DataFrame:
    """Requests in three batches; starts clear markers, and after three days they expire."""
    kind = F.when(F.col("event_type") == "purchase", events.STARTED).otherwise(events.ASKED).alias("kind")
    asks = t.events.select(F.col("user_id").alias("job_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), kind)
    queued = lambda requests: events.first_requests(requests, "job_id", "at_us", seconds=3 * 86_400)
    return _over_batches(asks, "at_us", scratch_path(t.spark, "cleared"), queued)
