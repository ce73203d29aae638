"""Registered queries: order-dependent logic over groups, reports and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowscribe.operators import cache, events, groups, reports
from rowscribe.operators.ordering import sequential_number
from rowscribe.plans import stand_ins as S
from rowscribe.plans.catalog_scan import ANSWER_FIELDS, MATERIALIZED
from rowscribe.plans.registry import Tables, query

with_sql = S.with_sql


@query(
    "flt09_oversize_groups",
    with_sql(
        S.GROUPED,
        "sizes AS (SELECT group_key, count(*) AS n FROM grouped GROUP BY group_key)",
        body="""SELECT row_number, group_key, CASE WHEN n > 6 THEN 'error' ELSE 'pending' END AS status,
          CASE WHEN n > 6 THEN 'Пропущено: группа слишком большая (' || n || ' строк > лимита 6).' END AS error_text,
          concat_ws(',', CASE WHEN turn = 1 THEN 'empty_cell' END, CASE WHEN n > 6 THEN 'skipped_large_group:' || n || '>6' END) AS warnings
        FROM grouped JOIN sizes USING (group_key)""",
    ),
)
def oversize_groups(t: Tables) -> DataFrame:
    marked = groups.mark_oversize(S.grouped_rows(t), ["group_key"], 6)
    return marked.select(
        "row_number", "group_key", "status", "error_text", F.array_join("warnings", ",").alias("warnings")
    )


FIRSTS = f"""done AS (SELECT * FROM answered WHERE {MATERIALIZED}),
f AS (SELECT *, row_number() OVER (PARTITION BY report_id, group_key ORDER BY row_number) AS rn,
        row_number() OVER (PARTITION BY report_id, coalesce(group_key, '') ORDER BY row_number) AS rb FROM done)"""


def _finished(t: Tables) -> DataFrame:
    from rowscribe.sources.export import finished_rows

    rows = S.answered_rows(t)
    return finished_rows(rows).select("report_id", "row_number", "group_key", "status", "n_chars")


@query(
    "win01_first_per_group",
    with_sql(
        S.ANSWERED,
        FIRSTS,
        body="""SELECT 'export' AS view, report_id, row_number, group_key, n_chars FROM f WHERE coalesce(group_key, '') = '' OR rn = 1
          UNION ALL SELECT 'preview', report_id, row_number, coalesce(group_key, ''), n_chars FROM f WHERE rb = 1""",
    ),
)
def first_per_group(t: Tables) -> DataFrame:
    done = _finished(t)
    keys = ["report_id", "group_key"]
    plain = groups.first_row_per_group(done, keys).withColumn("view", F.lit("export"))
    collapsed = groups.first_row_per_group(done, keys, blank_is_group=True).withColumn("view", F.lit("preview"))
    return plain.unionByName(collapsed).select("view", "report_id", "row_number", "group_key", "n_chars")


@query(
    "win02_group_number",
    with_sql(
        S.ANSWERED,
        FIRSTS,
        body="""SELECT report_id, row_number, group_key, row_number() OVER (PARTITION BY report_id ORDER BY row_number) AS group_number
          FROM f WHERE coalesce(group_key, '') = '' OR rn = 1""",
    ),
)
def group_number(t: Tables) -> DataFrame:
    firsts = groups.first_row_per_group(_finished(t), ["report_id", "group_key"])
    return groups.number_groups(firsts, ["report_id"]).select("report_id", "row_number", "group_key", "group_number")


@query(
    "win03_retention",
    with_sql(
        S.REPORTS,
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rn FROM reports WHERE user_id > 0)",
        body="""SELECT id, user_id, CASE WHEN status IN ('running','queued','paused') THEN 'skip_active' ELSE 'delete' END AS decision
          FROM ranked WHERE rn > 5""",
    ),
)
def retention(t: Tables) -> DataFrame:
    return reports.retention(S.reports(t), 5).select("id", "user_id", "decision")


@query(
    "win03_retention_counts",
    with_sql(
        S.REPORTS,
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rn FROM reports WHERE user_id > 0)",
        body="""SELECT count(*) FILTER (WHERE status NOT IN ('running','queued','paused')) AS deleted_reports,
          count(*) FILTER (WHERE status IN ('running','queued','paused')) AS skipped_active FROM ranked WHERE rn > 5""",
    ),
)
def retention_counts(t: Tables) -> DataFrame:
    return reports.retention_counts(reports.retention(S.reports(t), 5))


@query(
    "win04_newest_candidates",
    """SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS rn FROM embeddings) WHERE rn <= 20""",
)
def newest_candidates(t: Tables) -> DataFrame:
    entries = t.embeddings.select(
        "label", "vec_id", F.col("vec_id").alias("updated_at"), F.col("vec_id").alias("semantic_key")
    )
    return cache.newest_candidates(entries, ["label"], 20).select("label", "vec_id")


@query(
    "win05_tokens_on_first",
    with_sql(
        S.REPORT_ROWS,
        "f AS (SELECT *, row_number() OVER (PARTITION BY report_id, group_key ORDER BY row_number) AS rn FROM report_rows WHERE group_key IS NOT NULL)",
        "a AS (SELECT report_id, group_key, sum(total_tokens)::BIGINT AS total_tokens, max(status) AS answer FROM report_rows WHERE group_key IS NOT NULL GROUP BY ALL)",
        body="""SELECT report_id, row_number, f.group_key, a.answer, CASE WHEN rn = 1 THEN a.total_tokens ELSE 0 END AS total_tokens
          FROM f JOIN a USING (report_id, group_key)""",
    ),
)
def tokens_on_first(t: Tables) -> DataFrame:
    rows = S.report_rows(t).filter("group_key IS NOT NULL")
    answers = rows.groupBy("report_id", "group_key").agg(
        F.sum("total_tokens").alias("total_tokens"), F.max("status").alias("answer")
    )
    plain = rows.select("report_id", "row_number", "group_key")
    found = groups.spread_answers(plain, answers, ["report_id", "group_key"])
    return found.select("report_id", "row_number", "group_key", "answer", "total_tokens")


QUEUE = """queue AS (
  SELECT row_number() OVER (ORDER BY event_id) - 1 AS place,
         CASE event_id % 5 WHEN 0 THEN 'broken' WHEN 1 THEN '[1]' ELSE '{"job_id":" ' || user_id || ' "}' END AS item, user_id, event_id
  FROM events)"""


@query(
    "win06_queue_place",
    with_sql(
        QUEUE,
        body="SELECT CAST(user_id AS VARCHAR) AS job_id, min(place) AS queue_position FROM queue WHERE event_id % 5 > 1 GROUP BY user_id",
    ),
)
def queue_place(t: Tables) -> DataFrame:
    items = t.events.select(
        "event_id",
        F.expr(
            """CASE event_id % 5 WHEN 0 THEN 'broken' WHEN 1 THEN '[1]' ELSE concat('{"job_id":" ', user_id, ' "}') END"""
        ).alias("item"),
    )
    return events.queue_places(sequential_number(items, "event_id", "place", start=0), "place", "item")


FEED = """looks AS (
  SELECT *, row_number() OVER w AS rn, lag(status) OVER w AS s0, lag(processed) OVER w AS p0, lag(total) OVER w AS t0,
         lag(current_step) OVER w AS c0,
         min(CASE WHEN status IN ('completed','failed','canceled') THEN at_us END) OVER (PARTITION BY job) AS ended
  FROM job_events WINDOW w AS (PARTITION BY job ORDER BY at_us, seq)),
live AS (SELECT * FROM looks WHERE ended IS NULL OR at_us <= ended),
feed AS (
  SELECT job, seq, at_us, CASE WHEN rn = 1 THEN 'snapshot' ELSE 'progress' END AS event_kind FROM live
  WHERE rn = 1 OR s0 <> status OR p0 <> processed OR t0 <> total OR c0 <> current_step
  UNION ALL SELECT job, seq, at_us, 'done' FROM live WHERE status IN ('completed','failed','canceled'))"""


@query("win07_change_feed", with_sql(S.JOB_EVENTS, FEED, body="SELECT job, seq, event_kind FROM feed"))
def change_feed(t: Tables) -> DataFrame:
    return events.change_feed(S.job_events(t), ["job"], ["at_us", "seq"]).select("job", "seq", "event_kind")


@query(
    "win07_keepalive",
    with_sql(
        S.JOB_EVENTS,
        FEED,
        """steps AS (SELECT l.job, l.seq, l.at_us, l.rn, bool_or(f.seq IS NOT NULL) AS forced FROM live l LEFT JOIN feed f ON f.job = l.job AND f.seq = l.seq
           GROUP BY l.job, l.seq, l.at_us, l.rn)""",
        """walk AS (
          SELECT job, rn, seq, at_us, forced, at_us AS last_at, true AS emitted FROM steps WHERE rn = 1
          UNION ALL
          SELECT s.job, s.rn, s.seq, s.at_us, s.forced, CASE WHEN w.emitted THEN w.at_us ELSE w.last_at END,
                 s.forced OR s.at_us >= (CASE WHEN w.emitted THEN w.at_us ELSE w.last_at END) + 7200000000
          FROM walk w JOIN steps s ON s.job = w.job AND s.rn = w.rn + 1)""",
        body="""SELECT job, seq, event_kind FROM feed UNION ALL SELECT job, seq, 'keepalive' FROM walk WHERE emitted AND NOT forced""",
    ),
)
def keepalive(t: Tables) -> DataFrame:
    found = events.feed_with_keepalive(S.job_events(t), "job", "at_us", ["at_us", "seq"], every_seconds=7200.0)
    return found.select("job", "seq", "event_kind")


SILENT_FEED = with_sql(
    S.JOB_EVENTS,
    FEED,
    """spans AS (
  SELECT job, at_us, lead(at_us, 1, (SELECT max(at_us) // 1000 * 1000 FROM job_events)) OVER (PARTITION BY job ORDER BY at_us, seq) AS until,
         seq IN (SELECT seq FROM feed WHERE event_kind = 'done') AS ends
  FROM feed WHERE event_kind <> 'done')""",
    body="""SELECT job, seq, at_us, event_kind FROM feed
  UNION ALL SELECT job, NULL, at_us + 86400000000 * unnest(range(1, (until - at_us) // 86400000000 + 1)), 'keepalive' FROM spans WHERE NOT ends""",
)


@query("win07_silent_feed", SILENT_FEED)
def silent_feed(t: Tables) -> DataFrame:
    """Keep-alives of jobs that nothing is heard of, up to the last look at any job."""
    looks = S.job_events(t)
    clock = looks.agg(F.expr("max(at_us) div 1000 * 1000").alias("clock")).first().clock
    return events.silent_feed(looks, "job", "at_us", ["at_us", "seq"], F.lit(clock), 86_400.0)


@query(
    "win08_throttle",
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
def throttle(t: Tables) -> DataFrame:
    moves = t.events.selectExpr(
        "user_id AS job",
        "event_id AS seq",
        "unix_micros(CAST(ts AS TIMESTAMP)) AS at_us",
        "event_id AS processed",
        "CASE WHEN event_id % 1000 = 999 THEN event_id ELSE event_id + 1 END AS total",
    )
    found = events.throttle(moves, "job", "at_us", ["at_us", "seq"], every_rows=300, every_seconds=86_400.0)
    return found.select("job", "seq")


@query(
    "win09_event_fold",
    with_sql(
        """partial AS (
          SELECT user_id AS job, epoch_us(ts) AS at_us, event_id AS seq, CASE WHEN event_id % 3 > 0 THEN event_type END AS status,
                 CASE WHEN event_id % 2 = 0 THEN event_id // 10 END AS processed,
                 CASE WHEN event_id % 11 = 0 THEN 0 WHEN event_id % 5 > 0 THEN 2000 + event_id % 7 END AS total,
                 CASE WHEN event_id % 4 = 1 THEN value END AS eta_seconds,
                 CASE WHEN event_id % 6 = 1 THEN 'step ' || (event_id % 10) END AS current_step FROM events)""",
        """folded AS (
          SELECT job, at_us, seq, last_value(status IGNORE NULLS) OVER w AS status, last_value(processed IGNORE NULLS) OVER w AS processed,
                 last_value(total IGNORE NULLS) OVER w AS total, last_value(eta_seconds IGNORE NULLS) OVER w AS eta_seconds,
                 last_value(current_step IGNORE NULLS) OVER w AS current_step
          FROM partial WINDOW w AS (PARTITION BY job ORDER BY at_us, seq ROWS UNBOUNDED PRECEDING))""",
        body="""SELECT *, last_value(CASE WHEN total > 0 THEN floor(processed::DOUBLE / total * 10000 + 0.5) / 100 END IGNORE NULLS)
            OVER (PARTITION BY job ORDER BY at_us, seq ROWS UNBOUNDED PRECEDING) AS progress_percent FROM folded""",
    ),
)
def event_fold(t: Tables) -> DataFrame:
    partial = t.events.selectExpr(
        "user_id AS job",
        "unix_micros(CAST(ts AS TIMESTAMP)) AS at_us",
        "event_id AS seq",
        "CASE WHEN event_id % 3 > 0 THEN event_type END AS status",
        "CASE WHEN event_id % 2 = 0 THEN event_id div 10 END AS processed",
        "CASE WHEN event_id % 11 = 0 THEN 0 WHEN event_id % 5 > 0 THEN 2000 + event_id % 7 END AS total",
        "CASE WHEN event_id % 4 = 1 THEN value END AS eta_seconds",
        "CASE WHEN event_id % 6 = 1 THEN concat('step ', event_id % 10) END AS current_step",
    )
    return events.fold(partial, ["job"], ["at_us", "seq"])
