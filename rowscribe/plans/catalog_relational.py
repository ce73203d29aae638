"""Registered queries: joins, aggregations, sorts, set operations on stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowscribe import constants as K
from rowscribe.functions import jsonx, text, vectors
from rowscribe.functions.jsonx import text_list
from rowscribe.operators import cache, discovery, groups, logs, profile, reports
from rowscribe.operators import rows as R
from rowscribe.plans import stand_ins as S
from rowscribe.plans.catalog_columns import _quote
from rowscribe.plans.catalog_scan import ANSWER_FIELDS, LOG_LINES, MATERIALIZED, PARSED, log_lines
from rowscribe.plans.registry import Tables, query

with_sql = S.with_sql

# --- joins --------------------------------------------------------------------------------


@query(
    "joi01_report_source",
    with_sql(
        S.REPORTS,
        S.UPLOADS,
        body="""SELECT r.id, r.status, u.original_name AS source_original_name
          FROM reports r LEFT JOIN uploads u ON u.id = r.uploaded_file_id""",
    ),
)
def report_source(t: Tables) -> DataFrame:
    return reports.with_source_name(S.reports(t), S.uploads(t)).select("id", "status", "source_original_name")


GROUP_STATS = """gs AS (
  SELECT report_id, count(DISTINCT group_key) AS total_groups,
         count(DISTINCT CASE WHEN status IN ('done','error') THEN group_key END) AS processed_groups
  FROM report_rows WHERE group_key IS NOT NULL GROUP BY report_id)"""


@query(
    "joi02_report_list",
    with_sql(
        S.REPORTS,
        S.UPLOADS,
        S.REPORT_ROWS,
        GROUP_STATS,
        body="""SELECT r.id, r.user_id, r.status, u.original_name AS source_original_name,
          coalesce(total_groups, 0) AS group_total, coalesce(processed_groups, 0) AS group_processed
          FROM reports r LEFT JOIN uploads u ON u.id = r.uploaded_file_id LEFT JOIN gs ON gs.report_id = r.id""",
    ),
)
def report_list(t: Tables) -> DataFrame:
    listed = reports.report_list(S.reports(t), S.uploads(t), S.report_rows(t))
    return listed.select("id", "user_id", "status", "source_original_name", "group_total", "group_processed")


@query(
    "joi02_user_reports",
    with_sql(
        S.REPORTS,
        S.UPLOADS,
        S.REPORT_ROWS,
        GROUP_STATS,
        body="""SELECT r.id, r.user_id, r.status, u.original_name AS source_original_name,
          coalesce(total_groups, 0) AS group_total, coalesce(processed_groups, 0) AS group_processed
          FROM reports r LEFT JOIN uploads u ON u.id = r.uploaded_file_id LEFT JOIN gs ON gs.report_id = r.id
          WHERE r.user_id = (SELECT min(user_id) FROM reports) ORDER BY r.created_at DESC, r.id DESC LIMIT 20""",
    ),
)
def user_reports(t: Tables) -> DataFrame:
    owner = S.reports(t).agg(F.min("user_id").alias("user_id"))
    mine = S.reports(t).join(owner, "user_id", "left_semi")
    listed = reports.report_list(mine, S.uploads(t), S.report_rows(t), limit=20)
    return listed.select("id", "user_id", "status", "source_original_name", "group_total", "group_processed")


@query(
    "joi03_recent_failures",
    with_sql(
        S.REPORTS,
        S.USERS,
        body="""SELECT r.id AS report_id, r.user_id, u.username, r.updated_at, r.error_text FROM reports r JOIN users u ON u.id = r.user_id
          WHERE r.status = 'failed' AND r.error_text IS NOT NULL AND r.error_text <> ''
          ORDER BY r.updated_at DESC, r.id DESC LIMIT 30""",
    ),
)
def recent_failures(t: Tables) -> DataFrame:
    return reports.recent_failures(S.reports(t), S.users(t))


NOW = "TIMESTAMP '2024-01-04 00:00:00'"


@query(
    "joi04_expired_uploads",
    with_sql(
        S.REPORTS,
        S.UPLOADS,
        body=f"""SELECT u.id, u.user_id, u.original_name FROM uploads u
          LEFT JOIN reports r ON r.user_id = u.user_id AND r.uploaded_file_id = u.id
          WHERE r.id IS NULL AND u.created_at < {NOW} - INTERVAL 24 HOUR
            AND coalesce(u.inspect_status, 'ready') NOT IN ('queued', 'parsing')""",
    ),
)
def expired_uploads(t: Tables) -> DataFrame:
    found = reports.expired_uploads(S.uploads(t), S.reports(t), F.expr(NOW.replace("TIMESTAMP", "TIMESTAMP_NTZ")))
    return found.select("id", "user_id", "original_name")


OVERVIEW = """overview AS (
  SELECT u.id, u.username, u.role, u.created_at, count(DISTINCT r.id) AS reports_count, max(s.created_at) AS last_login_at
  FROM users u LEFT JOIN reports r ON r.user_id = u.id LEFT JOIN sessions s ON s.user_id = u.id
  GROUP BY u.id, u.username, u.role, u.created_at)"""


@query(
    "joi05_users_overview",
    with_sql(S.USERS, S.REPORTS, S.SESSIONS, OVERVIEW, body="SELECT * FROM overview"),
)
def users_overview(t: Tables) -> DataFrame:
    return reports.users_overview(S.users(t), S.reports(t), S.sessions(t))


CACHE = """cached AS (
  SELECT sha256(text) AS cache_key, '{"category":"' || lang || '"}' AS analysis_json,
         '{"usage":{"total_tokens":' || doc_id || '}}' AS raw_json,
         row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) AS rn
  FROM documents WHERE lang <> 'de'),
exact_cache AS (SELECT * EXCLUDE (rn) FROM cached WHERE rn = 1)"""


def exact_cache(t: Tables) -> DataFrame:
    """Answers to every text that is not German, the latest document of a text."""
    known = t.documents.filter("lang <> 'de'").select(
        F.sha2("text", 256).alias("cache_key"),
        "doc_id",
        F.expr("""concat('{"category":"', lang, '"}')""").alias("analysis_json"),
        F.expr("""concat('{"usage":{"total_tokens":', doc_id, '}}')""").alias("raw_json"),
    )
    last = F.max_by(F.struct("analysis_json", "raw_json"), "doc_id").alias("v")
    return known.groupBy("cache_key").agg(last).select("cache_key", "v.*")


@query(
    "joi07_exact_lookup",
    with_sql(
        CACHE,
        body="""SELECT DISTINCT sha256(text) AS cache_key, analysis_json AS cached_answer, raw_json AS cached_raw
          FROM documents d LEFT JOIN exact_cache c ON c.cache_key = sha256(d.text)""",
    ),
)
def exact_lookup(t: Tables) -> DataFrame:
    requests = t.documents.select(F.sha2("text", 256).alias("cache_key")).distinct()
    return cache.exact_lookup(requests, exact_cache(t))


VECTORS = """entries AS (
  SELECT label, vec_id AS entry, CAST(embedding AS DOUBLE[]) AS vector,
         row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS rank FROM embeddings),
requests AS (SELECT vec_id, (label + 1) % 10 AS label, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings),
pairs AS (
  SELECT r.vec_id, e.entry, e.rank, list_cosine_similarity(r.vector, e.vector) AS score
  FROM requests r JOIN entries e ON e.label = r.label AND e.rank <= 200),
best AS (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 12) DESC, rank) AS rn FROM pairs)"""

SEMANTIC_SQL = with_sql(
    VECTORS,
    body="""SELECT r.vec_id, CASE WHEN b.score >= 0.3 THEN CAST(b.entry AS VARCHAR) END AS semantic_key,
      CASE WHEN b.score >= 0.3 THEN round(b.score, 4) END AS similarity
    FROM requests r LEFT JOIN best b ON b.vec_id = r.vec_id AND b.rn = 1""",
)


def _semantic(t: Tables, block_rows: int) -> DataFrame:
    entries = t.embeddings.select(
        "label", F.col("vec_id").cast("string").alias("semantic_key"), "embedding", F.col("vec_id").alias("updated_at")
    )
    requests = t.embeddings.select(
        "vec_id",
        ((F.col("label") + 1) % 10).alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    found = cache.semantic_lookup(requests, entries, ["label"], threshold=0.3, block_rows=block_rows)
    return found.select("vec_id", "semantic_key", "similarity")


@query("joi08_semantic_lookup", SEMANTIC_SQL)
def semantic_lookup(t: Tables) -> DataFrame:
    return _semantic(t, cache.BLOCK_ROWS)


@query("joi08_semantic_lookup_joined", SEMANTIC_SQL)
def semantic_lookup_joined(t: Tables) -> DataFrame:
    """Many small blocks of requests for each key."""
    return _semantic(t, 16)


@query(
    "joi09_cosine",
    """SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), list_reverse(CAST(embedding AS DOUBLE[]))), 8) AS similarity,
      0.0::DOUBLE AS empty FROM embeddings""",
)
def cosine(t: Tables) -> DataFrame:
    nothing = F.array().cast("array<double>")
    return t.embeddings.select(
        "vec_id",
        F.round(vectors.cosine(F.col("embedding"), F.reverse("embedding")), 8).alias("similarity"),
        vectors.cosine(F.col("embedding"), nothing).alias("empty"),
    )


@query(
    "joi10_group_answers",
    with_sql(
        S.GROUPED,
        "answers AS (SELECT group_key, max(turn) AS answer, count(*) * 3 AS total_tokens FROM grouped WHERE turn >= 3 GROUP BY group_key)",
        "f AS (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY row_number) AS rn FROM grouped)",
        body="""SELECT f.row_number, f.group_key, answer, CASE WHEN rn = 1 THEN coalesce(total_tokens, 0) ELSE 0 END AS total_tokens
          FROM f LEFT JOIN answers USING (group_key)""",
    ),
)
def group_answers(t: Tables) -> DataFrame:
    rows = S.grouped_rows(t).select("row_number", "group_key")
    answers = (
        t.conversations.filter("turn >= 3")
        .groupBy(F.expr("concat('c', conv_id)").alias("group_key"))
        .agg(F.max("turn").alias("answer"), (F.count(F.lit(1)) * 3).alias("total_tokens"))
    )
    return groups.spread_answers(rows, answers, ["group_key"])


@query(
    "joi11_stale_jobs",
    with_sql(
        S.REPORTS,
        """now AS (SELECT max(updated_at) AS now FROM reports)""",
        body="""SELECT id, job_id, status FROM reports, now
          WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey * 2 + 5000000 = job_id)
            AND ((status = 'running' AND date_diff('second', updated_at, now) >= 31536000)
              OR (status = 'queued' AND NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey * 3 + 5000000 = job_id)
                  AND date_diff('second', updated_at, now) >= 31536000))""",
    ),
)
def stale_jobs(t: Tables) -> DataFrame:
    all_reports = S.reports(t)
    leases = t.customer.select((F.col("c_custkey") * 2 + 5000000).alias("job_id"))
    markers = t.part.select((F.col("p_partkey") * 3 + 5000000).alias("job_id"))
    now = all_reports.agg(F.max("updated_at")).scalar().cast("timestamp_ntz")
    found = reports.stale_jobs(all_reports, leases, markers, now, False, 31_536_000)
    return found.select("id", "job_id", "status")


#: Several reports share a job, some lack what a start needs.
STARTED = """jobs AS (
  SELECT id, id // 2 + 5000000 AS job_id, status, created_at, updated_at, user_id, uploaded_file_id,
         CASE WHEN id % 11 = 0 THEN ' ' WHEN id % 4 = 0 THEN 'keyed' ELSE 'open' END AS provider,
         CASE WHEN id % 3 = 0 THEN 'secret' END AS api_key_encrypted
  FROM reports), now AS (SELECT max(updated_at) AS now FROM reports),
stale AS (
  SELECT j.*, now, EXISTS (SELECT 1 FROM part p WHERE p.p_partkey * 7 + 5000000 = j.job_id) AS marked,
         CASE WHEN trim(provider) = '' OR uploaded_file_id IS NULL OR coalesce(user_id, 0) = 0 THEN 'no context'
              WHEN provider = 'keyed' AND api_key_encrypted IS NULL THEN 'no key' END AS lack
  FROM jobs j, now
  WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey * 5 + 5000000 = j.job_id)
    AND date_diff('second', updated_at, now) >= 31536000
    AND (status = 'running' OR (status = 'queued' AND NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey * 7 + 5000000 = j.job_id)))),
ranked AS (
  SELECT *, min(CASE WHEN lack IS NULL AND NOT marked THEN struct_pack(c := created_at, i := id) END) OVER (PARTITION BY job_id) AS first FROM stale),
judged AS (
  SELECT *, CASE WHEN lack IS NOT NULL AND NOT coalesce(status = 'queued' AND struct_pack(c := created_at, i := id) > first, false) THEN 'failed'
                 WHEN lack IS NULL AND struct_pack(c := created_at, i := id) = first THEN 'queued' END AS new_status
  FROM ranked)"""


def started(t: Tables) -> DataFrame:
    return S.reports(t).selectExpr(
        "id", "id div 2 + 5000000 AS job_id", "status", "created_at", "updated_at", "user_id", "uploaded_file_id",
        "CASE WHEN id % 11 = 0 THEN ' ' WHEN id % 4 = 0 THEN 'keyed' ELSE 'open' END AS provider",
        "CASE WHEN id % 3 = 0 THEN 'secret' END AS api_key_encrypted",
        "'m' AS model", "'Rate {row_json}' AS prompt_template",
    )


def recovered(t: Tables) -> DataFrame:
    jobs = started(t)
    leases = t.customer.select((F.col("c_custkey") * 5 + 5000000).alias("job_id"))
    markers = t.part.select((F.col("p_partkey") * 7 + 5000000).alias("job_id"))
    now = jobs.agg(F.max("updated_at")).scalar().cast("timestamp_ntz")
    return reports.recover_jobs(jobs, leases, markers, now, False, ("keyed",), 31_536_000)


@query(
    "joi11_job_recovery",
    with_sql(
        S.REPORTS,
        STARTED,
        body=f"""SELECT id, job_id, status, new_status,
          CASE WHEN new_status = 'failed' THEN CASE lack WHEN 'no key' THEN '{K.MSG_NO_KEY}' ELSE '{K.MSG_NO_CONTEXT}' END END AS new_error,
          CASE WHEN new_status = 'failed' THEN now END AS new_finished_at FROM judged""",
    ),
)
def job_recovery(t: Tables) -> DataFrame:
    return recovered(t).select("id", "job_id", "status", "new_status", "new_error", "new_finished_at")


@query(
    "joi11_recovery_counts",
    with_sql(
        S.REPORTS,
        STARTED,
        body="""SELECT count(*) FILTER (new_status = 'queued') AS requeued, count(*) FILTER (new_status = 'failed') AS failed FROM judged""",
    ),
)
def recovery_counts(t: Tables) -> DataFrame:
    return reports.recovery_counts(recovered(t))


@query(
    "joi12_snapshot_merge",
    with_sql(
        S.REPORTS,
        "listed AS (SELECT id, status, processed_rows, current_step AS summary_json FROM reports WHERE status <> 'queued')",
        "fresh AS (SELECT id, 'paused' AS status, processed_rows + 1 AS processed_rows, 'none' AS summary_json FROM reports WHERE status IN ('running','queued'))",
        body="""SELECT coalesce(l.id, f.id) AS id, coalesce(f.status, l.status) AS status,
          coalesce(f.processed_rows, l.processed_rows) AS processed_rows,
          CASE WHEN l.id IS NULL THEN f.summary_json ELSE l.summary_json END AS summary_json, l.id IS NULL AS is_new
          FROM listed l FULL JOIN fresh f ON f.id = l.id""",
    ),
)
def snapshot_merge(t: Tables) -> DataFrame:
    base = S.reports(t).select("id", "status", "processed_rows", F.col("current_step").alias("summary_json"))
    listed = base.filter("status <> 'queued'")
    fresh = base.filter("status IN ('running', 'queued')").select(
        "id",
        F.lit("paused").alias("status"),
        (F.col("processed_rows") + 1).alias("processed_rows"),
        F.lit("none").alias("summary_json"),
    )
    return reports.merge_snapshot(listed, fresh, ["summary_json"])


@query(
    "joi13_orphan_uploads",
    with_sql(
        S.REPORTS,
        S.UPLOADS,
        body="""SELECT id, user_id FROM uploads u WHERE NOT EXISTS
          (SELECT 1 FROM reports r WHERE r.user_id = u.user_id AND r.uploaded_file_id = u.id)""",
    ),
)
def orphan_uploads(t: Tables) -> DataFrame:
    return reports.unreferenced_uploads(S.uploads(t), S.reports(t)).select("id", "user_id")


# --- aggregations -----------------------------------------------------------------------------


@query(
    "agg01_column_profile",
    with_sql(
        S.SHEET,
        *[
            f"p{i} AS (SELECT '{c}' AS column_name, count(*) AS total_rows, count(DISTINCT NULLIF(trim(CAST({c} AS VARCHAR), {S.WS}), '')) AS n FROM sheet)"
            for i, c in enumerate(["review", "lang", "source", "n_chars"])
        ],
        body="""SELECT column_name, total_rows, CASE WHEN n <= 900 THEN n END AS distinct_values
          FROM (SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3)""",
    ),
)
def column_profile(t: Tables) -> DataFrame:
    found = profile.column_profile(S.sheet(t), ["review", "lang", "source", "n_chars"], cap=900)
    return found.select("column_name", "total_rows", "distinct_values")


@query(
    "agg02_report_summary",
    with_sql(
        S.ANSWERED,
        body="""SELECT report_id, count(*) AS total_rows,
          sum(CASE WHEN coalesce(error_text, '') = '' AND custom_json IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS success_rows,
          sum(CASE WHEN coalesce(error_text, '') <> '' THEN 1 ELSE 0 END)::BIGINT AS failed_rows FROM answered GROUP BY report_id""",
    ),
)
def report_summary(t: Tables) -> DataFrame:
    return reports.report_summary(S.answered_rows(t), ["report_id"])


@query(
    "agg03_pending_groups",
    with_sql(
        S.REPORT_ROWS,
        body="""SELECT report_id, group_key, min(row_number) AS first_row_number, count(*) AS group_rows
          FROM report_rows WHERE status = 'pending' GROUP BY report_id, group_key""",
    ),
)
def pending_groups(t: Tables) -> DataFrame:
    return groups.pending_groups(S.report_rows(t), ["report_id", "group_key"])


@query(
    "agg04_group_assembly",
    with_sql(
        S.GROUPED,
        body="""SELECT group_key, min(row_number) AS row_number, count(*) AS group_size,
          string_agg('[row ' || row_number || '] ' || text, chr(10) ORDER BY row_number) AS review_text,
          '{"group_key":"' || group_key || '","group_size":' || count(*) || ',"rows":['
            || string_agg('{"row_number":' || row_number || ',"review_text":' || CAST(to_json(text) AS VARCHAR)
                          || ',"row_json":' || input_json || '}', ',' ORDER BY row_number) || ']}' AS input_json,
          'grouped_by:conv,group_size:' || count(*) AS warnings
        FROM grouped GROUP BY group_key""",
    ),
)
def group_assembly(t: Tables) -> DataFrame:
    found = groups.assemble(S.grouped_rows(t), ["group_key"], "conv")
    return found.withColumn("warnings", F.array_join("warnings", ","))


@query("agg05_group_progress", with_sql(S.REPORT_ROWS, GROUP_STATS, body="SELECT report_id, total_groups AS group_total, processed_groups AS group_processed FROM gs"))
def group_progress(t: Tables) -> DataFrame:
    return reports.group_progress(S.report_rows(t))


@query(
    "agg06_row_progress",
    with_sql(
        S.REPORT_ROWS,
        body="""SELECT report_id, count(*) AS total_rows, count(*) FILTER (WHERE status IN ('done','error')) AS processed_rows
          FROM report_rows GROUP BY report_id""",
    ),
)
def row_progress(t: Tables) -> DataFrame:
    return reports.row_progress(S.report_rows(t))


@query(
    "agg07_token_usage",
    with_sql(
        S.REPORTS,
        body="""SELECT user_id, coalesce(sum(prompt_tokens), 0)::BIGINT AS prompt_tokens, coalesce(sum(completion_tokens), 0)::BIGINT AS completion_tokens,
          coalesce(sum(total_tokens), 0)::BIGINT AS total_tokens FROM reports GROUP BY user_id""",
    ),
)
def token_usage(t: Tables) -> DataFrame:
    return reports.token_usage(S.reports(t))


@query(
    "agg08_status_histogram",
    with_sql(
        S.REPORTS,
        body="""SELECT count(*) FILTER (WHERE status = 'queued') AS queued, count(*) FILTER (WHERE status = 'running') AS running,
          count(*) FILTER (WHERE status = 'paused') AS paused, count(*) FILTER (WHERE status = 'failed') AS failed FROM reports""",
    ),
)
def status_histogram(t: Tables) -> DataFrame:
    return reports.status_histogram(S.reports(t))


@query(
    "agg09_users_newest",
    with_sql(
        S.USERS,
        S.REPORTS,
        S.SESSIONS,
        OVERVIEW,
        body="SELECT * FROM overview ORDER BY created_at DESC, id DESC LIMIT 200",
    ),
)
def users_newest(t: Tables) -> DataFrame:
    overview = reports.users_overview(S.users(t), S.reports(t), S.sessions(t), limit=200)
    return reports.newest(overview, 200)


@query(
    "agg10_result_keys",
    with_sql(
        S.ANSWERED,
        ANSWER_FIELDS,
        f"done AS (SELECT * FROM flat WHERE {MATERIALIZED})",
        """seen AS (
          SELECT 'passthrough' AS kind, 'source' AS key, row_number, 0 AS position FROM done
          UNION ALL SELECT 'passthrough', 'lang', row_number, 1 FROM done
          UNION ALL SELECT 'answer', 'category', row_number, 2 FROM done WHERE answer IS NOT NULL
          UNION ALL SELECT 'answer', 'score', row_number, 3 FROM done WHERE answer IS NOT NULL
          UNION ALL SELECT 'answer', 'meta.quality', row_number, 4 FROM done WHERE answer IS NOT NULL
          UNION ALL SELECT 'answer', 'meta.tags', row_number, 5 FROM done WHERE answer IS NOT NULL
          UNION ALL SELECT 'answer', 'toxic', row_number, 6 FROM done WHERE answer IS NOT NULL AND doc_id % 2 = 0)""",
        body="""SELECT kind, key, min(row_number) AS first_row, min(position) AS first_position FROM seen GROUP BY kind, key""",
    ),
)
def result_keys(t: Tables) -> DataFrame:
    from rowscribe.sources.export import finished_rows

    found = discovery.result_keys(finished_rows(S.answered_rows(t)))
    return found.select("kind", "key", "first_row", "first_position")


@query(
    "agg11_preview_keys",
    with_sql(
        S.ANSWERED,
        ANSWER_FIELDS,
        body="""SELECT report_id, k.key AS key, CAST(min(row_number * 10 + k.position) AS BIGINT) AS first_seen FROM flat,
          (VALUES ('review', 0), ('lang', 1), ('source', 2), ('category', 3), ('score', 4), ('meta.quality', 5), ('meta.tags', 6), ('toxic', 7)) k(key, position)
          WHERE k.position < 3 OR answer IS NOT NULL AND (k.position < 7 OR doc_id % 2 = 0) GROUP BY ALL""",
    ),
)
def preview_keys(t: Tables) -> DataFrame:
    rows = S.answered_rows(t)
    answer = F.col("custom_json")
    merged = jsonx.row_preview(F.col("input_json"), F.col("passthrough_json"), answer, depth=discovery.depth_of(rows, answer))
    seen = discovery.first_seen_keys(rows, F.map_keys(merged), ["report_id"])
    order = (F.col("first_row") * 10 + F.col("first_position")).cast("bigint")
    return seen.select("report_id", "key", order.alias("first_seen"))


@query(
    "agg12_outcome_breakdown",
    with_sql(
        S.ANSWERED,
        """s AS (SELECT report_id, count(*) AS total, count(*) FILTER (WHERE coalesce(error_text, '') = '' AND custom_json IS NOT NULL) AS ok,
           count(*) FILTER (WHERE coalesce(error_text, '') <> '') AS bad FROM answered GROUP BY report_id)""",
        body="""SELECT report_id, 'success_rows' AS outcome, ok AS rows, CAST(floor(ok * 100.0 / total + 0.5) AS BIGINT) AS share_percent FROM s
          UNION ALL SELECT report_id, 'failed_rows', bad, CAST(floor(bad * 100.0 / total + 0.5) AS BIGINT) FROM s""",
    ),
)
def outcome_breakdown(t: Tables) -> DataFrame:
    return reports.outcome_breakdown(reports.report_summary(S.answered_rows(t), ["report_id"]))


@query(
    "agg13_cache_counters",
    with_sql(
        S.ANSWERED,
        body="""SELECT count(*) FILTER (WHERE doc_id % 4 = 0) AS cache_hits, count(*) FILTER (WHERE doc_id % 4 IN (1, 3)) AS cache_misses FROM answered""",
    ),
)
def cache_counters(t: Tables) -> DataFrame:
    rows = S.answered_rows(t).select(text_list(F.col("warnings_json")).alias("warnings"))
    return cache.counters(rows)


SCHEMES = ["оплата мимо кассы", "личные скидки", "подмена товара", "вымогательство"]


@query(
    "agg14_group_risk",
    with_sql(
        f"""labelled AS (
          SELECT d.source, coalesce(l.toxic, 0) AS toxic,
                 CASE WHEN d.doc_id % 13 = 0 AND d.lang = 'fr' THEN {_quote(SCHEMES[3])} WHEN d.lang = 'en' THEN {_quote(SCHEMES[0])}
                      WHEN d.lang = 'de' THEN {_quote(SCHEMES[1])} ELSE {_quote(SCHEMES[2])} END AS scheme
          FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
        g AS (SELECT source, count(*) AS group_rows, sum(toxic)::BIGINT AS violations,
                coalesce(string_agg(DISTINCT CASE WHEN toxic = 1 THEN scheme END, ', ' ORDER BY CASE WHEN toxic = 1 THEN scheme END), '') AS schemes
              FROM labelled GROUP BY source)""",
        body="""SELECT source, group_rows, violations, schemes, round_even(violations * 100.0::DOUBLE / group_rows, 1) AS share_percent,
          CASE WHEN contains(schemes, 'вымогательство') THEN 'высокий'
               WHEN violations <= 1 OR violations * 100.0 / group_rows < 10 THEN 'низкий'
               WHEN violations <= 4 AND violations * 100.0 / group_rows <= 20 THEN 'средний' ELSE 'высокий' END AS risk_level FROM g""",
    ),
)
def group_risk(t: Tables) -> DataFrame:
    scheme = (
        F.when((F.col("doc_id") % 13 == 0) & (F.col("lang") == "fr"), F.lit(SCHEMES[3]))
        .when(F.col("lang") == "en", F.lit(SCHEMES[0]))
        .when(F.col("lang") == "de", F.lit(SCHEMES[1]))
        .otherwise(F.lit(SCHEMES[2]))
    )
    labelled = t.documents.join(t.labels, "doc_id", "left").select(
        "source", F.coalesce("toxic", F.lit(0)).alias("toxic"), scheme.alias("scheme")
    )
    found = groups.risk_rollup(labelled, "source", "toxic", "scheme")
    return found.withColumn("schemes", F.array_join("schemes", ", "))


@query(
    "agg15_upload_references",
    with_sql(
        S.REPORTS,
        body="SELECT user_id, uploaded_file_id, count(*) AS reference_count FROM reports GROUP BY ALL",
    ),
)
def upload_references(t: Tables) -> DataFrame:
    return reports.upload_references(S.reports(t))


@query(
    "agg16_activity_flags",
    with_sql(
        S.REPORTS,
        body="""SELECT user_id, bool_or(status IN ('running','queued','paused')) AS has_active, bool_or(status = 'running') AS has_running
          FROM reports GROUP BY user_id""",
    ),
)
def activity_flags(t: Tables) -> DataFrame:
    return reports.activity_flags(S.reports(t))


# --- sorts, limits, sets ---------------------------------------------------------------------------


@query(
    "srt01_newest_reports",
    with_sql(S.REPORTS, body="SELECT id, user_id, created_at FROM reports ORDER BY created_at DESC, id DESC LIMIT 20"),
)
def newest_reports(t: Tables) -> DataFrame:
    return reports.newest(S.reports(t).select("id", "user_id", "created_at"), 20)


PREVIEW_READY = """ready AS (
  SELECT * FROM flat WHERE report_id = 'r3' AND (coalesce(status, '') IN ('done','error') OR custom_json IS NOT NULL OR coalesce(error_text, '') <> ''))"""


@query(
    "srt02_preview",
    with_sql(
        S.ANSWERED,
        ANSWER_FIELDS,
        PREVIEW_READY,
        body="""SELECT CAST(row_number AS BIGINT) AS row_number, source, upper(lang) AS lang, "category", NULLIF(error_text, '') AS error
          FROM ready ORDER BY ready.row_number LIMIT 10""",
    ),
)
def preview(t: Tables) -> DataFrame:
    rows = S.answered_rows(t).filter("report_id = 'r3'").withColumn("warnings", text_list(F.col("warnings_json")))
    found = reports.preview(rows)
    cell = lambda key: jsonx.cell(F.element_at("columns", F.lit(key)), "string").alias(key)
    return found.select(
        F.col("row_number").cast("bigint").alias("row_number"), cell("source"), cell("lang"), cell("category"), "error"
    )


@query(
    "srt02_preview_grouped",
    with_sql(
        S.ANSWERED,
        ANSWER_FIELDS,
        PREVIEW_READY,
        "f AS (SELECT *, row_number() OVER (PARTITION BY coalesce(group_key, '') ORDER BY row_number) AS rn FROM ready)",
        "top AS (SELECT * FROM f WHERE rn = 1 ORDER BY f.row_number LIMIT 10)",
        body="""SELECT row_number() OVER (ORDER BY top.row_number) AS row_number, source, "category", NULLIF(error_text, '') AS error FROM top""",
    ),
)
def preview_grouped(t: Tables) -> DataFrame:
    rows = S.answered_rows(t).filter("report_id = 'r3'").withColumn("warnings", text_list(F.col("warnings_json")))
    found = reports.preview(rows, "source")
    cell = lambda key: jsonx.cell(F.element_at("columns", F.lit(key)), "string").alias(key)
    return found.select("row_number", cell("source"), cell("category"), "error")


@query(
    "srt03_log_order",
    with_sql(
        LOG_LINES,
        PARSED,
        body="""SELECT idx, ts, message FROM log_records ORDER BY TRY_CAST(ts AS TIMESTAMPTZ) DESC NULLS LAST,
          CASE WHEN TRY_CAST(ts AS TIMESTAMPTZ) IS NULL THEN -idx ELSE idx END""",
    ),
)
def log_order(t: Tables) -> DataFrame:
    return logs.newest_first(logs.parse_lines(log_lines(t)), "idx").select("idx", "ts", "message")


@query("srt04_first_rows", with_sql(S.SHEET, S.CLEAN, S.PACKED, body="SELECT row_number, review_text FROM packed WHERE row_number < 152"))
def first_rows(t: Tables) -> DataFrame:
    return R.first_rows(S.packed(t), 150).select("row_number", "review_text")


@query(
    "srt05_evict_oldest",
    with_sql(
        """entries AS (SELECT event_id AS cache_key, ts AS updated_at, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS rank FROM events)""",
        body="SELECT cache_key, updated_at FROM entries WHERE rank <= 7000",
    ),
)
def evict_oldest(t: Tables) -> DataFrame:
    entries = t.events.select(F.col("event_id").alias("cache_key"), F.col("ts").alias("updated_at"))
    return cache.evict_oldest(entries, 7000, "cache_key")


@query(
    "srt06_inflight",
    with_sql(
        S.REPORTS,
        body="SELECT id, status, created_at FROM reports WHERE status IN ('running','queued','paused') ORDER BY created_at, id",
    ),
)
def inflight(t: Tables) -> DataFrame:
    return reports.inflight(S.reports(t)).select("id", "status", "created_at")


@query(
    "srt07_first_row",
    with_sql(
        S.REPORT_ROWS,
        body="""SELECT report_id, min(row_number) AS row_number, arg_min(status, row_number) AS status FROM report_rows GROUP BY report_id""",
    ),
)
def first_row(t: Tables) -> DataFrame:
    rows = S.report_rows(t).select("report_id", "row_number", "status")
    return reports.first_row(rows, ["report_id"])


PRESETS = """presets AS (
  SELECT p_partkey AS id, p_partkey % 3 AS user_id, p_name || ' ' || p_partkey AS name, p_brand AS prompt_template,
         TIMESTAMP '2024-01-01' + to_hours(CAST(p_partkey % 500 AS INTEGER)) AS updated_at FROM part)"""


def presets(t: Tables) -> DataFrame:
    return t.part.selectExpr(
        "p_partkey AS id",
        "p_partkey % 3 AS user_id",
        "concat(p_name, ' ', p_partkey) AS name",
        "p_brand AS prompt_template",
        "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, CAST(p_partkey % 500 AS INT)) AS updated_at",
    )


@query(
    "srt08_presets",
    with_sql(
        PRESETS,
        body="SELECT id, name, updated_at FROM presets WHERE user_id = 1 ORDER BY updated_at DESC, id DESC LIMIT 100",
    ),
)
def newest_presets(t: Tables) -> DataFrame:
    mine = reports.owned(presets(t), 1).select("id", "name", "updated_at")
    return reports.newest(mine, 100, by="updated_at")


@query("set01_distinct_users", with_sql(S.REPORTS, body="SELECT DISTINCT user_id FROM reports"))
def distinct_users(t: Tables) -> DataFrame:
    return S.reports(t).select("user_id").distinct()


@query(
    "set02_union_by_id",
    with_sql(
        S.REPORTS,
        body="""SELECT id, 'fresh' AS origin FROM reports WHERE status IN ('running','queued')
          UNION ALL SELECT id, 'listed' FROM reports WHERE status NOT IN ('queued','running')""",
    ),
)
def union_by_id(t: Tables) -> DataFrame:
    base = S.reports(t)
    listed = base.filter("status <> 'queued'").select("id", F.lit("listed").alias("origin"))
    fresh = base.filter("status IN ('running', 'queued')").select("id", F.lit("fresh").alias("origin"))
    merged = reports.merge_snapshot(listed, fresh, [])
    return merged.select("id", "origin")


@query(
    "set03_concat_logs",
    with_sql(LOG_LINES, body="SELECT file, idx, line FROM log_lines"),
)
def concat_logs(t: Tables) -> DataFrame:
    lines = log_lines(t)
    return logs.concat_logs([lines.filter(F.col("file") == name) for name in ("f0", "f1", "f2")]).select("file", "idx", "line")


@query(
    "set04_known_columns",
    "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang || '|text' ELSE 'text' END AS columns FROM documents",
)
def known_columns(t: Tables) -> DataFrame:
    chosen = F.array(F.lit("gone"), F.col("lang"), F.lit("text"))
    available = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("text"), F.col("lang"))).otherwise(
        F.array(F.lit("text"), F.col("source"))
    )
    return t.documents.select("doc_id", F.array_join(text.keep_known(chosen, available), "|").alias("columns"))
