"""Registered queries: scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowscribe import constants as K
from rowscribe.functions import jsonx
from rowscribe.operators import logs, maintenance, reports
from rowscribe.operators.rows import build_rows
from rowscribe.plans import stand_ins as S
from rowscribe.plans.registry import Tables, query
from rowscribe.session import scratch_path
from rowscribe.sources import export
from rowscribe.sources.sheets import decode_workbooks, is_admissible, profile_workbooks, sheet_from
from rowscribe.sources.tables import report_scan

with_sql = S.with_sql

ROW_SQL = "SELECT row_number, review_text, input_json, passthrough_json, warnings FROM packed"


@query(
    "src01_sheet_scan",
    with_sql(
        f"""numbered AS (
  SELECT CAST(row_number() OVER (ORDER BY doc_id) + 1 AS BIGINT) AS row_number, trim(text, {S.WS}) AS review,
         lang, source FROM documents)""",
        body=f"""SELECT row_number,
         NULLIF(concat_ws(chr(10), 'review: ' || {S.sql_clean('review')}, 'lang: ' || {S.sql_clean('lang')}), '') AS review_text,
         CAST(to_json({{'review': {S.sql_clean('review')}, 'lang': {S.sql_clean('lang')}}}) AS VARCHAR) AS input_json,
         CAST(to_json({{'Column 4': source}}) AS VARCHAR) AS passthrough_json
       FROM numbered""",
    ),
)
def sheet_scan(t: Tables) -> DataFrame:
    raw = t.documents.select(
        "doc_id", F.col("text").alias(" review "), F.col("lang").alias("lang "), F.col("source").alias("  ")
    )
    rows = build_rows(sheet_from(raw, "doc_id").drop("doc_id"), ["review", "lang"], ["Column 4"])
    return rows.select("row_number", "review_text", "input_json", "passthrough_json")


@query(
    "src01_workbook_rows",
    with_sql(
        S.BOOKS,
        body="""SELECT path, row_number, CAST(doc_id AS VARCHAR) AS id, 'number' AS id_kind, text, CASE row_number % 2 WHEN 0 THEN 'first' ELSE 'other' END AS shared,
            CASE WHEN doc_id % 2 = 0 THEN 'True' ELSE 'False' END AS even FROM books""",
    ),
)
def workbook_rows(t: Tables) -> DataFrame:
    """Rows of workbooks, cells with their kind."""
    cells = decode_workbooks(S.workbooks(t)).filter("row_number > 1")
    text = lambda place: F.col("cells")[place]["text"]
    return cells.select("path", F.col("row_number").cast("bigint").alias("row_number"), text(0).alias("id"), F.col("cells")[0]["kind"].alias("id_kind"), text(1).alias("text"), text(2).alias("shared"), text(3).alias("even"))


@query(
    "agg01_workbook_profile",
    with_sql(
        S.BOOKS,
        body=f"""SELECT path, c.column_name, count(*) AS total_rows, count(DISTINCT CASE c.place WHEN 0 THEN CAST(doc_id AS VARCHAR) WHEN 1 THEN nullif(trim(text, {S.WS}), '')
            WHEN 2 THEN CASE row_number % 2 WHEN 0 THEN 'first' ELSE 'other' END ELSE CAST(doc_id % 2 AS VARCHAR) END) AS distinct_values
          FROM books, (VALUES (0, 'id'), (1, 'text'), (2, 'Column 3'), (3, 'even')) c(place, column_name) GROUP BY path, c.column_name""",
    ),
)
def workbook_profile(t: Tables) -> DataFrame:
    found = profile_workbooks(decode_workbooks(S.workbooks(t)))
    return found.select("path", "column_name", "total_rows", "distinct_values")


@query(
    "src02_upload_admission",
    with_sql(
        S.UPLOADS,
        body="""SELECT id, original_name, length FROM uploads
          WHERE lower(original_name) LIKE '%.xlsx' AND length <= 209715200""",
    ),
)
def upload_admission(t: Tables) -> DataFrame:
    files = S.uploads(t)
    return files.filter(is_admissible(F.col("original_name"), F.col("length"))).select(
        "id", "original_name", "length"
    )


@query(
    "src03_placeholder_ingest",
    with_sql(
        S.REPORT_ROWS,
        body="""SELECT n.report_id, n.row_number, n.group_key FROM report_rows n
          WHERE NOT EXISTS (SELECT 1 FROM report_rows o WHERE o.report_id = n.report_id
                            AND o.row_number = n.row_number AND o.status = 'done')
          QUALIFY row_number() OVER (PARTITION BY report_id, row_number ORDER BY group_key NULLS FIRST) = 1""",
    ),
)
def placeholder_ingest(t: Tables) -> DataFrame:
    rows = S.report_rows(t)
    stored = rows.filter("status = 'done'")
    new = rows.select("report_id", "row_number", "group_key")
    return maintenance.insert_missing(stored, new, ["report_id", "row_number"])


@query(
    "src04_report_scan",
    with_sql(
        S.ANSWERED,
        body="SELECT row_number, status, group_key, n_chars FROM answered WHERE report_id = 'r2' ORDER BY row_number",
    ),
)
def ordered_report_scan(t: Tables) -> DataFrame:
    rows = S.answered_rows(t).select("report_id", "row_number", "status", "group_key", "n_chars")
    return report_scan(rows, "r2").drop("report_id")


@query(
    "src05_keyset_page",
    with_sql(
        S.REPORT_ROWS,
        body="""SELECT row_number, report_id, group_key FROM report_rows
          WHERE status = 'pending' AND row_number > 500000 ORDER BY row_number, report_id LIMIT 2000""",
    ),
)
def keyset_page(t: Tables) -> DataFrame:
    rows = S.report_rows(t).select("row_number", "report_id", "group_key", "status")
    return reports.pending_page(rows, 500_000, 2000, ["report_id"]).drop("status")


_CUSTOM = "CASE WHEN TRY_CAST(custom_json AS JSON) IS NOT NULL AND json_type(TRY_CAST(custom_json AS JSON)) = 'OBJECT' THEN custom_json END"

ANSWER_FIELDS = f"""fields AS (
  SELECT *, {_CUSTOM} AS answer FROM answered),
flat AS (
  SELECT *, json_extract_string(answer, '$.category') AS "category", CAST(json_extract_string(answer, '$.score') AS DOUBLE) AS "score",
         CAST(json_extract_string(answer, '$.meta.quality') AS BIGINT) AS "meta.quality",
         CASE WHEN answer IS NOT NULL THEN 'a, b' || (doc_id % 3) END AS "meta.tags",
         CAST(json_extract_string(answer, '$.toxic') AS BOOLEAN) AS "toxic"
  FROM fields)"""

WARNINGS_SQL = """CASE doc_id % 4 WHEN 0 THEN 'empty_cell, cache_hit' WHEN 1 THEN 'plain note'
         WHEN 2 THEN 'cache_disabled' ELSE '' END"""

MATERIALIZED = """(CASE WHEN status IN ('done','error') THEN true WHEN status = 'pending' THEN false
    ELSE custom_json IS NOT NULL OR coalesce(error_text, '') <> '' END)"""


@query(
    "src06_wide_export",
    with_sql(
        S.ANSWERED,
        ANSWER_FIELDS,
        f"""done AS (SELECT * FROM flat WHERE {MATERIALIZED}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY row_number) AS rn FROM done)""",
        body=f"""SELECT row_number, source, upper(lang) AS lang, "category", "score", "meta.quality", "meta.tags", "toxic",
          {WARNINGS_SQL} AS warnings, error_text AS error
        FROM ranked WHERE coalesce(group_key, '') = '' OR rn = 1""",
    ),
)
def wide_export(t: Tables) -> DataFrame:
    return export.wide_results(S.answered_rows(t))


@query(
    "src06_wide_export_grouped",
    with_sql(
        S.ANSWERED,
        ANSWER_FIELDS,
        f"""done AS (SELECT * FROM flat WHERE {MATERIALIZED}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY row_number) AS rn FROM done)""",
        body=f"""SELECT row_number() OVER (ORDER BY row_number) AS group_number, source, "category", "score", "meta.quality",
          "meta.tags", "toxic", {WARNINGS_SQL} AS warnings, error_text AS error
        FROM ranked WHERE coalesce(group_key, '') = '' OR rn = 1""",
    ),
)
def wide_export_grouped(t: Tables) -> DataFrame:
    return export.wide_results(S.answered_rows(t), group_by="source")


@query(
    "src06_named_export",
    with_sql(
        S.ANSWERED,
        ANSWER_FIELDS,
        f"""done AS (SELECT * FROM flat WHERE {MATERIALIZED}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY row_number) AS rn FROM done)""",
        body=f"""SELECT row_number, source, "toxic", CAST("score" AS DECIMAL(4,2)) AS "score", {WARNINGS_SQL} AS warnings, error_text AS error
        FROM ranked WHERE coalesce(group_key, '') = '' OR rn = 1""",
    ),
)
def named_export(t: Tables) -> DataFrame:
    """Columns and types as the caller names them; no key is looked for."""
    return export.wide_results(S.answered_rows(t), carried={"source": "string"}, answered={"toxic": "boolean", "score": "decimal(4,2)"})


@query(
    "src06_long_export",
    with_sql(
        S.ANSWERED,
        ANSWER_FIELDS,
        f"""done AS (SELECT * FROM flat WHERE {MATERIALIZED}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY row_number) AS rn FROM done)""",
        body="""SELECT row_number, p.key, CASE p.key WHEN 'score' THEN "score" WHEN 'meta.quality' THEN "meta.quality" END AS number,
            CASE p.key WHEN 'toxic' THEN "toxic" END AS flag, CASE p.key WHEN 'category' THEN "category" WHEN 'meta.tags' THEN "meta.tags" END AS word
          FROM ranked, (VALUES ('category'), ('score'), ('meta.quality'), ('meta.tags'), ('toxic')) p(key)
          WHERE (coalesce(group_key, '') = '' OR rn = 1) AND answer IS NOT NULL AND (p.key <> 'toxic' OR doc_id % 2 = 0)""",
    ),
)
def long_export(t: Tables) -> DataFrame:
    found, value = export.long_results(S.answered_rows(t)), F.col("value")
    kind = jsonx.kind_of(value)
    number = F.when(kind.isin("BIGINT", "DECIMAL", "DOUBLE"), jsonx.cell(value, "double")).alias("number")
    flag = F.when(kind == "BOOLEAN", jsonx.cell(value, "boolean")).alias("flag")
    word = F.when(kind.isin("STRING", "ARRAY"), jsonx.cell(value, "string")).alias("word")
    return found.select("row_number", "key", number, flag, word)


SUMMARY_SQL = """SELECT count(*) AS total, count(*) FILTER (WHERE coalesce(error_text, '') = '' AND custom_json IS NOT NULL) AS ok,
    count(*) FILTER (WHERE coalesce(error_text, '') <> '') AS bad FROM answered"""


@query(
    "src07_summary_sheet",
    with_sql(
        S.ANSWERED,
        f"s AS ({SUMMARY_SQL})",
        body="""SELECT 'total_rows' AS metric, CAST(total AS VARCHAR) AS value FROM s
          UNION ALL SELECT 'processed_rows', CAST(total AS VARCHAR) FROM s
          UNION ALL SELECT 'success_rows', CAST(ok AS VARCHAR) FROM s
          UNION ALL SELECT 'failed_rows', CAST(bad AS VARCHAR) FROM s""",
    ),
)
def summary_sheet(t: Tables) -> DataFrame:
    return export.summary_table(export.export_summary(S.answered_rows(t))).select("metric", "value")


@query(
    "src08_raw_export",
    with_sql(
        S.ANSWERED,
        body="""SELECT report_id, row_number, group_key, status, custom_json, error_text, warnings_json, raw_response_json, n_chars,
          CAST(to_json({'source': source, 'lang': upper(lang)}) AS VARCHAR) AS passthrough_json FROM answered""",
    ),
)
def raw_export(t: Tables) -> DataFrame:
    rows = S.answered_rows(t)
    path = scratch_path(t.spark, "raw")
    export.write_raw(rows, path, "rules", "rules-1", "prompt", "1")
    return t.spark.read.schema(rows.drop("input_json").schema).json(f"{path}/rows")


@query(
    "src09_partial_export",
    with_sql(
        S.ANSWERED,
        f"s AS ({SUMMARY_SQL})",
        body="SELECT total AS total_rows, ok AS success_rows, bad AS failed_rows, true AS partial FROM s",
    ),
)
def partial_export(t: Tables) -> DataFrame:
    return export.export_summary(S.answered_rows(t), partial=True)


@query(
    "src09_partial_rows",
    with_sql(
        S.ANSWERED,
        ANSWER_FIELDS,
        f"done AS (SELECT * FROM flat WHERE {MATERIALIZED} AND report_id = 'r3')",
        """ranked AS (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY row_number) AS rn FROM done)""",
        body=f"""SELECT row_number, source, upper(lang) AS lang, "category", "score", "meta.quality", "meta.tags", "toxic",
          {WARNINGS_SQL} AS warnings, error_text AS error
        FROM ranked WHERE coalesce(group_key, '') = '' OR rn = 1""",
    ),
)
def partial_rows(t: Tables) -> DataFrame:
    """What an unfinished report gives as written: rows with an outcome, none that wait."""
    path = scratch_path(t.spark, "partial")
    export.write_export(S.answered_rows(t).filter("report_id = 'r3'"), path, partial=True)
    return t.spark.read.parquet(f"{path}/results")


LOG_LINES = """log_lines AS (
  SELECT event_id AS idx, 'f' || (user_id % 3) AS file,
         CASE event_id % 6 WHEN 0 THEN 'plain ' || event_type || ' line ' || event_id WHEN 1 THEN '   ' WHEN 2 THEN '["list"]'
           ELSE '{"ts":"' || CASE WHEN event_id % 5 = 0 THEN 'bad' ELSE '2024-01-' || lpad(CAST(event_id % 28 + 1 AS VARCHAR), 2, '0') || 'T00:00:00Z' END
                || '","level":' || CASE event_id % 4 WHEN 0 THEN 'null' WHEN 1 THEN '"ERROR"' ELSE '"info"' END
                || ',"service":"worker","message":"Saw ' || event_type || '"}' END AS line
  FROM events)"""

PARSED = """parsed_log AS (
  SELECT idx, file, line, TRY_CAST(line AS JSON) AS j FROM log_lines WHERE trim(line) <> ''),
log_records AS (
  SELECT idx, file, line, CASE WHEN json_type(j) = 'OBJECT' THEN json_extract_string(j, '$.ts') END AS ts,
         CASE WHEN json_type(j) = 'OBJECT' THEN json_extract_string(j, '$.level') END AS level,
         CASE WHEN json_type(j) = 'OBJECT' THEN json_extract_string(j, '$.service') END AS service,
         CASE WHEN json_type(j) = 'OBJECT' THEN coalesce(json_extract_string(j, '$.message'), line) ELSE line END AS message
  FROM parsed_log)"""


def log_lines(t: Tables) -> DataFrame:
    return t.events.selectExpr(
        "event_id AS idx",
        "concat('f', user_id % 3) AS file",
        """CASE event_id % 6 WHEN 0 THEN concat('plain ', event_type, ' line ', event_id) WHEN 1 THEN '   ' WHEN 2 THEN '["list"]'
           ELSE concat('{"ts":"', CASE WHEN event_id % 5 = 0 THEN 'bad' ELSE concat('2024-01-', lpad(CAST(event_id % 28 + 1 AS STRING), 2, '0'), 'T00:00:00Z') END,
                '","level":', CASE event_id % 4 WHEN 0 THEN 'null' WHEN 1 THEN '"ERROR"' ELSE '"info"' END,
                ',"service":"worker","message":"Saw ', event_type, '"}') END AS line""",
    )


@query(
    "src10_log_scan",
    with_sql(LOG_LINES, PARSED, body="SELECT idx, ts, level, service, message FROM log_records"),
)
def log_scan(t: Tables) -> DataFrame:
    return logs.parse_lines(log_lines(t)).select("idx", "ts", "level", "service", "message")


@query(
    "src11_log_tail",
    with_sql(
        LOG_LINES,
        """per_file AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY idx DESC) AS rn FROM log_lines)""",
        body="SELECT file, idx, line FROM per_file WHERE rn <= 200 ORDER BY file DESC, idx DESC LIMIT 200",
    ),
)
def log_tail(t: Tables) -> DataFrame:
    return logs.tail(log_lines(t), 200, "file", ["idx"]).select("file", "idx", "line")
