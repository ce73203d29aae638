"""The engine's tables, derived from the general test tables.

Each frame comes with the same derivation as a SQL common table expression.
The test tables have no nulls, markers or broken answers, so these are set by
expressions over the ids; every row of a table stays in.
"""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowscribe.operators import rows as R
from rowscribe.plans.registry import Tables


def with_sql(*ctes: str, body: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + body


# --- documents as a review sheet ---------------------------------------------


def sheet(t: Tables) -> DataFrame:
    return t.documents.selectExpr(
        "CAST(doc_id + 2 AS INT) AS row_number",
        r"""CASE WHEN doc_id % 17 = 3 THEN '  N/A ' WHEN doc_id % 17 = 5 THEN '\t'
             WHEN doc_id % 29 = 7 THEN NULL ELSE text END AS review""",
        "CASE WHEN doc_id % 23 = 4 THEN ' - ' ELSE lang END AS lang",
        "concat(' ', source, ' ') AS source",
        "n_chars",
    )


SHEET = """sheet AS (
  SELECT CAST(doc_id + 2 AS INTEGER) AS row_number,
         CASE WHEN doc_id % 17 = 3 THEN '  N/A ' WHEN doc_id % 17 = 5 THEN chr(9)
              WHEN doc_id % 29 = 7 THEN NULL ELSE text END AS review,
         CASE WHEN doc_id % 23 = 4 THEN ' - ' ELSE lang END AS lang,
         ' ' || source || ' ' AS source, n_chars
  FROM documents)"""

WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"
MARKERS = "('', 'nan', 'none', 'null', 'n/a', 'na', '-')"


def sql_clean(column: str) -> str:
    return (
        f"CASE WHEN lower(trim({column}, {WS})) IN {MARKERS} THEN NULL ELSE trim({column}, {WS}) END"
    )


CLEAN = f"""clean AS (
  SELECT row_number, {sql_clean('review')} AS review, {sql_clean('lang')} AS lang,
         trim(source, {WS}) AS source, n_chars
  FROM sheet)"""

PACKED = """packed AS (
  SELECT row_number,
         NULLIF(concat_ws(chr(10), 'lang: ' || lang, 'review: ' || review), '') AS review_text,
         CAST(to_json({'lang': lang, 'review': review}) AS VARCHAR) AS input_json,
         CAST(to_json({'source': source}) AS VARCHAR) AS passthrough_json,
         CASE WHEN lang IS NULL OR review IS NULL THEN 'empty_cell' ELSE '' END AS warnings
  FROM clean)"""


def packed(t: Tables, group_by: str | None = None) -> DataFrame:
    return R.build_rows(sheet(t), ["lang", "review"], ["source"], group_by)


# --- documents as workbooks ------------------------------------------------------------

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
#: What XML cannot hold.
_UNFIT = "[^\\x09\\x0A\\x20-\\uD7FF\\uE000-\\uFFFD\\x{10000}-\\x{10FFFF}]"


def _workbook(rows) -> bytes:
    """One workbook with a header, and of each row its id, text (twice, once as a shared string) and a flag."""
    text = lambda t: escape(t or "")
    lines = ['<row r="1"><c t="inlineStr"><is><t>id</t></is></c><c t="inlineStr"><is><t> text </t></is></c><c/><c t="inlineStr"><is><t>even</t></is></c></row>']
    for place, (number, value) in enumerate(rows):
        cell = f'<c t="inlineStr"><is><t>{text(value)}</t></is></c>' if value is not None else "<c/>"
        lines.append(f'<row><c><v>{number}</v></c>{cell}<c t="s"><v>{place % 2}</v></c><c t="b"><v>{(number + 1) % 2}</v></c></row>')
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_LINKS}"><sheets><sheet name="Rows" sheetId="1" r:id="r1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{_MAIN}"><si><t>first</t></si><si><t>other</t></si></sst>')
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{_MAIN}"><sheetData>{"".join(lines)}</sheetData></worksheet>')
    return held.getvalue()


def workbooks(t: Tables) -> DataFrame:
    """path, length and content of workbooks of at most 500 documents each."""

    def pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("doc_id")
        content = _workbook(zip(rows["doc_id"].tolist(), rows["text"].tolist(), strict=True))
        return pd.DataFrame({"path": [f"book-{key[0]}.xlsx"], "length": [len(content)], "content": [content]})

    # Line ends and characters that XML changes or cannot hold are spaces.
    text = F.regexp_replace("text", _UNFIT, " ").alias("text")
    return t.documents.select("doc_id", text).groupBy(F.expr("doc_id div 500").alias("book")).applyInPandas(pack, "path string, length bigint, content binary")


BOOKS = r"""books AS (
  SELECT doc_id, 'book-' || (doc_id // 500) || '.xlsx' AS path, row_number() OVER (PARTITION BY doc_id // 500 ORDER BY doc_id) + 1 AS row_number,
         regexp_replace(text, '[\x00-\x08\x0B-\x1F]', ' ', 'g') AS text
  FROM documents)"""


# --- documents and labels as finished report rows --------------------------------


def answered_rows(t: Tables) -> DataFrame:
    """Report rows in every state: with answers, broken ones, errors, pending."""
    docs = t.documents.join(t.labels, "doc_id", "left")
    return docs.selectExpr(
        "CAST(doc_id + 2 AS INT) AS row_number",
        "concat('r', doc_id % 5) AS report_id",
        """CASE WHEN doc_id % 19 = 1 THEN NULL WHEN doc_id % 19 = 2 THEN '' ELSE source END AS group_key""",
        """CASE doc_id % 11 WHEN 0 THEN 'pending' WHEN 1 THEN 'error' WHEN 2 THEN 'other'
             WHEN 3 THEN NULL ELSE 'done' END AS status""",
        "to_json(named_struct('review', text, 'lang', lang)) AS input_json",
        "to_json(named_struct('source', source, 'lang', upper(lang))) AS passthrough_json",
        """CASE WHEN doc_id % 11 IN (0, 1, 3) THEN NULL WHEN doc_id % 11 = 4 THEN 'not json'
             WHEN doc_id % 11 = 5 THEN '[1,2]'
             ELSE concat('{"category":"', lang, '","score":0.', doc_id % 9 + 1,
                         ',"meta":{"quality":', coalesce(quality, -1), ',"tags":["a",null,"b', doc_id % 3, '"]}',
                         CASE WHEN doc_id % 2 = 0 THEN concat(',"toxic":', coalesce(toxic, 0) = 1) ELSE '' END,
                         '}') END AS custom_json""",
        """CASE WHEN doc_id % 11 = 1 THEN concat('failed ', doc_id) WHEN doc_id % 11 = 6 THEN '' END AS error_text""",
        """CASE doc_id % 4 WHEN 0 THEN '["empty_cell","cache_hit"]' WHEN 1 THEN 'plain note'
             WHEN 2 THEN '["cache_disabled",""]' END AS warnings_json""",
        """CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN '{"usage":null}'
             ELSE concat('{"usage":{"prompt_tokens":', doc_id % 50, ',"completion_tokens":null,"total_tokens":', doc_id % 70, '}}')
             END AS raw_response_json""",
        "n_chars",
    )


ANSWERED = """answered AS (
  SELECT CAST(d.doc_id + 2 AS INTEGER) AS row_number, 'r' || (d.doc_id % 5) AS report_id,
         CASE WHEN d.doc_id % 19 = 1 THEN NULL WHEN d.doc_id % 19 = 2 THEN '' ELSE source END AS group_key,
         CASE d.doc_id % 11 WHEN 0 THEN 'pending' WHEN 1 THEN 'error' WHEN 2 THEN 'other'
              WHEN 3 THEN NULL ELSE 'done' END AS status,
         source, lang, text, d.doc_id AS doc_id, n_chars,
         CASE WHEN d.doc_id % 11 IN (0, 1, 3) THEN NULL WHEN d.doc_id % 11 = 4 THEN 'not json'
              WHEN d.doc_id % 11 = 5 THEN '[1,2]'
              ELSE '{"category":"' || lang || '","score":0.' || (d.doc_id % 9 + 1)
                   || ',"meta":{"quality":' || coalesce(quality, -1) || ',"tags":["a",null,"b' || (d.doc_id % 3) || '"]}'
                   || CASE WHEN d.doc_id % 2 = 0 THEN ',"toxic":' || (coalesce(toxic, 0) = 1) ELSE '' END || '}'
              END AS custom_json,
         CASE WHEN d.doc_id % 11 = 1 THEN 'failed ' || d.doc_id WHEN d.doc_id % 11 = 6 THEN '' END AS error_text,
         CASE d.doc_id % 4 WHEN 0 THEN '["empty_cell","cache_hit"]' WHEN 1 THEN 'plain note'
              WHEN 2 THEN '["cache_disabled",""]' END AS warnings_json,
         CASE WHEN d.doc_id % 3 = 0 THEN NULL WHEN d.doc_id % 3 = 1 THEN '{"usage":null}'
              ELSE '{"usage":{"prompt_tokens":' || (d.doc_id % 50) || ',"completion_tokens":null,"total_tokens":'
                   || (d.doc_id % 70) || '}}' END AS raw_response_json
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""

# --- answers to be checked -----------------------------------------------------------

TEMPLATE = {
    "category": {"type": "enum", "values": ["en", "de", "fr", "es"]},
    "score": {"type": "number", "min": 0, "max": 1},
    "count": {"type": "integer", "min": 0},
    "topics": {"type": "array", "items": {"type": "string", "min_length": 2}, "max_items": 3},
    "urgent": {"type": "boolean"},
    "day": {"type": "date"},
    "meta": {
        "type": "object",
        "properties": {"quality": {"type": "integer"}, "note": {"type": "string", "max_length": 5}},
        "required": ["quality"],
    },
}


def raw_answers(t: Tables) -> DataFrame:
    """One answer text per document, each way of being wrong included."""
    docs = t.documents.join(t.labels, "doc_id", "left").selectExpr(
        "doc_id", "lang", "doc_id % 16 AS k", "coalesce(quality, -1) AS quality", "coalesce(toxic, 0) AS toxic"
    )
    return docs.selectExpr(
        "doc_id",
        """CASE k WHEN 0 THEN 'no json' WHEN 1 THEN '["list"]' WHEN 2 THEN '{"source":"x"}' ELSE concat(
            '{"category":', CASE k WHEN 3 THEN '"it"' WHEN 4 THEN 'null' ELSE concat('"', lang, '"') END,
            ',"score":', CASE k WHEN 5 THEN '1.5' WHEN 6 THEN '"high"' ELSE concat('0.', doc_id % 9 + 1) END,
            CASE k WHEN 7 THEN '' ELSE concat(',"count":', CASE k WHEN 8 THEN '1.5' WHEN 9 THEN 'true' ELSE concat('', doc_id % 7) END) END,
            ',"topics":', CASE k WHEN 10 THEN '["ok","x"]' WHEN 11 THEN '["aa","bb","cc","dd"]' ELSE '["aa"]' END,
            ',"urgent":', CASE k WHEN 12 THEN '1' ELSE concat('', toxic = 1) END,
            ',"day":"', CASE k WHEN 13 THEN '2024-02-30' ELSE '2024-02-29' END, '"',
            ',"meta":', CASE k WHEN 14 THEN '{"note":"abc"}' ELSE concat('{"quality":', quality, ',"note":"',
                 CASE WHEN doc_id % 32 = 15 THEN 'too long' ELSE 'short' END, '"}') END,
            CASE WHEN doc_id % 5 = 0 THEN ',"lang":"x","extra":[1,{"a":0.5}]' ELSE '' END, '}') END AS answer""",
    )


RAW_ANSWERS = """cases AS (
  SELECT d.doc_id AS doc_id, lang, d.doc_id % 16 AS k, coalesce(quality, -1) AS quality, coalesce(toxic, 0) AS toxic
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
raw_answers AS (
  SELECT doc_id, lang, k, quality, toxic,
         CASE k WHEN 0 THEN 'no json' WHEN 1 THEN '["list"]' WHEN 2 THEN '{"source":"x"}' ELSE
            '{"category":' || CASE k WHEN 3 THEN '"it"' WHEN 4 THEN 'null' ELSE '"' || lang || '"' END
            || ',"score":' || CASE k WHEN 5 THEN '1.5' WHEN 6 THEN '"high"' ELSE '0.' || (doc_id % 9 + 1) END
            || CASE k WHEN 7 THEN '' ELSE ',"count":' || CASE k WHEN 8 THEN '1.5' WHEN 9 THEN 'true' ELSE '' || (doc_id % 7) END END
            || ',"topics":' || CASE k WHEN 10 THEN '["ok","x"]' WHEN 11 THEN '["aa","bb","cc","dd"]' ELSE '["aa"]' END
            || ',"urgent":' || CASE k WHEN 12 THEN '1' ELSE '' || (toxic = 1) END
            || ',"day":"' || CASE k WHEN 13 THEN '2024-02-30' ELSE '2024-02-29' END || '"'
            || ',"meta":' || CASE k WHEN 14 THEN '{"note":"abc"}' ELSE '{"quality":' || quality || ',"note":"'
                 || CASE WHEN doc_id % 32 = 15 THEN 'too long' ELSE 'short' END || '"}' END
            || CASE WHEN doc_id % 5 = 0 THEN ',"lang":"x","extra":[1,{"a":0.5}]' ELSE '' END || '}' END AS answer
  FROM cases)"""

# The same rules written against the parsed JSON.
CHECKED = """parsed AS (
  SELECT *, TRY_CAST(answer AS JSON) AS j FROM raw_answers),
checked AS (
  SELECT *, CASE
    WHEN j IS NULL OR json_type(j) <> 'OBJECT' THEN 'Ожидался JSON-объект в ответе модели'
    WHEN len(list_intersect(json_keys(j), ['category','score','count','topics','urgent','day','meta'])) = 0
      THEN 'Модель вернула входные данные вместо результата по Ожидаемому JSON'
    WHEN coalesce(json_type(j, '$.category'), 'NULL') = 'NULL' THEN 'В ответе отсутствует обязательное поле: category'
    WHEN coalesce(json_type(j, '$.score'), 'NULL') = 'NULL' THEN 'В ответе отсутствует обязательное поле: score'
    WHEN coalesce(json_type(j, '$.count'), 'NULL') = 'NULL' THEN 'В ответе отсутствует обязательное поле: count'
    WHEN coalesce(json_type(j, '$.topics'), 'NULL') = 'NULL' THEN 'В ответе отсутствует обязательное поле: topics'
    WHEN coalesce(json_type(j, '$.urgent'), 'NULL') = 'NULL' THEN 'В ответе отсутствует обязательное поле: urgent'
    WHEN coalesce(json_type(j, '$.day'), 'NULL') = 'NULL' THEN 'В ответе отсутствует обязательное поле: day'
    WHEN coalesce(json_type(j, '$.meta'), 'NULL') = 'NULL' THEN 'В ответе отсутствует обязательное поле: meta'
    WHEN json_extract_string(j, '$.category') NOT IN ('en','de','fr','es') THEN 'Поле ''category'' должно быть одним из: en|de|fr|es'
    WHEN json_type(j, '$.score') NOT IN ('DOUBLE','UBIGINT','BIGINT') THEN 'Поле ''score'' должно быть числом'
    WHEN TRY_CAST(json_extract_string(j, '$.score') AS DOUBLE) > 1 THEN 'Поле ''score'' должно быть <= 1'
    WHEN json_type(j, '$.count') NOT IN ('UBIGINT','BIGINT','BOOLEAN') THEN 'Поле ''count'' должно быть целым числом'
    WHEN json_array_length(j, '$.topics') > 3 THEN 'Поле ''topics'' должно содержать не более 3 элементов'
    WHEN length(json_extract_string(j, '$.topics[0]')) < 2 THEN 'Поле ''topics[0]'' должно содержать не менее 2 символов'
    WHEN length(json_extract_string(j, '$.topics[1]')) < 2 THEN 'Поле ''topics[1]'' должно содержать не менее 2 символов'
    WHEN json_type(j, '$.urgent') <> 'BOOLEAN' THEN 'Поле ''urgent'' должно быть boolean'
    WHEN TRY_CAST(json_extract_string(j, '$.day') AS DATE) IS NULL THEN 'Поле ''day'' должно быть датой в формате YYYY-MM-DD'
    WHEN json_type(j, '$.meta.quality') IS NULL THEN 'Поле ''meta'' должно содержать обязательные ключи: quality'
    WHEN length(json_extract_string(j, '$.meta.note')) > 5 THEN 'Поле ''meta.note'' должно содержать не более 5 символов'
  END AS error FROM parsed)"""

# --- orders, customers, parts and line items as stored tables -----------------------------


def reports(t: Tables) -> DataFrame:
    return t.orders.selectExpr(
        "o_orderkey AS id",
        "o_orderkey + 5000000 AS job_id",
        "o_custkey AS user_id",
        """CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 'failed'
             WHEN o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' THEN 'canceled'
             WHEN o_orderstatus = 'F' OR (o_orderstatus = 'O' AND o_orderpriority = '1-URGENT') THEN 'completed'
             WHEN o_orderstatus = 'P' AND o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'paused'
             WHEN o_orderstatus = 'P' THEN 'running' ELSE 'queued' END AS status""",
        "o_orderdate AS created_at",
        "o_orderdate + make_dt_interval(CAST(o_orderkey % 10 AS INT)) AS updated_at",
        "CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + make_dt_interval(3) END AS finished_at",
        """CASE WHEN o_orderkey % 3 = 0 THEN concat('code ', o_orderkey % 100) WHEN o_orderkey % 3 = 1 THEN '' END AS error_text""",
        """CASE o_orderkey % 7 WHEN 0 THEN o_custkey WHEN 1 THEN o_orderkey % 997 END AS uploaded_file_id""",
        "CASE WHEN o_orderkey % 3 = 0 THEN 'lang' END AS group_by_column",
        "CAST(o_totalprice AS BIGINT) div 1000 AS total_rows",
        "(CAST(o_totalprice AS BIGINT) div 1000) * (o_orderkey % 11) div 10 AS processed_rows",
        "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 1000 END AS prompt_tokens",
        "o_orderkey % 300 AS completion_tokens",
        "o_orderkey % 1300 AS total_tokens",
        """CASE o_orderkey % 6 WHEN 0 THEN 'Обработка 5/10' WHEN 1 THEN ' В очереди ' WHEN 2 THEN ''
             WHEN 3 THEN 'Подготовка данных ' WHEN 4 THEN NULL ELSE 'На паузе 1/2 ' END AS current_step""",
    )


REPORTS = """reports AS (
  SELECT o_orderkey AS id, o_orderkey + 5000000 AS job_id, o_custkey AS user_id,
         CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 'failed'
              WHEN o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' THEN 'canceled'
              WHEN o_orderstatus = 'F' OR (o_orderstatus = 'O' AND o_orderpriority = '1-URGENT') THEN 'completed'
              WHEN o_orderstatus = 'P' AND o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'paused'
              WHEN o_orderstatus = 'P' THEN 'running' ELSE 'queued' END AS status,
         o_orderdate AS created_at, o_orderdate + to_days(CAST(o_orderkey % 10 AS INTEGER)) AS updated_at,
         CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + to_days(3) END AS finished_at,
         CASE WHEN o_orderkey % 3 = 0 THEN 'code ' || (o_orderkey % 100) WHEN o_orderkey % 3 = 1 THEN '' END AS error_text,
         CASE o_orderkey % 7 WHEN 0 THEN o_custkey WHEN 1 THEN o_orderkey % 997 END AS uploaded_file_id,
         CASE WHEN o_orderkey % 3 = 0 THEN 'lang' END AS group_by_column,
         CAST(trunc(o_totalprice) AS BIGINT) // 1000 AS total_rows,
         (CAST(trunc(o_totalprice) AS BIGINT) // 1000) * (o_orderkey % 11) // 10 AS processed_rows,
         CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 1000 END AS prompt_tokens,
         o_orderkey % 300 AS completion_tokens, o_orderkey % 1300 AS total_tokens,
         CASE o_orderkey % 6 WHEN 0 THEN 'Обработка 5/10' WHEN 1 THEN ' В очереди ' WHEN 2 THEN ''
              WHEN 3 THEN 'Подготовка данных ' WHEN 4 THEN NULL ELSE 'На паузе 1/2 ' END AS current_step
  FROM orders)"""


def users(t: Tables) -> DataFrame:
    return t.customer.selectExpr(
        "c_custkey AS id",
        "c_name AS username",
        "CASE WHEN c_nationkey = 0 THEN 'admin' ELSE 'user' END AS role",
        "TIMESTAMP_NTZ '2020-01-01 00:00:00' + make_dt_interval(CAST(c_custkey % 900 AS INT)) AS created_at",
    )


USERS = """users AS (
  SELECT c_custkey AS id, c_name AS username,
         CASE WHEN c_nationkey = 0 THEN 'admin' ELSE 'user' END AS role,
         TIMESTAMP '2020-01-01 00:00:00' + to_days(CAST(c_custkey % 900 AS INTEGER)) AS created_at
  FROM customer)"""


def uploads(t: Tables) -> DataFrame:
    return t.part.selectExpr(
        "p_partkey AS id",
        "p_partkey AS user_id",
        """CASE p_partkey % 4 WHEN 0 THEN concat('/in/', p_name, '.v1.xlsx') WHEN 1 THEN concat(p_name, '.xlsx')
             WHEN 2 THEN concat(' .', p_brand, ' ') ELSE '' END AS original_name""",
        "TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, CAST(p_partkey % 97 AS INT)) AS created_at",
        """CASE p_size % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'parsing' WHEN 2 THEN NULL ELSE 'ready' END AS inspect_status""",
        "CAST(p_retailprice * 200000 AS BIGINT) AS length",
    )


UPLOADS = """uploads AS (
  SELECT p_partkey AS id, p_partkey AS user_id,
         CASE p_partkey % 4 WHEN 0 THEN '/in/' || p_name || '.v1.xlsx' WHEN 1 THEN p_name || '.xlsx'
              WHEN 2 THEN ' .' || p_brand || ' ' ELSE '' END AS original_name,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(p_partkey % 97 AS INTEGER)) AS created_at,
         CASE p_size % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'parsing' WHEN 2 THEN NULL ELSE 'ready' END AS inspect_status,
         CAST(trunc(p_retailprice * 200000) AS BIGINT) AS length
  FROM part)"""


def sessions(t: Tables) -> DataFrame:
    return t.events.filter("event_type = 'signup'").selectExpr("user_id", "ts AS created_at")


SESSIONS = """sessions AS (
  SELECT user_id, ts AS created_at FROM events WHERE event_type = 'signup')"""


def report_rows(t: Tables) -> DataFrame:
    return t.lineitem.selectExpr(
        "l_orderkey AS report_id",
        "(l_partkey * 1000 + l_suppkey % 1000) * 10 + l_linenumber AS row_number",
        "CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE concat('g', l_suppkey % 3) END AS group_key",
        """CASE WHEN l_returnflag = 'N' THEN 'pending' WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'error'
             ELSE 'done' END AS status""",
        """CASE WHEN l_returnflag <> 'N' AND NOT (l_returnflag = 'R' AND l_linestatus = 'O') AND l_linenumber <> 6
             THEN concat('{"q":', CAST(l_quantity AS INT), '}') END AS custom_json""",
        """CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'bad answer' WHEN l_linenumber = 5 THEN '' END AS error_text""",
        """CASE WHEN l_linenumber = 3 THEN array('empty_cell', 'skipped_large_group:9>5')
             WHEN l_linenumber = 4 THEN array('empty_cell', 'cache_hit') ELSE array() END AS warnings""",
        "CAST(l_quantity AS INT) AS prompt_tokens",
        "CAST(l_linenumber AS INT) AS completion_tokens",
        "CAST(l_quantity AS INT) + l_linenumber AS total_tokens",
    )


REPORT_ROWS = """report_rows AS (
  SELECT l_orderkey AS report_id, (l_partkey * 1000 + l_suppkey % 1000) * 10 + l_linenumber AS row_number,
         CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE 'g' || (l_suppkey % 3) END AS group_key,
         CASE WHEN l_returnflag = 'N' THEN 'pending' WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'error'
              ELSE 'done' END AS status,
         CASE WHEN l_returnflag <> 'N' AND NOT (l_returnflag = 'R' AND l_linestatus = 'O') AND l_linenumber <> 6
              THEN '{"q":' || CAST(l_quantity AS INTEGER) || '}' END AS custom_json,
         CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'bad answer' WHEN l_linenumber = 5 THEN '' END AS error_text,
         CASE WHEN l_linenumber = 3 THEN ['empty_cell', 'skipped_large_group:9>5']
              WHEN l_linenumber = 4 THEN ['empty_cell', 'cache_hit'] ELSE CAST([] AS VARCHAR[]) END AS warnings,
         CAST(l_quantity AS INTEGER) AS prompt_tokens, CAST(l_linenumber AS INTEGER) AS completion_tokens,
         CAST(l_quantity AS INTEGER) + l_linenumber AS total_tokens
  FROM lineitem)"""

# --- conversations as a grouped report ------------------------------------------------------


def grouped_rows(t: Tables) -> DataFrame:
    return t.conversations.selectExpr(
        "conv_id * 100 + turn AS row_number",
        "concat('c', conv_id) AS group_key",
        "text AS review_text",
        "to_json(named_struct('role', role, 'text', text)) AS input_json",
        "to_json(named_struct('conv', concat('c', conv_id))) AS passthrough_json",
        "CASE WHEN turn = 1 THEN array('empty_cell') ELSE array() END AS warnings",
        "'pending' AS status",
        "CAST(NULL AS STRING) AS error_text",
    )


GROUPED = """grouped AS (
  SELECT conv_id * 100 + turn AS row_number, 'c' || conv_id AS group_key, conv_id, turn, role, text,
         CAST(to_json({'role': role, 'text': text}) AS VARCHAR) AS input_json,
         CASE WHEN turn = 1 THEN ['empty_cell'] ELSE CAST([] AS VARCHAR[]) END AS warnings
  FROM conversations)"""

# --- events as progress of jobs --------------------------------------------------------------


def job_events(t: Tables) -> DataFrame:
    """One look at a job per event; some fields are missing in some looks."""
    return t.events.selectExpr(
        "user_id AS job",
        "event_id AS seq",
        "unix_micros(CAST(ts AS TIMESTAMP)) AS at_us",
        """CASE WHEN event_id % 700 = 699 THEN 'completed' WHEN event_type = 'signup' THEN 'queued'
             WHEN event_type = 'error' THEN 'paused' ELSE 'running' END AS status""",
        "event_id div 1000 AS processed",
        "10 AS total",
        "CASE WHEN event_type = 'click' THEN 'reading' ELSE 'asking' END AS current_step",
    )


JOB_EVENTS = """job_events AS (
  SELECT user_id AS job, event_id AS seq, epoch_us(ts) AS at_us,
         CASE WHEN event_id % 700 = 699 THEN 'completed' WHEN event_type = 'signup' THEN 'queued'
              WHEN event_type = 'error' THEN 'paused' ELSE 'running' END AS status,
         event_id // 1000 AS processed, 10 AS total,
         CASE WHEN event_type = 'click' THEN 'reading' ELSE 'asking' END AS current_step
  FROM events)"""
