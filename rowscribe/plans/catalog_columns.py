"""Registered queries: projections, scalar functions, filters."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowscribe import constants as K
from rowscribe.functions import jsonx, progress, prompts, text
from rowscribe.functions.template import compile_template
from rowscribe.operators import logs
from rowscribe.operators.discovery import cell_table, depth_of
from rowscribe.operators import rows as R
from rowscribe.plans import stand_ins as S
from rowscribe.plans.catalog_scan import ANSWER_FIELDS, LOG_LINES, MATERIALIZED, PARSED, log_lines
from rowscribe.plans.registry import Tables, query

with_sql = S.with_sql


@query(
    "prj01_clean_cell",
    with_sql(
        S.SHEET,
        body=f"""SELECT row_number, {S.sql_clean('review')} AS review,
          CASE WHEN {S.sql_clean('review')} IS NULL THEN 'empty_cell' END AS warning FROM sheet""",
    ),
)
def clean_cell(t: Tables) -> DataFrame:
    return S.sheet(t).select(
        "row_number",
        text.clean_cell(F.col("review")).alias("review"),
        text.cell_warning(F.col("review")).alias("warning"),
    )


@query("prj02_review_text", with_sql(S.SHEET, S.CLEAN, S.PACKED, body="SELECT row_number, review_text FROM packed"))
def review_text(t: Tables) -> DataFrame:
    return S.packed(t).select("row_number", "review_text")


@query(
    "prj03_row_packing",
    with_sql(S.SHEET, S.CLEAN, S.PACKED, body="SELECT row_number, input_json, passthrough_json FROM packed"),
)
def row_packing(t: Tables) -> DataFrame:
    return S.packed(t).select("row_number", "input_json", "passthrough_json")


@query("prj04_row_warnings", with_sql(S.SHEET, S.CLEAN, S.PACKED, body="SELECT row_number, warnings FROM packed"))
def row_warnings(t: Tables) -> DataFrame:
    return S.packed(t).select("row_number", F.array_join("warnings", ",").alias("warnings"))


@query(
    "prj05_group_key",
    with_sql(
        S.SHEET,
        S.CLEAN,
        body="""SELECT row_number, coalesce(lang, '__missing__:' || row_number) AS group_key,
          concat_ws(',', CASE WHEN lang IS NULL OR review IS NULL THEN 'empty_cell' END,
                    CASE WHEN lang IS NULL THEN 'group_key_missing' END) AS warnings FROM clean""",
    ),
)
def group_key(t: Tables) -> DataFrame:
    return S.packed(t, "lang").select("row_number", "group_key", F.array_join("warnings", ",").alias("warnings"))


@query(
    "prj06_job_columns",
    with_sql(S.SHEET, S.CLEAN, body="SELECT row_number, CAST(to_json({'lang': trim(s.lang)}) AS VARCHAR) AS passthrough_json FROM clean c JOIN sheet s USING (row_number)"),
)
def job_columns(t: Tables) -> DataFrame:
    # A grouped job carries its group column through, whatever else was chosen.
    return S.packed(t, "lang").select("row_number", "passthrough_json")


SQUASH = r"trim(regexp_replace(coalesce({}, ''), '[\s\x0b\x1c-\x1f\x{{85}}\x{{a0}}]+', ' ', 'g'))"


@query(
    "prj07_squash_space",
    f"SELECT doc_id, {SQUASH.format('text')} AS text FROM documents",
)
def squash_space(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", prompts.normalized_input(F.lit(None), F.col("text")).alias("text"))


PROMPT = "Rate this review.\n{row_json}\nAnswer in JSON. Again: {row_json}"
SCHEMA = compile_template(S.TEMPLATE)


def _sha(value) -> str:
    body = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)
    return hashlib.sha256(body.encode()).hexdigest()


def _quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_HEAD = "\n".join(["rules", "rules-1", "custom", _sha(PROMPT), _sha(S.TEMPLATE), _sha(SCHEMA)]) + "\n"


@query(
    "prj08_cache_key",
    with_sql(
        S.SHEET,
        S.CLEAN,
        S.PACKED,
        body=f"""SELECT row_number, sha256({SQUASH.format('input_json')}) AS review_hash,
          sha256({_quote(_HEAD)} || sha256({SQUASH.format('input_json')})) AS cache_key,
          '{_sha(PROMPT)}' AS prompt_hash, '{_sha(S.TEMPLATE)}' AS expected_template_hash,
          '{_sha(SCHEMA)}' AS output_schema_hash FROM packed""",
    ),
)
def cache_key(t: Tables) -> DataFrame:
    keys = prompts.cache_keys(
        prompts.normalized_input(F.col("input_json"), F.col("review_text")),
        provider="rules",
        model="rules-1",
        mode="custom",
        prompt_template=PROMPT,
        template=S.TEMPLATE,
        schema=SCHEMA,
    )
    return S.packed(t).select("row_number", *[c.alias(n) for n, c in keys.items()])


_BLOCK = "\n\n" + "\n".join([*K.ANSWER_RULES, json.dumps(S.TEMPLATE, ensure_ascii=False, indent=2)]) + "\n"


@query(
    "prj09_prompt",
    with_sql(
        S.SHEET,
        S.CLEAN,
        S.PACKED,
        f"""prompts AS (SELECT *, trim(replace({_quote(PROMPT)}, '{{row_json}}', input_json), {S.WS}) || {_quote(_BLOCK)} AS prompt FROM packed)""",
        body=f"""SELECT row_number, prompt,
          rtrim(prompt, {S.WS}) || chr(10) || chr(10) || {_quote(K.FEEDBACK_INTRO)} || chr(10) || {_quote(K.FEEDBACK_REASON)} || 'bad' || chr(10)
          || CASE WHEN review_text IS NULL THEN '' ELSE {_quote(K.FEEDBACK_ANSWER)}
               || CASE WHEN length(review_text) > 500 THEN substr(review_text, 1, 500) || '…' ELSE review_text END || chr(10) END
          || {_quote(K.FEEDBACK_OUTRO)} || chr(10) AS retry_prompt
        FROM prompts""",
    ),
)
def prompt(t: Tables) -> DataFrame:
    rendered = S.packed(t).withColumn("prompt", prompts.render_prompt(PROMPT, F.col("input_json"), "custom", S.TEMPLATE))
    again = prompts.with_feedback(F.col("prompt"), F.lit(" bad "), F.col("review_text"))
    return rendered.select("row_number", "prompt", again.alias("retry_prompt"))


@query(
    "prj10_flatten",
    with_sql(
        S.ANSWERED,
        ANSWER_FIELDS,
        body="""SELECT row_number, "category", "score", "meta.quality" AS meta_quality, "toxic",
          CASE WHEN answer IS NULL THEN 0 ELSE 4 + (doc_id % 2 = 0)::INT END AS n_keys FROM flat""",
    ),
)
def flatten(t: Tables) -> DataFrame:
    rows = S.answered_rows(t)
    answer = F.col("custom_json")
    rows = rows.withColumn("flat", jsonx.flatten_object(answer, depth_of(rows, answer)))
    cell = lambda key, kind, name: jsonx.cell(F.element_at("flat", F.lit(key)), kind).alias(name)
    return rows.select(
        "row_number",
        cell("category", "string", "category"),
        cell("score", "double", "score"),
        cell("meta.quality", "int", "meta_quality"),
        cell("toxic", "boolean", "toxic"),
        F.size("flat").alias("n_keys"),
    )


@query(
    "prj10_cell_table",
    with_sql(
        S.ANSWERED,
        ANSWER_FIELDS,
        body="""SELECT row_number, p.position, p.key, p.kind, CASE p.key WHEN 'category' THEN "category" WHEN 'score' THEN CAST("score" AS VARCHAR)
            WHEN 'meta.quality' THEN CAST("meta.quality" AS VARCHAR) WHEN 'meta.tags' THEN "meta.tags" ELSE CAST("toxic" AS VARCHAR) END AS value
          FROM flat, (VALUES (0, 'category', 'STRING'), (1, 'score', 'DECIMAL'), (2, 'meta.quality', 'BIGINT'), (3, 'meta.tags', 'ARRAY'), (4, 'toxic', 'BOOLEAN')) p(position, key, kind)
          WHERE answer IS NOT NULL AND (p.position < 4 OR doc_id % 2 = 0)""",
    ),
)
def cells(t: Tables) -> DataFrame:
    found = cell_table(S.answered_rows(t), ["row_number"], F.col("custom_json"))
    return found.select("row_number", "position", "key", jsonx.kind_of(F.col("value")).alias("kind"), jsonx.cell(F.col("value"), "string").alias("value"))


@query(
    "prj11_list_cell",
    with_sql(S.ANSWERED, ANSWER_FIELDS, body='SELECT row_number, "meta.tags" AS tags, "meta.quality" AS quality, "toxic" FROM flat'),
)
def list_cell(t: Tables) -> DataFrame:
    flat = jsonx.flatten_object(F.col("custom_json"), 1)
    cell = lambda key, kind, name: jsonx.cell(flat[key], kind).alias(name)
    return S.answered_rows(t).select("row_number", cell("meta.tags", "string", "tags"), cell("meta.quality", "int", "quality"), cell("toxic", "boolean", "toxic"))


@query(
    "prj12_safe_object",
    with_sql(S.ANSWERED, ANSWER_FIELDS, body="SELECT row_number, coalesce(answer, '{}') AS object FROM flat"),
)
def safe_object(t: Tables) -> DataFrame:
    return S.answered_rows(t).select("row_number", jsonx.object_or_empty(F.col("custom_json")).alias("object"))


@query(
    "prj13_answer_or_legacy",
    with_sql(
        S.ANSWERED,
        ANSWER_FIELDS,
        body="""SELECT row_number, coalesce(answer, CASE WHEN doc_id % 3 = 2 THEN raw_response_json
          WHEN doc_id % 3 = 1 THEN raw_response_json ELSE '{}' END) AS object FROM flat""",
    ),
)
def answer_or_legacy(t: Tables) -> DataFrame:
    found = jsonx.analysis_text(F.col("custom_json"), F.col("raw_response_json"))
    return S.answered_rows(t).select("row_number", found.alias("object"))


@query(
    "prj14_row_preview",
    with_sql(
        S.ANSWERED,
        ANSWER_FIELDS,
        body="""SELECT row_number, text AS review, upper(lang) AS lang, source, "category", "score", coalesce(group_key, '-') AS group_key,
          CASE WHEN answer IS NULL THEN 3 ELSE 7 + (doc_id % 2 = 0)::INT END AS n_columns,
          source AS grouped_source, CASE WHEN answer IS NULL THEN 1 ELSE 5 + (doc_id % 2 = 0)::INT END AS n_grouped
        FROM flat""",
    ),
)
def row_preview(t: Tables) -> DataFrame:
    sources = [F.col("input_json"), F.col("passthrough_json"), F.col("custom_json")]
    rows = S.answered_rows(t).withColumns(
        {
            "plain": jsonx.row_preview(*sources, depth=1),
            "grouped": jsonx.row_preview(*sources, "source", F.col("group_key"), depth=1),
        }
    )
    cell = lambda key, kind="string": jsonx.cell(F.element_at("plain", F.lit(key)), kind).alias(key)
    return rows.select(
        "row_number",
        cell("review"),
        cell("lang"),
        cell("source"),
        cell("category"),
        cell("score", "double"),
        F.coalesce("group_key", F.lit("-")).alias("group_key"),
        F.size("plain").alias("n_columns"),
        jsonx.cell(F.element_at("grouped", F.lit("source")), "string").alias("grouped_source"),
        F.size("grouped").alias("n_grouped"),
    )


@query(
    "prj15_warning_list",
    with_sql(
        S.ANSWERED,
        body="""SELECT row_number, CASE doc_id % 4 WHEN 0 THEN 'empty_cell|cache_hit' WHEN 1 THEN 'plain note'
          WHEN 2 THEN 'cache_disabled' ELSE '' END AS warnings FROM answered""",
    ),
)
def warning_list(t: Tables) -> DataFrame:
    listed = jsonx.text_list(F.col("warnings_json"))
    return S.answered_rows(t).select("row_number", F.array_join(listed, "|").alias("warnings"))


@query(
    "prj16_token_fallback",
    "SELECT doc_id, CAST(greatest(1, length(text) // 4) AS INTEGER) AS prompt_tokens, 40 AS completion_tokens FROM documents",
)
def token_fallback(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id",
        jsonx.fallback_prompt_tokens(F.col("text")).alias("prompt_tokens"),
        F.lit(K.FALLBACK_COMPLETION_TOKENS).alias("completion_tokens"),
    )


@query(
    "prj17_usage",
    with_sql(
        S.ANSWERED,
        body="""SELECT row_number, CASE WHEN doc_id % 3 = 2 THEN doc_id % 50 ELSE 0 END AS prompt_tokens, 0 AS completion_tokens,
          CASE WHEN doc_id % 3 = 2 THEN doc_id % 70 ELSE 0 END AS total_tokens, doc_id % 3 = 2 AS has_usage FROM answered""",
    ),
)
def usage(t: Tables) -> DataFrame:
    raw = F.col("raw_response_json")
    return S.answered_rows(t).select(
        "row_number",
        *[jsonx.usage(raw, n).cast("bigint").alias(n) for n in ("prompt_tokens", "total_tokens")],
        jsonx.usage(raw, "completion_tokens").alias("completion_tokens"),
        jsonx.has_usage(raw).alias("has_usage"),
    )


@query(
    "prj18_percent",
    with_sql(
        S.REPORTS,
        body="""SELECT id, CASE WHEN total_rows = 0 THEN 0.0 ELSE round_even(processed_rows * 100.0::DOUBLE / total_rows, 2) END AS percent,
          round(CASE WHEN total_rows > 0 THEN least(100.0, greatest(0.0, (processed_rows + 3) * 100.0::DOUBLE / total_rows)) ELSE 0.0 END, 6) AS clamped
        FROM reports""",
    ),
)
def percent(t: Tables) -> DataFrame:
    done, total = F.col("processed_rows"), F.col("total_rows")
    return S.reports(t).select(
        "id",
        progress.percent(done, total).alias("percent"),
        F.round(progress.clamped_percent(done + 3, total), 6).alias("clamped"),
    )


@query(
    "prj19_eta_seconds",
    with_sql(
        S.REPORTS,
        body="""SELECT id, CASE WHEN total_rows > processed_rows
            THEN round_even((id % 1000) * 1.7320508::DOUBLE / greatest(1, processed_rows - 2) * (total_rows - processed_rows), 1) ELSE 0.0 END AS eta
          FROM reports""",
    ),
)
def eta_seconds(t: Tables) -> DataFrame:
    eta = progress.eta_seconds(
        (F.col("id") % 1000) * F.lit(1.7320508), F.col("processed_rows"), F.col("total_rows"), F.lit(2)
    )
    return S.reports(t).select("id", eta.alias("eta"))


@query(
    "prj20_eta_text",
    with_sql(
        S.REPORTS,
        "etas AS (SELECT id, CASE WHEN id % 9 = 0 THEN NULL ELSE (id % 5000) * 2.5::DOUBLE END AS eta FROM reports)",
        "parts AS (SELECT *, CAST(floor(eta + 0.5) AS BIGINT) AS s FROM etas)",
        body="""SELECT id, CASE WHEN eta IS NULL OR eta <= 0 THEN NULL
            WHEN s < 60 THEN 'Осталось ~' || s || ' сек'
            WHEN s < 3600 THEN 'Осталось ~' || CAST(floor(s / 60.0 + 0.5) AS BIGINT) || ' мин'
            WHEN CAST(floor((s % 3600) / 60.0 + 0.5) AS BIGINT) > 0
              THEN 'Осталось ~' || (s // 3600) || ' ч ' || CAST(floor((s % 3600) / 60.0 + 0.5) AS BIGINT) || ' мин'
            ELSE 'Осталось ~' || (s // 3600) || ' ч' END AS eta_text FROM parts""",
    ),
)
def eta_text(t: Tables) -> DataFrame:
    eta = F.when(F.col("id") % 9 != 0, (F.col("id") % 5000) * F.lit(2.5))
    return S.reports(t).select("id", progress.eta_text(eta).alias("eta_text"))


@query(
    "prj21_effective_progress",
    with_sql(
        S.REPORTS,
        "g AS (SELECT *, id % 4 AS group_total, id % 3 AS group_done, coalesce(group_by_column, '') <> '' AND id % 4 > 0 AS grouped FROM reports)",
        "p AS (SELECT id, grouped, CASE WHEN grouped THEN group_done ELSE processed_rows END AS processed, CASE WHEN grouped THEN group_total ELSE total_rows END AS total FROM g)",
        body="""SELECT id, grouped AS is_grouped, processed, total,
          round(CASE WHEN total > 0 THEN processed::DOUBLE / total * 100 ELSE 0.0 END, 6) AS percent FROM p""",
    ),
)
def effective_progress(t: Tables) -> DataFrame:
    shown = progress.effective_progress(
        F.col("group_by_column"), F.col("id") % 3, F.col("id") % 4, F.col("processed_rows"), F.col("total_rows")
    )
    shown["percent"] = F.round(shown["percent"], 6)
    return S.reports(t).select("id", *[c.alias(n) for n, c in shown.items()])


@query(
    "prj22_visible_step",
    with_sql(
        S.REPORTS,
        body="SELECT id, CASE WHEN id % 6 = 3 THEN 'Подготовка данных' END AS step FROM reports",
    ),
)
def visible_step(t: Tables) -> DataFrame:
    return S.reports(t).select("id", text.visible_step(F.col("current_step")).alias("step"))


@query(
    "prj23_file_stem",
    "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_name || '.v1' WHEN 1 THEN p_name WHEN 2 THEN '.' || p_brand END AS stem FROM part",
)
def file_stem(t: Tables) -> DataFrame:
    return S.uploads(t).select("id", text.file_stem(F.col("original_name")).alias("stem"))


@query(
    "prj24_safe_name",
    r"""WITH b AS (SELECT page_id, trim(regexp_replace(trim(url), '[\\/:*?"<>|\x00-\x1f]', '_', 'g'), '. ') AS base FROM pages)
    SELECT page_id, substr(CASE WHEN instr(base, '.') > 1 THEN regexp_replace(base, '\.[^.]*$', '') ELSE base END, 1, 100) || '.xlsx' AS name FROM b""",
)
def safe_name(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.safe_file_name(F.col("url"), "report", "xlsx").alias("name"))


def _redacted(column: str) -> str:
    out = column
    for pattern, replacement in K.SECRET_PATTERNS:
        out = f"regexp_replace({out}, {_quote(pattern)}, {_quote(replacement.replace('$', chr(92)))}, 'g')"
    return out


_SECRET_TEXT = "text || chr(10) || CASE doc_id % 3 WHEN 0 THEN 'Authorization: Bearer ' || source || '; x' WHEN 1 THEN 'api_key=\"' || source || '\" Password: ''pw'' ' ELSE 'API-KEY : \"k\"' END"


@query("prj25_mask_secrets", f"SELECT doc_id, {_redacted('(' + _SECRET_TEXT + ')')} AS text FROM documents")
def mask_secrets(t: Tables) -> DataFrame:
    noisy = F.concat(
        "text",
        F.lit("\n"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Authorization: Bearer "), "source", F.lit("; x")))
        .when(F.col("doc_id") % 3 == 1, F.concat(F.lit('api_key="'), "source", F.lit("\" Password: 'pw' ")))
        .otherwise(F.lit('API-KEY : "k"')),
    )
    return t.documents.select("doc_id", text.mask_secrets(noisy).alias("text"))


@query(
    "prj26_settings",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false ELSE true END AS flag,
      CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN 'a|1' ELSE '' END AS columns FROM events""",
)
def settings(t: Tables) -> DataFrame:
    stored = F.expr(
        "CASE event_id % 5 WHEN 0 THEN ' YES ' WHEN 1 THEN 'off' WHEN 2 THEN event_type WHEN 3 THEN '0' END"
    )
    listed = F.expr(
        """CASE event_id % 4 WHEN 0 THEN concat('["', event_type, '"," "]') WHEN 1 THEN '["a",1,""]' WHEN 2 THEN '{"a":1}' END"""
    )
    return t.events.select(
        "event_id",
        text.truthy(stored, True).alias("flag"),
        F.array_join(jsonx.setting_list(listed), "|").alias("columns"),
    )


@query(
    "prj27_overflow",
    """SELECT event_id, event_id % 4 IN (0, 1) AS openai, event_id % 4 IN (1, 2) AS ollama FROM events""",
)
def overflow(t: Tables) -> DataFrame:
    code = F.expr("CASE WHEN event_id % 4 = 0 THEN 'Context_Length_Exceeded' ELSE event_type END")
    note = F.expr(
        """CASE event_id % 4 WHEN 1 THEN concat(event_type, ': prompt TOO LONG') WHEN 2 THEN 'size Exceeds limit' ELSE event_type END"""
    )
    return t.events.select(
        "event_id",
        text.is_overflow(code, note, "openai").alias("openai"),
        text.is_overflow(code, note, "ollama").alias("ollama"),
    )


@query(
    "prj28_suggested_column",
    "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'The Review ' || lang WHEN 1 THEN lang ELSE 'Отзыв' END AS suggested FROM documents",
)
def suggested_column(t: Tables) -> DataFrame:
    headers = F.expr(
        """CASE doc_id % 3 WHEN 0 THEN array(lang, concat('The Review ', lang), 'review') WHEN 1 THEN array(lang, source)
           ELSE array(source, 'Отзыв') END"""
    )
    return t.documents.select("doc_id", text.suggested_column(headers).alias("suggested"))


@query(
    "prj29_sections",
    with_sql(
        """notes AS (SELECT doc_id, lang, source, trim(text, chr(10) || ' ') AS body FROM documents)""",
        body=f"""SELECT doc_id, 1 AS section, lang AS version, lang || ' — ' || source AS title,
          trim(array_to_string(list_filter(string_split(regexp_replace(trim(body, {S.WS}), '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]', chr(10), 'g'), chr(10)), lambda x: trim(x, {S.WS}) <> '---'), chr(10)), {S.WS}) AS body FROM notes
        UNION ALL SELECT doc_id, 2, '2.0', '2.0 beta', 'end' FROM notes""",
    ),
)
def sections(t: Tables) -> DataFrame:
    noted = t.documents.select(
        "doc_id",
        F.concat(
            F.lit("# intro\n---\n## "),
            "lang",
            F.lit(" — "),
            "source",
            F.lit("\n---\n"),
            "text",
            F.lit("\n---\n##  2.0 beta \nend\n --- \n"),
        ).alias("text"),
    )
    return logs.sections(noted, "doc_id", "text")


@query(
    "prj30_stored_summary",
    with_sql(
        S.REPORTS,
        body="""SELECT id, CASE WHEN id % 3 = 0 THEN '{"total_rows":' || total_rows || '}' ELSE '{"computed":true}' END AS summary FROM reports""",
    ),
)
def stored_summary(t: Tables) -> DataFrame:
    from rowscribe.operators.reports import stored_or_computed

    stored = F.expr(
        """CASE id % 3 WHEN 0 THEN concat('{"total_rows":', total_rows, '}') WHEN 1 THEN '[1]' ELSE 'broken' END"""
    )
    return S.reports(t).select("id", stored_or_computed(stored, F.lit('{"computed":true}')).alias("summary"))


# --- filters ------------------------------------------------------------------------------


@query("flt01_materialized", with_sql(S.ANSWERED, body=f"SELECT row_number, {MATERIALIZED} AS materialized FROM answered"))
def materialized(t: Tables) -> DataFrame:
    done = R.is_materialized(
        F.col("status"), F.col("custom_json"), F.lit(None).cast("string"), F.col("error_text")
    )
    return S.answered_rows(t).select("row_number", done.alias("materialized"))


@query(
    "flt02_previewable",
    with_sql(
        S.ANSWERED,
        body="""SELECT row_number, status FROM answered WHERE coalesce(status, '') IN ('done','error')
          OR custom_json IS NOT NULL OR coalesce(error_text, '') <> ''""",
    ),
)
def previewable(t: Tables) -> DataFrame:
    ready = R.is_previewable(
        F.col("status"), F.col("custom_json"), F.lit(None).cast("string"), F.col("error_text")
    )
    return S.answered_rows(t).filter(ready).select("row_number", "status")


@query(
    "flt03_pending",
    with_sql(S.REPORT_ROWS, body="SELECT report_id, row_number FROM report_rows WHERE status = 'pending'"),
)
def pending(t: Tables) -> DataFrame:
    return S.report_rows(t).filter("status = 'pending'").select("report_id", "row_number")


@query(
    "flt04_active",
    with_sql(S.REPORTS, body="SELECT id, user_id, status FROM reports WHERE status IN ('running','queued','paused')"),
)
def active(t: Tables) -> DataFrame:
    from rowscribe.operators.reports import active_reports

    return active_reports(S.reports(t)).select("id", "user_id", "status")


@query(
    "flt05_owned",
    with_sql(
        S.REPORTS,
        body="""SELECT 'owner' AS test, id, user_id FROM reports WHERE user_id = 7
          UNION ALL SELECT 'job', id, user_id FROM reports WHERE job_id = 5000042
          UNION ALL SELECT 'id', id, user_id FROM reports WHERE id = 11""",
    ),
)
def owned(t: Tables) -> DataFrame:
    from rowscribe.operators.reports import owned as find

    reports = S.reports(t)
    named = lambda name, df: df.select(F.lit(name).alias("test"), "id", "user_id")
    return (
        named("owner", find(reports, 7))
        .unionByName(named("job", find(reports, job_id=5000042)))
        .unionByName(named("id", find(reports, id=11)))
    )


@query(
    "flt06_log_filter",
    with_sql(
        LOG_LINES,
        PARSED,
        body="""SELECT idx, level, message FROM log_records WHERE (coalesce(level, '') = '' OR upper(level) = 'ERROR')
          AND (lower(message) LIKE '%click%' OR lower(line) LIKE '%click%')""",
    ),
)
def log_filter(t: Tables) -> DataFrame:
    found = logs.filter_records(logs.parse_lines(log_lines(t)), " error ", "CLICK")
    return found.select("idx", "level", "message")


@query(
    "flt07_access_noise",
    """SELECT event_id FROM events WHERE NOT (event_type IN ('view', 'click')) OR CAST(value AS INTEGER) % 500 >= 400 OR event_id % 300 >= 250""",
)
def access_noise(t: Tables) -> DataFrame:
    path = F.expr(
        "CASE event_type WHEN 'view' THEN '/api/jobs/7/events' WHEN 'click' THEN '/api/reports' ELSE concat('/api/', event_type) END"
    )
    status = F.expr("CAST(round(value) AS INT) % 500")
    return t.events.filter(logs.is_worth_logging(path, status, F.col("event_id") % 300)).select("event_id")


@query(
    "flt08_empty_row",
    with_sql(
        S.SHEET,
        S.CLEAN,
        body="SELECT row_number, review IS NULL AND lang IS NULL AS skipped FROM clean",
    ),
)
def empty_row(t: Tables) -> DataFrame:
    skipped = R.skips_model(F.col("review_text"), F.col("input_json"))
    return S.packed(t).select("row_number", skipped.alias("skipped"))
