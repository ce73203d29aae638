"""Registered queries: answer checks, annotation, caches, table changes."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowscribe import constants as K
from rowscribe.functions.template import compile_template, spark_type
from rowscribe.functions.validation import accepted_answer, answer_error, extra_keys_warning
from rowscribe.operators import cache, maintenance
from rowscribe.operators.annotate import embed
from rowscribe.operators.reports import report_summary
from rowscribe.plans import rules
from rowscribe.plans import stand_ins as S
from rowscribe.plans.annotate_report import Job, annotate_report, distinct_requests, with_keys
from rowscribe.plans.catalog_columns import SQUASH
from rowscribe.plans.catalog_relational import CACHE, PRESETS, exact_cache, presets
from rowscribe.plans.registry import Tables, query
from rowscribe.session import scratch_path

with_sql = S.with_sql
SCHEMA = compile_template(S.TEMPLATE)


@query(
    "val01_typed_answer",
    with_sql(
        S.RAW_ANSWERS,
        S.CHECKED,
        body="""SELECT doc_id, json_extract_string(j, '$.category') AS category, CAST(json_extract_string(j, '$.score') AS DOUBLE) AS score,
          CASE WHEN json_type(j, '$.count') = 'BOOLEAN' THEN NULL ELSE CAST(json_extract_string(j, '$.count') AS BIGINT) END AS count,
          CAST(json_extract_string(j, '$.urgent') AS BOOLEAN) AS urgent, CAST(json_extract_string(j, '$.meta.quality') AS BIGINT) AS quality
        FROM checked WHERE error IS NULL""",
    ),
)
def typed_answer(t: Tables) -> DataFrame:
    good = S.raw_answers(t).filter(answer_error(F.col("answer"), SCHEMA, S.TEMPLATE).isNull())
    parsed = F.from_json("answer", spark_type(SCHEMA)).alias("a")
    return good.select("doc_id", parsed).select(
        "doc_id", "a.category", "a.score", "a.count", "a.urgent", F.col("a.meta.quality").alias("quality")
    )


@query(
    "val02_answer_check",
    with_sql(
        S.RAW_ANSWERS,
        S.CHECKED,
        body="""SELECT doc_id, error, CASE WHEN k > 2 AND doc_id % 5 = 0 THEN 'dropped_extra_keys:lang,extra' WHEN k = 2 THEN 'dropped_extra_keys:source' END AS warning,
          CASE WHEN error IS NULL THEN replace(answer, ',"lang":"x","extra":[1,{"a":0.5}]', '') END AS accepted FROM checked""",
    ),
)
def answer_check(t: Tables) -> DataFrame:
    text = F.col("answer")
    checked = S.raw_answers(t).withColumn("error", answer_error(text, SCHEMA, S.TEMPLATE))
    return checked.select(
        "doc_id",
        "error",
        extra_keys_warning(text, S.TEMPLATE).alias("warning"),
        F.when(F.col("error").isNull(), accepted_answer(text, S.TEMPLATE)).alias("accepted"),
    )


LOOSE = {
    "type": "object",
    "required": ["score"],
    "properties": {
        "score": {"type": "number", "maximum": 0.5},
        "count": {"type": "integer", "enum": [0, 1, 2, 3, 4]},
        "topics": {"type": "array", "min_items": 1, "items": {"type": "string", "max_length": 2}},
        "day": {"type": "string", "format": "date-time"},
    },
}


@query(
    "val03_field_check",
    with_sql(
        S.RAW_ANSWERS,
        "p AS (SELECT *, TRY_CAST(answer AS JSON) AS j FROM raw_answers)",
        body="""SELECT doc_id, CASE
            WHEN j IS NULL OR json_type(j) <> 'OBJECT' THEN 'Ожидался JSON-объект в ответе модели'
            WHEN k = 2 THEN 'В ответе отсутствует обязательное поле: score'
            WHEN k = 6 THEN 'Поле ''score'' должно быть числом'
            WHEN k = 5 OR doc_id % 9 + 1 > 5 THEN 'Поле ''score'' должно быть <= 0.5'
            WHEN k = 8 OR (k NOT IN (7, 9) AND doc_id % 7 > 4) THEN 'Поле ''count'' должно быть одним из: 0|1|2|3|4'
            WHEN k = 13 THEN 'Поле ''day'' должно быть датой-временем в ISO-формате' END AS error
          FROM p""",
    ),
)
def field_check(t: Tables) -> DataFrame:
    return S.raw_answers(t).select("doc_id", answer_error(F.col("answer"), LOOSE).alias("error"))


@query(
    "val04_sentiment_check",
    """SELECT doc_id, CASE WHEN doc_id % 6 = 1 THEN 'В ответе отсутствует обязательное поле: summary'
        WHEN doc_id % 6 = 2 THEN 'Поле ''category'' должно содержать не менее 1 символов'
        WHEN lang = 'es' THEN 'Поле ''sentiment_label'' должно быть одним из: negative|neutral|positive'
        WHEN doc_id % 6 = 3 THEN 'Поле ''negativity_score'' должно быть >= 0'
        WHEN doc_id % 6 = 4 AND length(text) > 240 THEN 'Поле ''summary'' должно содержать не более 240 символов' END AS error FROM documents""",
)
def sentiment_check(t: Tables) -> DataFrame:
    answer = F.to_json(
        F.struct(
            F.when(F.col("doc_id") % 6 == 2, F.lit("")).otherwise(F.col("source")).alias("category"),
            F.expr(
                "CASE lang WHEN 'en' THEN 'neutral' WHEN 'de' THEN 'negative' WHEN 'fr' THEN 'positive' ELSE 'angry' END"
            ).alias("sentiment_label"),
            F.when(F.col("doc_id") % 6 == 3, F.lit(-0.5)).otherwise(F.lit(0.5)).alias("negativity_score"),
            F.when(F.col("doc_id") % 6 == 1, F.lit(None))
            .when(F.col("doc_id") % 6 == 4, F.col("text"))
            .otherwise(F.lit("short"))
            .alias("summary"),
        )
    )
    error = answer_error(answer, compile_template(K.SENTIMENT_TEMPLATE), K.SENTIMENT_TEMPLATE)
    return t.documents.select("doc_id", error.alias("error"))


@query(
    "val05_cache_recheck",
    with_sql(
        S.RAW_ANSWERS,
        S.CHECKED,
        body="""SELECT doc_id, error IS NOT NULL AS invalid_hit,
          CASE WHEN error IS NULL THEN 'cache_hit' ELSE 'cache_invalidated:' || substr(error, 1, 80) END AS cache_note FROM checked""",
    ),
)
def cache_recheck(t: Tables) -> DataFrame:
    stored = S.raw_answers(t).select(
        "doc_id", F.col("answer").alias("cached_answer"), F.lit(None).cast("string").alias("cached_raw")
    )
    return cache.check_hits(stored, SCHEMA, S.TEMPLATE).select("doc_id", "invalid_hit", "cache_note")


# --- annotation ------------------------------------------------------------------------------------

JOB = Job(rules.PROMPT, rules.TEMPLATE)
ROW_COLUMNS = ["row_number", "status", "custom_json", "error_text", "prompt_tokens", "total_tokens"]

SIZED = "sized AS (SELECT c.row_number, c.lang, p.review_text, p.warnings, length(coalesce(c.review, '')) AS n, c.review IS NULL AND c.lang IS NULL AS blank FROM clean c JOIN packed p USING (row_number))"

ROW_RESULT = """SELECT row_number, CASE WHEN NOT blank AND error_text IS NOT NULL THEN 'error' ELSE 'done' END AS status,
      CASE WHEN NOT blank THEN custom_json END AS custom_json, CASE WHEN NOT blank THEN error_text END AS error_text,
      CASE WHEN blank THEN 0 ELSE prompt_tokens END AS prompt_tokens, CASE WHEN blank THEN 0 ELSE total_tokens END AS total_tokens,
      concat_ws(',', NULLIF(warnings, ''), CASE WHEN blank THEN 'skipped_empty' ELSE notes END) AS warnings FROM annotated"""


def _row_result(rows: DataFrame) -> DataFrame:
    return rows.select(*ROW_COLUMNS, F.array_join("warnings", ",").alias("warnings"))


@query("ann01_row_annotation", with_sql(S.SHEET, S.CLEAN, S.PACKED, SIZED, rules.SQL, body=ROW_RESULT))
def row_annotation(t: Tables) -> DataFrame:
    return _row_result(annotate_report(S.packed(t), JOB, rules.annotator).rows)


@query(
    "ann01_annotation_summary",
    with_sql(
        S.SHEET,
        S.CLEAN,
        S.PACKED,
        SIZED,
        rules.SQL,
        body="""SELECT count(*) AS total_rows, count(*) FILTER (WHERE NOT blank AND error_text IS NULL) AS success_rows,
          count(*) FILTER (WHERE NOT blank AND error_text IS NOT NULL) AS failed_rows FROM annotated""",
    ),
)
def annotation_summary(t: Tables) -> DataFrame:
    return report_summary(annotate_report(S.packed(t), JOB, rules.annotator).rows)


@query(
    "ann01_with_exact_cache",
    with_sql(
        S.SHEET,
        S.CLEAN,
        S.PACKED,
        SIZED,
        rules.SQL,
        """cached AS (SELECT *, n > 400 AND n % 2 = 1 AS good, n > 400 AND n % 2 = 0 AS broken FROM annotated)""",
        body="""SELECT row_number, CASE WHEN NOT blank AND NOT good AND error_text IS NOT NULL THEN 'error' ELSE 'done' END AS status,
          CASE WHEN good THEN '{"category":"none","score":0.5,"chars":1}' WHEN NOT blank THEN custom_json END AS custom_json,
          CASE WHEN NOT blank AND NOT good THEN error_text END AS error_text,
          CASE WHEN blank THEN 0 WHEN good THEN 3 ELSE prompt_tokens END AS prompt_tokens,
          CASE WHEN blank THEN 0 WHEN good THEN 0 ELSE total_tokens END AS total_tokens,
          concat_ws(',', NULLIF(warnings, ''), CASE WHEN blank THEN 'skipped_empty' WHEN good THEN 'cache_hit' ELSE
             NULLIF(concat_ws(',', CASE WHEN broken THEN 'cache_invalidated:В ответе отсутствует обязательное поле: score' END, notes), '') END) AS warnings
        FROM cached""",
    ),
)
def with_exact_cache(t: Tables) -> DataFrame:
    rows = S.packed(t)
    size = F.length(F.coalesce(F.try_variant_get(F.parse_json("input_json"), "$.review", "string"), F.lit("")))
    stored = (
        distinct_requests(with_keys(rows, JOB))
        .withColumn("n", size)
        .filter("n > 400")
        .select(
            "cache_key",
            F.expr(
                """CASE WHEN n % 2 = 1 THEN '{"category":"none","score":0.5,"chars":1}' ELSE '{"category":"none"}' END"""
            ).alias("analysis_json"),
            F.lit('{"usage":{"prompt_tokens":3}}').alias("raw_json"),
        )
    )
    return _row_result(annotate_report(rows, JOB, rules.annotator, cache=stored).rows)


@query(
    "ann01_with_semantic_cache",
    with_sql(
        S.SHEET,
        S.CLEAN,
        S.PACKED,
        SIZED,
        rules.SQL,
        "entries AS (SELECT lang, max(n_chars) AS chars FROM documents WHERE lang IN ('en', 'de') GROUP BY lang)",
        body="""SELECT row_number, CASE WHEN NOT blank AND chars IS NULL AND error_text IS NOT NULL THEN 'error' ELSE 'done' END AS status,
          CASE WHEN chars IS NOT NULL THEN '{"category":"' || a.lang || '","score":0.5,"chars":' || chars || '}' WHEN NOT blank THEN custom_json END AS custom_json,
          CASE WHEN NOT blank AND chars IS NULL THEN error_text END AS error_text,
          CASE WHEN blank OR chars IS NOT NULL THEN 0 ELSE prompt_tokens END AS prompt_tokens,
          CASE WHEN blank OR chars IS NOT NULL THEN 0 ELSE total_tokens END AS total_tokens,
          concat_ws(',', NULLIF(warnings, ''), CASE WHEN blank THEN 'skipped_empty' WHEN chars IS NOT NULL THEN 'semantic_cache_hit:1.0' ELSE notes END) AS warnings
        FROM annotated a LEFT JOIN entries e ON e.lang = a.lang""",
    ),
)
def with_semantic_cache(t: Tables) -> DataFrame:
    # One entry per language; the French answer no longer passes, Spanish has none.
    entries = (
        t.documents.filter("lang <> 'es'")
        .groupBy("lang")
        .agg(F.max("n_chars").alias("chars"), F.max("doc_id").alias("updated_at"))
        .withColumns(
            {
                "semantic_key": F.col("lang"),
                "provider": F.lit(JOB.provider),
                "model": F.lit(JOB.model),
                "analysis_mode": F.lit(JOB.mode),
                "embedding": F.expr(
                    "transform(array('en', 'de', 'fr'), l -> IF(l = lang, 1.0D, 0.0D))"
                ),
                "analysis_json": F.expr(
                    """CASE lang WHEN 'fr' THEN '{"category":"fr"}' ELSE concat('{"category":"', lang, '","score":0.5,"chars":', chars, '}') END"""
                ),
                "raw_json": F.lit("{}"),
                "input_json": F.lit("{}"),
                "review_text": F.lit(""),
            }
        )
    )
    stored = with_keys(entries, JOB)
    done = annotate_report(
        S.packed(t), JOB, rules.annotator, semantic=stored, embedder=rules.language_embedder
    )
    return _row_result(done.rows)


GROUP_RESULT = with_sql(
    S.GROUPED,
    """sized AS (SELECT group_key, count(*) AS n, min(row_number) AS first_row, NULL AS lang,
         string_agg('[row ' || row_number || '] ' || text, chr(10) ORDER BY row_number) AS review_text FROM grouped GROUP BY group_key)""",
    rules.SQL,
    body="""SELECT g.row_number, g.group_key,
      CASE WHEN n > 7 OR error_text IS NOT NULL THEN 'error' ELSE 'done' END AS status,
      CASE WHEN n <= 7 THEN custom_json END AS custom_json,
      CASE WHEN n > 7 THEN 'Пропущено: группа слишком большая (' || n || ' строк > лимита 7).' ELSE error_text END AS error_text,
      CASE WHEN n <= 7 AND g.row_number = first_row THEN total_tokens ELSE 0 END AS total_tokens,
      concat_ws(',', CASE WHEN turn = 1 THEN 'empty_cell' END,
        CASE WHEN n > 7 THEN 'skipped_large_group:' || n || '>7' ELSE concat_ws(',', 'grouped_by:conv,group_size:' || n, notes) END) AS warnings
    FROM grouped g JOIN annotated USING (group_key)""",
)


def group_result(found: DataFrame) -> DataFrame:
    return found.select(
        "row_number",
        "group_key",
        "status",
        "custom_json",
        "error_text",
        "total_tokens",
        F.array_join("warnings", ",").alias("warnings"),
    )


@query("ann02_group_annotation", GROUP_RESULT)
def group_annotation(t: Tables) -> DataFrame:
    job = Job(rules.PROMPT, rules.TEMPLATE, group_by="conv", group_max_rows=7)
    return group_result(annotate_report(S.grouped_rows(t), job, rules.annotator).rows)


@query(
    "ann03_bounded_calls",
    with_sql(
        S.SHEET,
        S.CLEAN,
        S.PACKED,
        body=f"SELECT count(DISTINCT {SQUASH.format('input_json')}) AS calls, true AS within_limit FROM packed",
    ),
)
def bounded_calls(t: Tables) -> DataFrame:
    """Every distinct input is asked once, and never more than four calls are open."""
    from rowscribe.operators.annotate import annotate

    def timed(prompt: str):
        begun = time.time_ns()
        answer, _ = rules.annotator(prompt)
        return answer, json.dumps({"usage": {"prompt_tokens": 0}, "begun": begun, "ended": time.time_ns()})

    job = Job(rules.PROMPT, rules.TEMPLATE, parallelism=4)
    requests = distinct_requests(with_keys(S.packed(t), job)).withColumn("prompt", F.concat(F.lit("a\nROW="), "input_json"))
    answers = annotate(requests, timed, template=None, schema=None, retries=0, parallelism=4)
    at = lambda name: F.try_variant_get(F.try_parse_json("raw_response_json"), f"$.{name}", "bigint")
    # Of two calls that touch, the end comes first.
    marks = answers.select(F.explode(F.array(F.struct(at("begun").alias("at"), F.lit(1).alias("step")), F.struct(at("ended").alias("at"), F.lit(-1).alias("step")))).alias("m"))
    begun = marks.groupBy("m.at").agg(F.sum("m.step").alias("step"))
    second = F.expr("at div 1000000000").alias("second")
    # Few rows, one per second of the run, tell what is open when a second begins.
    per_second = begun.groupBy(second).agg(F.sum("step").alias("step"))
    before = F.sum("step").over(W.orderBy("second").rowsBetween(W.unboundedPreceding, -1))
    carried = per_second.select("second", F.coalesce(before, F.lit(0)).alias("carried"))
    inside = F.sum("step").over(W.partitionBy("second").orderBy("at"))
    opened = begun.withColumn("second", second).withColumn("opened", inside).join(carried, "second")
    seen = opened.select(F.lit(0).alias("n"), (F.col("opened") + F.col("carried")).alias("open"))
    both = answers.select(F.lit(1).alias("n"), F.lit(0).cast("bigint").alias("open")).unionByName(seen)
    return both.agg(F.sum("n").cast("bigint").alias("calls"), (F.max("open") <= 4).alias("within_limit"))


@query(
    "ann04_resume",
    with_sql(
        S.SHEET,
        S.CLEAN,
        S.PACKED,
        SIZED,
        rules.SQL,
        f"result AS ({ROW_RESULT})",
        body="SELECT * FROM result WHERE row_number % 3 <> 0",
    ),
)
def resume(t: Tables) -> DataFrame:
    rows = S.packed(t)
    status = F.when(F.col("row_number") % 3 == 0, F.lit("done")).otherwise(F.lit("pending"))
    stopped = rows.withColumn("status", status).withColumn("error_text", F.lit(None).cast("string"))
    return _row_result(annotate_report(stopped, JOB, rules.annotator).rows)


@query("ann04_interrupted", with_sql(S.SHEET, S.CLEAN, S.PACKED, SIZED, rules.SQL, body=ROW_RESULT))
def interrupted(t: Tables) -> DataFrame:
    """A journal that already has the answers of every third input; the rest is asked, the result is that of one run."""
    journal = scratch_path(t.spark, "journal")
    job = Job(rules.PROMPT, rules.TEMPLATE, journal=journal)
    rows = S.packed(t)
    annotate_report(rows.filter("row_number % 3 = 0"), job, rules.annotator).rows.count()
    return _row_result(annotate_report(rows, job, rules.annotator).rows)


@query(
    "ann05_embedding",
    f"""WITH s AS (SELECT doc_id, {SQUASH.format('text')} AS x FROM documents)
    SELECT doc_id, length(x)::DOUBLE AS size, length(regexp_replace(x, '[^aeiou]', '', 'g'))::DOUBLE AS vowels,
      length(regexp_replace(x, '[^ ]', '', 'g'))::DOUBLE AS blanks FROM s""",
)
def embedding(t: Tables) -> DataFrame:
    found = embed(t.documents.select("doc_id", "text"), "text", rules.embedder)
    part = lambda i, name: F.col("embedding")[i].alias(name)
    return found.select("doc_id", part(0, "size"), part(1, "vowels"), part(2, "blanks"))


# --- table changes ------------------------------------------------------------------------------------

STORED = """stored AS (
  SELECT sha256(text) AS cache_key, min(doc_id) AS created_at, max(doc_id) AS updated_at, count(*) AS hits, max(lang) AS analysis_json
  FROM documents WHERE lang <> 'de' GROUP BY text)"""


def stored_cache(t: Tables) -> DataFrame:
    known = t.documents.filter("lang <> 'de'").groupBy(F.sha2("text", 256).alias("cache_key"))
    return known.agg(
        F.min("doc_id").alias("created_at"),
        F.max("doc_id").alias("updated_at"),
        F.count(F.lit(1)).alias("hits"),
        F.max("lang").alias("analysis_json"),
    )


@query(
    "upd01_cache_upsert",
    with_sql(
        STORED,
        "fresh AS (SELECT sha256(text) AS cache_key, max(doc_id) + 1000000 AS updated_at, arg_max(source, doc_id) AS analysis_json FROM documents WHERE lang <> 'fr' GROUP BY text)",
        body="""SELECT coalesce(s.cache_key, f.cache_key) AS cache_key, CASE WHEN s.cache_key IS NULL THEN f.updated_at ELSE s.created_at END AS created_at,
          coalesce(f.updated_at, s.updated_at) AS updated_at, coalesce(s.hits, 0) AS hits, coalesce(f.analysis_json, s.analysis_json) AS analysis_json
        FROM stored s FULL JOIN fresh f ON f.cache_key = s.cache_key""",
    ),
)
def cache_upsert(t: Tables) -> DataFrame:
    fresh = t.documents.filter("lang <> 'fr'").select(
        F.sha2("text", 256).alias("cache_key"),
        (F.col("doc_id") + 1000000).alias("updated_at"),
        F.col("source").alias("analysis_json"),
    )
    keep = {"created_at": F.col("_new.updated_at"), "hits": F.lit(0).cast("bigint")}
    return cache.upsert(stored_cache(t), fresh, ["cache_key"], keep, ["updated_at"])


@query(
    "upd02_semantic_upsert",
    """WITH e AS (SELECT vec_id, CAST(label AS VARCHAR) AS label, list_transform(embedding, lambda x: round(x::DOUBLE * 2)) AS v FROM embeddings),
      k AS (SELECT sha256('rules' || chr(10) || label || chr(10) || '[' || array_to_string(list_transform(v, lambda x: CAST(CASE WHEN x = 0 THEN 0.0 ELSE x END AS VARCHAR)), ', ') || ']') AS semantic_key, vec_id FROM e)
    SELECT semantic_key, min(vec_id) AS created_at, max(vec_id) AS updated_at, max(vec_id) AS analysis_json FROM k GROUP BY semantic_key""",
)
def semantic_upsert(t: Tables) -> DataFrame:
    entries = t.embeddings.select(
        "vec_id",
        F.lit("rules").alias("provider"),
        F.col("label").cast("string").alias("model"),
        # Adding 0.0 turns a negative zero into a plain one.
        F.transform(
            "embedding", lambda x: F.round(x.cast("double") * 2) + F.lit(0.0)
        ).alias("embedding"),
    )
    keyed = entries.select(
        cache.semantic_key(["provider", "model"], F.col("embedding")).alias("semantic_key"),
        F.col("vec_id").alias("updated_at"),
        F.col("vec_id").alias("analysis_json"),
    )
    first = keyed.groupBy("semantic_key").agg(
        F.min("updated_at").alias("created_at"), F.min("updated_at").alias("updated_at"), F.min("analysis_json").alias("analysis_json")
    )
    keep = {"created_at": F.col("_new.updated_at")}
    return cache.upsert(first, keyed, ["semantic_key"], keep, ["updated_at"])


@query(
    "upd03_hit_touch",
    with_sql(
        STORED,
        "uses AS (SELECT sha256(text) AS cache_key, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY text)",
        body="""SELECT s.cache_key, s.hits + coalesce(u.n, 0) AS hits, CASE WHEN u.n IS NULL THEN s.updated_at ELSE 9000000 END AS updated_at
          FROM stored s LEFT JOIN uses u USING (cache_key)""",
    ),
)
def hit_touch(t: Tables) -> DataFrame:
    used = t.documents.filter("lang = 'en'").select(F.sha2("text", 256).alias("cache_key"))
    touched = cache.touch(stored_cache(t), used, "cache_key", F.lit(9000000).cast("bigint"))
    return touched.select("cache_key", "hits", "updated_at")


@query(
    "upd04_cache_limit",
    with_sql(
        STORED,
        body="SELECT cache_key, updated_at FROM stored QUALIFY row_number() OVER (ORDER BY updated_at DESC, cache_key DESC) <= 500",
    ),
)
def cache_limit(t: Tables) -> DataFrame:
    return cache.evict_oldest(stored_cache(t), 500, "cache_key").select("cache_key", "updated_at")


RETRY = "status = 'error' OR (status = 'done' AND len(warnings) = 2 AND warnings[2] LIKE '%skipped_large_group%')"


@query(
    "upd05_retry_reset",
    with_sql(
        S.REPORT_ROWS,
        f"r AS (SELECT *, {RETRY} AS was_reset FROM report_rows)",
        body="""SELECT report_id, row_number, was_reset, CASE WHEN was_reset THEN 'pending' ELSE status END AS status,
          CASE WHEN NOT was_reset THEN custom_json END AS custom_json, CASE WHEN NOT was_reset THEN error_text END AS error_text,
          CASE WHEN NOT was_reset THEN array_to_string(warnings, ',') END AS warnings,
          CASE WHEN was_reset THEN 0 ELSE total_tokens END AS total_tokens FROM r""",
    ),
)
def retry_reset(t: Tables) -> DataFrame:
    rows = S.report_rows(t).withColumn("raw_response_json", F.lit(None).cast("string"))
    found = maintenance.reset_failed_rows(rows)
    return found.select(
        "report_id",
        "row_number",
        "was_reset",
        "status",
        "custom_json",
        "error_text",
        F.array_join("warnings", ",").alias("warnings"),
        "total_tokens",
    )


@query(
    "upd06_patch",
    with_sql(
        S.REPORTS,
        """patch AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'completed' WHEN 2 THEN 'canceled' END AS status,
             CASE WHEN c_custkey % 5 = 0 THEN c_name END AS error_text, CASE WHEN c_custkey % 8 = 0 THEN 'own step' END AS current_step FROM customer)""",
        body="""SELECT r.id, coalesce(p.status, r.status) AS status, coalesce(p.error_text, r.error_text) AS error_text,
          coalesce(p.current_step, CASE p.status WHEN 'failed' THEN 'Ошибка' WHEN 'completed' THEN 'Завершено' WHEN 'canceled' THEN 'Отменено' END, r.current_step) AS current_step
        FROM reports r LEFT JOIN patch p ON p.id = r.id""",
    ),
)
def patch(t: Tables) -> DataFrame:
    changes = t.customer.selectExpr(
        "c_custkey AS id",
        "CASE c_custkey % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'completed' WHEN 2 THEN 'canceled' END AS status",
        "CASE WHEN c_custkey % 5 = 0 THEN c_name END AS error_text",
        "CASE WHEN c_custkey % 8 = 0 THEN 'own step' END AS current_step",
    )
    patched = maintenance.apply_patch(S.reports(t), changes, ["id"])
    return patched.select("id", "status", "error_text", "current_step")


@query(
    "upd07_row_tokens",
    with_sql(
        S.REPORTS,
        S.REPORT_ROWS,
        body="""SELECT r.id, coalesce(sum(w.prompt_tokens), 0)::BIGINT AS prompt_tokens, coalesce(sum(w.completion_tokens), 0)::BIGINT AS completion_tokens,
          coalesce(sum(w.total_tokens), 0)::BIGINT AS total_tokens FROM reports r LEFT JOIN report_rows w ON w.report_id = r.id GROUP BY r.id""",
    ),
)
def row_tokens(t: Tables) -> DataFrame:
    found = maintenance.with_row_tokens(S.reports(t), S.report_rows(t))
    return found.select("id", "prompt_tokens", "completion_tokens", "total_tokens")


@query(
    "upd08_preset_upsert",
    with_sql(
        PRESETS,
        """fresh AS (SELECT s_suppkey + 900000 AS new_id, s_suppkey % 3 AS user_id, p_name || ' ' || p_partkey AS name, s_name AS prompt_template,
             TIMESTAMP '2025-01-01' AS updated_at FROM supplier JOIN part ON p_partkey = s_suppkey * 2)""",
        body="""SELECT coalesce(p.id, f.new_id) AS id, coalesce(p.user_id, f.user_id) AS user_id, coalesce(p.name, f.name) AS name,
          coalesce(f.prompt_template, p.prompt_template) AS prompt_template,
          CASE WHEN p.id IS NULL THEN f.updated_at ELSE p.updated_at END AS created_at, coalesce(f.updated_at, p.updated_at) AS updated_at
        FROM presets p FULL JOIN fresh f ON f.user_id = p.user_id AND f.name = p.name""",
    ),
)
def preset_upsert(t: Tables) -> DataFrame:
    stored = presets(t).withColumn("created_at", F.col("updated_at")).withColumn("new_id", F.lit(None).cast("bigint"))
    fresh = t.supplier.join(t.part, F.col("p_partkey") == F.col("s_suppkey") * 2).selectExpr(
        "s_suppkey + 900000 AS new_id",
        "s_suppkey % 3 AS user_id",
        "concat('  ', p_name, ' ', p_partkey, ' ') AS name",
        "s_name AS prompt_template",
        "TIMESTAMP_NTZ '2025-01-01 00:00:00' AS updated_at",
    )
    return maintenance.upsert_presets(stored, fresh).drop("new_id")


@query(
    "upd09_cascade_delete",
    with_sql(
        S.REPORTS,
        S.REPORT_ROWS,
        S.UPLOADS,
        "gone AS (SELECT id, user_id FROM reports WHERE status = 'failed')",
        "left_reports AS (SELECT * FROM reports WHERE status <> 'failed')",
        body="""SELECT 'reports' AS kind, id AS key, 1 AS n FROM left_reports
          UNION ALL SELECT 'rows', report_id, count(*) FROM report_rows WHERE report_id NOT IN (SELECT id FROM gone) GROUP BY report_id
          UNION ALL SELECT 'uploads', id, 1 FROM uploads u WHERE NOT (user_id IN (SELECT user_id FROM gone)
            AND NOT EXISTS (SELECT 1 FROM left_reports r WHERE r.user_id = u.user_id AND r.uploaded_file_id = u.id))""",
    ),
)
def cascade_delete(t: Tables) -> DataFrame:
    reports = S.reports(t)
    gone = reports.filter("status = 'failed'").select("id")
    left, rows, uploads = maintenance.delete_reports(reports, S.report_rows(t), S.uploads(t), gone)
    one = F.lit(1).cast("bigint").alias("n")
    kept = left.select(F.lit("reports").alias("kind"), F.col("id").alias("key"), one)
    counted = rows.groupBy(F.col("report_id").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    files = uploads.select(F.lit("uploads").alias("kind"), F.col("id").alias("key"), one)
    return kept.unionByName(counted.withColumn("kind", F.lit("rows"))).unionByName(files)


@query(
    "upd10_terminal_reset",
    with_sql(
        S.REPORTS,
        body="""SELECT id, CASE WHEN status <> 'failed' THEN finished_at END AS finished_at, CASE WHEN status <> 'failed' THEN error_text END AS error_text,
          CASE WHEN status = 'failed' THEN TIMESTAMP '2024-01-04 00:00:00' ELSE updated_at END AS updated_at FROM reports""",
    ),
)
def terminal_reset(t: Tables) -> DataFrame:
    reports = S.reports(t)
    now = F.expr("TIMESTAMP_NTZ '2024-01-04 00:00:00'")
    found = maintenance.reset_terminal_state(reports, reports.filter("status = 'failed'"), now)
    return found.select("id", "finished_at", "error_text", "updated_at")


@query("upd11_record_insert", with_sql(S.REPORTS, body="SELECT id, user_id, status, created_at FROM reports"))
def record_insert(t: Tables) -> DataFrame:
    records = S.reports(t).select("id", "user_id", "status", "created_at")
    path = scratch_path(t.spark, "reports")
    records.filter("status = 'queued'").write.mode("append").parquet(path)
    records.filter("status <> 'queued'").write.mode("append").parquet(path)
    return t.spark.read.parquet(path)


@query(
    "upd12_delete_keys",
    with_sql(STORED, body="SELECT cache_key, hits FROM stored WHERE cache_key NOT IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id))"),
)
def delete_keys(t: Tables) -> DataFrame:
    gone = t.documents.join(t.labels, "doc_id").select(F.sha2("text", 256).alias("cache_key"))
    return cache.delete_keys(stored_cache(t), gone, ["cache_key"]).select("cache_key", "hits")


@query(
    "upd13_progress_overwrite",
    with_sql(
        S.REPORTS,
        "last AS (SELECT user_id AS id, max(event_id) AS e FROM events GROUP BY user_id)",
        body="""SELECT r.id, coalesce(e // 10, processed_rows) AS processed_rows, CASE WHEN e IS NULL THEN current_step WHEN e % 3 = 0 THEN NULL ELSE 'at ' || e END AS current_step
          FROM reports r LEFT JOIN last l ON l.id = r.id""",
    ),
)
def progress_overwrite(t: Tables) -> DataFrame:
    updates = t.events.selectExpr(
        "user_id AS id",
        "event_id AS seq",
        "event_id div 10 AS processed_rows",
        "CASE WHEN event_id % 3 > 0 THEN concat('at ', event_id) END AS current_step",
    )
    found = maintenance.latest_progress(S.reports(t), updates)
    return found.select("id", "processed_rows", "current_step")
