"""The annotation of a report from pending rows to finished rows.

Rows -> (groups) -> cache key per input -> one request per distinct key ->
exact cache -> similarity cache -> model -> answers back to all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowscribe import constants as K
from rowscribe.functions import jsonx, prompts
from rowscribe.functions.template import compile_template
from rowscribe.functions.validation import accepted_answer, answer_error
from rowscribe.operators import cache as caches
from rowscribe.operators import groups
from rowscribe.operators.annotate import Annotator, Embedder, annotate, embed
from rowscribe.operators.rows import skips_model
from rowscribe.session import cut

ANSWER = [
    "custom_json",
    "raw_response_json",
    "error_text",
    "answer_warnings",
    "prompt_tokens",
    "completion_tokens",
    "total_tokens",
]
KEY_PARTS = ["prompt_hash", "review_hash", "expected_template_hash", "output_schema_hash"]


@dataclass
class Job:
    """What to ask: prompt, answer template and where the answer comes from."""

    prompt: str
    template: dict | None
    provider: str = "rules"
    model: str = "rules-1"
    mode: str = "custom"
    group_by: str | None = None
    group_max_rows: int | None = None
    retries: int = K.RETRIES
    parallelism: int = K.PARALLEL_CALLS
    use_cache: bool = True
    #: Folder of the answers already given; name one to go on after an interruption.
    journal: str | None = None

    @property
    def schema(self) -> dict | None:
        return compile_template(self.template) if self.template else None


@dataclass
class Annotated:
    """Finished rows, new entries for both caches and cache keys to delete."""

    rows: DataFrame
    fresh: DataFrame
    fresh_semantic: DataFrame | None
    invalid: DataFrame | None


def with_keys(units: DataFrame, job: Job) -> DataFrame:
    normalized = prompts.normalized_input(F.col("input_json"), F.col("review_text"))
    keys = prompts.cache_keys(
        normalized,
        provider=job.provider,
        model=job.model,
        mode=job.mode,
        prompt_template=job.prompt,
        template=job.template,
        schema=job.schema,
        review_hash=F.col("review_hash"),
    )
    # The hash of the row is a step of its own: both it and the key need it.
    return units.withColumn("review_hash", F.sha2(normalized, 256)).withColumns(keys)


def distinct_requests(units: DataFrame) -> DataFrame:
    """One request per cache key, worded like its first row, with the tokens its review has at a guess.

    The first row is a minimum taken inside each task, so a text that fills a
    third of the sheet is shuffled once per task.
    """
    guessed = jsonx.fallback_prompt_tokens(F.col("review_text")).alias("guessed_tokens")
    needed = [guessed, "input_json", *KEY_PARTS]
    first = units.groupBy("cache_key").agg(
        F.min_by(F.struct(*needed), "row_number").alias("_first"), F.count(F.lit(1)).alias("key_rows")
    )
    # A key whose rows have no numbers has no first row either.
    unknown = jsonx.fallback_prompt_tokens(F.lit(""))
    return first.select("cache_key", "key_rows", "_first.*").withColumn("guessed_tokens", F.coalesce("guessed_tokens", unknown))


_CACHED = ["cached_answer", "cached_raw", "cache_notes"]


def _reused(found: DataFrame) -> DataFrame:
    usage = lambda field: jsonx.usage(F.col("cached_raw"), field)
    return found.select(
        "cache_key",
        F.col("cached_answer").alias("custom_json"),
        F.col("cached_raw").alias("raw_response_json"),
        F.lit(None).cast("string").alias("error_text"),
        F.col("cache_notes").alias("answer_warnings"),
        usage("prompt_tokens").alias("prompt_tokens"),
        usage("completion_tokens").alias("completion_tokens"),
        usage("total_tokens").alias("total_tokens"),
    )


def _similar(misses: DataFrame, job: Job, semantic: DataFrame, embedder: Embedder) -> DataFrame:
    """Misses, without their texts, with a checked similar answer where there is one."""
    asked = embed(
        misses.withColumns(
            {"provider": F.lit(job.provider), "model": F.lit(job.model), "analysis_mode": F.lit(job.mode)}
        ),
        "input_json",
        embedder,
        job.parallelism,
    ).drop("input_json")
    # Vectors come from a model: make them once.
    found = cut(caches.semantic_lookup(cut(asked), semantic), "similar")
    answers = semantic.select(
        "semantic_key", F.col("analysis_json").alias("_answer"), F.col("raw_json").alias("_raw")
    )
    joined = found.join(answers, "semantic_key", "left")
    good = F.col("_answer").isNotNull() & answer_error(F.col("_answer"), job.schema, job.template).isNull()
    note = F.concat(F.lit("semantic_cache_hit:"), F.col("similarity").cast("string"))
    return (
        joined.withColumn("cached_answer", F.when(good, accepted_answer(F.col("_answer"), job.template)))
        .withColumn("cached_raw", F.when(good, F.col("_raw")))
        .withColumn(
            "cache_notes",
            F.concat("cache_notes", F.array_compact(F.array("embedding_note", F.when(good, note)))),
        )
        .select("cache_key", *_CACHED, *caches.SEMANTIC_KEYS[:3], "embedding")
    )


def answer_requests(
    requests: DataFrame,
    job: Job,
    annotator: Annotator,
    cache: DataFrame | None = None,
    semantic: DataFrame | None = None,
    embedder: Embedder | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """Answers per cache key; the fresh ones, what was asked, the broken cache keys."""
    parts, invalid = [], None
    none = F.lit(None).cast("string")
    # Looked up by key alone; the texts of what is left are joined again afterwards.
    waiting = requests.withColumns({"cached_answer": none, "cached_raw": none, "cache_notes": F.array().cast("array<string>")})
    if job.use_cache and cache is not None:
        found = caches.exact_lookup(requests.select("cache_key"), cache)
        checked = caches.check_hits(found, job.schema, job.template)
        checked = cut(checked.withColumn("cache_notes", F.array_compact(F.array("cache_note"))))
        invalid = checked.filter("invalid_hit").select("cache_key")
        parts.append(_reused(checked.filter("cached_answer IS NOT NULL")))
        waiting = requests.join(checked.filter("cached_answer IS NULL").select("cache_key", *_CACHED), "cache_key")
    if job.use_cache and semantic is not None and embedder is not None:
        keys = [k for k in caches.SEMANTIC_KEYS if k in requests.columns]
        checked = cut(_similar(waiting.select("cache_key", "input_json", *keys, *_CACHED), job, semantic, embedder))
        parts.append(_reused(checked.filter("cached_answer IS NOT NULL")))
        waiting = requests.join(checked.filter("cached_answer IS NULL"), "cache_key")
    prompt = prompts.render_prompt(job.prompt, F.col("input_json"), job.mode, job.template)
    fresh = annotate(
        waiting.withColumn("prompt", prompt),
        annotator,
        template=job.template,
        schema=job.schema,
        retries=job.retries,
        parallelism=job.parallelism,
        use_cache=job.use_cache,
        journal=job.journal,
    )
    notes = waiting.select("cache_key", F.col("cache_notes").alias("_notes"))
    asked = fresh.join(notes, "cache_key").withColumn("answer_warnings", F.concat("_notes", "answer_warnings"))
    answers = asked.select("cache_key", *ANSWER)
    for part in parts:
        answers = answers.unionByName(part)
    return answers, fresh, waiting, invalid


def annotate_report(
    rows: DataFrame,
    job: Job,
    annotator: Annotator,
    cache: DataFrame | None = None,
    semantic: DataFrame | None = None,
    embedder: Embedder | None = None,
) -> Annotated:
    """Finish the pending rows of a report (``rows`` as made by ``build_rows``).

    Rows that already are done or failed are not asked again: a stopped job
    goes on by running this over the rows that are still pending.
    """
    blank = {
        "status": F.lit("pending"),
        "error_text": F.lit(None).cast("string"),
    }
    missing = {n: v for n, v in blank.items() if n not in rows.columns}
    pending = rows.withColumns(missing) if missing else rows
    pending = pending.filter(F.col("status") == "pending")
    columns = [*rows.columns, *[c for c in ("status", "error_text") if c not in rows.columns]]

    # Rows that need no answer stay in the same flow, marked and without a key,
    # so that the sheet is read once for the requests and once for the result.
    stats = None
    if job.group_by:
        stats = cut(groups.group_stats(pending, ["group_key"]))
        flow = pending
        if job.group_max_rows is not None:
            flow = groups.mark_oversize(pending, ["group_key"], job.group_max_rows, stats)
        flow = flow.withColumn("_aside", F.col("status") == "error")
        units = groups.assemble(pending, ["group_key"], job.group_by, job.group_max_rows, stats)
        units = cut(with_keys(units.withColumnRenamed("warnings", "unit_warnings"), job), "units")
        requests = cut(distinct_requests(units))
    else:
        empty = skips_model(F.col("review_text"), F.col("input_json"))
        note = F.array_append("warnings", F.lit("skipped_empty"))
        flow = with_keys(pending.withColumn("_aside", F.coalesce(empty, F.lit(False))), job)
        flow = flow.withColumn("warnings", F.when(F.col("_aside"), note).otherwise(F.col("warnings")))
        flow = flow.withColumn("cache_key", F.when(~F.col("_aside"), F.col("cache_key")))
        requests = cut(distinct_requests(flow.filter("cache_key IS NOT NULL")))
    # The distinct inputs are written once; attempts and joins start from them.
    answers, fresh, asked, invalid = answer_requests(
        requests.drop("key_rows"), job, annotator, cache, semantic, embedder
    )
    flow = flow.drop(*KEY_PARTS).withColumnRenamed("error_text", "_row_error")
    none = F.array().cast("array<string>")
    if job.group_by:
        slim = units.select("group_key", "row_number", "cache_key", "unit_warnings")
        per_unit = slim.join(answers, "cache_key", "left")
        per_group = per_unit.select("group_key", "unit_warnings", *ANSWER)
        done = groups.spread_answers(flow, per_group, ["group_key"], stats)
    else:
        done = flow.join(answers, "cache_key", "left")
        done = done.withColumn("unit_warnings", none)
    merged = F.concat("warnings", F.coalesce("unit_warnings", none), F.coalesce("answer_warnings", none))
    failed = F.coalesce("error_text", F.lit("")) != ""
    outcome = F.when(failed, F.lit("error")).otherwise(F.lit("done"))
    skipped = F.when(F.col("status") == "error", F.lit("error")).otherwise(F.lit("done"))
    tokens = ["prompt_tokens", "completion_tokens", "total_tokens"]
    finished = done.withColumns(
        {
            "warnings": F.when(F.col("_aside"), F.col("warnings")).otherwise(merged),
            "error_text": F.when(F.col("_aside"), F.col("_row_error")).otherwise(F.col("error_text")),
            "status": F.when(F.col("_aside"), skipped).otherwise(outcome),
            **{n: F.coalesce(n, F.lit(0)) for n in tokens},
        }
    )
    extra = ["custom_json", "raw_response_json", *tokens]
    result = finished.select(*[c for c in columns if c not in extra], *extra)

    details = requests.select(
        "cache_key", "prompt_hash", "review_hash", F.lit(job.provider).alias("provider"), F.lit(job.model).alias("model")
    )
    new_entries = (
        fresh.filter("custom_json IS NOT NULL")
        .join(details, "cache_key")
        .select(
            "cache_key",
            "provider",
            "model",
            "prompt_hash",
            "review_hash",
            F.col("custom_json").alias("analysis_json"),
            F.col("raw_response_json").alias("raw_json"),
        )
    )
    similar = None
    if "embedding" in asked.columns:
        similar = (
            asked.filter("embedding IS NOT NULL")
            .select("cache_key", *caches.SEMANTIC_KEYS, "embedding")
            .join(new_entries.select("cache_key", "analysis_json", "raw_json"), "cache_key")
            .drop("cache_key")
            .withColumn("semantic_key", caches.semantic_key(caches.SEMANTIC_KEYS, F.col("embedding")))
        )
    return Annotated(result, new_entries, similar, invalid)
