"""The annotation stage: user callables over distinct inputs.

A callable sees one prompt and returns ``(answer_text, raw_json_text)``. Every
distinct cache key is asked once. Checks and retry prompts are column
expressions; only the call itself runs in Python. Answers are appended to a
journal by every task that finishes and read from there before anything is asked,
so neither a lost executor nor a run started again repeats answered calls.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowscribe import constants as K
from rowscribe.functions import jsonx
from rowscribe.functions.prompts import with_feedback
from rowscribe.functions.text import squash
from rowscribe.functions.validation import accepted_answer, answer_error, extra_keys_warning
from rowscribe.operators.calls import TASK_CALLS, call_in_waves, empty_journal
from rowscribe.session import cut, scratch_path

Annotator = Callable[[str], tuple[str, str | None]]
Embedder = Callable[[str], list[float]]


class PromptTooLong(Exception):
    """Raised by an annotator whose model cannot take the prompt; never retried."""

    def __init__(self, model: str, message: str = ""):
        super().__init__(message)
        self.model, self.message = model, message


class EmbedderMissing(Exception):
    """Raised by an embedder that does not exist; no further calls are made."""


REPLY = T.StructType([T.StructField(name, T.StringType()) for name in ("answer", "raw", "failure", "overflow_model", "overflow_message")])
JOURNAL = T.StructType([T.StructField(name, T.StringType()) for name in ("cache_key", "prompt_key", "turn")] + REPLY.fields)
_ASKED = ["cache_key", "prompt_key"]


def _prompt_key(prompt: Column, wrong: Column) -> Column:
    """What was asked, and after how many wrong answers: the same words may be asked again."""
    return F.concat_ws("-", F.sha2(prompt, 256), wrong.cast("string"))


def _asking(annotator: Annotator):
    def ask(prompt: str):
        try:
            answer, raw = annotator(prompt)
            return answer, raw, None, None, None
        except PromptTooLong as stop:
            return None, None, None, stop.model, stop.message
        except Exception as problem:  # a failed call is data: it is retried, then reported
            return None, None, f"{type(problem).__name__}: {problem}", None, None

    return ask


def _replies(waiting: DataFrame, annotator: Annotator, journal: str, resumed: bool, turn: str, parallelism: int, task_calls: int) -> DataFrame:
    """``waiting``, without its texts, with the reply to each prompt; only prompts the journal has no answer to are asked."""
    todo = waiting.select(*_ASKED, F.lit(turn).alias("turn"), "prompt")
    if resumed:
        known = waiting.sparkSession.read.schema(JOURNAL).parquet(journal)
        todo = todo.join(known.filter("failure IS NULL").select(*_ASKED), _ASKED, "left_anti")
    call_in_waves(todo, "cache_key", "prompt", _asking(annotator), REPLY, journal, limit=parallelism, task_calls=task_calls)
    # Failures of earlier turns are no answers; of repeated answers to one prompt any will do.
    found = waiting.sparkSession.read.schema(JOURNAL).parquet(journal).filter((F.col("failure").isNull()) | (F.col("turn") == turn))
    one = found.groupBy(*_ASKED).agg(F.max_by(F.struct(*REPLY.names), F.col("failure").isNull()).alias("reply"))
    slim = waiting.drop("prompt")
    return slim.join(one, _ASKED).select(*slim.columns, "reply.*")


def annotate(
    requests: DataFrame,
    annotator: Annotator,
    *,
    template: dict | None,
    schema: dict | None,
    retries: int = K.RETRIES,
    parallelism: int = K.PARALLEL_CALLS,
    use_cache: bool = True,
    journal: str | None = None,
    task_calls: int = TASK_CALLS,
) -> DataFrame:
    """Answers per cache key.

    ``requests``: ``cache_key`` (unique), ``prompt`` and ``guessed_tokens``, or
    ``review_text`` to guess from. At most ``parallelism`` calls are open at a time, however many requests and executors
    there are. ``journal`` names a folder that outlives a run: a run with the same
    journal asks only what finished tasks have not answered. Without one the answers
    are kept in the scratch folder, for this run alone.
    """
    start = [] if use_cache else [F.lit("cache_disabled")]
    resumed = journal is not None
    journal = journal or scratch_path(requests.sparkSession, "journal")
    empty_journal(requests.sparkSession, journal, JOURNAL)
    run = scratch_path(requests.sparkSession, "run").rsplit("-", 1)[1]
    guess = F.col("guessed_tokens") if "guessed_tokens" in requests.columns else jsonx.fallback_prompt_tokens(F.col("review_text"))
    # The long text is stored once for an attempt; what passes on between attempts has none.
    waiting = requests.select(
        "cache_key",
        F.col("prompt").alias("first_prompt"),
        F.lit(None).cast("struct<problem: string, answer: string>").alias("mistake"),
        F.lit(0).alias("wrong"),
        guess.alias("guessed_tokens"),
        F.array(*start).cast("array<string>").alias("notes"),
    )
    finished: DataFrame | None = None
    for attempt in range(retries + 1):
        waiting = cut(waiting, "waiting")
        again = with_feedback(F.col("first_prompt"), F.col("mistake.problem"), F.col("mistake.answer"))
        posed = waiting.withColumn("prompt", F.col("first_prompt") if attempt == 0 else F.when(F.col("mistake").isNull(), F.col("first_prompt")).otherwise(again))
        posed = posed.withColumn("prompt_key", _prompt_key(F.col("prompt"), F.col("wrong"))).drop("first_prompt", "mistake")
        asked = _replies(posed, annotator, journal, resumed, f"{run}-{attempt}", parallelism, task_calls)
        answered = F.col("failure").isNull() & F.col("overflow_model").isNull()
        # Answers are checked after they are stored, at the width of the data and not of the calls.
        checked = asked.withColumn("problem", F.when(answered, answer_error(F.col("answer"), schema, template)))
        if template:
            extra = F.array_compact(F.array(extra_keys_warning(F.col("answer"), template)))
            checked = checked.withColumn("notes", F.concat("notes", extra))
        checked = cut(checked.withColumn("attempts", F.lit(attempt + 1)), "checked")

        final = (
            F.col("overflow_model").isNotNull()
            | (F.col("failure").isNull() & F.col("problem").isNull())
            | F.lit(attempt == retries)
        )
        done = checked.filter(final)
        finished = done if finished is None else finished.unionByName(done)
        if attempt == retries or checked.filter(~final).isEmpty():
            break
        # Only an answer that was read and found wrong gives feedback.
        corrigible = F.col("problem").isNotNull() & F.try_parse_json("answer").isNotNull()
        # A retry with feedback, and every attempt without a cache, bypasses the cache.
        bypasses = corrigible if use_cache else F.lit(True)
        noted = F.array_append("notes", F.lit("cache_disabled"))
        wrong = F.col("wrong") + F.col("failure").isNull().cast("int")
        failed = checked.filter(~final).select(
            "cache_key",
            F.when(corrigible, F.struct("problem", "answer")).alias("mistake"),
            wrong.alias("wrong"),
            "guessed_tokens",
            F.when(bypasses, noted).otherwise(F.col("notes")).alias("notes"),
        )
        waiting = failed.join(waiting.select("cache_key", "first_prompt"), "cache_key")
    return _outcome(finished, template)


def _outcome(checked: DataFrame, template: dict | None) -> DataFrame:
    ok = F.col("overflow_model").isNull() & F.col("failure").isNull() & F.col("problem").isNull()
    head, tail = K.MSG_OVERFLOW
    reason = F.coalesce("failure", F.concat(F.lit("ValueError: "), F.col("problem")))
    error = (
        F.when(F.col("overflow_model").isNotNull(), F.concat(F.lit(head), F.col("overflow_model"), F.lit(tail)))
        .when(~ok, F.concat(F.lit(K.MSG_RETRIES), reason))
    )
    overflow_note = F.when(
        F.coalesce("overflow_message", F.lit("")) != "",
        F.concat(F.lit("context_length_exceeded:"), F.substring("overflow_message", 1, 200)),
    )
    known = jsonx.has_usage(F.col("raw"))

    def tokens(field: str, guess: Column) -> Column:
        return F.when(ok, F.when(known, jsonx.usage(F.col("raw"), field)).otherwise(guess)).otherwise(0)

    guessed, completion = F.col("guessed_tokens"), F.lit(K.FALLBACK_COMPLETION_TOKENS)
    return checked.select(
        "cache_key",
        F.when(ok, accepted_answer(F.col("answer"), template)).alias("custom_json"),
        F.when(ok, F.col("raw")).alias("raw_response_json"),
        error.alias("error_text"),
        F.concat("notes", F.array_compact(F.array(overflow_note))).alias("answer_warnings"),
        tokens("prompt_tokens", guessed).cast("int").alias("prompt_tokens"),
        tokens("completion_tokens", completion).cast("int").alias("completion_tokens"),
        tokens("total_tokens", guessed + completion).cast("int").alias("total_tokens"),
        "attempts",
    )


EMBEDDED = T.StructType([T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("embedding_note", T.StringType())])


def embed(
    requests: DataFrame, text: str, embedder: Embedder, parallelism: int = K.PARALLEL_CALLS, task_calls: int = TASK_CALLS
) -> DataFrame:
    """Add ``embedding``, a vector of the normalised text, and ``embedding_note``.

    Equal texts are embedded once. A failed call gives no vector and a note. The
    first text is asked alone: an embedder that reports itself missing is called
    once in the whole run (or, if it goes missing later, no more after the wave that
    found out), and all rows with text get the note. Blank texts are not asked.
    """

    def embed_one(value: str):
        try:
            return [float(x) for x in embedder(value)] or None, None
        except EmbedderMissing:
            return None, K.NOTE_EMBEDDER_MISSING
        except Exception:  # the exact path still works without a vector
            return None, K.NOTE_EMBEDDING_FAILED

    gone = F.col("embedding_note") == K.NOTE_EMBEDDER_MISSING
    squashed = squash(F.coalesce(F.col(text), F.lit("")))
    prepared = requests.withColumn("_text", squashed)
    # The texts are kept once, as they came; blank ones have no key.
    prepared = cut(prepared.withColumn("_text_key", F.when(F.col("_text") != "", F.sha2("_text", 256))).drop("_text"), "texts")
    asked = cut(prepared.filter("_text_key IS NOT NULL").groupBy("_text_key").agg(F.first(squashed).alias("_text")), "asked")
    path = scratch_path(requests.sparkSession, "vectors")
    key = T.StructField("_text_key", T.StringType())
    empty_journal(requests.sparkSession, path, T.StructType([key, *EMBEDDED.fields]))
    call_in_waves(
        asked, "_text_key", "_text", embed_one, EMBEDDED, path, limit=parallelism, task_calls=task_calls, stop=gone,
    )
    found = requests.sparkSession.read.schema(T.StructType([key, *EMBEDDED.fields])).parquet(path)
    # A lost task may have answered a text twice.
    found = found.groupBy("_text_key").agg(F.first(F.struct(*EMBEDDED.names)).alias("_found"), F.lit(True).alias("_asked"))
    unasked = F.when(F.col("_text_key").isNotNull() & F.col("_asked").isNull(), F.lit(K.NOTE_EMBEDDER_MISSING))
    note = F.coalesce(F.col("_found.embedding_note"), unasked).alias("embedding_note")
    return prepared.join(found, "_text_key", "left").select(*requests.columns, F.col("_found.embedding").alias("embedding"), note)
