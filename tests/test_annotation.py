"""The annotation of a report with callables that count their calls."""

from __future__ import annotations

import json
import os
import time
import uuid

import pytest
from pyspark.sql import functions as F

from rowscribe.operators.annotate import EmbedderMissing, PromptTooLong, annotate, embed
from rowscribe.operators.rows import build_rows
from rowscribe.streaming import intake
from rowscribe.plans.annotate_report import Job, annotate_report, distinct_requests, with_keys

TEMPLATE = {"kind": {"type": "enum", "values": ["good", "bad"]}}


def counted(folder):
    """An annotator that leaves one file per call."""

    def ask(prompt: str):
        with open(os.path.join(folder, uuid.uuid4().hex), "w") as log:
            log.write(prompt)
        row = json.loads(next(x for x in prompt.split("\n") if x.startswith("{")))
        text = row.get("t") or str(row.get("group_size"))
        if "long" in text:
            raise PromptTooLong("m", "x" * 300)
        if "down" in text:
            raise TimeoutError("no answer")
        if "stubborn" in text:
            return '{"kind":"ugly","more":1}', None
        if "shaky" in text and "ugly" not in prompt.split("EXPECTED_JSON:")[-1]:
            return '{"kind":"ugly"}', None
        return '{"kind":"good"}', '{"usage":{"prompt_tokens":3,"completion_tokens":2,"total_tokens":5}}'

    return ask


def sheet(spark, texts):
    df = spark.createDataFrame([(i, t, f"g{i % 2}") for i, t in enumerate(texts, start=2)], "row_number int, t string, g string")
    return df


def test_every_outcome(spark, tmp_path):
    texts = ["fine", "fine", None, "stubborn", "shaky", "down", "long one", "fine "]
    rows = build_rows(sheet(spark, texts).drop("g"), ["t"])
    job = Job("Rate\n{row_json}", TEMPLATE, parallelism=2)
    done = {r.row_number: r for r in annotate_report(rows, job, counted(tmp_path)).rows.collect()}
    assert [done[i].status for i in range(2, 10)] == ["done", "done", "done", "error", "done", "error", "error", "done"]
    assert done[2].custom_json == '{"kind":"good"}' and done[2].total_tokens == 5
    assert done[4].warnings == ["empty_cell", "skipped_empty"] and done[4].custom_json is None
    assert done[5].error_text == "Ошибка LLM после повторов: ValueError: Поле 'kind' должно быть одним из: good|bad"
    extra = "dropped_extra_keys:more"
    assert done[5].warnings == [extra, "cache_disabled", extra, "cache_disabled", extra]
    assert done[6].warnings == ["cache_disabled"]
    assert done[7].error_text == "Ошибка LLM после повторов: TimeoutError: no answer" and done[7].warnings == []
    assert done[8].warnings == ["context_length_exceeded:" + "x" * 200]
    # fine once, stubborn and down three times, shaky twice, long once
    assert len(os.listdir(tmp_path)) == 1 + 3 + 3 + 2 + 1


def test_cache_is_used_checked_and_filled(spark, tmp_path):
    rows = build_rows(sheet(spark, ["one", "two", "three"]).drop("g"), ["t"])
    job = Job("Rate\n{row_json}", TEMPLATE)
    keys = {json.loads(r.input_json)["t"]: r.cache_key for r in distinct_requests(with_keys(rows, job)).collect()}
    stored = spark.createDataFrame(
        [(keys["one"], '{"kind":"bad"}', '{"usage":{"total_tokens":9}}'), (keys["two"], '{"kind":"old"}', None)],
        "cache_key string, analysis_json string, raw_json string",
    )
    out = annotate_report(rows, job, counted(tmp_path), cache=stored)
    got = {r.review_text: r for r in out.rows.collect()}
    assert got["t: one"].custom_json == '{"kind":"bad"}' and got["t: one"].warnings == ["cache_hit"]
    assert got["t: one"].total_tokens == 9
    assert got["t: two"].custom_json == '{"kind":"good"}'
    assert got["t: two"].warnings[0].startswith("cache_invalidated:Поле 'kind'")
    assert [r.cache_key for r in out.invalid.collect()] == [keys["two"]]
    assert {r.cache_key for r in out.fresh.collect()} == {keys["two"], keys["three"]}
    assert len(os.listdir(tmp_path)) == 2
    # Without the cache every row is asked and says so.
    plain = annotate_report(rows, Job("Rate\n{row_json}", TEMPLATE, use_cache=False), counted(tmp_path), cache=stored)
    assert {tuple(r.warnings) for r in plain.rows.collect()} == {("cache_disabled",)}


def test_similar_answers(spark, tmp_path):
    rows = build_rows(sheet(spark, ["aa", "ab", "zz"]).drop("g"), ["t"])
    job = Job("Rate\n{row_json}", TEMPLATE)
    keyed = distinct_requests(with_keys(rows, job)).first()
    vector = lambda text: [float(text.count("a")), float(text.count("z"))]
    entry = {
        "semantic_key": "s1",
        "provider": job.provider,
        "model": job.model,
        "analysis_mode": job.mode,
        "prompt_hash": keyed.prompt_hash,
        "expected_template_hash": keyed.expected_template_hash,
        "output_schema_hash": keyed.output_schema_hash,
        "embedding": [1.0, 0.0],
        "analysis_json": '{"kind":"bad"}',
        "raw_json": "{}",
        "updated_at": 1,
    }
    semantic = spark.createDataFrame([entry])
    out = annotate_report(rows, job, counted(tmp_path), semantic=semantic, embedder=vector)
    got = {r.review_text: r for r in out.rows.collect()}
    new = out.fresh_semantic.collect()
    assert [(r.embedding, r.analysis_json, len(r.semantic_key)) for r in new] == [([0.0, 2.0], '{"kind":"good"}', 64)]
    assert got["t: aa"].warnings == ["semantic_cache_hit:1.0"] and got["t: ab"].custom_json == '{"kind":"bad"}'
    assert got["t: zz"].custom_json == '{"kind":"good"}' and len(os.listdir(tmp_path)) == 1


def test_group_job_and_resume(spark, tmp_path):
    rows = build_rows(sheet(spark, ["a", "b", None, "d", "e"]), ["g", "t"], group_by="g")
    job = Job("Rate\n{row_json}", TEMPLATE, group_by="g", group_max_rows=2)
    got = {r.row_number: r for r in annotate_report(rows, job, counted(tmp_path)).rows.collect()}
    assert [got[i].status for i in range(2, 7)] == ["error", "done", "error", "done", "error"]
    assert got[2].warnings == ["skipped_large_group:3>2"]
    assert got[3].warnings == ["grouped_by:g", "group_size:2"]
    assert [got[i].total_tokens for i in range(2, 7)] == [0, 5, 0, 0, 0]
    assert len(os.listdir(tmp_path)) == 1
    stopped = rows.withColumn("status", F.when(F.col("row_number") < 5, F.lit("done")).otherwise(F.lit("pending")))
    again = annotate_report(stopped, job, counted(tmp_path)).rows
    assert sorted(r.row_number for r in again.collect()) == [5, 6]


def test_embedder_failures(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a  b", "", None, "fail", "a b", "later"])], "i int, t string")

    def vector(text):
        if text == "fail":
            raise RuntimeError()
        return [float(len(text))]

    got = {r.i: (r.embedding, r.embedding_note) for r in embed(df, "t", vector, parallelism=1).collect()}
    assert got[0] == got[4] == ([3.0], None) and got[1] == got[2] == (None, None) and got[5] == ([5.0], None)
    assert got[3] == (None, "semantic_cache_error")
    assert embed(df.limit(0), "t", vector).count() == 0


def timed(folder, wait=0.05):
    """An annotator that leaves the begin and end of each call."""

    def ask(prompt: str):
        begun = time.time()
        time.sleep(wait)
        with open(os.path.join(folder, uuid.uuid4().hex), "w") as log:
            log.write(f"{begun} {time.time()}")
        return '{"kind":"good"}', None

    return ask


def most_open(folder):
    marks = []
    for name in os.listdir(folder):
        begun, ended = map(float, open(os.path.join(folder, name)).read().split())
        marks += [(begun, 1), (ended, -1)]
    open_, most = 0, 0
    for _, step in sorted(marks):
        open_ += step
        most = max(most, open_)
    return most


@pytest.mark.parametrize("limit,partitions", [(1, 8), (3, 2), (6, 1), (9, 16)])
def test_open_calls(spark, tmp_path, limit, partitions):
    # More tasks of few calls than the limit lets run at a time; the width of the data does not matter.
    rows = build_rows(sheet(spark, [f"text {i}" for i in range(60)]).drop("g").repartition(partitions), ["t"])
    requests = distinct_requests(with_keys(rows, Job("Rate\n{row_json}", TEMPLATE))).withColumn("prompt", F.col("input_json"))
    found = annotate(requests, timed(tmp_path), template=None, schema=None, parallelism=limit, task_calls=7)
    assert found.count() == 60 and len(os.listdir(tmp_path)) == 60
    assert most_open(tmp_path) <= limit and (limit < 3 or most_open(tmp_path) > limit // 2)


def dying(folder, at):
    """An annotator whose process ends at a prompt, as if the executor was lost."""

    def ask(prompt: str):
        if at in prompt:
            time.sleep(2)
            os._exit(1)
        open(os.path.join(folder, uuid.uuid4().hex), "w").close()
        return '{"kind":"good"}', None

    return ask


def test_a_second_run_keeps_paid_answers(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    texts = [f"text {i}" for i in range(40)]
    rows = build_rows(sheet(spark, texts).drop("g"), ["t"])
    job = Job("Rate\n{row_json}", TEMPLATE, parallelism=4, journal=str(tmp_path / "journal"))
    requests = distinct_requests(with_keys(rows, job)).withColumn("prompt", F.col("input_json"))
    options = dict(template=None, schema=None, parallelism=4, journal=job.journal, task_calls=3)
    with pytest.raises(Exception):
        annotate(requests, dying(str(calls), '"text 17"'), **options).count()
    spent = len(os.listdir(calls))
    kept = spark.read.parquet(job.journal).count()
    assert 0 < kept <= spent < 40
    done = annotate(requests, dying(str(calls), "no such text"), **options)
    assert done.filter("custom_json IS NOT NULL").count() == 40
    # Only calls of the task that was lost are repeated; what finished tasks had answered is not asked again.
    assert len(os.listdir(calls)) - spent == 40 - kept and spent - kept < 3
    assert annotate(requests, dying(str(calls), "text"), **options).count() == 40


def test_missing_embedder_stops_the_run(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i % 50}") for i in range(200)] + [(900, "  "), (901, None)], "i int, t string").repartition(8)

    def vector(text):
        open(os.path.join(tmp_path, uuid.uuid4().hex), "w").close()
        raise EmbedderMissing()

    got = embed(df, "t", vector, parallelism=4, task_calls=5).collect()
    assert len(os.listdir(tmp_path)) == 1 and len(got) == 202
    assert {r.embedding_note for r in got if r.i < 900} == {"semantic_cache_disabled_endpoint_404"}
    assert {r.embedding_note for r in got if r.i >= 900} == {None} and not any(r.embedding for r in got)


def test_a_group_over_three_batches_is_one_call(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    texts = [f"t{i}" for i in range(12)]
    rows = build_rows(sheet(spark, texts), ["g", "t"], group_by="g").withColumn("at_us", F.col("row_number") * 10_000_000)
    rows = rows.withColumn("ends", (F.col("group_key") == "g0") & (F.col("row_number") == 10))
    job = Job("Rate\n{row_json}", TEMPLATE, group_by="g", parallelism=2)
    for number in range(3):
        rows.filter(F.expr("(row_number - 2) div 4") == number).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        whole = intake.whole_groups(stream, "group_key", "at_us", 25, F.col("ends")).drop("at_us", "ends")
        writer = intake.annotate_stream(whole, job, counted(str(calls)), str(tmp_path / "out"), str(tmp_path / "log"))
        writer.trigger(availableNow=True).start().awaitTermination()
        # Both groups have rows in every batch; neither is whole before the third.
        assert len(os.listdir(calls)) == (0 if number < 2 else 1)
    done = spark.read.parquet(str(tmp_path / "out")).collect()
    # g0 ended with row 10; row 12 and the group g1 wait for more.
    assert sorted(r.row_number for r in done) == [2, 4, 6, 8, 10, 12]
    assert {r.custom_json for r in done} == {'{"kind":"good"}'} and sum(r.total_tokens for r in done) == 5
