"""Rows, groups, caches, reports and table changes on small tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rowscribe import constants as K
from rowscribe.operators import cache, groups, logs, maintenance, profile, reports
from rowscribe.operators import rows as R
from rowscribe.sources.sheets import header_names, sheet_from


def test_build_rows(spark):
    sheet = spark.createDataFrame(
        [(2, " a ", "-", " x "), (3, None, " ", None), (4, "0", "b", "-")], "row_number int, t string, u string, p string"
    )
    got = [r.asDict() for r in R.build_rows(sheet, ["u", "t"], ["p"]).orderBy("row_number").collect()]
    assert [r["review_text"] for r in got] == ["t: a", None, "u: b\nt: 0"]
    assert [r["input_json"] for r in got] == ['{"u":null,"t":"a"}', '{"u":null,"t":null}', '{"u":"b","t":"0"}']
    assert [r["passthrough_json"] for r in got] == ['{"p":"x"}', '{"p":null}', '{"p":"-"}']
    assert [r["warnings"] for r in got] == [["empty_cell"], ["empty_cell"], []]
    grouped = R.build_rows(sheet, ["u", "t"], ["p"], "u").orderBy("row_number").collect()
    assert [r.group_key for r in grouped] == ["__missing__:2", "__missing__:3", "b"]
    assert [r.warnings for r in grouped] == [["empty_cell", "group_key_missing"]] * 2 + [[]]
    assert [r.passthrough_json for r in grouped] == ['{"u":"-"}', '{"u":""}', '{"u":"b"}']
    skipped = R.build_rows(sheet, ["u", "t"]).select(R.skips_model(F.col("review_text"), F.col("input_json"))).collect()
    assert [r[0] for r in skipped] == [False, True, False]


def test_column_choice():
    for bad in (([], None, None), (["x"], None, None), (["a"], ["x"], None), (["a"], None, "b")):
        with pytest.raises(ValueError):
            R.resolve_columns(["a", "b"], *bad)
    assert R.resolve_columns(["a", "b"], ["a"], ["b"], " a ") == (["a"], ["a"], "a")


def test_header_and_numbering(spark):
    assert header_names([" a ", None, "", "a"]) == ["a", "Column 2", "Column 3", "a"]
    df = spark.createDataFrame([(30, "x", "u"), (10, "y", "v"), (20, "z", "w")], ["id", " name ", " "])
    got = sheet_from(df, "id", max_rows=2).orderBy("row_number").collect()
    assert [(r.row_number, r.name, r["Column 3"]) for r in got] == [(2, "y", "v"), (3, "z", "w")]


def test_profile_cap_and_blanks(spark):
    df = spark.createDataFrame([("a", 1), (" a ", 2), ("", 3), ("  ", None), (None, 3), ("b", 3)], "s string, n int")
    got = lambda cap: {r.column_name: (r.total_rows, r.distinct_values) for r in profile.column_profile(df, ["s", "n"], cap).collect()}
    assert got(3) == {"s": (6, 2), "n": (6, 3)}
    assert got(2) == {"s": (6, 2), "n": (6, None)}


def test_materialized(spark):
    cases = [("done", None, None), ("pending", "{}", None), ("odd", "{}", None), (None, None, "e"), (None, None, ""), ("in_progress", None, "e")]
    df = spark.createDataFrame(cases, "status string, c string, e string")
    none = F.lit(None).cast("string")
    got = df.select(R.is_materialized(F.col("status"), F.col("c"), none, F.col("e")), R.is_previewable(F.col("status"), F.col("c"), none, F.col("e")))
    assert [tuple(r) for r in got.collect()] == [(True, True), (False, True), (True, True), (True, True), (False, False), (False, True)]


def _group_rows(spark):
    rows = [(i, "big" if i % 3 else f"g{i % 2}", f"t{i}", "{}", [], "pending", None) for i in range(2, 30)]
    return spark.createDataFrame(rows, "row_number int, group_key string, review_text string, input_json string, warnings array<string>, status string, error_text string")


def test_oversize_and_assembly(spark):
    rows = _group_rows(spark)
    marked = groups.mark_oversize(rows, ["group_key"], 6).collect()
    assert {r.status for r in marked if r.group_key == "big"} == {"error"}
    assert {r.warnings[0] for r in marked if r.group_key == "big"} == {"skipped_large_group:19>6"}
    assert {r.error_text for r in marked if r.group_key != "big"} == {None}
    built = {r.group_key: r for r in groups.assemble(rows, ["group_key"], "g", 6).collect()}
    assert set(built) == {"g0", "g1"}
    assert built["g0"].review_text == "\n".join(f"[row {i}] t{i}" for i in (6, 12, 18, 24))
    assert built["g1"].row_number == 3 and built["g1"].warnings == ["grouped_by:g", "group_size:5"]


def test_tokens_only_on_first_row(spark):
    rows = _group_rows(spark).select("row_number", "group_key")
    answers = spark.createDataFrame([("big", 7, "x"), ("g0", None, "y")], "group_key string, total_tokens int, custom_json string")
    got = groups.spread_answers(rows, answers, ["group_key"]).collect()
    assert len(got) == 28 and sum(r.total_tokens for r in got) == 7
    assert [r.row_number for r in got if r.total_tokens] == [2]
    assert {r.custom_json for r in got if r.group_key == "g1"} == {None}


def test_first_rows_and_blanks(spark):
    rows = [(1, "a"), (2, None), (3, ""), (4, "a"), (5, None), (6, "b")]
    df = spark.createDataFrame(rows, "row_number int, group_key string")
    export = groups.first_row_per_group(df, ["group_key"])
    assert sorted(r.row_number for r in export.collect()) == [1, 2, 3, 5, 6]
    preview = groups.first_row_per_group(df, ["group_key"], blank_is_group=True)
    assert sorted((r.row_number, r.group_key) for r in preview.collect()) == [(1, "a"), (2, ""), (6, "b")]
    numbered = groups.number_groups(export)
    assert {r.row_number: r.group_number for r in numbered.collect()} == {1: 1, 2: 2, 3: 3, 5: 4, 6: 5}


def test_risk_levels(spark):
    def level(size, hits, scheme="личные скидки"):
        df = spark.range(size).select(F.lit("s").alias("g"), (F.col("id") < hits).cast("int").alias("v"), F.lit(scheme).alias("k"))
        return groups.risk_rollup(df, "g", "v", "k").first()

    assert level(10, 0).risk_level == "низкий" and level(10, 0).schemes == []
    assert level(3, 1).risk_level == "низкий" and level(3, 1).share_percent == 33.3
    assert level(20, 3).risk_level == "средний"
    assert level(20, 5).risk_level == "высокий"
    assert level(100, 5).risk_level == "низкий"
    assert level(100, 1, "вымогательство").risk_level == "высокий"


def test_semantic_lookup_both_ways(spark):
    entries = [("m", f"e{i}", [1.0, i / 10], i) for i in range(8)] + [("m", "twin", [1.0, 0.3], 99), ("n", "zero", [0.0, 0.0], 1), ("n", "none", [], 2)]
    requests = [("m", 1, [1.0, 0.3]), ("m", 2, [2.0, 1.4, 9.0]), ("n", 3, [1.0, 1.0]), ("o", 4, [1.0]), ("m", 5, None), ("m", 6, [-1.0, 0.0])]
    stored = spark.createDataFrame(entries, "model string, semantic_key string, embedding array<double>, updated_at int")
    asked = spark.createDataFrame(requests, "model string, id int, embedding array<double>")
    for block_rows in (100, 2):
        found = cache.semantic_lookup(asked, stored, ["model"], limit=4, block_rows=block_rows)
        got = {r.id: (r.semantic_key, r.similarity) for r in found.collect()}
        # Only the four newest entries are looked at; the newer twin wins the tie.
        assert got == {1: ("twin", 1.0), 2: ("e7", 1.0), 3: (None, None), 4: (None, None), 5: (None, None), 6: (None, None)}


def test_upsert_touch_evict(spark):
    table = spark.createDataFrame([("a", 1, "x", 5), ("b", 2, "y", 6)], "k string, hits int, v string, updated_at int")
    fresh = spark.createDataFrame([("b", 0, "new", 8), ("b", 0, "old", 7), ("c", 0, None, 9)], "k string, hits int, v string, updated_at int")
    merged = cache.upsert(table, fresh, ["k"], {"hits": F.lit(0)}, ["updated_at"])
    assert sorted(map(tuple, merged.collect())) == [("a", 1, "x", 5), ("b", 2, "new", 8), ("c", 0, None, 9)]
    used = spark.createDataFrame([("a",), ("a",)], "k string")
    touched = {r.k: (r.hits, r.updated_at) for r in cache.touch(merged, used, "k", F.lit(50)).collect()}
    assert touched == {"a": (3, 50), "b": (2, 8), "c": (0, 9)}
    assert sorted(r.k for r in cache.evict_oldest(merged, 2, "k").collect()) == ["b", "c"]
    assert cache.evict_oldest(merged, 3, "k").count() == 3
    ties = spark.range(100).select(F.col("id").alias("k"), F.lit(1).alias("updated_at"))
    assert cache.evict_oldest(ties, 30, "k").count() == 30


def test_retry_reset(spark):
    rows = [(1, "error", "e", ["empty_cell", "x"]), (2, "done", None, ["skipped_large_group:9>5"]), (3, "done", None, ["cache_hit"]), (4, "pending", None, [])]
    df = spark.createDataFrame(rows, "row_number int, status string, error_text string, warnings array<string>").withColumns(
        {"custom_json": F.lit("{}"), "prompt_tokens": F.lit(5)}
    )
    got = [tuple(r) for r in maintenance.reset_failed_rows(df).orderBy("row_number").select("status", "error_text", "warnings", "custom_json", "prompt_tokens", "was_reset").collect()]
    assert got == [
        ("pending", None, None, None, 0, True),
        ("pending", None, None, None, 0, True),
        ("done", None, ["cache_hit"], "{}", 5, False),
        ("pending", None, [], "{}", 5, False),
    ]


def test_retention_and_delete(spark):
    rows = [(i, 1, i, "done") for i in range(8)] + [(20, 1, -1, "running"), (30, 0, 5, "done"), (40, 2, 1, "done")]
    df = spark.createDataFrame(rows, "id int, user_id int, created_at int, status string").withColumn("uploaded_file_id", F.col("id"))
    stale = reports.retention(df, 5)
    assert sorted((r.id, r.decision) for r in stale.collect()) == [(0, "delete"), (1, "delete"), (2, "delete"), (20, "skip_active")]
    assert tuple(reports.retention_counts(stale).first()) == (3, 1)
    uploads = spark.createDataFrame([(0, 1), (7, 1), (99, 1), (98, 2)], "id int, user_id int")
    row_table = spark.createDataFrame([(0, 1), (7, 1)], "report_id int, row_number int")
    left, kept, files = maintenance.delete_reports(df, row_table, uploads, stale.filter("decision = 'delete'"))
    assert left.count() == 8 and [r.report_id for r in kept.collect()] == [7]
    # User 2 deleted nothing and keeps an unused upload.
    assert sorted((r.id, r.user_id) for r in files.collect()) == [(7, 1), (98, 2)]


def test_snapshot_merge(spark):
    listed = spark.createDataFrame([(1, "running", "s1"), (2, "done", "s2")], "id int, status string, summary_json string")
    active = spark.createDataFrame([(1, "paused", None), (3, "queued", "s3")], "id int, status string, summary_json string")
    got = reports.merge_snapshot(listed, active, ["summary_json"]).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "paused", "s1", False), (2, "done", "s2", False), (3, "queued", "s3", True)]


def test_log_filters(spark):
    lines = ['{"level":"ERROR","message":"Boom"}', "plain BOOM", '{"level":"info","message":"boom"}', '{"message":null,"x":"boom"}', " "]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "i int, line string")
    records = logs.parse_lines(df)
    assert [r.message for r in records.orderBy("i").collect()] == ["Boom", "plain BOOM", "boom", lines[3]]
    assert [r.i for r in logs.filter_records(records, "error", "boom").orderBy("i").collect()] == [0, 1, 3]


def test_sections(spark):
    text = "# top\nintro\n---\n## 2.0 — today\nline\n---\n more \n## \n## 1.9\n\n"
    df = spark.createDataFrame([(1, text), (2, "no heading"), (3, "## only")], "k int, t string")
    got = [tuple(r) for r in logs.sections(df, "k", "t").orderBy("k", "section").collect()]
    assert got == [(1, 1, "2.0", "2.0 — today", "line\n more"), (1, 2, "", "", ""), (1, 3, "1.9", "1.9", ""), (3, 1, "only", "only", "")]


def test_job_recovery(spark):
    """Stale jobs are queued once per job_id, or fail with the reason; live ones stay out."""
    at = lambda hour: f"2024-01-01 {hour:02d}:00:00"
    rows = [
        # id, job, status, created, updated, user, file, provider, key
        ("a", "j1", "running", at(1), at(1), 1, "f", "open", None),  # queued again
        ("b", "j1", "queued", at(2), at(1), 1, None, "open", None),  # its job waits by now: left alone
        ("c", "j1", "running", at(2), at(1), 1, None, "open", None),  # running, cannot be started again
        ("d", "j2", "running", at(1), at(1), 1, "f", "keyed", " "),  # no key
        ("e", "j3", "running", at(1), at(1), 1, "f", "keyed", "k"),  # marked: stays
        ("f", "j3", "queued", at(1), at(1), 1, "f", "open", None),  # marked and queued: not stale
        ("g", "j4", "running", at(1), at(1), 1, "f", "open", None),  # has a lease
        ("h", "j5", "running", at(1), at(9), 1, "f", "open", None),  # fresh
        ("i", None, "running", at(1), None, 1, "f", "open", None),  # no job
        ("k", "j6", "running", at(1), at(1), 0, "f", "open", None),  # no user
        ("l", "j7", "paused", at(1), at(1), 1, "f", "open", None),
        ("m", "j8", "queued", at(1), at(9), 1, "f", "open", None),  # only if the queue is empty
    ]
    names = "id string, job_id string, status string, created_at string, updated_at string, user_id long, uploaded_file_id string, provider string, api_key_encrypted string"
    table = spark.createDataFrame(rows, names).withColumn("updated_at", F.col("updated_at").cast("timestamp"))
    table = table.withColumn("model", F.lit("m")).withColumn("prompt_template", F.lit("p"))
    leases, markers = (spark.createDataFrame([(j,)] * 2, "job_id string") for j in ("j4", "j3"))
    now = F.lit(at(9)).cast("timestamp")
    found = reports.recover_jobs(table, leases, markers, now, False, ("keyed",), 3600)
    assert found.columns == [*table.columns, "new_status", "new_error", "new_finished_at"]
    got = {r.id: (r.new_status, r.new_error) for r in found.collect()}
    lost, keyless = ("failed", K.MSG_NO_CONTEXT), ("failed", K.MSG_NO_KEY)
    assert got == {"a": ("queued", None), "b": (None, None), "c": lost, "d": keyless, "e": (None, None), "i": lost, "k": lost}
    assert {r.id for r in found.filter("new_finished_at IS NOT NULL").collect()} == {"c", "d", "i", "k"}
    assert reports.recovery_counts(found).collect() == [(1, 4)]
    empty = reports.recover_jobs(table, leases, markers, now, True, ("keyed",), 3600)
    assert {r.id: r.new_status for r in empty.collect()}["m"] == "queued"
    assert reports.recovery_counts(reports.recover_jobs(table.limit(0), leases, markers, now, True)).collect() == [(0, 0)]
