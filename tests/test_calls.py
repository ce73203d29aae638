"""What calls and annotation read, shuffle and write."""

from __future__ import annotations

from pyspark.sql import DataFrameReader
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowscribe import session
from rowscribe.operators import annotate as annotate_operator
from rowscribe.operators import cache, calls
from rowscribe.operators.rows import build_rows
from rowscribe.plans import annotate_report


def test_a_wave_lists_and_reads_its_own_requests(spark, tmp_path, monkeypatch):
    # The width of what a wave reads must not grow with the number of waves.
    df = spark.range(300).select(F.col("id").cast("string").alias("k"), F.concat(F.lit("text "), "id").alias("t")).repartition(5)
    kind = T.StructType([T.StructField("k", T.StringType()), T.StructField("size", T.LongType())])
    read = []
    plain = DataFrameReader.parquet

    def listing(reader, *paths, **options):
        found = plain(reader, *paths, **options)
        read.append(len(found.inputFiles()))
        return found

    monkeypatch.setattr(DataFrameReader, "parquet", listing)
    calls.empty_journal(spark, str(tmp_path / "j"), kind)
    calls.call_in_waves(df, "k", "t", lambda t: [len(t)], T.StructType(kind.fields[1:]), str(tmp_path / "j"), limit=2, task_calls=10, stop=F.col("size") < 0)
    monkeypatch.undo()
    # One listing of all waves, then one file for each of them.
    assert len(read) == 17 and read[0] == 16 and set(read[1:]) == {1}
    assert spark.read.parquet(str(tmp_path / "j")).groupBy("size").count().count() == 3
    assert spark.read.parquet(str(tmp_path / "j")).select("k").distinct().count() == 300


def written_by(spark, monkeypatch, run):
    """Names of the columns of every table that ``run`` writes to the shared folder."""
    written = []

    def noted(df, name="cut"):
        written.append((name, df.columns))
        return session.cut(df, name)

    for module in (annotate_operator, annotate_report):
        monkeypatch.setattr(module, "cut", noted)
    run()
    monkeypatch.undo()
    return written


def test_a_text_is_written_once_per_step(spark, monkeypatch):
    sheet = spark.createDataFrame([(i, f"text {i}") for i in range(2, 30)], "row_number int, t string")
    job = annotate_report.Job("Rate\n{row_json}", {"kind": {"type": "enum", "values": ["good"]}}, retries=1)
    none = spark.createDataFrame([], "cache_key string, analysis_json string, raw_json string")

    def answer(prompt):
        return '{"kind":"good"}' if '"text 4"' not in prompt else "[]", None

    def run():
        rows = annotate_report.annotate_report(build_rows(sheet, ["t"]), job, answer, cache=none).rows.collect()
        assert len(rows) == 28 and [r.row_number for r in rows if r.status == "error"] == [4]

    texts = {"review_text", "input_json", "prompt", "first_prompt", "_text"}
    for name, columns in written_by(spark, monkeypatch, run):
        assert len(texts & set(columns)) == (0 if name == "checked" else 1 if "cached_answer" not in columns else 0), (name, columns)


def test_a_guess_is_that_of_the_first_row(spark):
    rows = build_rows(spark.createDataFrame([(3, "a" * 40), (2, "a" * 40 + "    ")], "row_number int, t string"), ["t"])
    job = annotate_report.Job("Rate\n{row_json}", None)
    keyed = annotate_report.distinct_requests(annotate_report.with_keys(rows, job))
    assert [(r.key_rows, r.guessed_tokens) for r in keyed.collect()] == [(2, 10)]
    assert "review_text" not in keyed.columns


def test_requests_are_not_brought_together_by_their_key(many_chunks):
    spark = many_chunks
    small = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(small)
    spark.conf.set(small, "-1")  # as if the table was large
    asked = spark.range(2000).select(F.lit("m").alias("model"), "id", F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"))
    stored = spark.createDataFrame([("m", "e", [1.0, 5.0], 1)], "model string, semantic_key string, embedding array<double>, updated_at int")
    path = session.scratch_path(spark, "asked")
    asked.repartition(8).write.parquet(path)
    found = cache.semantic_lookup(spark.read.parquet(path), stored, ["model"], block_rows=50)
    plan = found._jdf.queryExecution().executedPlan().toString()
    spark.conf.set(small, before)
    # The big side meets the number of its blocks by a broadcast, and is dealt by key and block.
    assert found.count() == 2000 and "BroadcastHashJoin [model" in plan
    spread = found.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert max(r["count"] for r in spread) < 2000
