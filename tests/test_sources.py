"""Files: workbooks, logs, stored rows, exports, streams."""

from __future__ import annotations

import json
import os
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rowscribe.operators import events as batch_events
from rowscribe.operators import discovery, logs, profile
from rowscribe.sources import export, sheets, tables
from rowscribe.sources.logs import read_lines
from rowscribe.streaming import events, intake

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def workbook(path, sheets_xml, shared=()):
    with zipfile.ZipFile(path, "w") as book:
        names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets_xml, 1))
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{LINKS}"><sheets>{names}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets_xml) + 1))
        book.writestr("xl/_rels/workbook.xml.rels", f"<Relationships>{rels}</Relationships>")
        strings = "".join(f"<si><t>{s}</t></si>" for s in shared)
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">{strings}</sst>')
        for i, body in enumerate(sheets_xml.values(), 1):
            book.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{body}</sheetData></worksheet>')


@pytest.fixture()
def folder(tmp_path):
    rows = (
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t> n </t></is></c></row>'
        '<row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>1</v></c><c r="C2"><v>2.5</v></c></row>'
        '<row r="4"><c r="B4" t="str"><v>1</v></c><c r="C4" t="b"><v>1</v></c></row>'
    )
    workbook(tmp_path / "a.xlsx", {"Reviews": rows, "Alt": '<row><c t="inlineStr"><is><t>comment</t></is></c></row>'}, ["отзыв", " текст "])
    (tmp_path / "b.txt").write_text("no workbook")
    (tmp_path / "c.xlsx").write_bytes(b"x" * 5000)
    return str(tmp_path)


def test_workbooks(spark, folder):
    files = sheets.admitted_files(spark, folder, max_bytes=4000)
    assert [r.path.rsplit("/", 1)[1] for r in files.select("path").collect()] == ["a.xlsx"]
    cells = sheets.decode_workbooks(files)
    path = cells.select("path").first().path
    got = sheets.workbook_sheet(cells, path, "Reviews")
    assert got.columns == ["row_number", "отзыв", "Column 2", "n"]
    assert [tuple(r) for r in got.orderBy("row_number").collect()] == [
        (2, " текст ", "1", "2.5"),
        (3, None, None, None),
        (4, None, "1", "True"),
    ]
    with pytest.raises(ValueError):
        sheets.workbook_sheet(cells, path, "Missing")
    profile = {(r.sheet, r.column_name): (r.total_rows, r.distinct_values) for r in sheets.profile_workbooks(cells).collect()}
    # The number 1 and the text "1" are two values.
    assert profile == {("Reviews", "отзыв"): (3, 1), ("Reviews", "Column 2"): (3, 2), ("Reviews", "n"): (3, 2), ("Alt", "comment"): (0, 0)}


def test_workbook_stream(spark, folder, tmp_path):
    stream = intake.workbook_stream(spark, folder).filter("length < 4000")
    out = str(tmp_path / "out")
    writer = intake.profile_workbook_stream(stream, out, str(tmp_path / "log"))
    writer.trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(out).count() == 4


def test_log_tail_of_files(spark, tmp_path):
    for name, size in (("backend", 500), ("worker", 7)):
        (tmp_path / f"{name}.log").write_text("\n".join(f"{name} {i}" for i in range(size)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    lines = read_lines(spark, str(tmp_path / "backend.log"), str(tmp_path / "worker.log"))
    got = logs.tail(lines, 10, "file", ["block", "row_id"]).collect()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    assert [r.line for r in got] == [f"worker {i}" for i in range(6, -1, -1)] + [f"backend {i}" for i in (499, 498, 497)]


def test_ingest_and_scan(spark, tmp_path):
    path = str(tmp_path / "rows")
    first = spark.createDataFrame([("r1", 2, "a"), ("r1", 3, "b"), ("r1", 3, "b")], "report_id string, row_number int, t string")
    assert tables.ingest_rows(spark, first, path, None) == 2
    again = spark.createDataFrame([("r1", 3, "x"), ("r1", 4, "c"), ("r2", 2, "d"), ("r2", 2, "d")], "report_id string, row_number int, t string")
    stored = spark.read.parquet(path)
    assert tables.ingest_rows(spark, again, path, stored) == 2
    scan = tables.report_scan(spark.read.parquet(path), "r1")
    assert [r.row_number for r in scan.collect()] == [2, 3, 4]
    assert "PartitionFilters: [isnotnull(report_bucket" in scan._jdf.queryExecution().toString()


def report(spark):
    rows = [
        (2, "done", "g1", '{"src":"a","row_number":"x"}', '{"b":1,"a":{"c":[1,null,"z"]}}', ["w1", "w2"], None),
        (3, "pending", "g2", '{"src":"b"}', None, [], None),
        (4, "done", "g1", '{"src":"a","more":"m"}', '{"b":1,"src":"own"}', [], None),
        (5, "error", "", '{"src":"c"}', None, [], "broken"),
        (6, "error", None, "not json", '{"n":0.5}', [], "broken too"),
    ]
    return spark.createDataFrame(rows, "row_number int, status string, group_key string, passthrough_json string, custom_json string, warnings array<string>, error_text string")


def test_wide_export(spark):
    wide = export.wide_results(report(spark))
    assert wide.columns == ["row_number", "src", "more", "b", "a.c", "answer.src", "n", "warnings", "error"]
    got = [tuple(r) for r in wide.orderBy("row_number").collect()]
    assert got == [
        (2, "a", None, 1, "1, z", None, None, "w1, w2", None),
        (5, "c", None, None, None, None, None, "", "broken"),
        (6, None, None, None, None, None, 0.5, "", "broken too"),
    ]
    assert dict(wide.dtypes)["b"] == "bigint" and dict(wide.dtypes)["n"] == "double"
    # Nothing runs in Python, and named keys need no look at the rows.
    assert "Python" not in wide._jdf.queryExecution().toString() and "Pandas" not in wide._jdf.queryExecution().toString()
    named = export.wide_results(report(spark), carried=["src"], answered={"a.c": "string", "n": "decimal(3,1)", "gone": "int"})
    assert [tuple(r)[2:5] for r in named.orderBy("row_number").collect()] == [("1, z", None, None), (None, None, None), (None, Decimal("0.5"), None)]
    assert dict(named.dtypes)["src"] == "variant"
    cells = [(r.row_number, r.position, r.key, r.value.toPython()) for r in export.long_results(report(spark)).orderBy("row_number", "position").collect()]
    assert cells == [(2, 0, "b", 1), (2, 1, "a.c", [1, None, "z"]), (6, 0, "n", 0.5)]
    with pytest.raises(ValueError):
        discovery.named_columns(discovery.result_keys(export.finished_rows(report(spark))), most=2)
    grouped = export.wide_results(report(spark), "src")
    assert grouped.columns[:2] == ["group_number", "src"] and "more" not in grouped.columns
    assert [r.group_number for r in grouped.orderBy("group_number").collect()] == [1, 2, 3]


def test_written_exports(spark, tmp_path):
    rows = report(spark).withColumn("input_json", F.lit("{}"))
    export.write_export(rows, str(tmp_path / "x"), prompt_example="ask", partial=True)
    lines = {r.metric: r.value for r in spark.read.parquet(str(tmp_path / "x/summary")).collect()}
    assert lines == {"total_rows": "5", "success_rows": "2", "failed_rows": "2", "partial": "true"}
    assert spark.read.parquet(str(tmp_path / "x/prompt_example")).first().value == "ask"
    export.write_raw(rows, str(tmp_path / "raw"), "p", "m", "q", "1")
    raw = spark.read.json(str(tmp_path / "raw/rows"))
    assert raw.count() == 5 and "input_json" not in raw.columns
    assert spark.read.json(str(tmp_path / "raw/metadata")).first().model == "m"
    nested = spark.createDataFrame([(1, ["a"])], "n int, l array<string>")
    assert [tuple(r) for r in export.summary_table(nested).collect()] == [(0, "n", "1"), (1, "l", '["a"]')]


@pytest.mark.parametrize("cap", [None, 40, 99, 100])
def test_profile_of_five_batches(spark, tmp_path, cap):
    rows = [(i, f" v{i % 100} ", "x" * (i % 3 * 50), None if i % 2 else "same") for i in range(400)]
    whole = spark.createDataFrame(rows, "id int, many string, long string, few string")
    columns = ["id", "many", "long", "few"]
    for number in range(5):
        whole.filter(f"id div 80 = {number}").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(whole.schema).parquet(str(tmp_path / "in"))
        writer = intake.profile_sheets(stream, columns, str(tmp_path / "out"), str(tmp_path / "log"), cap)
        writer.trigger(availableNow=True).start().awaitTermination()
    got = {r.column_name: (r.total_rows, r.distinct_values) for r in intake.profile_so_far(spark, str(tmp_path / "out"), cap).collect()}
    plain = {"id": 400, "many": 100, "long": 2, "few": 1}
    assert got == {c: (400, n if cap is None or n <= cap else None) for c, n in plain.items()}
    assert got == {r.column_name: (r.total_rows, r.distinct_values) for r in profile.column_profile(whole, columns, cap).collect()}
    if cap == 40:
        # What is far above the cap is never stored or shuffled as values.
        kept = spark.read.parquet(str(tmp_path / "out/values")).select("position").distinct().collect()
        assert {r.position for r in kept} == {2, 3}


def _looks():
    rows, seq = [], 0
    for job in range(6):
        for i in range(40):
            status = "completed" if job % 2 and i == 30 else ("running" if i % 7 else "paused")
            rows.append(dict(job=job, seq=seq, at_us=i * 400_000 + job + 1, status=status, processed=i * (job + 1), total=1000, current_step=f"s{i // 5}"))
            seq += 1
    return rows


def _in_three_batches(spark, rows, schema, source):
    source.mkdir()
    for part in range(3):
        piece = [r for r in rows if r["at_us"] // 5_400_000 == part]
        (source / f"{part}.json").write_text("\n".join(json.dumps(r) for r in piece))
        os.utime(source / f"{part}.json", (1_700_000_000 + part,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))


def _drained(stream, path):
    writer = stream.writeStream.format("parquet").option("path", str(path / "out")).option("checkpointLocation", str(path / "log"))
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query, stream.sparkSession.read.schema(stream.schema).parquet(str(path / "out"))


def _held(spark, log):
    """Keys whose state is still stored."""
    rows = spark.read.format("statestore").option("stateVarName", "held").load(str(log))
    return {r.key.job for r in rows.select("key").collect()}


LOOKS = "job int, seq int, at_us bigint, status string, processed int, total int, current_step string"


def test_throttle_over_batches_equals_one_batch(spark, tmp_path):
    rows, order = _looks(), ["at_us", "seq"]
    sent = events.throttled_progress(_in_three_batches(spark, rows, LOOKS, tmp_path / "in"), "job", "at_us", order, 20, 1.0)
    query, got = _drained(sent, tmp_path)
    assert len([p for p in query.recentProgress if p.numInputRows]) == 3
    want = batch_events.throttle(spark.createDataFrame([tuple(r.values()) for r in rows], LOOKS), "job", "at_us", order, 20, 1.0)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def plain_feed(rows, every, until):
    out = []
    for job in {r["job"] for r in rows}:
        before, emitted = None, None
        for r in sorted((r for r in rows if r["job"] == job), key=lambda r: (r["at_us"], r["seq"])):
            while before and emitted + every <= r["at_us"]:
                emitted += every
                out.append((job, emitted, None, "keepalive"))
            now = [r[n] for n in ("status", "processed", "total", "current_step")]
            if now != before:
                out.append((job, r["at_us"], r["seq"], "progress" if before else "snapshot"))
                emitted = r["at_us"]
            before = now
            if r["status"] == "completed":
                out.append((job, r["at_us"], r["seq"], "done"))
                emitted = until
                break
        while emitted + every <= until:
            emitted += every
            out.append((job, emitted, None, "keepalive"))
    return sorted(out, key=str)


def test_feed_of_silent_jobs(spark, tmp_path):
    # Jobs 6 to 8 fall silent, one of them after it has ended.
    rows = [r | {"processed": 0} for r in _looks()]
    rows += [dict(job=6 + i, seq=900 + i, at_us=1_000_000 * i + 1, status="completed" if i == 1 else "running", processed=None, total=9, current_step=None) for i in range(3)]
    rows += [dict(job=7, seq=990, at_us=1_500_000, status="running", processed=0, total=9, current_step="late")]
    until = max(r["at_us"] for r in rows) // 1000 * 1000
    stream = _in_three_batches(spark, rows, LOOKS, tmp_path / "in")
    query, got = _drained(events.live_feed(stream, "job", "at_us", ["at_us", "seq"], 0.7, remember_seconds=3.0), tmp_path)
    columns = ["job", "at_us", "seq", "event_kind"]
    found = sorted(map(tuple, got.select(columns).collect()), key=str)
    assert found == plain_feed(rows, 700_000, until)
    assert any(k == "keepalive" and job == 8 and at > 10_800_000 for job, at, _, k in found)
    # Ended jobs (1, 3, 5 and 7) have left the state in which 0, 2, 4, 6 and 8 still are.
    assert query.lastProgress.stateOperators[0].customMetrics["numValueStateVars"] > 0
    assert _held(spark, tmp_path / "log") == {0, 2, 4, 6, 8}
    whole = spark.createDataFrame([tuple(r.values()) for r in rows], LOOKS)
    batch = batch_events.silent_feed(whole, "job", "at_us", ["at_us", "seq"], F.lit(until), 0.7)
    assert sorted(map(tuple, batch.select(columns).collect()), key=str) == found


def test_requests_over_batches(spark, tmp_path):
    second = 1_000_000
    # (id, second, kind): repeats before and after a start, and after the marker has expired; in three batches.
    marks = [("a", 0, "asked"), ("a", 1, "asked"), ("a", 2, "started"), ("a", 3, "asked"), ("a", 4, "asked"), ("a", 6, "asked"), ("a", 7, "asked"), ("a", 7, "asked")]
    marks += [("a", 12, "started"), ("a", 14, "asked"), ("b", 1, "asked"), ("b", 5, "asked"), ("b", 14, "started"), ("b", 15, "asked"), ("c", 2, "started"), (None, 1, "asked"), (None, 1, "asked"), (" ", 12, "asked"), ("d", 2, "other")]
    rows = [dict(job_id=i, at_us=s * second + 1, kind=k) for i, s, k in marks]
    stream = _in_three_batches(spark, rows, "job_id string, at_us bigint, kind string", tmp_path / "in")
    _, got = _drained(events.first_requests(stream, "job_id", "at_us", seconds=4), tmp_path)
    found = sorted(((r.job_id or "", r.at_us // second) for r in got.collect()))
    assert found == sorted([("a", 0), ("a", 3), ("a", 7), ("a", 14), ("b", 1), ("b", 5), ("b", 15), ("", 1), ("", 1), (" ", 12)])


def test_scratch_is_named_and_cleared(spark):
    from rowscribe.session import clear_scratch, cut, scratch_path

    assert spark.sparkContext.applicationId in scratch_path(spark, "x")
    kept = cut(spark.range(3))
    assert kept.count() == 3
    assert clear_scratch(spark) and not clear_scratch(spark)


def test_rejected_files_and_letter_case(spark, tmp_path):
    for name, size in (("a.XLSX", 10), ("b.xlsx", 2000), ("c.txt", 5)):
        (tmp_path / name).write_bytes(b"x" * size)
    folder = str(tmp_path)
    assert sheets.admitted_files(spark, folder).count() == 2
    assert [r.path[-6:] for r in sheets.admitted_files(spark, folder, 100).select("path").collect()] == ["a.XLSX"]
    found = {r.path[-5:]: r.reason for r in sheets.rejected_files(spark, folder, 100).collect()}
    assert found == {".xlsx"[-5:]: "too large", "c.txt": "not a workbook"}


def test_deeply_nested_answer(spark):
    # Deeper than a JSON reader goes: no answer, like any text that is no object.
    deep = '{"a":' * 10_000 + "1" + "}" * 10_000
    some = '{"a":' * 20 + "1" + "}" * 20
    rows = spark.createDataFrame([(deep,), ('{"a":{"b":{"c":[1,null,"z"]}},"d":true}',), (some,)], "t string")
    assert discovery.depth_of(rows.filter("length(t) < 1000"), F.col("t")) == 19
    found = discovery.cell_table(rows.filter("length(t) < 100 OR length(t) > 1000"), [], F.col("t")).collect()
    assert [(r.key, r.value.toPython()) for r in found] == [("a.b.c", [1, None, "z"]), ("d", True)]
