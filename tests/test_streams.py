"""Streams over tables that are one file or a folder of files."""

from __future__ import annotations

import pytest

from rowscribe.plans import catalog_streams
from rowscribe.plans.registry import Tables

ROWS = [(1, "a fine place", "en", "web", 12), (2, "a fine place", "de", "web", 12), (3, None, None, "mail", 0)]


@pytest.mark.parametrize("files", [1, 2])
def test_a_table_of_several_files_is_streamed_whole(spark, tmp_path, files):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long").repartition(files).write.parquet(path)
    t = Tables(spark, str(tmp_path))
    found = {r.column_name: (r.total_rows, r.distinct_values) for r in catalog_streams.profile_intake(t).collect()}
    assert found == {"doc_id": (3, 3), "text": (3, 1), "lang": (3, 2), "source": (3, 2), "n_chars": (3, 2)}
    assert catalog_streams.live_annotation(t).first().total_rows == 3


def test_a_table_of_one_file_is_streamed(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    stream = catalog_streams.StreamTables(spark, t.folder).documents
    found = []
    catalog_streams._finish(stream.writeStream.foreachBatch(lambda batch, _: found.append(batch.count())))
    assert sum(found) == t.documents.count()
