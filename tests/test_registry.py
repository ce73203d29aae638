"""Registered queries against their SQL on the smallest test tables."""

from __future__ import annotations

import glob
import os
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from rowscribe.plans import registry

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "tools"))
from check_oracle import rows_of  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
QUICK = ["src04", "src05", "prj01", "prj08", "prj14", "flt06", "joi02", "joi05", "joi08", "agg01", "agg04", "agg10", "agg14", "win01", "win03", "val02", "upd05", "upd09", "ann02"]


@pytest.fixture(scope="module")
def db():
    base = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        base.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return base


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.SQL)
    assert set(registry.QUERIES) <= set(entry.queries()) and set(registry.SQL) <= set(entry.oracle_sql())
    assert len(registry.QUERIES) >= 130


@pytest.mark.parametrize("name", [n for n in entry.queries() if n.split("_")[0] in QUICK])
def test_query_matches_sql(spark, db, name):
    found = entry.queries()[name](spark, FOLDER)
    result = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(found.columns)
    assert rows_of(found.columns, found.collect()) == rows_of(names, result.fetchall())


def test_flagship(spark):
    row = entry.entry(spark).first()
    assert row.total_rows == 200 and 0 < row.success_rows <= row.total_rows
    # Rows with neither review nor language need no answer and are neither.
    ids = [r.doc_id for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect()]
    blank = sum((i % 17 in (3, 5) or i % 29 == 7) and i % 23 == 4 for i in ids)
    assert row.success_rows + row.failed_rows + blank == row.total_rows
