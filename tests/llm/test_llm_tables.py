"""Archives, vector search, the pipeline and the optional part's registration."""

from __future__ import annotations

import gzip
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from rowscribe.llm import vector_search, warc
from rowscribe.session import scratch_path

SMALL = "/root/testdata/sf0.001"


def test_archives_round_trip(spark):
    big = "".join(random.Random(1).choices("abc é\n", k=70_000))
    rows = [(1, "http://a/%0A", big), (2, "http://a\nb", big), (3, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (2, "u", big), (None, "u", big), (None, "v", "alone")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, payload string, chunk_no int")
    records = warc.records_of(pages)
    manifest = warc.write_archives(warc.chunk_rows(records, 1000), scratch_path(spark, "warc"))
    found = warc.read_archives(manifest, 700).orderBy("page_id", "url", "chunk_no").collect()
    last = [f for f in found if f.last]
    assert len(last) == len(rows) and {(f.page_id, f.url) for f in last} == {(p, u) for p, u, _ in rows}
    for f in last:
        body = next(h for p, u, h in rows if (p, u) == (f.page_id, f.url)) or ""
        assert f.payload_bytes == len(body.encode()) and f.payload_digest == hashlib.sha1(body.encode()).hexdigest() == f.digest_so_far
        if body == big and f.page_id != 2:
            assert (f.record_type, f.refers_to) == ("revisit", 2)
        else:
            assert (f.record_type, f.refers_to) == ("response", None)
            assert b"".join(g.chunk for g in found if (g.page_id, g.url) == (f.page_id, f.url)) == body.encode()
    assert max(len(f.chunk) for f in found) <= 700
    text = b"".join(gzip.open(m.path.removeprefix("file:")).read() for m in manifest.select("path").distinct().collect())
    assert text.count(b"WARC/1.1\r\n") == len(rows) == len(re.findall(rb"\r\nWARC-Date: \d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ\r\n", text))
    assert warc.archive_pages(pages.limit(0)).count() == 0


def brute(vectors, queries, k):
    out = set()
    for q, x in queries:
        scores = sorted((-float(np.dot(x, y)), v) for v, y in vectors if v != q)
        out |= {(q, i + 1, v) for i, (_, v) in enumerate(scores[:k])}
    return out


def test_vector_search(spark):
    r = np.random.default_rng(3)
    good = [(i, r.integers(-8, 9, 6).astype(float).tolist()) for i in range(300)]
    good = [(i, x) for i, x in good if any(x)] + [(1000 + i, [1.0, 2.0, 0.0, 0.0, 0.0, 1.0]) for i in range(90)]
    bad = [(2000, None), (2001, [0.0] * 6), (2002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2003, [float("nan")] * 6), (2004, [1.0, 2.0]), (None, [1.0] * 6), (2005, [float("inf")] * 6), (2006, [])]
    rows = spark.createDataFrame([(*x, "l") for x in [*good, *bad, good[0]]], "vec_id long, embedding array<double>, list string")
    found = vector_search.search(rows, rows.filter("vec_id % 20 = 0"), k=20).collect()
    want = brute(good, [x for x in good if x[0] % 20 == 0], 20)
    got = {(f.query_id, f.rank, f.vec_id) for f in found}
    assert len(got) == len(want) and len({(q, v) for q, _, v in got} & {(q, v) for q, _, v in want}) >= 0.95 * len(want)
    few = spark.createDataFrame(good[:3], "vec_id long, embedding array<double>")
    assert {(f.query_id, f.rank, f.vec_id) for f in vector_search.search(few, few, 20).collect()} == brute(good[:3], good[:3], 20)
    assert vector_search.search(rows.limit(0), rows.limit(0)).count() == 0


def test_a_query_reads_every_list_within_reach():
    r = np.random.default_rng(4)
    x = r.standard_normal((60_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    asked, count = x[:50], 400_000  # lists as for so many vectors
    index = vector_search.Index.learned(x[:20_000], count, 1.0, 20)
    packed = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * 64, pa.int32()), pa.array(m.ravel()))
    read = [set() for _ in asked]
    for batch in index.probe([pa.record_batch({"query": pa.array(np.arange(50)), "embedding": packed(asked)})]):
        for query, one in zip(batch.column("query").to_pylist(), batch.column("list").to_pylist(), strict=True):
            read[query].add(one)
    gaps = np.linalg.norm(index._asked(asked, 1.0)[:, None] - index.centroids[None], axis=2)
    assert read == [set(np.flatnonzero(g <= index.reach * np.sort(g)[vector_search.BASE - 1]).tolist()) for g in gaps]
    assert len(index.centroids) > 1000 and max(map(len, read)) > 64 and np.mean([*map(len, read)]) < 0.5 * len(index.centroids)
    scores = asked @ x.T
    scores[np.arange(50), np.arange(50)] = -np.inf
    near = np.argsort(-scores, axis=1)[:, :20]
    lists = {}
    for batch in index.place([pa.record_batch({"rep": pa.array(near.ravel()), "embedding": packed(x[near.ravel()])})]):
        for rep, one in zip(batch.column("rep").to_pylist(), batch.column("list").to_pylist(), strict=True):
            lists.setdefault(rep, set()).add(one)
    assert np.mean([bool(lists[v] & read[i]) for i in range(50) for v in near[i].tolist()]) >= 0.9


@pytest.mark.parametrize("name", ["op2_warc", "op3_substring_dedup"])
def test_queries_match_sql(spark, name):
    import glob
    import os

    import duckdb

    db = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    found = entry.queries()[name](spark, SMALL)
    result = db.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(map(str, result.fetchall())) == sorted(str(tuple(r)) for r in found.select(*names).collect())


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = docs.columns
    odd = spark.createDataFrame([(900_001, None, "en", "s", 0), (900_002, "", "en", "s", 0), (None, "The and attion to thanedble the, anea. Eriner thanea, and that thing. a.b@mail.de", "en", "s", 3)], docs.schema)
    copy = docs.limit(3).withColumn("doc_id", F.col("doc_id") + 800_000)
    rows = docs.unionByName(odd).unionByName(copy)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, SMALL).cache()
        assert rows.columns == names
    kept = {r.doc_id for r in rows.collect()}
    assert not any(k and 800_000 <= k < 900_000 for k in kept) and None in kept
    assert not any("a.b@mail.de" in (r.text or "") for r in rows.collect())
    coded = corpus_pipeline.STAGES[-1][1](spark, rows, SMALL)
    assert coded.count() == rows.count() and coded.filter("NOT round_trip").count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SMALL).count() == 0


def test_pipeline_keeps_rows_that_share_a_doc_id(spark):
    """Rows are told apart by doc_id and text, and columns named like the stages' own do no harm."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy(F.desc(F.length("text"))).first().text
    r = random.Random(8)
    text = [" ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(60)) for _ in range(3)]
    rows = [(1, text[0]), (2, text[0]), (2, text[1]), (2, text[1]), (3, text[2]), (None, text[2]), (None, text[2])]
    odd = spark.createDataFrame([(i, x, "a", "b", 7, 8, 9, "c") for i, x in rows], "doc_id long, text string, lang string, source string, _id int, _key int, key int, class_id string")
    kept = corpus_pipeline.near_duplicates(spark, odd, SMALL)
    assert kept.columns == odd.columns
    assert sorted(map(str, kept.select("doc_id", "text").collect())) == sorted(map(str, odd.filter("doc_id IS NULL OR doc_id != 2").select("doc_id", "text").collect() + odd.filter(F.col("text") == text[1]).select("doc_id", "text").limit(1).collect()))
    rows = [(1, text[0] + " " + item), (1, text[1]), (None, item), (None, text[2])]
    odd = spark.createDataFrame([(i, x, 7, 8) for i, x in rows], "doc_id long, text string, _id int, _key int")
    kept = corpus_pipeline.benchmarks(spark, odd, SMALL)
    assert {(k.doc_id, k.text) for k in kept.collect()} == {(1, text[1]), (None, text[2])}
    named = docs.withColumn("_id", F.lit(1)).withColumn("_key", F.lit(2)).withColumn("text_key", F.lit(3))
    assert corpus_pipeline.languages(spark, named, SMALL).columns == named.columns


def test_languages_of_pages(spark):
    """Every page is identified, with markup and address as a plain reading of its html and url gives them."""
    found = entry.queries()["op4_language_id"](spark, SMALL).collect()
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    said = {f.doc_id: f for f in found if f.kind == "page"}
    assert len(found) == docs + len(pages) and sum(f.kind == "document" for f in found) == docs
    assert set(said) == {p.page_id for p in pages}
    stated = {p.page_id: m[1].lower() for p in pages if (m := re.search(r"<html\b[^>]*\blang\s*=\s*[\"']?([a-z]{2,3})", p.html or "", re.I | re.S))}
    assert stated and {i: f.declared for i, f in said.items() if f.declared} == stated
    known = [i for i, x in stated.items() if x in {f.language for f in found if f.kind == "document"}]
    assert sum(said[i].language == stated[i] for i in known) >= 0.8 * len(known)


def test_queries_are_registered():
    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))


def test_recall_of_the_registered_query(spark):
    """At least 0.95 of the true neighbours on a table whose queries do not read every list, no vector twice, scores in order."""
    folder = "/root/testdata/sf0.1"
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()}
    rows = {v: np.array(x, float) for v, x in rows.items() if x and all(c is not None and np.isfinite(c) for c in x) and any(x)}
    ids, matrix = np.array(sorted(rows)), np.stack([rows[v] for v in sorted(rows)])
    found = {}
    for f in entry.queries()["op8_vector_search"](spark, folder).collect():
        found.setdefault(f.query_id, {})[f.rank] = (f.vec_id, f.score)
    assert set(found) == {v for v in rows if v % 20 == 0}
    hits = 0
    for q, ranked in found.items():
        assert sorted(ranked) == list(range(1, 21)) and len({v for v, _ in ranked.values()} - {q}) == 20
        got = [ranked[i] for i in range(1, 21)]
        assert got == sorted(got, key=lambda x: (-x[1], x[0])) and all(abs(rows[q] @ rows[v] - s) < 1e-9 for v, s in got)
        scores = np.where(ids == q, -np.inf, matrix @ rows[q])
        hits += len({v for v, _ in got} & set(ids[np.lexsort((ids, -scores))[:20]].tolist()))
    assert hits >= 0.95 * 20 * len(found)
