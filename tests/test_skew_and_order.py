"""Order-dependent operators with one key that holds most rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from rowscribe.operators import cache, events
from rowscribe.operators.ordering import chunked, sequential_number


@pytest.fixture()
def busy(many_chunks):
    """Events of one busy job, some small ones; times with ties inside a job."""
    random.seed(7)
    rows, seq = [], 0
    for job, size in [("busy", 4000), ("b2", 700)] + [(f"j{i}", random.randint(1, 9)) for i in range(60)]:
        at, processed = 1_000_000, 0
        for _ in range(size):
            at += random.choice([0, 10_000, 300_000, 2_500_000])
            processed += random.choice([0, 1, 1, 2, 9])
            status = random.choice(["running"] * 6 + ["paused"])
            rows.append((job, seq, at, status, processed, size * 3, random.choice(["a", "b"])))
            seq += 1
    rows.append(("b2", seq, at + 5, "failed", processed, 1, "z"))
    shuffled = random.sample(rows, len(rows))
    schema = "job string, seq bigint, at_us bigint, status string, processed bigint, total bigint, current_step string"
    df = many_chunks.createDataFrame(shuffled, schema).repartition(5)
    by_job = {}
    for r in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        by_job.setdefault(r[0], []).append(r)
    return df, by_job


def test_busy_job_spans_chunks(busy):
    df, _ = busy
    chunks = chunked(df, ["job"], ["at_us", "seq"])
    assert chunks.filter("job = 'busy'").select("_chunk").distinct().count() > 1


def expected_throttle(rows, every_rows, micros):
    last_time, last_count, out = rows[0][2], 0, []
    for _, seq, at, _, processed, total, _ in rows:
        if processed >= total or processed - last_count >= every_rows or at - last_time >= micros:
            out.append(seq)
            last_time, last_count = at, processed
    return out


@pytest.mark.parametrize("every_rows,seconds", [(20, 1.0), (500, 60.0), (3, 0.2), (10**6, 3000.0), (1, 10.0)])
def test_throttle_matches_plain_walk(busy, every_rows, seconds):
    df, by_job = busy
    got = events.throttle(df, "job", "at_us", ["at_us", "seq"], every_rows, seconds).select("job", "seq").collect()
    want = {(job, s) for job, rows in by_job.items() for s in expected_throttle(rows, every_rows, int(seconds * 1e6))}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def expected_feed(rows, micros=None):
    before, emitted, out = None, None, []
    for job, seq, at, status, processed, total, step in rows:
        now = (status, processed, total, step)
        if now != before:
            out.append((job, seq, "snapshot" if before is None else "progress"))
            emitted = at
        elif micros is not None and at - emitted >= micros:
            out.append((job, seq, "keepalive"))
            emitted = at
        before = now
        if status in ("completed", "failed", "canceled"):
            out.append((job, seq, "done"))
            break
    return out


def test_change_feed_matches_plain_walk(busy):
    df, by_job = busy
    # Drop the field that nearly always changes, so that unchanged looks occur.
    df = df.withColumn("processed", F.lit(0).cast("bigint"))
    quiet = {j: [(*r[:4], 0, *r[5:]) for r in rows] for j, rows in by_job.items()}
    got = events.change_feed(df, ["job"], ["at_us", "seq"]).select("job", "seq", "event_kind").collect()
    assert sorted(map(tuple, got)) == sorted(e for rows in quiet.values() for e in expected_feed(rows))
    got = events.feed_with_keepalive(df, "job", "at_us", ["at_us", "seq"], 0.5).select("job", "seq", "event_kind").collect()
    assert sorted(map(tuple, got)) == sorted(e for rows in quiet.values() for e in expected_feed(rows, 500_000))


def test_fold_matches_plain_walk(busy):
    df, by_job = busy
    gaps = {"status": 3, "processed": 2, "total": 5, "current_step": 7}
    holes = df.withColumns({n: F.when(F.col("seq") % m != 0, F.col(n)) for n, m in gaps.items()})
    holes = holes.withColumn("total", F.when(F.col("seq") % 11 == 1, F.lit(0)).otherwise(F.col("total")))
    holes = holes.withColumn("eta_seconds", F.lit(None).cast("double"))
    got = {(r.job, r.seq): r for r in events.fold(holes, ["job"], ["at_us", "seq"]).collect()}
    assert len(got) == sum(map(len, by_job.values()))
    for job, rows in by_job.items():
        state, shown = dict.fromkeys(gaps), None
        for _, seq, _, status, processed, total, step in rows:
            new = dict(status=status, processed=processed, total=total, current_step=step)
            new = {n: (v if seq % gaps[n] else None) for n, v in new.items()}
            if seq % 11 == 1:
                new["total"] = 0
            state.update({n: v for n, v in new.items() if v is not None})
            if state["total"] and state["processed"] is not None:
                shown = int(state["processed"] / state["total"] * 10000 + 0.5) / 100
            row = got[job, seq]
            assert (row.status, row.processed, row.total, row.current_step, row.progress_percent) == (*state.values(), shown)


@pytest.mark.parametrize("lease", [1, 2, 3])
def test_lost_leases_match_plain_walk(busy, lease):
    df, by_job = busy
    want = []
    for job, rows in by_job.items():
        run = None
        for at in (r[2] for r in rows):
            if run is None or at - run[2] >= lease * 1_000_000:
                run = [job, at, at, 0]
                want.append(run)
            run[2], run[3] = at, run[3] + 1
    found = events.lost_leases(df, ["job"], "at_us", ["at_us", "seq"], lease)
    got = found.select("job", "first_beat", "last_beat", "beats").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert found.filter(f"expired_at <> last_beat + {lease * 1_000_000}").isEmpty()


def test_numbers_over_chunks(many_chunks):
    rows = [("hot", i * 7919 % 100_003) for i in range(3000)] + [(f"k{i % 9}", i) for i in range(200)] + [(None, 5), (None, 3)]
    df = many_chunks.createDataFrame(rows, "k string, n bigint").repartition(4)
    got = sequential_number(df, "n", "number", ["k"], start=2).collect()
    by_key = {}
    for k, n in rows:
        by_key.setdefault(k, []).append(n)
    want = {(k, n, i) for k, ns in by_key.items() for i, n in enumerate(sorted(ns), start=2)}
    assert {tuple(r) for r in got} == want and len(got) == len(rows)
    ordered = sequential_number(df.na.drop(), ["n", "k"], "number", start=1).collect()
    plain = sorted((n, k) for k, n in rows if k)
    assert {(r.n, r.k): r.number for r in ordered} == {key: i for i, key in enumerate(plain, start=1)}


def test_numbering_moves_rows_once(many_chunks):
    df = many_chunks.createDataFrame([(i * 7 % 100, "x" * i) for i in range(100)], "n bigint, wide string").repartition(3)
    plan = sequential_number(df, "n", "number")._jdf.queryExecution().executedPlan().toString()
    # Only the written, ordered copy is read: once for the counts of its partitions and once for the rows.
    assert plan.count("FileScan") == 2 and "ReadSchema: struct<_at:bigint>" in plan


@pytest.mark.parametrize("keep", [0, 1, 399, 500, 777, 1200, 1201, 5000])
def test_eviction_by_cut_off(many_chunks, monkeypatch, keep):
    monkeypatch.setattr(cache, "FEW", 20)
    monkeypatch.setattr(cache, "BINS", 8)
    random.seed(keep)
    # A crowded second, one time with many ties, some far away, some without a time.
    times = [random.randrange(10**6) for _ in range(600)] + [500_000] * 400 + [random.randrange(10**15) for _ in range(150)] + [None] * 50
    rows = [(f"k{i:04}", t, "v") for i, t in enumerate(times)]
    df = many_chunks.createDataFrame(rows, "cache_key string, at bigint, v string").selectExpr("cache_key", "timestamp_micros(at) AS updated_at", "v").repartition(3)
    found = {r.cache_key for r in cache.evict_oldest(df, keep, "cache_key").collect()}
    oldest = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert found == {r[0] for r in oldest[max(0, len(rows) - keep) :]}
