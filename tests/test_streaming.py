"""Streaming jobs against their batch forms on files that arrive in several parts."""

import os
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from wikimill.streaming import jobs as j


def parts(spark, tmp_path, rows, schema, n=3):
    """Write rows as several files that become separate micro-batches, in this order (files are taken by their time)."""
    size = -(-len(rows) // n)
    seen: set = set()
    for i in range(n):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for f in set((tmp_path / "in").glob("part-*")) - seen:
            os.utime(f, (1_700_000_000 + 60 * i,) * 2)
            seen.add(f)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def events(n=60):
    t0 = datetime(2024, 1, 1)
    return [(i, i % 3, t0 + timedelta(minutes=7 * i)) for i in range(n)]


END = timedelta(days=3)  # a last event that moves the watermark past all others


def test_trailing_counts(spark):
    rows = events()
    batch = j.trailing_counts(spark.createDataFrame(rows, "id long, submitter long, ts timestamp"), "submitter", "ts")
    want = {i: sum(s2 == s and timedelta(0) <= t - t2 <= timedelta(hours=1) and i2 != i for i2, s2, t2 in rows if i2 < i) for i, s, t in rows}
    assert {r["id"]: r["recent"] for r in batch.collect()} == want


def test_rate_limit_out_of_order(spark, tmp_path):
    """Batches that overlap in time give the decisions of the batch form."""
    rows = events(90)
    mixed = [r for k in range(3) for r in rows[k::3]] + [(1000, 9, rows[0][2] + END)]
    schema = "id long, submitter long, ts timestamp"
    stream = parts(spark, tmp_path, mixed, schema, n=4)
    out = {r["id"]: r for r in j.run_to_files(j.rate_limit_stream(stream, 3600, 2, "1 day"), "t-r1").collect()}
    batch = j.rate_limited(spark.createDataFrame(rows, schema), "submitter", "ts", 3600, 2).collect()
    assert any(r["refused"] for r in batch)
    assert {r["id"]: (r["recent"], r["refused"]) for r in batch} == {i: (r["recent"], r["refused"]) for i, r in out.items() if i < 1000}


def test_rate_limit_late_row(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(1, 0, t0 + timedelta(hours=6)), (2, 0, t0 + timedelta(hours=7)), (3, 0, t0 + timedelta(hours=1)), (4, 0, t0 + timedelta(hours=9))]
    stream = parts(spark, tmp_path, rows, "id long, submitter long, ts timestamp", n=4)
    out = {r["id"]: tuple(r)[2:] for r in j.run_to_files(j.rate_limit_stream(stream, 3600, 2, "1 minute"), "t-r1l").collect()}
    assert out == {1: (0, False, False), 2: (1, False, False), 3: (None, None, True)}


def test_runner_claims_out_of_order(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    at = lambda m: t0 + timedelta(minutes=m)
    rows = [(1, 7, "a", at(0)), (3, 7, "b", at(3)), (2, 7, "b", at(1)), (4, 7, "a", at(4)), (9, 8, "z", at(60))]
    stream = parts(spark, tmp_path, rows, "id long, run_id long, runner string, ts timestamp", n=5)
    out = {r["id"]: r["granted"] for r in j.run_to_files(j.runner_claims(stream, 120, "10 minutes"), "t-r3").collect()}
    assert out == {1: True, 2: False, 3: True, 4: False}


def test_lifecycle_in_any_order(spark, tmp_path):
    rows = [(1, 5, "pass"), (1, 3, "claim"), (1, 4, "fail"), (2, 2, "fail"), (2, 1, "claim")]
    out = j.run_to_files(j.lifecycle_stream(parts(spark, tmp_path, rows, "job_id long, seq long, kind string", n=5), 1), "t-r4o")
    last = {r["job_id"]: tuple(r["s"]) for r in out.groupBy("job_id").agg(F.max_by(F.struct("attempt", "status"), F.struct("seq", "attempt")).alias("s")).collect()}
    assert last == {1: (1, "pass"), 2: (1, "needs_review")}


def test_lease_expiry_with_budget(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    at = lambda m: t0 + timedelta(minutes=m)
    rows = [(1, at(0), 0, "claim"), (1, at(5), 1, "done"), (2, at(1), 2, "claim"), (2, at(20), 3, "claim"), (3, at(60), 4, "claim"), (9, at(90), 5, "claim"), (9, at(95), 6, "done")]
    stream = parts(spark, tmp_path, rows, "task_id long, ts timestamp, seq long, kind string")
    got = {(r["task_id"], r["attempts"], r["status"]) for r in j.run_to_files(j.lease_stream(stream, 8, 2), "t-r5").collect()}
    assert got == {(2, 1, "queued"), (2, 2, "failed"), (3, 1, "queued")}


def test_lifecycle(spark, tmp_path):
    kinds = ["claim", "fail", "claim", "fail", "claim", "fail", "claim", "pass"]
    rows = [(i % 2, i, kinds[i // 2]) for i in range(16)]
    schema = "job_id long, seq long, kind string"
    out = j.run_to_files(j.lifecycle_stream(parts(spark, tmp_path, rows, schema), 3), "t-r4")
    last = {r["job_id"]: tuple(r["s"]) for r in out.groupBy("job_id").agg(F.max_by(F.struct("attempt", "status"), "seq").alias("s")).collect()}
    assert last == {r["job_id"]: (r["attempt"], r["status"]) for r in j.lifecycle_status(spark.createDataFrame(rows, schema), 3).collect()}


def test_incremental_ingest_keeps_the_latest(spark, tmp_path):
    rows = [(1, "a"), (2, "b"), (1, "c"), (3, "d")]
    stream = parts(spark, tmp_path, rows, "doc_id long, text string", n=2)
    out = j.incremental_ingest(stream, lambda d: d, ["doc_id"], "t-r10")
    assert sorted(tuple(r) for r in out.collect()) == [(1, "c"), (2, "b"), (3, "d")]


def test_late_rows_are_dropped(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    # a row is late by the watermark of the batch before, so one more batch lies between
    rows = [(t0 + timedelta(hours=h), "a") for h in (0, 5, 6)] + [(t0 + timedelta(minutes=1), "a"), (t0 + timedelta(hours=9), "a")]
    stream = parts(spark, tmp_path, rows, "ts timestamp, status string", n=5)
    out = j.run_to_files(j.window_counts(stream, "ts", "10 minutes", "1 hour"), "t-r9")
    assert [r["n"] for r in out.collect()] == [1, 1, 1]


def test_finished_jobs_leave_the_state(spark, tmp_path):
    """Job 1 passes and is forgotten; what comes behind the watermark is reported, what comes in time begins anew. Job 2 still runs."""
    at = lambda d: datetime(2024, 1, 1) + timedelta(days=d)
    rows = [(1, 1, "claim", at(0)), (1, 2, "pass", at(1)), (2, 1, "claim", at(1)), (9, 1, "claim", at(20)), (9, 2, "claim", at(21)), (1, 3, "fail", at(2)), (1, 4, "claim", at(40)), (2, 2, "claim", at(40)), (9, 3, "claim", at(41))]
    stream = parts(spark, tmp_path, rows, "job_id long, seq long, kind string, ts timestamp", n=9)
    out = {(r["job_id"], r["seq"]): (r["attempt"], r["status"]) for r in j.run_to_files(j.lifecycle_stream(stream, 3, "1 day", 5), "t-r4e").collect()}
    assert out[1, 2] == (1, "pass") and out[1, 3] == (None, "late")
    assert out[1, 4] == (1, "running")  # not 2: the state of the first life is gone
    assert out[2, 2] == (2, "running")


class FakeStates:
    """States in memory that count the rows and bucket keys they give."""

    def __init__(self):
        self.rows = self.keys = 0
        self.timers = []

    def getMapState(self, name, key, value):
        outer, held = self, {}

        class Buckets:
            exists = staticmethod(lambda: bool(held))
            containsKey = staticmethod(held.__contains__)
            updateValue = staticmethod(held.__setitem__)
            removeKey = staticmethod(held.pop)

            @staticmethod
            def keys():
                outer.keys += len(held)
                return list(held)

            @staticmethod
            def getValue(k):
                outer.rows += len(held[k][0])
                return held[k]

        return Buckets

    def getValueState(self, name, schema):
        held = []

        class Value:
            exists = staticmethod(lambda: bool(held))
            get = staticmethod(lambda: held[0])
            clear = staticmethod(held.clear)

            @staticmethod
            def update(v):
                held[:] = [v]

        return Value

    def registerTimer(self, ms):
        self.timers.append(ms)


class Collect(j.InOrder):
    columns, waiting_schema, output = ("us", "id"), "us long, id long", ["us", "id"]

    def start(self, handle):
        pass

    def step(self, key, due):
        return due

    def late(self, key, row):
        return (-1, row[1])


class Times:
    def __init__(self, watermark, expiry=None):
        self.getCurrentWatermarkInMs, self.getExpiryTimeInMs = (lambda: watermark), (lambda: expiry)


def waited(n, batches):
    """Rows of one key over ``n`` / 10 minutes, shuffled into batches; the watermark then passes in steps."""
    states, p = FakeStates(), Collect()
    p.init(states)
    order = sorted(range(n), key=lambda i: (i * 7919) % n)
    at = lambda i: (1_000_000 + 6_000 * i) * 1000 + i % 7
    for k in range(batches):
        list(p.handleInputRows((1,), iter([pd.DataFrame([(at(i), i) for i in order[k::batches]], columns=["us", "id"])]), Times(0)))
    out, last = [], at(n - 1) // 1000
    for step in range(1, 11):
        mark = 1_000_000 + (last - 1_000_000) * step // 10 + (BUCKET if step == 10 else 0)
        for t in sorted(t for t in states.timers if t <= mark):
            states.timers.remove(t)
            for frame in p.handleExpiredTimer((1,), Times(mark), Times(mark, t)):
                out += list(frame.itertuples(index=False, name=None))
    assert out == sorted((at(i), i) for i in range(n))
    return states


BUCKET = j.BUCKET_MS


def test_waiting_rows_are_read_when_due():
    one, two = waited(3000, 4), waited(6000, 4)
    assert two.rows <= 2.1 * one.rows and two.keys <= 2.1 * one.keys
    assert one.rows <= 5 * 3000  # once for each batch that adds to their bucket, once when due
    assert len(set(one.timers)) == 0


def test_table_as_file_and_as_folder(spark, tmp_path):
    """A table may be one file or a folder of part files; a folder without rows gives an empty snapshot."""
    rows = [(1, "a"), (2, "b"), (3, "c")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(str(tmp_path / "folder.parquet"))
    pd.DataFrame(rows, columns=["doc_id", "text"]).to_parquet(tmp_path / "file.parquet")
    for name in ("folder.parquet", "file.parquet"):
        out = j.incremental_ingest(j.read_stream(spark, str(tmp_path), name), lambda d: d, ["doc_id"], "t-r10p")
        assert sorted(tuple(r) for r in out.collect()) == rows
    (tmp_path / "none").mkdir()
    none = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "none"))
    assert j.incremental_ingest(none, lambda d: d, ["doc_id"], "t-r10n").collect() == []


def test_a_key_has_one_timer(spark):
    """Rows of a thousand different minutes wait under one timer, and come when the watermark reaches them, also inside a minute."""
    states, p = FakeStates(), Collect()
    p.init(states)
    at = lambda i: (1_000_000 + 60_000 * i) * 1000
    list(p.handleInputRows((1,), iter([pd.DataFrame([(at(i), i) for i in range(1000)], columns=["us", "id"])]), Times(0)))
    assert len(states.timers) == 1
    states, p = FakeStates(), Collect()
    p.init(states)
    list(p.handleInputRows((1,), iter([pd.DataFrame([(30_000_000, 1), (30_002_000, 2)], columns=["us", "id"])]), Times(0)))
    assert [t < 30_000 for t in states.timers] == [True]
    frames = list(p.handleExpiredTimer((1,), Times(30_000), Times(30_000, states.timers.pop())))
    assert [tuple(r) for f in frames for r in f.itertuples(index=False)] == [(30_000_000, 1)]
    assert states.timers and states.timers[-1] < 30_002


def test_a_lease_sets_timers_for_its_last_claim(spark):
    """A task with many claims sets one timer for the end of the last lease and one to be forgotten."""
    states, p = FakeStates(), j.LeaseProcessor(8, 2, 10**9)
    p.init(states)
    out = p.step((1,), [(60_000_000 * 10 * i, i, "claim") for i in range(100)])
    assert len(out) == 99 and len(states.timers) == 2
    assert out[0] == (1, 480_000, 1, "queued") and out[1][3] == "failed"
    end = 99 * 600_000 + 480_000
    assert min(states.timers) < end and p.expire((1,), end - 1) == [] and p.expire((1,), end) == [(1, end, 100, "failed")]
    assert p.expire((1,), end + 1) == []
