"""Time-dependent rules (R*), each as a batch form over a table and as a Structured Streaming job over its events.

Stateful jobs hold rows back until the watermark has passed them and then handle them in event order, whatever batch they came
in. A row that comes after the watermark is reported as late and changes nothing. State is cleared by event-time timers.
Outputs go to Parquet files through the file sink, or through ``foreachBatch`` where rows are updated.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import work_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def read_stream(spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream of the Parquet files of one table, which is a file of a folder or a folder of files; the schema is that of the
    files present."""
    table = f"{folder.rstrip('/')}/{name}"
    r = spark.readStream.schema(spark.read.parquet(table).schema)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return r.parquet(table)
    # a stream reads folders only: a single file is picked from its own
    return r.option("pathGlobFilter", name.rsplit("/", 1)[-1]).parquet(table.rsplit("/", 1)[0])


def with_state_store(spark: SparkSession) -> None:
    """Stateful processors need the RocksDB store; a session that names no store gets it, once."""
    if spark.conf.get(STATE_PROVIDER) != ROCKSDB:
        spark.conf.set(STATE_PROVIDER, ROCKSDB)


def run_to_files(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process everything available and return what was written."""
    spark = df.sparkSession
    with_state_store(spark)
    out, state = work_path(spark, name), work_path(spark, f"{name}-state")
    q = df.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def run_upserts(df: DataFrame, name: str, keys: list[str], mode: str = "update", order: str | None = None) -> DataFrame:
    """Keep the latest row per key of a stream; returns the table as it stands when everything is processed.

    A micro-batch only writes its own rows, into a folder of its own, so the cost follows the new rows and not the table.
    Running a batch again after a failure overwrites the same folder. Readers take the newest row per key; ``complete``
    results are whole, so there the last folder is the table.
    """
    spark = df.sparkSession
    base, state = work_path(spark, name), work_path(spark, f"{name}-state")
    written = []

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/epoch={epoch}")
        written.append(epoch)

    q = df.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    if not written:  # nothing has arrived yet
        return spark.createDataFrame([], df.schema)
    log = spark.read.parquet(base)
    if mode == "complete":
        last = log.agg(F.max("epoch")).first()[0]
        return spark.read.parquet(f"{base}/epoch={last}")
    return latest_rows(log, keys, ["epoch", *([order] if order else [])])


def latest_rows(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key of a log of changes; also compacts one when written back."""
    values = [c for c in log.columns if c not in keys and c not in order]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_v")).select(*keys, "_v.*")


def _stateful(df: DataFrame, key: str, processor: StatefulProcessor, schema: str, timers: bool = True) -> DataFrame:
    return df.groupBy(key).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="eventTime" if timers else "none"
    )


BUCKET_MS = 60_000  # the usual delay of these streams
SEGMENT_ROWS = 512


class InOrder(StatefulProcessor):
    """Hands the rows of a key to ``step`` in the order of ``columns``, of which the first is ``us`` (microseconds).

    A row waits until the watermark reaches it. What comes later than that is given to ``late``. ``expire`` may clear state
    when a timer runs out. Rows wait in sorted segments of a few hundred, under the time of their first row, and a key has one
    timer, for the first row of all: a timer reads the segments that have begun and no others, so a key costs a few state calls
    for a segment and not for a row, and rows that are not due cost their segments' keys, once a batch.
    """

    columns: tuple[str, ...]
    waiting_schema: str
    output: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        row = ",".join(":".join(field.split()) for field in self.waiting_schema.split(","))
        self.waiting = handle.getMapState("waiting", "first long", f"rows array<struct<{row}>>")
        self.start(handle)

    def start(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def step(self, key, due: list[tuple]) -> list[tuple]:
        raise NotImplementedError

    def late(self, key, row: tuple) -> tuple:
        raise NotImplementedError

    def expire(self, key, now: int) -> list[tuple]:
        return []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        found, out = [], []
        for frame in rows:
            for r in frame[list(self.columns)].itertuples(index=False, name=None):
                if r[0] // 1000 > passed or passed <= 0:
                    found.append(r)
                else:
                    out.append(self.late(key, r))
        if found:
            found.sort()
            self._keep(found)
            self._wake(found[0][0])
        if out:
            yield pd.DataFrame(out, columns=self.output)

    def _keep(self, rows: list[tuple]) -> None:
        """Puts sorted rows into segments; one that begins at the same time as another is put together with it."""
        for i in range(0, len(rows), SEGMENT_ROWS):
            segment = rows[i:i + SEGMENT_ROWS]
            if self.waiting.containsKey((segment[0][0],)):
                segment = sorted(self._rows(segment[0][0]) + segment)
            self.waiting.updateValue((segment[0][0],), (segment,))

    def _wake(self, us: int) -> None:
        # a timer fires when the watermark is greater; a row is due when the watermark reaches it
        self.handle.registerTimer(us // 1000 - 1)

    def _rows(self, first: int) -> list[tuple]:
        return [tuple(r) for r in self.waiting.getValue((first,))[0]]

    def _due(self, now: int) -> list[tuple]:
        """Takes all rows up to ``now`` out of their segments and sets the timer for the next one."""
        firsts = [k[0] for k in self.waiting.keys()]
        begun = [f for f in firsts if f // 1000 <= now]
        held = []
        for f in begun:
            held += self._rows(f)
            self.waiting.removeKey((f,))
        held.sort()
        n = bisect_right(held, now, key=lambda r: r[0] // 1000)
        self._keep(held[n:])
        ahead = [f for f in firsts if f // 1000 > now] + [r[0] for r in held[n:n + 1]]
        if ahead:
            self._wake(min(ahead))
        return held[:n]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # all rows up to the watermark at once; a timer set meanwhile could not fire in this batch any more
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        due = self._due(now)
        out = (self.step(key, due) if due else []) + self.expire(key, now)
        if out:
            yield pd.DataFrame(out, columns=self.output)

    def close(self) -> None:
        pass


# --- R1 rate limit --------------------------------------------------------------------------------------------------


def trailing_counts(events: DataFrame, key: str, ts: str, seconds: int = 3600) -> DataFrame:
    """How many rows of the same key lie in the trailing time before each row (the row itself not counted).

    A row only needs its own stretch of time and the one before, so every row is sent to its stretch and, as context, to
    the next one. A submitter with a large share of the rows is thereby spread over the stretches.
    """
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    size = seconds * 1_000_000
    d = events.withColumns({"_t": t, "_b": F.floor(t / size)})
    both = d.withColumn("_own", F.lit(True)).unionByName(d.withColumns({"_b": F.col("_b") + 1, "_own": F.lit(False)}))
    w = Window.partitionBy(key, "_b").orderBy("_t").rangeBetween(-size, 0)
    same = Window.partitionBy(key, "_b", "_t")
    # rows at the very same moment count only when they come first, by id
    earlier = F.row_number().over(same.orderBy("id")) - 1
    counted = both.withColumn("recent", F.count("*").over(w) - F.count("*").over(same) + earlier)
    return counted.where("_own").drop("_t", "_b", "_own")


def _admitted(recent: deque, us: int, span: int, limit: int) -> tuple[int, bool]:
    """How many accepted moments lie in the span before ``us``, and whether the row is refused; an accepted one is kept."""
    while recent and recent[0] < us - span:
        recent.popleft()
    count, refused = len(recent), len(recent) >= limit
    if not refused:
        recent.append(us)
    return count, refused


def rate_limited(events: DataFrame, key: str, ts: str, seconds: int = 3600, limit: int = 10) -> DataFrame:
    """``id``, key, ``recent`` and ``refused`` of events ``(id, key, ts)``: a refused proposal is not stored, so only accepted
    ones count for those after it.

    Each decision rests on the decisions before it, so the rows of a submitter are one sorted stretch of a partition; they
    are read through with at most ``limit`` moments in memory, however many there are.
    """
    span = seconds * 1_000_000
    rows = events.select("id", F.col(key).alias("k"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))

    def decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, recent = object(), deque()
        for frame in frames:
            out = []
            for r in frame.itertuples():
                if r.k != now:
                    now, recent = r.k, deque()
                out.append((r.id, r.k, *_admitted(recent, r.us, span, limit)))
            yield pd.DataFrame(out, columns=["id", key, "recent", "refused"])

    types = dict(events.dtypes)
    return rows.repartition("k").sortWithinPartitions("k", "us", "id").mapInPandas(decide, f"id {types['id']}, {key} {types[key]}, recent int, refused boolean")


class RateLimit(InOrder):
    """Admits or refuses the proposals of a submitter; keeps the accepted moments that still count."""

    columns, waiting_schema, output = ("us", "id"), "us long, id long", ["id", "submitter", "recent", "refused", "late"]

    def __init__(self, seconds: int, limit: int):
        self.span, self.limit = seconds * 1_000_000, limit

    def start(self, handle: StatefulProcessorHandle) -> None:
        self.accepted = handle.getListState("accepted", "us long")

    def step(self, key, due):
        recent = deque(t[0] for t in self.accepted.get()) if self.accepted.exists() else deque()
        out = [(i, key[0], *_admitted(recent, us, self.span, self.limit), False) for us, i in due]
        self.accepted.put([(t,) for t in recent])
        self.handle.registerTimer((recent[-1] + self.span) // 1000 + 1)
        return out

    def late(self, key, row):
        return row[1], key[0], None, None, True

    def expire(self, key, now):
        if self.accepted.exists() and max(t[0] for t in self.accepted.get()) + self.span < now * 1000:
            self.accepted.clear()
        return []


def rate_limit_stream(events: DataFrame, seconds: int = 3600, limit: int = 10, delay: str = "1 minute") -> DataFrame:
    """``rate_limited`` as a stream of ``(id, submitter, ts)``. Late rows have ``late`` set and no decision."""
    e = events.withWatermark("ts", delay).select("id", "submitter", F.unix_micros("ts").alias("us"))
    return _stateful(e, "submitter", RateLimit(seconds, limit), "id long, submitter long, recent int, refused boolean, late boolean")


# --- R2, R5 leases --------------------------------------------------------------------------------------------------


def recover_stale(jobs: DataFrame, as_of: Column, minutes: int = 60) -> DataFrame:
    """Running jobs whose lock is too old go back to retry."""
    stale = (F.col("status") == "running") & (F.col("locked_at") < as_of - F.make_dt_interval(mins=F.lit(minutes)))
    reason = F.concat(F.lit("Recovered stale lease from "), F.coalesce("locked_by", F.lit("unknown")))
    return jobs.where(stale).select("id", F.lit("retry").alias("status"), reason.alias("last_error"))


def expire_leases(leases: DataFrame, as_of: Column, minutes: int = 8, max_attempts: int = 2) -> DataFrame:
    """Leases past their time: requeued while attempts are left, failed otherwise."""
    expired = F.col("leased_at") + F.make_dt_interval(mins=F.lit(minutes)) <= as_of
    return leases.where(expired).select("task_id", F.when(F.col("attempts") < max_attempts, "queued").otherwise("failed").alias("status"))


class LeaseProcessor(InOrder):
    """Follows one task: a claim starts a lease, done ends it, and a timer ends it when time runs out.

    The number of attempts is forgotten when nothing has happened for ``forget`` milliseconds.
    """

    columns, waiting_schema, output = ("us", "seq", "kind"), "us long, seq long, kind string", ["task_id", "expired_at", "attempts", "status"]

    def __init__(self, minutes: int, max_attempts: int, forget: int):
        self.ms, self.max_attempts, self.forget = minutes * 60_000, max_attempts, forget

    def start(self, handle: StatefulProcessorHandle) -> None:
        self.lease = handle.getValueState("lease", "until long, attempts int, open boolean")

    def _row(self, key, until: int, attempts: int) -> tuple:
        return key[0], until, attempts, "queued" if attempts < self.max_attempts else "failed"

    def step(self, key, due):
        out = []
        until, attempts, is_open = self.lease.get() if self.lease.exists() else (None, 0, False)
        for us, _, kind in due:
            now = us // 1000
            if is_open and now >= until:
                out.append(self._row(key, until, attempts))
            is_open = kind == "claim"
            if is_open:
                until, attempts = now + self.ms, attempts + 1
        if until is not None:
            self.lease.update((until, attempts, is_open))
            if is_open:  # fires when the watermark reaches the lease's end
                self.handle.registerTimer(until - 1)
            self.handle.registerTimer(until + self.forget - 1)
        return out

    def late(self, key, row):
        return key[0], row[0] // 1000, None, "late"

    def expire(self, key, now):
        if not self.lease.exists():
            return []
        until, attempts, is_open = self.lease.get()
        ended = is_open and now >= until
        if now >= until + self.forget:
            self.lease.clear()
        elif ended:
            self.lease.update((until, attempts, False))
        return [self._row(key, until, attempts)] if ended else []


def lease_stream(events: DataFrame, minutes: int, max_attempts: int, delay: str = "1 minute", forget_days: int = 365) -> DataFrame:
    """Expired leases of an event stream ``(task_id, ts, seq, kind)``, kind being claim or done.

    An event later than the delay comes back with the status ``late`` and its own time.
    """
    e = events.withWatermark("ts", delay).select("task_id", F.unix_micros("ts").alias("us"), "seq", "kind")
    processor = LeaseProcessor(minutes, max_attempts, forget_days * 86_400_000)
    out = _stateful(e, "task_id", processor, "task_id long, expired_at long, attempts int, status string")
    return out.withColumn("expired_at", F.timestamp_millis("expired_at"))


# --- R3 runner lease ------------------------------------------------------------------------------------------------


def claimable_runs(runs: DataFrame, runner: str, as_of: Column, stale_seconds: int = 120) -> DataFrame:
    """Runs a runner may take: nobody's, its own, or one whose heartbeat is too old."""
    old = F.col("heartbeat_at") < as_of - F.make_dt_interval(secs=F.lit(max(30, stale_seconds)))
    free = F.col("runner_id").isNull() | (F.col("runner_id") == runner) | F.col("heartbeat_at").isNull() | old
    return runs.where(F.coalesce(free, F.lit(False))).select("id")


class RunnerLease(InOrder):
    """Decides the claims of one run in time order; the holder keeps it while its heartbeat is fresh."""

    columns, waiting_schema, output = ("us", "id", "runner"), "us long, id long, runner string", ["id", "run_id", "granted", "late"]

    def __init__(self, stale_seconds: int):
        self.span = max(30, stale_seconds) * 1_000_000

    def start(self, handle: StatefulProcessorHandle) -> None:
        self.holder = handle.getValueState("holder", "runner string, us long")

    def step(self, key, due):
        out = []
        runner, at = self.holder.get() if self.holder.exists() else (None, None)
        for us, i, who in due:
            granted = at is None or runner == who or at < us - self.span
            if granted:
                runner, at = who, us
            out.append((i, key[0], granted, False))
        self.holder.update((runner, at))
        self.handle.registerTimer((at + self.span) // 1000 + 1)
        return out

    def late(self, key, row):
        return row[1], key[0], None, True

    def expire(self, key, now):
        # from here on anybody may have the run, as if nobody had held it
        if self.holder.exists() and self.holder.get()[1] + self.span < now * 1000:
            self.holder.clear()
        return []


def runner_claims(events: DataFrame, stale_seconds: int = 120, delay: str = "1 minute") -> DataFrame:
    """Granted or refused claims ``(id, run_id, runner, ts)``; late ones have ``late`` set and no decision."""
    e = events.withWatermark("ts", delay).select("id", "run_id", "runner", F.unix_micros("ts").alias("us"))
    return _stateful(e, "run_id", RunnerLease(stale_seconds), "id long, run_id long, granted boolean, late boolean")


# --- R4 job lifecycle -----------------------------------------------------------------------------------------------


def lifecycle_status(events: DataFrame, max_attempts: int = 3) -> DataFrame:
    """Status of each job after its events ``(job_id, seq, kind)``; kinds are claim, pass and fail."""
    agg = events.groupBy("job_id").agg(F.max_by("kind", "seq").alias("kind"), F.count_if(F.col("kind") == "claim").alias("attempt"))
    failed = F.when(F.col("attempt") >= max_attempts, "needs_review").otherwise("retry")
    return agg.select("job_id", F.col("attempt").cast("int").alias("attempt"), F.when(F.col("kind") == "claim", "running").when(F.col("kind") == "pass", "pass").otherwise(failed).alias("status"))


class JobLifecycle(StatefulProcessor):
    """Folds the events of one job into its status and number of attempts.

    Attempts are a count and the status follows from the event with the greatest number, so events may come in any order.
    With ``keep`` (milliseconds), a job that has passed or waits for review is forgotten so long after its last event; an event
    behind the watermark then changes nothing and is reported as late.
    """

    def __init__(self, max_attempts: int, keep: int | None = None):
        self.max_attempts, self.keep = max_attempts, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "n int, seq long, kind string, last long")

    def _status(self, n: int, kind: str) -> str:
        return {"claim": "running", "pass": "pass"}.get(kind, "needs_review" if n >= self.max_attempts else "retry")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, seq, kind, last = self.job.get() if self.job.exists() else (0, None, "", 0)
        passed = timerValues.getCurrentWatermarkInMs() if self.keep is not None else 0
        late, taken = [], False
        for frame in rows:
            for r in frame.itertuples():
                if self.keep is not None:
                    if 0 < passed >= r.ms:
                        late.append((key[0], r.seq, None, "late"))
                        continue
                    last = max(last, r.ms)
                taken = True
                n += r.kind == "claim"
                if seq is None or r.seq > seq:
                    seq, kind = r.seq, r.kind
        if taken:
            self.job.update((n, seq, kind, last))
            if self.keep is not None and self._status(n, kind) in ("pass", "needs_review"):
                self.handle.registerTimer(last + self.keep)
        now = [(key[0], seq, n, self._status(n, kind))] if taken else []
        yield pd.DataFrame(late + now, columns=["job_id", "seq", "attempt", "status"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.job.exists():
            n, _, kind, last = self.job.get()
            if self._status(n, kind) in ("pass", "needs_review") and last + self.keep <= expiredTimerInfo.getExpiryTimeInMs():
                self.job.clear()
        yield pd.DataFrame([], columns=["job_id", "seq", "attempt", "status"])

    def close(self) -> None:
        pass


def lifecycle_stream(events: DataFrame, max_attempts: int = 3, delay: str = "1 day", keep_days: int = 90) -> DataFrame:
    """One status row per job and micro-batch; a snapshot keeps the one with the greatest ``seq`` and attempt per job.

    Events ``(job_id, seq, kind, ts)``: a job that has passed or waits for review leaves the state ``keep_days`` after its last
    event; an event later than ``delay`` comes back with the status ``late``, no attempt and its own ``seq``. What comes in time
    after that begins the job anew. Events without ``ts`` have no time to forget by: every job stays, as in the snapshot itself.
    """
    schema = "job_id long, seq long, attempt int, status string"
    if "ts" not in events.columns:
        return _stateful(events.select("job_id", "seq", "kind"), "job_id", JobLifecycle(max_attempts), schema, timers=False)
    e = events.withWatermark("ts", delay).select("job_id", "seq", "kind", F.unix_millis("ts").alias("ms"))
    return _stateful(e, "job_id", JobLifecycle(max_attempts, keep_days * 86_400_000), schema)


# --- R6 - R10 -------------------------------------------------------------------------------------------------------


def stalled_runs(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs with nothing left to run that are unfinished because documents wait for review or failed."""
    doc = F.col("source_document_id")
    c = jobs.groupBy(F.col("run_id").alias("id")).agg(
        F.count_if(F.col("status").isin("queued", "running", "retry")).alias("runnable"),
        F.countDistinct(F.when(F.col("status") == "needs_review", doc)).alias("review"),
        F.countDistinct(F.when(F.col("status") == "failed", doc)).alias("failed"),
    )
    j = c.join(runs.select("id", "scope_count", "completed_count"), "id")
    stalled = (F.col("runnable") == 0) & (F.col("completed_count") < F.col("scope_count")) & ((F.col("review") > 0) | (F.col("failed") > 0))
    return j.select("id", "runnable", "review", "failed", F.when(stalled, "paused").otherwise("running").alias("status"))


def status_counts_stream(jobs: DataFrame) -> DataFrame:
    """Running numbers of runnable, review and failed jobs per run (complete mode)."""
    s = F.col("status")
    return jobs.groupBy("run_id").agg(
        F.count_if(s.isin("queued", "running", "retry")).alias("runnable"), F.count_if(s == "needs_review").alias("review"), F.count_if(s == "failed").alias("failed")
    )


def activity_feed(proposals: DataFrame, docs: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Accepted proposals on published documents as they arrive; ``docs(source_document_id, source_title)`` is static."""
    return proposals.withWatermark("created_at", delay).where(F.col("status") == "accepted").join(docs, "source_document_id")


def ingest_dedupe(captures: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """First capture per key within the delay."""
    return captures.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def window_counts(events: DataFrame, ts: str, delay: str, size: str, slide: str | None = None) -> DataFrame:
    """Rows per time window and kind; late rows beyond the delay are dropped."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    agg = events.withWatermark(ts, delay).groupBy(w.alias("w"), "status").agg(F.count("*").alias("n"))
    return agg.select(F.col("w.start").alias("start"), "status", "n")


def session_counts(events: DataFrame, key: str, ts: str, delay: str, gap: str) -> DataFrame:
    """Rows per activity session of a key."""
    agg = events.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return agg.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def incremental_ingest(docs: DataFrame, parse: Callable[[DataFrame], DataFrame], keys: list[str], name: str) -> DataFrame:
    """Parse the files that arrived since the last run and merge the result into the snapshot."""
    return run_upserts(parse(docs), name, keys, mode="append")
