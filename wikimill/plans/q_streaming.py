"""R*: batch forms and streaming jobs. Streams read the given Parquet files; results are compared with the same SQL."""

from pyspark.sql import functions as F

from ..streaming import jobs as r
from .registry import query

AS_OF = "TIMESTAMP '2024-01-10 00:10:00'"


def as_of():
    return F.lit("2024-01-10 00:10:00").cast("timestamp")


def seconds(df, column):
    return df.withColumn(column, F.date_format(column, "yyyy-MM-dd HH:mm:ss"))


TRAILING = """
SELECT id, submitter, CAST((SELECT count(*) FROM edit_proposals b WHERE b.submitter = a.submitter AND b.created_at >= a.created_at - INTERVAL '1' HOUR AND (b.created_at < a.created_at OR (b.created_at = a.created_at AND b.id < a.id))) AS INT) AS recent FROM edit_proposals a"""
ACCEPTED = """
WITH RECURSIVE e AS (SELECT id, submitter, created_at AS ts, row_number() OVER (PARTITION BY submitter ORDER BY created_at, id) AS n FROM edit_proposals),
w AS (SELECT id, submitter, n, ts, CAST(0 AS INT) AS recent, [ts] AS kept FROM e WHERE n = 1 UNION ALL
 SELECT id, submitter, n, ts, CAST(len(live) AS INT) AS recent, CASE WHEN len(live) >= 2 THEN live ELSE list_append(live, ts) END AS kept
 FROM (SELECT e.id, e.submitter, e.n, e.ts, list_filter(w.kept, lambda x: x >= e.ts - INTERVAL '1' HOUR) AS live FROM w JOIN e ON e.submitter = w.submitter AND e.n = w.n + 1))
SELECT id, submitter, recent, recent >= 2 AS refused{late} FROM w{where}"""
PASSED = " WHERE epoch_ms(ts) <= (SELECT epoch_ms(max(created_at)) - 60000 FROM edit_proposals)"


@query("r1_trailing_attempts", TRAILING)
def _(t):
    d = r.trailing_counts(t.edit_proposals.select("id", "submitter", "created_at"), "submitter", "created_at")
    return d.select("id", "submitter", F.col("recent").cast("int").alias("recent"))


@query("r1_rate_limit", ACCEPTED.format(late="", where=""))
def _(t):
    return r.rate_limited(t.edit_proposals.select("id", "submitter", "created_at"), "submitter", "created_at", 3600, 2)


def proposals(t):
    e = r.read_stream(t.spark, t.dir, "events.parquet")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("submitter"), F.col("ts").cast("timestamp").alias("ts"))


@query("r1_rate_limit_stream", ACCEPTED.format(late=", false AS late", where=PASSED))
def _(t):
    return r.run_to_files(r.rate_limit_stream(proposals(t), 3600, 2), "r1")


LOCKS = "SELECT id, CASE WHEN id % 3 = 0 THEN 'running' ELSE 'queued' END AS status, runner_id AS locked_by, heartbeat_at AS locked_at FROM pipeline_runs"


@query("r2_stale_recovery", f"""
SELECT id, 'retry' AS status, 'Recovered stale lease from ' || coalesce(locked_by, 'unknown') AS last_error FROM ({LOCKS}) WHERE status = 'running' AND locked_at < {AS_OF} - INTERVAL '5' MINUTE""")
def _(t):
    return r.recover_stale(t.sql(LOCKS), as_of(), 5)


LEASE_EVENTS = "SELECT user_id AS task_id, ts, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'done' ELSE 'claim' END AS kind FROM events"
LEASE_SQL = """
WITH e AS ({events}), f AS (SELECT *, count_if(kind = 'claim') OVER (PARTITION BY task_id ORDER BY ts, seq) AS attempts, lead(ts) OVER (PARTITION BY task_id ORDER BY ts, seq) AS nxt FROM e),
m AS (SELECT max(ts) AS top FROM e)
SELECT task_id, strftime(ts + INTERVAL '{minutes}' MINUTE, '%Y-%m-%d %H:%M:%S') AS expired_at, CAST(attempts AS INT) AS attempts, CASE WHEN attempts < {budget} THEN 'queued' ELSE 'failed' END AS status
FROM f, m WHERE kind = 'claim' AND epoch_ms(ts) + {minutes} * 60000 <= least(coalesce(epoch_ms(nxt), epoch_ms(top) - 60000), epoch_ms(top) - 60000)"""


def lease_events(t):
    e = r.read_stream(t.spark, t.dir, "events.parquet")
    kind = F.when(F.col("event_type").isin("purchase", "error"), "done").otherwise("claim")
    return e.select(F.col("user_id").alias("task_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), kind.alias("kind"))


@query("r2_stale_recovery_stream", LEASE_SQL.format(events=LEASE_EVENTS, minutes=60, budget=1000000))
def _(t):
    return seconds(r.run_to_files(r.lease_stream(lease_events(t), 60, 1_000_000), "r2"), "expired_at")


@query("r3_runner_lease", f"SELECT id FROM pipeline_runs WHERE runner_id IS NULL OR runner_id = 'runner1' OR heartbeat_at IS NULL OR heartbeat_at < {AS_OF} - INTERVAL '120' SECOND")
def _(t):
    return r.claimable_runs(t.pipeline_runs, "runner1", as_of())


@query("r3_runner_lease_stream", """
WITH RECURSIVE e AS (SELECT event_id AS id, user_id AS run_id, event_type AS runner, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
w AS (SELECT id, run_id, n, true AS granted, runner AS holder, ts AS at FROM e WHERE n = 1 UNION ALL
 SELECT e.id, e.run_id, e.n, w.holder = e.runner OR w.at < e.ts - INTERVAL '7200' SECOND, CASE WHEN w.holder = e.runner OR w.at < e.ts - INTERVAL '7200' SECOND THEN e.runner ELSE w.holder END,
  CASE WHEN w.holder = e.runner OR w.at < e.ts - INTERVAL '7200' SECOND THEN e.ts ELSE w.at END FROM w JOIN e ON e.run_id = w.run_id AND e.n = w.n + 1)
SELECT id, run_id, granted, false AS late FROM w JOIN e USING (id, run_id, n) WHERE epoch_ms(e.ts) <= (SELECT epoch_ms(max(ts)) - 60000 FROM events)""")
def _(t):
    e = r.read_stream(t.spark, t.dir, "events.parquet")
    e = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("run_id"), F.col("event_type").alias("runner"), F.col("ts").cast("timestamp").alias("ts"))
    return r.run_to_files(r.runner_claims(e, 7200), "r3")


LIFE = "SELECT user_id AS job_id, event_id AS seq, CASE event_type WHEN 'view' THEN 'claim' WHEN 'click' THEN 'claim' WHEN 'purchase' THEN 'pass' ELSE 'fail' END AS kind FROM events"
LIFE_SQL = f"""
SELECT job_id, attempt, CASE WHEN kind = 'claim' THEN 'running' WHEN kind = 'pass' THEN 'pass' WHEN attempt >= 30 THEN 'needs_review' ELSE 'retry' END AS status
FROM (SELECT job_id, arg_max(kind, seq) AS kind, CAST(count_if(kind = 'claim') AS INT) AS attempt FROM ({LIFE}) GROUP BY 1)"""


@query("r4_job_lifecycle", LIFE_SQL)
def _(t):
    return r.lifecycle_status(t.sql(LIFE), 30)


@query("r4_job_lifecycle_stream", LIFE_SQL)
def _(t):
    e = r.read_stream(t.spark, t.dir, "events.parquet")
    kind = F.when(F.col("event_type").isin("view", "click"), "claim").when(F.col("event_type") == "purchase", "pass").otherwise("fail")
    e = e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), kind.alias("kind"), F.col("ts").cast("timestamp").alias("ts"))
    out = r.run_to_files(r.lifecycle_stream(e, 30, keep_days=365), "r4").where("status <> 'late'")
    return out.groupBy("job_id").agg(F.max_by(F.struct("attempt", "status"), "seq").alias("s")).select("job_id", "s.attempt", "s.status")


LEASES = "SELECT o_orderkey AS task_id, TIMESTAMP '2024-01-10 00:00:00' + INTERVAL '1' SECOND * CAST(o_custkey % 600 AS INT) AS leased_at, CAST(1 + o_orderkey % 3 AS INT) AS attempts FROM orders"


@query("r5_lease_expiry", f"SELECT task_id, CASE WHEN attempts < 2 THEN 'queued' ELSE 'failed' END AS status FROM ({LEASES}) WHERE leased_at + INTERVAL '8' MINUTE <= {AS_OF}")
def _(t):
    return r.expire_leases(t.sql(LEASES).withColumn("leased_at", F.col("leased_at").cast("timestamp")), as_of())


@query("r5_lease_expiry_stream", LEASE_SQL.format(events=LEASE_EVENTS, minutes=8, budget=2))
def _(t):
    return seconds(r.run_to_files(r.lease_stream(lease_events(t), 8, 2), "r5"), "expired_at")


STALL_JOBS = "SELECT c_custkey % 60 AS run_id, c_custkey AS source_document_id, CASE WHEN c_custkey % 60 < 20 THEN 'pass' WHEN c_custkey % 60 < 40 THEN CASE WHEN c_custkey % 7 = 0 THEN 'needs_review' ELSE 'failed' END ELSE 'queued' END AS status FROM customer"
STALL_RUNS = "SELECT n_nationkey + 10 AS id, 30 AS scope_count, CAST(n_nationkey * 2 AS INT) AS completed_count FROM nation"


@query("r6_stalled_runs", f"""
WITH c AS (SELECT run_id AS id, CAST(count_if(status IN ('queued', 'running', 'retry')) AS BIGINT) AS runnable, count(DISTINCT CASE WHEN status = 'needs_review' THEN source_document_id END) AS review, count(DISTINCT CASE WHEN status = 'failed' THEN source_document_id END) AS failed FROM ({STALL_JOBS}) GROUP BY 1)
SELECT id, runnable, review, failed, CASE WHEN runnable = 0 AND completed_count < scope_count AND (review > 0 OR failed > 0) THEN 'paused' ELSE 'running' END AS status FROM c JOIN ({STALL_RUNS}) u USING (id)""")
def _(t):
    return r.stalled_runs(t.sql(STALL_JOBS), t.sql(STALL_RUNS))


@query("r6_status_counts_stream", f"""
SELECT run_id, CAST(count_if(status IN ('queued', 'running', 'retry')) AS BIGINT) AS runnable, CAST(count_if(status = 'needs_review') AS BIGINT) AS review, CAST(count_if(status = 'failed') AS BIGINT) AS failed FROM ({STALL_JOBS}) GROUP BY 1""")
def _(t):
    c = r.read_stream(t.spark, t.dir, "customer.parquet")
    k = F.col("c_custkey")
    status = F.when(k % 60 < 20, "pass").when((k % 60 < 40) & (k % 7 == 0), "needs_review").when(k % 60 < 40, "failed").otherwise("queued")
    return r.run_upserts(r.status_counts_stream(c.select((k % 60).alias("run_id"), status.alias("status"))), "r6", ["run_id"], mode="complete")


def proposal_stream(t):
    e = r.read_stream(t.spark, t.dir, "events.parquet")
    status = F.when(F.col("event_type") == "purchase", "accepted").when(F.col("event_type") == "error", "rejected").when(F.col("event_type") == "view", "superseded").otherwise("pending")
    return e.select(F.col("event_id").alias("id"), (F.col("user_id") % 50).alias("source_document_id"), F.col("user_id").alias("submitter"), F.col("ts").cast("timestamp").alias("created_at"), status.alias("status"))


@query("r7_activity_feed_stream", """
SELECT p.id, d.source_title FROM edit_proposals p JOIN wiki_docs d ON d.id = p.source_document_id WHERE p.status = 'accepted' AND d.source = 'mirror' AND coalesce(d.published_revision_no, 0) > 0 AND d.published_html IS NOT NULL""")
def _(t):
    live = t.wiki_docs.where("source = 'mirror' AND coalesce(published_revision_no, 0) > 0 AND published_html IS NOT NULL")
    feed = r.activity_feed(proposal_stream(t), live.select(F.col("id").alias("source_document_id"), "source_title"))
    return r.run_to_files(feed.select("id", "source_title"), "r7")


@query("r8_ingest_dedupe_stream", "SELECT DISTINCT user_id % 50 AS source_document_id, user_id AS submitter, event_type FROM events")
def _(t):
    e = r.read_stream(t.spark, t.dir, "events.parquet")
    e = e.select((F.col("user_id") % 50).alias("source_document_id"), F.col("user_id").alias("submitter"), "event_type", F.col("ts").cast("timestamp").alias("ts"))
    out = r.ingest_dedupe(e, ["source_document_id", "submitter", "event_type"], "ts", "1 day")
    return r.run_to_files(out.drop("ts"), "r8")


CLOSED = "(SELECT max(created_at) - INTERVAL '10' MINUTE FROM edit_proposals)"


@query("r9_tumbling_counts_stream", f"""
SELECT strftime(date_trunc('hour', created_at), '%Y-%m-%d %H:%M:%S') AS start, status, count(*) AS n FROM edit_proposals WHERE date_trunc('hour', created_at) + INTERVAL '1' HOUR <= {CLOSED} GROUP BY 1, 2""")
def _(t):
    d = r.run_to_files(r.window_counts(proposal_stream(t), "created_at", "10 minutes", "1 hour"), "r9")
    return d.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "status", "n")


@query("r9_sliding_counts_stream", f"""
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, status, count(*) AS n FROM (SELECT *, unnest([date_trunc('hour', created_at) - INTERVAL '1' HOUR, date_trunc('hour', created_at)]) AS s FROM edit_proposals) WHERE s + INTERVAL '2' HOUR <= {CLOSED} GROUP BY 1, 2""")
def _(t):
    d = r.run_to_files(r.window_counts(proposal_stream(t), "created_at", "10 minutes", "2 hours", "1 hour"), "r9s")
    return d.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "status", "n")


@query("r9_session_counts_stream", f"""
WITH g AS (SELECT *, CASE WHEN created_at >= lag(created_at) OVER w + INTERVAL '30' MINUTE OR lag(created_at) OVER w IS NULL THEN 1 ELSE 0 END AS brk FROM edit_proposals WINDOW w AS (PARTITION BY submitter ORDER BY created_at)),
s AS (SELECT *, sum(brk) OVER (PARTITION BY submitter ORDER BY created_at) AS sid FROM g)
SELECT submitter, strftime(min(created_at), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY submitter, sid HAVING max(created_at) + INTERVAL '30' MINUTE <= {CLOSED}""")
def _(t):
    d = r.run_to_files(r.session_counts(proposal_stream(t), "submitter", "created_at", "10 minutes", "30 minutes"), "r9g")
    return d.select("submitter", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("r10_incremental_ingest_stream", "SELECT doc_id, lang, length(text) AS n, md5(text) AS digest FROM documents")
def _(t):
    d = r.read_stream(t.spark, t.dir, "documents.parquet")
    parse = lambda x: x.select("doc_id", "lang", F.length("text").alias("n"), F.md5(F.col("text").cast("binary")).alias("digest"))
    return r.incremental_ingest(d, parse, ["doc_id"], "r10")
