"""W*, T3, T4, T7: ranking and ordered numbering."""

from pyspark.sql import functions as F

from ..operators import ranking as r
from .registry import query

STAGE = "CASE stage WHEN 'raw' THEN 1 WHEN 'source_render' THEN 2 WHEN 'translation' THEN 3 WHEN 'en_render' THEN 4 WHEN 'publish' THEN 5 WHEN 'integration_qa' THEN 6 ELSE 99 END"


@query("w1_next_job", f"""
SELECT id, run_id, stage FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY {STAGE}, updated_at, source_title) AS rn FROM pipeline_jobs WHERE status IN ('queued', 'retry')) WHERE rn = 1""")
def _(t):
    return r.next_jobs(t.pipeline_jobs).select("id", "run_id", "stage")


@query("w1_claim_batch", f"""
SELECT id, run_id, stage, 'running' AS status, attempt + 1 AS attempt, 'w1' AS locked_by FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY {STAGE}, updated_at, source_title) AS rn FROM pipeline_jobs WHERE status IN ('queued', 'retry')) WHERE rn <= 5""")
def _(t):
    return r.claim(t.pipeline_jobs, "w1", F.lit("2024-01-01").cast("timestamp"), 5).drop("locked_at")


@query("w2_best_relation", """
SELECT to_title, score, position, anchor_text FROM (SELECT *, row_number() OVER (PARTITION BY to_title ORDER BY score DESC, position, anchor_text) AS rn FROM doc_links) WHERE rn = 1""")
def _(t):
    return r.first_by(t.doc_links, ["to_title"], [-F.col("score"), F.col("position"), F.col("anchor_text")], ["score", "position", "anchor_text"])


LINK_ROWS = """SELECT from_id, to_title, CASE crawl_mode WHEN 'skip' THEN 99 ELSE CASE source_area WHEN 'toc' THEN 5 ELSE 35 END END AS tier,
 CASE WHEN source_area = 'toc' THEN position END AS toc_order, score AS priority, crawl_mode, position AS dom_order FROM doc_links"""


@query("w3_best_link", f"""
SELECT from_id, to_title, tier, priority, dom_order FROM (SELECT *, row_number() OVER (PARTITION BY from_id, to_title ORDER BY tier, coalesce(toc_order, 2147483647), priority DESC, CASE crawl_mode WHEN 'expand' THEN 3 ELSE 1 END DESC, dom_order) AS rn
FROM ({LINK_ROWS})) WHERE rn = 1""")
def _(t):
    return r.best_link(t.sql(LINK_ROWS), ["from_id", "to_title"])


INBOUND = """SELECT to_title, CASE WHEN source_area = 'toc' AND crawl_mode = 'expand' THEN 'subdocument' WHEN source_area = 'toc' THEN 'member' WHEN crawl_mode = 'expand' THEN 'related' ELSE 'agency' END AS relation,
 score AS priority, from_id * 10 + position AS pos FROM doc_links"""
RANKED = f"SELECT *, CASE relation WHEN 'subdocument' THEN 5 WHEN 'member' THEN 4 WHEN 'core_kpop_document' THEN 3 WHEN 'related' THEN 2 ELSE 1 END AS rank FROM ({INBOUND})"


@query("w4_best_inbound", f"""
SELECT to_title, rank, priority, pos FROM (SELECT *, row_number() OVER (PARTITION BY to_title ORDER BY rank DESC, priority DESC, pos) AS rn FROM ({RANKED})) WHERE rn = 1""")
def _(t):
    return r.best_inbound(t.sql(INBOUND).withColumn("rank", r.relation_rank(F.col("relation"))), "to_title")


CANON = "SELECT id, title, canonical, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * CAST(weight AS INT) AS ts FROM link_titles"


@query("w5_latest_canonical", f"""
SELECT title, id, canonical FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY CASE WHEN canonical THEN 0 ELSE 1 END, ts DESC, id) AS rn FROM ({CANON})) WHERE rn = 1""")
def _(t):
    return r.latest_canonical(t.sql(CANON).withColumn("ts", F.col("ts").cast("timestamp")), "title")


@query("w6_latest_runs", """
SELECT root_title, id, status FROM (SELECT *, row_number() OVER (PARTITION BY root_title ORDER BY created_at DESC, id) AS rn FROM pipeline_runs) WHERE rn = 1 ORDER BY created_at DESC, root_title LIMIT 80""")
def _(t):
    runs = t.pipeline_runs.withColumn("created_at", F.col("created_at").cast("timestamp"))
    return r.latest_runs(runs).select("root_title", "id", "status")


SAVES = "SELECT id AS save_id, source_document_id, created_at FROM edit_proposals"


@query("w7_next_revision", f"""
WITH s AS ({SAVES}) SELECT save_id, s.source_document_id, d.content_revision_no + row_number() OVER (PARTITION BY s.source_document_id ORDER BY s.created_at, save_id) AS revision_no FROM s JOIN wiki_docs d ON d.id = s.source_document_id""")
def _(t):
    return r.next_revisions(t.sql(SAVES), t.wiki_docs).select("save_id", "source_document_id", "revision_no")


@query("w8_revision_history", """
SELECT source_document_id, revision_no FROM (SELECT *, row_number() OVER (PARTITION BY source_document_id ORDER BY revision_no DESC) AS rn FROM revisions) WHERE rn <= 50""")
def _(t):
    return r.revision_history(t.revisions).select("source_document_id", "revision_no")


EVENTS = "SELECT l_orderkey AS doc, CAST(round(l_extendedprice * 100) AS BIGINT) AS pos, l_returnflag AS value FROM lineitem"


@query("w9_without_repeats", f"""
SELECT doc, pos, value FROM (SELECT *, lag(value) OVER (PARTITION BY doc ORDER BY pos) AS p, row_number() OVER (PARTITION BY doc ORDER BY pos) AS rn FROM ({EVENTS})) WHERE rn = 1 OR value IS DISTINCT FROM p""")
def _(t):
    return r.without_repeats(t.sql(EVENTS), "doc", "pos", "value")


LABELS = "SELECT l_orderkey AS doc, CAST(l_linenumber % 2 AS INT) AS section, 't' || CAST(l_suppkey % 3 AS STRING) AS target, CASE WHEN l_tax > 0.04 THEN 'a/' ELSE 'a' END || l_shipdate AS label, CAST(round(l_extendedprice * 100) AS BIGINT) AS pos FROM (SELECT l_orderkey, l_linenumber, l_suppkey, l_tax, l_extendedprice, CAST(l_partkey AS STRING) AS l_shipdate FROM lineitem)"


@query("w13_best_label", f"""
SELECT doc, section, target, label, label_score FROM (SELECT *, CAST(CASE WHEN contains(label, '/') THEN 100 ELSE 0 END + length(label) AS INT) AS label_score, row_number() OVER (PARTITION BY doc, section, target ORDER BY CASE WHEN contains(label, '/') THEN 100 ELSE 0 END + length(label) DESC, pos) AS rn FROM ({LABELS})) WHERE rn = 1""")
def _(t):
    return r.best_label(t.sql(LABELS), ["doc", "section", "target"])


@query("t3_core_top", "SELECT root_title, id, score FROM (SELECT *, row_number() OVER (PARTITION BY root_title ORDER BY weight DESC, score DESC, title, id) AS rn FROM (SELECT id, root_title, title, weight, revision_no AS score FROM link_titles)) WHERE rn <= 40")
def _(t):
    d = t.sql("SELECT id, root_title, title, weight, revision_no AS score FROM link_titles")
    return r.top_rows(d, ["root_title"], [F.col("weight").desc(), F.col("score").desc(), F.col("title"), F.col("id")], 40).select("root_title", "id", "score")


@query("t7_oldest_work", """
SELECT id, coalesce(strftime(locked_at, '%Y-%m-%d'), '') AS locked_at FROM (SELECT id, locked_at FROM pipeline_jobs WHERE status IN ('running', 'queued') ORDER BY locked_at ASC NULLS FIRST, id LIMIT 12)""")
def _(t):
    d = t.pipeline_jobs.where("status IN ('running', 'queued')").orderBy(F.col("locked_at").asc_nulls_first(), "id").limit(12)
    return d.select("id", F.coalesce(F.date_format("locked_at", "yyyy-MM-dd"), F.lit("")).alias("locked_at"))
