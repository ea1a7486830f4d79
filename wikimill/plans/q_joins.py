"""J*: joins and lookups."""

from pyspark.sql import functions as F

from ..operators import joins as j
from .q_search import PUBLISHED
from .registry import query

REQUESTS = "SELECT doc_id AS request_id, CASE WHEN doc_id % 3 = 0 THEN lower('G' || CAST(doc_id % 20 AS STRING) || '/S' || CAST(doc_id AS STRING)) ELSE 'G' || CAST(doc_id % 20 AS STRING) || '/S' || CAST(doc_id AS STRING) END AS title FROM documents"


@query("j1_point_lookup", f"""
WITH r AS ({REQUESTS}), x AS (SELECT r.request_id, d.id, d.source_title, row_number() OVER (PARTITION BY r.request_id ORDER BY CASE WHEN d.source_title = r.title THEN 0 ELSE 1 END, d.source_title, d.id) AS rn
 FROM r JOIN wiki_docs d ON lower(d.source_title) = lower(r.title) WHERE {PUBLISHED})
SELECT request_id, id, source_title FROM x WHERE rn = 1""")
def _(t):
    return j.point_lookup(t.sql(REQUESTS), t.wiki_docs, "mirror")


ASSET_ROWS = "SELECT id, id % 300 AS source_document_id, asset_type, source_ref, label, status, resolved_url, storage_path FROM asset_queue"


@query("j2_page_assets", f"""
WITH a AS ({ASSET_ROWS}), r AS (SELECT *, row_number() OVER (PARTITION BY source_document_id ORDER BY source_ref, id) AS rn FROM a WHERE asset_type = 'image' AND status = 'resolved'),
g AS (SELECT source_document_id, count(*) AS n, string_agg('{{"source_ref":"' || source_ref || '"' || CASE WHEN label IS NULL THEN '' ELSE ',"label":"' || label || '"' END || ',"status":"resolved","resolved_url":"' || resolved_url || '"'
  || CASE WHEN storage_path IS NULL THEN '' ELSE ',"storage_path":"' || storage_path || '"' END || '}}', ',' ORDER BY rn) AS items FROM r WHERE rn <= 500 GROUP BY 1)
SELECT d.id, d.source_title, coalesce(g.n, 0) AS n_assets, '[' || coalesce(g.items, '') || ']' AS assets FROM wiki_docs d LEFT JOIN g ON g.source_document_id = d.id WHERE {PUBLISHED}""")
def _(t):
    return j.pages_with_assets(t.wiki_docs, t.sql(ASSET_ROWS), "mirror")


@query("j5_verified_storage", "SELECT id, storage_path FROM asset_queue WHERE storage_path IN (SELECT path FROM storage_listing)")
def _(t):
    return j.verified(t.asset_queue, t.storage_listing).select("id", "storage_path")


@query("j6_orphan_objects", "SELECT path FROM storage_listing WHERE path NOT IN (SELECT storage_path FROM asset_queue WHERE storage_path IS NOT NULL)")
def _(t):
    return j.orphans(t.storage_listing, t.asset_queue)


EDGES = "SELECT from_id, to_title, CASE WHEN from_id % 10 = 0 THEN CAST(-1 AS BIGINT) END AS to_id, position FROM doc_links"


@query("j13_link_backfill", f"""
WITH e AS ({EDGES}), d AS (SELECT title, min(id) AS did FROM link_titles GROUP BY 1)
SELECT from_id, position, to_title, CAST(coalesce(to_id, did, 0) AS BIGINT) AS to_id FROM e LEFT JOIN d ON d.title = e.to_title""")
def _(t):
    out = j.backfill_links(t.sql(EDGES), t.link_titles)
    return out.select("from_id", "position", "to_title", F.coalesce("to_id", F.lit(0)).alias("to_id"))


LINKS14 = "SELECT id, current_title AS root_title, CASE WHEN id % 4 = 0 THEN current_title || '/S' || CAST(id % 900 AS STRING) WHEN id % 4 = 1 THEN target || ' (' || current_title || ')' ELSE target END AS target FROM plain_links"
SOURCES14 = "SELECT source_title, root_title, CASE WHEN id % 2 = 0 THEN id END AS document_id FROM wiki_docs"
DOCS14 = "SELECT id AS document_id, 'slug-' || CAST(id AS STRING) AS slug, CASE WHEN id % 3 = 0 THEN 'draft' ELSE 'published' END AS status FROM wiki_docs WHERE content_revision_no > 0"
GENERIC = r"""(regexp_matches(target, '(?i)^(?:\d{4}년|\d{1,2}월(?:\s*\d{1,2}일)?|SBS|MBC|KBS|JTBC|tvN|엠넷|Mnet|유튜브|YouTube|Instagram|X|트위터|OST|가수|아이돌|대한민국|일본|미국)$') OR regexp_matches(target, '(?i)(?:^|/)(?:참가자|\d+회|FINAL)$'))"""


@query("j14_target_disposition", f"""
WITH l AS ({LINKS14}), s AS ({SOURCES14}), d AS ({DOCS14}),
x AS (SELECT l.id, l.target, l.root_title, s.root_title AS sroot, d.slug, d.status FROM l LEFT JOIN s ON s.source_title = l.target LEFT JOIN d ON d.document_id = s.document_id),
y AS (SELECT *, CASE WHEN slug IS NOT NULL THEN 1 WHEN sroot = root_title THEN 2 WHEN target = root_title OR starts_with(target, root_title || '/') OR contains(target, '(' || root_title || ')') OR contains(target, '[' || root_title || ']') THEN 3 WHEN {GENERIC} THEN 4 ELSE 5 END AS c FROM x)
SELECT id, target, CASE c WHEN 1 THEN 'internal' WHEN 2 THEN 'internal_pending' WHEN 3 THEN 'crawl_candidate' ELSE 'plain_text' END AS disposition,
 CASE WHEN c > 1 THEN '' WHEN status = 'published' THEN '/wiki/' || slug ELSE '/admin/drafts/' || slug END AS url, CAST(CASE c WHEN 1 THEN 1.0 WHEN 2 THEN 0.95 WHEN 3 THEN 0.9 WHEN 4 THEN 0.98 ELSE 0.82 END AS DOUBLE) AS confidence FROM y""")
def _(t):
    return j.target_disposition(t.sql(LINKS14), t.sql(SOURCES14), t.sql(DOCS14))


REQ = "SELECT o_orderkey AS req_id, o_orderkey % 1200 AS source_document_id FROM orders"


@query("j15_requirement_documents", f"""
SELECT r.req_id, r.source_document_id, CASE WHEN d.id IS NULL THEN 'missing_source_document' ELSE '' END AS blocker FROM ({REQ}) r LEFT JOIN wiki_docs d ON d.id = r.source_document_id""")
def _(t):
    return j.requirements_with_documents(t.sql(REQ), t.wiki_docs).select("req_id", "source_document_id", "blocker")


@query("j16_recent_activity", """
SELECT p.id, d.source_title, strftime(p.created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM edit_proposals p JOIN wiki_docs d ON d.id = p.source_document_id
WHERE p.status = 'accepted' AND d.source = 'mirror' AND coalesce(d.published_revision_no, 0) > 0 AND d.published_html IS NOT NULL ORDER BY p.created_at DESC, p.id LIMIT 30""")
def _(t):
    return j.recent_activity(t.edit_proposals, t.wiki_docs, "mirror").select("id", "source_title", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


@query("t5_recent_proposals", """
SELECT id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM (SELECT id, created_at FROM edit_proposals WHERE status = 'accepted' ORDER BY created_at DESC, id LIMIT 30)""")
def _(t):
    p = t.edit_proposals.where("status = 'accepted'").orderBy(F.col("created_at").desc(), "id").limit(30)
    return p.select("id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


RENDERS = "SELECT id, content_rendered_at AS rendered_at FROM render_docs WHERE content_rendered_at IS NOT NULL"
REFS = "SELECT doc_id AS id, 'file' AS kind, CAST(doc_id % 300 AS STRING) AS ref_key FROM required_files UNION ALL SELECT id, 'template' AS kind, CAST(id % 31 AS STRING) AS ref_key FROM render_docs"
CHANGES = """SELECT 'file' AS kind, CAST(o_orderkey % 300 AS STRING) AS ref_key, TIMESTAMP '2024-03-01 00:00:00' + INTERVAL '1' HOUR * CAST(o_orderkey % 300 AS INT) AS ts FROM orders
UNION ALL SELECT 'template' AS kind, CAST(o_custkey % 37 AS STRING) AS ref_key, TIMESTAMP '2024-03-01 00:00:00' + INTERVAL '1' HOUR * CAST(o_custkey % 37 * 3 AS INT) AS ts FROM orders"""


@query("j17_dependency_freshness", f"""
WITH rn AS ({RENDERS}), rf AS (SELECT DISTINCT * FROM ({REFS})), ch AS (SELECT kind, ref_key, max(ts) AS dep_ts FROM ({CHANGES}) GROUP BY 1, 2)
SELECT rn.id, count_if(dep_ts > rendered_at) AS newer, strftime(max(dep_ts), '%Y-%m-%d %H:%M:%S') AS latest_at FROM rf JOIN ch USING (kind, ref_key) JOIN rn USING (id) GROUP BY 1""")
def _(t):
    out = j.stale_dependencies(t.sql(RENDERS), t.sql(REFS), t.sql(CHANGES))
    return out.select("id", F.col("newer").cast("bigint").alias("newer"), F.date_format("latest_at", "yyyy-MM-dd HH:mm:ss").alias("latest_at"))


BLOCKS = """SELECT l_orderkey AS doc_id, CAST(l_linenumber % 3 AS INT) AS section, CAST(round(l_extendedprice * 100) AS BIGINT) AS pos,
 CASE l_linenumber % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'internal-link' WHEN 2 THEN 'image' ELSE 'paragraph' END AS type, 'r' || CAST(l_partkey % 50 AS STRING) AS ref FROM lineitem"""
ASSETS18 = """SELECT p_partkey AS asset_id, CASE WHEN p_partkey % 2 = 0 THEN 'image' ELSE 'internal_link' END AS asset_type, 'r' || CAST(p_partkey % 60 AS STRING) AS source_ref,
 CASE p_partkey % 3 WHEN 0 THEN 'resolved' WHEN 1 THEN 'skipped' ELSE 'pending' END AS status, CASE WHEN p_partkey % 5 > 0 THEN 'p' || CAST(p_partkey % 4 AS STRING) END AS storage_path,
 CASE WHEN p_partkey % 7 > 0 THEN '/wiki/s' || CAST(p_partkey AS STRING) END AS resolved_url FROM part"""


@query("j18_block_hydration", f"""
WITH a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset_type, source_ref ORDER BY asset_id DESC) AS k FROM ({ASSETS18})) WHERE k = 1),
b AS (SELECT b.*, a.status, coalesce(a.storage_path, a.resolved_url) AS stored, a.resolved_url FROM ({BLOCKS}) b LEFT JOIN a ON a.source_ref = b.ref AND a.asset_type = CASE b.type WHEN 'internal-link' THEN 'internal_link' ELSE b.type END),
c AS (SELECT *, type = 'image' AND coalesce(status = 'resolved', false) AND stored IS NOT NULL AS shown FROM b),
d AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section, shown, stored ORDER BY pos) AS rn FROM c)
SELECT doc_id, section, pos, CASE WHEN type = 'internal-link' AND coalesce(status = 'skipped', false) THEN 'paragraph' ELSE type END AS type, ref,
 CASE WHEN shown THEN 'resolved' WHEN type = 'image' THEN 'placeholder' WHEN type = 'internal-link' AND coalesce(status = 'skipped', false) THEN 'as_text' WHEN coalesce(status = 'resolved', false) AND resolved_url IS NOT NULL THEN 'resolved' ELSE 'kept' END AS outcome
FROM d WHERE (shown AND rn = 1) OR (NOT shown AND NOT (type = 'image' AND coalesce(status = 'skipped', false)))""")
def _(t):
    return j.hydrate_blocks(t.sql(BLOCKS), t.sql(ASSETS18))


CELLS = "SELECT doc_id AS id, 'k' || CAST(doc_id % 400 AS STRING) AS label, CASE WHEN doc_id % 3 = 0 THEN 'v' ELSE '' END AS value FROM documents"
CANDS = "SELECT 'k' || CAST(p_partkey % 300 AS STRING) AS label, CASE WHEN p_partkey % 300 < 150 THEN 'same' ELSE p_name END AS target FROM part"


@query("j19_unique_recovery", f"""
WITH u AS (SELECT label, min(target) AS tgt FROM ({CANDS}) GROUP BY 1 HAVING count(DISTINCT target) = 1)
SELECT c.id, c.label, CASE WHEN value = '' THEN coalesce(tgt, '') ELSE value END AS value, value = '' AND tgt IS NOT NULL AS recovered FROM ({CELLS}) c LEFT JOIN u USING (label)""")
def _(t):
    return j.recover_unique(t.sql(CELLS), t.sql(CANDS), "label").select("id", "label", "value", "recovered")


TEMPLATES = "SELECT DISTINCT '틀:T' || CAST(doc_id % 350 AS STRING) AS template FROM documents"
CANON = "SELECT '틀:T' || CAST(s_suppkey * 3 AS STRING) AS template FROM supplier"
SEEN = "SELECT '틀:T' || CAST(c_custkey % 200 AS STRING) AS template FROM customer"


@query("j20_fallback_preference", f"""
WITH fb AS (SELECT template_title AS template, count(*) AS n, count_if(translation_status = 'reviewed' AND length(en_html) > 0) AS rv, count_if(length(source_html) > 0) AS sr FROM fallback_rows GROUP BY 1)
SELECT t.template, coalesce(n, 0) AS fallback_rows, CAST(coalesce(rv, 0) AS BIGINT) AS reviewed_rows, CASE WHEN t.template IN ({CANON}) THEN 'canonical_raw' WHEN t.template IN ('틀:T1', '틀:T2') THEN 'compat_builtin'
 WHEN rv > 0 THEN 'reviewed_dom_fallback' WHEN sr > 0 THEN 'dom_fallback_pending' WHEN t.template IN ({SEEN}) THEN 'browser_placeholder' ELSE 'missing' END AS resolution
FROM ({TEMPLATES}) t LEFT JOIN fb USING (template)""")
def _(t):
    return j.template_resolution(t.sql(TEMPLATES), t.sql(CANON), t.fallback_rows, ("틀:T1", "틀:T2"), t.sql(SEEN))


ORIGINAL = "SELECT doc_id % 100 AS doc, 'k' || CAST(doc_id % 77 AS STRING) AS image_key FROM documents"
BASELINE = "SELECT p_partkey % 100 AS doc, 'k' || CAST(p_partkey % 91 AS STRING) AS image_key FROM part"


@query("j22_key_compare", f"""
WITH o AS (SELECT DISTINCT * FROM ({ORIGINAL})), b AS (SELECT DISTINCT * FROM ({BASELINE}))
SELECT coalesce(o.doc, b.doc) AS doc, coalesce(o.image_key, b.image_key) AS image_key, CASE WHEN o.doc IS NOT NULL AND b.doc IS NOT NULL THEN 'common' WHEN o.doc IS NOT NULL THEN 'missing' ELSE 'extra' END AS side
FROM o FULL JOIN b ON o.doc = b.doc AND o.image_key = b.image_key""")
def _(t):
    return j.compare_keys(t.sql(ORIGINAL), t.sql(BASELINE), ["doc", "image_key"])


