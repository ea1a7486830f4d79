"""File references against stored media."""

from pyspark.sql import functions as F

from ..operators import assets as a
from .registry import query

AUDIT = """
WITH req AS (SELECT doc_id, lower(regexp_replace(file_name, '^(파일|File):', '')) AS key FROM required_files GROUP BY 1, 2),
q AS (SELECT DISTINCT unnest([lower(regexp_replace(source_ref, '^File:', '')), lower(label)]) AS key, storage_path AS stored FROM asset_queue WHERE status = 'resolved' AND storage_path IS NOT NULL),
s AS (SELECT lower(regexp_replace(coalesce(canonical_key, file_name), '(?i)^file:', '')) AS key, storage_path AS stored FROM capture_staging WHERE storage_path IS NOT NULL AND file_name NOT LIKE '__anonymous__%'),
av AS (SELECT DISTINCT key, stored FROM (SELECT * FROM q UNION ALL SELECT * FROM s) WHERE key IS NOT NULL), n AS (SELECT key, count(*) AS n_paths FROM av GROUP BY 1),
mt AS (SELECT r.doc_id, r.key, coalesce(n.n_paths, 0) AS n_paths FROM req r LEFT JOIN n USING (key))
"""


def matched(t):
    return a.match_required(t.required_files, a.available_paths(t.asset_queue, t.capture_staging))


@query("j3_asset_audit", AUDIT + "SELECT doc_id, count(*) AS required, CAST(count_if(n_paths > 0) AS BIGINT) AS available, CAST(count_if(n_paths = 0) AS BIGINT) AS missing FROM mt GROUP BY 1")
def _(t):
    return a.audit_documents(matched(t))


@query("j3_missing_files", AUDIT + """, qr AS (SELECT key, count(*) AS queue_rows FROM (SELECT DISTINCT id, unnest([lower(regexp_replace(source_ref, '^File:', '')), lower(label)]) AS key FROM asset_queue) WHERE key IS NOT NULL GROUP BY 1)
SELECT key, count(*) AS owners, min(doc_id) AS first_owner, coalesce(max(queue_rows), 0) AS queue_rows FROM mt LEFT JOIN qr USING (key) WHERE n_paths = 0 GROUP BY 1""")
def _(t):
    return a.audit_missing(matched(t), t.asset_queue).drop("name")


@query("j3_duplicate_paths", AUDIT + "SELECT DISTINCT key, n_paths FROM mt WHERE n_paths > 1")
def _(t):
    return a.audit_duplicates(matched(t))


@query("j4_render_asset_audit", AUDIT + """, need AS (SELECT id AS doc_id, lower(regexp_replace(trim(unnest(list_concat(CASE WHEN source_rendered_at IS NULL THEN [] ELSE coalesce(from_json(json_extract(source_meta, '$.missingFiles'), '["VARCHAR"]'), []) END,
 CASE WHEN content_rendered_at IS NULL THEN [] ELSE coalesce(from_json(json_extract(content_meta, '$.missingFiles'), '["VARCHAR"]'), []) END))), '^File:', '')) AS key FROM render_docs),
av2 AS (SELECT key, count(*) AS n_paths FROM av WHERE stored IN (SELECT path FROM storage_listing) GROUP BY 1)
SELECT key, count(DISTINCT doc_id) AS owners, coalesce(max(n_paths), 0) AS n_paths, CASE WHEN max(n_paths) > 0 THEN 'reusable' ELSE 'capture_required' END AS state FROM need LEFT JOIN av2 USING (key) GROUP BY 1""")
def _(t):
    files = lambda c: F.from_json(F.get_json_object(c, "$.missingFiles"), "array<string>")
    d = t.render_docs.select(
        "id", F.col("source_rendered_at").isNotNull().alias("source_ready"), F.col("content_rendered_at").isNotNull().alias("content_ready"),
        files("source_meta").alias("source_missing"), files("content_meta").alias("content_missing"),
    )
    return a.render_audit(d, t.asset_queue, t.capture_staging, t.storage_listing)


REFS7 = """SELECT p_partkey AS ref_id, 'G' || CAST(p_partkey % 20 AS STRING) AS root_title, CASE p_partkey % 4 WHEN 0 THEN 'File:' || p_type || ' (' || p_name || ').svg' WHEN 1 THEN p_name || ' ' || p_type || '.svg'
 WHEN 2 THEN lower(p_type) || '-' || p_name || '.svg' ELSE p_type || ' (' || p_name || ').svg' END AS ref FROM part"""
ASSETS7 = "SELECT 'G' || CAST(p_partkey % 20 AS STRING) AS root_title, p_type || ' (' || p_name || ').svg' AS key, 'https://cdn.example/file/' || CAST(p_size % 2 AS STRING) AS url FROM part WHERE p_size > 20"


@query("j7_alias_resolution", rf"""
WITH r AS ({REFS7}), s AS ({ASSETS7}),
rn AS (SELECT ref_id, root_title, ref, regexp_replace(ref, '^File:', '') AS nf FROM r),
rl AS (SELECT ref_id, root_title, 0 AS level, ref AS sig FROM rn UNION ALL SELECT ref_id, root_title, 1, nf FROM rn UNION ALL SELECT ref_id, root_title, 2, lower(nf) FROM rn
 UNION ALL SELECT ref_id, root_title, 3, 'svg|' || array_to_string(list_sort(list_filter(string_split_regex(regexp_replace(regexp_replace(lower(nf), '\.svg$', ''), '[\[\](){{}}''"“”‘’.,:;_+\-/\\]+', ' ', 'g'), '\s+'), lambda x: x <> '')), '|') FROM rn
 UNION ALL SELECT ref_id, root_title, 4, 'svg|' || regexp_replace(regexp_replace(lower(nf), '\.svg$', ''), '[^0-9a-z가-힣]+', '', 'g') FROM rn),
al AS (SELECT root_title, 0 AS level, key AS sig, url FROM s UNION ALL SELECT root_title, 1, key, url FROM s UNION ALL SELECT root_title, 2, lower(key), url FROM s
 UNION ALL SELECT root_title, 3, 'svg|' || array_to_string(list_sort(list_filter(string_split_regex(regexp_replace(regexp_replace(lower(key), '\.svg$', ''), '[\[\](){{}}''"“”‘’.,:;_+\-/\\]+', ' ', 'g'), '\s+'), lambda x: x <> '')), '|'), url FROM s
 UNION ALL SELECT root_title, 4, 'svg|' || regexp_replace(regexp_replace(lower(key), '\.svg$', ''), '[^0-9a-z가-힣]+', '', 'g'), url FROM s),
ix AS (SELECT root_title, level, sig, min(url) AS lo, max(url) AS hi FROM al GROUP BY 1, 2, 3),
h AS (SELECT rl.ref_id, rl.level, lo, hi, row_number() OVER (PARTITION BY rl.ref_id ORDER BY rl.level) AS rn FROM rl JOIN ix USING (root_title, level, sig))
SELECT ref_id, level, CASE WHEN lo = hi THEN lo END AS url FROM h WHERE rn = 1""")
def _(t):
    return a.resolve_aliases(t.sql(REFS7), t.sql(ASSETS7), "root_title")


def cover(c: str, root: str) -> str:
    stem = rf"regexp_replace({c}, '\.[^.]+$', '')"
    stem = rf"(CASE WHEN ends_with(lower({stem}), lower('(' || {root} || ')')) THEN substr({stem}, 1, length({stem}) - length({root}) - 2) ELSE {stem} END)"
    return rf"lower(regexp_replace(regexp_replace({stem}, '(?i)\s+(?:digital\s+)?cover$', ''), '[\s:._-]+', '', 'g'))"


@query("j8_stored_media_match", rf"""
WITH ex AS (SELECT root_title, id, 0 AS level, unnest([caption, alt_text]) AS sig FROM media), cv AS (SELECT root_title, id, 1 AS level, {cover("caption || '.jpg'", "root_title")} AS sig FROM media WHERE regexp_matches(role, '^album[-_]cover(:|$)') AND caption IS NOT NULL),
ix AS (SELECT root_title, level, sig, min(id) AS lo, max(id) AS hi FROM (SELECT * FROM ex UNION ALL SELECT * FROM cv) WHERE sig IS NOT NULL GROUP BY 1, 2, 3),
rl AS (SELECT ref_id, root_title, 0 AS level, file_name AS sig FROM media_refs UNION ALL SELECT ref_id, root_title, 1, {cover("file_name", "root_title")} FROM media_refs),
h AS (SELECT ref_id, level, lo, hi, row_number() OVER (PARTITION BY ref_id ORDER BY level) AS rn FROM rl JOIN ix USING (root_title, level, sig))
SELECT ref_id, level, lo AS media_id FROM h WHERE rn = 1 AND lo = hi""")
def _(t):
    return a.match_stored_media(t.media_refs, t.media)


@query("j9_media_scope", """
WITH ro AS (SELECT DISTINCT root_title FROM wiki_docs), ge AS (SELECT root_title, id AS document_id FROM wiki_docs WHERE crawl_depth = 1), ti AS (SELECT id AS document_id, source_title AS title FROM wiki_docs),
u AS (SELECT * FROM ge UNION SELECT root_title, document_id FROM ro JOIN ti ON ti.title = ro.root_title)
SELECT u.root_title, m.id FROM u JOIN media m USING (document_id) UNION SELECT ro.root_title, m.id FROM ro JOIN media m ON starts_with(m.storage_path, lower(ro.root_title) || '/')""")
def _(t):
    d = t.wiki_docs
    return a.media_scope(
        d.select("root_title").distinct(), d.where("crawl_depth = 1").select("root_title", F.col("id").alias("document_id")),
        d.select(F.col("id").alias("document_id"), F.col("source_title").alias("title")), t.media.drop("root_title"),
    )


NEEDED = "SELECT doc_id, file_name FROM required_files UNION ALL SELECT doc_id, 'alt-' || CAST(doc_id % 120 AS STRING) || '.jpg' AS file_name FROM documents"
DONE = "SELECT doc_id, file_name AS ref FROM required_files WHERE file_name LIKE 'F%.PNG' AND length(file_name) < 7"


@query("j10_staged_reconciliation", f"""
WITH nd AS (SELECT DISTINCT doc_id, lower(regexp_replace(file_name, '^(파일|File):', '')) AS key FROM ({NEEDED})), dn AS (SELECT DISTINCT doc_id, lower(ref) AS key FROM ({DONE})),
st AS (SELECT *, lower(regexp_replace(coalesce(canonical_key, file_name), '(?i)^file:', '')) AS k, regexp_replace(lower(alt_name), '\\.webp$', '') AS b FROM capture_staging WHERE storage_path IS NOT NULL),
bk AS (SELECT k, storage_path FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY captured_at DESC, id) AS rn FROM st WHERE file_name NOT LIKE '__anonymous__%') WHERE rn = 1),
ba AS (SELECT b, storage_path FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY captured_at DESC, id) AS rn FROM st) WHERE rn = 1)
SELECT nd.doc_id, nd.key, coalesce(bk.storage_path, ba.storage_path) AS storage_path, CASE WHEN bk.k IS NOT NULL THEN 'key' ELSE 'alt' END AS method
FROM nd LEFT JOIN dn ON dn.doc_id = nd.doc_id AND dn.key = nd.key LEFT JOIN bk ON bk.k = nd.key LEFT JOIN ba ON ba.b = regexp_replace(nd.key, '\\.(png|jpg)$', '') WHERE dn.doc_id IS NULL AND coalesce(bk.storage_path, ba.storage_path) IS NOT NULL""")
def _(t):
    s = t.capture_staging.withColumn("captured_at", F.col("captured_at").cast("timestamp"))
    return a.reconcile_staged(t.sql(NEEDED), t.sql(DONE), s)


HINTS = "SELECT DISTINCT 'G' || CAST(page_id % 20 AS STRING) AS root_title, 'f' || CAST(page_id % 20 + 20 AS STRING) || '.png' AS file, 'https://file.mirror.example/file/e' || CAST(page_id % 20 + 20 AS STRING) AS url FROM pages"


@query("j11_hint_updates", f"""
SELECT q.id, h.url AS enrichment_url, 'pending' AS status FROM asset_queue q JOIN ({HINTS}) h ON h.root_title = q.root_title AND 'File:' || h.file = q.source_ref
WHERE q.status IN ('pending', 'unresolved') AND NOT (q.enrichment_url IS NOT DISTINCT FROM h.url AND q.status = 'pending')""")
def _(t):
    return a.hint_updates(t.asset_queue, t.sql(HINTS))


USABLE = """bad AS (SELECT *, coalesce(original_url LIKE '%/xref/%', false) OR coalesce(enrichment_url LIKE '%/xref/%', false) AS bad FROM asset_queue), pp AS (SELECT DISTINCT storage_path FROM bad WHERE bad AND storage_path IS NOT NULL),
us AS (SELECT b.* FROM bad b WHERE NOT bad AND (b.storage_path IS NULL OR b.storage_path NOT IN (SELECT storage_path FROM pp)))"""


@query("j12_root_reuse", f"""
WITH {USABLE} SELECT root_title, key, resolved_url, coalesce(storage_path, '') AS storage_path FROM (SELECT *, lower(regexp_replace(coalesce(label, source_ref), '^File:', '')) AS key, row_number() OVER (PARTITION BY root_title, lower(regexp_replace(coalesce(label, source_ref), '^File:', '')) ORDER BY id) AS rn
FROM us WHERE status = 'resolved') WHERE rn = 1""")
def _(t):
    return a.reuse_resolved(t.asset_queue, ["root_title"]).withColumn("storage_path", F.coalesce("storage_path", F.lit("")))


HINT_KEYS = f"SELECT root_title, file AS key, url FROM ({HINTS})"


@query("j12_resolved_map", f"""
WITH {USABLE}, ly AS (SELECT root_title, id, source_ref, label, original_url, 1 AS layer, enrichment_url AS url FROM us UNION ALL SELECT root_title, id, source_ref, label, original_url, 2, resolved_url FROM us
 UNION ALL SELECT root_title, id, source_ref, label, original_url, 3, resolved_url FROM us WHERE storage_path IS NOT NULL),
ks AS (SELECT root_title, id, layer, url, unnest([regexp_replace(source_ref, '^File:', ''), label, original_url]) AS key FROM ly WHERE url IS NOT NULL),
al AS (SELECT root_title, id, layer, url, key FROM ks WHERE key IS NOT NULL UNION ALL SELECT root_title, 0, 0, url, key FROM ({HINT_KEYS}))
SELECT root_title, key, url FROM (SELECT *, row_number() OVER (PARTITION BY root_title, key ORDER BY layer DESC, id DESC) AS rn FROM al) WHERE rn = 1""")
def _(t):
    return a.resolved_map(t.asset_queue, t.sql(HINT_KEYS), "root_title")
