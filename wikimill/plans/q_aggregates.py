"""A*, U*: aggregates and set operations."""

from pyspark.sql import functions as F

from ..functions.keys import asset_key
from ..functions.markup import include_bodies, include_target
from ..functions.urls import is_non_payload
from ..operators import aggregates as a
from .registry import query


@query("a1_stage_status_counts", """
SELECT run_id, CASE WHEN grouping(stage) = 1 THEN 'all' ELSE stage END AS stage, CASE WHEN grouping(status) = 1 THEN 'all' ELSE status END AS status, count(*) AS n
FROM pipeline_jobs GROUP BY ROLLUP (run_id, stage, status) HAVING grouping(run_id) = 0""")
def _(t):
    return a.stage_status_counts(t.pipeline_jobs)


STATUSES = ["queued", "running", "pass", "retry", "needs_review", "failed", "skipped"]


@query("a1_stage_status_pivot", f"""
SELECT run_id, stage, is_dependency, {", ".join(f"count_if(status = '{s}')::BIGINT AS {s}" for s in STATUSES)} FROM pipeline_jobs GROUP BY 1, 2, 3""")
def _(t):
    return a.stage_status_pivot(t.pipeline_jobs, STATUSES)


@query("a2_run_rollup", """
WITH c AS (SELECT run_id AS id, count(DISTINCT CASE WHEN stage = 'integration_qa' AND status = 'pass' THEN source_document_id END) AS completed_count,
 count(DISTINCT CASE WHEN status = 'failed' THEN source_document_id END) AS failed_count, count(DISTINCT CASE WHEN status = 'needs_review' THEN source_document_id END) AS review_count FROM pipeline_jobs GROUP BY 1)
SELECT id, scope_count, completed_count, failed_count, review_count, CASE WHEN scope_count > 0 AND completed_count >= scope_count AND failed_count = 0 AND review_count = 0 THEN 'completed' ELSE 'running' END AS status
FROM c JOIN (SELECT id, scope_count FROM pipeline_runs) r USING (id)""")
def _(t):
    return a.run_rollup(t.pipeline_jobs, t.pipeline_runs)


TOTALS = "SELECT id AS run_id, CAST(scope_count * 20 AS BIGINT) AS dependency_total FROM pipeline_runs"


@query("a3_dependency_progress", f"""
WITH c AS (SELECT run_id, count(DISTINCT CASE WHEN is_dependency THEN source_document_id END) AS docs, count(DISTINCT CASE WHEN is_dependency AND stage = 'en_render' AND status = 'pass' THEN source_document_id END) AS rendered FROM pipeline_jobs GROUP BY 1),
x AS (SELECT run_id, greatest(coalesce(dependency_total, 0), docs) AS total, greatest(coalesce(dependency_total, 0), docs) - docs + rendered AS ready FROM c LEFT JOIN ({TOTALS}) u USING (run_id))
SELECT run_id, total, least(total, ready) AS ready, greatest(0, total - ready) AS waiting FROM x""")
def _(t):
    return a.dependency_progress(t.pipeline_jobs, t.sql(TOTALS))


INCLUDES = r"""
WITH e AS (SELECT source_title AS owner, unnest(regexp_extract_all(source_wikitext, '(?i)\[include\(([^,)]+)', 1)) AS template FROM wiki_docs WHERE source_wikitext IS NOT NULL)
"""


def include_edges(t):
    docs = t.wiki_docs.where("source_wikitext IS NOT NULL")
    return docs.select(F.col("source_title").alias("owner"), F.explode(F.transform(include_bodies("source_wikitext"), include_target)).alias("template"))


@query("a4_template_references", INCLUDES + "SELECT template, count(DISTINCT owner) AS owner_count, count(*) AS refs, min(owner) AS first_owner FROM e GROUP BY 1")
def _(t):
    return a.template_references(include_edges(t))


@query("a4_template_owners", INCLUDES + "SELECT DISTINCT template, owner FROM e")
def _(t):
    return include_edges(t).select("template", "owner").distinct()


@query("a5_status_histogram", "SELECT status, count(*) AS n FROM asset_queue GROUP BY 1")
def _(t):
    return a.histogram(t.asset_queue, "status")


QA_GROUPS = {"canonical_raw": "^missing_canonical_raw$", "source_render": "^(missing_source_render|source_stale_)", "clean_dependencies": "^source_missing_(files|templates|youtube):"}


@query("a6_qa_counts", """
WITH r AS (SELECT CASE WHEN source_wikitext IS NULL THEN 1 ELSE 0 END AS b1, CASE WHEN source_rendered_at IS NULL THEN 1 ELSE 0 END AS b2,
 CASE WHEN coalesce(CAST(json_extract(source_meta, '$.missingFileCount') AS INT), 0) > 0 THEN 1 ELSE 0 END AS b3 FROM render_docs)
SELECT count(*) AS scope, CAST(count_if(b1 + b2 + b3 = 0) AS BIGINT) AS pass, CAST(count_if(b1 + b2 + b3 > 0) AS BIGINT) AS blocked, CAST(count_if(b1 = 0) AS BIGINT) AS canonical_raw,
 CAST(count_if(b2 = 0) AS BIGINT) AS source_render, CAST(count_if(b3 = 0) AS BIGINT) AS clean_dependencies FROM r""")
def _(t):
    files = F.get_json_object("source_meta", "$.missingFileCount").cast("int")
    b = F.array_compact(F.array(
        F.when(F.col("source_wikitext").isNull(), "missing_canonical_raw"), F.when(F.col("source_rendered_at").isNull(), "missing_source_render"),
        F.when(files > 0, F.concat(F.lit("source_missing_files:"), files)),
    ))
    return a.blocker_counts(t.render_docs.select(b.alias("blockers")), QA_GROUPS)


@query("a7_first_samples", r"""
WITH m AS (SELECT trim(regexp_replace(text, '\s+', ' ', 'g')) AS sample, doc_id FROM documents)
SELECT sample, min(doc_id) AS first_at FROM m GROUP BY 1 ORDER BY first_at, sample LIMIT 30""")
def _(t):
    d = t.documents.select(F.trim(F.regexp_replace("text", r"\s+", " ")).alias("sample"), "doc_id")
    return a.first_samples(d, "sample", "doc_id", 30)


COVER = "CASE WHEN sum(raw_chars) + sum(rendered_chars) > 0 THEN round(floor(sum(raw_chars) / (sum(raw_chars) + sum(rendered_chars)) * 1000 + 0.5) / 10, 1) ELSE 0.0 END"
RAW_ROWS = "SELECT root_title, id, length(coalesce(source_wikitext, '')) AS raw_chars, CAST(length(text) % 4000 AS BIGINT) AS rendered_chars FROM wiki_docs"


@query("a8_raw_coverage", f"SELECT root_title, CAST(sum(raw_chars) AS BIGINT) AS raw_chars, CAST(sum(rendered_chars) AS BIGINT) AS rendered_chars, {COVER} AS coverage FROM ({RAW_ROWS}) GROUP BY 1")
def _(t):
    return a.raw_coverage(t.sql(RAW_ROWS), ["root_title"])


@query("a9_poisoned_paths", "SELECT DISTINCT storage_path FROM asset_queue WHERE storage_path IS NOT NULL AND (coalesce(original_url, '') LIKE '%/xref/%' OR coalesce(enrichment_url, '') LIKE '%/xref/%')")
def _(t):
    return a.poisoned_paths(t.asset_queue, is_non_payload("original_url") | is_non_payload("enrichment_url"))


@query("a10_cluster_membership", """
SELECT root_title, source_document_id, min(crawl_depth) AS min_crawl_depth, strftime(min(seen_at), '%Y-%m-%d') AS first_seen_at, strftime(max(seen_at), '%Y-%m-%d') AS last_seen_at FROM clusters GROUP BY 1, 2""")
def _(t):
    d = a.cluster_membership(t.clusters)
    return d.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("first_seen_at", "last_seen_at")})


@query("a11_text_nodes", r"""
WITH b AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?i)<script\b[\s\S]*?</script\s*>', '', 'g'), '(?i)<style\b[\s\S]*?</style\s*>', '', 'g') AS h FROM wiki_pages),
n AS (SELECT page_id, trim(regexp_replace(unnest(string_split_regex(h, '<[^>]*>')), '\s+', ' ', 'g')) AS text FROM b)
SELECT page_id, text, count(*) AS n, regexp_matches(text, '[가-힣]') AS has_hangul FROM n WHERE text <> '' GROUP BY 1, 2""")
def _(t):
    return a.text_node_frequency(t.wiki_pages, "page_id", F.col("html"))


WIDTHS = "SELECT l_orderkey AS table_id, CAST(l_quantity % 4 AS INT) AS width FROM lineitem"


@query("a12_modal_width", f"""
SELECT table_id, width, n FROM (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY n DESC, width) AS rn FROM (SELECT table_id, width, count(*) AS n FROM ({WIDTHS}) WHERE width > 0 GROUP BY 1, 2)) WHERE rn = 1 AND n >= 2""")
def _(t):
    return a.modal_width(t.sql(WIDTHS), ["table_id"])


@query("a13_byte_accounting", "SELECT count(*) AS rows, CAST(sum(octet_length(encode(html))) AS BIGINT) AS original_bytes, CAST(sum(length(url)) AS BIGINT) AS stored_bytes FROM pages")
def _(t):
    return a.byte_accounting(t.pages, F.col("html"), F.length("url"))


LABELS = "SELECT source_title AS target, translated_title AS label, id AS ordinal FROM wiki_docs WHERE translated_title IS NOT NULL UNION ALL SELECT title AS target, 'Title/' || CAST(weight AS STRING) AS label, id + 1000000 AS ordinal FROM link_titles"


@query("a14_label_index", f"""
WITH r AS (SELECT trim(target) AS key, trim(label) AS label, ordinal FROM ({LABELS}) WHERE label <> '' AND NOT regexp_matches(label, '[가-힣]')),
u AS (SELECT 'exact' AS kind, key, label, ordinal FROM r WHERE key <> label UNION ALL
      SELECT 'suffix' AS kind, regexp_replace(key, '^.*/', '') AS key, regexp_replace(label, '^.*/', '') AS label, ordinal FROM r)
SELECT kind, key, arg_min(label, ordinal) AS label FROM u GROUP BY 1, 2""")
def _(t):
    return a.label_index(t.sql(LABELS))


@query("a15_ordered_json", """
SELECT source_document_id, '[' || string_agg('{"revision_no":' || CAST(revision_no AS VARCHAR) || ',"editor_type":"' || editor_type || '"}', ',' ORDER BY revision_no) || ']' AS items
FROM revisions GROUP BY 1""")
def _(t):
    # one list per document: all of its revisions, as many as one document has
    return a.ordered_json(t.revisions, ["source_document_id"], ["revision_no"], ["revision_no", "editor_type"])


@query("a16_pass_statistics", r"""
WITH c AS (SELECT length(source_wikitext) AS chars_before, length(regexp_replace(regexp_replace(source_wikitext, '(?m)^##.*$', '', 'g'), '\[br\]', chr(10), 'g')) AS chars_after,
 len(regexp_extract_all(source_wikitext, '(?m)^##.*$')) AS comments, len(regexp_extract_all(source_wikitext, '\{\{\{#!')) AS directives FROM wiki_docs WHERE source_wikitext IS NOT NULL)
SELECT count(*) AS docs, CAST(count_if(chars_after <> chars_before) AS BIGINT) AS docs_changed, CAST(sum(chars_before) AS BIGINT) AS chars_before, CAST(sum(chars_after) AS BIGINT) AS chars_after, CAST(sum(comments) AS BIGINT) AS comments, CAST(sum(directives) AS BIGINT) AS directives FROM c""")
def _(t):
    s = F.col("source_wikitext")
    after = F.regexp_replace(F.regexp_replace(s, r"(?m)^##.*$", ""), r"\[br\]", "\n")
    d = t.wiki_docs.where(s.isNotNull()).select(
        F.length(s).alias("chars_before"), F.length(after).alias("chars_after"), F.regexp_count(s, F.lit(r"(?m)^##.*$")).alias("comments"), F.regexp_count(s, F.lit(r"\{\{\{#!")).alias("directives")
    )
    return a.pass_statistics(d, ["comments", "directives"])


SCOPE_A = "SELECT title, weight AS priority, 'cluster' AS reason FROM link_titles"
SCOPE_B = "SELECT 'N' || CAST(o_custkey % 900 AS STRING) AS title, 30 AS priority, 'dependency' AS reason FROM orders"


@query("u1_union_by_priority", f"""
SELECT title, priority, reason FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY priority DESC, part, reason) AS rn FROM (SELECT *, 0 AS part FROM ({SCOPE_A}) UNION ALL SELECT *, 1 AS part FROM ({SCOPE_B}))) WHERE rn = 1""")
def _(t):
    return a.union_by_priority([t.sql(SCOPE_A), t.sql(SCOPE_B)], ["title"], ["reason"])


IN_SCOPE = "SELECT id, 'captured' AS status, 70 AS priority FROM wiki_docs WHERE crawl_depth <= 1"


@query("u2_ignored_complement", f"SELECT * FROM ({IN_SCOPE}) UNION ALL SELECT DISTINCT id, 'ignored' AS status, 0 AS priority FROM wiki_docs WHERE id NOT IN (SELECT id FROM ({IN_SCOPE}))")
def _(t):
    return a.with_ignored_complement(t.sql(IN_SCOPE), t.wiki_docs, ["id"])


@query("u3_scope_completeness", "SELECT title FROM link_titles EXCEPT SELECT to_title AS title FROM doc_links WHERE crawl_mode = 'expand' AND score > 45 AND position = 2")
def _(t):
    captured = t.doc_links.where("crawl_mode = 'expand' AND score > 45 AND position = 2").select(F.col("to_title").alias("title"))
    return a.missing_titles(t.link_titles, captured, "title")


@query("u4_set_jaccard", r"""
WITH w AS (SELECT id, list_distinct(string_split(source_text, ' ')) AS a, list_distinct(string_split(translated_text, ' ')) AS b FROM translations)
SELECT id, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 6) AS similarity FROM w""")
def _(t):
    x, y = F.split("source_text", " ", -1), F.split("translated_text", " ", -1)
    return t.translations.select("id", F.round(a.jaccard(x, y), 6).alias("similarity"))


@query("u5_marker_difference", r"""
WITH m AS (SELECT page_id, list_distinct(regexp_extract_all(original_html, '(?i)data-[a-z]+|<[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(rendered_html, '(?i)data-[a-z]+|<[a-z0-9]+')) AS b FROM html_pairs)
SELECT page_id, len(list_filter(b, lambda x: NOT list_contains(a, x))) AS added, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS lost FROM m""")
def _(t):
    p = r"(?i)data-[a-z]+|<[a-z0-9]+"
    x, y = (F.regexp_extract_all(c, F.lit(p), F.lit(0)) for c in ("original_html", "rendered_html"))
    return t.html_pairs.select("page_id", F.size(a.marker_difference(x, y)).alias("added"), F.size(a.marker_difference(y, x)).alias("lost"))


@query("u6_distinct_keys", r"""
SELECT id, array_to_string(list_sort(list_distinct(list_filter([lower(regexp_replace(source_ref, '^File:', '')), lower(coalesce(label, '')), coalesce(storage_path, '')], lambda x: x <> ''))), ',') AS keys FROM asset_queue""")
def _(t):
    keys = a.distinct_values(asset_key("source_ref"), asset_key("label"), F.col("storage_path"))
    return t.asset_queue.select("id", F.array_join(F.array_sort(keys), ",").alias("keys"))
