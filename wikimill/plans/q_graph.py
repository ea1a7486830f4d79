"""G*: link and include graphs."""

from pyspark.sql import functions as F

from ..functions.urls import Site
from ..operators import graph as g
from .registry import query

LOCAL = "SELECT id, source_title, root_title, replace(source_wikitext, 'Template:', '틀:') AS source_wikitext FROM wiki_docs"


@query("g1_include_edges", rf"""
SELECT DISTINCT source_title AS owner, template FROM (SELECT source_title, trim(unnest(regexp_extract_all(source_wikitext, '(?i)\[include\(([^,)]+)', 1))) AS template FROM ({LOCAL}) WHERE source_wikitext IS NOT NULL)
WHERE starts_with(template, '틀:')""")
def _(t):
    return g.include_edges(t.sql(LOCAL), "source_title", "source_wikitext").select("owner", "template")


@query("g1_simple_include_edges", r"""
SELECT DISTINCT source_title AS owner, regexp_replace(template, '^Template:', '틀:') AS template FROM (SELECT source_title, trim(unnest(regexp_extract_all(source_wikitext, '(?i)\[include\(\s*([^,)\n]+)', 1))) AS template FROM wiki_docs WHERE source_wikitext IS NOT NULL)""")
def _(t):
    return g.simple_include_edges(t.wiki_docs, "source_title", "source_wikitext")


@query("g2_template_closure", r"""
WITH RECURSIVE d AS (SELECT regexp_replace(source_title, '^Template:', '틀:') AS title, root_title, source_wikitext FROM wiki_docs),
e AS (SELECT DISTINCT title, root_title, '틀:' || trim(unnest(regexp_extract_all(source_wikitext, '\[include\(Template:([^,)\n]+)', 1))) AS dst FROM d WHERE source_wikitext IS NOT NULL),
c AS (SELECT DISTINCT root_title AS root, dst AS node, 0 AS depth FROM e WHERE NOT starts_with(title, '틀:') UNION SELECT c.root, e.dst, c.depth + 1 FROM c JOIN e ON e.title = c.node WHERE c.depth < (SELECT count(DISTINCT dst) FROM e))
SELECT root, node, min(depth) AS depth, node IN (SELECT title FROM d) AS found FROM c GROUP BY 1, 2""")
def _(t):
    return g.template_closure(t.wiki_docs)


SEEDS = "SELECT DISTINCT 'N' || CAST(n_nationkey AS STRING) AS root, 'N' || CAST(n_nationkey AS STRING) AS node FROM nation"


@query("g2_link_closure", f"""
WITH RECURSIVE n AS (SELECT count(DISTINCT dst) AS top FROM graph_links),
c AS (SELECT root, node, 0 AS depth FROM ({SEEDS}) UNION SELECT c.root, e.dst, c.depth + 1 FROM c JOIN graph_links e ON e.src = c.node, n WHERE c.depth < least(n.top, 60))
SELECT root, node, min(depth) AS depth FROM c GROUP BY 1, 2""")
def _(t):
    return g.transitive_closure(t.sql(SEEDS), t.graph_links)


ROOTS = "SELECT 'N' || CAST(n_nationkey AS STRING) AS title FROM nation"


@query("g3_crawl_frontier", f"""
WITH RECURSIVE l AS (SELECT src, dst, max(score) AS score FROM graph_links WHERE score >= 74 GROUP BY 1, 2), a AS MATERIALIZED (SELECT src, list({{'node': dst, 'score': score}}) AS outs FROM l GROUP BY 1),
c AS (SELECT title AS root, 0 AS place, CAST(NULL AS STRUCT(worth INTEGER, depth INTEGER, finder INTEGER, node VARCHAR)) AS cur, [title] AS known,
  [CAST({{'worth': -100, 'depth': 0, 'finder': 0, 'node': title}} AS STRUCT(worth INTEGER, depth INTEGER, finder INTEGER, node VARCHAR))] AS queue FROM (SELECT DISTINCT title FROM ({ROOTS}))
UNION ALL SELECT root, place + 1, head, list_concat(known, list_transform(fresh, lambda x: x.node)),
  list_sort(list_concat(queue[2:], list_transform(fresh, lambda x: CAST({{'worth': -x.score, 'depth': head.depth + 1, 'finder': place + 1, 'node': x.node}} AS STRUCT(worth INTEGER, depth INTEGER, finder INTEGER, node VARCHAR))))) FROM (
  SELECT c.*, queue[1] AS head, CASE WHEN queue[1].depth < 2 THEN list_filter(coalesce(a.outs, []), lambda x: NOT list_contains(known, x.node)) ELSE [] END AS fresh
  FROM c LEFT JOIN a ON a.src = c.queue[1].node WHERE len(queue) > 0 AND place < 12))
SELECT root, cur.node AS node, cur.depth AS depth, -cur.worth AS score, place FROM c WHERE place > 0""")
def _(t):
    return g.crawl_frontier(t.sql(ROOTS), t.graph_links, max_depth=2, max_docs=12)


@query("g4_link_graph", """
SELECT from_id, to_title, arg_min(anchor_text, (position, anchor_text)) AS anchor_text, strftime(min(seen_at), '%Y-%m-%d') AS first_seen_at, strftime(max(seen_at), '%Y-%m-%d') AS last_seen_at FROM doc_links GROUP BY 1, 2""")
def _(t):
    return g.link_graph(t.doc_links).withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("first_seen_at", "last_seen_at")})


@query("g5_backlinks", """
SELECT to_title, count(DISTINCT from_id) AS n_from, count(*) AS n_links, to_title NOT IN (SELECT title FROM link_titles) AS unresolved FROM doc_links GROUP BY 1""")
def _(t):
    return g.backlinks(t.doc_links, t.link_titles)


@query("g6_link_integrity", r"""
WITH l AS (SELECT DISTINCT id, root_title, unnest(regexp_extract_all(content_html, 'href="/w/([^"#?]+)"', 1)) AS title FROM render_docs WHERE content_html IS NOT NULL)
SELECT id, count(*) AS links, CAST(count_if(s.title IS NOT NULL AND p.title IS NULL) AS BIGINT) AS unpublished_core, CAST(count_if(s.title IS NULL) AS BIGINT) AS outside_core
FROM l LEFT JOIN (SELECT DISTINCT root_title, source_title AS title FROM render_docs) s ON s.root_title = l.root_title AND s.title = l.title
LEFT JOIN (SELECT DISTINCT source_title AS title FROM render_docs WHERE published_revision_no > 0) p ON p.title = l.title GROUP BY 1""")
def _(t):
    d = t.render_docs
    scope = d.select("root_title", F.col("source_title").alias("title"))
    return g.link_integrity(d.where("content_html IS NOT NULL"), "content_html", scope, d.where("published_revision_no > 0").select(F.col("source_title").alias("title")), Site())


@query("g7_include_expansion", r"""
WITH RECURSIVE d AS (SELECT id, replace(source_wikitext, 'Template:', '틀:') AS s, CAST(((id * 5) % 31) * 7 + 21 AS BIGINT) AS n, 'v' || CAST(id % 4 AS VARCHAR) AS k FROM wiki_docs WHERE source_wikitext IS NOT NULL),
e AS (SELECT id, k, n, CAST([] AS BIGINT[]) AS path, '' AS head, '' AS tail FROM d UNION ALL
 SELECT e.id, e.k, CASE WHEN e.n % 2 = 0 THEN e.n % 40 + 21 END, list_append(e.path, e.n), e.head || 'T' || CAST(e.n AS VARCHAR) || '<' || e.k || '|>', t.text || e.tail
 FROM e JOIN documents t ON t.doc_id = e.n WHERE NOT list_contains(e.path, e.n) AND len(e.path) < 8),
b AS (SELECT id, arg_max(head || tail, len(path)) AS body FROM e GROUP BY id),
x AS (SELECT d.id, regexp_replace(replace(d.s, '[include(틀:T' || CAST(d.n AS VARCHAR) || ', k=' || d.k || ', second, deep=(a,b))]', b.body), '\[include\(틀:M[0-9]\)\]', '') AS text FROM d JOIN b USING (id))
SELECT id, length(text) AS n, md5(text) AS digest FROM x""")
def _(t):
    d = t.sql(LOCAL)
    templates = t.sql("""SELECT '틀:T' || CAST(doc_id AS STRING) AS title, 'T' || CAST(doc_id AS STRING) || '<@k=none@|@x@>' ||
        CASE WHEN doc_id % 2 = 0 THEN '[include(틀:T' || CAST(doc_id % 40 + 21 AS STRING) || ', k=@k=inner@)]' ELSE '' END || text AS text FROM documents""")
    out = g.expand_includes(d.select("id", F.col("source_wikitext").alias("text")), templates)
    return out.select("id", F.length("text").alias("n"), F.md5(F.col("text").cast("binary")).alias("digest"))


SUFFIX_OK = "title NOT IN (root_title || '/노래방 수록 목록', root_title || '/유튜브')"


@query("g8_core_scope", f"""
WITH d AS (SELECT root_title, source_title AS title, min(crawl_depth) AS crawl_depth, arg_min(source_wikitext, id) AS txt FROM wiki_docs WHERE source_title NOT LIKE 'Template:%' GROUP BY 1, 2),
r AS (SELECT root_title, title, 'root' AS reason, 100 AS priority, 100 AS score, -1 AS pos FROM d WHERE title = root_title),
p AS (SELECT r.root_title, r.title, CASE WHEN r.reason = 'root-subdocument' AND r.{SUFFIX_OK.replace("root_title", "r.root_title")} THEN 95 WHEN r.reason = 'root-member-row' THEN 92 WHEN r.reason = 'root-activity-row' AND r.label LIKE '%팬덤%' THEN 88 END AS priority,
  r.reason AS why, r.score, r.pos FROM relations r JOIN d ON d.root_title = r.root_title AND d.title = r.title),
p2 AS (SELECT root_title, title, CASE priority WHEN 95 THEN 'root_subdocument' WHEN 92 THEN 'member_row' ELSE 'fandom' END AS reason, priority, score, pos FROM p WHERE priority IS NOT NULL),
f AS (SELECT root_title, title, 'root_subdocument_fallback' AS reason, 80 AS priority, 80 AS score, 4611686018427387904 AS pos FROM d WHERE starts_with(title, root_title || '/') AND crawl_depth = 1 AND {SUFFIX_OK}),
u AS (SELECT * FROM r UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM f)
SELECT root_title, title, reason, priority, score FROM (SELECT *, row_number() OVER (PARTITION BY root_title, title ORDER BY priority DESC, pos) AS rn FROM u WHERE root_title IN (SELECT root_title FROM r)) WHERE rn = 1""")
def _(t):
    return g.core_scope(t.wiki_docs, t.relations)
