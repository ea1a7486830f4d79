"""Wiki-shaped tables derived from the given tables, as SQL text that Spark and DuckDB both accept.

The given tables hold no wiki markup, so titles, markup, queue rows and so on are computed from their columns. Every
derived table keeps all rows and the whole texts of the table it comes from.
"""

DERIVED: dict[str, str] = {}

DERIVED["wiki_docs"] = """
SELECT doc_id AS id,
       CASE WHEN doc_id % 10 = 3 THEN 'other' ELSE 'mirror' END AS source,
       CASE WHEN doc_id < 20 THEN 'G' || CAST(doc_id AS STRING)
            WHEN doc_id % 7 = 0 THEN 'Template:T' || CAST(doc_id AS STRING)
            ELSE 'G' || CAST(doc_id % 20 AS STRING) || '/S' || CAST(doc_id AS STRING) END AS source_title,
       'G' || CAST(doc_id % 20 AS STRING) AS root_title,
       CASE WHEN doc_id < 20 THEN 0 ELSE 1 + CAST(doc_id % 3 AS INT) END AS crawl_depth,
       CASE WHEN doc_id % 11 = 0 THEN NULL ELSE
         '[[G' || CAST((doc_id * 3) % 20 AS STRING) || '|label ' || CAST(doc_id AS STRING) || ']] [[G' || CAST(doc_id % 20 AS STRING) || '/S' || CAST(doc_id + 20 AS STRING) || ']]' || chr(10)
         || '[include(Template:T' || CAST(((doc_id * 5) % 31) * 7 + 21 AS STRING) || ', k=v' || CAST(doc_id % 4 AS STRING) || ', second, deep=(a,b))]' || chr(10)
         || CASE WHEN doc_id % 13 = 0 THEN '[include(Template:M' || CAST(doc_id % 3 AS STRING) || ')]' || chr(10) ELSE '' END
         || '[[File:f' || CAST(doc_id % 50 AS STRING) || '.png|width=100]] [youtube(abc' || CAST(1000 + doc_id AS STRING) || ')][* note]' || chr(10)
         || '##hidden comment' || chr(10)
         || '== Overview ==' || chr(10)
         || 'The page ' || CAST(doc_id AS STRING) || ' tells of an act and of its many records and shows. It is kept short here.' || chr(10)
         || '{{{#!folding more' || chr(10) || 'inside a block' || chr(10) || '}}}' || chr(10)
         || '||<-2> a || b ||' || chr(10) || '|| c' || CAST(doc_id % 5 AS STRING) || ' || [[G1|one]] || d ||' || chr(10)
         || '=== ' || lang || ' ===' || chr(10)
         || ' * first item' || chr(10) || ' * second item' || chr(10) || chr(10) || '----' || chr(10)
         || '== Text ==' || chr(10)
         || text END AS source_wikitext,
       lang AS content_language,
       CAST(doc_id % 5 AS INT) AS content_revision_no,
       CASE WHEN doc_id % 4 = 0 THEN 0 ELSE CAST(doc_id % 5 AS INT) END AS published_revision_no,
       CASE WHEN doc_id % 9 = 4 THEN NULL WHEN doc_id % 9 = 5 THEN '' ELSE '<p>' || text || '</p>' END AS published_html,
       CASE WHEN doc_id % 13 = 5 THEN NULL WHEN doc_id % 17 = 2 THEN '가수 ' || CAST(doc_id AS STRING)
            WHEN doc_id < 20 THEN 'Group ' || CAST(doc_id AS STRING)
            WHEN doc_id % 3 = 0 THEN 'Songs of G' || CAST(doc_id % 20 AS STRING) || ' ' || CAST(doc_id AS STRING)
            ELSE 'Album ' || CAST(doc_id AS STRING) END AS translated_title,
       TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * CAST(doc_id % 500 AS INT) AS updated_at,
       source AS feed, text
FROM documents
"""

DERIVED["asset_queue"] = """
SELECT doc_id AS id, doc_id AS source_document_id, 'G' || CAST(doc_id % 20 AS STRING) AS root_title,
       'image' AS asset_type, 'File:f' || CAST(doc_id % 60 AS STRING) || '.png' AS source_ref,
       CASE WHEN doc_id % 3 = 0 THEN 'F' || CAST(doc_id % 60 AS STRING) || '.PNG' END AS label,
       CASE doc_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'unresolved' ELSE 'resolved' END AS status,
       CASE WHEN doc_id % 4 = 2 THEN 'imports/g/' || CAST(doc_id % 60 AS STRING) || '-' || CAST(doc_id % 2 AS STRING) || '.png' END AS storage_path,
       CASE WHEN doc_id % 4 >= 2 THEN 'https://cdn.example/file/' || CAST(doc_id % 60 AS STRING) END AS resolved_url,
       CASE WHEN doc_id % 29 = 2 THEN 'https://www.mirror.example/xref/' || CAST(doc_id AS STRING)
            WHEN doc_id % 5 = 0 THEN 'https://file.mirror.example/file/h' || CAST(doc_id AS STRING) END AS original_url,
       CASE WHEN doc_id % 6 = 1 THEN 'https://file.mirror.example/file/e' || CAST(doc_id AS STRING) END AS enrichment_url
FROM documents
"""

DERIVED["capture_staging"] = """
SELECT page_id AS id, 'G' || CAST(page_id % 20 AS STRING) AS root_title,
       CASE WHEN page_id % 12 = 0 THEN '__anonymous__' || CAST(page_id AS STRING) ELSE 'f' || CAST(page_id % 75 AS STRING) || '.png' END AS file_name,
       CASE WHEN page_id % 4 = 0 THEN 'file:F' || CAST(page_id % 75 AS STRING) || '.png' END AS canonical_key,
       'alt-' || CAST(page_id % 90 AS STRING) || '.webp' AS alt_name, url AS source_url,
       CASE WHEN page_id % 7 = 0 THEN NULL ELSE 'staged/' || CAST(page_id % 40 AS STRING) || '.png' END AS storage_path,
       TIMESTAMP '2024-02-01 00:00:00' + INTERVAL '1' MINUTE * CAST((page_id * 37) % 1000 AS INT) AS captured_at
FROM pages
"""

DERIVED["required_files"] = """
SELECT doc_id, 'File:f' || CAST(doc_id % 50 AS STRING) || '.png' AS file_name FROM documents
UNION ALL
SELECT doc_id, 'F' || CAST((doc_id * 7) % 130 AS STRING) || '.PNG' AS file_name FROM documents
UNION ALL
SELECT doc_id, '파일:f' || CAST(doc_id % 50 AS STRING) || '.png' AS file_name FROM documents
"""

DERIVED["storage_listing"] = """
SELECT DISTINCT 'imports/g/' || CAST(p_partkey % 55 AS STRING) || '-' || CAST(p_partkey % 2 AS STRING) || '.png' AS path FROM part
UNION
SELECT 'staged/' || CAST(p_partkey % 35 AS STRING) || '.png' AS path FROM part
"""

DERIVED["media"] = """
SELECT p_partkey AS id, p_partkey % 400 AS document_id, 'store' AS bucket,
       CASE WHEN p_partkey % 3 = 0 THEN 'g' || CAST(p_partkey % 20 AS STRING) ELSE 'x' END || '/' || CAST(p_partkey AS STRING) || '.jpg' AS storage_path,
       CASE p_partkey % 3 WHEN 0 THEN 'album-cover:a' WHEN 1 THEN 'infobox' ELSE 'album_cover' END AS role,
       CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE p_type || ': ' || p_name || ' ' || CAST(p_partkey % 1500 AS STRING) END AS caption,
       CASE WHEN p_partkey % 5 = 0 THEN p_brand || ' ' || CAST(p_partkey AS STRING) || '.jpg' END AS alt_text,
       'G' || CAST(p_partkey % 20 AS STRING) AS root_title
FROM part
"""

DERIVED["media_refs"] = """
SELECT p_partkey AS ref_id, 'G' || CAST(p_partkey % 20 AS STRING) AS root_title,
       CASE p_partkey % 4 WHEN 0 THEN p_type || ': ' || p_name || ' ' || CAST(p_partkey % 1500 AS STRING) || '.jpg'
                          WHEN 1 THEN p_type || ' ' || p_name || ' ' || CAST(p_partkey % 1500 AS STRING) || '(G' || CAST(p_partkey % 20 AS STRING) || ').png'
                          WHEN 2 THEN p_type || '-' || p_name || ' ' || CAST(p_partkey % 1500 AS STRING) || ' digital cover.webp'
                          ELSE p_brand || ' ' || CAST(p_partkey + 1 AS STRING) || '.jpg' END AS file_name
FROM part
"""

DERIVED["pipeline_jobs"] = """
SELECT o_orderkey AS id, o_custkey % 10 AS run_id, o_orderkey AS source_document_id, 'D' || CAST(o_orderkey AS STRING) AS source_title,
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'raw' WHEN '2' THEN 'source_render' WHEN '3' THEN 'translation' WHEN '4' THEN 'en_render'
            ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'publish' ELSE 'integration_qa' END END AS stage,
       CASE WHEN o_orderstatus = 'F' THEN 'pass' WHEN o_orderstatus = 'P' THEN 'running' WHEN o_orderkey % 3 = 0 THEN 'retry'
            WHEN o_orderkey % 17 = 0 THEN 'needs_review' WHEN o_orderkey % 19 = 0 THEN 'failed' ELSE 'queued' END AS status,
       CAST(o_orderkey % 4 AS INT) AS attempt, 3 AS max_attempts, o_orderdate AS updated_at,
       CASE WHEN o_orderstatus = 'P' THEN 'w' || CAST(o_custkey % 4 AS STRING) END AS locked_by,
       CASE WHEN o_orderstatus = 'P' AND o_orderkey % 5 > 0 THEN o_orderdate END AS locked_at,
       o_orderkey % 6 = 0 AS is_dependency
FROM orders
"""

DERIVED["pipeline_runs"] = """
SELECT c_custkey AS id, 'G' || CAST(c_custkey % 40 AS STRING) AS root_title,
       CASE c_custkey % 6 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'paused' WHEN 3 THEN 'completed' WHEN 4 THEN 'failed' ELSE 'cancelled' END AS status,
       CAST(c_custkey % 30 AS INT) AS scope_count,
       CASE WHEN c_custkey % 4 > 0 THEN 'runner' || CAST(c_custkey % 3 AS STRING) END AS runner_id,
       CASE WHEN c_custkey % 5 > 0 THEN TIMESTAMP '2024-01-10 00:00:00' + INTERVAL '1' SECOND * CAST((c_custkey * 13) % 600 AS INT) END AS heartbeat_at,
       TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' MINUTE * CAST((c_custkey * 7919) % 100000 AS INT) AS created_at
FROM customer
"""

DERIVED["revisions"] = """
SELECT conv_id AS source_document_id, turn + 1 AS revision_no, text AS content_wikitext, role AS editor_type,
       TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR * CAST(turn * 7 + conv_id % 24 AS INT) AS created_at
FROM conversations
"""

DERIVED["edit_proposals"] = """
SELECT event_id AS id, user_id % 50 AS source_document_id, user_id AS submitter, ts AS created_at,
       CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'error' THEN 'rejected' WHEN 'view' THEN 'superseded' ELSE 'pending' END AS status, value,
       CAST(event_id % 5 AS INT) AS base_revision_no
FROM events
"""

DERIVED["render_docs"] = """
SELECT doc_id AS id, 'G' || CAST(doc_id % 20 AS STRING) || '/S' || CAST(doc_id AS STRING) AS source_title,
       'G' || CAST(doc_id % 20 AS STRING) AS root_title, doc_id % 7 = 0 AS is_template, doc_id % 14 = 0 AS fallback_ready,
       CASE WHEN doc_id % 23 = 0 THEN NULL ELSE text END AS source_wikitext,
       CASE WHEN doc_id % 19 = 1 THEN NULL ELSE TIMESTAMP '2024-03-01 00:00:00' + INTERVAL '1' HOUR * CAST(doc_id % 200 AS INT) END AS source_rendered_at,
       CASE WHEN doc_id % 19 = 1 THEN NULL ELSE
         '{"hasError":' || CASE WHEN doc_id % 37 = 5 THEN 'true' ELSE 'false' END
         || ',"missingFileCount":' || CAST(CASE WHEN doc_id % 12 = 0 THEN doc_id % 5 ELSE 0 END AS STRING)
         || ',"missingFiles":[' || CASE WHEN doc_id % 16 = 0 THEN '"f' || CAST(doc_id % 70 AS STRING) || '.png","f2.png"' ELSE '' END || ']'
         || ',"missingTemplates":[' || CASE WHEN doc_id % 31 = 0 THEN '"T1"' ELSE '' END || ']'
         || ',"missingYouTubeEmbeds":[' || CASE WHEN doc_id % 41 = 0 THEN '"y"' ELSE '' END || ']'
         || ',"compatibility":{"version":"' || CASE WHEN doc_id % 15 = 1 THEN 'v7' ELSE 'v8' END || '","enginePatchset":"' || CASE WHEN doc_id % 21 = 1 THEN 'p1' ELSE 'p2' END || '"}}' END AS source_meta,
       CASE WHEN doc_id % 8 = 3 THEN NULL ELSE replace(text, 'e', 'a') END AS content_wikitext,
       CASE WHEN doc_id % 8 = 3 THEN 'ko' ELSE 'en' END AS content_language,
       CASE doc_id % 9 WHEN 0 THEN 'reviewed' WHEN 1 THEN 'failed' WHEN 2 THEN NULL ELSE 'translated_by_chatgpt' END AS translation_status,
       CAST(doc_id % 6 AS INT) AS content_revision_no,
       CASE WHEN doc_id % 13 = 5 THEN NULL WHEN doc_id % 17 = 2 THEN '가수 ' || CAST(doc_id AS STRING) ELSE 'Album ' || CAST(doc_id AS STRING) END AS translated_title,
       'h' || CAST(doc_id % 3 AS STRING) AS source_hash,
       CASE WHEN doc_id % 18 = 2 THEN 'h9' ELSE 'h' || CAST(doc_id % 3 AS STRING) END AS translation_source_hash,
       CASE WHEN doc_id % 10 = 7 THEN NULL ELSE '<article><p>' || text || '</p>'
            || CASE WHEN doc_id % 26 = 4 THEN '[[leak]]' ELSE '' END || CASE WHEN doc_id % 28 = 6 THEN '<a href="/w/x">한글링크</a>' ELSE '' END
            || '<a class="wiki-link-internal" href="/w/G' || CAST(doc_id % 25 AS STRING) || '/S' || CAST(doc_id + 5 AS STRING) || '">next</a></article>' END AS content_html,
       CASE WHEN doc_id % 10 = 7 THEN NULL ELSE TIMESTAMP '2024-03-05 00:00:00' + INTERVAL '1' HOUR * CAST(doc_id % 100 AS INT) END AS content_rendered_at,
       CASE WHEN doc_id % 10 = 7 THEN NULL ELSE '{"hasError":false,"missingFileCount":' || CAST(CASE WHEN doc_id % 22 = 0 THEN 2 ELSE 0 END AS STRING)
         || ',"missingFiles":[' || CASE WHEN doc_id % 24 = 0 THEN '"File:F' || CAST(doc_id % 90 AS STRING) || '.PNG"' ELSE '' END || ']'
         || ',"editableContent":{"revisionNo":' || CAST(CASE WHEN doc_id % 24 = 1 THEN 9 ELSE doc_id % 6 END AS STRING) || '}}' END AS content_meta,
       CASE WHEN doc_id % 5 = 4 THEN 0 ELSE CAST(doc_id % 6 AS INT) END AS published_revision_no,
       CASE WHEN doc_id % 5 = 4 THEN NULL ELSE 'en' END AS published_language,
       CASE WHEN doc_id % 5 = 4 THEN NULL ELSE '<p>' || text || '</p>' END AS published_html
FROM documents
"""

DERIVED["wiki_pages"] = """
SELECT page_id, 'P' || CAST(page_id AS STRING) AS title,
  replace(html, '</article>',
    '<h2>1. Media</h2><p>2024년 ' || CAST(1 + page_id % 12 AS STRING) || '월 ' || CAST(1 + page_id % 28 AS STRING) || '일 and 2023. 5. 7.</p>'
    || '<img alt="File:f' || CAST(page_id % 50 AS STRING) || '.png" data-src="https://file.mirror.example/file/a' || CAST(page_id AS STRING) || '">'
    || '<img alt="g' || CAST(page_id % 9 AS STRING) || '.jpg" src="//i.mirror.example/i/' || CAST(page_id AS STRING) || '.jpg?x=1">'
    || '<a href="https://www.other' || CAST(page_id % 4 AS STRING) || '.example/x?a=1&amp;b=2">out</a> <a href="https://www.mirror.example/w/Self">in</a>'
    || '<iframe src="https://www.youtube.com/embed/vid' || CAST(1000 + page_id AS STRING) || '"></iframe>'
    || '<ul><li>G' || CAST(page_id % 20 AS STRING) || ' member <a href="/w/M' || CAST(page_id % 30 AS STRING) || '">M' || CAST(page_id % 30 AS STRING) || '</a></li></ul>'
    || '<table><tr><th colspan="2" style="background-color:#fff;text-align:center">G' || CAST(page_id % 20 AS STRING) || ' album</th></tr>'
    || '<tr><td>2022. 1. 2.</td><td><a href="/w/G' || CAST(page_id % 20 AS STRING) || '/Song%20' || CAST(page_id % 7 AS STRING) || '">song</a></td></tr>'
    || '<tr><td rowspan="2">x</td><td></td></tr></table>'
    || '<pre><code>== Raw ==' || chr(10) || '[[Target' || CAST(page_id % 6 AS STRING) || '|[[File:r' || CAST(page_id % 8 AS STRING) || '.png|width=1]]]] [[Other|x]] {{{#!wiki style' || chr(10) || 'a}}}{{{#!folding b' || chr(10) || 'c}}}</code></pre>'
    || '<h3>1.1. After</h3><p>tail &lt;b&gt; text [dday(2024-01-01)] [age(2000-06-15)]</p></article>') AS html
FROM pages
"""

DERIVED["clusters"] = """
SELECT 'G' || CAST(o_custkey % 20 AS STRING) AS root_title, o_orderkey % 500 AS source_document_id, CAST(o_orderkey % 7 % 4 AS INT) AS crawl_depth, o_orderdate AS seen_at
FROM orders
"""

DERIVED["doc_links"] = """
SELECT l_orderkey AS from_id, 'N' || CAST(l_partkey % 900 AS STRING) AS to_title, 'anchor ' || l_returnflag AS anchor_text, l_shipdate AS seen_at,
       CAST(l_linenumber AS INT) AS position, CAST(l_quantity AS INT) AS score,
       CASE l_linestatus WHEN 'O' THEN 'expand' ELSE 'skip' END AS crawl_mode,
       CASE WHEN l_linenumber < 3 THEN 'toc' ELSE 'section' END AS source_area, l_shipdate AS ts
FROM lineitem
"""

DERIVED["link_titles"] = """
SELECT p_partkey AS id, 'N' || CAST(p_partkey % 700 AS STRING) AS title, p_size AS weight, 'G' || CAST(p_partkey % 20 AS STRING) AS root_title,
       p_partkey % 3 = 0 AS canonical, CAST(p_size % 5 AS INT) AS revision_no
FROM part
"""

DERIVED["graph_links"] = """
SELECT DISTINCT 'N' || CAST(o_orderkey % 1200 AS STRING) AS src, 'N' || CAST((o_orderkey * 7 + o_custkey) % 1500 AS STRING) AS dst, CAST(50 + o_custkey % 51 AS INT) AS score
FROM orders
"""

DERIVED["relations"] = """
SELECT 'G' || CAST(doc_id % 20 AS STRING) AS root_title,
       CASE doc_id % 5 WHEN 0 THEN 'G' || CAST(doc_id % 20 AS STRING) || '/S' || CAST(doc_id AS STRING)
                       WHEN 4 THEN 'G' || CAST(doc_id % 20 AS STRING) || '/S' || CAST(doc_id + 20 AS STRING)
                       ELSE 'G' || CAST(doc_id % 20 AS STRING) || '/S' || CAST(doc_id AS STRING) END AS title,
       CASE WHEN doc_id % 8 = 0 THEN '팬덤' ELSE 'label' END AS label,
       CASE doc_id % 5 WHEN 0 THEN 'root-subdocument' WHEN 1 THEN 'root-member-row' WHEN 2 THEN 'root-activity-row' WHEN 3 THEN 'root-qualified-title' ELSE 'root-discography-row' END AS reason,
       CAST(80 + doc_id % 21 AS INT) AS score, doc_id AS pos
FROM documents
"""

DERIVED["translations"] = """
SELECT doc_id AS id, 'G' || CAST(doc_id % 20 AS STRING) AS root_title,
       '== H ==' || chr(10) || '[[A|' || lang || ']] https://site.example/' || CAST(doc_id AS STRING) || chr(10) || '[include(Template:T, x=1)] [youtube(abcdefg)] [* n]' || chr(10)
         || '=== S ===' || chr(10) || '|| a || b ||' || chr(10) || '{{{ x }}}' || chr(10) || text AS source_text,
       CASE WHEN doc_id % 15 = 0 THEN '=== H ===' ELSE '== H ==' END || chr(10)
         || CASE WHEN doc_id % 6 = 0 THEN '[[B|en]]' ELSE '[[A|en]]' END || ' https://site.example/' || CAST(CASE WHEN doc_id % 10 = 0 THEN 0 ELSE doc_id END AS STRING) || chr(10)
         || '[include(Template:T, x=2)] [youtube(abcdefg)] [* n]' || chr(10)
         || '=== S ===' || chr(10) || '|| a || b' || CASE WHEN doc_id % 9 = 0 THEN '' ELSE ' ||' END || chr(10) || '{{{ x }}}' || chr(10) || replace(text, 'e', 'a') AS translated_text
FROM documents
"""

DERIVED["html_pairs"] = """
SELECT page_id, title, html AS original_html,
       replace(replace(replace(html, '<li>', '<p>'), 'data-src', 'src'), CASE WHEN page_id % 3 = 0 THEN '<td>' ELSE '<zz>' END, '') AS rendered_html
FROM wiki_pages
"""

DERIVED["table_summaries"] = """
SELECT conv_id AS doc_id, 'original' AS side, CAST(turn AS INT) AS idx, text, CAST(1 + turn % 4 AS INT) AS n_rows, CAST(2 + turn % 3 AS INT) AS n_cols FROM conversations
UNION ALL
SELECT conv_id AS doc_id, 'baseline' AS side, CAST(20 - turn AS INT) AS idx, CASE WHEN turn % 3 = 0 THEN replace(text, ' the ', ' zz ') ELSE text END AS text,
       CAST(1 + turn % 4 AS INT) AS n_rows, CAST(2 + turn % 2 AS INT) AS n_cols FROM conversations
"""

DERIVED["patches"] = """
SELECT l_orderkey AS doc_id, l_linenumber AS patch_id, CAST(l_quantity AS INT) * 40 AS start_pos, CAST(l_quantity AS INT) * 40 + CAST(l_partkey % 60 AS INT) AS end_pos
FROM lineitem
"""

DERIVED["fallback_rows"] = """
SELECT p_partkey AS id, '틀:T' || CAST((p_partkey % 40) * 7 AS STRING) AS template_title,
       CASE p_partkey % 3 WHEN 0 THEN 'reviewed' WHEN 1 THEN 'pending' ELSE 'none' END AS translation_status,
       CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE '<p>' || p_name || '</p>' END AS source_html,
       CASE WHEN p_partkey % 6 = 0 THEN '<p>' || p_type || '</p>' END AS en_html
FROM part
"""

DERIVED["plain_links"] = """
SELECT p_partkey AS id, 'G' || CAST(p_partkey % 20 AS STRING) AS current_title,
       CASE p_partkey % 14 WHEN 0 THEN '2024년' WHEN 1 THEN '3월 14일' WHEN 2 THEN '대한민국' WHEN 3 THEN 'K-POP' WHEN 4 THEN '파일:' || p_name || '.png'
            WHEN 5 THEN '틀:' || p_brand WHEN 6 THEN '/Sub ' || p_brand WHEN 7 THEN ':' || p_name WHEN 8 THEN p_name || '#s-2.1'
            WHEN 9 THEN 'https://x.example/' || p_brand WHEN 10 THEN 'G' || CAST(p_partkey % 20 AS STRING) || '/' || p_type WHEN 11 THEN '2023-05-0' || CAST(1 + p_partkey % 9 AS STRING)
            WHEN 12 THEN 'Category:' || p_type ELSE p_name END AS target,
       CASE p_partkey % 6 WHEN 0 THEN '멤버' WHEN 1 THEN '음반' WHEN 2 THEN '소속사' WHEN 3 THEN '외부 링크' WHEN 4 THEN '출생지' ELSE 'Overview' END AS section_title,
       CASE p_partkey % 5 WHEN 0 THEN '프로듀서 ' || p_name WHEN 1 THEN '시상식' WHEN 2 THEN 'feat. ' || p_brand ELSE p_type END AS context,
       CASE WHEN p_partkey % 9 = 0 THEN 'toc' ELSE 'section' END AS source_area
FROM part
"""

DERIVED["url_rows"] = """
SELECT page_id AS id, CASE page_id % 9 WHEN 0 THEN 'https://www.mirror.example/xref/' || CAST(page_id AS STRING) WHEN 1 THEN 'https://mirror.example/images/cc.png'
       WHEN 2 THEN 'https://file.mirror.example/file/h' || CAST(page_id AS STRING) || '?v=1' WHEN 3 THEN 'https://i.wiki.example/i/' || CAST(page_id AS STRING) || '.webp'
       WHEN 4 THEN 'https://dark.mirror.example/w/Page' WHEN 5 THEN 'not a url' WHEN 6 THEN 'https://w.cdnhost.example/i/z.png' WHEN 7 THEN 'https://mirror.example/RecentChanges' ELSE url END AS url
FROM pages
"""
