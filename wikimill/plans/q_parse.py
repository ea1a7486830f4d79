"""Sections, blocks, tables and localization."""

from pyspark.sql import functions as F

from ..operators import parse as p
from ..operators.aggregates import label_index
from ..operators.extract import template_calls
from ..operators.quality import lossy_splits
from .registry import query


def digest(c):
    return F.md5(F.col(c).cast("binary"))


HEADS = r"<h2\b[^>]*>[\s\S]*?</h2>|<h3\b[^>]*>[\s\S]*?</h3>|<h4\b[^>]*>[\s\S]*?</h4>"


@query("x10_page_sections", rf"""
WITH a AS (SELECT page_id, regexp_extract(html, '(?i)<article\b[^>]*>([\s\S]*?)</article>', 1) AS c FROM wiki_pages),
s AS (SELECT page_id, string_split_regex(c, '{HEADS}') AS b, list_transform(regexp_extract_all(c, '{HEADS}'), lambda x: CAST(substr(x, 3, 1) AS INT)) AS l FROM a),
r AS (SELECT page_id, unnest(b) AS body, l, generate_subscripts(b, 1) - 1 AS section FROM s)
SELECT page_id, CAST(section AS INT) AS section, CASE WHEN section = 0 THEN 1 ELSE l[section] END AS level, CAST(section * 10 AS INT) AS sort_order, md5(body) AS digest FROM r""")
def _(t):
    return p.page_sections(t.wiki_pages, "page_id", "html").select("page_id", "section", "level", "sort_order", digest("body").alias("digest"))


@query("x10_page_blocks", """
SELECT page_id, 'image' AS type, 'https://file.mirror.example/file/a' || CAST(page_id AS VARCHAR) AS ref, '' AS text FROM pages UNION ALL
SELECT page_id, 'image', 'https://i.mirror.example/i/' || CAST(page_id AS VARCHAR) || '.jpg?x=1', '' FROM pages UNION ALL SELECT page_id, 'video', 'https://www.youtube.com/embed/vid' || CAST(1000 + page_id AS VARCHAR), '' FROM pages UNION ALL
SELECT page_id, 'external-link', 'https://www.other' || CAST(page_id % 4 AS VARCHAR) || '.example/x?a=1&b=2', 'out' FROM pages UNION ALL SELECT page_id, 'internal-link', 'Self', 'in' FROM pages UNION ALL SELECT page_id, 'table', '', '' FROM pages""")
def _(t):
    b = p.page_blocks(p.page_sections(t.wiki_pages, "page_id", "html"), "page_id")
    return b.where("type NOT IN ('paragraph', 'list')").select("page_id", "type", "ref", "text")


@query("w13_section_links", "SELECT page_id, 'Self' AS ref, 'in' AS text FROM pages")
def _(t):
    b = p.page_blocks(p.page_sections(t.wiki_pages, "page_id", "html"), "page_id")
    return p.best_section_links(b, "page_id").select("page_id", "ref", "text")


# marks for the beginning of a paragraph and for what ends one
MARKED = r"""regexp_replace(regexp_replace(regexp_extract(html, '(?i)<article\b[^>]*>([\s\S]*?)</article>', 1), '(?i)</p\b|<h[2-4]\b|<table\b|<ul\b|<ol\b', chr(2), 'g'), '(?i)<p\b[^>]*>', chr(1), 'g')"""
READABLE = "p"
for _p, _r in ((r"<[^>]+>", ""), ("&amp;", "&"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), (r"\[age\([^\]]+\)\]", ""), (r"\[dday\([^\]]+\)\]", ""), (r"''{2,5}", ""), (r"\s+", " "), (r"^\s+|\s+$", "")):
    READABLE = f"regexp_replace({READABLE}, '{_p}', '{_r}', 'g')"


@query("x10_text_blocks", f"""
SELECT page_id, 'paragraph' AS type, md5(t) AS digest FROM (SELECT page_id, {READABLE} AS t FROM (SELECT page_id, unnest(regexp_extract_all({MARKED}, chr(1) || '([^' || chr(1) || chr(2) || ']*)', 1)) AS p FROM wiki_pages)) WHERE length(t) >= 2
UNION ALL SELECT page_id, 'list', md5('G' || CAST(page_id % 20 AS VARCHAR) || ' member M' || CAST(page_id % 30 AS VARCHAR)) FROM pages""")
def _(t):
    b = p.page_blocks(p.page_sections(t.wiki_pages, "page_id", "html"), "page_id").where("type IN ('paragraph', 'list')")
    return b.select("page_id", "type", digest("text").alias("digest"))


CELLS = """SELECT page_id, replace(replace(html, 'background-color:#fff;', 'background-color:#fff;color:#0' || CAST(page_id % 10 AS STRING) || 'f;'), '<td></td></tr></table>', '<td><img src="//i.mirror.example/i/' || CAST(page_id AS STRING) || '.png"></td></tr></table>') AS html FROM wiki_pages"""


@query("x11_table_cells", """
SELECT page_id, 0 AS "row", 0 AS col, 1 AS rowspan, 2 AS colspan, true AS header, '#fff' AS background, '#0' || CAST(page_id % 10 AS VARCHAR) || 'f' AS color, 'center' AS align, 'G' || CAST(page_id % 20 AS VARCHAR) || ' album' AS text, '' AS image_url, '' AS link_url FROM pages UNION ALL
SELECT page_id, 1, 0, 1, 1, false, '', '', '', '2022. 1. 2.', '', '' FROM pages UNION ALL SELECT page_id, 1, 1, 1, 1, false, '', '', '', 'song', '', '/w/G' || CAST(page_id % 20 AS VARCHAR) || '/Song%20' || CAST(page_id % 7 AS VARCHAR) FROM pages UNION ALL
SELECT page_id, 2, 0, 2, 1, false, '', '', '', 'x', '', '' FROM pages UNION ALL SELECT page_id, 2, 1, 1, 1, false, '', '', '', '', 'https://i.mirror.example/i/' || CAST(page_id AS VARCHAR) || '.png', '' FROM pages""")
def _(t):
    return p.table_cells(p.page_blocks(p.page_sections(t.sql(CELLS), "page_id", "html"), "page_id"), ["page_id", "section", "pos"]).drop("section", "pos")


GRID = """SELECT page_id, '<article><table><tr><td></td><td>T</td><td>' || url || '</td></tr><tr><td>c</td><td>d</td><td></td></tr><tr><td>e</td><td>f</td></tr><tr><td>g</td><td>h</td></tr></table></article>' AS html FROM pages"""


@query("x42_trim_overflow", """
SELECT page_id, "row", col, CASE WHEN text = 'URL' THEN url ELSE text END AS text FROM pages, (VALUES (0, 1, 'T'), (0, 2, 'URL'), (1, 0, 'c'), (1, 1, 'd'), (2, 0, 'e'), (2, 1, 'f'), (3, 0, 'g'), (3, 1, 'h')) v("row", col, text)""")
def _(t):
    keys = ["page_id", "section", "pos"]
    c = p.table_cells(p.page_blocks(p.page_sections(t.sql(GRID), "page_id", "html"), "page_id"), keys)
    return p.trim_overflow(c, keys).select("page_id", "row", "col", "text")


@query("x12_markup_blocks", "SELECT id, md5(source_wikitext) AS digest FROM wiki_docs WHERE source_wikitext IS NOT NULL")
def _(t):
    d = p.blocked(t.wiki_docs, "id", "source_wikitext").select("id", F.array_join(p.block_texts("source_wikitext"), "").alias("w"))
    return d.select("id", digest("w").alias("digest"))


@query("x12_block_content", r"""
WITH l AS (SELECT id, unnest(string_split(source_wikitext, chr(10))) AS line FROM wiki_docs WHERE source_wikitext IS NOT NULL),
t AS (SELECT id, count_if(line LIKE '||%') AS n FROM l GROUP BY 1)
SELECT id, 'heading' AS type, CAST(length(regexp_extract(line, '^(={2,6})', 1)) AS INT) AS level, regexp_extract(line, '^={2,6}\s*(.*?)\s*={2,6}\s*$', 1) AS text, CAST(NULL AS INT) AS table_rows, NULL AS template, NULL AS media, NULL AS items FROM l WHERE regexp_matches(line, '^={2,6}\s*.*?\s*={2,6}\s*$')
UNION ALL SELECT id, 'table', NULL, NULL, CAST(n AS INT), NULL, NULL, NULL FROM t WHERE n > 0
UNION ALL SELECT id, 'template', NULL, NULL, NULL, replace(trim(regexp_extract(line, '^\[include\(([^,)]*)', 1)), 'Template: ', 'Template:'), NULL, NULL FROM l WHERE regexp_matches(line, '^\s*\[include\(.*\)\]\s*$')
UNION ALL SELECT id, 'media', NULL, NULL, NULL, NULL, 'file', NULL FROM l WHERE line LIKE '[[File:%'
UNION ALL SELECT id, 'list', NULL, NULL, NULL, NULL, NULL, string_agg(trim(substr(trim(line), 2)), '|') FROM l WHERE line LIKE ' * %' GROUP BY id""")
def _(t):
    b = p.block_content(p.markup_blocks(t.wiki_docs, "id", "source_wikitext"))
    b = b.where("type IN ('heading', 'table', 'template', 'media', 'list')")
    return b.select("id", "type", "level", F.when(F.col("type") == "heading", F.col("text")).alias("text"), "table_rows", "template", "media", F.array_join("items", "|").alias("items"))


@query("v3_lossless_split", "SELECT id FROM wiki_docs WHERE source_wikitext IS NOT NULL AND content_language = 'en'")
def _(t):
    docs = p.blocked(t.wiki_docs.withColumn("id", F.struct("id", "content_language")), "id", "source_wikitext")
    # English documents lose their second block, which the check has to find
    broken = F.filter(p.block_texts("source_wikitext"), lambda x, i: (F.col("id.content_language") != "en") | (i != 1))
    return lossy_splits(docs, "id", "source_wikitext", broken).select("id.id")


@query("x13_structure_statistics", """
SELECT id, 14 + CASE WHEN id % 13 = 0 THEN 1 ELSE 0 END AS blocks, 3 AS headings, 1 AS tables, 1 + CASE WHEN id % 13 = 0 THEN 1 ELSE 0 END AS templates, 1 AS media, 1 AS fallbacks, 2 AS links FROM wiki_docs WHERE source_wikitext IS NOT NULL""")
def _(t):
    return p.structure_statistics(t.wiki_docs, "id", "source_wikitext")


@query("x21_markup_cells", """
SELECT id, 0 AS "row", 0 AS col, '<-2>' AS options, 'a' AS content, 'a' AS text FROM wiki_docs WHERE source_wikitext IS NOT NULL UNION ALL SELECT id, 0, 1, '', 'b', 'b' FROM wiki_docs WHERE source_wikitext IS NOT NULL UNION ALL
SELECT id, 1, 0, '', 'c' || CAST(id % 5 AS VARCHAR), 'c' || CAST(id % 5 AS VARCHAR) FROM wiki_docs WHERE source_wikitext IS NOT NULL UNION ALL SELECT id, 1, 1, '', '[[G1|one]]', 'one' FROM wiki_docs WHERE source_wikitext IS NOT NULL UNION ALL
SELECT id, 1, 2, '', 'd', 'd' FROM wiki_docs WHERE source_wikitext IS NOT NULL""")
def _(t):
    return p.markup_cells(t.wiki_docs, "id", "source_wikitext").select("id", "row", "col", "options", "content", "text")


INFOBOX = """SELECT id, 'lead' || chr(10) || '||<tablealign=right> 이름 || Name ' || CAST(id AS STRING) || ' ||' || chr(10) || '||<|2> 데뷔일 || [include(틀:국기, 국명=가)] || [[2024년]] [[' || CAST(1 + id % 12 AS STRING) || '월 7일]] ||' || chr(10)
 || '|| [include(틀:국기, 국명=나)] || 2021년 1월 2일 ||' || chr(10) || '|| 상징 || {{{#red x}}} ||' || chr(10) || '|| 빈칸 || ||' || chr(10) || '|| 긴칸 || {{{#!wiki s' || chr(10) || '|| inner || row ||' || chr(10) || '}}} ||' || chr(10)
 || '== Next ==' || chr(10) || '|| other || table ||' || chr(10) || text AS src FROM wiki_docs"""


@query("x22_infobox_fields", f"""
SELECT id, '이름' AS label, 'text' AS kind, 'Name ' || CAST(id AS VARCHAR) AS value, '' AS lock FROM ({INFOBOX}) UNION ALL SELECT id, '데뷔일 · 가', 'date', '2024-' || lpad(CAST(1 + id % 12 AS VARCHAR), 2, '0') || '-07', '' FROM ({INFOBOX}) UNION ALL
SELECT id, '데뷔일 · 나', 'date', '2021-01-02', '' FROM ({INFOBOX}) UNION ALL SELECT id, '상징', 'locked', '{{{{{{#red x}}}}}}', 'Styled wiki block' FROM ({INFOBOX}) UNION ALL
SELECT id, '빈칸', 'locked', '', 'Empty value' FROM ({INFOBOX}) UNION ALL SELECT id, '긴칸', 'locked', '긴칸', 'Multi-line or nested structured field' FROM ({INFOBOX})""")
def _(t):
    return p.infobox_fields(t.sql(INFOBOX), "id", "src").drop("line")


HEADING_LINE = "(" + " OR ".join(rf"regexp_matches(line, '^={{{n}}}\s*.*?\s*={{{n}}}\s*$')" for n in range(2, 7)) + ")"
LINES = rf"""l AS (SELECT id, unnest(string_split_regex(regexp_replace(source_wikitext, '\r\n?', chr(10), 'g'), '\n')) AS line, generate_subscripts(string_split_regex(regexp_replace(source_wikitext, '\r\n?', chr(10), 'g'), '\n'), 1) - 1 AS line_no FROM wiki_docs WHERE source_wikitext IS NOT NULL),
h AS (SELECT id, CAST(line_no AS INT) AS line_no, line, {HEADING_LINE} AS is_heading, len(regexp_extract_all(line, '\{{\{{\{{')) - len(regexp_extract_all(line, '\}}\}}\}}')) AS delta FROM l)"""


LOCK = "CASE " + " ".join(f"WHEN regexp_matches(line, '{rule}') THEN '{reason}'" for rule, reason in p.LOCK_RULES) + " ELSE '' END"
NL = "' || chr(10) || '"
READS = (
    (r"(?i)\[br\]", NL), (r"\[\*\s*\]", ""), (r"\[\*\s*([^\[\]]*?)\s*\]", r" (Note: \1)"), (r"\[\[([^\]|]+)\|([^\]]+)\]\]", r"\2"), (r"\[\[([^\]]+)\]\]", r"\1"),
    (r"\[https?://[^\s\]]+\s+([^\]]+)\]", r"\1"), (r"\[https?://[^\]]+\]", ""), ("''" * 3, ""), ("''" * 2, ""), (r"\^\^", ""), ("~~", ""),
    (r"(?m)^\s*\*\s?", "• "), (r"[ \t]+\n", NL), (r"\n{3,}", NL * 2), (r"^\s+|\s+$", ""),
)
PLAIN = "raw"
for _p, _r in READS:
    PLAIN = f"regexp_replace({PLAIN}, '{_p}', '{_r}', 'g')"


@query("x23_editable_blocks", rf"""
WITH {LINES}, n AS (SELECT *, sum(CASE WHEN is_heading THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY line_no) AS section, {LOCK} AS rule FROM h),
d AS (SELECT *, sum(CASE WHEN is_heading THEN 0 ELSE delta END) OVER (PARTITION BY id, section ORDER BY line_no) AS depth FROM n),
f AS (SELECT *, coalesce(lag(depth) OVER (PARTITION BY id ORDER BY line_no), 0) AS before FROM d),
g AS (SELECT *, before > 0 OR rule <> '' AS protected, trim(line, ' ' || chr(9)) = '' AND before = 0 AS blank FROM f),
b AS (SELECT *, NOT is_heading AND NOT blank AND coalesce(lag(is_heading) OVER w OR lag(blank) OVER w OR (before = 0 AND lag(protected) OVER w <> protected), true) AS fresh FROM g WINDOW w AS (PARTITION BY id ORDER BY line_no)),
c AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY id, section ORDER BY line_no) AS nth FROM b),
r AS (SELECT id, section, nth - 1 AS block, regexp_replace(string_agg(line, chr(10) ORDER BY line_no), '^\s+|\s+$', '', 'g') AS raw, first(before ORDER BY line_no) AS depth, coalesce(first(rule ORDER BY line_no) FILTER (WHERE rule <> ''), '') AS rule FROM c WHERE NOT is_heading AND NOT blank AND nth > 0 GROUP BY 1, 2, 3),
x AS (SELECT id, section, block, CASE WHEN section = 0 THEN 'Document lead metadata' WHEN depth > 0 THEN 'Inside a protected wiki block' WHEN rule <> '' THEN rule WHEN raw = '' THEN 'Empty block' ELSE '' END AS lock, length({PLAIN}) AS n FROM r)
SELECT id, CAST(section AS INT) AS section, CAST(block AS INT) AS block, CASE WHEN lock = '' AND n = 0 THEN 'Unsupported wiki syntax' ELSE lock END AS lock, lock = '' AND n > 0 AS editable, n FROM x""")
def _(t):
    return p.editable_blocks(t.wiki_docs, "id", "source_wikitext").select("id", "section", "block", "lock", "editable", F.length("plain").alias("n"))


@query("w10_section_numbering", f"""
WITH {LINES} SELECT id, line_no, is_heading, CAST(sum(CASE WHEN is_heading THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY line_no) AS INT) AS section FROM h""")
def _(t):
    return p.markup_lines(t.wiki_docs, "id", "source_wikitext").select("id", "line_no", "is_heading", "section")


@query("w11_nesting_depth", f"""
WITH {LINES}, s AS (SELECT *, sum(CASE WHEN is_heading THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY line_no) AS section FROM h),
c AS (SELECT *, sum(CASE WHEN is_heading THEN 0 ELSE delta END) OVER (PARTITION BY id, section ORDER BY line_no) AS c FROM s)
SELECT id, line_no, CAST(c - least(0, min(c) OVER (PARTITION BY id, section ORDER BY line_no)) AS INT) AS depth_after FROM c""")
def _(t):
    return p.markup_lines(t.wiki_docs, "id", "source_wikitext").select("id", "line_no", "depth_after")


@query("w12_line_chunks", r"""
WITH RECURSIVE d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
n AS (SELECT doc_id, l, len(l) AS k FROM d),
r AS (SELECT doc_id, 1 AS i, 0 AS chunk, CAST(length(l[1]) + CASE WHEN k > 1 THEN 1 ELSE 0 END AS BIGINT) AS cur, k, l FROM n UNION ALL
 SELECT doc_id, i + 1, CASE WHEN cur > 0 AND cur + length(l[i + 1]) + CASE WHEN i + 1 < k THEN 1 ELSE 0 END > 500 THEN chunk + 1 ELSE chunk END,
  CASE WHEN cur > 0 AND cur + length(l[i + 1]) + CASE WHEN i + 1 < k THEN 1 ELSE 0 END > 500 THEN 0 ELSE cur END + length(l[i + 1]) + CASE WHEN i + 1 < k THEN 1 ELSE 0 END, k, l FROM r WHERE i < k)
SELECT doc_id, chunk, max(cur) AS n FROM r GROUP BY 1, 2""")
def _(t):
    return p.line_chunks(t.documents, "doc_id", "text", 500).select("doc_id", "chunk", F.length("text").cast("bigint").alias("n"))


ALBUMS = """SELECT doc_id AS id, '||<tableclass=albums> [[Album ' || CAST(doc_id AS STRING) || '|x]] 2024. ' || CAST(1 + doc_id % 12 AS STRING) || '. 3. || [[File:x.png]] 2020. 1. 1. || no link 2021. 1. 1. ||' || chr(10)
 || '|| Label ' || CAST(doc_id % 9 AS STRING) || ' || none || [[First#a|f]] || [[Second]] ||' || chr(10) || text AS src FROM documents"""


@query("x30_release_catalog", f"SELECT id, 'Album ' || CAST(id AS VARCHAR) AS target, '2024-' || lpad(CAST(1 + id % 12 AS VARCHAR), 2, '0') || '-03' AS date FROM ({ALBUMS})")
def _(t):
    cells = p.markup_cells(t.sql(ALBUMS).where("src RLIKE '(?i)tableclass=albums'"), "id", "src")
    return p.release_catalog(cells, "id")


@query("x30_relation_catalog", f"SELECT id, 'Label ' || CAST(id % 9 AS VARCHAR) AS label, 'First' AS target FROM ({ALBUMS})")
def _(t):
    return p.relation_catalog(p.markup_cells(t.sql(ALBUMS), "id", "src"), "id")


KOREAN = "SELECT doc_id AS id, '[[항목 ' || CAST(doc_id AS STRING) || ']] and [[다른/항목 ' || CAST(doc_id AS STRING) || '#s-1|한글]] and [[A|b]] [[파일:가.png]]' || chr(10) || replace(text, '[', '(') AS src FROM documents"
NAMES = "SELECT '항목 ' || CAST(doc_id AS STRING) AS target, 'Item ' || CAST(doc_id AS STRING) AS label, doc_id AS ordinal FROM documents WHERE lang IN ('en', 'fr')"


@query("x31_localized_links", f"""
WITH k AS (SELECT s.id, s.src, d.lang IN ('en', 'fr') AS known FROM ({KOREAN}) s JOIN documents d ON d.doc_id = s.id)
SELECT id, CASE WHEN known THEN 2 ELSE 0 END AS localized, md5(CASE WHEN known THEN replace(replace(src, '[[항목 ' || CAST(id AS VARCHAR) || ']]', '[[항목 ' || CAST(id AS VARCHAR) || '|Item ' || CAST(id AS VARCHAR) || ']]'), '|한글]]', '|Item ' || CAST(id AS VARCHAR) || ']]') ELSE src END) AS digest FROM k""")
def _(t):
    d = p.localize_links(t.sql(KOREAN), "id", "src", label_index(t.sql(NAMES)))
    return d.select("id", "localized", digest("text").alias("digest"))


ENGLISH = """SELECT id, source_title, translated_title, source_wikitext || chr(10) || '[include(틀:상세 내용, 문서명=D' || CAST(id AS STRING) || ', 표시명=Detail ' || CAST(id AS STRING) || ')]' AS content_wikitext, content_language FROM wiki_docs"""


@query("a14_label_rows", f"""
SELECT source_title AS target, translated_title AS label, CAST(0 AS INT) AS step FROM wiki_docs WHERE translated_title IS NOT NULL UNION ALL
SELECT regexp_extract(x, '\\[\\[([^\\[\\]|#]+)', 1), regexp_extract(x, '\\|([^\\[\\]]+)', 1), 1 FROM (SELECT unnest(regexp_extract_all(content_wikitext, '\\[\\[[^\\[\\]|#]+(?:#[^\\]|]*)?\\|[^\\[\\]]+\\]\\]')) AS x FROM ({ENGLISH}) WHERE content_language = 'en') UNION ALL
SELECT 'D' || CAST(id AS VARCHAR), 'Detail ' || CAST(id AS VARCHAR), 2 FROM ({ENGLISH}) WHERE content_language = 'en' AND content_wikitext IS NOT NULL""")
def _(t):
    return p.label_rows(t.sql(ENGLISH)).select("target", "label", F.col("ordinal.step").alias("step"))


CALLS = """SELECT doc_id AS id, '[include(틀:국기, 국명=항목 ' || CAST(doc_id AS STRING) || ')] [include(틀:상세 내용, 문서명=G/항목 ' || CAST(doc_id AS STRING) || ')] [include(틀:음반 표시, 음반종류=정규, n집=' || CAST(doc_id % 30 AS STRING) || '집)] [include(틀:국기, 국명=가, 출력=x)]' || chr(10) || text AS src FROM documents"""


@query("x32_template_labels", f"""
WITH k AS (SELECT doc_id AS id, lang IN ('en', 'fr') AS known, doc_id % 30 AS n FROM documents)
SELECT id, 0 AS call, '출력' AS param, '항목 ' || CAST(id AS VARCHAR) AS target, CASE WHEN known THEN 'Item ' || CAST(id AS VARCHAR) ELSE '' END AS label FROM k UNION ALL
SELECT id, 1, '표시명', 'G/항목 ' || CAST(id AS VARCHAR), CASE WHEN known THEN 'Item ' || CAST(id AS VARCHAR) ELSE '' END FROM k UNION ALL SELECT id, 2, '음반종류', '정규', 'Studio Album' FROM k UNION ALL
SELECT id, 2, 'n집', CAST(n AS VARCHAR) || '집', CAST(n AS VARCHAR) || CASE WHEN n % 100 BETWEEN 11 AND 13 THEN 'th' WHEN n % 10 = 1 THEN 'st' WHEN n % 10 = 2 THEN 'nd' WHEN n % 10 = 3 THEN 'rd' ELSE 'th' END FROM k""")
def _(t):
    return p.template_labels(template_calls(t.sql(CALLS), "id", "src"), "id", label_index(t.sql(NAMES)))
