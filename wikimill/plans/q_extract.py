"""X*: extraction from pages and markup."""

from pyspark.sql import functions as F

from ..functions import html as h
from ..functions import keys as k
from ..functions import markup as m
from ..functions.dates import expand_date_macros, iso_date
from ..functions.urls import Site, remote_candidates
from ..operators import extract as x
from ..operators.ranking import top_rows
from .registry import query



def as_of():
    """The moment date macros refer to; fixed so that results do not change."""
    return F.lit("2024-07-01 20:00:00").cast("timestamp")


TEXT = "c"
for _p, _r in ((r"(?i)<script[\s\S]*?</script>", ""), (r"(?i)<style[\s\S]*?</style>", ""), (r"(?i)<br\s*/?>", "\n"), (r"(?i)</p>|</div>|</li>|</tr>|</h[1-6]>", "\n"), (r"<[^>]+>", ""), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", "")):
    TEXT = f"regexp_replace({TEXT}, '{_p}', '{_r}', 'g')"
for _e, _v in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#x27;", "''")):
    TEXT = f"replace({TEXT}, '{_e}', '{_v}')"


@query("x1_html_to_text", f"SELECT page_id, length(t) AS n, md5(t) AS digest FROM (SELECT page_id, {TEXT} AS t FROM (SELECT page_id, html AS c FROM wiki_pages))")
def _(t):
    d = t.wiki_pages.select("page_id", h.html_to_text("html").alias("t"))
    return d.select("page_id", F.length("t").alias("n"), F.md5(F.col("t").cast("binary")).alias("digest"))


ROOT_LINKS = Site(mirror="mirror.example", wiki_path="/")


@query("x2_internal_links", r"""
WITH l AS (SELECT page_id, unnest(list_distinct(list_transform(regexp_extract_all(html, '(?i)href=["'']/([^"''#?]+)[^"'']*["'']', 1), lambda v: url_decode(v)))) AS title FROM pages)
SELECT page_id, title FROM l WHERE NOT regexp_matches(title, '/$') AND NOT regexp_matches(title, '^@.+@$') AND NOT regexp_matches(title, '^(분류|파일|틀|나무위키|특수기능|사용자):')""")
def _(t):
    return x.items(t.pages, "page_id", h.internal_links("html", ROOT_LINKS), "title").select("page_id", "title")


@query("x3_external_links", r"""
WITH l AS (SELECT page_id, unnest(list_distinct(list_transform(regexp_extract_all(html, '(?i)href=["''](https?://[^"'']+)["'']', 1), lambda v: replace(v, '&amp;', '&')))) AS url FROM wiki_pages)
SELECT page_id, url FROM l WHERE NOT regexp_matches(url, '^https?://(www\.)?(mirror|wiki)\.example(/|$)')""")
def _(t):
    return x.items(t.wiki_pages, "page_id", h.external_links("html"), "url").select("page_id", "url")


@query("x4_image_refs", r"""
WITH l AS (SELECT page_id, list_concat(regexp_extract_all(html, '(?:파일:|Image:\s*파일:)([^|<\]\n]+)', 1), regexp_extract_all(html, '(?i)(?:src|data-src)=["''](https?://[^"'']+)["'']', 1),
 regexp_extract_all(html, '(?i)https?://[^"''<>\s]+\.(?:jpg|jpeg|png|webp|gif|svg)(?:\?[^"''<>\s]*)?')) AS a FROM (SELECT page_id, replace(html, 'File:', '파일:') || '<i data-src="https://cdn.example/' || CAST(page_id AS VARCHAR) || '.webp?v=2"></i>' AS html FROM wiki_pages))
SELECT DISTINCT page_id, trim(ref) AS ref FROM (SELECT page_id, unnest(a) AS ref FROM l) WHERE NOT ref LIKE 'http%' OR regexp_matches(ref, '(?i)\.(?:jpg|jpeg|png|webp|gif|svg)(?:\?|$)')""")
def _(t):
    d = t.sql("SELECT page_id, replace(html, 'File:', '파일:') || '<i data-src=\"https://cdn.example/' || CAST(page_id AS STRING) || '.webp?v=2\"></i>' AS html FROM wiki_pages")
    return x.items(d, "page_id", h.image_refs("html"), "ref").select("page_id", "ref")


@query("x5_videos", "SELECT page_id, 'https://www.youtube.com/embed/vid' || CAST(1000 + page_id AS VARCHAR) AS url, 'youtube' AS provider, 'vid' || CAST(1000 + page_id AS VARCHAR) AS video_id FROM pages")
def _(t):
    return x.videos(t.wiki_pages, "page_id", "html").drop("pos")


@query("x6_rendered_files", """
SELECT page_id, 'f' || CAST(page_id % 50 AS VARCHAR) || '.png' AS file, 'https://file.mirror.example/file/a' || CAST(page_id AS VARCHAR) AS url FROM pages UNION ALL
SELECT page_id, 'g' || CAST(page_id % 9 AS VARCHAR) || '.jpg' AS file, 'https://i.mirror.example/i/' || CAST(page_id AS VARCHAR) || '.jpg?x=1' AS url FROM pages""")
def _(t):
    return x.rendered_files(t.wiki_pages, "page_id", "html")


@query("x7_file_targets", "SELECT page_id, 'r' || CAST(page_id % 8 AS VARCHAR) || '.png' AS file, 'Target' || CAST(page_id % 6 AS VARCHAR) AS target FROM pages")
def _(t):
    return x.file_targets(x.raw_bundle(t.wiki_pages, "page_id", "html"), "page_id", "source_wikitext")


@query("x8_article_body", r"SELECT page_id, length(a) AS n, md5(a) AS digest FROM (SELECT page_id, regexp_extract(html, '(?i)<article\b[^>]*>([\s\S]*?)</article>', 1) AS a FROM pages)")
def _(t):
    d = t.pages.select("page_id", h.article_html("html").alias("a"))
    return d.select("page_id", F.length("a").alias("n"), F.md5(F.col("a").cast("binary")).alias("digest"))


@query("x9_segments", r"""
WITH a AS (SELECT page_id, regexp_extract(html, '(?i)<article\b[^>]*>([\s\S]*?)</article>', 1) AS c FROM wiki_pages),
s AS (SELECT page_id, string_split_regex(c, '<pre><code>|</code></pre>') AS p FROM a)
SELECT page_id, 0 AS segment_index, 'rendered' AS type, md5(trim(p[1], chr(10) || ' ')) AS digest FROM s UNION ALL SELECT page_id, 1 AS segment_index, 'raw' AS type, md5(p[2]) AS digest FROM s
UNION ALL SELECT page_id, 2 AS segment_index, 'rendered' AS type, md5(trim(p[3], chr(10) || ' ')) AS digest FROM s""")
def _(t):
    return x.segments(t.wiki_pages, "page_id", "html").select("page_id", "segment_index", "type", F.md5(F.col("source").cast("binary")).alias("digest"))


FEATURES = {
    "table_lines": r"(?:^|\n)[^\n]*\|\|", "folding": r"#!folding\b", "include": r"(?i)\[include\(", "wiki": r"#!wiki\b", "if_macro": r"#!if\b", "youtube": r"(?i)\[youtube\(",
    "colspan": r"<-\d+>", "rowspan": r"<(?:\^|v)?\|\d+>", "toc": r"(?i)\[(?:목차|tableofcontents)\]", "category": r"(?i)\[\[(?:분류|Category):",
}
ACTIVE = r"array_to_string(list_filter(string_split_regex(source_wikitext, '\r?\n'), lambda x: NOT regexp_matches(x, '^\s*##')), chr(10))"


@query("x14_source_features", f"""
WITH r AS (SELECT id, {ACTIVE} AS raw FROM wiki_docs WHERE source_wikitext IS NOT NULL)
SELECT id, {", ".join(f"len(regexp_extract_all(raw, '{p}')) AS {n}" for n, p in FEATURES.items())},
 len(regexp_extract_all(raw, '\\[\\*')) - len(regexp_extract_all(raw, '\\[\\*\\*')) AS footnote,
 len(list_filter(string_split(raw, chr(10)), lambda l: regexp_matches(l, '^={{1,6}}\\s*[^\\n=].*?\\s*={{1,6}}$'))) AS headings,
 len(list_filter(regexp_extract_all(raw, '\\[\\[([^\\]|]+)(?:\\|[^\\]]*)?\\]\\]', 1), lambda l: trim(l) <> '' AND NOT regexp_matches(trim(l), '(?i)^(?:파일|File|분류|Category):'))) AS links,
 len(regexp_extract_all(raw, '(?i)\\[\\[(?:파일|File):[^\\]|]+')) AS file_refs FROM r""")
def _(t):
    d = t.wiki_docs.where("source_wikitext IS NOT NULL").select("id", m.active_source("source_wikitext").alias("raw"))
    return d.select("id", *[c.alias(n) for n, c in m.source_features(F.col("raw")).items()])


RENDERED = {
    "tables": r"(?i)<table\b", "details": r"(?i)<details\b", "colspan": r"(?i)<[^>]*\scolspan\s*=", "rowspan": r"(?i)<[^>]*\srowspan\s*=",
    "headings": r"(?i)<h[1-6]\b", "images": r"(?i)<img\b", "svg": r"(?i)<svg\b", "youtube": r"""(?i)<iframe\b[^>]*youtube\.com/embed/""",
}


RENDERED_PAGES = """SELECT page_id, html || repeat('<span id="f" class="a wiki-fn-content">n</span>', CAST(page_id % 3 AS INT)) || CASE WHEN page_id % 2 = 0 THEN '<div class="wiki-macro-toc">t</div><div class="wiki-heading x">h</div>' ELSE '' END
 || repeat('<a class="wiki-link-internal" href="/w/L">l</a><a class="wiki-link-internal-not" href="/w/L">l</a>', CAST(page_id % 4 AS INT)) AS html FROM wiki_pages"""


CLASSES = {"footnotes": ("[^>]*", "wiki-fn-content", "page_id % 3"), "toc": ("[^>]*", "wiki-macro-toc", "CAST(page_id % 2 = 0 AS INT)"), "links": (r"a\b[^>]*", "wiki-link-internal", "page_id % 4 * 2")}


@query("x15_rendered_features", f"""SELECT page_id, {", ".join(f"len(regexp_extract_all(html, '{p}')) + {'CAST(page_id % 2 = 0 AS INT)' if n == 'headings' else 0} AS {n}" for n, p in RENDERED.items())},
 {", ".join(f"""len(regexp_extract_all(html, '(?i)<{tag}\\bclass="[^"]*\\b{name}\\b')) + {more} AS {n}""" for n, (tag, name, more) in CLASSES.items())} FROM wiki_pages""")
def _(t):
    return t.sql(RENDERED_PAGES).select("page_id", *[c.alias(n) for n, c in h.rendered_features("html").items()])


GRAMMAR_SRC = """SELECT id, '{{{#!wiki a' || chr(10) || 'x}}}{{{#!folding b' || chr(10) || 'y}}}' || CASE WHEN id % 3 = 0 THEN '[[open {{{' ELSE ']] }}}' END || chr(10) || replace(replace(text, '[', '('), '{', '(') AS src FROM wiki_docs"""


@query("x16_grammar_analysis", f"""
SELECT id, length(src) AS source_chars, length(src) + 1 AS normalized_chars, true AS normalized_changed, 0 AS repairs, 1 AS d_wiki, 0 AS d_if, 0 AS d_style, 1 AS d_folding, 0 AS d_html,
 CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END AS square_balance, CASE WHEN id % 3 = 0 THEN 1 ELSE 0 END AS curly_balance FROM ({GRAMMAR_SRC})""")
def _(t):
    return x.grammar_analysis(t.sql(GRAMMAR_SRC), "id", "src")


@query("a7_grammar_totals", f"""
SELECT count(*) AS blocks, count(*) AS normalized_blocks, CAST(0 AS BIGINT) AS repairs, count(*) AS d_wiki, CAST(0 AS BIGINT) AS d_if, CAST(0 AS BIGINT) AS d_style, count(*) AS d_folding, CAST(0 AS BIGINT) AS d_html,
 CAST(count_if(id % 3 = 0) AS BIGINT) AS unbalanced_blocks FROM ({GRAMMAR_SRC})""")
def _(t):
    from ..operators.aggregates import merge_grammar

    return merge_grammar(x.grammar_analysis(t.sql(GRAMMAR_SRC), "id", "src"))


@query("x17_block_boundaries", f"SELECT id, md5(replace(src, 'x}}}}}}{{{{{{#', 'x}}}}}}' || chr(10) || '{{{{{{#')) AS digest FROM ({GRAMMAR_SRC})")
def _(t):
    return x.with_block_boundaries(t.sql(GRAMMAR_SRC), "src", "fixed").select("id", F.md5(F.col("fixed").cast("binary")).alias("digest"))


IF_SRC = """SELECT id, '{{{#!if a == null' || chr(10) || 'one}}} {{{#!if ' || CASE id % 4 WHEN 0 THEN '(a != null || 3 > 2)' WHEN 1 THEN 'b === ''x'' && c == null' WHEN 2 THEN 'a b == null' ELSE '!(x) && 1 <= 2' END || chr(10) || 'two}}}' || chr(10) || replace(text, '{', '(') AS src FROM wiki_docs"""


@query("x18_conditions", f"""
SELECT id, 0 AS pos, 'a == null' AS condition, 'true' AS value, true AS shown FROM ({IF_SRC}) UNION ALL
SELECT id, 1 AS pos, CASE id % 4 WHEN 0 THEN '(a != null || 3 > 2)' WHEN 1 THEN 'b === ''x'' && c == null' WHEN 2 THEN 'a b == null' ELSE '!(x) && 1 <= 2' END AS condition,
 CASE id % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN 'unknown' ELSE 'true' END AS value, id % 4 IN (0, 3) AS shown FROM ({IF_SRC})""")
def _(t):
    d = x.conditional_calls(t.sql(IF_SRC), "id", "src")
    return d.select("id", "pos", "condition", F.coalesce(F.col("value").cast("string"), F.lit("unknown")).alias("value"), "shown")


CALLING = """SELECT doc_id, '[include(틀:T' || CAST(doc_id % 7 AS STRING) || ', a=v' || CAST(doc_id % 4 AS STRING) || ', n=3' || CASE WHEN doc_id % 3 = 0 THEN ', c=x, c=' || CAST(doc_id % 5 AS STRING) ELSE '' END || ')] [include(틀:None, a=1)]' || chr(10) || translate(coalesce(text, ''), '[]{}', '    ') AS src FROM documents"""
CALLED = """SELECT '틀:T' || CAST(k AS STRING) AS title, '{{{#!if a == "v1"' || chr(10) || 'A}}}{{{#!if c == null || a == "v2"' || chr(10) || 'B {{{#!if c != "4"' || chr(10) || 'C}}}}}}{{{#!if c x != null' || chr(10) || 'D}}}{{{#!if n > 2' || chr(10) || 'E}}}{{{#!if !(a != "v0") && b == null' || chr(10) || 'F}}}' || CAST(k AS STRING) AS source FROM (SELECT DISTINCT doc_id % 7 AS k FROM documents)"""


@query("x18_call_conditions", """
WITH d AS (SELECT doc_id, 'v' || CAST(doc_id % 4 AS VARCHAR) AS a, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id % 5 AS VARCHAR) END AS c FROM documents),
r AS (SELECT doc_id, 0 AS pos, 'a == "v1"' AS condition, a = 'v1' AS value FROM d UNION ALL SELECT doc_id, 1, 'c == null || a == "v2"', c IS NULL OR a = 'v2' FROM d
 UNION ALL SELECT doc_id, 2, 'c != "4"', c IS DISTINCT FROM '4' FROM d UNION ALL SELECT doc_id, 3, 'c x != null', NULL FROM d UNION ALL SELECT doc_id, 4, 'n > 2', NULL FROM d
 UNION ALL SELECT doc_id, 5, '!(a != "v0") && b == null', a = 'v0' FROM d)
SELECT doc_id, 0 AS call, '틀:T' || CAST(doc_id % 7 AS VARCHAR) AS template, pos, condition, coalesce(CAST(value AS VARCHAR), 'unknown') AS value, coalesce(value, false) AS shown FROM r""")
def _(t):
    d = x.call_conditions(t.sql(CALLING), "doc_id", "src", t.sql(CALLED))
    return d.withColumn("value", F.coalesce(F.col("value").cast("string"), F.lit("unknown")))


@query("x18_resolved_text", f"""
SELECT id, 'one ' || CASE WHEN id % 4 IN (0, 3) THEN 'two' ELSE '' END || chr(10) || replace(text, '{{', '(') AS text, 2 AS evaluated, CASE WHEN id % 4 IN (0, 3) THEN 2 ELSE 1 END AS included,
 CASE WHEN id % 4 IN (0, 3) THEN 0 ELSE 1 END AS excluded FROM wiki_docs""")
def _(t):
    return x.resolve_conditions(t.sql(IF_SRC), "id", "src")


@query("x19_template_calls", r"""
WITH c AS (SELECT id, regexp_extract(source_wikitext, '\[include\((Template:T[0-9]+)', 1) AS template FROM wiki_docs WHERE source_wikitext IS NOT NULL)
SELECT id, 0 AS call, template, 0 AS param, 'k' AS name, false AS positional, 'v' || CAST(id % 4 AS VARCHAR) AS value FROM c UNION ALL SELECT id, 0, template, 1, '', true, 'second' FROM c
UNION ALL SELECT id, 0, template, 2, 'deep', false, '(a,b)' FROM c""")
def _(t):
    return x.template_calls(t.wiki_docs, "id", "source_wikitext").drop("lock_reason")


@query("x20_media_calls", """
SELECT id, 0 AS pos, 'file' AS kind, 'File:f' || CAST(id % 50 AS VARCHAR) || '.png' AS target, 1 AS n_options, 'width=100' AS options FROM wiki_docs WHERE source_wikitext IS NOT NULL
UNION ALL SELECT id, 1, 'youtube', 'abc' || CAST(1000 + id AS VARCHAR), 0, '' FROM wiki_docs WHERE source_wikitext IS NOT NULL""")
def _(t):
    return x.media_calls(t.wiki_docs.where("source_wikitext IS NOT NULL"), "id", "source_wikitext")


@query("x27_slugs", r"""
SELECT id, CASE WHEN s = '' THEN 'section-' || CAST(id AS VARCHAR) ELSE s END AS slug, CASE WHEN p = '' THEN 'asset' ELSE p END AS part FROM (SELECT id,
 regexp_replace(regexp_replace(regexp_replace(lower(v), '^\d+(?:\.\d+)*\.?\s*', ''), '[^a-z0-9가-힣]+', '-', 'g'), '^-+|-+$', '', 'g') AS s,
 substr(regexp_replace(regexp_replace(lower(v), '[^a-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80) AS p FROM (SELECT page_id AS id, CAST(page_id AS VARCHAR) || '.1 ' || url AS v FROM pages))""")
def _(t):
    d = t.sql("SELECT page_id AS id, CAST(page_id AS STRING) || '.1 ' || url AS v FROM pages")
    return d.select("id", k.anchor_slug("v", F.col("id")).alias("slug"), k.path_part("v").alias("part"))


@query("x28_date_macros", """
SELECT event_id, CASE WHEN n >= 0 THEN '+' || CAST(n AS VARCHAR) ELSE CAST(n AS VARCHAR) END || ' and ' || CAST(greatest(0, date_sub('year', d, DATE '2024-07-02')) AS VARCHAR) || ' [dday(2024-13-01)]' AS text
FROM (SELECT event_id, CAST(ts - INTERVAL '7000' DAY AS DATE) AS d, datediff('day', CAST(ts - INTERVAL '7000' DAY AS DATE), DATE '2024-07-02') AS n FROM events)""")
def _(t):
    d = t.sql("SELECT event_id, CAST(CAST(ts - INTERVAL '7000' DAY AS DATE) AS STRING) AS d FROM events")
    text = F.format_string("[dday(%s)] and &#91;age(%s)&#93; [dday(2024-13-01)]", "d", "d")
    return d.select("event_id", expand_date_macros(text, as_of()).alias("text"))


@query("x29_iso_dates", """
SELECT page_id, '2024-' || lpad(CAST(1 + page_id % 12 AS VARCHAR), 2, '0') || '-' || lpad(CAST(1 + page_id % 28 AS VARCHAR), 2, '0') AS first_date FROM pages""")
def _(t):
    return t.wiki_pages.select("page_id", iso_date("html").alias("first_date"))


RESOLVED = r"""CASE WHEN regexp_matches(t0, '(?i)^(?:https?:|ftp:|mailto:|tel:)') THEN '' WHEN regexp_matches(t2, '(?i)^(?:파일|File|분류|Category|틀|Template|나무위키|사용자|User|토론|특수기능|Special):') THEN '' ELSE t2 END"""


@query("x33_link_targets", rf"""
WITH a AS (SELECT id, current_title, trim(target) AS t0, trim(regexp_replace(trim(regexp_replace(trim(target), '^:', '')), '#.*$', '')) AS t1 FROM plain_links),
b AS (SELECT *, CASE WHEN starts_with(t1, '/') THEN regexp_replace(current_title, '/$', '') || t1 ELSE t1 END AS t2 FROM a)
SELECT id, {RESOLVED} AS title FROM b""")
def _(t):
    return t.plain_links.select("id", m.resolve_link(F.col("target"), F.col("current_title")).alias("title"))


@query("x34_page_links", rf"""
WITH l AS (SELECT id, unnest(m) AS inside, generate_subscripts(m, 1) AS k FROM (SELECT id, regexp_extract_all({ACTIVE}, '\[\[([^\[\]]+?)\]\]', 1) AS m FROM wiki_docs WHERE source_wikitext IS NOT NULL)),
a AS (SELECT id, k, trim(regexp_extract(inside, '^([^|]*)', 1)) AS t0, trim(regexp_replace(regexp_replace(inside, '^[^|]*\|', ''), '\s+', ' ', 'g')) AS text FROM l), b AS (SELECT id, k, text, t0, trim(regexp_replace(t0, '#.*$', '')) AS t2 FROM a)
SELECT id, title, arg_min(text, k) AS text FROM (SELECT id, k, text, {RESOLVED} AS title FROM b) WHERE title <> '' GROUP BY 1, 2""")
def _(t):
    return x.page_links(t.wiki_docs, "id", "source_title", "source_wikitext").select("id", "title", "text")


RELATION_PAGES = "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'G' || CAST(page_id % 20 AS STRING) ELSE 'P' || CAST(page_id AS STRING) END AS title, 'G' || CAST(page_id % 20 AS STRING) AS root_title, html FROM wiki_pages"


@query("s4_snapshot_relations", """
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN CASE WHEN 'M' || CAST(page_id % 30 AS VARCHAR) < 'Self' THEN '100:' || 'G' || CAST(page_id % 20 AS VARCHAR) || '/Song ' || CAST(page_id % 7 AS VARCHAR) || ',90:M' || CAST(page_id % 30 AS VARCHAR) || ',90:Self' END
 ELSE '100:G' || CAST(page_id % 20 AS VARCHAR) || '/Song ' || CAST(page_id % 7 AS VARCHAR) END AS relations FROM pages""")
def _(t):
    pages = t.sql(RELATION_PAGES)
    d = x.with_relations(pages.select("page_id"), pages, "page_id", "html")
    return d.select("page_id", F.array_join(F.transform("relations", lambda r: F.concat(r["score"].cast("string"), F.lit(":"), r["title"])), ",").alias("relations"))


@query("x35_relation_candidates", """
SELECT page_id, 'G' || CAST(page_id % 20 AS VARCHAR) || '/Song ' || CAST(page_id % 7 AS VARCHAR) AS target, 'song' AS label, 100 AS score, 'root-subdocument' AS reason FROM pages UNION ALL
SELECT page_id, 'M' || CAST(page_id % 30 AS VARCHAR), 'M' || CAST(page_id % 30 AS VARCHAR), 90, 'root-member-row' FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id, 'Self', 'in', 90, 'root-member-row' FROM pages WHERE page_id % 2 = 0""")
def _(t):
    return x.relation_candidates(t.sql(RELATION_PAGES), "page_id", "html").drop("root_title")


@query("t4_relation_top", """
SELECT page_id, 'G' || CAST(page_id % 20 AS VARCHAR) || '/Song ' || CAST(page_id % 7 AS VARCHAR) AS target, 100 AS score FROM pages UNION ALL SELECT page_id, 'M' || CAST(page_id % 30 AS VARCHAR), 90 FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id, 'Self', 90 FROM pages WHERE page_id % 2 = 0""")
def _(t):
    c = x.suppress_relations(x.relation_candidates(t.sql(RELATION_PAGES), "page_id", "html"), "page_id")
    return top_rows(c, ["page_id"], [F.col("score").desc(), F.col("target")], 60).select("page_id", "target", "score")


CAL = r"""(regexp_matches(target, '^(?:18|19|20|21)\d{2}년$') OR regexp_matches(target, '^(?:1[0-2]|[1-9])월(?:\s*(?:3[01]|[12]\d|[1-9])일)?$') OR regexp_matches(target, '^(?:18|19|20|21)\d{2}[.-](?:1[0-2]|0?[1-9])[.-](?:3[01]|[12]\d|0?[1-9])$'))"""


@query("x36_link_classes", rf"""
WITH a AS (SELECT *, section_title || ' ' || context AS v FROM plain_links),
b AS (SELECT *, CASE WHEN {CAL} THEN 'calendar' WHEN target IN ('대한민국', 'K-POP') THEN 'generic_concept' WHEN regexp_matches(v, '출생지') THEN 'profile_attribute' WHEN section_title = '멤버' THEN 'member'
 WHEN regexp_matches(v, '(?i)(소속사|프로듀서|시상식|feat\.?)') THEN CASE WHEN regexp_matches(v, '소속사') THEN 'agency' WHEN regexp_matches(v, '프로듀서') THEN 'creative_credit' WHEN regexp_matches(v, '시상식') THEN 'industry_entity' ELSE 'collaboration' END
 ELSE 'external_reference' END AS relation FROM a)
SELECT id, CASE WHEN relation = 'member' THEN 'expand' ELSE 'skip' END AS crawl_mode, relation, CASE WHEN relation = 'member' THEN 20 ELSE 99 END AS tier,
 CASE WHEN relation <> 'member' THEN 0 WHEN source_area = 'toc' THEN 200 ELSE 140 END AS priority FROM b""")
def _(t):
    return x.classify_links(t.plain_links).select("id", "crawl_mode", "relation", "tier", "priority")


@query("x37_content_hash", "SELECT doc_id, sha256(text) AS hash, sha256(trim(lang)) AS include_hash FROM documents")
def _(t):
    return t.documents.select("doc_id", x.content_hash("text").alias("hash"), x.include_hash("lang").alias("include_hash"))


@query("x38_short_ids", "SELECT doc_id, 'doc:0:' || CAST(length(text) AS VARCHAR) || ':' || substr(sha256(text), 1, 8) AS node_id FROM documents")
def _(t):
    return t.documents.select("doc_id", x.short_id("doc", F.lit(0), F.length("text"), F.col("text")).alias("node_id"))


@query("x39_remote_candidates", r"""
WITH u AS (SELECT id, url, regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]+', ''), '#.*$', '') AS tail FROM url_rows)
SELECT id, url AS candidate FROM u WHERE NOT regexp_matches(url, '^https?://([a-z]+\.)?mirror\.example/(xref|images|w|RecentChanges|Search)(/|$)')
UNION ALL SELECT id, 'https://' || unnest(['www.', '', 'dark.', 'd.', 'm.']) || 'mirror.example' || tail FROM u WHERE url LIKE 'https://file.mirror.example/file/%'
UNION ALL SELECT id, 'https://i.wiki.example' || tail FROM u WHERE url LIKE 'https://w.cdnhost.example/%'""")
def _(t):
    return t.url_rows.select("id", F.explode(remote_candidates("url")).alias("candidate"))


# leaked control syntax of a kind that depends on the page, and what is left of it
LEAKED = """SELECT page_id, html || CASE page_id % 5 WHEN 0 THEN '<td>x {{{#!wiki b</td>' WHEN 1 THEN '<td> {{{#!if a == b<br></td>' WHEN 2 THEN '<td>&lt;tablewidth=100%&gt; y</td>' WHEN 3 THEN '<img class=z alt=q w="//file.mirror.example/file/abc">'
 ELSE '<dd> || &lt;rowcolor=red&gt;<b>[[a|</b><a class="x not-exist" title="파일:n.png">f</a>' END || CASE WHEN page_id % 3 = 0 THEN '<p style="background-color: keepall">' ELSE '<p>' END || '}}} tail</p> {{{+1 big' AS html FROM wiki_pages"""


@query("x40_repair_report", r"""
SELECT page_id, md5(regexp_replace(regexp_replace(html, '\[dday\(2024-01-01\)\]', 'DDAY'), '\[age\(2000-06-15\)\]', 'AGE') || CASE page_id % 5 WHEN 0 THEN '<td>x </td>' WHEN 1 THEN '' WHEN 2 THEN '<td>y</td>' WHEN 3 THEN '<img class=z alt=q w="//file.mirror.example/file/abc" data-original="//file.mirror.example/file/abc">'
  ELSE '<dd>&lt;rowcolor=red&gt;<b>[[a|</b><img class="unresolved-file" alt="파일:n.png" data-unresolved="1">' END || CASE WHEN page_id % 3 = 0 THEN '<p style="">' ELSE '<p>' END || 'tail</p> big') AS digest, 1 AS raw_blocks,
 CAST(page_id % 5 = 1 AS INT) AS directive_only_cells, CAST(page_id % 5 < 2 AS INT) AS leaked_directives, 1 AS orphan_closers, CAST(page_id % 5 IN (2, 4) AS INT) AS leaked_table_options, CAST(page_id % 5 = 4 AS INT) AS split_links,
 CAST(page_id % 5 = 4 AS INT) AS unresolved_file_anchors, CAST(page_id % 3 = 0 AS INT) AS semantic_styles, CAST(page_id % 5 = 4 AS INT) AS hybrid_tables, CAST(page_id % 5 = 3 AS INT) AS image_hints FROM wiki_pages""")
def _(t):
    d = x.repair_html(t.sql(LEAKED), "page_id", "html", as_of())
    # the dated macros have their own query; here they stand for whatever they give
    today = F.regexp_replace(F.regexp_replace("html", r"(tail &lt;b&gt; text )\S+ \S+(</p></article>)", "$1DDAY AGE$2"), r"^$", "")
    return d.withColumn("digest", F.md5(today.cast("binary"))).drop("html")


@query("x41_render_manifest", r"""
SELECT page_id, length(a) AS article_chars, 1 AS raw_blocks, len(regexp_extract_all(a, '(?i)<style\b')) AS style_blocks, len(regexp_extract_all(a, '(?i)<table\b')) AS tables, len(regexp_extract_all(a, '(?i)<iframe\b')) AS iframes,
 0 AS float_right_tables, 2 AS rendered_files, 1 AS raw_file_refs, 1 AS unresolved_files, false AS has_toc, false AS has_section_anchors, false AS has_raw_controls
FROM (SELECT page_id, regexp_extract(html, '(?i)<article\b[^>]*>([\s\S]*?)</article>', 1) AS a FROM wiki_pages)""")
def _(t):
    return x.render_manifest(t.wiki_pages, "page_id", "html")


@query("s4_page_snapshot", f"""
SELECT page_id, url, sha256(html) AS hash, length(t) AS n_text FROM (SELECT page_id, url, c AS html, {TEXT} AS t FROM (SELECT page_id, url, html AS c FROM pages))""")
def _(t):
    return x.snapshot(t.pages).select("page_id", "url", "hash", F.length("text").alias("n_text"))
