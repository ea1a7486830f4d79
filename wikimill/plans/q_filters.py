"""F*: predicates and projections."""

from pyspark.sql import functions as F

from ..functions.markup import active_source
from ..functions.urls import is_asset_candidate, is_non_payload
from ..operators import filters as f
from .registry import query

DOC = "id, source_title"


@query("f1_published_documents", """
SELECT id, source_title, published_revision_no FROM wiki_docs
WHERE source = 'mirror' AND coalesce(published_revision_no, 0) > 0 AND published_html IS NOT NULL AND length(published_html) > 0""")
def _(t):
    return f.published_documents(t.wiki_docs, "mirror").select("id", "source_title", "published_revision_no")


@query("f1_published_or_english_source", """
SELECT id, source_title FROM wiki_docs
WHERE source = 'mirror' AND coalesce(published_revision_no, 0) > 0
  AND (length(published_html) > 0 OR (content_language = 'en' AND length(source_wikitext) > 0))""")
def _(t):
    d = t.wiki_docs.withColumns({"published_language": F.col("content_language"), "published_wikitext": F.col("source_wikitext")})
    return f.published_documents(d, "mirror", english_source=True).select("id", "source_title")


@query("f2_namespace_filter", """
SELECT id, target FROM plain_links
WHERE NOT regexp_matches(target, '^(파일|File|틀|Template|분류|Category|사용자|User|나무위키|NamuWiki|특수기능|Special|토론|Discussion|휴지통):')""")
def _(t):
    return f.article_titles(t.plain_links, "target").select("id", "target")


@query("f3_calendar_titles", r"""
SELECT id, target FROM plain_links
WHERE trim(target) = '' OR regexp_matches(target, '^(?:18|19|20|21)\d{2}년$') OR regexp_matches(target, '^(?:18|19|20|21)\d{2}$')
   OR regexp_matches(target, '^(?:18|19|20|21)\d{2}년\s*(?:1[0-2]|[1-9])월(?:\s*(?:3[01]|[12]\d|[1-9])일)?$')
   OR regexp_matches(target, '^(?:1[0-2]|[1-9])월(?:\s*(?:3[01]|[12]\d|[1-9])일)?$') OR regexp_matches(target, '^(?:3[01]|[12]\d|[1-9])일$')
   OR regexp_matches(target, '^(?:18|19|20|21)\d{2}[.-](?:1[0-2]|0?[1-9])[.-](?:3[01]|[12]\d|0?[1-9])$')""")
def _(t):
    return t.plain_links.where(f.is_calendar_title("target")).select("id", "target")


@query("f4_stop_titles", f"""
SELECT id, target FROM plain_links WHERE target NOT IN ({", ".join("'" + x + "'" for x in f.STOP_TITLES)})""")
def _(t):
    return f.without_stop_titles(t.plain_links, "target").select("id", "target")


URL_PARTS = r"""
WITH u AS (SELECT id, url, regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1) AS h, regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) AS p FROM url_rows),
v AS (SELECT *, (h = 'mirror.example' OR h LIKE '%.mirror.example') AND regexp_matches(p, '(?i)^/(?:images|xref|w|RecentChanges|Search)(?:/|$)') AS non_payload FROM u)
"""


@query("f5_non_payload_urls", URL_PARTS + "SELECT id, url, non_payload FROM v")
def _(t):
    return t.url_rows.select("id", "url", is_non_payload("url").alias("non_payload"))


@query("f6_asset_candidates", URL_PARTS + r"""
SELECT id, url FROM v WHERE NOT non_payload AND regexp_matches(h, '(^|\.)(wiki\.example|cdnhost\.example|mirror\.example)$')
 AND NOT regexp_matches(p, '^/w/') AND (regexp_matches(p, '(?i)/(?:i|file)/') OR regexp_matches(url, '(?i)\.(?:jpe?g|png|webp|gif|avif|svg)(?:$|[?#])'))""")
def _(t):
    return t.url_rows.where(is_asset_candidate("url")).select("id", "url")


@query("f7_canonical_source", r"""
SELECT id, coalesce(source_wikitext, '') <> '' AND updated_at IS NOT NULL AND CASE WHEN id % 3 = 0 THEN 'raw' ELSE 'html' END = 'raw'
       AND regexp_matches('normal-' || CASE WHEN id % 2 = 0 THEN 'raw-view' ELSE 'other' END || '-v1', '^normal-(?:raw-view|edit-source)-v1$') AS canonical
FROM wiki_docs""")
def _(t):
    d = t.wiki_docs.select(
        "id", "source_wikitext", F.col("updated_at").alias("raw_extracted_at"),
        F.when(F.col("id") % 3 == 0, "raw").otherwise("html").alias("source_format"),
        F.concat(F.lit("normal-"), F.when(F.col("id") % 2 == 0, "raw-view").otherwise("other"), F.lit("-v1")).alias("source_extraction_version"),
    )
    return d.select("id", f.is_canonical_source(r"^normal-(?:raw-view|edit-source)-v1$", "raw").alias("canonical"))


@query("f8_markup_likelihood", r"""
SELECT id, length(source_wikitext) >= 500 AND
  (CAST(regexp_matches(source_wikitext, '\[\[[^\]]+\]\]') AS INT) + CAST(regexp_matches(source_wikitext, '(?m)^={2,6}[^=].*={2,6}$') AS INT)
   + CAST(regexp_matches(source_wikitext, '(?m)^\|\|') AS INT) + CAST(regexp_matches(source_wikitext, '\{\{\{#!') AS INT)
   + CAST(regexp_matches(source_wikitext, '(?i)\[\[(?:파일|File):') AS INT)) >= 2 AS markup FROM wiki_docs WHERE source_wikitext IS NOT NULL""")
def _(t):
    return t.wiki_docs.where("source_wikitext IS NOT NULL").select("id", f.looks_like_markup("source_wikitext").alias("markup"))


@query("f9_block_pages", """
SELECT page_id, regexp_matches(html, '(?i)captcha|cloudflare|cf-chl|challenge-platform|access denied|비정상적인 접근|자동화된 접근') AS blocked FROM pages""")
def _(t):
    return t.pages.select("page_id", f.is_block_page("html").alias("blocked"))


@query("f10_signal_score", r"""
WITH p AS (SELECT id, '||본명 x||' || chr(10) || context || chr(10) || section_title || ' 소속사' || chr(10) || 'MBTI ' || target AS txt FROM plain_links)
SELECT id, CAST(regexp_matches(txt, '(^|\n)\|?\|?[^\n]{0,30}본명') AS INT) + CAST(regexp_matches(txt, '(^|\n)\|?\|?[^\n]{0,30}출생') AS INT)
 + CAST(regexp_matches(txt, '(^|\n)\|?\|?[^\n]{0,30}신체') AS INT) + CAST(regexp_matches(txt, '(^|\n)\|?\|?[^\n]{0,30}MBTI') AS INT)
 + CAST(regexp_matches(txt, '(^|\n)\|?\|?[^\n]{0,30}포지션') AS INT) + CAST(regexp_matches(txt, '(^|\n)\|?\|?[^\n]{0,30}소속사') AS INT) AS score FROM p""")
def _(t):
    d = t.sql("""SELECT id, '||본명 x||' || chr(10) || context || chr(10) || section_title || ' 소속사' || chr(10) || 'MBTI ' || target AS txt FROM plain_links""")
    return d.select("id", f.profile_score("txt").alias("score"))


AD_TEXT = r"""trim(regexp_replace(regexp_replace(block, '<[^>]+>', '', 'g'), '\s+', ' ', 'g'))"""


@query("f11_injected_ads", rf"""
WITH h AS (SELECT page_id, replace(html, '</nav>', '</nav><section aria-label="x"><p>Sponsored offer' || CAST(page_id AS VARCHAR) || '.com</p><a>1</a><a>2</a></section>') AS html FROM pages),
b AS (SELECT page_id, unnest(regexp_extract_all(html, '<section\b[^>]*>[\s\S]*?</section>')) AS block FROM h)
SELECT page_id, regexp_matches({AD_TEXT}, '(?i)sponsored') AND len(regexp_extract_all(block, '(?i)<a\b')) >= 2 AS is_ad FROM b""")
def _(t):
    h = t.sql("""SELECT page_id, '<article>' || replace(html, '</nav>', '</nav><section aria-label="x"><p>Sponsored offer' || CAST(page_id AS STRING) || '.com</p><a>1</a><a>2</a></section>') AS html FROM pages""")
    h = h.withColumn("html", F.regexp_replace(F.regexp_replace("html", "(?i)</?article[^>]*>", ""), "^", "<article>"))
    return f.html_blocks(h, "page_id", "html", tag="section").select("page_id", f.is_injected_ad("block").alias("is_ad"))


@query("f12_strip_notices", r"""
WITH s AS (SELECT id, '[include(틀:접근 제한, x=' || CAST(id AS VARCHAR) || ')]' || chr(10) || source_wikitext AS txt FROM wiki_docs WHERE source_wikitext IS NOT NULL)
SELECT id, md5(regexp_replace(txt, '(?im)^\s*\[include\(\s*틀\s*:\s*접근\s*제한(?:\s*,[^\]\r\n]*)?\)\]\s*$', '', 'g')) AS digest FROM s""")
def _(t):
    s = t.sql("SELECT id, '[include(틀:접근 제한, x=' || CAST(id AS STRING) || ')]' || chr(10) || source_wikitext AS txt FROM wiki_docs WHERE source_wikitext IS NOT NULL")
    return s.select("id", F.md5(f.strip_notices("txt").cast("binary")).alias("digest"))


@query("f13_active_source", r"""
SELECT id, md5(array_to_string(list_filter(string_split_regex(source_wikitext, '\r?\n'), lambda x: NOT regexp_matches(x, '^\s*##')), chr(10))) AS digest
FROM wiki_docs WHERE source_wikitext IS NOT NULL""")
def _(t):
    return t.wiki_docs.where("source_wikitext IS NOT NULL").select("id", F.md5(active_source("source_wikitext").cast("binary")).alias("digest"))


@query("f14_content_templates", r"""
WITH x AS (SELECT id, target, CASE id % 5 WHEN 0 THEN '틀 : 접근 제한' WHEN 1 THEN '틀:설명문서' WHEN 2 THEN '틀:' || context || '/설명문서' WHEN 3 THEN '틀: ' || context ELSE target END AS title FROM plain_links)
SELECT id, title FROM x WHERE regexp_matches(title, '^틀') AND NOT regexp_matches(title, '/설명문서($|/)')
  AND NOT regexp_matches(trim(regexp_replace(title, '^틀\s*:\s*', '')), '^(접근\s*제한|설명문서|문서 가져옴|토론 관련 틀|토론 합의|분류 설명|분류 참고|한시적 넘겨주기)$')""")
def _(t):
    x = t.sql("""SELECT id, CASE id % 5 WHEN 0 THEN '틀 : 접근 제한' WHEN 1 THEN '틀:설명문서' WHEN 2 THEN '틀:' || context || '/설명문서' WHEN 3 THEN '틀: ' || context ELSE target END AS title FROM plain_links""")
    return x.where(f.is_content_template("title")).select("id", "title")
