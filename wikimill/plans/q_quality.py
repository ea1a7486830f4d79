"""V*, M4, M5: quality gates."""

from pyspark.sql import functions as F

from ..functions.html import rendered_features
from ..functions.markup import active_source, source_features
from ..operators import graph as g
from ..operators import quality as v
from ..operators.ranking import STAGES
from .q_extract import ACTIVE, CLASSES, FEATURES, RENDERED
from .registry import query

JOBS = "SELECT id, run_id, source_document_id, CASE WHEN id % 40 = 0 THEN 'unknown' ELSE stage END AS stage, CASE WHEN id % 31 = 0 THEN 'stuck' ELSE status END AS status FROM pipeline_jobs"


@query("v1_enum_violations", f"""
SELECT id, unnest(list_filter([CASE WHEN stage NOT IN ({", ".join(f"'{s}'" for s in STAGES)}) THEN 'stage' END, CASE WHEN status NOT IN ({", ".join(f"'{s}'" for s in v.JOB_STATUS)}) THEN 'status' END], lambda x: x IS NOT NULL)) AS "column" FROM ({JOBS})""")
def _(t):
    return v.enum_violations(t.sql(JOBS), {"stage": STAGES, "status": v.JOB_STATUS}, "id")


@query("v1_duplicate_keys", "SELECT from_id, to_title, count(*) AS n FROM doc_links GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return v.duplicate_keys(t.doc_links, ["from_id", "to_title"])


def _list_rule(name: str, a: str, b: str) -> str:
    return f"CASE WHEN {a} <> {b} THEN '{name}_changed:' || CAST(len({a}) AS VARCHAR) || '->' || CAST(len({b}) AS VARCHAR) END"


def _sig(c: str) -> dict[str, str]:
    level = "CASE " + " ".join(f"WHEN regexp_matches(l, '^\\s*={{{n}}}\\s*.*\\s*={{{n}}}\\s*$') THEN {n}" for n in range(6, 0, -1)) + " ELSE 0 END"
    return {
        "links": rf"list_transform(regexp_extract_all({c}, '\[\[([^\]\n]+?)\]\]', 1), lambda x: trim(regexp_extract(x, '^([^|]*)', 1)))",
        "urls": rf"""regexp_extract_all({c}, 'https?://[^\s\]}}|<>"]+')""",
        "includes": rf"list_transform(regexp_extract_all({c}, '(?i)\[include\(\s*([^,)\n]+)', 1), lambda x: trim(x))",
        "youtube": rf"regexp_extract_all({c}, '(?i)\[(?:youtube|youtu\.be)\(\s*([A-Za-z0-9_-]{{6,}})', 1)",
        "headings": rf"list_filter(list_transform(string_split_regex({c}, '\r?\n'), lambda l: {level}), lambda n: n > 0)",
    }


_A, _B = _sig("source_text"), _sig("translated_text")
_RULES = [_list_rule(n, _A[n], _B[n]) for n in _A]
for _n, _p in (("tableDelimiters", r"\|\|"), ("tripleOpen", r"\{\{\{"), ("tripleClose", r"\}\}\}"), ("footnoteOpen", r"\[\*")):
    _x, _y = (f"len(regexp_extract_all({c}, '{_p}'))" for c in ("source_text", "translated_text"))
    _RULES.append(f"CASE WHEN {_x} <> {_y} THEN '{_n}_changed:' || CAST({_x} AS VARCHAR) || '->' || CAST({_y} AS VARCHAR) END")


@query("v2_structure_preservation", f"SELECT id, array_to_string(list_filter([{', '.join(_RULES)}], lambda x: x IS NOT NULL), ';') AS errors FROM translations")
def _(t):
    return t.translations.select("id", F.array_join(v.structure_errors("source_text", "translated_text"), ";").alias("errors"))


LEAK_KINDS = {"include": r"(?i)\[include\(", "file-link": r"(?i)\[\[(?:파일|File):", "directive": r"(?i)#!(?:wiki|if|folding)\b", "youtube-macro": r"(?i)\[youtube\("}
# places of all matches from the lengths of the pieces and matches before them, then the passage around each
PLACED = r"""SELECT id, '{kind}' AS kind, len(m) AS n, list_distinct(list_transform(range(1, len(m) + 1), lambda i: (list_sum(list_transform(p[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0) + 1)::BIGINT)) AS places, m, t
 FROM (SELECT id, t, string_split_regex(t, '{pattern}') AS p, regexp_extract_all(t, '{pattern}') AS m FROM v) WHERE len(m) > 0"""


@query("v4_syntax_leaks", rf"""
WITH v AS (SELECT id, replace(replace(replace(replace(replace(replace(regexp_replace(source_wikitext, '<[^>]+>', '', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)) AS t FROM wiki_docs WHERE source_wikitext IS NOT NULL),
f AS ({" UNION ALL ".join(PLACED.format(kind=kind, pattern=pattern) for kind, pattern in LEAK_KINDS.items())})
SELECT id, kind, n, array_to_string(list_sort(list_distinct(list_transform(range(1, len(m) + 1), lambda i: trim(regexp_replace(substr(t, greatest(1, places[i] - 45), places[i] - greatest(1, places[i] - 45) + length(m[i]) + 75), '\s+', ' ', 'g'))))), ' // ') AS samples FROM f""")
def _(t):
    d = v.syntax_leaks(t.wiki_docs.where("source_wikitext IS NOT NULL"), "id", "source_wikitext")
    return d.withColumn("samples", F.array_join(F.array_sort("samples"), " // "))


@query("v4_leak_gate", r"""
SELECT id, array_to_string(list_filter([CASE WHEN regexp_matches(source_wikitext, '\[\[[^\]]+\]\]') THEN 'raw-link' END, CASE WHEN regexp_matches(source_wikitext, '(?i)\[include\s*\(') THEN 'include' END,
 CASE WHEN regexp_matches(source_wikitext, '(?i)\{\{\{#!(?:wiki|folding|if)') THEN 'wiki-directive' END, CASE WHEN regexp_matches(source_wikitext, '(?m)(?:^|[>\n])\|\|[^<\n]{1,300}\|\|') THEN 'raw-table' END], lambda x: x IS NOT NULL), '+') AS leaks
FROM wiki_docs WHERE source_wikitext IS NOT NULL""")
def _(t):
    return t.wiki_docs.where("source_wikitext IS NOT NULL").select("id", v.leak_names("source_wikitext").alias("leaks"))


@query("v5_untranslated_links", "SELECT id, '/w/x' AS href, '한글링크' AS visible FROM render_docs WHERE content_html IS NOT NULL AND id % 28 = 6")
def _(t):
    d = t.render_docs.where("content_html IS NOT NULL")
    return d.select("id", F.explode(v.untranslated_links("content_html")).alias("x")).select("id", "x.href", "x.visible")


@query("v5_untranslated_text", "SELECT id, 1 AS passages FROM render_docs WHERE content_html IS NOT NULL AND id % 28 = 6")
def _(t):
    d = t.render_docs.where("content_html IS NOT NULL").select("id", F.size(v.untranslated_text("content_html")).alias("passages"))
    return d.where("passages > 0")


def jnum(meta: str, key: str) -> str:
    return f"coalesce(TRY_CAST(json_extract_string({meta}, '$.{key}') AS INT), 0)"


def jlen(meta: str, key: str) -> str:
    return f"coalesce(json_array_length(json_extract({meta}, '$.{key}')), 0)"


def jcount(meta: str, num: str, arr: str) -> str:
    return f"CASE WHEN {jnum(meta, num)} > 0 THEN {jnum(meta, num)} ELSE {jlen(meta, arr)} END"


def counted(prefix: str, n: str) -> str:
    return f"CASE WHEN ({n}) > 0 THEN '{prefix}:' || CAST(({n}) AS VARCHAR) END"


def jstr(meta: str, key: str) -> str:
    return f"coalesce(json_extract_string({meta}, '$.{key}'), '')"


HAS_RAW = "coalesce(trim(source_wikitext), '') <> ''"
SRC = f"""CASE WHEN NOT ({HAS_RAW}) THEN ['missing_canonical_raw'] ELSE list_filter([CASE WHEN source_rendered_at IS NULL THEN 'missing_source_render' END, CASE WHEN source_meta IS NULL THEN 'missing_source_render_meta' END,
 CASE WHEN json_extract_string(source_meta, '$.hasError') = 'true' THEN 'source_render_error' END,
 CASE WHEN source_meta IS NOT NULL AND {jstr("source_meta", "compatibility.version")} <> 'v8' THEN 'source_stale_compat:' || {jstr("source_meta", "compatibility.version")} END,
 CASE WHEN source_meta IS NOT NULL AND {jstr("source_meta", "compatibility.enginePatchset")} <> 'p2' THEN 'source_stale_patchset:' || {jstr("source_meta", "compatibility.enginePatchset")} END,
 {counted("source_missing_files", jcount("source_meta", "missingFileCount", "missingFiles"))}, {counted("source_missing_templates", jlen("source_meta", "missingTemplates"))}, {counted("source_missing_youtube", jlen("source_meta", "missingYouTubeEmbeds"))}], lambda x: x IS NOT NULL) END"""
TITLE = "CASE WHEN coalesce(trim(translated_title), '') = '' THEN 'missing_translated_title' WHEN regexp_matches(translated_title, '[가-힣]') THEN 'translated_title_contains_hangul' END"
TRA = f"""list_filter([CASE WHEN NOT (content_language = 'en' AND coalesce(trim(content_wikitext), '') <> '') THEN 'missing_english_revision' END,
 CASE WHEN coalesce(translation_status, 'null') NOT IN ('translated_by_chatgpt', 'reviewed') THEN 'translation_status:' || coalesce(translation_status, 'null') END, CASE WHEN content_revision_no <= 0 THEN 'missing_content_revision' END,
 CASE WHEN NOT is_template THEN {TITLE} END, CASE WHEN source_hash <> translation_source_hash THEN 'translation_stale_source_hash' END], lambda x: x IS NOT NULL)"""
REV = jnum("content_meta", "editableContent.revisionNo")
META = f"""CASE WHEN content_meta IS NULL THEN NULL WHEN {REV} = 0 THEN 'missing_render_revision' WHEN {REV} <> content_revision_no THEN 'stale_current_render:r' || CAST({REV} AS VARCHAR) || '->r' || CAST(content_revision_no AS VARCHAR) END,
 {counted("missing_files", jcount("content_meta", "missingFileCount", "missingFiles"))}"""
LEAK = "CASE WHEN contains(coalesce(content_html, ''), '[[leak]]') THEN '{0}:raw-link' END, CASE WHEN contains(coalesce(content_html, ''), '한글') THEN 'visible_korean_links:1' END, CASE WHEN contains(coalesce(content_html, ''), '한글') THEN 'visible_korean_text:1' END"
REN = f"""list_filter([CASE WHEN length(coalesce(content_html, '')) < 100 THEN 'missing_current_render' END, CASE WHEN content_rendered_at IS NULL THEN 'missing_current_render_timestamp' END,
 CASE WHEN content_meta IS NULL THEN 'missing_current_render_meta' END, {META}, {LEAK.format("syntax_leak")}], lambda x: x IS NOT NULL)"""
PUB = """list_filter([CASE WHEN published_revision_no = 0 THEN 'not_published' WHEN published_revision_no <> content_revision_no THEN 'stale_publish:r' || CAST(published_revision_no AS VARCHAR) || '->r' || CAST(content_revision_no AS VARCHAR) END,
 CASE WHEN published_language IS DISTINCT FROM 'en' THEN 'published_language_not_en' END, CASE WHEN coalesce(trim(published_html), '') = '' THEN 'missing_published_html' END], lambda x: x IS NOT NULL)"""


@query("v6_readiness", f"""
WITH b AS (SELECT id, is_template, fallback_ready, {HAS_RAW} AS has_raw, {SRC} AS s, {TRA} AS t, {REN} AS r, {PUB} AS p FROM render_docs),
c AS (SELECT *, CASE WHEN NOT has_raw AND is_template AND fallback_ready THEN 1 WHEN NOT has_raw THEN 2 WHEN len(s) > 0 THEN 3 WHEN len(t) > 0 THEN 4 WHEN len(r) > 0 THEN 5 WHEN NOT is_template AND len(p) > 0 THEN 6 ELSE 7 END AS k FROM b)
SELECT id, CASE k WHEN 1 THEN 'SOURCE_RENDER' WHEN 2 THEN 'RAW' WHEN 3 THEN 'SOURCE_RENDER' WHEN 4 THEN 'TRANSLATION' WHEN 5 THEN 'EN_RENDER' WHEN 6 THEN 'PUBLISH' ELSE CASE WHEN is_template THEN 'COMPLETE_DEPENDENCY' ELSE 'COMPLETE' END END AS stage,
 CASE k WHEN 1 THEN 'recover_template_from_captured_dom' WHEN 2 THEN 'capture_raw' WHEN 3 THEN 'repair_or_render_source' WHEN 4 THEN 'translate_or_repair_translation' WHEN 5 THEN 'render_or_repair_english' WHEN 6 THEN 'publish' ELSE 'none' END AS next_action,
 CASE k WHEN 1 THEN 'captured_dom_fallback_recovery' WHEN 2 THEN 'missing_canonical_raw' WHEN 3 THEN array_to_string(s, ',') WHEN 4 THEN array_to_string(t, ',') WHEN 5 THEN array_to_string(r, ',') WHEN 6 THEN array_to_string(p, ',') ELSE '' END AS blockers,
 CASE WHEN k = 7 THEN 'PASS' ELSE 'WAIT' END AS status FROM c""")
def _(t):
    d = v.readiness(t.render_docs, "v8", "p2")
    return d.select("id", "stage", "next_action", F.array_join("blockers", ",").alias("blockers"), "status")


SHOWN = "coalesce(trim(content_html), '') <> ''"
QA = f"""list_concat(list_filter({SRC}, lambda x: x <> 'source_render_error'), list_filter([CASE WHEN NOT (content_language = 'en' AND coalesce(trim(content_wikitext), '') <> '') THEN 'missing_english_revision' END,
 CASE WHEN translation_status = 'failed' THEN 'translation_failed' END, CASE WHEN NOT ({SHOWN}) THEN 'missing_current_render' END, CASE WHEN content_rendered_at IS NULL THEN 'missing_current_render_timestamp' END,
 {{links}}, CASE WHEN {SHOWN} AND content_meta IS NULL THEN 'missing_render_meta' END, {META}, {LEAK.format("current_syntax_leak")}, {{published}}, {TITLE}], lambda x: x IS NOT NULL))"""
LINKS_CTE = r"""
l AS (SELECT DISTINCT id, root_title, unnest(regexp_extract_all(content_html, 'href="/w/([^"#?]+)"', 1)) AS title FROM render_docs WHERE content_html IS NOT NULL),
lk AS (SELECT id, count_if(s.title IS NOT NULL AND p.title IS NULL) AS unpublished_core, count_if(s.title IS NULL) AS outside_core FROM l LEFT JOIN (SELECT DISTINCT root_title, source_title AS title FROM render_docs) s ON s.root_title = l.root_title AND s.title = l.title
 LEFT JOIN (SELECT DISTINCT source_title AS title FROM render_docs WHERE published_revision_no > 0) p ON p.title = l.title GROUP BY 1)"""
NOT_PUB = "CASE WHEN NOT (published_revision_no > 0 AND coalesce(trim(published_html), '') <> '') THEN '{0}' END"


def qa_results(t, prepublish):
    d = t.render_docs
    links = g.link_integrity(
        d.where("content_html IS NOT NULL"), "content_html", d.select("root_title", F.col("source_title").alias("title")),
        d.where("published_revision_no > 0").select(F.col("source_title").alias("title")),
    )
    return v.integration_qa(d, "v8", "p2", prepublish, links)


@query("v7_integration_qa", f"""
WITH {LINKS_CTE} SELECT d.id, array_to_string({QA.format(links=f"CASE WHEN {SHOWN} AND lk.unpublished_core > 0 THEN 'core_links_unpublished:' || CAST(lk.unpublished_core AS VARCHAR) END", published=NOT_PUB.format("not_published"))}, ',') AS blockers,
 array_to_string(list_filter([CASE WHEN {SHOWN} AND lk.outside_core > 0 THEN 'outside_core_links:' || CAST(lk.outside_core AS VARCHAR) END], lambda x: x IS NOT NULL), ',') AS warnings FROM render_docs d LEFT JOIN lk ON lk.id = d.id""")
def _(t):
    d = qa_results(t, False)
    return d.select("id", F.array_join("blockers", ",").alias("blockers"), F.array_join("warnings", ",").alias("warnings"))


@query("v7_prepublish_qa", f"""
WITH {LINKS_CTE} SELECT d.id, array_to_string({QA.format(links="NULL", published="NULL")}, ',') AS blockers,
 array_to_string(list_filter([CASE WHEN {SHOWN} AND lk.unpublished_core > 0 THEN 'core_links_pending_publish:' || CAST(lk.unpublished_core AS VARCHAR) END, CASE WHEN {SHOWN} AND lk.outside_core > 0 THEN 'outside_core_links:' || CAST(lk.outside_core AS VARCHAR) END,
 {NOT_PUB.format("pending_publish")}], lambda x: x IS NOT NULL), ',') AS warnings FROM render_docs d LEFT JOIN lk ON lk.id = d.id""")
def _(t):
    d = qa_results(t, True)
    return d.select("id", F.array_join("blockers", ",").alias("blockers"), F.array_join("warnings", ",").alias("warnings"))


@query("v7_publish_check", """
SELECT id, array_to_string(list_filter([CASE WHEN content_language <> 'en' THEN 'content_language_not_en' END, CASE WHEN coalesce(content_wikitext, '') = '' THEN 'missing_content_wikitext' END, CASE WHEN coalesce(content_html, '') = '' THEN 'missing_content_render' END,
 CASE WHEN published_revision_no <> content_revision_no THEN 'published_revision_mismatch:r' || CAST(published_revision_no AS VARCHAR) || '->r' || CAST(content_revision_no AS VARCHAR) END, CASE WHEN published_language IS DISTINCT FROM 'en' THEN 'published_language_not_en' END,
 CASE WHEN coalesce(published_html, '') = '' THEN 'missing_published_html' END], lambda x: x IS NOT NULL), ',') AS blockers FROM render_docs""")
def _(t):
    return t.render_docs.select("id", F.array_join(v.published_blockers(F.col("content_revision_no")), ",").alias("blockers"))


@query("v8_preflight_gate", f"""
WITH b AS (SELECT id, root_title, len(list_filter({TRA}, lambda x: x <> 'translation_stale_source_hash')) + len({REN}) AS n FROM render_docs)
SELECT root_title, count(*) AS docs, CAST(count_if(n > 0) AS BIGINT) AS failing, count_if(n > 0) = 0 AS publish FROM b GROUP BY 1""")
def _(t):
    return v.release_gate(v.preflight(t.render_docs))


GATE = "SELECT o_orderkey AS id, 'R' || CAST(o_custkey % 700 AS STRING) AS root_title, o_orderkey % 15 = 0 AS bad FROM orders"


@query("v8_release_gate", f"SELECT root_title, count(*) AS docs, CAST(count_if(bad) AS BIGINT) AS failing, count_if(bad) = 0 AS publish FROM ({GATE}) GROUP BY 1")
def _(t):
    d = t.sql(GATE).withColumn("blockers", F.when(F.col("bad"), F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")))
    return v.release_gate(d)


@query("v8_publishable", f"SELECT id, root_title FROM (SELECT *, bool_or(bad) OVER (PARTITION BY root_title) AS any_bad FROM ({GATE})) WHERE NOT any_bad")
def _(t):
    d = t.sql(GATE).withColumn("blockers", F.when(F.col("bad"), F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")))
    return v.publishable(d).select("id", "root_title")


@query("v9_blocker_routing", f"""
WITH b AS (SELECT id, {SRC} AS b FROM render_docs UNION ALL SELECT id + 10000000, {TRA} FROM render_docs UNION ALL SELECT id + 20000000, ['http_status:500'] FROM render_docs)
SELECT id, CASE WHEN len(list_filter(b, lambda x: regexp_matches(x, '^(missing_canonical_raw|missing_source_render|source_render_error|source_missing_(files|templates|youtube):)'))) > 0 THEN 'source_render'
 WHEN len(list_filter(b, lambda x: regexp_matches(x, '^(missing_english_revision|missing_translated_title|translated_title_contains_hangul)'))) > 0 THEN 'translation'
 WHEN len(list_filter(b, lambda x: starts_with(x, 'http_status:'))) > 0 THEN 'publish' ELSE '' END AS stage FROM b""")
def _(t):
    d = t.render_docs
    rows = d.select("id", v.source_blockers("v8", "p2").alias("b")).unionByName(d.select((F.col("id") + 10000000).alias("id"), v.translation_blockers().alias("b")))
    rows = rows.unionByName(d.select((F.col("id") + 20000000).alias("id"), F.array(F.lit("http_status:500")).alias("b")))
    return rows.select("id", v.route_blockers(F.col("b")).alias("stage"))


def loss_columns():
    s, r = source_features(F.col("raw")), rendered_features("html")
    return v.structural_loss(s, r)


_SOURCE = ", ".join(f"len(regexp_extract_all(raw, '{FEATURES[n]}')) AS {n}" for n in ("folding", "youtube", "colspan", "rowspan", "toc"))
_SHOWN = ", ".join([*(f"len(regexp_extract_all(html, '{p}')) AS {n}" for n, p in RENDERED.items()), *(f"""len(regexp_extract_all(html, '(?i)<{tag}\\bclass="[^"]*\\b{name}\\b')) AS {n}""" for n, (tag, name, _) in CLASSES.items())])


@query("m4_structural_loss", f"""
WITH r AS (SELECT id, {ACTIVE} AS raw FROM wiki_docs WHERE source_wikitext IS NOT NULL),
s AS (SELECT id, {_SOURCE}, len(regexp_extract_all(raw, '\\[\\*')) - len(regexp_extract_all(raw, '\\[\\*\\*')) AS footnote,
 len(list_filter(string_split(raw, chr(10)), lambda l: regexp_matches(l, '^={{1,6}}\\s*[^\\n=].*?\\s*={{1,6}}$'))) AS headings,
 len(list_filter(regexp_extract_all(raw, '\\[\\[([^\\]|]+)(?:\\|[^\\]]*)?\\]\\]', 1), lambda l: trim(l) <> '' AND NOT regexp_matches(trim(l), '(?i)^(?:파일|File|분류|Category):'))) AS links,
 len(regexp_extract_all(raw, '(?i)\\[\\[(?:파일|File):[^\\]|]+')) AS file_refs FROM r),
p AS (SELECT page_id AS id, {_SHOWN} FROM wiki_pages)
SELECT s.id, greatest(0, s.folding - p.details) AS folding, greatest(0, s.footnote - p.footnotes) AS footnotes, greatest(0, s.youtube - p.youtube) AS youtube, greatest(0, s.colspan - p.colspan) AS colspan,
 greatest(0, s.rowspan - p.rowspan) AS rowspan, greatest(0, s.headings - p.headings) AS headings, greatest(0, s.toc - p.toc) AS toc, greatest(0, s.links - p.links) AS links, greatest(0, s.file_refs - p.images - p.svg) AS images FROM s JOIN p ON p.id = s.id""")
def _(t):
    # counted first, so that only numbers are joined
    docs = t.wiki_docs.where("source_wikitext IS NOT NULL").select("id", active_source("source_wikitext").alias("raw"))
    source, shown = source_features(F.col("raw")), rendered_features("html")
    docs = docs.select("id", *[c.alias(f"s_{n}") for n, c in source.items()])
    pages = t.wiki_pages.select(F.col("page_id").alias("id"), *[c.alias(f"r_{n}") for n, c in shown.items()])
    loss = v.structural_loss({n: F.col(f"s_{n}") for n in source}, {n: F.col(f"r_{n}") for n in shown})
    return docs.join(pages, "id").select("id", *[c.alias(n) for n, c in loss.items()])


MATRIX = """SELECT id, id % 2 = 0 AS is_content, source_wikitext IS NOT NULL AS input_ready, length(coalesce(content_html, '')) AS html_chars, content_revision_no AS current_revision,
 CASE WHEN id % 24 = 1 THEN 9 ELSE content_revision_no END AS rendered_revision, CASE WHEN id % 15 = 1 THEN 'v7' ELSE 'v8' END AS engine, 'v8' AS expected_engine, CASE WHEN id % 10 = 2 THEN 1 ELSE 0 END AS newer_dependencies,
 id % 50 = 3 AS run_failed, id % 37 = 5 AS has_error, CASE WHEN id % 26 = 4 THEN 2 ELSE 0 END AS leaks, CASE WHEN id % 41 = 0 THEN 1 ELSE 0 END AS missing_youtube, CASE WHEN id % 33 = 6 THEN 4 ELSE 0 END AS loss,
 CASE WHEN id % 31 = 0 THEN 1 ELSE 0 END AS missing_templates, CASE WHEN id % 12 = 0 THEN 3 ELSE 0 END AS missing_files FROM render_docs"""


@query("v10_render_status", f"""
SELECT id, CASE WHEN NOT input_ready THEN CASE WHEN is_content THEN 'TRANSLATION_PENDING' ELSE 'NO_SOURCE' END WHEN html_chars = 0 THEN 'UNRENDERED' WHEN rendered_revision <> current_revision THEN 'STALE_REVISION' WHEN engine <> 'v8' THEN 'STALE_ENGINE'
 WHEN newer_dependencies > 0 THEN 'STALE_DEPENDENCY' WHEN run_failed OR has_error OR leaks > 0 OR missing_youtube > 0 OR loss > 0 THEN 'ENGINE_FAIL' WHEN missing_templates > 0 OR missing_files > 0 THEN 'DEPENDENCY' ELSE 'OK' END AS status FROM ({MATRIX})""")
def _(t):
    return v.render_status(t.sql(MATRIX)).select("id", "status")


PROMO = """SELECT page_id, html || CASE WHEN page_id % 4 = 0 THEN '<a href="#a">x</a><a href="#b">y</a>' WHEN page_id % 4 = 1 THEN '<i style="display:none">z</i>' ELSE '' END AS html, CASE WHEN page_id % 7 = 0 THEN 'abc' ELSE html END AS markup,
 CASE WHEN page_id % 5 = 0 THEN 0.85 ELSE 0.95 END AS score, 1 AS d_tables, 1 AS g_tables, 3 AS d_rows, CASE WHEN page_id % 6 = 0 THEN 2 ELSE 3 END AS g_rows, 5 AS d_cells, 5 AS g_cells, 2 AS d_links, 2 AS g_links, 1 AS d_images, 1 AS g_images FROM wiki_pages"""


@query("m5_promotion", f"""
SELECT page_id, len(r) = 0 AS eligible, array_to_string(r, ';') AS reasons FROM (SELECT page_id, list_filter([CASE WHEN score < 0.9 THEN 'low_score' END,
 CASE WHEN len(regexp_extract_all(html, '(?i)href=["'']#')) >= 2 OR contains(html, 'display:none') THEN 'interactive_layout' END, CASE WHEN d_rows <> g_rows THEN 'structural_loss' END, CASE WHEN length(html) >= 200 AND length(trim(markup)) < 8 THEN 'trivial' END], lambda x: x IS NOT NULL) AS r FROM ({PROMO}))""")
def _(t):
    return v.promotion(t.sql(PROMO), "page_id")


STALE = "SELECT id, source_wikitext, is_template, translation_status, source_meta, source_rendered_at, TIMESTAMP '2024-03-01 00:00:00' + INTERVAL '1' HOUR * CAST(id % 250 AS INT) AS raw_extracted_at, content_meta, content_language, content_wikitext, content_revision_no, content_rendered_at FROM render_docs"


@query("v11_stale_renders", f"""
SELECT id, by_time, by_version FROM (SELECT id, source_rendered_at IS NULL OR source_rendered_at < raw_extracted_at AS by_time, {jstr("source_meta", "compatibility.version")} <> 'v8' AS by_version FROM ({STALE})
 WHERE source_wikitext IS NOT NULL AND NOT is_template AND translation_status IN ('pending_chatgpt', 'failed', 'translated_by_chatgpt', 'reviewed')) WHERE by_time OR by_version""")
def _(t):
    return v.stale_renders(t.sql(STALE), "v8")


@query("v11_stale_drafts", f"""
SELECT id FROM ({STALE}) WHERE translation_status IN ('translated_by_chatgpt', 'reviewed') AND content_language = 'en' AND content_wikitext IS NOT NULL AND content_revision_no > 0
 AND ({REV} <> content_revision_no OR (source_rendered_at IS NOT NULL AND (content_rendered_at IS NULL OR content_rendered_at < source_rendered_at)))""")
def _(t):
    return v.stale_drafts(t.sql(STALE))


REQ = """SELECT doc_id AS id, CASE doc_id % 6 WHEN 0 THEN 'root' WHEN 1 THEN 'toc_document' WHEN 2 THEN 'member' WHEN 3 THEN 'template_dependency' WHEN 4 THEN 'related' END AS relation, CAST(doc_id % 20 AS INT) AS scope_depth, doc_id % 4 = 0 AS canonical, doc_id % 5 = 0 AS dom_captured FROM documents"""
PRIOR = "SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'ignored' ELSE 'captured' END AS status, doc_id % 2 = 0 AS manual FROM labels"


@query("v12_requirement_status", f"""
WITH p AS (SELECT DISTINCT id FROM ({PRIOR}) WHERE status = 'ignored' AND manual), d AS (SELECT r.*, p.id IS NOT NULL AND NOT (canonical AND relation IS NOT NULL) AS man FROM ({REQ}) r LEFT JOIN p USING (id))
SELECT id, CASE WHEN man OR relation IS NULL THEN 'ignored' WHEN canonical THEN 'captured' ELSE 'needs_raw' END AS status,
 CASE WHEN relation IS NULL OR canonical THEN 0 WHEN relation = 'root' THEN 100 WHEN relation = 'toc_document' THEN greatest(80, 95 - scope_depth) WHEN relation = 'member' THEN greatest(78, 90 - scope_depth) WHEN relation = 'template_dependency' THEN greatest(65, 76 - scope_depth) ELSE 80 END AS priority,
 CASE WHEN relation IS NULL OR canonical THEN 0 ELSE 100 END AS score, CASE WHEN man THEN 'manual_ignore' WHEN relation IS NULL THEN 'outside_team_core_scope' WHEN canonical THEN 'canonical_raw_present' WHEN dom_captured THEN 'canonical_raw_missing' ELSE 'canonical_raw_missing,browser_dom_missing' END AS reasons FROM d""")
def _(t):
    return v.requirement_status(t.sql(REQ), t.sql(PRIOR))


@query("v13_proposal_conflicts", """
SELECT p.id, p.source_document_id, CASE WHEN d.id IS NULL THEN 'missing_document' WHEN d.content_revision_no = p.base_revision_no THEN 'ok' ELSE 'conflict' END AS state FROM edit_proposals p LEFT JOIN wiki_docs d ON d.id = p.source_document_id""")
def _(t):
    from ..operators.joins import proposal_conflicts

    return proposal_conflicts(t.edit_proposals, t.wiki_docs)


@query("v14_overlapping_patches", """
SELECT doc_id, start_pos, end_pos, count(*) AS n FROM (SELECT *, max(end_pos) OVER (PARTITION BY doc_id ORDER BY start_pos, end_pos, patch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM patches) WHERE start_pos < m GROUP BY 1, 2, 3""")
def _(t):
    return v.overlapping_patches(t.patches).groupBy("doc_id", "start_pos", "end_pos").agg(F.count("*").alias("n"))


PATCHES15 = """SELECT doc_id, CAST(floor(length(text) / 4) AS INT) AS start_pos, CAST(floor(length(text) / 4) AS INT) + 5 AS end_pos, substr(text, CAST(floor(length(text) / 4) AS INT) + 1, 5) AS before, '<A>' AS after FROM documents UNION ALL
SELECT doc_id, CAST(floor(length(text) / 2) AS INT) + 5 AS start_pos, CAST(floor(length(text) / 2) AS INT) + 8 AS end_pos, CASE WHEN doc_id % 10 = 0 THEN '?!?' ELSE substr(text, CAST(floor(length(text) / 2) AS INT) + 6, 3) END AS before, '' AS after FROM documents"""


@query("v15_patch_application", f"""
WITH p AS (SELECT doc_id, min(start_pos) AS s1, max(start_pos) AS s2 FROM ({PATCHES15}) GROUP BY 1)
SELECT doc_id, CASE WHEN s1 + 5 > s2 THEN 'overlap' WHEN doc_id % 10 = 0 THEN 'conflict' ELSE 'applied' END AS state,
 md5(CASE WHEN s1 + 5 > s2 OR doc_id % 10 = 0 THEN text ELSE substr(text, 1, s1) || '<A>' || substr(text, s1 + 6, s2 - s1 - 5) || substr(text, s2 + 4) END) AS digest FROM documents JOIN p USING (doc_id)""")
def _(t):
    return v.apply_patches(t.documents, t.sql(PATCHES15)).select("doc_id", "state", F.md5(F.col("text").cast("binary")).alias("digest"))


VERSIONS = "SELECT id, CASE WHEN id % 3 = 0 THEN 'p5' WHEN id % 3 = 1 THEN 'p4' END AS parse_version, CASE WHEN id % 4 > 0 THEN updated_at END AS parsed_at FROM wiki_docs"


@query("v16_version_skip", f"SELECT id FROM ({VERSIONS}) WHERE NOT coalesce(parse_version = 'p5' AND parsed_at IS NOT NULL, false)")
def _(t):
    return v.to_process(t.sql(VERSIONS), "p5").select("id")


@query("v17_reusable_translations", """
SELECT id, id % 3 <> 2 AS keep, CASE id % 3 WHEN 2 THEN 1 ELSE 0 END AS untranslated FROM plain_links""")
def _(t):
    d = t.plain_links.select(
        "id", F.array(F.lit("plain text"), F.when(F.col("id") % 3 == 2, "새 글").otherwise("옛 글"), F.col("current_title")).alias("nodes"),
        F.create_map(F.lit("옛 글"), F.lit("old text")).alias("translated"),
    )
    return v.reusable_translations(d)


DEPS = "SELECT 'R' || CAST(l_suppkey % 150 AS STRING) AS root_title, l_quantity > 2 AS ready, l_quantity = 1 AND l_linenumber = 3 AND l_tax > 0.06 AS terminal FROM lineitem"
RENDER_JOBS = "SELECT o_orderkey AS id, 'R' || CAST(o_custkey % 200 AS STRING) AS root_title FROM orders"


@query("v18_dependency_gate", f"""
WITH d AS (SELECT root_title, bool_and(ready) AS rd, bool_or(terminal) AS tm FROM ({DEPS}) GROUP BY 1)
SELECT j.id, j.root_title, CASE WHEN coalesce(rd, true) THEN 'ready' WHEN tm THEN 'blocked' ELSE 'waiting' END AS state FROM ({RENDER_JOBS}) j LEFT JOIN d USING (root_title)""")
def _(t):
    return v.dependency_gate(t.sql(RENDER_JOBS), t.sql(DEPS))
