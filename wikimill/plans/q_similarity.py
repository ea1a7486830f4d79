"""Similarity and fidelity."""

from pyspark.sql import functions as F

from ..operators import similarity as s
from .registry import query

COMPACT = r"lower(regexp_replace(regexp_replace({0}, '(?i)<\s*(?:img|video)\b[^>]*>', ' ', 'g'), '[\s\x{{200b}}-\x{{200d}}\x{{2060}}\x{{feff}}]+', '', 'g'))"
GRAMS = "list_distinct(list_transform(list_zip(string_split({0}, '')[1:-3], string_split({0}, '')[2:-2], string_split({0}, '')[3:]), lambda z: z[1] || z[2] || z[3]))"


@query("m1_text_similarity", f"""
WITH c AS (SELECT id, {COMPACT.format("source_text")} AS a, {COMPACT.format("translated_text")} AS b FROM translations), g AS (SELECT id, {GRAMS.format("a")} AS x, {GRAMS.format("b")} AS y FROM c)
SELECT id, round(len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))), 6) AS similarity FROM g""")
def _(t):
    return s.with_text_similarity(t.translations, "source_text", "translated_text", "similarity").select("id", F.round("similarity", 6).alias("similarity"))


@query("m2_ratio_similarity", """
SELECT page_id, round(CASE WHEN a = 0 AND b = 0 THEN 1.0 WHEN a = 0 OR b = 0 THEN 0.0 ELSE least(a, b) / greatest(a, b) END, 6) AS items FROM (SELECT page_id, len(regexp_extract_all(original_html, '<li>')) AS a, len(regexp_extract_all(rendered_html, '<li>')) AS b FROM html_pairs)""")
def _(t):
    n = lambda c: F.regexp_count(c, F.lit("<li>"))
    return t.html_pairs.select("page_id", F.round(s.ratio_similarity(n("original_html"), n("rendered_html")), 6).alias("items"))


def r(a: str) -> str:
    return f"CASE WHEN {a}a = 0 AND {a}b = 0 THEN 1.0 WHEN {a}a = 0 OR {a}b = 0 THEN 0.0 ELSE least({a}a, {a}b) / greatest({a}a, {a}b) END"


@query("m3_fidelity_parts", r"""
WITH c AS (SELECT page_id, len(regexp_extract_all(original_html, '(?i)<tr\b')) AS ra, len(regexp_extract_all(rendered_html, '(?i)<tr\b')) AS rb, len(regexp_extract_all(original_html, '(?i)<t[dh]\b')) AS ca, len(regexp_extract_all(rendered_html, '(?i)<t[dh]\b')) AS cb,
 len(regexp_extract_all(original_html, '(?i)<table\b')) AS ta, len(regexp_extract_all(rendered_html, '(?i)<table\b')) AS tb FROM html_pairs)
SELECT page_id, 1.0::DOUBLE AS links, 1.0::DOUBLE AS images, 1.0::DOUBLE AS youtube, round(""" + r("t") + ", 6) AS tables, round(" + r("r") + ", 6) AS rows, round(" + r("c") + ", 6) AS cells, 1.0::DOUBLE AS foldings FROM c")
def _(t):
    d = s.fidelity(t.html_pairs, "page_id", "original_html", "rendered_html")
    return d.select("page_id", "links", "images", "youtube", *[F.round(n, 6).alias(n) for n in ("tables", "rows", "cells")], "foldings")


VISIBLE = r"""regexp_replace(regexp_replace(regexp_replace({0}, '(?i)<script\b[\s\S]*?</script\s*>', '', 'g'), '(?i)<style\b[\s\S]*?</style\s*>', '', 'g'), '<[^>]+>', '', 'g')"""
for _e, _v in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#x27;", "''")):
    VISIBLE = f"replace({VISIBLE}, '{_e}', '{_v}')"


@query("m3_fidelity_score", rf"""
WITH v AS (SELECT page_id, original_html, rendered_html, {COMPACT.format(VISIBLE.format("original_html"))} AS a, {COMPACT.format(VISIBLE.format("rendered_html"))} AS b FROM html_pairs),
g AS (SELECT page_id, original_html, rendered_html, a = b AS same, {GRAMS.format("a")} AS x, {GRAMS.format("b")} AS y FROM v),
c AS (SELECT page_id, CASE WHEN same THEN 1.0 ELSE len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) END AS t, len(regexp_extract_all(original_html, '(?i)<tr\b')) AS ra, len(regexp_extract_all(rendered_html, '(?i)<tr\b')) AS rb,
 len(regexp_extract_all(original_html, '(?i)<t[dh]\b')) AS ca, len(regexp_extract_all(rendered_html, '(?i)<t[dh]\b')) AS cb, len(regexp_extract_all(original_html, '(?i)<table\b')) AS ta, len(regexp_extract_all(rendered_html, '(?i)<table\b')) AS tb FROM g)
SELECT page_id, round(0.35 * t + 0.15 + 0.05 + 0.05 + 0.10 * ({r("t")}) + 0.10 * ({r("r")}) + 0.10 * ({r("c")}) + 0.10, 4) AS score FROM c""")
def _(t):
    return s.fidelity(t.html_pairs, "page_id", "original_html", "rendered_html").select("page_id", "score")


TOK = r"list_distinct(list_filter(string_split_regex(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), '[\s·|/(),:;\[\]{}<>]+'), lambda x: length(x) >= 2))"


@query("m6_table_similarity", rf"""
WITH k AS (SELECT *, {TOK} AS tk FROM table_summaries),
p AS (SELECT o.doc_id, o.idx AS o_idx, b.idx AS b_idx, len(list_intersect(o.tk, b.tk)) AS c, len(o.tk) AS na, len(b.tk) AS nb, o.n_rows AS ra, b.n_rows AS rb, o.n_cols AS ca, b.n_cols AS cb
 FROM k o JOIN k b ON o.doc_id = b.doc_id AND o.side = 'original' AND b.side = 'baseline'),
s AS (SELECT *, c / (na + nb - c) AS ts FROM p WHERE c > 0)
SELECT doc_id, o_idx, b_idx, round(ts, 6) AS token_score, round(ts * 0.78 + (1 - least(1.0, abs(ra - rb) / greatest(ra, rb))) * 0.14 + (1 - least(1.0, abs(ca - cb) / greatest(ca, cb))) * 0.08, 6) AS score FROM s WHERE ts >= (0.32 - 0.14 - 0.08) / 0.78""")
def _(t):
    x = t.table_summaries
    d = s.table_candidates(x.where("side = 'original'"), x.where("side = 'baseline'"))
    return d.select("doc_id", "o_idx", "b_idx", F.round("token_score", 6).alias("token_score"), F.round("score", 6).alias("score"))


CLOSE = "CASE WHEN o.{c} > 0 AND b.{c} > 0 THEN {f}(o.{c}, b.{c}) ELSE {other} END"
LEAST, MOST = ({c: CLOSE.format(c=c, f=f, other=other) for c in ("n_rows", "n_cols")} for f, other in (("least", 0), ("greatest", 1)))


@query("j21_table_pairing", rf"""
WITH RECURSIVE s AS (SELECT doc_id, side, idx, n_rows, n_cols, list_distinct(list_filter(string_split_regex(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), '[\s·|/(),:;\[\]{{}}<>]+'), lambda x: length(x) >= 2)) AS t FROM table_summaries),
f AS (SELECT o.doc_id, o.idx AS o_idx, b.idx AS b_idx, CAST(len(list_intersect(o.t, b.t)) AS HUGEINT) AS k, len(o.t) + len(b.t) - len(list_intersect(o.t, b.t)) AS u,
  {LEAST["n_rows"]} AS r, {MOST["n_rows"]} AS r1, {LEAST["n_cols"]} AS c, {MOST["n_cols"]} AS c1
  FROM s o JOIN s b ON o.doc_id = b.doc_id AND o.side = 'original' AND b.side = 'baseline' WHERE len(o.t) > 0 AND len(b.t) > 0),
p AS (SELECT doc_id, o_idx, b_idx, 78 * k * r1 * c1 + 14 * CAST(r AS HUGEINT) * u * c1 + 8 * CAST(c AS HUGEINT) * u * r1 AS above, 100 * CAST(u AS HUGEINT) * r1 * c1 AS below, 5 * k >= u AS enough FROM f),
q AS (SELECT doc_id, o_idx, list(struct_pack(b := b_idx, s := (above * 1000000000000000000) // below, m := CAST((above * 2000 + below) // (2 * below) AS BIGINT), k := enough) ORDER BY (above * 1000000000000000000) // below DESC, b_idx) AS cands FROM p GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o_idx) AS n FROM q),
w(doc_id, n, o_idx, used, best, ok) AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT), CAST(0 AS INT), CAST([] AS INT[]), CAST(NULL AS STRUCT(b INT, s HUGEINT, m BIGINT, k BOOLEAN)), false FROM n UNION ALL
  SELECT doc_id, n, o_idx, CASE WHEN best.s >= 320000000000000000 AND best.k THEN list_append(used, best.b) ELSE used END, best, coalesce(best.s >= 320000000000000000 AND best.k, false)
  FROM (SELECT n.doc_id, n.n, n.o_idx, w.used, list_filter(n.cands, lambda c: NOT list_contains(w.used, c.b))[1] AS best FROM w JOIN n ON n.doc_id = w.doc_id AND n.n = w.n + 1))
SELECT doc_id, o_idx, best.b AS b_idx, best.m / 1000.0 AS score FROM w WHERE ok""")
def _(t):
    x = t.table_summaries
    return s.pair_tables(x.where("side = 'original'"), x.where("side = 'baseline'"))
