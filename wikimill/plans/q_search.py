"""Search and display texts."""

from pyspark.sql import functions as F

from ..functions.markup import plain_text
from ..operators import search as s
from ..operators import search_index
from ..operators.ranking import numbered
from .registry import query

PUBLISHED = "source = 'mirror' AND coalesce(published_revision_no, 0) > 0 AND length(published_html) > 0"


def search_sql(q: str, rank: str = "rank") -> str:
    return f"""
SELECT id, source_title, translated_title, root_title, source_wikitext, content_language, CASE WHEN t = '{q}' THEN 0 WHEN starts_with(t, '{q}') THEN 1 WHEN contains(t, '{q}') THEN 2 WHEN starts_with(r, '{q}') THEN 3
  WHEN contains(r, '{q}') THEN 4 WHEN contains(s, '{q}') THEN 5 ELSE 6 END AS {rank}
FROM (SELECT *, lower(coalesce(translated_title, '')) AS t, lower(coalesce(root_title, '')) AS r, lower(source_title) AS s, lower(coalesce(source_wikitext, '')) AS b FROM wiki_docs)
WHERE {PUBLISHED} AND source_title NOT LIKE '틀:%' AND source_title NOT LIKE '파일:%'
  AND (contains(t, '{q}') OR contains(s, '{q}') OR contains(r, '{q}') OR contains(b, '{q}'))
ORDER BY {rank}, length(coalesce(translated_title, source_title)), source_title LIMIT 80"""


@query("t1_search_top", f"SELECT id, source_title, rank FROM ({search_sql('g1')})")
def _(t):
    return s.search_top(t.wiki_docs, " G1 ", "mirror").select("id", "source_title", "rank")


@query("t1_search_text", f"SELECT id, source_title, rank FROM ({search_sql('ation')})")
def _(t):
    return s.search_top(t.wiki_docs, "ation", "mirror").select("id", "source_title", "rank")


@query("t1_index_text", f"SELECT id, source_title, rank FROM ({search_sql('ation')})")
def _(t):
    return search_index.build(t.wiki_docs.drop("text")).search_top("ation", "mirror").select("id", "source_title", "rank")


@query("t1_gram_counts", f"""
SELECT gram, count(*) AS n FROM (SELECT DISTINCT id, field, substr(txt, i, 3) AS gram FROM (SELECT id, field, txt, unnest(range(1, length(txt) - 1)) AS i FROM (
  {" UNION ALL ".join(f"SELECT id, {i} AS field, lower({c}) AS txt FROM wiki_docs WHERE length({c}) > 2" for i, c in enumerate(search_index.FIELDS))})))
GROUP BY gram""")
def _(t):
    counts = search_index.build(t.wiki_docs.drop("text")).table("counts")
    return counts.select("gram", F.col("rows").alias("n"))


KEY = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
DISPLAY = f"""CASE WHEN coalesce(translated_title, '') = '' OR regexp_matches(translated_title, '[가-힣]') THEN ''
  WHEN root_title <> source_title AND NOT contains(source_title, '/') AND {KEY.format('translated_title')} <> {KEY.format('root_title')}
       AND NOT contains({KEY.format('translated_title')}, {KEY.format('root_title')}) THEN translated_title || ' (' || root_title || ')'
  ELSE translated_title END"""


@query("x26_display_title", f"SELECT id, {DISPLAY} AS display_title FROM wiki_docs")
def _(t):
    return t.wiki_docs.select("id", s.display_title().alias("display_title"))


RERANK = f"""
WITH h AS (SELECT *, {DISPLAY} AS display_title FROM ({search_sql('album 1', 'rank0')})),
k AS (SELECT *, {KEY.format('translated_title')} AS t, {KEY.format('display_title')} AS d, {KEY.format('root_title')} AS r, {KEY.format('source_title')} AS s,
  {KEY.format("coalesce(source_wikitext, '')")} AS b FROM h WHERE display_title <> '')
SELECT id, display_title, CASE WHEN t = '' THEN 999 WHEN t = 'album 1' OR d = 'album 1' THEN 0 WHEN source_title = root_title AND starts_with(t, 'album 1') THEN 1
  WHEN starts_with(t, 'album 1') OR starts_with(d, 'album 1') THEN 2 WHEN source_title = root_title AND starts_with(r, 'album 1') THEN 3 WHEN starts_with(r, 'album 1') THEN 4
  WHEN contains(t, 'album 1') OR contains(d, 'album 1') THEN 5 WHEN contains(r, 'album 1') THEN 6 WHEN contains(s, 'album 1') THEN 7 WHEN contains(b, 'album 1') THEN 8 ELSE 50 END AS search_rank
FROM k ORDER BY search_rank, length(display_title), display_title LIMIT 50"""


@query("t2_search_rerank", RERANK)
def _(t):
    hits = s.search_top(t.wiki_docs, "Album 1", "mirror")
    return s.rerank(hits, "Album 1").select("id", "display_title", "search_rank")


@query("t2_index_rerank", f"SELECT id, display_title, search_rank FROM ({RERANK})")
def _(t):
    hits = search_index.build(t.wiki_docs.drop("text")).search_top("Album 1", "mirror")
    return s.rerank(hits, "Album 1").select("id", "display_title", "search_rank")


@query("t6_published_index", f"""
SELECT source_title, translated_title, published_revision_no FROM wiki_docs WHERE {PUBLISHED} AND source_title NOT LIKE '틀:%' ORDER BY source_title""")
def _(t):
    d = t.wiki_docs.where(s.is_published("mirror") & ~F.col("source_title").startswith("틀:"))
    return d.select("source_title", "translated_title", "published_revision_no").orderBy("source_title")


@query("t8_locale_order", "SELECT id, translated_title, row_number() OVER (ORDER BY translated_title COLLATE ko, id) AS pos FROM wiki_docs WHERE translated_title IS NOT NULL")
def _(t):
    d = t.wiki_docs.where("translated_title IS NOT NULL")
    return numbered(d, [F.collate("translated_title", "ko"), F.col("id")]).select("id", "translated_title", "pos")


@query("j23_scalar_query", """
WITH q AS (SELECT lower(trim(max(text))) AS value FROM benchmark)
SELECT d.id, q.value AS needle FROM wiki_docs d, q WHERE q.value <> '' AND contains(lower(d.text), q.value)""")
def _(t):
    # a scalar subquery: one row, joined as a literal of the plan, no cross join of tables
    return t.sql("""SELECT id, needle FROM (SELECT id, text, (SELECT lower(trim(max(text))) FROM benchmark) AS needle FROM wiki_docs)
                    WHERE needle <> '' AND contains(lower(text), needle)""")


PLAIN = r"""regexp_replace(txt, '(?i)\[br\]', chr(10), 'g')"""
for _pat, _rep in (
    (r"\[\*\s*([^\[\]]*?)\s*\]", r" (Note: \1)"), (r"\[\[([^\]|]+)\|([^\]]+)\]\]", r"\2"), (r"\[\[([^\]]+)\]\]", r"\1"),
    (r"\[https?://[^\s\]]+\s+([^\]]+)\]", r"\1"), (r"\[https?://[^\]]+\]", ""), ("''''''", ""), ("''''", ""), (r"\^\^", ""), ("~~", ""),
    (r"(?m)^\s*\*\s?", "• "), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", ""),
):
    PLAIN = f"regexp_replace({PLAIN}, '{_pat}', '{_rep}', 'g')"


@query("x24_plain_text", f"SELECT id, length(p) AS n, md5(p) AS digest FROM (SELECT id, {PLAIN} AS p FROM (SELECT id, source_wikitext AS txt FROM wiki_docs WHERE source_wikitext IS NOT NULL))")
def _(t):
    d = t.wiki_docs.where("source_wikitext IS NOT NULL").select("id", plain_text("source_wikitext").alias("p"))
    return d.select("id", F.length("p").alias("n"), F.md5(F.col("p").cast("binary")).alias("digest"))


@query("x25_search_snippet", r"""
WITH s AS (SELECT id, 'The page ' || CAST(id AS VARCHAR) || ' tells of an act and of its many records and shows. It is kept short here.' AS expected FROM wiki_docs WHERE source_wikitext IS NOT NULL)
SELECT id, expected AS snippet FROM s""")
def _(t):
    # the overview section of these documents holds one prose line, a block and a table
    return t.wiki_docs.where("source_wikitext IS NOT NULL").transform(lambda d: s.with_snippet(d, "source_wikitext")).select("id", "snippet")
