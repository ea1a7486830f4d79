"""Search over published documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import search_key, strip, title_key
from ..functions.markup import count, depth_after_lines, prose_text, unix_lines
from .filters import is_published

HANGUL = "[가-힣]"


def search_top(docs: DataFrame, text: str, source: str, limit: int = 80) -> DataFrame:
    """Published articles that contain the query, best title match first.

    The query is a literal, so the scan filters in place and only the top rows of each partition reach the final sort.
    """
    q = text.strip(" ").lower()
    title, root = F.lower(F.coalesce("translated_title", F.lit(""))), F.lower(F.coalesce("root_title", F.lit("")))
    own, body = F.lower(F.coalesce("source_title", F.lit(""))), F.lower(F.coalesce("source_wikitext", F.lit("")))
    has = lambda c: c.contains(q)
    rank = (
        F.when(title == q, 0)
        .when(title.startswith(q), 1)
        .when(has(title), 2)
        .when(root.startswith(q), 3)
        .when(has(root), 4)
        .when(has(own), 5)
        .otherwise(6)
    )
    namespaced = F.col("source_title").startswith("틀:") | F.col("source_title").startswith("파일:")
    hits = docs.where(F.lit(q != "") & is_published(source) & ~namespaced & (has(title) | has(own) | has(root) | has(body)))
    # what the display order needs to know of a text is worked out here, so that no text goes to the final sort
    hits = hits.withColumns({"rank": rank, "body_hit": search_key(F.coalesce("source_wikitext", F.lit(""))).contains(search_key(F.lit(text)))})
    return hits.drop("source_wikitext").orderBy("rank", F.length(F.coalesce("translated_title", "source_title")), "source_title").limit(limit)


def display_title() -> Column:
    """English title, with the root in parentheses when the title does not imply it; empty for untranslated titles."""
    title = title_key(F.coalesce("translated_title", F.lit("")))
    root = title_key(F.coalesce("root_title", F.lit("")))
    related = (root != "") & (root != F.col("source_title")) & ~F.col("source_title").contains("/")
    related = related & (search_key(title) != search_key(root)) & ~F.contains(search_key(title), search_key(root))
    return (
        F.when((title == "") | title.rlike(HANGUL), "")
        .when(related, F.concat(title, F.lit(" ("), root, F.lit(")")))
        .otherwise(title)
    )


def rerank(hits: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """Order search hits for display: exact titles, then root documents, then prefixes, containment, and text."""
    q = search_key(F.lit(text))
    h = hits.withColumn("display_title", display_title()).where(F.col("display_title") != "")
    h = h.select(
        "*",
        q.alias("_q"),
        search_key(F.coalesce("translated_title", F.lit(""))).alias("_t"),
        search_key("display_title").alias("_d"),
        search_key(F.coalesce("root_title", F.lit(""))).alias("_r"),
        search_key("source_title").alias("_s"),
    )
    t, d, r, s, qq = (F.col(c) for c in ("_t", "_d", "_r", "_s", "_q"))
    is_root = F.coalesce(F.col("source_title") == F.col("root_title"), F.lit(False))
    rank = (
        F.when((qq == "") | (t == ""), 999)
        .when((t == qq) | (d == qq), 0)
        .when(is_root & t.startswith(qq), 1)
        .when(t.startswith(qq) | d.startswith(qq), 2)
        .when(is_root & r.startswith(qq), 3)
        .when(r.startswith(qq), 4)
        .when(t.contains(qq) | d.contains(qq), 5)
        .when(r.contains(qq), 6)
        .when(s.contains(qq), 7)
        .when(F.col("body_hit"), 8)
        .otherwise(50)
    )
    return (
        h.withColumn("search_rank", rank)
        .drop("_q", "_t", "_d", "_r", "_s")
        .orderBy("search_rank", F.length("display_title"), "display_title")
        .limit(limit)
    )


def overview_body(source: Column | str) -> Column:
    """Text below the overview heading up to the next top heading; the whole text when there is none."""
    s = unix_lines(source)
    after = F.regexp_replace(s, r"(?ims)\A.*?^==\s*Overview\s*==\s*$", "")
    cut = F.regexp_replace(after, r"(?ms)^==\s*[^=][^\n]*?\s*==\s*$.*\z", "")
    return F.when(s.rlike(r"(?im)^==\s*Overview\s*==\s*$"), cut).otherwise(s)


def with_snippet(docs: DataFrame, source: str, name: str = "snippet") -> DataFrame:
    """Add the prose of the overview: whole lines outside blocks until 220 characters are reached, cut to 217 and an ellipsis."""
    docs = docs.withColumn("_lines", F.split(overview_body(source), "\n", -1))
    docs = docs.withColumn("_depth", depth_after_lines(F.col("_lines")))
    return docs.withColumn(name, _snippet(F.col("_lines"), F.col("_depth"))).drop("_lines", "_depth")


def _snippet(raw: Column, after: Column) -> Column:
    kept = F.filter(
        F.transform(
            raw,
            lambda x, i: F.struct(
                strip(x).alias("line"),
                # inside a block, or opening one
                ((F.coalesce(F.get(after, i - 1), F.lit(0)) > 0) | (count(x, r"\{\{\{") > 0)).alias("inside"),
            ),
        ),
        lambda x: (x["line"] != "")
        & ~x["inside"]
        & ~x["line"].rlike(r"^\|\||^={2,6}|^\s*[*-]\s+|^##@")
        & ~x["line"].rlike(r"(?i)^\[(?:include|youtube|목차|clearfix)"),
    )

    def clean(x: Column) -> Column:
        t = F.regexp_replace(prose_text(x["line"]), r"(?i)\[(?:age|dday)\([^\]]+\)\]", " ")
        return strip(F.regexp_replace(F.regexp_replace(t, r"\[[^\]]+\]", " "), r"\s+", " "))

    prose = F.filter(
        F.transform(kept, clean), lambda t: (F.length(t) >= 45) & t.rlike("[A-Za-z]") & t.rlike("[.!?]")
    )
    joined = F.aggregate(
        prose,
        F.lit(""),
        lambda acc, t: F.when(F.length(acc) >= 220, acc).when(acc == "", t).otherwise(F.concat(acc, F.lit(" "), t)),
    )
    return F.when(
        F.length(joined) > 220, F.concat(F.regexp_replace(F.substring(joined, 1, 217), r"\s+$", ""), F.lit("…"))
    ).otherwise(joined)
