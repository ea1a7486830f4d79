"""Predicates and projections (F*)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import all_matches, article_html, html_to_text
from ..functions.arrays import rows_of
from ..functions.keys import as_col, strip, title_key
from ..functions.markup import count

# Namespaces of the source wiki that hold no articles.
SKIP_NAMESPACES = (
    "파일:", "File:", "틀:", "Template:", "분류:", "Category:", "사용자:", "User:",
    "나무위키:", "NamuWiki:", "특수기능:", "Special:", "토론:", "Discussion:", "휴지통:",
)
# Titles too general to follow.
STOP_TITLES = (
    "대한민국", "한국", "조선민주주의인민공화국", "북한", "일본", "중국", "중화인민공화국", "대만",
    "미국", "영국", "프랑스", "독일", "캐나다", "호주", "러시아", "태국", "필리핀", "베트남",
    "인도네시아", "말레이시아", "싱가포르", "홍콩", "마카오",
    "K-POP", "KPOP", "J-POP", "C-POP", "R&B", "발라드", "댄스", "힙합", "랩", "보컬",
    "아이돌", "가수", "음악", "노래", "앨범", "싱글",
    "YouTube", "유튜브", "Instagram", "인스타그램", "TikTok", "틱톡", "Facebook", "페이스북",
    "Spotify", "스포티파이", "X", "Twitter", "트위터", "Weverse", "위버스", "네이버", "Naver",
)
# Title shapes that are only dates.
CALENDAR_TITLES = (
    r"^(?:18|19|20|21)\d{2}년$",
    r"^(?:18|19|20|21)\d{2}$",
    r"^(?:18|19|20|21)\d{2}년\s*(?:1[0-2]|[1-9])월(?:\s*(?:3[01]|[12]\d|[1-9])일)?$",
    r"^(?:1[0-2]|[1-9])월(?:\s*(?:3[01]|[12]\d|[1-9])일)?$",
    r"^(?:3[01]|[12]\d|[1-9])일$",
    r"^(?:18|19|20|21)\d{2}[.-](?:1[0-2]|0?[1-9])[.-](?:3[01]|[12]\d|0?[1-9])$",
)
# Labels of a profile table.
PROFILE_LABELS = ("본명", "출생", "신체", "MBTI", "포지션", "소속사")
# The five syntax signs of raw markup.
RAW_SIGNS = (r"\[\[[^\]]+\]\]", r"(?m)^={2,6}[^=].*={2,6}$", r"(?m)^\|\|", r"\{\{\{#!", r"(?i)\[\[(?:파일|File):")
# Words of block and challenge pages.
BLOCK_PAGE = r"(?i)captcha|cloudflare|cf-chl|challenge-platform|access denied|비정상적인 접근|자동화된 접근"
# Words that mark paid blocks.
AD_WORDS = r"(?i)(?:파워링크|광고등록|sponsored|advertisement|promoted\s+link|adchoices)"
DOMAIN = r"(?i)\b(?:[a-z0-9-]+\.)+(?:com|net|org|io|me|co\.kr|or\.kr|ne\.kr|kr)\b"
# Template names that document or administer the wiki.
UTILITY_TEMPLATES = (
    r"(?i)^(?:접근\s*제한|설명문서|문서 가져옴|토론 관련 틀|토론 합의(?:/설명문서)?|분류 설명|분류 참고|한시적 넘겨주기)$"
)
PROTECTION_NOTICE = r"(?im)^\s*\[include\(\s*틀\s*:\s*접근\s*제한(?:\s*,[^\]\r\n]*)?\)\]\s*$"


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def is_published(source: str, *, english_source: bool = False) -> Column:
    """Published and readable. With ``english_source`` an English source without stored HTML counts too."""
    html = F.col("published_html").isNotNull() & (F.length("published_html") > 0)
    if english_source:
        text = F.col("published_wikitext").isNotNull() & (F.length("published_wikitext") > 0)
        html = html | (F.coalesce(F.col("published_language") == "en", F.lit(False)) & text)
    return (F.col("source") == source) & (F.coalesce(F.col("published_revision_no"), F.lit(0)) > 0) & html


def published_documents(docs: DataFrame, source: str, **kw) -> DataFrame:
    return docs.where(is_published(source, **kw))


def in_skip_namespace(title: Column | str) -> Column:
    t = as_col(title)
    return any_of([t.startswith(ns) for ns in SKIP_NAMESPACES])


def article_titles(df: DataFrame, title: str) -> DataFrame:
    return df.where(~in_skip_namespace(title))


def is_calendar_title(title: Column | str) -> Column:
    t = title_key(title)
    return (t == "") | any_of([t.rlike(p) for p in CALENDAR_TITLES])


def without_stop_titles(df: DataFrame, title: str) -> DataFrame:
    """Anti-join against the stop titles. The list is a fixed value of under 60 rows, so it is safe to broadcast."""
    stop = df.sparkSession.createDataFrame([(t,) for t in STOP_TITLES], "stop_title string")
    return df.join(F.broadcast(stop), F.col(title) == F.col("stop_title"), "left_anti")


def is_canonical_source(version_pattern: str, source_format: str) -> Column:
    """All four facts of a canonical capture hold."""
    return F.coalesce(
        (F.coalesce(F.col("source_wikitext"), F.lit("")) != "")
        & F.col("raw_extracted_at").isNotNull()
        & (F.col("source_format") == source_format)
        & F.col("source_extraction_version").rlike(version_pattern),
        F.lit(False),
    )


def looks_like_markup(text: Column | str) -> Column:
    t = as_col(text)
    return (F.length(t) >= 500) & (sum(t.rlike(p).cast("int") for p in RAW_SIGNS) >= 2)


def is_block_page(text: Column | str) -> Column:
    return as_col(text).rlike(BLOCK_PAGE)


def profile_score(text: Column | str, labels: tuple[str, ...] = PROFILE_LABELS) -> Column:
    """How many profile labels occur near the start of a line."""
    t = F.coalesce(as_col(text), F.lit(""))
    return sum(t.rlike(rf"(?:^|\n)\|?\|?[^\n]{{0,30}}{w}[^\n]{{0,80}}").cast("int") for w in labels)


def html_blocks(pages: DataFrame, key: str, html: str, tag: str = "ul|ol|table|div|section|aside") -> DataFrame:
    """Innermost blocks of a page in order (no block of the same kinds inside)."""
    found = all_matches(article_html(F.col(html)), rf"(?i)<(?:{tag})\b[^>]*>(?:[^<]++|<(?!/?(?:{tag})\b))*+</(?:{tag})\s*>")
    return rows_of(pages, [key], found, "block", "pos")


def is_injected_ad(block: Column | str, own_domains: tuple[str, ...] = ("wiki.example", "youtube.com"), longest: int | None = None) -> Column:
    """Paid block by its words and links; the geometry of the rendered page is not known here.

    ``longest``: characters above which a block is taken for content; by default there is no such limit.
    """
    b = as_col(block)
    text = strip(F.regexp_replace(html_to_text(b), r"\s+", " "))
    names = F.transform(all_matches(text, DOMAIN), lambda d: F.regexp_replace(F.lower(d), r"^www\.", ""))
    own = "|".join(d.replace(".", r"\.") for d in own_domains)
    domains = F.size(F.array_distinct(F.filter(names, lambda d: ~d.rlike(rf"(?:^|\.)(?:{own})$"))))
    anchors, tables = count(b, r"(?i)<a\b"), count(b, r"(?i)<table\b")
    headings = count(b, r"(?i)<h[1-6]\b")
    explicit = text.rlike(AD_WORDS) | b.rlike(r"""(?i)^<[^>]*aria-label=["'][^"']*(?:파워링크|광고등록|sponsored|advertisement|adchoices)""")
    body = (text != "") & (F.length(text) <= longest if longest is not None else F.lit(True))
    return body & ((explicit & (anchors >= 2)) | ((domains >= 2) & (anchors >= 6) & (tables >= 2) & (headings == 0)))


def strip_notices(source: Column | str) -> Column:
    return F.regexp_replace(as_col(source), PROTECTION_NOTICE, "")


def is_content_template(title: Column | str) -> Column:
    """Templates worth keeping: in the template namespace, no documentation page and no administration template."""
    t = F.regexp_replace(title_key(title), r"(?i)^(틀|Template)\s*:\s*", "$1:")
    body = strip(F.regexp_replace(t, r"(?i)^틀:", ""))
    return t.rlike("^틀:") & ~t.rlike(r"/설명문서(?:$|/)") & ~body.rlike(UTILITY_TEMPLATES)

