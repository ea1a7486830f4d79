"""HTML column expressions. They work on the raw text of a page and need no parser process."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import running_sums
from .keys import FILE_PREFIX, as_col, let, nfkc, strip
from .urls import SITE, Site, host, is_non_payload, percent_decode

# The entities the page decoder knows.
BASIC_ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"))
BRACKET_ENTITIES = (("&#91;", "["), ("&#93;", "]"), ("&#123;", "{"), ("&#125;", "}"))
# Title namespaces that are never article links.
EXCLUDED_NAMESPACES = ("분류:", "파일:", "틀:", "나무위키:", "특수기능:", "사용자:")

IMAGE_URL = r"(?i)\.(?:jpg|jpeg|png|webp|gif|svg)(?:\?|$)"
RAW_BLOCK = r"(?i)<pre\b[^>]*>\s*<code\b[^>]*>([\s\S]*?)</code>\s*</pre>"


def all_matches(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def match_spans(text: Column, pattern: str) -> Column:
    """Start (1-based) and text of every match of a pattern, from the lengths of the matches and the pieces between them."""

    def placed(parts: Column) -> Column:
        ends = running_sums(F.transform(parts, lambda z: F.length(z["piece"]) + F.coalesce(F.length(z["raw"]), F.lit(0))))
        spans = lambda e: F.transform(parts, lambda z, i: F.struct((F.get(e, i) - F.length(z["raw"]) + 1).alias("start"), z["raw"].alias("raw")))
        return F.filter(let(ends, spans), lambda s: s["raw"].isNotNull())

    return let(woven(text, pattern), placed)


def woven(text: Column, pattern: str, *groups: int) -> Column:
    """A text cut at the matches of a pattern: structs of the ``piece`` before a match, the match (``raw``) and its groups
    (``g1``, …). The last one has the rest of the text and no match."""
    columns = [F.split(text, pattern, -1).alias("piece"), all_matches(text, pattern).alias("raw")]
    return F.arrays_zip(*columns, *[all_matches(text, pattern, g).alias(f"g{g}") for g in groups])


CHUNK = 512


def chunks(text: Column) -> Column:
    """A text in pieces of ``CHUNK`` characters, for ``cut``."""
    return all_matches(text, rf"(?s).{{1,{CHUNK}}}")


def cut(pieces: Column, start: Column, length: Column) -> Column:
    """``substring(text, start, length)`` from the text's ``chunks``, which does not read the text from its beginning."""
    first = F.floor((start - 1) / CHUNK).cast("int")
    last = F.floor((start + length - 2) / CHUNK).cast("int")
    part = F.array_join(F.slice(pieces, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
    return F.when(length > 0, F.substring(part, (start - first * CHUNK).cast("int"), length.cast("int"))).otherwise("")


def decode_basic(c: Column) -> Column:
    for entity, text in BASIC_ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(text))
    return c


def _numeric_entities(c: Column) -> Column:
    """Decode numeric entities piece by piece (no per-row Python)."""
    pattern = r"(?i)&#x[0-9a-f]+;|&#[0-9]+;"

    def char(e: Column) -> Column:
        is_hex = F.lower(e).startswith("&#x")
        digits = F.regexp_extract(e, r"(?i)&#x?([0-9a-f]+);", 1)
        code = F.conv(digits, 16, 10).cast("bigint")
        code = F.when(is_hex, code).otherwise(digits.cast("bigint"))
        # UTF-32 bytes of the code point
        return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")

    rebuilt = F.array_join(F.transform(woven(c, pattern), lambda z: F.concat(z["piece"], F.coalesce(char(z["raw"]), F.lit("")))), "")
    return F.when(c.rlike(pattern), rebuilt).otherwise(c)


def decode_all(c: Column) -> Column:
    for entity, text in BASIC_ENTITIES + BRACKET_ENTITIES:
        c = F.regexp_replace(c, "(?i)" + entity, text)
    return let(c, _numeric_entities)


def html_to_text(html: Column | str) -> Column:
    c = as_col(html)
    c = F.regexp_replace(c, r"(?i)<script[\s\S]*?</script>", "")
    c = F.regexp_replace(c, r"(?i)<style[\s\S]*?</style>", "")
    c = F.regexp_replace(c, r"(?i)<br\s*/?>", "\n")
    c = F.regexp_replace(c, r"(?i)</p>|</div>|</li>|</tr>|</h[1-6]>", "\n")
    c = F.regexp_replace(c, r"<[^>]+>", "")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return decode_basic(strip(c))


def visible_html(html: Column | str) -> Column:
    """HTML without the elements that never show text."""
    return F.regexp_replace(as_col(html), r"(?i)<(script|style|noscript|template)\b[\s\S]*?</\1\s*>", "")


def visible_text(html: Column | str) -> Column:
    return decode_basic(F.regexp_replace(visible_html(html), r"<[^>]+>", ""))


def article_html(html: Column | str) -> Column:
    html = as_col(html)
    inner = F.regexp_extract(html, r"(?i)<article\b[^>]*>([\s\S]*?)</article>", 1)
    return F.coalesce(F.nullif(inner, F.lit("")), html)


def is_article_title(title: Column) -> Column:
    ok = (title != "") & ~title.rlike(r"^@.+@$") & ~title.endswith("/")
    ok = ok & ~title.rlike(r"^(?:\d{4}년|\d{1,2}월(?:\s|$)|\d{1,2}월\s*\d{1,2}일|\d{1,2}월\s*$)")
    for ns in EXCLUDED_NAMESPACES:
        ok = ok & ~title.startswith(ns)
    return ok


def internal_links(html: Column | str, site: Site = SITE) -> Column:
    """Distinct article titles a page links to, in order of first appearance."""
    raw = all_matches(as_col(html), rf"""(?i)href=["']{site.link_prefix}([^"'#?]+)[^"']*["']""", 1)
    return F.filter(F.array_distinct(F.transform(raw, percent_decode)), is_article_title)


def external_links(html: Column | str, site: Site = SITE) -> Column:
    raw = F.transform(all_matches(as_col(html), r"""(?i)href=["'](https?://[^"']+)["']""", 1), decode_basic)
    bare = lambda u: F.regexp_replace(host(u), r"^www\.", "")
    return F.filter(F.array_distinct(raw), lambda u: F.coalesce(~bare(u).isin(*site.own_hosts), F.lit(False)))


def image_refs(html: Column | str) -> Column:
    """File names in markup residue, then image addresses in attributes and in the text."""
    c = as_col(html)
    names = F.transform(all_matches(c, r"(?:파일:|Image:\s*파일:)([^|<\]\n]+)", 1), strip)
    attrs = all_matches(c, r"""(?i)(?:src|data-src)=["'](https?://[^"']+)["']""", 1)
    bare = all_matches(c, r"""(?i)https?://[^"'<>\s]+\.(?:jpg|jpeg|png|webp|gif|svg)(?:\?[^"'<>\s]*)?""")
    urls = F.filter(F.concat(attrs, bare), lambda u: u.rlike(IMAGE_URL))
    return F.array_distinct(F.concat(names, urls))


def video_urls(html: Column | str) -> Column:
    c = as_col(html)
    attrs = all_matches(c, r"""(?i)(?:src|href)=["'](https?://[^"']*(?:youtube\.com|youtu\.be|vimeo\.com|tiktok\.com)[^"']*)["']""", 1)
    bare = all_matches(c, r"""(?i)https?://(?:www\.)?(?:youtube\.com|youtu\.be|vimeo\.com|tiktok\.com)/[^"'<>\s]+""")
    return F.array_distinct(F.transform(F.concat(attrs, bare), decode_basic))


def video_provider(url: Column) -> Column:
    return (
        F.when(url.rlike("(?i)youtu"), "youtube").when(url.rlike("(?i)vimeo"), "vimeo").when(url.rlike("(?i)tiktok"), "tiktok")
    ).otherwise("external")


def video_id(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?i)(?:youtube\.com/(?:watch\?v=|embed/|shorts/)|youtu\.be/)([A-Za-z0-9_-]{6,})", 1)
    return F.when((video_provider(url) == "youtube") & (found != ""), found)


def attribute(tag: Column, name: str) -> Column:
    """Value of a tag attribute in double or single quotes, null when absent."""
    double = F.regexp_extract(tag, rf"""(?i)\s{name}\s*=\s*"([^"]*)\"""", 1)
    single = F.regexp_extract(tag, rf"""(?i)\s{name}\s*=\s*'([^']*)'""", 1)
    return F.nullif(F.when(double != "", double).otherwise(single), F.lit(""))


def file_name(value: Column) -> Column:
    return F.regexp_replace(strip(nfkc(value)), FILE_PREFIX, "")


def media_url(value: Column, site: Site = SITE) -> Column:
    """Absolute address of a media attribute, empty when it is none."""

    def absolute(u: Column) -> Column:
        return (
            F.when(u.startswith("//"), F.concat(F.lit("https:"), u))
            .when(u.startswith("/"), F.concat(F.lit(f"https://www.{site.mirror}"), u))
            .when(u.rlike("(?i)^https?://"), u)
            .otherwise("")
        )

    return let(strip(decode_all(F.coalesce(value, F.lit("")))), absolute)


def image_tags(html: Column | str) -> Column:
    return all_matches(article_html(html), r"(?i)<img\b[^>]*>")


def image_tag_url(tag: Column, site: Site = SITE) -> Column:
    """First usable address among data-original, data-src, srcset, src and an address embedded anywhere in the tag."""
    srcset = F.transform(
        F.split(F.coalesce(attribute(tag, "srcset"), F.lit("")), ","), lambda v: F.regexp_extract(strip(v), r"^(\S+)", 1)
    )
    embedded = F.regexp_extract(tag, rf"(?i)(?:https?:)?//{site.file_host}/file/[a-z0-9]+", 0)
    candidates = F.concat(
        F.array(attribute(tag, "data-original"), attribute(tag, "data-src")), srcset, F.array(attribute(tag, "src"), embedded)
    )
    usable = F.filter(F.transform(candidates, lambda v: media_url(v, site)), lambda u: (u != "") & ~is_non_payload(u, site))
    return F.get(usable, F.lit(0))


def image_tag_file(tag: Column) -> Column:
    """File an image tag shows: its alt text with a file prefix, or a bare file name."""

    def shown(alt: Column) -> Column:
        named = F.regexp_extract(alt, r"(?i)^(?:파일|File):(.+)$", 1)
        return F.when(named != "", strip(named)).when(alt.rlike(r"(?i)\.(?:avif|gif|jpe?g|png|svg|webp)$"), alt)

    return let(strip(decode_all(F.coalesce(attribute(tag, "alt"), F.lit("")))), shown)


RENDERED_FEATURES = {
    "tables": r"(?i)<table\b",
    "details": r"(?i)<details\b",
    "footnotes": r"""(?i)<[^>]*\bclass=["'][^"']*\bwiki-fn-content\b""",
    "youtube": r"""(?i)<iframe\b[^>]*\bsrc=["'][^"']*(?:youtube\.com/embed/|youtube-nocookie\.com/embed/)""",
    "colspan": r"(?i)<[^>]*\scolspan\s*=",
    "rowspan": r"(?i)<[^>]*\srowspan\s*=",
    "headings": r"""(?i)<h[1-6]\b|<[^hH>][^>]*\bclass=["'][^"']*\bwiki-heading\b""",
    "toc": r"""(?i)<[^>]*\bclass=["'][^"']*\bwiki-macro-toc\b""",
    "links": r"""(?i)<a\b[^>]*\bclass=["'][^"']*\bwiki-link-internal\b""",
    "images": r"(?i)<img\b",
    "svg": r"(?i)<svg\b",
}


def rendered_features(html: Column | str) -> dict[str, Column]:
    return {name: F.regexp_count(as_col(html), F.lit(p)) for name, p in RENDERED_FEATURES.items()}
