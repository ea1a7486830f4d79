"""Normalized text keys. The rules differ by use and stay separate on purpose."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Namespace words of the source wiki and their English forms.
FILE_PREFIX = r"(?i)^(?:파일|File):"
TEMPLATE_PREFIX = r"(?i)^(?:틀|Template):"
IMAGE_EXTENSION = r"(?i)\.(?:avif|gif|jpe?g|png|svg|webp)$"
NON_ASCII = r"[^\x00-\x7F]"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, for expressions that use a long value several times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _icu(method: str, c: Column) -> Column:
    """Compatibility normalization by the ICU library that ships with Spark; ASCII texts are left alone."""
    call = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit(method), F.coalesce(c, F.lit("")), F.lit(True))
    return F.when(c.rlike(NON_ASCII), call).otherwise(c)


def nfkc(c: Column | str) -> Column:
    """Unicode NFKC."""
    return _icu("compose", as_col(c))


def nfkd(c: Column | str) -> Column:
    """Unicode NFKD."""
    return _icu("decompose", as_col(c))


def strip(c: Column | str) -> Column:
    """Trim all leading and trailing whitespace, including line breaks."""
    return F.regexp_replace(as_col(c), r"^\s+|\s+$", "")


def title_key(c: Column | str) -> Column:
    return strip(nfkc(c))


def clean_spaces(c: Column) -> Column:
    """No-break spaces become spaces, characters without width go."""
    c = F.regexp_replace(c, "\u00a0", " ")
    return F.regexp_replace(c, "[\u200b-\u200d\u2060\ufeff]", "")


def title_key_strict(c: Column | str) -> Column:
    return strip(F.regexp_replace(clean_spaces(nfkc(c)), r"[ \t]+", " "))


def asset_name(c: Column | str) -> Column:
    c = F.regexp_replace(strip(clean_spaces(nfkc(c))), FILE_PREFIX, "")
    return F.regexp_replace(c, r"[ \t]+", " ")


def asset_key(c: Column | str) -> Column:
    return F.lower(asset_name(c))


def asset_key_noquery(c: Column | str) -> Column:
    c = F.regexp_replace(title_key_strict(c), FILE_PREFIX, "")
    return F.lower(F.regexp_replace(c, r"[?#].*$", ""))


def asset_base_key(c: Column | str) -> Column:
    return F.regexp_replace(asset_key_noquery(c), IMAGE_EXTENSION, "")


def template_title(c: Column | str) -> Column:
    """Template titles in the local namespace; the prefix is added where it is absent."""
    raw = title_key(c)
    return (
        F.when(raw == "", "")
        .when(raw.rlike("^틀:"), raw)
        .when(raw.rlike("(?i)^Template:"), F.concat(F.lit("틀:"), strip(F.regexp_replace(raw, "(?i)^Template:", ""))))
        .otherwise(F.concat(F.lit("틀:"), raw))
    )


def document_key(c: Column | str) -> Column:
    """Title key with the English template prefix folded into the local one, so titles and includes can be joined."""
    t = title_key(c)
    return F.when(t.rlike(TEMPLATE_PREFIX), template_title(c)).otherwise(t)


def link_target_key(c: Column | str) -> Column:
    return F.lower(strip(F.regexp_replace(nfkc(c), r"#.*$", "")))


def search_key(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(nfkc(c)), r"[^a-z0-9]+", " "))


def file_ref(c: Column | str) -> Column:
    """File reference without namespace, spaces collapsed, case kept."""
    return F.regexp_replace(strip(F.regexp_replace(nfkc(c), FILE_PREFIX, "")), r"\s+", " ")


def _stem_ext(c: Column) -> tuple[Column, Column]:
    value = F.lower(file_ref(c))
    has_ext = value.rlike(r"(?s)^.+\.[^.]+$")
    stem = F.when(has_ext, F.regexp_replace(value, r"\.[^.]*$", "")).otherwise(value)
    ext = F.when(has_ext, F.regexp_extract(value, r"\.([^.]*)$", 1)).otherwise("")
    return stem, ext


def token_signature(c: Column | str) -> Column:
    """Extension plus the sorted punctuation-separated tokens of the stem."""
    stem, ext = _stem_ext(as_col(c))
    spaced = F.regexp_replace(stem, r"[\[\](){}'\"“”‘’.,:;_+\-/\\]+", " ")
    tokens = F.array_sort(F.filter(F.split(spaced, r"\s+"), lambda t: t != ""))
    return F.concat(ext, F.lit("|"), F.array_join(tokens, "|"))


def compact_signature(c: Column | str) -> Column:
    """Extension plus the stem without anything but digits, Latin letters and Hangul."""
    stem, ext = _stem_ext(as_col(c))
    return F.concat(ext, F.lit("|"), F.regexp_replace(stem, r"[^0-9a-z가-힣]+", ""))


def cover_title(file: Column | str, root: Column | str) -> Column:
    """Album title of a cover file name: no extension, no trailing ``(root)``, no ``cover`` suffix; null for other files."""
    name = file_ref(file)
    stem = F.regexp_replace(name, r"\.[^.]+$", "")
    qualifier = F.concat(F.lit("("), as_col(root), F.lit(")"))
    stem = F.when(
        F.lower(stem).endswith(F.lower(qualifier)), F.substring(stem, F.lit(1), F.length(stem) - F.length(qualifier))
    ).otherwise(stem)
    stem = F.regexp_replace(stem, r"(?i)\s+(?:digital\s+)?cover$", "")
    return F.when(
        name.rlike(r"(?i)\.(?:jpg|jpeg|png|webp|avif)$"), F.regexp_replace(F.lower(stem), r"[\s:._-]+", "")
    )


def storage_prefix(root: Column | str) -> Column:
    """Folder name of a root title: ASCII slug, or the title with dashes when nothing ASCII is left."""
    root = as_col(root)
    slug = F.regexp_replace(F.regexp_replace(F.lower(nfkd(root)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.when(slug != "", slug).otherwise(F.lower(F.regexp_replace(nfkc(root), r"\s+", "-")))


def anchor_slug(c: Column | str, fallback: Column) -> Column:
    base = F.regexp_replace(F.lower(nfkc(c)), r"^\d+(?:\.\d+)*\.?\s*", "")
    base = F.regexp_replace(F.regexp_replace(base, r"[^a-z0-9가-힣]+", "-"), r"^-+|-+$", "")
    return F.when(base != "", base).otherwise(F.concat(F.lit("section-"), fallback.cast("string")))


def path_part(c: Column | str) -> Column:
    """ASCII-safe path part; ``asset`` when nothing is left. Beyond 80 characters the rest is told apart by a digest."""
    base = F.regexp_replace(F.lower(nfkd(c)), r"[^a-z0-9._-]+", "-")
    base = F.regexp_replace(base, r"^-+|-+$", "")
    short = F.concat(F.substring(base, 1, 80), F.lit("-"), F.substring(F.sha2(base, 256), 1, 16))
    return F.when(base == "", "asset").when(F.length(base) > 80, short).otherwise(base)
