"""Wiki markup column expressions."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import first_per
from .batches import per_value
from .html import all_matches, woven
from .keys import as_col, strip

COMMENT_LINE = r"^\s*##"
# include call with up to two levels of nested parentheses; a ')' that no ']' follows does not end the call
BALANCED_INCLUDE = r"(?i)\[include\(((?:[^()]++|\((?:[^()]++|\([^()]*+\))*+\)|\)(?!\]))*+)\)\]"
INCLUDE_OPEN = r"(?i)\[include\("
LINK = r"\[\[([^\]|\n]+)(?:\|[^\]]*)?\]\]"
FILE_LINK = r"(?i)\[\[(?:파일|File):([^\]|\n]+)(?:\|[^\]]*)?\]\]"
# Words of the source wiki.
CATEGORY_OR_FILE = r"(?i)^(?:파일|File|분류|Category):"


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def unix_lines(c: Column | str) -> Column:
    return F.regexp_replace(as_col(c), r"\r\n?", "\n")


def lines(c: Column | str) -> Column:
    return F.split(unix_lines(c), "\n", -1)


def active_source(c: Column | str) -> Column:
    """Source without comment lines."""
    return F.array_join(F.filter(F.split(as_col(c), r"\r?\n", -1), lambda x: ~x.rlike(COMMENT_LINE)), "\n")


def article_links(source: Column) -> Column:
    targets = F.transform(all_matches(source, r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]", 1), strip)
    return F.filter(targets, lambda t: (t != "") & ~t.rlike(CATEGORY_OR_FILE))


# What is counted in a source.
SOURCE_FEATURES = {
    "table_lines": r"(?:^|\n)[^\n]*\|\|",
    "folding": r"#!folding\b",
    "include": INCLUDE_OPEN,
    "wiki": r"#!wiki\b",
    "if_macro": r"#!if\b",
    "footnote": r"\[\*(?!\*)",
    "youtube": r"(?i)\[youtube\(",
    "colspan": r"<-\d+>",
    "rowspan": r"<(?:\^|v)?\|\d+>",
    "headings": r"(?:^|\n)={1,6}\s*[^\n=].*?\s*={1,6}(?=\n|$)",
    "toc": r"(?i)\[(?:목차|tableofcontents)\]",
    "category": r"(?i)\[\[(?:분류|Category):",
}


def source_features(raw: Column) -> dict[str, Column]:
    """The 14 syntax counts of a source without comment lines."""
    out = {name: count(raw, p) for name, p in SOURCE_FEATURES.items()}
    out["links"] = F.size(article_links(raw))
    out["file_refs"] = F.size(F.filter(all_matches(raw, r"(?i)\[\[(?:파일|File):([^\]|]+)", 1), lambda x: strip(x) != ""))
    return out


def simple_includes(source: Column | str) -> Column:
    """Include targets by the short rule: up to the first comma, closing parenthesis or line end."""
    return F.filter(F.transform(all_matches(as_col(source), r"(?i)\[include\(\s*([^,\)\n]+)", 1), strip), lambda x: x != "")


INCLUDE_TOKEN = re.compile(r"\[include\(|[()]", re.I)


@per_value(T.ArrayType(T.StringType()))
def _scan_includes(text: str) -> list[str]:
    """Text and call bodies in turn, for the few texts whose nesting is too deep for the pattern."""
    cuts, begin, depth = [0], None, 0
    for token in INCLUDE_TOKEN.finditer(text):
        mark = token.group()
        if begin is None:
            begin, depth = (token.span(), 0) if len(mark) > 1 else (None, 0)
        elif mark != ")":
            depth += 1
        elif depth:
            depth -= 1
        elif text.startswith("]", token.end()):
            cuts += [*begin, token.start(), token.end() + 1]
            begin = None
    return [text[i:j] for i, j in zip(cuts[::2], [*cuts[1::2], None], strict=True)]


def include_pieces(source: Column | str) -> Column:
    """A text cut at its include calls: even items are text, odd items the inner text of a call (balanced rule).

    The pattern handles two levels of nesting inside the JVM; a text where it finds fewer calls than openers goes to the
    scanner, the others reach it as nulls.
    """
    raw = as_col(source)
    found = all_matches(raw, BALANCED_INCLUDE, 1)
    exact = F.size(found) == count(raw, INCLUDE_OPEN)
    zipped = F.flatten(F.transform(woven(raw, BALANCED_INCLUDE, 1), lambda z: F.filter(F.array(z["piece"], z["g1"]), lambda x: x.isNotNull())))
    return F.when(exact, zipped).otherwise(_scan_includes(F.when(~exact, raw)))


def include_bodies(source: Column | str) -> Column:
    """Inner text of every include call."""
    return F.filter(include_pieces(unix_lines(source)), lambda x, i: i % 2 == 1)


SCOPE_TOKEN = re.compile(r"""\[\[|\]\]|\{\{\{|\}\}\}|[(),|="]""")


def split_scopes(text: str, mark: str, links: bool) -> list[str]:
    """Split at ``mark`` outside parentheses; with ``links`` also outside links, braces and double quotes.

    Scopes nest without bound. Parentheses inside links and braces are text, and so is a closer of a scope that is not open.
    """
    parts, begin, paren, square, curly, quoted = [], 0, 0, 0, 0, False
    for token in SCOPE_TOKEN.finditer(text):
        t, at = token.group(), token.start()
        if quoted or (t == '"' and links):
            quoted = not quoted or t != '"' or text[at - 1] == "\\"
        elif links and t in ("[[", "]]"):
            square = max(0, square + (1 if t == "[[" else -1))
        elif links and len(t) == 3:
            curly = max(0, curly + (1 if t == "{{{" else -1))
        elif t in "()":
            if not square and not curly:
                paren = max(0, paren + (1 if t == "(" else -1))
        elif t == mark and not (paren or square or curly):
            parts.append(text[begin:at])
            begin = token.end()
    return [*parts, text[begin:]]


def _splitter(mark: str, links: bool):
    return per_value(T.ArrayType(T.StringType()))(lambda text: split_scopes(text, mark, links))


_SPLIT = {(mark, links): _splitter(mark, links) for mark in ",|" for links in (False, True)}


def split_top(body: Column, mark: str, links: bool = True) -> Column:
    """``split_scopes`` of a column. A text without an opener is split in the JVM, only the others reach Python."""
    opened = body.rlike(r"""[("]|\[\[|\{\{\{""")
    return F.when(opened, _SPLIT[mark, links](F.when(opened, body))).otherwise(F.split(body, re.escape(mark), -1))


@per_value(T.ArrayType(T.StringType()))
def _split_once(text: str) -> list[str]:
    first = split_scopes(text, "=", True)[0]
    return [first, text[len(first) + 1:]] if len(first) < len(text) else [text]


def split_once(part: Column) -> Column:
    """A parameter cut at its first equals sign outside all scopes: name and value, or the value alone."""
    opened = part.rlike(r"""^[^=]*(?:[("]|\[\[|\{\{\{)""") & F.contains(part, F.lit("="))
    return F.when(opened, _split_once(F.when(opened, part))).otherwise(F.split(part, "=", 2))


def top_level_parts(body: Column) -> Column:
    """Split a call at the commas outside parentheses, however deep they nest."""
    return split_top(body, ",", links=False)


def include_target(body: Column) -> Column:
    """Template title of a call: the text before the first comma outside parentheses, blanks tidied."""
    name = F.regexp_extract(body, r"^((?:[^,()]++|\([^()]*+\)|\))*+)", 1)
    name = F.regexp_replace(name, "\u00a0", " ")
    name = F.regexp_replace(strip(name), r"(?i)^(틀|Template)\s*:\s*", "$1:")
    return strip(F.regexp_replace(name, r"[ \t]+", " "))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _running_depth(values: pd.Series) -> pd.Series:
    """Running sum that never falls below zero, per array."""

    def one(deltas) -> np.ndarray:
        total = np.cumsum(np.asarray(deltas, dtype=np.int64))
        return (total - np.minimum(np.minimum.accumulate(total), 0)).astype(np.int32) if len(total) else total.astype(np.int32)

    return values.map(one, na_action="ignore")


def depth_after_lines(line_array: Column) -> Column:
    """Nesting depth of ``{{{`` blocks after each line. Only the small integer arrays travel to Python, never the text."""
    return _running_depth(F.transform(line_array, lambda x: count(x, r"\{\{\{") - count(x, r"\}\}\}")))


def final_depth(source: Column, opener: str, closer: str) -> Column:
    """Unclosed openers at the end of a text; closers without an opener are ignored."""
    tokens = all_matches(source, f"{opener}|{closer}")
    return F.aggregate(
        tokens, F.lit(0), lambda acc, t: F.greatest(F.lit(0), acc + F.when(t.rlike(f"^{opener}"), 1).otherwise(-1))
    )


NESTED = r"(?:[^\[\]]++|\[(?:[^\[\]]++|\[[^\[\]]*+\])*+\])*+"


# How a block reads, rule after rule (pattern, what takes its place).
PLAIN_RULES = (
    (r"(?i)\[br\]", "\n"),
    (r"\[\*\s*\]", ""),
    (r"\[\*\s*(" + NESTED + r")\]", " (Note: $1\u0001"),
    (r"\s*\u0001", ")"),
    (r"\[\[([^\]|]+)\|([^\]]+)\]\]", "$2"),
    (r"\[\[([^\]]+)\]\]", "$1"),
    (r"\[https?://[^\s\]]+\s+([^\]]+)\]", "$1"),
    (r"\[https?://[^\]]+\]", ""),
    ("'''", ""),
    ("''", ""),
    (r"\^\^", ""),
    ("~~", ""),
    (r"(?m)^\s*\*\s?", "• "),
    (r"[ \t]+\n", "\n"),
    (r"\n{3,}", "\n\n"),
)


def rewritten(c: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """A text after a table of replacement rules, applied in their order, without blanks at its ends."""
    return strip(reduce(lambda text, rule: F.regexp_replace(text, *rule), rules, c))


def plain_text(c: Column | str) -> Column:
    """Readable text of a block: links become labels, notes are spelled out, emphasis is dropped."""
    return rewritten(as_col(c), PLAIN_RULES)


def prose_text(c: Column) -> Column:
    """Search text of a line: no files, links as labels, no notes, no Hangul."""
    t = F.regexp_replace(c, r"(?i)\[\[(?:파일|File):[^\]]+\]\]", " ")
    t = F.regexp_replace(t, r"\[\[([^\]|]+)\|([^\]]+)\]\]", "$2")
    t = F.regexp_replace(t, r"\[\[([^\]]+)\]\]", "$1")
    for p in (r"(?i)\[br\]", r"\[\*[^\]]*\]", r"[가-힣]+"):
        t = F.regexp_replace(t, p, " ")
    t = F.regexp_replace(t, "'''|''", "")
    return strip(F.regexp_replace(t, r"\s+", " "))


def resolve_link(target: Column, current: Column) -> Column:
    """Title a link points to; empty for addresses, namespaces and links inside the page."""
    t = strip(F.regexp_replace(target, "\u00a0", " "))
    inner = strip(F.regexp_replace(strip(F.regexp_replace(t, r"^:", "")), r"#.*$", ""))
    full = F.when(
        inner.startswith("/"),
        F.when(current != "", F.concat(F.regexp_replace(current, r"/$", ""), inner)).otherwise(""),
    ).otherwise(inner)
    # Namespaces that are not article targets.
    skip = r"(?i)^(?:파일|File|분류|Category|틀|Template|나무위키|사용자|User|토론|특수기능|Special):"
    return F.when(t.rlike(r"(?i)^(?:https?:|ftp:|mailto:|tel:)") | full.rlike(skip), "").otherwise(full)


def page_links(source: Column | str, current: Column) -> Column:
    """Distinct link targets of a page with the text shown for them, in order. ``current`` is the page's title key."""
    inside = all_matches(active_source(source), r"\[\[([^\[\]]+?)\]\]", 1)
    items = F.transform(
        inside,
        lambda x: F.struct(
            resolve_link(F.regexp_extract(x, r"(?s)^([^|]*)", 1), current).alias("title"),
            strip(F.regexp_replace(F.regexp_replace(x, r"(?s)^[^|]*\|", ""), r"\s+", " ")).alias("text"),
        ),
    )
    return first_per(F.filter(items, lambda x: x["title"] != ""), "title")
