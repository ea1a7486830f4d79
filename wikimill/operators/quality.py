"""Data-quality gates and rule engines (V*, M4, M5). Rules are columns; blockers are arrays inside the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.html import all_matches, chunks, cut, match_spans, visible_html, visible_text
from ..functions.arrays import rows_of
from ..functions.keys import as_col, clean_spaces, let, nfkc, strip, title_key
from ..functions.markup import count

HANGUL = "[가-힣]"
# Job and run states.
JOB_STATUS = ("queued", "running", "pass", "retry", "needs_review", "failed", "skipped")
READY_TRANSLATIONS = ("translated_by_chatgpt", "reviewed")


def blocker_array(*rules: Column) -> Column:
    return F.array_compact(F.array(*rules))


def text_present(c: Column | str) -> Column:
    """Whether a text has more than blanks; read as far as its first other character."""
    return F.coalesce(as_col(c).rlike(r"\S"), F.lit(False))


def meta_count(meta: str, count_key: str | None, array_key: str) -> Column:
    """A positive number under ``count_key``, else the length of the list under ``array_key``, else 0."""
    listed = F.coalesce(F.json_array_length(F.get_json_object(meta, f"$.{array_key}")), F.lit(0))
    if count_key is None:
        return listed
    number = F.get_json_object(meta, f"$.{count_key}").try_cast("int")
    return F.when(number > 0, number).otherwise(listed)


# --- V1 -------------------------------------------------------------------------------------------------------------


def enum_violations(df: DataFrame, rules: dict[str, tuple[str, ...]], key: str) -> DataFrame:
    """Rows whose value is not allowed, one row per violated column."""
    bad = blocker_array(*[F.when(~F.coalesce(F.col(c).isin(*v), F.lit(False)), F.lit(c)) for c, v in rules.items()])
    return rows_of(df, [key], bad, "column")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


# --- V2, V3 ---------------------------------------------------------------------------------------------------------


def heading_levels(text: Column) -> Column:
    level = lambda x: F.length(F.regexp_extract(x, r"^\s*(={1,6})\s*.*?\s*\1\s*$", 1))
    return F.filter(F.transform(F.split(text, r"\r?\n", -1), level), lambda n: n > 0)


def structure_errors(before: Column | str, after: Column | str) -> Column:
    """What a translation must keep: ordered link targets, addresses, includes, video ids, heading levels, delimiters."""
    a, b = as_col(before), as_col(after)
    lists = {
        "links": lambda t: F.filter(
            F.transform(all_matches(t, r"\[\[([^\]\n]+?)\]\]", 1), lambda x: strip(F.regexp_extract(x, r"^([^|]*)", 1))), lambda x: x != ""
        ),
        "urls": lambda t: all_matches(t, r"""https?://[^\s\]}|<>"]+"""),
        "includes": lambda t: F.transform(all_matches(t, r"(?i)\[include\(\s*([^,\)\n]+)", 1), strip),
        "youtube": lambda t: all_matches(t, r"(?i)\[(?:youtube|youtu\.be)\(\s*([A-Za-z0-9_-]{6,})", 1),
        "headings": heading_levels,
    }
    counts = {"tableDelimiters": r"\|\|", "tripleOpen": r"\{\{\{", "tripleClose": r"\}\}\}", "footnoteOpen": r"\[\*"}
    rules = []
    for name, fn in lists.items():
        x, y = fn(a), fn(b)
        rules.append(F.when(~x.eqNullSafe(y), F.concat(F.lit(f"{name}_changed:"), F.size(x).cast("string"), F.lit("->"), F.size(y).cast("string"))))
    for name, p in counts.items():
        x, y = count(a, p), count(b, p)
        rules.append(F.when(x != y, F.concat(F.lit(f"{name}_changed:"), x.cast("string"), F.lit("->"), y.cast("string"))))
    return blocker_array(*rules)


def lossy_splits(docs: DataFrame, key: str, source: str, parts: Column) -> DataFrame:
    """Documents whose parts (an array of texts) do not add up to their source. Compared inside the row."""
    return docs.where(~F.array_join(parts, "").eqNullSafe(F.col(source))).select(key)


# --- V4, V5 ---------------------------------------------------------------------------------------------------------

# Visible markup, and what keeps a page from its release.
LEAK_PATTERNS = {
    "directive": r"(?i)#!(?:wiki|if|folding)\b",
    "include": r"(?i)\[include\(",
    "file-link": r"(?i)\[\[(?:파일|File):",
    "youtube-macro": r"(?i)\[youtube\(",
    "table-param": r"(?i)<(?:table)?(?:align|width|height|bordercolor|bgcolor|color|class)\s*=\s*[^>]*>",
    "cell-param": r"(?i)<(?:col|row)?(?:bgcolor|color|class|keepall|nopad|width|height)\b[^>]*>",
    "bare-color-param": r"(?i)<\s*#[0-9a-f]{3,8}\s*(?:,\s*#[0-9a-f]{3,8}\s*)?>",
    "table-span-param": r"<(?:-\d+|(?:\^|v)?\|\d+|[:()])>",
}
GATE_PATTERNS = {
    "raw-link": r"\[\[[^\]]+\]\]",
    "include": r"(?i)\[include\s*\(",
    "wiki-directive": r"(?i)\{\{\{#!(?:wiki|folding|if)",
    "raw-table": r"(?m)(?:^|[>\n])\|\|[^<\n]+\|\|",
}


def passages(text: Column, spans: Column, before: int, after: int) -> Column:
    """Distinct passages around matches of a text, blanks tidied."""

    def around(pieces: Column) -> Column:
        def one(x: Column) -> Column:
            lo = F.greatest(F.lit(1), x["start"] - before)
            return strip(F.regexp_replace(cut(pieces, lo, x["start"] - lo + F.length(x["raw"]) + after), r"\s+", " "))

        return F.array_distinct(F.transform(spans, one))

    return let(chunks(text), around)


def syntax_leaks(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Visible markup per page and kind, with its number and its passages."""
    d = pages.select(key, visible_text(html).alias("_t"))
    t = F.col("_t")

    def leak(kind: str, pattern: str) -> Column:
        about = lambda s: F.struct(F.lit(kind).alias("kind"), F.size(s).alias("n"), passages(t, s, 45, 75).alias("samples"))
        return F.when(t.rlike(pattern), let(match_spans(t, pattern), about))

    found = F.array_compact(F.array(*[leak(kind, p) for kind, p in LEAK_PATTERNS.items()]))
    return rows_of(d, [key], found, "x").select(key, "x.kind", "x.n", "x.samples")


def leak_names(html: Column | str) -> Column:
    """Names of the four gate patterns a page breaks, joined by ``+``."""
    return F.array_join(F.array_compact(F.array(*[F.when(as_col(html).rlike(p), F.lit(n)) for n, p in GATE_PATTERNS.items()])), "+")


def untranslated_links(html: Column | str) -> Column:
    """Distinct (address, text) pairs of links whose text has Hangul."""
    anchors = all_matches(visible_html(html), r"(?i)<a\b[^>]*\shref=[^>]*>[\s\S]*?</a>")
    pairs = F.transform(
        anchors,
        lambda a: F.struct(
            F.regexp_extract(a, r"""(?i)\shref=["']([^"']*)["']""", 1).alias("href"), strip(F.regexp_replace(visible_text(a), r"\s+", " ")).alias("visible")
        ),
    )
    hits = F.array_distinct(F.filter(pairs, lambda p: p["visible"].rlike(HANGUL)))
    return F.when(as_col(html).rlike(HANGUL), hits).otherwise(F.array().cast("array<struct<href:string,visible:string>>"))


def untranslated_text(html: Column | str) -> Column:
    """Distinct passages around Hangul in the visible text, up to 56 characters on both sides."""
    bare = F.regexp_replace(as_col(html), r"(?i)<(picture|svg|video|audio|canvas)\b[\s\S]*?</\1\s*>", "")
    tidy = F.regexp_replace(clean_spaces(nfkc(visible_text(bare))), r"[ \t]+", " ")
    found = let(tidy, lambda t: passages(t, match_spans(t, "[가-힣]+"), 56, 56))
    return F.when(as_col(html).rlike(HANGUL), found).otherwise(F.array().cast("array<string>"))


# --- V6, V7 ---------------------------------------------------------------------------------------------------------


def _counted(prefix: str, n: Column) -> Column:
    return let(n, lambda v: F.when(v > 0, F.concat(F.lit(prefix + ":"), v.cast("string"))))


def source_blockers(version: str, patchset: str) -> Column:
    raw, meta = text_present("source_wikitext"), F.col("source_meta")
    v = F.coalesce(F.get_json_object(meta, "$.compatibility.version"), F.lit(""))
    p = F.coalesce(F.get_json_object(meta, "$.compatibility.enginePatchset"), F.get_json_object(meta, "$.enginePatchset"), F.lit(""))
    named = lambda x: F.when(x == "", "none").otherwise(x)
    has = raw & meta.isNotNull()
    return F.when(~raw, F.array(F.lit("missing_canonical_raw"))).otherwise(
        blocker_array(
            F.when(F.col("source_rendered_at").isNull(), "missing_source_render"),
            F.when(meta.isNull(), "missing_source_render_meta"),
            F.when(has & (F.get_json_object(meta, "$.hasError") == "true"), "source_render_error"),
            F.when(has & (v != version), F.concat(F.lit("source_stale_compat:"), named(v))),
            F.when(has & (p != patchset), F.concat(F.lit("source_stale_patchset:"), named(p))),
            F.when(has, _counted("source_missing_files", meta_count("source_meta", "missingFileCount", "missingFiles"))),
            F.when(has, _counted("source_missing_templates", meta_count("source_meta", "missingTemplateCount", "missingTemplates"))),
            F.when(has, _counted("source_missing_youtube", meta_count("source_meta", "missingYouTubeCount", "missingYouTubeEmbeds"))),
        )
    )


def title_blocker() -> Column:
    t = title_key(F.coalesce("translated_title", F.lit("")))
    return F.when(t == "", "missing_translated_title").when(t.rlike(HANGUL), "translated_title_contains_hangul")


def translation_blockers() -> Column:
    status = F.coalesce("translation_status", F.lit("null"))
    stale = (F.coalesce("source_hash", F.lit("")) != "") & (F.coalesce("translation_source_hash", F.lit("")) != "") & (F.col("source_hash") != F.col("translation_source_hash"))
    return blocker_array(
        F.when(~(F.col("content_language").eqNullSafe("en") & text_present("content_wikitext")), "missing_english_revision"),
        F.when(~status.isin(*READY_TRANSLATIONS), F.concat(F.lit("translation_status:"), status)),
        F.when(F.coalesce("content_revision_no", F.lit(0)) <= 0, "missing_content_revision"),
        F.when(~F.col("is_template"), title_blocker()),
        F.when(stale, "translation_stale_source_hash"),
    )


def _render_meta_blockers(missing_meta: str) -> list[Column]:
    meta, rev = F.col("content_meta"), F.coalesce("content_revision_no", F.lit(0))
    rendered = F.coalesce(F.get_json_object(meta, "$.editableContent.revisionNo").try_cast("int"), F.lit(0))
    has = meta.isNotNull()
    stale = F.concat(F.lit("stale_current_render:r"), rendered.cast("string"), F.lit("->r"), rev.cast("string"))
    return [
        F.when(~has, missing_meta),
        F.when(has & (rendered == 0), "missing_render_revision").when(has & (rendered != rev), stale),
        F.when(has & (F.get_json_object(meta, "$.hasError") == "true"), "render_error"),
        F.when(has, _counted("missing_files", meta_count("content_meta", "missingFileCount", "missingFiles"))),
        F.when(has, _counted("missing_templates", meta_count("content_meta", "missingTemplateCount", "missingTemplates"))),
        F.when(has, _counted("missing_youtube", meta_count("content_meta", "missingYouTubeCount", "missingYouTubeEmbeds"))),
    ]


def _visible_blockers(html: Column, leak: str) -> list[Column]:
    links = F.size(untranslated_links(html))
    texts = F.size(untranslated_text(html))
    hangul = html.rlike(HANGUL)
    return [
        let(leak_names(html), lambda names: F.when(names != "", F.concat(F.lit(leak + ":"), names))),
        F.when(hangul, _counted("visible_korean_links", links)),
        F.when(hangul, _counted("visible_korean_text", texts)),
    ]


def english_render_blockers() -> Column:
    html = F.coalesce("content_html", F.lit(""))
    return blocker_array(
        F.when(F.length(html) < 100, "missing_current_render"),
        F.when(F.col("content_rendered_at").isNull(), "missing_current_render_timestamp"),
        *_render_meta_blockers("missing_current_render_meta"),
        *_visible_blockers(html, "syntax_leak"),
    )


def publish_blockers() -> Column:
    rev, pub = F.coalesce("content_revision_no", F.lit(0)), F.coalesce("published_revision_no", F.lit(0))
    stale = F.concat(F.lit("stale_publish:r"), pub.cast("string"), F.lit("->r"), rev.cast("string"))
    return blocker_array(
        F.when(pub == 0, "not_published").when(pub != rev, stale),
        F.when(~F.col("published_language").eqNullSafe("en"), "published_language_not_en"),
        F.when(~text_present("published_html"), "missing_published_html"),
    )


def readiness(docs: DataFrame, version: str, patchset: str) -> DataFrame:
    """First failing stage of each document, what to do next and why."""
    d = docs.select(
        "id", "root_title", "is_template", "fallback_ready", text_present("source_wikitext").alias("has_raw"),
        source_blockers(version, patchset).alias("b_source"), translation_blockers().alias("b_translation"),
        english_render_blockers().alias("b_render"), publish_blockers().alias("b_publish"),
    )
    fails = lambda c: F.size(c) > 0
    cases = (
        (~F.col("has_raw") & F.col("is_template") & F.col("fallback_ready"), "SOURCE_RENDER", "recover_template_from_captured_dom", F.array(F.lit("captured_dom_fallback_recovery"))),
        (~F.col("has_raw"), "RAW", "capture_raw", F.array(F.lit("missing_canonical_raw"))),
        (fails("b_source"), "SOURCE_RENDER", "repair_or_render_source", F.col("b_source")),
        (fails("b_translation"), "TRANSLATION", "translate_or_repair_translation", F.col("b_translation")),
        (fails("b_render"), "EN_RENDER", "render_or_repair_english", F.col("b_render")),
        (~F.col("is_template") & fails("b_publish"), "PUBLISH", "publish", F.col("b_publish")),
    )
    out = F.struct(F.when(F.col("is_template"), "COMPLETE_DEPENDENCY").otherwise("COMPLETE").alias("stage"), F.lit("none").alias("next_action"), F.array().cast("array<string>").alias("blockers"))
    for cond, stage, action, why in reversed(cases):
        out = F.when(cond, F.struct(F.lit(stage).alias("stage"), F.lit(action).alias("next_action"), why.alias("blockers"))).otherwise(out)
    d = d.select("id", "root_title", out.alias("r")).select("id", "root_title", "r.*")
    return d.withColumn("status", F.when(F.col("stage").startswith("COMPLETE"), "PASS").otherwise("WAIT"))


def integration_qa(docs: DataFrame, version: str, patchset: str, prepublish: bool, links: DataFrame | None = None) -> DataFrame:
    """Release check per document: blockers and warnings. ``links(id, unpublished_core, outside_core)`` adds link rules.

    Before publication, what publication itself will fix is only a warning.
    """
    html = F.coalesce("content_html", F.lit(""))
    shown = text_present("content_html")
    published = (F.coalesce("published_revision_no", F.lit(0)) > 0) & text_present("published_html")
    # the source rules, without the error flag that only the readiness check looks at
    src = F.filter(source_blockers(version, patchset), lambda b: b != "source_render_error")
    before = F.concat(
        src,
        blocker_array(
            F.when(~(F.col("content_language").eqNullSafe("en") & text_present("content_wikitext")), "missing_english_revision"),
            F.when(F.col("translation_status").eqNullSafe("failed"), "translation_failed"),
            F.when(~shown, "missing_current_render"),
            F.when(F.col("content_rendered_at").isNull(), "missing_current_render_timestamp"),
        ),
    )
    after = blocker_array(
        *[F.when(shown, b) for b in _render_meta_blockers("missing_render_meta")],
        *[F.when(shown, b) for b in _visible_blockers(html, "current_syntax_leak")],
        F.lit(None).cast("string") if prepublish else F.when(~published, "not_published"),
        title_blocker(),
    )
    # the texts are judged first; only flags and short arrays meet the link counts
    d = docs.select("id", "root_title", shown.alias("_shown"), published.alias("published"), before.alias("_before"), after.alias("_after"))
    if links is not None:
        d = d.join(links.select("id", "unpublished_core", "outside_core"), "id", "left").na.fill(0, ["unpublished_core", "outside_core"])
    else:
        d = d.withColumns({"unpublished_core": F.lit(0), "outside_core": F.lit(0)})
    pending, outside = F.col("unpublished_core"), F.col("outside_core")
    unpublished = F.array().cast("array<string>") if prepublish else blocker_array(F.when(F.col("_shown"), _counted("core_links_unpublished", pending)))
    warnings = blocker_array(
        F.when(F.col("_shown"), _counted("core_links_pending_publish", pending)) if prepublish else F.lit(None).cast("string"),
        F.when(F.col("_shown"), _counted("outside_core_links", outside)),
        F.when(~F.col("published"), "pending_publish") if prepublish else F.lit(None).cast("string"),
    )
    d = d.select("id", "root_title", "published", F.concat("_before", unpublished, "_after").alias("blockers"), warnings.alias("warnings"))
    return d.withColumn("readiness", F.when(F.size("blockers") == 0, "PASS").otherwise("BLOCKED"))


def published_blockers(expected_revision: Column) -> Column:
    """What is wrong with a document right after publication."""
    pub = F.coalesce("published_revision_no", F.lit(0))
    mismatch = F.concat(F.lit("published_revision_mismatch:r"), pub.cast("string"), F.lit("->r"), expected_revision.cast("string"))
    return blocker_array(
        F.when(~F.col("content_language").eqNullSafe("en"), "content_language_not_en"),
        F.when(F.coalesce("content_wikitext", F.lit("")) == "", "missing_content_wikitext"),
        F.when(F.coalesce("content_html", F.lit("")) == "", "missing_content_render"),
        F.when(pub != expected_revision, mismatch),
        F.when(~F.col("published_language").eqNullSafe("en"), "published_language_not_en"),
        F.when(F.coalesce("published_html", F.lit("")) == "", "missing_published_html"),
    )


def preflight(docs: DataFrame) -> DataFrame:
    """Blockers of a draft before its root may be released: translation rules and the state of its render."""
    own = F.filter(translation_blockers(), lambda b: b != "translation_stale_source_hash")
    return docs.select("id", "root_title", F.concat(own, english_render_blockers()).alias("blockers"))


def release_gate(results: DataFrame) -> DataFrame:
    """A root is released only when every one of its documents passes."""
    roots = results.groupBy("root_title").agg(F.count("*").alias("docs"), F.count_if(F.size("blockers") > 0).alias("failing"))
    return roots.withColumn("publish", F.col("failing") == 0)


def publishable(results: DataFrame) -> DataFrame:
    """Documents of the roots that may be released."""
    return results.join(release_gate(results).where("publish").select("root_title"), "root_title", "left_semi")


# Which stage has to run again for a blocker.
ROUTES = (
    ("source_render", r"^(?:missing_canonical_raw|missing_source_render|missing_source_meta|source_render_error|source_compat_not_current|source_patchset_not_current|source_missing_(?:files|templates|youtube):|missing_(?:files|templates|youtube):)"),
    ("translation", r"^(?:missing_english_revision|missing_translated_title|translated_title_contains_hangul|published_visible_korean_|published_syntax_leak:|public_syntax_leak:)"),
    ("en_render", r"^(?:missing_english_render|stale_english_render:|english_render_error)"),
    ("publish", r"^(?:published_revision_mismatch:|missing_english_publish_snapshot|public_placeholder|http_status:)"),
)


def route_blockers(blockers: Column) -> Column:
    """First stage that can remove a blocker; empty when none can."""

    def hit(pattern: str) -> Column:
        return F.exists(blockers, lambda b: b.rlike(pattern))

    out = F.lit("")
    for stage, pattern in reversed(ROUTES):
        out = F.when(hit(pattern), stage).otherwise(out)
    return out


# --- V10, M4, M5 ----------------------------------------------------------------------------------------------------

# The rendered feature that a source feature turns into.
LOSS_PAIRS = {
    "folding": ("folding", "details"), "footnotes": ("footnote", "footnotes"), "youtube": ("youtube", "youtube"), "colspan": ("colspan", "colspan"),
    "rowspan": ("rowspan", "rowspan"), "headings": ("headings", "headings"), "toc": ("toc", "toc"), "links": ("links", "links"),
}


def structural_loss(source: dict[str, Column], rendered: dict[str, Column]) -> dict[str, Column]:
    """How many elements of each kind the render lost."""
    loss = {n: F.greatest(F.lit(0), source[s] - rendered[r]) for n, (s, r) in LOSS_PAIRS.items()}
    loss["images"] = F.greatest(F.lit(0), source["file_refs"] - rendered["images"] - rendered["svg"])
    return loss


def render_status(docs: DataFrame) -> DataFrame:
    """Status of a render by precedence. Needs the columns named here; ``is_content`` tells drafts from sources."""
    failed = F.col("run_failed") | F.col("has_error") | (F.col("leaks") > 0) | (F.col("missing_youtube") > 0) | (F.col("loss") > 0)
    shown = F.col("html_chars") > 0
    return docs.withColumn(
        "status",
        F.when(~F.col("input_ready") & F.col("is_content"), "TRANSLATION_PENDING")
        .when(~F.col("input_ready"), "NO_SOURCE")
        .when(~shown, "UNRENDERED")
        .when(F.col("rendered_revision") != F.col("current_revision"), "STALE_REVISION")
        .when(F.col("engine") != F.col("expected_engine"), "STALE_ENGINE")
        .when(F.col("newer_dependencies") > 0, "STALE_DEPENDENCY")
        .when(failed, "ENGINE_FAIL")
        .when((F.col("missing_templates") > 0) | (F.col("missing_files") > 0), "DEPENDENCY")
        .otherwise("OK"),
    )


def promotion(pairs: DataFrame, key: str) -> DataFrame:
    """Whether a converted fragment may replace its source.

    Needs ``html``, ``markup``, ``score`` and the five structure counts of both sides (``d_*`` and ``g_*``).
    """
    html = F.col("html")
    hash_links = count(html, r"""(?i)href=["']#(?:["']|[^"']*["'])""")
    flex = count(html, r"(?i)display\s*:\s*(?:flex|grid|inline-flex|inline-grid)\b")
    hidden = count(html, r"(?i)display\s*:\s*none\b")
    interactive = (hash_links >= 2) | (hidden > 0) | ((hash_links > 0) & (flex > 0))
    loss = F.lit(False)
    for n in ("tables", "rows", "cells", "links", "images"):
        loss = loss | (F.col(f"d_{n}") != F.col(f"g_{n}"))
    trivial = (F.length(html) >= 200) & (F.length(strip("markup")) < 8)
    reasons = blocker_array(F.when(F.col("score") < 0.9, "low_score"), F.when(interactive, "interactive_layout"), F.when(loss, "structural_loss"), F.when(trivial, "trivial"))
    return pairs.select(key, (F.size(reasons) == 0).alias("eligible"), F.array_join(reasons, ";").alias("reasons"))


# --- V11 - V18 ------------------------------------------------------------------------------------------------------


def stale_renders(docs: DataFrame, version: str) -> DataFrame:
    """Sources to render again: no render, an older one, or one by another version."""
    older = F.col("source_rendered_at").isNull() | F.coalesce(F.col("source_rendered_at") < F.col("raw_extracted_at"), F.lit(False))
    outdated = F.coalesce(F.get_json_object("source_meta", "$.compatibility.version"), F.lit("")) != version
    d = docs.where(F.col("source_wikitext").isNotNull() & ~F.col("is_template") & F.coalesce(F.col("translation_status").isin("pending_chatgpt", "failed", *READY_TRANSLATIONS), F.lit(False)))
    return d.where(older | outdated).select("id", older.alias("by_time"), outdated.alias("by_version"))


def stale_drafts(docs: DataFrame) -> DataFrame:
    """Drafts to render again: another revision than rendered, or a newer source render."""
    rendered = F.coalesce(F.get_json_object("content_meta", "$.editableContent.revisionNo").try_cast("int"), F.lit(0))
    ready = F.col("translation_status").isin(*READY_TRANSLATIONS) & F.col("content_language").eqNullSafe("en") & F.col("content_wikitext").isNotNull() & (F.col("content_revision_no") > 0)
    newer = F.col("source_rendered_at").isNotNull() & (F.col("content_rendered_at").isNull() | (F.col("content_rendered_at") < F.col("source_rendered_at")))
    return docs.where(F.coalesce(ready, F.lit(False)) & ((rendered != F.col("content_revision_no")) | newer)).select("id")


def requirement_status(docs: DataFrame, prior: DataFrame) -> DataFrame:
    """Requirement of each document; one that was ignored by hand stays ignored until its source is captured.

    ``docs(id, relation, scope_depth, canonical, dom_captured)`` (relation null outside the scope), ``prior(id, status,
    manual)``.
    """
    p = prior.where((F.col("status") == "ignored") & F.col("manual")).select("id", F.lit(True).alias("_manual")).distinct()
    d = docs.join(p, "id", "left")
    depth, rel = F.coalesce("scope_depth", F.lit(0)), F.col("relation")
    outside, captured = rel.isNull(), F.col("canonical")
    manual = F.coalesce("_manual", F.lit(False)) & ~(captured & ~outside)
    priority = (
        F.when(rel == "root", 100)
        .when(rel == "toc_document", F.greatest(F.lit(80), 95 - depth))
        .when(rel == "member", F.greatest(F.lit(78), 90 - depth))
        .when(rel == "template_dependency", F.greatest(F.lit(65), 76 - depth))
        .otherwise(80)
    )
    open_ = ~outside & ~captured
    reasons = F.when(manual, "manual_ignore").when(outside, "outside_team_core_scope").when(captured, "canonical_raw_present")
    reasons = reasons.when(F.col("dom_captured"), "canonical_raw_missing").otherwise("canonical_raw_missing,browser_dom_missing")
    return d.select(
        "id",
        F.when(manual | outside, "ignored").when(captured, "captured").otherwise("needs_raw").alias("status"),
        F.when(open_, priority).otherwise(0).alias("priority"),
        F.when(open_, 100).otherwise(0).alias("score"),
        reasons.alias("reasons"),
    )


def overlapping_patches(patches: DataFrame, key: str = "doc_id", width: int = 4096) -> DataFrame:
    """Patches that start before an earlier patch of the same document ends.

    The running maximum is taken per stretch of ``width`` characters and joined with the maximum of the stretches before,
    so a document with very many patches is spread over tasks.
    """
    d = patches.withColumn("_b", F.floor(F.col("start_pos") / width))
    order = ["start_pos", "end_pos", "patch_id"]
    local = F.max("end_pos").over(Window.partitionBy(key, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    tops = d.groupBy(key, "_b").agg(F.max("end_pos").alias("_top"))
    before = tops.select(key, "_b", F.max("_top").over(Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"))
    d = d.withColumn("_local", local).join(before, [key, "_b"])
    return d.where(F.col("start_pos") < F.greatest("_local", "_earlier")).drop("_b", "_local", "_earlier")


def apply_patches(docs: DataFrame, patches: DataFrame) -> DataFrame:
    """Documents with their patches applied from the end to the start.

    ``docs(doc_id, text)``, ``patches(doc_id, start_pos, end_pos, before, after)`` with 0-based ranges. A document whose
    text differs from ``before`` anywhere, or whose patches overlap, stays as it is and is marked. The patches of one
    document are one array, as the document itself is one value.
    """
    listed = patches.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_pos", "end_pos", "before", "after"))).alias("p"))
    d = docs.join(listed, "doc_id")
    d = d.withColumn("_c", chunks(F.col("text")))
    same = F.forall("p", lambda x: cut(F.col("_c"), x["start_pos"] + 1, x["end_pos"] - x["start_pos"]) == x["before"])
    indexed = F.transform("p", lambda x, i: (i == 0) | (x["start_pos"] >= F.get(F.col("p"), i - 1)["end_pos"]))
    apart = F.forall(indexed, lambda ok: ok)
    # cut once between the patches, joined once
    kept = lambda x, i: cut(F.col("_c"), F.coalesce(F.get("p", i - 1)["end_pos"], F.lit(0)) + 1, x["start_pos"] - F.coalesce(F.get("p", i - 1)["end_pos"], F.lit(0)))
    last = F.element_at("p", -1)["end_pos"]
    replaced = F.concat(F.array_join(F.transform("p", lambda x, i: F.concat(kept(x, i), x["after"])), ""), cut(F.col("_c"), last + 1, F.length("text") - last))
    state = F.when(~apart, "overlap").when(~same, "conflict").otherwise("applied")
    return d.select("doc_id", state.alias("state"), F.when(apart & same, replaced).otherwise(F.col("text")).alias("text"))


def to_process(docs: DataFrame, version: str, force: bool = False) -> DataFrame:
    """Rows that the current parser version has not seen."""
    if force:
        return docs
    return docs.where(~F.coalesce((F.col("parse_version") == version) & F.col("parsed_at").isNotNull(), F.lit(False)))


def reusable_translations(rows: DataFrame) -> DataFrame:
    """After a content change a translation stays only when every new Hangul text is in the old map.

    ``rows(id, nodes array<string>, translated map<string,string>)``.
    """
    hangul = F.filter("nodes", lambda n: n.rlike("[가-힣ㄱ-ㅎㅏ-ㅣ]"))
    missing = F.array_except(hangul, F.map_keys(F.coalesce("translated", F.create_map().cast("map<string,string>"))))
    return rows.select("id", (F.size(missing) == 0).alias("keep"), F.size(missing).alias("untranslated"))


def dependency_gate(jobs: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Whether a render job may start: ready, blocked (a dependency ended badly) or waiting.

    ``jobs(id, root_title)``, ``dependencies(root_title, ready, terminal)``.
    """
    roots = dependencies.groupBy("root_title").agg(F.min(F.col("ready").cast("int")).alias("_ready"), F.max(F.col("terminal").cast("int")).alias("_terminal"))
    j = jobs.join(roots, "root_title", "left")
    state = F.when(F.coalesce("_ready", F.lit(1)) == 1, "ready").when(F.col("_terminal") == 1, "blocked").otherwise("waiting")
    return j.select("id", "root_title", state.alias("state"))

