"""Lookups and joins (J*). Keys are exploded before joining; no join condition holds an OR."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import title_key
from .filters import is_published
from .ranking import first_by, top_rows


def point_lookup(requests: DataFrame, docs: DataFrame, source: str) -> DataFrame:
    """Published document per requested title, letter case ignored; an exact title wins, then title order."""
    d = docs.where(is_published(source)).select("id", "source_title", F.lower("source_title").alias("_k"))
    hit = requests.withColumn("_k", F.lower("title")).join(d, "_k")
    exact = F.when(F.col("source_title") == F.col("title"), 0).otherwise(1)
    return first_by(hit, ["request_id"], [exact, F.col("source_title"), F.col("id")], ["id", "source_title"])


def pages_with_assets(docs: DataFrame, assets: DataFrame, source: str, limit: int = 500) -> DataFrame:
    """Published documents with their resolved images as a JSON list in reference order, at most ``limit`` per page."""
    resolved = assets.where((F.col("asset_type") == "image") & (F.col("status") == "resolved"))
    item = F.struct("source_ref", "label", "status", "resolved_url", "storage_path")
    top = top_rows(resolved, ["source_document_id"], [F.col("source_ref"), F.col("id")], limit)
    listed = top.groupBy("source_document_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rn", item.alias("item")))), lambda x: x["item"]).alias("items")
    )
    d = docs.where(is_published(source)).select("id", "source_title")
    return d.join(listed, d["id"] == listed["source_document_id"], "left").select(
        "id", "source_title", F.coalesce(F.size("items"), F.lit(0)).alias("n_assets"), F.coalesce(F.to_json("items"), F.lit("[]")).alias("assets")
    )


def orphans(listing: DataFrame, references: DataFrame, path: str = "path", ref: str = "storage_path") -> DataFrame:
    """Stored paths nothing refers to."""
    return listing.join(references.where(F.col(ref).isNotNull()), listing[path] == references[ref], "left_anti")


def verified(references: DataFrame, listing: DataFrame, ref: str = "storage_path", path: str = "path") -> DataFrame:
    """Rows whose stored path exists in the listing."""
    return references.join(listing, references[ref] == listing[path], "left_semi")


def backfill_links(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """Fill the target id of edges whose title exists by now. Titles are unique in the document table."""
    ids = docs.groupBy(F.col("title").alias("to_title")).agg(F.min("id").alias("_id"))
    return edges.join(ids, "to_title", "left").withColumn("to_id", F.coalesce("to_id", "_id")).drop("_id")


def looks_generic(target: Column) -> Column:
    # Dates, broadcasters, platforms and other targets that need no page.
    return (
        target.rlike(r"(?i)^(?:\d{4}년|\d{1,2}월(?:\s*\d{1,2}일)?|SBS|MBC|KBS|JTBC|tvN|엠넷|Mnet|유튜브|YouTube|Instagram|X|트위터|OST|가수|아이돌|대한민국|일본|미국)$")
        | target.rlike(r"(?i)(?:^|/)(?:참가자|\d+회|FINAL)$")
    )


def has_root_affinity(target: Column, root: Column) -> Column:
    wrapped = F.contains(target, F.concat(F.lit("("), root, F.lit(")"))) | F.contains(target, F.concat(F.lit("["), root, F.lit("]")))
    return (target == root) | F.startswith(target, F.concat(root, F.lit("/"))) | wrapped


def target_disposition(links: DataFrame, sources: DataFrame, documents: DataFrame) -> DataFrame:
    """What to do with an internal link: page, pending page, crawl candidate or plain text, with a confidence.

    ``sources(source_title, root_title, document_id)`` are the known titles, ``documents(document_id, slug, status)`` the
    generated pages.
    """
    s = sources.select(F.col("source_title").alias("target"), F.col("root_title").alias("source_root"), "document_id")
    j = links.join(s, "target", "left").join(documents, "document_id", "left")
    ours = F.coalesce(F.col("source_root") == F.col("root_title"), F.lit(False))
    generic, affine = looks_generic(F.col("target")), has_root_affinity(F.col("target"), F.col("root_title"))

    def pick(internal, pending, candidate, plain, other) -> Column:
        return F.when(F.col("slug").isNotNull(), internal).when(ours, pending).when(affine, candidate).when(generic, plain).otherwise(other)

    url = F.when(F.col("status") == "published", F.concat(F.lit("/wiki/"), "slug")).otherwise(F.concat(F.lit("/admin/drafts/"), "slug"))
    return j.select(
        "id",
        "target",
        pick("internal", "internal_pending", "crawl_candidate", "plain_text", "plain_text").alias("disposition"),
        F.coalesce(F.when(F.col("slug").isNotNull(), url), F.lit("")).alias("url"),
        pick(1.0, 0.95, 0.9, 0.98, 0.82).alias("confidence"),
    )


def requirements_with_documents(req: DataFrame, docs: DataFrame) -> DataFrame:
    """Requirements with their document; a missing one becomes a blocker."""
    d = docs.select(F.col("id").alias("source_document_id"), F.lit(True).alias("_found"))
    j = req.join(d, "source_document_id", "left")
    return j.withColumn("blocker", F.when(F.col("_found").isNull(), "missing_source_document").otherwise("")).drop("_found")


def recent_activity(proposals: DataFrame, docs: DataFrame, source: str, limit: int = 30) -> DataFrame:
    """Newest accepted proposals on published documents."""
    live = docs.where(
        (F.col("source") == source) & (F.coalesce("published_revision_no", F.lit(0)) > 0) & F.col("published_html").isNotNull()
    ).select(F.col("id").alias("source_document_id"), "source_title")
    hits = proposals.where(F.col("status") == "accepted").join(live, "source_document_id")
    return hits.orderBy(F.col("created_at").desc(), "id").limit(limit)


def stale_dependencies(renders: DataFrame, refs: DataFrame, changes: DataFrame) -> DataFrame:
    """Renders older than something they depend on.

    ``refs(id, kind, ref_key)`` lists what a render used and ``changes(kind, ref_key, ts)`` when things changed.
    """
    latest = changes.groupBy("kind", "ref_key").agg(F.max("ts").alias("dep_ts"))
    j = refs.distinct().join(latest, ["kind", "ref_key"]).join(renders, "id")
    return j.groupBy("id").agg(
        F.count_if(F.col("dep_ts") > F.col("rendered_at")).alias("newer"), F.max("dep_ts").alias("latest_at")
    )


def hydrate_blocks(blocks: DataFrame, assets: DataFrame) -> DataFrame:
    """Attach assets to section blocks by (type, reference).

    Skipped images disappear, skipped links turn into paragraphs, a resolved image shows once per section, images
    without a usable asset stay as placeholders.
    """
    a = first_by(assets, ["asset_type", "source_ref"], [-F.col("asset_id")], ["status", "storage_path", "resolved_url"])
    kind = F.when(F.col("type") == "internal-link", "internal_link").when(F.col("type") == "external-link", "external_link").otherwise(F.col("type"))
    b = blocks.withColumns({"asset_type": kind, "source_ref": F.col("ref")}).join(a, ["asset_type", "source_ref"], "left")
    stored = F.coalesce("storage_path", "resolved_url")
    shown = (F.col("type") == "image") & (F.col("status") == "resolved") & stored.isNotNull()
    b = b.withColumns({"_shown": F.coalesce(shown, F.lit(False)), "_stored": stored})
    w = Window.partitionBy("doc_id", "section", "_stored").orderBy("pos")
    images = b.where("_shown").withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    rest = b.where(~F.col("_shown") & ~((F.col("type") == "image") & F.coalesce(F.col("status") == "skipped", F.lit(False))))
    out = images.unionByName(rest)
    skipped_link = (F.col("type") == "internal-link") & F.coalesce(F.col("status") == "skipped", F.lit(False))
    outcome = (
        F.when(F.col("_shown"), "resolved")
        .when(F.col("type") == "image", "placeholder")
        .when(skipped_link, "as_text")
        .when(F.coalesce(F.col("status") == "resolved", F.lit(False)) & F.col("resolved_url").isNotNull(), "resolved")
        .otherwise("kept")
    )
    return out.select(
        "doc_id", "section", "pos", F.when(skipped_link, "paragraph").otherwise(F.col("type")).alias("type"), "ref", outcome.alias("outcome")
    )


def recover_unique(cells: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """Fill a blank value only where exactly one candidate target exists for its key."""
    unique = (
        candidates.groupBy(key)
        .agg(F.min("target").alias("_lo"), F.max("target").alias("_hi"))
        .where("_lo = _hi")
        .select(key, F.col("_lo").alias("_target"))
    )
    j = cells.join(unique, key, "left")
    blank = F.coalesce(F.col("value"), F.lit("")) == ""
    return j.withColumns(
        {"recovered": blank & F.col("_target").isNotNull(), "value": F.when(blank, F.coalesce("_target", F.lit(""))).otherwise(F.col("value"))}
    ).drop("_target")


def template_resolution(templates: DataFrame, canonical: DataFrame, fallbacks: DataFrame, builtin: tuple[str, ...], seen: DataFrame) -> DataFrame:
    """How each template can be shown: canonical source, built-in, reviewed or pending fallback, placeholder, missing."""
    fb = fallbacks.groupBy(title_key("template_title").alias("template")).agg(
        F.count("*").alias("fallback_rows"),
        F.count_if((F.col("translation_status") == "reviewed") & (F.length("en_html") > 0)).alias("reviewed_rows"),
        F.count_if(F.length("source_html") > 0).alias("source_rows"),
    )
    c = canonical.select("template", F.lit(True).alias("_canonical")).distinct()
    s = seen.select("template", F.lit(True).alias("_seen")).distinct()
    j = templates.join(c, "template", "left").join(fb, "template", "left").join(s, "template", "left")
    status = (
        F.when(F.col("_canonical"), "canonical_raw")
        .when(F.col("template").isin(*builtin), "compat_builtin")
        .when(F.col("reviewed_rows") > 0, "reviewed_dom_fallback")
        .when(F.col("source_rows") > 0, "dom_fallback_pending")
        .when(F.col("_seen"), "browser_placeholder")
        .otherwise("missing")
    )
    return j.select(
        "template", status.alias("resolution"), F.coalesce("fallback_rows", F.lit(0)).alias("fallback_rows"),
        F.coalesce("reviewed_rows", F.lit(0)).alias("reviewed_rows"),
    )


def compare_keys(original: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """Common, missing and extra keys of two sets."""
    o = original.select(*keys).distinct().withColumn("_o", F.lit(True))
    b = baseline.select(*keys).distinct().withColumn("_b", F.lit(True))
    side = F.when(F.col("_o") & F.col("_b"), "common").when(F.col("_o"), "missing").otherwise("extra")
    return o.join(b, keys, "full_outer").select(*keys, side.alias("side"))


def proposal_conflicts(proposals: DataFrame, docs: DataFrame) -> DataFrame:
    """Whether a proposal still applies: base revision equals the current one."""
    d = docs.select(F.col("id").alias("source_document_id"), "content_revision_no")
    j = proposals.join(d, "source_document_id", "left")
    state = (
        F.when(F.col("content_revision_no").isNull(), "missing_document")
        .when(F.col("content_revision_no") == F.col("base_revision_no"), "ok")
        .otherwise("conflict")
    )
    return j.select("id", "source_document_id", state.alias("state"))
