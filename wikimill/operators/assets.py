"""Resolution of file references against stored media."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import (
    asset_base_key,
    asset_key,
    asset_key_noquery,
    asset_name,
    compact_signature,
    cover_title,
    file_ref,
    storage_prefix,
    token_signature,
)
from ..functions.urls import SITE, Site, is_non_payload, path, percent_decode
from .aggregates import distinct_values, poisoned_paths
from .ranking import first_by

ANONYMOUS = r"(?i)^__anonymous__"


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def stored_path(marker: str) -> Column:
    """Storage path of a queue row, else the part of its resolved address after the bucket marker."""
    p = path("resolved_url")
    from_url = F.when(F.contains(p, F.lit(marker)), percent_decode(F.substring_index(p, marker, -1)))
    return F.nullif(F.coalesce(F.nullif(F.trim("storage_path"), F.lit("")), from_url, F.lit("")), F.lit(""))


def available_paths(queue: DataFrame, staging: DataFrame, marker: str = "/public/") -> DataFrame:
    """Stored paths per normalized file key, from resolved queue rows (by any of their names) and staged captures."""
    names = [c for c in ("source_ref", "label", "filename") if c in queue.columns]
    keyed = queue.withColumns({f"_k{i}": asset_key(n) for i, n in enumerate(names)})
    q = (
        keyed.where(F.col("status") == "resolved")
        .select(F.explode(distinct_values(*[F.col(f"_k{i}") for i in range(len(names))])).alias("key"), stored_path(marker).alias("stored"))
        .where(F.col("stored").isNotNull())
    )
    s = staging.where(F.col("storage_path").isNotNull() & ~F.coalesce("file_name", F.lit("")).rlike(ANONYMOUS))
    s = s.select(asset_key(F.coalesce(F.nullif("canonical_key", F.lit("")), "file_name")).alias("key"), F.col("storage_path").alias("stored"))
    return q.unionByName(s).where("key <> ''").distinct()


def required_keys(required: DataFrame) -> DataFrame:
    """Distinct file keys per document, with one spelling of the name."""
    r = required.select("doc_id", asset_name("file_name").alias("name")).withColumn("key", F.lower("name"))
    return r.where("key <> ''").groupBy("doc_id", "key").agg(F.min("name").alias("name"))


def match_required(required: DataFrame, available: DataFrame) -> DataFrame:
    """Every required file of every document with the number of stored paths it has."""
    paths = available.groupBy("key").agg(F.count("*").alias("n_paths"), F.min("stored").alias("stored"))
    return required_keys(required).join(paths, "key", "left").na.fill(0, ["n_paths"])


def audit_documents(matched: DataFrame) -> DataFrame:
    return matched.groupBy("doc_id").agg(
        F.count("*").alias("required"), F.count_if(F.col("n_paths") > 0).alias("available"), F.count_if(F.col("n_paths") == 0).alias("missing")
    )


def audit_missing(matched: DataFrame, queue: DataFrame) -> DataFrame:
    """Missing files with the number of documents that need them and of queue rows that already name them."""
    keyed = queue.withColumns({"_a": asset_key("source_ref"), "_b": asset_key("label")})
    rows = keyed.select("id", F.explode(distinct_values(F.col("_a"), F.col("_b"))).alias("key")).groupBy("key").agg(F.count("*").alias("queue_rows"))
    missing = matched.where("n_paths = 0").groupBy("key").agg(F.min("name").alias("name"), F.count("*").alias("owners"), F.min("doc_id").alias("first_owner"))
    return missing.join(rows, "key", "left").na.fill(0, ["queue_rows"])


def audit_duplicates(matched: DataFrame) -> DataFrame:
    return matched.where("n_paths > 1").groupBy("key").agg(F.first("n_paths").alias("n_paths"))


def render_needs(docs: DataFrame) -> DataFrame:
    """Files the current renders miss: the union of both lists, each counted only when its render exists."""
    empty = F.array().cast("array<string>")
    src = F.when(F.col("source_ready"), F.coalesce("source_missing", empty)).otherwise(empty)
    own = F.when(F.col("content_ready"), F.coalesce("content_missing", empty)).otherwise(empty)
    return docs.select(F.col("id").alias("doc_id"), F.explode(F.array_union(src, own)).alias("file_name"))


def render_audit(docs: DataFrame, queue: DataFrame, staging: DataFrame, listing: DataFrame) -> DataFrame:
    """Per missing file: reusable when a stored copy still exists, otherwise to be captured."""
    stored = available_paths(queue, staging).join(listing.select(F.col("path").alias("stored")), "stored", "left_semi")
    matched = match_required(render_needs(docs), stored)
    return matched.groupBy("key").agg(F.count("*").alias("owners"), F.max("n_paths").alias("n_paths")).withColumn(
        "state", F.when(F.col("n_paths") > 0, "reusable").otherwise("capture_required")
    )


# --- alias resolution -----------------------------------------------------------------------------------------------


def _signatures(c: Column) -> list[Column]:
    """The four levels of a file name, strongest first."""
    return [c, file_ref(c), F.lower(file_ref(c)), token_signature(c), compact_signature(c)]


def _levels(df: DataFrame, keep: list[str], name: str) -> DataFrame:
    sigs = df.select(*keep, *[s.alias(f"_s{i}") for i, s in enumerate(_signatures(F.col(name)))])
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.col(f"_s{i}").alias("sig")) for i in range(5)])).alias("x")
    return sigs.select(*keep, each).select(*keep, "x.level", "x.sig").where("sig <> ''")


def resolve_aliases(refs: DataFrame, assets: DataFrame, scope: str) -> DataFrame:
    """Address per reference, or none when its strongest matching level is ambiguous.

    ``refs(ref_id, scope, ref)``, ``assets(scope, key, url)``. Levels: the key as written, without namespace, without
    letter case, by sorted tokens, by letters and digits. A weaker level never decides over a collision above it.
    """
    usable = assets.where("coalesce(key, '') <> '' AND coalesce(url, '') <> ''")
    # exact levels match only keys as written; weaker ones match the normalized key
    a = _levels(usable.withColumn("_raw", F.col("key")), [scope, "_raw", "url"], "key")
    a = a.withColumn("sig", F.when(F.col("level") <= 1, F.col("_raw")).otherwise(F.col("sig")))
    index = a.groupBy(scope, "level", "sig").agg(F.min("url").alias("lo"), F.max("url").alias("hi"))
    hits = _levels(refs, ["ref_id", scope], "ref").join(index, [scope, "level", "sig"])
    best = hits.groupBy("ref_id").agg(F.min_by(F.struct("level", "lo", "hi"), "level").alias("b"))
    return best.select("ref_id", F.col("b.level").alias("level"), F.when(F.col("b.lo") == F.col("b.hi"), F.col("b.lo")).alias("url"))


def match_stored_media(refs: DataFrame, media: DataFrame) -> DataFrame:
    """Stored media per file: the only exact caption or alt text, else the only album cover with the same title.

    ``refs(ref_id, root_title, file_name)``, ``media(id, root_title, role, caption, alt_text)``.
    """
    exact = media.select("root_title", "id", F.explode(F.array("caption", "alt_text")).alias("k")).where("coalesce(k, '') <> ''")
    exact = exact.select("root_title", "id", F.lit(0).alias("level"), file_ref("k").alias("sig"))
    covers = media.where(F.col("role").rlike(r"(?i)^album[-_]cover(?::|$)") & F.col("caption").isNotNull())
    covers = covers.select("root_title", "id", F.lit(1).alias("level"), cover_title(F.concat("caption", F.lit(".jpg")), "root_title").alias("sig"))
    index = union_all([exact, covers]).groupBy("root_title", "level", "sig").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    r = refs.select("ref_id", "root_title", file_ref("file_name").alias("_s0"), cover_title("file_name", "root_title").alias("_s1"))
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.col(f"_s{i}").alias("sig")) for i in (0, 1)])).alias("x")
    hits = r.select("ref_id", "root_title", each).select("ref_id", "root_title", "x.level", "x.sig").join(index, ["root_title", "level", "sig"])
    best = hits.groupBy("ref_id").agg(F.min_by(F.struct("level", "lo", "hi"), "level").alias("b"))
    return best.where("b.lo = b.hi").select("ref_id", "b.level", F.col("b.lo").alias("media_id"))


def media_scope(roots: DataFrame, generated: DataFrame, titles: DataFrame, media: DataFrame) -> DataFrame:
    """Media a root may reuse: attached to its generated documents, to a document of its title, or below its folder.

    ``generated(root_title, document_id)``, ``titles(document_id, title)``. The folder test joins every parent folder of
    a path with the folder of the root, so it stays an equality.
    """
    by_doc = generated.where(F.col("document_id").isNotNull()).select("root_title", "document_id")
    by_title = roots.join(titles, roots["root_title"] == titles["title"]).select("root_title", "document_id")
    attached = by_doc.unionByName(by_title).distinct().join(media.select("document_id", "id"), "document_id").select("root_title", "id")
    parts = F.split("storage_path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    below = media.where(F.contains("storage_path", F.lit("/"))).select("id", F.explode(folders).alias("folder"))
    prefixed = roots.select("root_title", storage_prefix("root_title").alias("folder")).join(below, "folder").select("root_title", "id")
    return attached.unionByName(prefixed).distinct()


def reconcile_staged(needed: DataFrame, resolved: DataFrame, staging: DataFrame) -> DataFrame:
    """Newest staged capture per needed file: by exact key, else by the base name kept in its alt text.

    Files that are resolved already are left alone.
    """
    need = required_keys(needed).withColumns({"exact": asset_key_noquery("name"), "base": asset_base_key("name")})
    done = resolved.select("doc_id", asset_key_noquery("ref").alias("exact")).distinct()
    need = need.join(done, ["doc_id", "exact"], "left_anti")
    held = staging.where(F.col("storage_path").isNotNull())
    newest = [-F.unix_micros("captured_at"), F.col("id")]
    named = held.where(~F.col("file_name").rlike(ANONYMOUS)).withColumn("exact", asset_key_noquery(F.coalesce("canonical_key", "file_name")))
    by_key = first_by(named, ["exact"], newest, ["storage_path"]).withColumnRenamed("storage_path", "_exact")
    alts = held.where(F.col("alt_name").isNotNull()).withColumn("base", asset_base_key("alt_name"))
    by_alt = first_by(alts, ["base"], newest, ["storage_path"]).withColumnRenamed("storage_path", "_alt")
    j = need.join(by_key, "exact", "left").join(by_alt, "base", "left")
    method = F.when(F.col("_exact").isNotNull(), "key").when(F.col("_alt").isNotNull(), "alt")
    return j.select("doc_id", "key", F.coalesce("_exact", "_alt").alias("storage_path"), method.alias("method")).where("storage_path IS NOT NULL")


def hint_updates(queue: DataFrame, hints: DataFrame) -> DataFrame:
    """Open queue rows that gain an address from the cluster's file map; unchanged rows are skipped."""
    open_rows = queue.where((F.col("asset_type") == "image") & F.col("status").isin("pending", "unresolved")).withColumn("file", file_ref("source_ref"))
    j = open_rows.join(hints.select("root_title", "file", F.col("url").alias("hint")), ["root_title", "file"])
    same = F.col("enrichment_url").eqNullSafe(F.col("hint")) & (F.col("status") == "pending")
    return j.where(~same).select("id", F.col("hint").alias("enrichment_url"), F.lit("pending").alias("status"))


def _bad_origin(site: Site) -> Column:
    bad = lambda c: F.coalesce(is_non_payload(c, site), F.lit(False))
    return bad("original_url") | bad("enrichment_url")


def usable_rows(queue: DataFrame, site: Site = SITE) -> DataFrame:
    """Queue rows that neither have a bad origin nor share a stored path with one that has."""
    poisoned = poisoned_paths(queue, _bad_origin(site))
    return queue.where(~_bad_origin(site)).join(poisoned, "storage_path", "left_anti")


def reuse_resolved(queue: DataFrame, keys: list[str], site: Site = SITE) -> DataFrame:
    """First resolved address per file key, bad origins excluded."""
    r = usable_rows(queue, site).where((F.col("status") == "resolved") & F.col("resolved_url").isNotNull())
    r = r.withColumn("key", asset_key(F.coalesce(F.nullif("label", F.lit("")), "source_ref"))).where("key <> ''")
    return first_by(r, [*keys, "key"], [F.col("id")], ["resolved_url", "storage_path"])


def resolved_map(queue: DataFrame, hints: DataFrame, scope: str, site: Site = SITE) -> DataFrame:
    """Address per file key: hints, then remote addresses, then resolved ones, then stored ones; later layers win.

    Within a layer the last row wins.
    """
    rows = usable_rows(queue, site).withColumns({"_k0": file_ref("source_ref"), "_k1": file_ref("label"), "_k2": file_ref("original_url")})
    web = lambda c: F.coalesce(F.col(c).rlike("(?i)^https?://") & ~is_non_payload(c, site), F.lit(False))
    remote = F.when(web("enrichment_url"), F.col("enrichment_url")).when(web("source_ref"), F.col("source_ref"))
    good = F.when(~F.coalesce(is_non_payload("resolved_url", site), F.lit(False)), F.nullif("resolved_url", F.lit("")))
    layers = F.array(
        F.struct(F.lit(1).alias("layer"), remote.alias("url")),
        F.struct(F.lit(2).alias("layer"), good.alias("url")),
        F.struct(F.lit(3).alias("layer"), F.when(F.coalesce("storage_path", F.lit("")) != "", good).alias("url")),
    )
    names = distinct_values(F.col("_k0"), F.col("_k1"), F.col("_k2"))
    rows = rows.select(scope, F.col("id").alias("ord"), names.alias("names"), F.explode(layers).alias("x")).select(scope, "ord", "names", "x.layer", "x.url")
    rows = rows.where("url IS NOT NULL").select(scope, "ord", F.explode("names").alias("key"), "layer", "url")
    base = hints.where(~is_non_payload("url", site)).select(scope, F.lit(0).cast("bigint").alias("ord"), "key", F.lit(0).alias("layer"), "url")
    return rows.unionByName(base).groupBy(scope, "key").agg(F.max_by("url", F.struct("layer", "ord", "url")).alias("url"))
