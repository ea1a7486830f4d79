"""Grouped statistics and roll-ups (A*, U*). Every grouping combines before its shuffle; no unbounded list is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import rows_of
from ..functions.keys import strip
from .ranking import first_by


def stage_status_counts(jobs: DataFrame) -> DataFrame:
    """Jobs per run, stage and status, with totals per stage and per run."""
    return (
        jobs.rollup("run_id", "stage", "status")
        .agg(F.count("*").alias("n"), F.grouping("stage").alias("_gs"), F.grouping("status").alias("_gt"), F.grouping("run_id").alias("_gr"))
        .where("_gr = 0")
        .select("run_id", F.when(F.col("_gs") == 1, "all").otherwise(F.col("stage")).alias("stage"), F.when(F.col("_gt") == 1, "all").otherwise(F.col("status")).alias("status"), "n")
    )


def stage_status_pivot(jobs: DataFrame, statuses: list[str]) -> DataFrame:
    """One row per run and stage with a column per status, split by core and dependency documents."""
    return jobs.groupBy("run_id", "stage", "is_dependency").pivot("status", statuses).count().na.fill(0)


def run_rollup(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """Distinct documents completed, failed and in review per run, and whether the run is complete."""
    doc = F.col("source_document_id")
    counts = jobs.groupBy(F.col("run_id").alias("id")).agg(
        F.countDistinct(F.when((F.col("stage") == "integration_qa") & (F.col("status") == "pass"), doc)).alias("completed_count"),
        F.countDistinct(F.when(F.col("status") == "failed", doc)).alias("failed_count"),
        F.countDistinct(F.when(F.col("status") == "needs_review", doc)).alias("review_count"),
    )
    done = (
        (F.col("scope_count") > 0) & (F.col("completed_count") >= F.col("scope_count")) & (F.col("failed_count") == 0) & (F.col("review_count") == 0)
    )
    return runs.select("id", "scope_count").join(counts, "id").withColumn("status", F.when(done, "completed").otherwise("running"))


def dependency_progress(jobs: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Dependency documents per run: total, ready and waiting.

    A document is ready when its English render passed. ``totals(run_id, dependency_total)`` may name more documents than
    have jobs; those are ready already. Ready never exceeds the total.
    """
    dep, doc = F.col("is_dependency"), F.col("source_document_id")
    rendered = dep & (F.col("stage") == "en_render") & (F.col("status") == "pass")
    agg = jobs.groupBy("run_id").agg(F.countDistinct(F.when(dep, doc)).alias("docs"), F.countDistinct(F.when(rendered, doc)).alias("rendered"))
    if totals is not None:
        agg = agg.join(totals, "run_id", "left")
    else:
        agg = agg.withColumn("dependency_total", F.lit(0))
    total = F.greatest(F.coalesce("dependency_total", F.lit(0)), F.col("docs"))
    ready = total - F.col("docs") + F.col("rendered")
    return agg.select("run_id", total.alias("total"), F.least(total, ready).alias("ready"), F.greatest(F.lit(0), total - ready).alias("waiting"))


def template_references(edges: DataFrame) -> DataFrame:
    """Owner and reference counts per template. The owners stay rows of ``edges``; a hot template has too many to list."""
    return edges.groupBy("template").agg(
        F.countDistinct("owner").alias("owner_count"), F.count("*").alias("refs"), F.min("owner").alias("first_owner")
    )


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def blocker_counts(results: DataFrame, groups: dict[str, str]) -> DataFrame:
    """One pass over result rows: how many carry no blocker of each group (pattern per group)."""
    def hit(pattern: str) -> Column:
        return F.exists("blockers", lambda b: b.rlike(pattern))

    clean = [F.count_if(~hit(p)).alias(name) for name, p in groups.items()]
    return results.agg(F.count("*").alias("scope"), F.count_if(F.size("blockers") == 0).alias("pass"), F.count_if(F.size("blockers") > 0).alias("blocked"), *clean)


def first_samples(df: DataFrame, value: str, order: str, k: int) -> DataFrame:
    """The first ``k`` distinct values in order of first appearance."""
    return df.groupBy(value).agg(F.min(order).alias("first_at")).orderBy("first_at", value).limit(k)


def merge_grammar(analyses: DataFrame) -> DataFrame:
    """Corpus totals of per-block grammar analyses."""
    return analyses.agg(
        F.count("*").alias("blocks"),
        F.count_if("normalized_changed").alias("normalized_blocks"),
        F.sum("repairs").alias("repairs"),
        *[F.sum(f"d_{k}").alias(f"d_{k}") for k in ("wiki", "if", "style", "folding", "html")],
        F.count_if((F.col("square_balance") > 0) | (F.col("curly_balance") > 0)).alias("unbalanced_blocks"),
    )


def coverage(raw: Column, rendered: Column) -> Column:
    total = raw + rendered
    return F.when(total > 0, F.round(F.floor(raw / total * 1000 + 0.5) / 10, 1)).otherwise(0.0)


def raw_coverage(docs: DataFrame, by: list[str]) -> DataFrame:
    """Share of recoverable source characters, weighted by length."""
    agg = docs.groupBy(*by).agg(F.sum("raw_chars").alias("raw_chars"), F.sum("rendered_chars").alias("rendered_chars"))
    return agg.withColumn("coverage", coverage(F.col("raw_chars"), F.col("rendered_chars")))


def poisoned_paths(assets: DataFrame, bad: Column) -> DataFrame:
    """Stored paths that ever came from a bad origin."""
    return assets.where(F.col("storage_path").isNotNull()).groupBy("storage_path").agg(F.max(bad).alias("poisoned")).where("poisoned").select("storage_path")


def cluster_membership(seen: DataFrame) -> DataFrame:
    return seen.groupBy("root_title", "source_document_id").agg(
        F.min("crawl_depth").alias("min_crawl_depth"), F.min("seen_at").alias("first_seen_at"), F.max("seen_at").alias("last_seen_at")
    )


def text_node_frequency(pages: DataFrame, key: str, html: Column) -> DataFrame:
    """How often each visible text occurs in a fragment, and whether it has Hangul."""
    body = F.regexp_replace(html, r"(?i)<(script|style|noscript|template)\b[\s\S]*?</\1\s*>", "")
    nodes = F.transform(F.split(body, r"<[^>]*>", -1), lambda x: strip(F.regexp_replace(x, r"\s+", " ")))
    rows = rows_of(pages, [key], F.filter(nodes, lambda x: x != ""), "text")
    return rows.groupBy(key, "text").agg(F.count("*").alias("n")).withColumn("has_hangul", F.col("text").rlike("[가-힣]"))


def modal_width(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Most frequent row width per table; the smaller width wins ties, and a width must occur twice."""
    counts = rows.where("width > 0").groupBy(*keys, "width").agg(F.count("*").alias("n"))
    return first_by(counts, keys, [-F.col("n"), F.col("width")], ["width", "n"]).where("n >= 2")


def byte_accounting(df: DataFrame, original: Column, stored: Column) -> DataFrame:
    return df.agg(
        F.count("*").alias("rows"), F.sum(F.octet_length(original)).alias("original_bytes"), F.sum(stored).alias("stored_bytes")
    )


def label_index(labels: DataFrame) -> DataFrame:
    """First label per key: by whole title and by last path segment. Rows are ``(target, label, ordinal)``."""
    clean = strip(F.regexp_replace("label", r"\s+", " "))
    ok = (clean != "") & ~clean.rlike("[가-힣]") & ~clean.rlike(r"(?i)\[\[|\]\]|\{\{\{|\}\}\}|\[include\(")
    rows = labels.withColumns({"key": strip("target"), "label": clean}).where(ok & (F.col("key") != ""))
    exact = rows.where("key <> label").select(F.lit("exact").alias("kind"), "key", "label", "ordinal")
    last = lambda c: strip(F.regexp_replace(c, r"^.*/", ""))
    suffix = rows.select(F.lit("suffix").alias("kind"), last("key").alias("key"), last("label").alias("label"), "ordinal")
    suffix = suffix.where("key <> '' AND label <> ''")
    return exact.unionByName(suffix).groupBy("kind", "key").agg(F.min_by("label", F.struct("ordinal", "label")).alias("label"))


def ordered_json(rows: DataFrame, keys: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """JSON list per key in a given order; use where the list per key is bounded (e.g. after ``top_rows``)."""
    item = F.struct(*[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], F.struct(*fields).alias("item"))
    listed = F.transform(F.array_sort(F.collect_list(item)), lambda x: x["item"])
    return rows.groupBy(*keys).agg(F.to_json(listed).alias("items"))


def pass_statistics(changes: DataFrame, passes: list[str]) -> DataFrame:
    """Corpus totals of per-document rewrite counters."""
    return changes.agg(
        F.count("*").alias("docs"),
        F.count_if(F.col("chars_after") != F.col("chars_before")).alias("docs_changed"),
        F.sum("chars_before").alias("chars_before"),
        F.sum("chars_after").alias("chars_after"),
        *[F.sum(p).alias(p) for p in passes],
    )


# --- set operations -------------------------------------------------------------------------------------------------


def union_by_priority(parts: list[DataFrame], key: list[str], keep: list[str]) -> DataFrame:
    """Union where the row with the highest priority wins per key; the earlier part wins ties."""
    tagged = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    u = tagged[0]
    for p in tagged[1:]:
        u = u.unionByName(p)
    return first_by(u, key, [-F.col("priority"), F.col("_part"), *[F.col(k) for k in keep]], ["priority", *keep])


def with_ignored_complement(scope: DataFrame, cluster: DataFrame, key: list[str]) -> DataFrame:
    """Scope rows plus an ignored row for every cluster document outside the scope."""
    rest = cluster.select(*key).distinct().join(scope, key, "left_anti")
    return scope.unionByName(rest.withColumns({"status": F.lit("ignored"), "priority": F.lit(0)}))


def missing_titles(expected: DataFrame, captured: DataFrame, title: str) -> DataFrame:
    return expected.select(title).subtract(captured.select(title))


def jaccard(a: Column, b: Column) -> Column:
    """Set similarity of two arrays; two empty sets are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def marker_difference(original: Column, baseline: Column) -> Column:
    """Markers that appear only in the baseline."""
    return F.array_except(baseline, original)


def distinct_values(*cols: Column) -> Column:
    """Distinct non-empty values of several columns."""
    return F.array_distinct(F.filter(F.array(*cols), lambda x: x.isNotNull() & (x != "")))
