"""Ranking and ordered numbering (W*). Top-1 picks are aggregates, so a hot key is combined before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

# The order of the pipeline stages.
STAGES = ("raw", "source_render", "translation", "en_render", "publish", "integration_qa")


def first_by(df: DataFrame, keys: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """The first row per key in the given order (ascending; negate or invert for descending)."""
    best = F.min_by(F.struct(*keep), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return df.groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best.*")


def top_rows(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows per key. With a constant ``k`` the rows are limited per task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def numbered(df: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """Global 1-based position in the given order without one task that sees everything.

    Range-sort, number inside each partition, then add the sizes of the earlier partitions.
    """
    cols = [f"_o{i}" for i in range(len(order))]
    keyed = df.select("*", *[o.alias(c) for o, c in zip(order, cols, strict=True)])
    parts = cut_lineage(keyed.orderBy(*cols).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row per partition
    before = sizes.withColumn(
        "_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).select("_part", "_before")
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*cols))
    return (
        parts.withColumn("_local", local)
        .join(before, "_part")
        .withColumn(name, F.col("_before") + F.col("_local"))
        .drop("_part", "_before", "_local", *cols)
    )


def numbered_within(df: DataFrame, key: str, bucket: Column, order: list[Column], name: str) -> DataFrame:
    """1-based position per key where one key may hold a large share of the rows.

    ``bucket`` must follow the order (e.g. the day of the ordering time). Positions are counted per (key, bucket) and
    shifted by the sizes of the key's earlier buckets.
    """
    d = df.withColumn("_bucket", bucket)
    sizes = d.groupBy(key, "_bucket").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(key, "_bucket", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(*order))
    return (
        d.withColumn("_local", local)
        .join(before, [key, "_bucket"])
        .withColumn(name, F.col("_before") + F.col("_local"))
        .drop("_bucket", "_local", "_before")
    )


def stage_order(stage: Column | str = "stage") -> Column:
    c = F.col(stage) if isinstance(stage, str) else stage
    out = F.lit(99)
    for i, s in reversed(list(enumerate(STAGES, 1))):
        out = F.when(c == s, i).otherwise(out)
    return out


def next_jobs(jobs: DataFrame, k: int = 1, stage: str | None = None) -> DataFrame:
    """The next ``k`` claimable jobs of every run: stage order, then oldest, then title."""
    open_jobs = jobs.where(F.col("status").isin("queued", "retry"))
    if stage:
        open_jobs = open_jobs.where(F.col("stage") == stage)
    return top_rows(open_jobs, ["run_id"], [stage_order(), F.col("updated_at"), F.col("source_title")], k)


def claim(jobs: DataFrame, worker: str, as_of: Column, k: int = 1) -> DataFrame:
    """The claimed jobs as they look after the claim."""
    return next_jobs(jobs, k).select(
        "id", "run_id", "stage", F.lit("running").alias("status"), (F.col("attempt") + 1).alias("attempt"),
        F.lit(worker).alias("locked_by"), as_of.alias("locked_at"),
    )


def best_relation(rel: DataFrame, keys: list[str]) -> DataFrame:
    """Highest score per target; the earliest position wins among equals."""
    return first_by(rel, keys, [-F.col("score"), F.col("position")], ["score", "position", "anchor_text"])


def best_link(links: DataFrame, keys: list[str]) -> DataFrame:
    """Best link per target: tier, table-of-contents order, priority, crawl mode, document order."""
    mode = F.when(F.col("crawl_mode") == "expand", 3).when(F.col("crawl_mode") == "leaf", 2).otherwise(1)
    toc = F.coalesce("toc_order", F.lit(2**31 - 1))
    order = [F.col("tier"), toc, -F.col("priority"), -mode, F.col("dom_order")]
    return first_by(links, keys, order, ["tier", "priority", "dom_order"])


# Relations of a link, weakest first.
RELATION_RANKS = ("related", "core_kpop_document", "member", "subdocument")


def relation_rank(relation: Column) -> Column:
    out = F.lit(1)
    for n, name in enumerate(RELATION_RANKS, 2):
        out = F.when(relation == name, n).otherwise(out)
    return out


def best_inbound(edges: DataFrame, key: str) -> DataFrame:
    """Best inbound relation per title: highest rank, then highest priority, then the first seen."""
    return first_by(edges, [key], [-F.col("rank"), -F.col("priority"), F.col("pos")], ["rank", "priority", "pos"])


def latest_canonical(rows: DataFrame, key: str) -> DataFrame:
    """Canonical rows before others, then the newest, then the smallest id."""
    return first_by(rows, [key], [(~F.col("canonical")).cast("int"), -F.unix_micros("ts"), F.col("id")], ["id", "canonical"])


def latest_runs(runs: DataFrame, limit: int = 80) -> DataFrame:
    """Newest run of each root; the roots with the newest runs."""
    last = first_by(runs, ["root_title"], [-F.unix_micros("created_at"), F.col("id")], ["id", "created_at", "status"])
    return last.orderBy(F.col("created_at").desc(), "root_title").limit(limit)


def next_revisions(saves: DataFrame, docs: DataFrame, doc: str = "source_document_id") -> DataFrame:
    """Number a batch of saves after each document's current revision, in time order."""
    n = numbered_within(saves, doc, F.to_date("created_at"), [F.col("created_at"), F.col("save_id")], "n")
    current = docs.select(F.col("id").alias(doc), F.coalesce("content_revision_no", F.lit(0)).alias("current_no"))
    return n.join(current, doc).withColumn("revision_no", F.col("current_no") + F.col("n")).drop("n")


def revision_history(revisions: DataFrame, k: int = 50) -> DataFrame:
    return top_rows(revisions, ["source_document_id"], [F.col("revision_no").desc()], k)


def without_repeats(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Drop rows equal to the row before them within the same document. Rows at the same place stand by value, so that reruns agree."""
    w = Window.partitionBy(key).orderBy(order, value)
    previous, first = F.lag(value).over(w), F.row_number().over(w) == 1
    return df.withColumn("_keep", first | ~F.col(value).eqNullSafe(previous)).where("_keep").drop("_keep")


def best_label(links: DataFrame, keys: list[str]) -> DataFrame:
    """Best label of a repeated link: one with a slash, then the longer one, then the earlier one."""
    score = F.when(F.col("label").contains("/"), 100).otherwise(0) + F.length("label")
    return first_by(links.withColumn("label_score", score), keys, [-F.col("label_score"), F.col("pos")], ["label", "label_score"])
