"""Writers (K1-K7). A table is a snapshot: changes give a new DataFrame that is written as a whole or by partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.urls import wiki_url
from ..session import cut_lineage, stored


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Target with updates merged in: provided columns are replaced, others kept, new keys added.

    Of several updates of one key the last by ``order`` counts.
    """
    values = [c for c in updates.columns if c not in keys and c != order]
    u = updates.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col(order)).alias("_u"))
    j = target.withColumn("_t", F.lit(True)).join(u, keys, "full_outer")
    out = []
    for c in target.columns:
        out.append(F.when(F.col("_u").isNotNull(), F.col(f"_u.{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c))
    return j.select(*out)


def insert_ignore(target: DataFrame, new: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Target plus the rows whose key it lacks; the first by ``order`` among several."""
    values = [c for c in new.columns if c not in keys]
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*values), order).alias("_v")).select(*keys, "_v.*")
    fresh = first.join(target.select(*keys), keys, "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def patch(df: DataFrame, predicate: Column, changes: dict[str, Column]) -> DataFrame:
    """Change columns of the rows that satisfy a predicate; the predicate sees the old values."""
    d = df.withColumn("_p", F.coalesce(predicate, F.lit(False)))
    return d.withColumns({c: F.when(F.col("_p"), v).otherwise(F.col(c)) for c, v in changes.items()}).drop("_p")


def replace_children(spark: SparkSession, path: str, parents: DataFrame, children: DataFrame, key: str, buckets: int = 64) -> None:
    """Replace all child rows of the given parents in a table stored by key bucket.

    Only the buckets that hold a parent are read and rewritten (dynamic partition overwrite). One folder per parent would
    be millions of folders, so parents share buckets; choose their number so that one bucket is a few gigabytes.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    touched = parents.select(bucket.alias("bucket")).distinct()
    kept = spark.read.parquet(path).join(touched, "bucket", "left_semi").join(parents.select(key), key, "left_anti")
    new = children.join(parents.select(key).distinct(), key, "left_semi").withColumn("bucket", bucket)
    # written back to where it was read from, hence cut off first
    whole = cut_lineage(kept.unionByName(new.select(*kept.columns)))
    write_bucketed(whole, path, overwrite_touched=True)
    # a bucket whose rows all went away has nothing to write; it is emptied by writing no rows into it
    gone = touched.join(whole.select("bucket").distinct(), "bucket", "left_anti").collect()  # at most ``buckets`` rows
    for row in gone:
        whole.drop("bucket").limit(0).write.mode("overwrite").parquet(f"{path.rstrip('/')}/bucket={row['bucket']}")


def write_bucketed(df: DataFrame, path: str, overwrite_touched: bool = False) -> None:
    # rebalancing keeps a bucket's rows together but splits a large bucket over several files of the advisory size
    w = df.hint("rebalance", F.col("bucket")).write.partitionBy("bucket").mode("overwrite")
    w.option("partitionOverwriteMode", "dynamic" if overwrite_touched else "static").parquet(path)


def artifact_manifest(docs: DataFrame, key: str, kinds: dict[str, str]) -> DataFrame:
    """One row per artifact of a document: kind, content hash, storage path and size. ``kinds`` maps kind to column."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("content")) for k, c in kinds.items()])).alias("a")
    d = docs.select(key, each).select(key, "a.kind", "a.content").where(F.length("content") > 0)
    d = d.withColumn("hash", F.sha2("content", 256)).withColumn("bytes", F.octet_length("content"))
    return d.withColumn("path", F.concat_ws("/", F.lit("browser-artifacts"), F.col(key).cast("string"), F.concat("hash", F.lit("."), "kind", F.lit(".gz"))))


SMALL = 1_000_000  # keys and digests in a broadcast, about 150 bytes each


def missing_artifacts(manifest: DataFrame, known: DataFrame | None = None, small: int = SMALL) -> DataFrame:
    """``kind, hash, content`` of each content once, without those in ``known(kind, hash)``.

    The row with the least key keeps a content (``key``, the first column, tells rows apart). That is decided on keys and digests
    alone; the decision goes to the contents as a broadcast of the rows to keep or of the rows to drop, whichever is fewer, so
    contents are not moved. Only if both are more than ``small`` the rows to keep are joined by a shuffle.
    """
    key = manifest.columns[0]
    digests = stored(manifest.select(key, "kind", "hash").distinct(), "artifact-digests")
    wanted = digests if known is None else digests.join(known.select("kind", "hash").distinct(), ["kind", "hash"], "left_anti")
    keep = stored(wanted.groupBy("kind", "hash").agg(F.min(key).alias(key)), "artifact-owners")
    n_all, n_keep = digests.count(), keep.count()
    here = manifest.select(F.col(key).alias("_key"), "kind", "hash", "content")

    def same(side: DataFrame) -> Column:
        return F.col("_key").eqNullSafe(side[key]) & (here["kind"] == side["kind"]) & (here["hash"] == side["hash"])

    if n_keep > small >= n_all - n_keep:
        match = [digests[c].eqNullSafe(keep[c]) for c in (key, "kind", "hash")]
        drop = digests.join(keep, match, "left_anti")
        return here.join(F.broadcast(drop), same(drop), "left_anti").drop("_key")
    return here.join(F.broadcast(keep) if n_keep <= small else keep, same(keep), "left_semi").drop("_key")


def export_artifacts(manifest: DataFrame, path: str) -> None:
    """Add each content that the store at ``path`` does not have, compressed, below its kind. What is there stays."""
    spark = manifest.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    known = spark.read.parquet(path).select("kind", "hash") if there else None
    missing_artifacts(manifest, known).write.partitionBy("kind").mode("append").option("compression", "gzip").parquet(path)


def sitemap(index: DataFrame, base: str) -> DataFrame:
    """Address, change date, frequency and priority of every published page, and the front page."""
    rows = index.select(
        wiki_url(f"{base}/w/", F.col("source_title")).alias("url"),
        F.coalesce(F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("")).alias("lastmod"),
        F.lit("weekly").alias("changefreq"),
        F.lit(0.8).alias("priority"),
    )
    front = index.sparkSession.range(1).select(F.lit(base).alias("url"), F.lit("").alias("lastmod"), F.lit("daily").alias("changefreq"), F.lit(1.0).alias("priority"))
    return front.unionByName(rows)


def run_summary(results: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    """Totals of a run and its final status."""
    agg = results.groupBy(*by).agg(
        F.count_if(F.col("status") == "fetched").alias("fetched"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(~F.col("status").isin("fetched", "skipped")).alias("errors"),
        *[F.sum(F.when(F.col("status") == "fetched", F.col(c)).otherwise(0)).alias(c) for c in measures],
    )
    return agg.withColumn("run_status", F.when(F.col("errors") > 0, "completed_with_errors").otherwise("completed"))
