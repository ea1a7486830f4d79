"""Readers and writers."""

from pyspark.sql import functions as F

from ..session import work_path
from ..sources import sinks as k
from ..sources import snapshots as v
from ..sources import tables as s
from .registry import query


@query("s1_filtered_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 250000 ORDER BY o_orderkey")
def _(t):
    where = (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 250000)
    return s.scan(t.spark, t.path("orders"), ["o_orderkey", "o_totalprice"], where, [F.col("o_orderkey")])


@query("s2_full_scan", "SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem")
def _(t):
    return s.scan(t.spark, t.path("lineitem"), ["l_orderkey", "l_partkey", "l_linenumber"])


@query("s3_key_lookup", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def _(t):
    keys = t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return s.lookup(t.customer, keys, "c_custkey").select("c_custkey", "c_name")


@query("s5_team_list", "SELECT DISTINCT trim(p_name) AS team FROM part")
def _(t):
    line = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("# "), "p_brand")).otherwise(F.concat(F.lit("  "), "p_name", F.lit(" # note")))
    path = work_path(t.spark, "teams")
    t.part.select(line.alias("value")).unionByName(t.part.select(F.col("p_name").alias("value"))).write.text(path)
    return s.team_list(t.spark, path)


IMAGES = """SELECT p_partkey AS id, CASE p_partkey % 7
 WHEN 0 THEN unhex('89504E470D0A1A0A0000000D49484452' || lpad(hex(CAST(p_size AS BIGINT)), 8, '0') || lpad(hex(CAST(p_size + 10 AS BIGINT)), 8, '0') || '0802')
 WHEN 1 THEN unhex('474946383961' || lpad(hex(CAST(p_size AS BIGINT)), 2, '0') || '01' || lpad(hex(CAST(p_size AS BIGINT)), 2, '0') || '00')
 WHEN 2 THEN unhex('FFD8FFE000040102FFC00011080' || '0' || lpad(hex(CAST(p_size AS BIGINT)), 2, '0') || '0140030000000000000000FFD9')
 WHEN 3 THEN CAST('<svg xmlns="x"></svg>' AS BINARY) WHEN 4 THEN CAST('<html>no</html>' AS BINARY) WHEN 5 THEN CAST('' AS BINARY) ELSE unhex('010203') END AS content,
 CASE WHEN p_partkey % 7 = 4 THEN 'text/html' WHEN p_partkey % 7 = 6 THEN 'image/png' END AS declared, CASE WHEN p_partkey % 11 = 0 THEN 503 ELSE 200 END AS http_status FROM part"""


@query("s6_image_inspection", """
SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 OR p_partkey % 7 IN (4, 5) THEN '' ELSE CASE p_partkey % 7 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/gif' WHEN 2 THEN 'image/jpeg' WHEN 3 THEN 'image/svg+xml' ELSE 'image/png' END END AS type,
 CASE WHEN p_partkey % 11 = 0 THEN 'http_status' WHEN p_partkey % 7 = 5 THEN 'empty' WHEN p_partkey % 7 = 4 THEN 'not_an_image' WHEN p_partkey % 7 IN (0, 1, 2) AND p_size <= 2 THEN 'placeholder_size' ELSE '' END AS rejected,
 CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE CASE p_partkey % 7 WHEN 0 THEN p_size WHEN 1 THEN p_size + 256 WHEN 2 THEN 320 ELSE 0 END END AS width,
 CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE CASE p_partkey % 7 WHEN 0 THEN p_size + 10 WHEN 1 THEN p_size WHEN 2 THEN p_size ELSE 0 END END AS height FROM part""")
def _(t):
    d = s.inspect_images(t.sql(IMAGES))
    return d.select("id", "type", "rejected", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("width", "height")))


UPDATES = "SELECT o_orderkey % 1300 AS id, 'resolved' AS status, 'https://cdn.example/u' || CAST(o_orderkey AS STRING) AS resolved_url, o_orderkey AS ord FROM orders"


@query("k1_upsert", f"""
WITH u AS (SELECT id, arg_max(resolved_url, ord) AS url FROM ({UPDATES}) GROUP BY 1)
SELECT coalesce(q.id, u.id) AS id, CASE WHEN u.id IS NOT NULL THEN 'resolved' ELSE q.status END AS status, CASE WHEN u.id IS NOT NULL THEN u.url ELSE q.resolved_url END AS resolved_url, q.source_ref FROM asset_queue q FULL JOIN u ON u.id = q.id""")
def _(t):
    return k.upsert(t.asset_queue.select("id", "status", "resolved_url", "source_ref"), t.sql(UPDATES), ["id"], "ord")


@query("k1_upsert_version", f"""
WITH u AS (SELECT id, arg_max(resolved_url, ord) AS url FROM ({UPDATES}) GROUP BY 1)
SELECT coalesce(q.id, u.id) AS id, CASE WHEN u.id IS NOT NULL THEN 'resolved' ELSE q.status END AS status, CASE WHEN u.id IS NOT NULL THEN u.url ELSE q.resolved_url END AS resolved_url, q.source_ref FROM asset_queue q FULL JOIN u ON u.id = q.id""")
def _(t):
    path = work_path(t.spark, "queue")
    v.create(t.asset_queue.select("id", "status", "resolved_url", "source_ref"), path, "id", buckets=16)
    v.upsert(t.spark, path, t.sql(UPDATES), "ord")
    return v.read(t.spark, path)


NEW = "SELECT p_partkey + 500 AS id, p_name AS status, p_brand AS source_ref FROM part"


@query("k2_insert_ignore", f"SELECT id, status, source_ref FROM asset_queue UNION ALL SELECT * FROM ({NEW}) WHERE id NOT IN (SELECT id FROM asset_queue)")
def _(t):
    return k.insert_ignore(t.asset_queue.select("id", "status", "source_ref"), t.sql(NEW), ["id"], F.col("status"))


@query("k3_conditional_patch", "SELECT id, CASE WHEN status = 'retry' AND attempt >= 2 THEN 'queued' ELSE status END AS status, CASE WHEN status = 'retry' AND attempt >= 2 THEN 0 ELSE attempt END AS attempt FROM pipeline_jobs")
def _(t):
    hit = (F.col("status") == "retry") & (F.col("attempt") >= 2)
    return k.patch(t.pipeline_jobs.select("id", "status", "attempt"), hit, {"status": F.lit("queued"), "attempt": F.lit(0)})


@query("k4_replace_children", """
SELECT conv_id, turn, role AS body FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE turn >= 4) UNION ALL SELECT conv_id, turn, 'new ' || role AS body FROM conversations WHERE role = 'user' AND conv_id IN (SELECT conv_id FROM conversations WHERE turn >= 4)""")
def _(t):
    path = work_path(t.spark, "sections")
    old = t.conversations.select("conv_id", "turn", F.col("role").alias("body"))
    v.create(old, path, "conv_id", buckets=16)
    parents = old.where("turn >= 4").select("conv_id").distinct()
    children = old.where("body = 'user'").withColumn("body", F.concat(F.lit("new "), "body"))
    v.replace_children(t.spark, path, parents, children)
    return v.read(t.spark, path)


@query("k5_artifact_manifest", """
SELECT page_id, kind, sha256(content) AS hash, octet_length(encode(content)) AS bytes, 'browser-artifacts/' || CAST(page_id AS VARCHAR) || '/' || sha256(content) || '.' || kind || '.gz' AS path
FROM (SELECT page_id, 'html' AS kind, html AS content FROM pages UNION ALL SELECT page_id, 'css' AS kind, 'p{margin:' || CAST(page_id % 3 AS VARCHAR) || '}' AS content FROM pages)""")
def _(t):
    p = t.pages.withColumn("css", F.concat(F.lit("p{margin:"), (F.col("page_id") % 3).cast("string"), F.lit("}")))
    return k.artifact_manifest(p, "page_id", {"html": "html", "css": "css"}).select("page_id", "kind", "hash", F.col("bytes").cast("bigint").alias("bytes"), "path")


@query("k5_artifact_export", "SELECT 'html' AS kind, count(DISTINCT html) AS n, (SELECT CAST(sum(octet_length(encode(html))) AS BIGINT) FROM (SELECT DISTINCT html FROM pages)) AS bytes FROM pages UNION ALL SELECT 'css', 3, 33")
def _(t):
    path = work_path(t.spark, "artifacts")
    p = t.pages.withColumn("css", F.concat(F.lit("p{margin:"), (F.col("page_id") % 3).cast("string"), F.lit("}")))
    k.export_artifacts(k.artifact_manifest(p, "page_id", {"html": "html", "css": "css"}), path)
    return t.spark.read.parquet(path).groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.octet_length("content")).cast("bigint").alias("bytes"))


@query("k6_sitemap", """
SELECT 'https://site.example/w/' || array_to_string(list_transform(string_split(source_title, '/'), lambda x: url_encode(x)), '/') AS url, strftime(updated_at, '%Y-%m-%dT%H:%M:%S') AS lastmod, 'weekly' AS changefreq, 0.8::DOUBLE AS priority
FROM (SELECT source_title || '/한 글 ' || translated_title AS source_title, updated_at FROM wiki_docs WHERE translated_title IS NOT NULL) UNION ALL SELECT 'https://site.example', '', 'daily', 1.0::DOUBLE""")
def _(t):
    d = t.sql("SELECT source_title || '/한 글 ' || translated_title AS source_title, updated_at AS published_at FROM wiki_docs WHERE translated_title IS NOT NULL")
    return k.sitemap(d, "https://site.example")


RUNS = "SELECT o_custkey % 25 AS run_id, CASE WHEN o_orderkey % 11 = 0 AND o_custkey % 25 > 2 THEN 'HTTP 500' WHEN o_orderkey % 5 = 0 THEN 'skipped' ELSE 'fetched' END AS status, CAST(o_orderkey % 13 AS BIGINT) AS links, CAST(o_custkey % 7 AS BIGINT) AS images FROM orders"


@query("k7_run_summary", f"""
SELECT run_id, CAST(count_if(status = 'fetched') AS BIGINT) AS fetched, CAST(count_if(status = 'skipped') AS BIGINT) AS skipped, CAST(count_if(status = 'HTTP 500') AS BIGINT) AS errors, CAST(sum(CASE WHEN status = 'fetched' THEN links ELSE 0 END) AS BIGINT) AS links,
 CAST(sum(CASE WHEN status = 'fetched' THEN images ELSE 0 END) AS BIGINT) AS images, CASE WHEN count_if(status = 'HTTP 500') > 0 THEN 'completed_with_errors' ELSE 'completed' END AS run_status FROM ({RUNS}) GROUP BY 1""")
def _(t):
    return k.run_summary(t.sql(RUNS), ["run_id"], ["links", "images"])
