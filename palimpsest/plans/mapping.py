"""The model's tables as views over the driver's tables, and the same views in SQL.

events are commits (user: inode, order in time: version), customers under
nations under regions are a directory tree, documents are blobs, embeddings are
vectors of which every third is still buffered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.session import table

HASHES, EXTERNAL_EVERY = 997, 50


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "syntax_error").when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "signup", "processing").otherwise("clean")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("inode_id"),
        F.row_number().over(order).alias("version_number"),
        F.lag("event_id").over(order).alias("parent_version_id"),
        F.col("ts").alias("created_at"),
        F.sha2(F.concat(F.lit("c"), (F.col("event_id") % HASHES).cast("string")), 256).alias("content_hash"),
        (F.col("event_id") % HASHES).alias("blob_id"),
        (F.col("event_id") % HASHES + 1).alias("size"),
        status.alias("status"),
        F.col("event_type").alias("special_type"),
        F.col("props").alias("special_data"),
        F.when(F.col("event_id") % EXTERNAL_EVERY == 0, F.concat(F.lit("ext/"), F.col("event_id").cast("string"))).alias("external_path"),
        F.lit(0).alias("retry_count"),
    )


VERSIONS = """fv AS (
  SELECT event_id AS id, user_id AS inode_id, CAST(row_number() OVER w AS INTEGER) AS version_number, lag(event_id) OVER w AS parent_version_id, ts AS created_at,
    sha256('c' || CAST(event_id % 997 AS VARCHAR)) AS content_hash, event_id % 997 AS blob_id, event_id % 997 + 1 AS size,
    CASE event_type WHEN 'error' THEN 'syntax_error' WHEN 'view' THEN 'pending' WHEN 'signup' THEN 'processing' ELSE 'clean' END AS status,
    event_type AS special_type, props AS special_data, CASE WHEN event_id % 50 = 0 THEN 'ext/' || event_id END AS external_path
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


def inodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root, regions, nations and customers; a customer's current blob is its key modulo the number of hashes."""
    null = F.lit(None).cast("string")
    root = spark.range(1).select(F.lit("root").alias("id"), F.lit(1).cast("long").alias("ino"), null.alias("parent_id"), F.lit("").alias("name"), F.lit(True).alias("is_dir"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("long").alias("current_blob_id"))
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    r = table(spark, sf_dir, "region").select(key("r", "r_regionkey").alias("id"), (F.col("r_regionkey") + 2).cast("long").alias("ino"), F.lit("root").alias("parent_id"), F.col("r_name").alias("name"), F.lit(True).alias("is_dir"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("long").alias("current_blob_id"))
    n = table(spark, sf_dir, "nation").select(key("n", "n_nationkey"), (F.col("n_nationkey") + 100).cast("long"), key("r", "n_regionkey"), F.col("n_name"), F.lit(True), F.lit(0).cast("long"), F.lit(None).cast("long"))
    c = table(spark, sf_dir, "customer").select(key("c", "c_custkey"), (F.col("c_custkey") + 1000).cast("long"), key("n", "c_nationkey"), F.col("c_name"), F.lit(False), F.col("c_custkey") % 100, F.col("c_custkey") % HASHES)
    return root.union(r).union(n).union(c)


INODES = """inodes AS (
  SELECT 'root' AS id, CAST(1 AS BIGINT) AS ino, CAST(NULL AS VARCHAR) AS parent_id, '' AS name, TRUE AS is_dir, CAST(0 AS BIGINT) AS size, CAST(NULL AS BIGINT) AS current_blob_id
  UNION ALL SELECT 'r' || r_regionkey, r_regionkey + 2, 'root', r_name, TRUE, 0, NULL FROM region
  UNION ALL SELECT 'n' || n_nationkey, n_nationkey + 100, 'r' || n_regionkey, n_name, TRUE, 0, NULL FROM nation
  UNION ALL SELECT 'c' || c_custkey, c_custkey + 1000, 'n' || c_nationkey, c_name, FALSE, c_custkey % 100, c_custkey % 997 FROM customer)"""


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A blob for each document, a tenth of them private."""
    d = table(spark, sf_dir, "documents")
    created = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("doc_id").cast("int"))
    return d.select(F.col("doc_id").alias("blob_id"), F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"), F.octet_length("text").cast("long").alias("size"), (F.col("doc_id") % 10 != 0).alias("shared"), created.alias("created_at"))


BLOBS = "blobs AS (SELECT doc_id AS blob_id, sha256(text) AS content_hash, CAST(strlen(text) AS BIGINT) AS size, doc_id % 10 <> 0 AS shared, TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id AS INTEGER)) AS created_at FROM documents)"


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("id"), F.lit("m").alias("model_id"), F.size("embedding").alias("dim"), F.concat(F.lit("t"), F.col("label").cast("string")).alias("plugin_type"),
        "embedding", (F.col("vec_id") % 3 != 0).alias("consolidated"), F.lit(True).alias("is_current"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("vec_id").cast("int"))).alias("created_at"),
    )


EMBEDDINGS = "emb AS (SELECT vec_id AS id, 't' || label AS plugin_type, CAST(embedding AS DOUBLE[]) AS embedding, vec_id % 3 <> 0 AS consolidated FROM embeddings)"


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).where("consolidated").select(F.col("plugin_type").alias("centroid_id"), F.col("id").alias("member_id"))


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A centroid for each label: the mean of its consolidated vectors."""
    flat = embeddings(spark, sf_dir).where("consolidated").select("plugin_type", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "x"))
    means = flat.groupBy("plugin_type", "pos").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    whole = means.groupBy("plugin_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda p: p["m"]).alias("centroid"), F.max("n").alias("member_count"))
    return whole.select(F.col("plugin_type").alias("id"), "plugin_type", F.lit("m").alias("model_id"), F.size("centroid").alias("dim"), "centroid", "member_count", F.lit(True).alias("is_active"), F.lit(None).cast("string").alias("label"))


CENTROIDS = """cen AS (
  SELECT plugin_type AS id, plugin_type, list(m ORDER BY pos) AS centroid, max(n) AS member_count FROM (
    SELECT plugin_type, pos, avg(embedding[pos]) AS m, count(*) AS n FROM emb, unnest(range(1, 65)) AS p(pos) WHERE consolidated GROUP BY plugin_type, pos) GROUP BY plugin_type)"""


def thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thresholds of the even labels; the odd ones are not calibrated."""
    t = embeddings(spark, sf_dir).select("plugin_type", "model_id").distinct().where("substring(plugin_type, 2) % 2 = 0")
    return t.select("plugin_type", "model_id", F.lit(5).cast("long").alias("backlog_threshold"), F.lit(0.8).alias("join_threshold"), F.lit(0.6).alias("split_variance_threshold"), F.lit(40).cast("long").alias("max_members_per_centroid"), F.lit(25).alias("batch_size"))


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    row = table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row.embedding]


QUERY = "q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0)"


def code_blocks(spark: SparkSession, sf_dir: str, part: int) -> DataFrame:
    """Blocks of one of two versions of a file: documents by language and source, a few of them changed in the second."""
    d = table(spark, sf_dir, "documents").where(F.pmod("doc_id", F.lit(7)) != part)
    return d.select(
        F.col("lang").alias("kind"), F.concat(F.col("source"), F.lit("_"), F.pmod("doc_id", F.lit(50)).cast("string")).alias("name"), F.col("doc_id").cast("int").alias("start_line"), (F.col("doc_id") + 1).cast("int").alias("end_line"),
        F.col("text").alias("source"), F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"),
    )


def with_sql(*views: str, body: str) -> str:
    return f"WITH RECURSIVE {', '.join(views)} {body}"
