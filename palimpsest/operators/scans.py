"""Point lookups, listings and predicates. Every ORDER BY ends in a unique key."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as fn


class MissingCalibration(LookupError):
    """A combination of plugin type and model has no thresholds; nothing may be guessed in their place."""


def inode_lookup(inodes: DataFrame, parent: object, name: str) -> DataFrame:
    return inodes.where(fn.same(F.col("parent_id"), F.lit(parent)) & (F.col("name") == name))


def inode_by_number(inodes: DataFrame, ino: int) -> DataFrame:
    return inodes.where(F.col("ino") == ino)


def inode_by_id(inodes: DataFrame, inode: object) -> DataFrame:
    return inodes.where(F.col("id") == inode)


def children(inodes: DataFrame, parent: object) -> DataFrame:
    return inodes.where(fn.same(F.col("parent_id"), F.lit(parent))).orderBy("ino")


def version_of(versions: DataFrame, inode: object, number: int | None = None) -> DataFrame:
    """An exact version of an inode, or its latest."""
    own = versions.where(F.col("inode_id") == inode)
    if number is not None:
        return own.where(F.col("version_number") == number)
    return own.orderBy(F.desc("version_number"), "id").limit(1)


def latest_versions(versions: DataFrame) -> DataFrame:
    """The latest version of every inode, by one map-side combined aggregate."""
    whole = F.struct(*(F.col(c) for c in versions.columns))
    return versions.groupBy("inode_id").agg(F.max_by(whole, F.struct("version_number", "id")).alias("v")).select("v.*")


def version_by_id(versions: DataFrame, version: object) -> DataFrame:
    return versions.where(F.col("id") == version)


def history(versions: DataFrame, inode: object) -> DataFrame:
    return versions.where(F.col("inode_id") == inode).orderBy("version_number")


def newest_by_hash(versions: DataFrame, content_hash: str) -> DataFrame:
    return versions.where(F.col("content_hash") == content_hash).orderBy(F.desc("created_at"), "id").limit(1)


def blocks_of_version(ast_nodes: DataFrame, version: object) -> DataFrame:
    return ast_nodes.where(F.col("version_id") == version).orderBy("start_line", "id")


def blobs_by_hash(blobs: DataFrame, content_hash: str) -> DataFrame:
    """All blobs of a hash: a shared one, and any number of private ones."""
    return blobs.where(F.col("content_hash") == content_hash).orderBy("blob_id")


def dedup_target(blobs: DataFrame, content_hash: str) -> DataFrame:
    """The blob that new content of a hash may refer to: shared ones only."""
    return blobs.where(F.col("shared") & (F.col("content_hash") == content_hash))


def blob_digests(blobs: DataFrame, sample: int | None = None, seed: int = 0) -> DataFrame:
    """Ids and hashes to scrub: all, or a repeatable sample of that many."""
    digests = blobs.select("blob_id", "content_hash")
    if sample is None:
        return digests
    return digests.orderBy(F.xxhash64(F.col("blob_id").cast("string"), F.lit(seed)), "blob_id").limit(sample)


def private_blob(inodes: DataFrame, blobs: DataFrame, inode: object) -> DataFrame:
    own = inodes.where(F.col("id") == inode).select(F.col("current_blob_id").alias("blob_id"))
    return blobs.join(own, "blob_id").where(~F.col("shared"))


def default_model(models: DataFrame) -> DataFrame:
    return models.where(F.col("is_default")).orderBy("id").limit(1)


def model_by_name(models: DataFrame, name: str) -> DataFrame:
    return models.where(F.col("name") == name)


def with_thresholds(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """rows with the thresholds of their combination; combinations without any drop out."""
    return rows.join(thresholds, ["plugin_type", "model_id"])


def thresholds_of(thresholds: DataFrame, plugin_type: str, model_id: str):
    """The thresholds of one combination as a row; without them nothing may run."""
    row = thresholds.where((F.col("plugin_type") == plugin_type) & (F.col("model_id") == model_id)).first()
    if row is None:
        raise MissingCalibration(f"no thresholds for {plugin_type}, {model_id}")
    return row


def calibrated_combinations(thresholds: DataFrame) -> DataFrame:
    return thresholds.select("plugin_type", "model_id").distinct()


def stale_access(now: datetime, changed: str = "updated_at") -> Column:
    """Whether an access time is due: before the last change of content or attributes, or a day old."""
    day_ago = F.lit(now) - F.expr("INTERVAL 1 DAY")
    return (F.col("atime") < F.col("mtime")) | (F.col("atime") < F.col(changed)) | (F.col("atime") < day_ago)


def older_than(now: datetime, seconds: int, column: str = "created_at") -> Column:
    return F.col(column) < F.lit(now) - F.make_dt_interval(secs=F.lit(seconds))


def by_metadata(versions: DataFrame, reachable: DataFrame, wanted: dict) -> DataFrame:
    """Versions of reachable files whose JSON holds ``wanted``."""
    return versions.join(reachable.select(F.col("id").alias("inode_id")), "inode_id", "left_semi").where(fn.json_contains(F.col("special_data"), wanted))


def broken_files(versions: DataFrame, reachable: DataFrame) -> DataFrame:
    """Versions of reachable files that failed their syntax check."""
    return versions.join(reachable.select(F.col("id").alias("inode_id")), "inode_id", "left_semi").where(F.col("status") == "syntax_error")


def actor_activity(versions: DataFrame, actor: str, since: datetime | None = None, limit: int | None = None) -> DataFrame:
    """Versions an agent wrote, newest first; ``since`` is inclusive."""
    wrote = F.try_variant_get(F.try_parse_json("special_data"), "$.agent.actor_id", "string") == actor
    found = versions.where(wrote & fn.optional(None if since is None else F.col("created_at") >= F.lit(since))).orderBy(F.desc("created_at"), "id")
    return found if limit is None else found.limit(limit)


def latest_wins(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of a log for each key, by an aggregate that combines before the exchange."""
    whole = F.struct(*(F.col(c) for c in log.columns))
    return log.groupBy(*keys).agg(F.max_by(whole, F.struct(*order)).alias("r")).select("r.*")


def upsert(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """base with rows of ``changes`` in place of those of the same key; null keys are equal."""
    marked = base.withColumn("_age", F.lit(0)).unionByName(changes.withColumn("_age", F.lit(1)))
    order = Window.partitionBy(*keys).orderBy(F.desc("_age"))
    return marked.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_age")
