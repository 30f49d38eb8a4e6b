"""Data-quality rules. Each gives a row (rule, violations, detail) when it is violated, none when it isn't."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as fn
from palimpsest.operators.scans import latest_versions
from palimpsest.schema import CORE_TABLES, FORBIDDEN_COLUMNS


def _told(bad: DataFrame, rule: str, detail: Column | None = None) -> DataFrame:
    """One row if ``bad`` has any; details are distinct and in order."""
    listed = F.array_join(F.array_sort(F.collect_set(detail.cast("string"))), ",") if detail is not None else F.lit("")
    return bad.agg(F.count("*").alias("violations"), listed.alias("detail")).where("violations > 0").select(F.lit(rule).alias("rule"), "violations", "detail")


def hash_format(versions: DataFrame) -> DataFrame:
    return _told(versions.where(~fn.is_content_hash(F.col("content_hash"))), "I1.hash_format", F.substring(F.col("id").cast("string"), 1, 8))


def hash_size_disagreement(versions: DataFrame) -> DataFrame:
    sizes = versions.where("external_path is null").groupBy("content_hash").agg(F.min("size").alias("lo"), F.max("size").alias("hi"))
    return _told(sizes.where("lo <> hi"), "I1.hash_size_disagreement", F.col("content_hash"))


def blob_size_mismatch(versions: DataFrame, blobs: DataFrame) -> DataFrame:
    own = versions.where("external_path is null").select("content_hash", "size")
    bad = own.join(blobs.select("content_hash", F.col("size").alias("stored")), "content_hash").where("size <> stored")
    return _told(bad, "I1.blob_size_mismatch", F.col("content_hash"))


def duplicate_version_number(versions: DataFrame) -> DataFrame:
    return _told(versions.groupBy("inode_id", "version_number").count().where("count > 1"), "I2.duplicate_version_number", F.col("inode_id"))


def non_contiguous_versions(versions: DataFrame) -> DataFrame:
    spans = versions.groupBy("inode_id").agg(F.min("version_number").alias("lo"), F.max("version_number").alias("hi"), F.count("*").alias("n"))
    detail = F.concat(F.col("inode_id").cast("string"), F.lit(":"), F.col("lo"), F.lit("-"), F.col("hi"), F.lit("/"), F.col("n"))
    return _told(spans.where("lo <> 1 or hi <> n"), "I2.non_contiguous_versions", detail)


def broken_version_chain(versions: DataFrame) -> DataFrame:
    """More roots than one, or a root that isn't the first version."""
    roots = versions.where("parent_version_id is null").groupBy("inode_id").agg(F.count("*").alias("n"), F.max(F.col("version_number") != 1).alias("late"))
    return _told(roots.where("n <> 1 or late"), "I2.broken_version_chain", F.col("inode_id"))


def cross_inode_parent(versions: DataFrame) -> DataFrame:
    parents = versions.select(F.col("id").alias("parent_version_id"), F.col("inode_id").alias("other"))
    bad = versions.select("id", "inode_id", "parent_version_id").join(parents, "parent_version_id").where("inode_id <> other")
    return _told(bad, "I2.cross_inode_parent", F.col("id"))


def dangling_blob_reference(versions: DataFrame, blobs: DataFrame) -> DataFrame:
    bad = versions.where("external_path is null and blob_id is not null").join(blobs.select("content_hash"), "content_hash", "left_anti")
    return _told(bad, "I3.dangling_blob_reference", F.col("content_hash"))


def current_blob_desync(inodes: DataFrame, versions: DataFrame) -> DataFrame:
    tips = latest_versions(versions).select(F.col("inode_id").alias("id"), "blob_id")
    bad = inodes.where(~F.col("is_dir")).select("id", "current_blob_id").join(tips, "id").where(~F.col("current_blob_id").eqNullSafe(F.col("blob_id")))
    return _told(bad, "I3.current_blob_desync", F.col("id"))


def orphan_blobs(versions: DataFrame, blobs: DataFrame) -> DataFrame:
    """Information, no failure: what the cleaner may reclaim."""
    return _told(blobs.join(versions.select("content_hash"), "content_hash", "left_anti"), "I3.orphan_blobs_INFO")


def schema_rules(spark, found: dict[str, DataFrame]) -> DataFrame:
    """Core tables that are missing and columns that must not be there."""
    rows = []
    missing = sorted(t for t in CORE_TABLES if t not in found)
    if missing:
        rows.append(("I4.missing_core_table", len(missing), ",".join(missing)))
    for table, columns in FORBIDDEN_COLUMNS.items():
        rows += [(f"I4.{table}_{c}_reintroduced", 1, f"{table}.{c} exists") for c in columns if table in found and c in found[table].columns]
    return spark.createDataFrame(rows, "rule string, violations long, detail string")


def multiple_is_current(ast_embeddings: DataFrame) -> DataFrame:
    return _told(ast_embeddings.where("is_current").groupBy("id").count().where("count > 1"), "FIX02.multiple_is_current", F.col("id"))


def stuck_processing(versions: DataFrame, now: datetime, seconds: int = 600) -> DataFrame:
    old = F.col("created_at") < F.lit(now) - F.make_dt_interval(secs=F.lit(seconds))
    return _told(versions.where((F.col("status") == "processing") & old), "PIPE.stuck_processing", F.col("id"))


def all_rules(inodes: DataFrame, versions: DataFrame, blobs: DataFrame, now: datetime) -> DataFrame:
    parts = [
        hash_format(versions), hash_size_disagreement(versions), blob_size_mismatch(versions, blobs), duplicate_version_number(versions), non_contiguous_versions(versions),
        broken_version_chain(versions), cross_inode_parent(versions), dangling_blob_reference(versions, blobs), current_blob_desync(inodes, versions), orphan_blobs(versions, blobs),
        stuck_processing(versions, now),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
