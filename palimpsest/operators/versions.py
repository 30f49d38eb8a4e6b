"""Version chains: committing, deriving what is current, and comparing versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.scans import latest_versions


def commit(inodes: DataFrame, versions: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new versions, commits refused). incoming: (seq, id, inode_id, ..) in the order of seq.

    A version already there is passed over (replay changes nothing); an inode that
    is not there refuses. Numbers go on from the inode's last, parents follow it.
    Only inodes that are written to are read.
    """
    first = incoming.groupBy("id").agg(F.min_by(F.struct(*(F.col(c) for c in incoming.columns)), "seq").alias("r")).select("r.*")
    fresh = first.join(versions.select("id"), "id", "left_anti")
    known = fresh.join(inodes.select(F.col("id").alias("inode_id")), "inode_id", "left_semi")
    refused = fresh.join(inodes.select(F.col("id").alias("inode_id")), "inode_id", "left_anti")
    touched = versions.join(known.select("inode_id").distinct(), "inode_id", "left_semi")
    tips = latest_versions(touched).select("inode_id", F.col("version_number").alias("_last"), F.col("id").alias("_tip"))
    order = Window.partitionBy("inode_id").orderBy("seq", "id")
    numbered = (
        known.join(tips, "inode_id", "left")
        .withColumn("version_number", (F.coalesce("_last", F.lit(0)) + F.row_number().over(order)).cast("int"))
        .withColumn("parent_version_id", F.coalesce(F.lag("id").over(order), F.col("_tip")))
        .drop("_last", "_tip")
    )
    return numbered, refused


def commit_blocks(ast_nodes: DataFrame, incoming: DataFrame) -> DataFrame:
    """New code blocks: once for each version and hash, whatever is replayed."""
    return incoming.dropDuplicates(["version_id", "content_hash"]).join(ast_nodes.select("version_id", "content_hash"), ["version_id", "content_hash"], "left_anti")


def advance_inodes(inodes: DataFrame, committed: DataFrame) -> DataFrame:
    """Inodes pointing at their newest committed version; modification and change times move, access times don't."""
    tips = latest_versions(committed).select(F.col("inode_id").alias("id"), F.col("blob_id").alias("_b"), F.col("size").alias("_s"), F.col("created_at").alias("_t"))
    moved = F.col("_t").isNotNull()
    return (
        inodes.join(tips, "id", "left")
        .withColumns(
            {
                "current_blob_id": F.when(moved, F.col("_b")).otherwise(F.col("current_blob_id")),
                "size": F.when(moved, F.col("_s")).otherwise(F.col("size")),
                "mtime": F.coalesce("_t", "mtime"),
                "updated_at": F.coalesce("_t", "updated_at"),
            }
        )
        .select(*inodes.columns)
    )


def with_is_current(versions: DataFrame) -> DataFrame:
    """Whether each version is its inode's latest: derived, so no order of updates can get it wrong."""
    tips = versions.groupBy("inode_id").agg(F.max("version_number").alias("_last"))
    return versions.join(tips, "inode_id").withColumn("is_current", F.col("version_number") == F.col("_last")).drop("_last")


def refresh_is_current(ast_embeddings: DataFrame, ast_nodes: DataFrame, versions: DataFrame) -> DataFrame:
    """Embeddings of code blocks with is_current as their version has it."""
    current = with_is_current(versions).select(F.col("id").alias("version_id"), F.col("is_current").alias("_c"))
    of_node = ast_nodes.select(F.col("id").alias("_node"), "version_id").join(current, "version_id")
    joined = ast_embeddings.join(of_node, ast_embeddings["id"] == F.col("_node"), "left")
    return joined.withColumn("is_current", F.coalesce("_c", "is_current")).select(*ast_embeddings.columns)


def next_number(versions: DataFrame, inodes: DataFrame) -> DataFrame:
    """(inode_id, next_number) for every inode, 1 for one without versions."""
    last = versions.groupBy("inode_id").agg(F.max("version_number").alias("n"))
    return inodes.select(F.col("id").alias("inode_id")).join(last, "inode_id", "left").select("inode_id", (F.coalesce("n", F.lit(0)) + 1).alias("next_number"))


def diff_functions(old: DataFrame, new: DataFrame) -> DataFrame:
    """(change, kind, name, start_line, ..) between two versions' code blocks.

    Of blocks of one kind and name the last by line stands. Added ones are only in
    the new version, removed ones only in the old, changed ones differ in hash or
    source and are shown as they are new.
    """

    def last(df: DataFrame) -> DataFrame:
        shown = F.struct("start_line", "end_line", "source", "content_hash")
        return df.groupBy("kind", "name").agg(F.max_by(shown, F.struct("start_line", "content_hash")).alias("b"))

    both = last(old).withColumnRenamed("b", "o").join(last(new).withColumnRenamed("b", "n"), ["kind", "name"], "full_outer")
    differs = (F.col("o.content_hash") != F.col("n.content_hash")) | (F.col("o.source") != F.col("n.source"))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(differs, "changed")
    shown = F.coalesce("n", "o")
    return both.select(change.alias("change"), "kind", "name", shown.alias("b")).where("change is not null").select("change", "kind", "name", "b.*")


def status_log(versions: DataFrame, events: DataFrame) -> DataFrame:
    """Versions with the status of the last event (version_id, at, status, retry); a failure counts as a retry."""
    last = events.groupBy("version_id").agg(F.max_by("status", F.struct("at", "status")).alias("_s"), F.sum(F.when(F.col("status") == "failed", 1).otherwise(0)).alias("_r"))
    joined = versions.join(last, versions["id"] == last["version_id"], "left")
    return joined.withColumns({"status": F.coalesce("_s", "status"), "retry_count": (F.col("retry_count") + F.coalesce("_r", F.lit(0))).cast("int")}).select(*versions.columns)


def claim_pending(versions: DataFrame, limit: int) -> DataFrame:
    """The oldest pending versions, as the one batch owner takes them."""
    return versions.where(F.col("status") == "pending").orderBy("created_at", "id").limit(limit).withColumn("status", F.lit("processing"))


def revert_stuck(versions: DataFrame, now, seconds: int = 600) -> DataFrame:
    """Versions in processing for too long are pending again."""
    stuck = (F.col("status") == "processing") & (F.col("created_at") < F.lit(now) - F.make_dt_interval(secs=F.lit(seconds)))
    return versions.withColumn("status", F.when(stuck, "pending").otherwise(F.col("status")))
