"""Content-addressed blobs: deduplication, reclamation, scrubbing and sharing."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as fn
from palimpsest.operators.scans import older_than


def insert_blobs(blobs: DataFrame, incoming: DataFrame) -> DataFrame:
    """(blob_id offered, canonical_id, inserted) for incoming (seq, blob_id, content_hash, shared, ..).

    Of shared blobs of a hash the one already stored is canonical, else the first
    to come; private ones are always stored and never shared with anyone.
    """
    stored = blobs.where("shared").select("content_hash", F.col("blob_id").alias("_stored"))
    shared = incoming.where("shared")
    first = shared.groupBy("content_hash").agg(F.min_by("blob_id", F.struct("seq", "blob_id")).alias("_first"))
    told = shared.join(first, "content_hash").join(stored, "content_hash", "left")
    canonical = F.coalesce("_stored", "_first")
    inserted = F.col("_stored").isNull() & (F.col("blob_id") == F.col("_first"))
    private = incoming.where("not shared").select("blob_id", F.col("blob_id").alias("canonical_id"), F.lit(True).alias("inserted"))
    return told.select("blob_id", canonical.alias("canonical_id"), inserted.alias("inserted")).union(private)


def dedup_contents(contents: DataFrame, id_col: str, data_col: str) -> DataFrame:
    """(id, content_hash, size, canonical_id, inserted) of raw contents: the least id of a hash is stored."""
    hashed = contents.select(F.col(id_col).alias("id"), fn.content_hash(F.col(data_col)).alias("content_hash"), F.octet_length(data_col).alias("size"))
    first = hashed.groupBy("content_hash").agg(F.min("id").alias("canonical_id"))
    return hashed.join(first, "content_hash").select("id", "content_hash", "size", "canonical_id", (F.col("id") == F.col("canonical_id")).alias("inserted"))


def set_compressed_size(blobs: DataFrame, sizes: DataFrame) -> DataFrame:
    """blobs with compressed sizes given by blob id: private twins of a hash are left alone."""
    return blobs.join(sizes.select("blob_id", F.col("compressed_size").alias("_c")), "blob_id", "left").withColumn("compressed_size", F.coalesce("_c", "compressed_size")).select(*blobs.columns)


def delete_blobs(blobs: DataFrame, gone: DataFrame) -> DataFrame:
    return blobs.join(gone.select("blob_id"), "blob_id", "left_anti")


def unreferenced(blobs: DataFrame, versions: DataFrame, now: datetime, grace_seconds: int = 3600, limit: int | None = 500, by: str = "blob_id") -> DataFrame:
    """Blobs past their grace that no version names, oldest first; ``by`` content_hash counts twins of a hash as one."""
    old = blobs.where(older_than(now, grace_seconds))
    found = old.join(versions.where(F.col(by).isNotNull()).select(by), by, "left_anti").orderBy("created_at", "blob_id")
    return found if limit is None else found.limit(limit)


def protected_split(candidates: DataFrame, queued: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(to delete, kept because a queued write names its hash)."""
    named = queued.select("content_hash").distinct()
    return candidates.join(named, "content_hash", "left_anti"), candidates.join(named, "content_hash", "left_semi")


def collect_garbage(blobs: DataFrame, versions: DataFrame, queued: DataFrame, now: datetime, grace_seconds: int = 3600, limit: int = 500) -> tuple[DataFrame, DataFrame]:
    """(ids to reclaim, one row of counters). References are looked up again here, not taken from an earlier list."""
    free, kept = protected_split(unreferenced(blobs, versions, now, grace_seconds, limit), queued)
    report = free.agg(F.count("*").alias("reclaimed"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).crossJoin(F.broadcast(kept.agg(F.count("*").alias("skipped_pending"))))
    return free.select("blob_id"), report


def reconcile_provisional(provisional: DataFrame, stored: DataFrame, present: DataFrame) -> DataFrame:
    """(blob_id, action): a new hash keeps its copy; a known one drops it, or heals the stored bytes if they are lost."""
    known = stored.where("shared").select("content_hash", F.col("blob_id").alias("_stored"))
    bytes_ = present.select(F.col("blob_id").alias("_stored"), F.lit(True).alias("_there"))
    told = provisional.join(known, "content_hash", "left").join(bytes_, "_stored", "left")
    action = F.when(F.col("_stored").isNull(), "keep").when(F.col("_there"), "delete_copy").otherwise("heal")
    return told.select("blob_id", F.col("_stored").alias("canonical_id"), action.alias("action"))


def scrub(expected: DataFrame, files: DataFrame, decode=fn.decompress) -> DataFrame:
    """(blob_id, state): intact, mismatch, undecodable or missing, and unreferenced for files nobody expects.

    expected: (blob_id, content_hash); files: (blob_id, data). decode turns stored
    bytes into content, null where it can't. Nothing is deleted.
    """
    read = files.select("blob_id", F.col("data"), decode(F.col("data")).alias("_plain"))
    both = expected.select("blob_id", "content_hash").join(read, "blob_id", "full_outer")
    state = (
        F.when(F.col("content_hash").isNull(), "unreferenced")
        .when(F.col("data").isNull(), "missing")
        .when(F.col("_plain").isNull(), "undecodable")
        .when(fn.content_hash(F.col("_plain")) == F.col("content_hash"), "intact")
        .otherwise("mismatch")
    )
    return both.select("blob_id", state.alias("state"))


def scrub_report(states: DataFrame) -> DataFrame:
    """One row of counters; what was checked leaves out what is missing."""
    n = lambda s: F.count_if(F.col("state") == s)
    return states.agg(
        (n("intact") + n("mismatch") + n("undecodable")).alias("checked"), n("intact").alias("intact"), n("mismatch").alias("mismatch"), n("undecodable").alias("undecodable"), n("missing").alias("missing"), n("unreferenced").alias("unreferenced")
    )


def inode_sharing(versions: DataFrame, blobs: DataFrame) -> DataFrame:
    """(inode_id, shared, private): distinct blobs of an inode's versions by kind."""
    own = versions.where("blob_id is not null").select("inode_id", "blob_id").distinct().join(blobs.select("blob_id", "shared"), "blob_id")
    return own.groupBy("inode_id").agg(F.count_if("shared").alias("shared"), F.count_if(~F.col("shared")).alias("private"))


def sharing_totals(blobs: DataFrame) -> DataFrame:
    return blobs.agg(F.count_if("shared").alias("shared"), F.count_if(~F.col("shared")).alias("private"))


def pack(contents: DataFrame, id_col: str, data_col: str) -> DataFrame:
    """(id, content_hash, size, stored, compressed_size): hashed as it is, then compressed."""
    packed = contents.select(F.col(id_col).alias("id"), fn.content_hash(F.col(data_col)).alias("content_hash"), F.octet_length(data_col).cast("long").alias("size"), fn.compress(F.col(data_col).cast("binary")).alias("stored"))
    return packed.withColumn("compressed_size", F.octet_length("stored").cast("long"))


def still_unreferenced(candidates: DataFrame, versions: DataFrame, by: str = "blob_id") -> DataFrame:
    """Of blobs listed earlier those that no version has come to name since."""
    return candidates.join(versions.where(F.col(by).isNotNull()).select(by), by, "left_anti")
