"""The write queue as a stream: committed batch by batch, replayed without effect, read through an overlay.

The queue never drops an acknowledged write, so no watermark is used. A batch is
put in order by sequence and committed in ``foreachBatch``; commits are keyed by
version id, so a batch that runs again adds nothing.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.operators.scans import latest_wins
from palimpsest.operators.versions import commit, commit_blocks
from palimpsest.schema import conform, schema_of


def overlay(committed: DataFrame, pending: DataFrame) -> DataFrame:
    """The newest state of each inode: its last queued write, else its last committed version."""
    both = committed.select("inode_id", F.lit(0).alias("_queued"), F.col("version_number").cast("long").alias("_at"), "content_hash", "size").union(
        pending.select("inode_id", F.lit(1).alias("_queued"), F.col("seq").alias("_at"), "content_hash", "size")
    )
    return latest_wins(both, ["inode_id"], ["_queued", "_at"]).select("inode_id", "content_hash", "size", (F.col("_queued") == 1).alias("pending"))


def withdraw(pending: DataFrame, committed_ids: DataFrame) -> DataFrame:
    """What stays queued: markers whose own version isn't committed; a later write of the inode stays."""
    return pending.join(committed_ids.select(F.col("id").alias("version_id")), "version_id", "left_anti")


def as_versions(markers: DataFrame) -> DataFrame:
    return markers.withColumn("id", F.col("version_id")).withColumn("created_at", F.try_to_timestamp("created_at"))


def replay(inodes: DataFrame, versions: DataFrame, markers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new versions, one row {found, committed, already_committed, failed}); a marker that fails stops no other."""
    incoming = as_versions(markers)
    new, refused = commit(inodes, versions, incoming)
    found = incoming.select("id", "seq")
    known = found.join(versions.select("id"), "id", "left_semi")
    report = (
        found.agg(F.count("*").alias("found"))
        .crossJoin(F.broadcast(new.agg(F.count("*").alias("committed"))))
        .crossJoin(F.broadcast(known.agg(F.count("*").alias("already_committed"))))
        .crossJoin(F.broadcast(refused.agg(F.count("*").alias("failed"))))
    )
    return new, report


def new_blocks(markers: DataFrame, ast_nodes: DataFrame) -> DataFrame:
    """Code blocks that markers carry and the table lacks."""
    flat = markers.select("version_id", F.explode("ast_nodes").alias("n")).select("version_id", "n.*")
    return commit_blocks(ast_nodes, flat)


class CommitLog:
    """Committed versions as an append-only Parquet log, a folder for each batch."""

    def __init__(self, spark: SparkSession, folder: str, inodes: DataFrame):
        self.spark, self.folder, self.inodes = spark, folder.rstrip("/"), inodes

    def versions(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema_of("file_versions"))
        return self.spark.read.schema(schema_of("file_versions")).option("recursiveFileLookup", True).parquet(self.folder)

    def commit_batch(self, markers: DataFrame, batch_id: int) -> None:
        """Commit a batch; run again it writes the same folder again."""
        before = self.versions().where(~F.col("_metadata.file_path").contains(f"/batch={batch_id}/")) if batch_id >= 0 and self._has_rows() else self.versions()
        new, _ = commit(self.inodes, before, as_versions(markers))
        conform(new, "file_versions").write.mode("overwrite").parquet(f"{self.folder}/batch={batch_id}")

    def _has_rows(self) -> bool:
        return bool(self.versions().inputFiles())


def stream_markers(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Markers as they are queued; the rate limit holds back, and never refuses."""
    return spark.readStream.schema(schema_of("pending_markers")).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def drain(log: CommitLog, markers: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start committing a stream of markers; with ``once`` it ends when the queue is empty."""
    writer = markers.writeStream.foreachBatch(lambda df, n: log.commit_batch(df, n)).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")
    return writer.start()


class PendingQueueFull(RuntimeError):
    """The queue stayed full for as long as a write may wait; nothing of the write was made durable."""


class Gate:
    """Admits writes to the queue, no more than ``most`` at once; a write that finds no place waits up to ``patience`` seconds."""

    def __init__(self, most: int = 10_000, patience: float = 5.0):
        self.most, self.patience, self._held, self._changed = most, patience, 0, threading.Condition()

    @property
    def depth(self) -> int:
        return self._held

    def admit(self) -> None:
        with self._changed:
            if not self._changed.wait_for(lambda: self._held < self.most, self.patience):
                raise PendingQueueFull(f"{self._held} writes are queued")
            self._held += 1

    def release(self, places: int = 1) -> None:
        with self._changed:
            self._held = max(0, self._held - places)
            self._changed.notify_all()


def enqueue(gate: Gate, folder: str, markers: DataFrame) -> int:
    """Make markers durable in the queue and return how many; a place is taken for each first, and given back if the write fails."""
    from palimpsest.sources.documents import write_markers

    taken = 0
    try:
        for _ in range(markers.count()):
            gate.admit()
            taken += 1
        write_markers(markers, folder)
    except BaseException:
        gate.release(taken)
        raise
    return taken


class EmbedWorker:
    """Runs ``embed`` over pending versions when that is due; while writes go on, a forced run takes its first version without a pause.

    ``embed(versions)`` returns (done ids, failed ids). Of the versions the driver
    holds a count and an age.
    """

    def __init__(self, embed: Callable[[DataFrame], tuple[DataFrame, DataFrame]], batch: int = 50, clock: Callable[[], float] = time.monotonic):
        self.embed, self.batch, self.clock, self.last_write = embed, batch, clock, float("-inf")

    def written(self) -> None:
        """A write came in: what isn't forced waits until things are quiet."""
        self.last_write = self.clock()

    def step(self, versions: DataFrame, now: datetime) -> DataFrame:
        """versions after one step of the loop."""
        from palimpsest.operators.aggregates import oldest_pending_age, pending_backlog

        backlog, age = pending_backlog(versions).first().backlog, oldest_pending_age(versions, now).first().age_secs
        quiet = self.clock() - self.last_write
        if not embed_due(backlog, age, quiet):
            return versions
        most = self.batch if quiet >= DEBOUNCE else 1
        taken = versions.where(F.col("status") == "pending").orderBy("created_at", "id").limit(most)
        done, failed = self.embed(taken)
        return finish_embed(versions, done, failed)


DEBOUNCE = 0.5


def embed_due(backlog: int, oldest_seconds: float | None, quiet_seconds: float, debounce: float = DEBOUNCE, longest: float = 60.0, most: int = 1000) -> bool:
    """Whether the embedding worker should run: things are quiet, or too much or too long has waited."""
    if backlog == 0:
        return False
    return quiet_seconds >= debounce or backlog > most or (oldest_seconds or 0.0) > longest


def missing_embeddings(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """Of (id, model_id) those that have no embedding yet: insert-if-absent."""
    return wanted.dropDuplicates(["id", "model_id"]).join(existing.select("id", "model_id"), ["id", "model_id"], "left_anti")


def submit(inode_id: str, seq: int, name: str, data: bytes, store, parent: str | None = None, status_note: str | None = None) -> dict:
    """Store the bytes of a write and return its marker; written to the queue it is the durable order to commit.

    ``status_note`` is kept with a write that was forced past its syntax check.
    """
    import hashlib
    import json

    import zstandard

    content = hashlib.sha256(data).hexdigest()
    packed = zstandard.ZstdCompressor(level=3).compress(data)
    if not store.exists(content):
        store.put(content, packed)
    version = hashlib.sha256(f"{inode_id}|{seq}|{content}".encode()).hexdigest()
    return {
        "seq": seq, "inode_id": inode_id, "parent_inode": parent, "name": name, "version_id": version, "content_hash": content, "blob_id": content, "size": len(data),
        "compressed_size": len(packed), "shared": True, "special_type": "syntax_error" if status_note else "generic", "special_data": json.dumps({"error": status_note} if status_note else {}),
    }


def embed_versions(versions: DataFrame, ast_nodes: DataFrame, embeddings: DataFrame, embed, model_id: str, dim: int, block_model: str, block_dim: int) -> DataFrame:
    """New embeddings of versions' texts and of their code blocks: those that are not there yet.

    ``embed`` makes a vector column of a text and a dimension column.
    """
    now = F.current_timestamp() if "created_at" not in versions.columns else F.col("created_at")
    texts = versions.where(F.col("search_text").isNotNull()).select("id", F.lit(model_id).alias("model_id"), F.lit(dim).alias("dim"), F.col("special_type").alias("plugin_type"), F.col("search_text").alias("_t"), now.alias("created_at"))
    of = versions.select(F.col("id").alias("version_id"), F.col("special_type").alias("plugin_type"), now.alias("created_at"))
    blocks = ast_nodes.drop("created_at").join(of, "version_id").select("id", F.lit(block_model).alias("model_id"), F.lit(block_dim).alias("dim"), "plugin_type", F.col("source").alias("_t"), "created_at")
    new = missing_embeddings(texts.unionByName(blocks), embeddings)
    made = new.withColumns({"embedding": embed(F.col("_t"), F.col("dim")), "consolidated": F.lit(False), "is_current": F.lit(True)})
    return conform(made, "embeddings")


def finish_embed(versions: DataFrame, done: DataFrame, failed: DataFrame) -> DataFrame:
    """versions with status clean for those embedded, failed and one more retry for those that weren't."""
    ok, bad = done.select("id", F.lit(True).alias("_ok")), failed.select("id", F.lit(True).alias("_bad"))
    joined = versions.join(ok, "id", "left").join(bad, "id", "left")
    return joined.withColumns(
        {"status": F.when(F.col("_bad"), "failed").when(F.col("_ok"), "clean").otherwise(F.col("status")), "retry_count": (F.col("retry_count") + F.coalesce("_bad", F.lit(False)).cast("int")).cast("int")}
    ).select(*versions.columns)


def set_search_text(versions: DataFrame, contents: DataFrame) -> DataFrame:
    """versions with the text derived from their bytes (id, data), or from their JSON where those are no text."""
    from palimpsest.functions.text import search_text

    joined = versions.drop("search_text").join(contents.select("id", "data"), "id", "left")
    return joined.withColumn("search_text", search_text(F.col("data"), F.col("special_data"))).drop("data").select(*versions.columns)
