"""The registry of documented symbols: what the code has, what the registry says, what documents link to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as fn
from palimpsest.functions.code import symbols_of

LINK = r"symbol://([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})"


def scan_symbols(files: DataFrame) -> DataFrame:
    """(path, kind, name, line, id, doc_summary) of source files (path, source)."""
    return files.select("path", F.explode(symbols_of("source")).alias("s")).select("path", "s.*")


def scan_links(documents: DataFrame) -> DataFrame:
    """(path, id) of the symbols that documents (path, text) link to, each occurrence once."""
    return documents.select("path", F.explode(F.regexp_extract_all("text", F.lit(LINK))).alias("id")).select("path", F.lower("id").alias("id"))


def issues(symbols: DataFrame, registry: DataFrame, links: DataFrame) -> DataFrame:
    """(class, location, line, name, detail): MissingId, DuplicateId, StaleCache and DeadLink, in that stable order."""
    with_id = symbols.where("id is not null")
    missing = symbols.where("id is null").select(F.lit("MissingId").alias("class"), F.col("path").alias("location"), "line", "name", F.lit(None).cast("string").alias("detail"))
    places = with_id.groupBy("id").agg(F.count("*").alias("n"), F.min(F.struct("path", "line")).alias("at"), F.array_sort(F.collect_list(F.concat_ws(":", "path", F.col("line").cast("string")))).alias("all"))
    double = places.where("n > 1").select(F.lit("DuplicateId").alias("class"), F.col("at.path").alias("location"), F.col("at.line").alias("line"), F.col("id").alias("name"), F.array_join("all", ",").alias("detail"))
    live = registry.where(~F.col("tombstoned")).join(places.where("n = 1"), "id")
    moved = (fn.normalize_path(F.col("last_known_file")) != fn.normalize_path(F.col("at.path"))) | (F.col("last_known_line") != F.col("at.line"))
    stale = live.where(moved).select(F.lit("StaleCache").alias("class"), F.col("at.path").alias("location"), F.col("at.line").alias("line"), F.col("id").alias("name"), F.concat_ws(":", "last_known_file", F.col("last_known_line").cast("string")).alias("detail"))
    known = places.select("id").join(registry.where("tombstoned").select("id"), "id", "left_anti")
    dead = links.join(known, "id", "left_anti").select(F.lit("DeadLink").alias("class"), F.col("path").alias("location"), F.lit(0).alias("line"), F.col("id").alias("name"), F.lit(None).cast("string").alias("detail"))
    rank = F.array_position(F.array(*(F.lit(c) for c in ("MissingId", "DuplicateId", "StaleCache", "DeadLink"))), F.col("class"))
    return missing.union(double).union(stale).union(dead).orderBy(rank, "location", "line", "name")


def resolve(registry: DataFrame, symbols: DataFrame, symbol_id: str) -> DataFrame:
    """(id, file, line, summary, tombstoned): a tombstone's saved summary, else where the code has it now."""
    own = registry.where(F.col("id") == symbol_id)
    now = symbols.where(F.col("id") == symbol_id).orderBy("path", "line").limit(1).select(F.col("id"), F.col("path").alias("_p"), F.col("line").alias("_l"), F.col("doc_summary").alias("_d"))
    both = own.select("id", "tombstoned", "last_known_file", "last_known_line", "doc_summary").join(now, "id", "full_outer")
    gone = F.coalesce("tombstoned", F.lit(False))
    pick = lambda a, b: F.when(gone, F.col(a)).otherwise(F.col(b))
    return both.where(gone | F.col("_p").isNotNull()).select("id", pick("last_known_file", "_p").alias("file"), pick("last_known_line", "_l").alias("line"), pick("doc_summary", "_d").alias("summary"), gone.alias("tombstoned"))


def generate_registry(symbols: DataFrame, previous: DataFrame) -> DataFrame:
    """Registry rows of all symbols with an id, and tombstones of those that went, by (crate, name, id)."""
    now = symbols.where("id is not null").groupBy("id").agg(F.min_by(F.struct("path", "line", "kind", "name", "doc_summary"), F.struct("path", "line")).alias("s"))
    fresh = now.select("id", fn.crate_of(F.col("s.path")).alias("crate_name"), "s.kind", "s.name", F.col("s.path").alias("last_known_file"), F.col("s.line").alias("last_known_line"), "s.doc_summary", F.lit(False).alias("tombstoned"), F.lit(None).cast("string").alias("tombstoned_reason"))
    gone = previous.join(now.select("id"), "id", "left_anti").withColumns({"tombstoned": F.lit(True), "tombstoned_reason": F.coalesce("tombstoned_reason", F.lit("no longer in the code"))})
    return fresh.unionByName(gone.select(*fresh.columns)).orderBy("crate_name", "name", "id")
