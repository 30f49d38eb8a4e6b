"""The tables of the model, their keys and checks of a catalogue against them.

The four vector families of the relational model are one table each here, with
the dimension and the model as columns: partition pruning replaces the choice of
a table, and a dimension is data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DDL = {
    "storage_backends": "id string, name string, backend_type string, config string, is_virtual boolean, priority int",
    "inode_registry": (
        "id string, ino long, parent_id string, name string, is_dir boolean, uid int, gid int, mode int, size long, nlink int, created_at timestamp, "
        "updated_at timestamp, current_blob_id string, backend_id string, on_prem boolean, compression_level short, versioning_enabled boolean, rdev long, "
        "atime timestamp, mtime timestamp, dedup_enabled boolean"
    ),
    "file_versions": (
        "id string, inode_id string, version_number int, created_at timestamp, blob_id string, size long, compressed_size long, external_path string, "
        "content_hash string, cid string, ipfs_pinned boolean, special_type string, special_data string, status string, retry_count int, "
        "parent_version_id string, search_text string"
    ),
    "blobs": "blob_id string, content_hash string, backend_id string, size long, compressed_size long, created_at timestamp, shared boolean",
    "embedding_models": "id string, name string, dimensions int, version string, is_local boolean, is_default boolean",
    "embeddings": "id string, model_id string, dim int, plugin_type string, embedding array<float>, consolidated boolean, is_current boolean, created_at timestamp",
    "ast_nodes": "id string, version_id string, kind string, name string, start_line int, end_line int, source string, content_hash string, created_at timestamp",
    "consolidation_thresholds": (
        "plugin_type string, model_id string, backlog_threshold long, idle_before_sleep_secs int, max_wait_secs int, join_threshold double, "
        "split_variance_threshold double, max_members_per_centroid long, batch_size int"
    ),
    "concept_centroids": (
        "id string, plugin_type string, model_id string, dim int, centroid array<float>, m2 double, member_count long, label string, is_active boolean, "
        "merged_into string, created_at timestamp, last_consolidated_at timestamp"
    ),
    "centroid_members": "centroid_id string, member_id string, distance double, consolidated_at timestamp",
    "lexical_nodes": "id string, lemma string, pos string, language string, external_ref string",
    "lexical_edges": "from_id string, to_id string, relation string",
    "word_centroid_links": "lexical_node_id string, centroid_id string, weight double",
    "pending_markers": (
        "seq long, inode_id string, parent_inode string, name string, version_id string, content_hash string, blob_id string, size long, compressed_size long, "
        "shared boolean, external_path string, mode int, uid int, gid int, special_type string, special_data string, "
        "ast_nodes array<struct<kind:string,name:string,start_line:int,end_line:int,source:string,content_hash:string>>, created_at string"
    ),
    "symbols": (
        "id string, crate_name string, kind string, name string, last_known_file string, last_known_line int, doc_summary string, tombstoned boolean, "
        "tombstoned_reason string"
    ),
}

CORE_TABLES = ("storage_backends", "inode_registry", "file_versions", "blobs")
PROCESSING_STATUS = ("clean", "pending", "processing", "failed", "syntax_error")
LEXICAL_RELATIONS = ("synonym", "hypernym", "hyponym", "meronym")
#: Columns that must never come back: sharing is counted from references, not stored.
FORBIDDEN_COLUMNS = {"blobs": ("refcount",)}
DEFAULTS = {
    "file_versions": {"special_type": "generic", "special_data": "{}", "status": "pending", "retry_count": 0},
    "inode_registry": {"uid": 1000, "gid": 1000, "mode": 33188, "compression_level": 3, "rdev": 0, "dedup_enabled": True, "on_prem": True, "versioning_enabled": True},
    "blobs": {"shared": True},
    "consolidation_thresholds": {
        "backlog_threshold": 500, "idle_before_sleep_secs": 1800, "max_wait_secs": 86400, "split_variance_threshold": 0.15, "max_members_per_centroid": 5000, "batch_size": 200,
    },
}


def schema_of(table: str) -> T.StructType:
    return T._parse_datatype_string(_DDL[table])


def tables() -> list[str]:
    return list(_DDL)


def conform(df: DataFrame, table: str) -> DataFrame:
    """df with the columns of ``table`` in order: missing ones by default or null, others dropped."""
    given = DEFAULTS.get(table, {})
    columns = []
    for field in schema_of(table):
        if field.name in df.columns:
            value = F.col(field.name)
            value = F.coalesce(value, F.lit(given[field.name])) if field.name in given else value
        else:
            value = F.lit(given.get(field.name))
        columns.append(value.cast(field.dataType).alias(field.name))
    return df.select(*columns)


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def column_exists(df: DataFrame, name: str) -> bool:
    return name in df.columns


def check_schema(found: dict[str, DataFrame]) -> list[str]:
    """What is wrong with a catalogue: missing core tables, missing columns, forbidden ones; empty if nothing."""
    problems = [f"missing table {t}" for t in CORE_TABLES if t not in found]
    for table, df in found.items():
        if table in _DDL:
            problems += [f"missing column {table}.{f.name}" for f in schema_of(table) if f.name not in df.columns]
        problems += [f"forbidden column {table}.{c}" for c in FORBIDDEN_COLUMNS.get(table, ()) if c in df.columns]
    return problems
