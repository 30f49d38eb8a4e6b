"""Vector search: exact over what is buffered, routed by centroids over what is consolidated.

Top-k is TakeOrderedAndProject or a windowed group limit, so no more than k rows
a task are exchanged. The centroids of a route are at most ``probes`` rows, a
proven bound, and are broadcast.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.vector import cosine_distance

PROBES = 10


def vector_literal(vector: list[float]) -> Column:
    return F.lit([float(x) for x in vector])


def nearest(rows: DataFrame, vector: list[float], k: int, vector_col: str = "embedding", id_col: str = "id") -> DataFrame:
    """rows with ``distance``, the k of least cosine distance; ties by id."""
    return rows.withColumn("distance", cosine_distance(F.col(vector_col), vector_literal(vector))).orderBy("distance", id_col).limit(k)


def active(centroids: DataFrame, plugin_type: str | None = None, model_id: str | None = None, dim: int | None = None) -> DataFrame:
    found = centroids.where("is_active")
    for column, value in (("plugin_type", plugin_type), ("model_id", model_id), ("dim", dim)):
        if value is not None:
            found = found.where(F.col(column) == value)
    return found


def nearest_centroids(centroids: DataFrame, vector: list[float], k: int = PROBES) -> DataFrame:
    return nearest(active(centroids), vector, k, "centroid")


def search_via_centroids(centroids: DataFrame, members: DataFrame, embeddings: DataFrame, vector: list[float], k: int, probes: int = PROBES, current_only: bool = False) -> DataFrame:
    """(id, distance): the k nearest members of the nearest centroids, by their own exact distances."""
    routes = F.broadcast(nearest_centroids(centroids, vector, probes).select(F.col("id").alias("centroid_id")))
    pool = members.join(routes, "centroid_id").select(F.col("member_id").alias("id")).distinct()
    own = embeddings.where("is_current") if current_only else embeddings
    return nearest(own.join(pool, "id"), vector, k).select("id", "distance")


def search_buffered(embeddings: DataFrame, vector: list[float], k: int, current_only: bool = False) -> DataFrame:
    """(id, distance): the k nearest of what no centroid has taken yet."""
    own = embeddings.where(~F.col("consolidated"))
    return nearest(own.where("is_current") if current_only else own, vector, k).select("id", "distance")


def merge_hits(crystallised: DataFrame, buffered: DataFrame, k: int) -> DataFrame:
    """(id, distance, source): each id once, at its least distance, the crystallised hit first among equals."""
    both = crystallised.select("id", "distance", F.lit("crystallised").alias("source"), F.lit(0).alias("_r")).union(
        buffered.select("id", "distance", F.lit("buffered").alias("source"), F.lit(1).alias("_r"))
    )
    best = Window.partitionBy("id").orderBy("distance", "_r")
    return both.withColumn("_n", F.row_number().over(best)).where("_n = 1").orderBy("distance", "id").limit(k).select("id", "distance", "source")


def search_by_concept(centroids: DataFrame, members: DataFrame, embeddings: DataFrame, vector: list[float], k: int = 10, probes: int = PROBES, current_only: bool = False) -> DataFrame:
    """Both searches, merged: (id, distance, source)."""
    found = search_via_centroids(centroids, members, embeddings.where("consolidated"), vector, k, probes, current_only)
    return merge_hits(found, search_buffered(embeddings, vector, k, current_only), k)


def search_semantic(centroids: DataFrame, members: DataFrame, embeddings: DataFrame, query: str | None = None, query_vector: list[float] | None = None, embed=None, limit: int = 10, type_filter: str = "generic") -> DataFrame:
    """By vector, or by text through ``embed``; one of them must be given, the vector wins."""
    if query_vector is None:
        if query is None or embed is None:
            raise ValueError("a query or a query vector is needed")
        query_vector = embed(query)
    dim = len(query_vector)
    own = embeddings.where((F.col("plugin_type") == type_filter) & (F.col("dim") == dim))
    return search_by_concept(active(centroids, type_filter, dim=dim), members, own, query_vector, limit)


def search_functions(centroids: DataFrame, members: DataFrame, embeddings: DataFrame, ast_nodes: DataFrame, query_vector: list[float], language: str = "rust", kind: str | None = None, limit: int = 10) -> DataFrame:
    """Current code blocks near a vector, of one kind if it is given."""
    nodes = ast_nodes if kind is None else ast_nodes.where(F.col("kind") == kind)
    own = embeddings.where((F.col("plugin_type") == language) & (F.col("dim") == len(query_vector))).join(nodes.select("id"), "id", "left_semi")
    hits = search_by_concept(active(centroids, language, dim=len(query_vector)), members, own, query_vector, limit, current_only=True)
    return F.broadcast(hits).join(nodes, "id").select("id", "kind", "name", "start_line", "end_line", "distance", "source")


def browse_concepts(centroids: DataFrame, thresholds: DataFrame, type_filter: str = "generic", limit: int = 10) -> DataFrame:
    """Active centroids, the largest first; calibrated combinations where there are none, marked as such."""
    own = active(centroids, None if type_filter == "generic" else type_filter)
    shown = own.select("id", "plugin_type", "model_id", "label", "member_count", F.lit(False).alias("calibrated_only")).orderBy(F.desc("member_count"), "id").limit(limit)
    if not own.isEmpty():
        return shown
    null = F.lit(None).cast("string")
    return thresholds.select(null.alias("id"), "plugin_type", "model_id", null.alias("label"), F.lit(None).cast("long").alias("member_count"), F.lit(True).alias("calibrated_only")).orderBy("plugin_type", "model_id").limit(limit)


def flat_search(embeddings: DataFrame, versions: DataFrame, inodes: DataFrame, backends: DataFrame, vector: list[float], k: int = 20) -> DataFrame:
    """(id, name, backend, similarity) of clean versions, by similarity."""
    clean = versions.where(F.col("status") == "clean").select(F.col("id"), "inode_id")
    named = inodes.select(F.col("id").alias("inode_id"), "name", "backend_id")
    hits = nearest(embeddings.join(clean, "id").join(named, "inode_id"), vector, k)
    return (
        hits.join(backends.select(F.col("id").alias("backend_id"), F.col("name").alias("backend")), "backend_id", "left")
        .select("id", "name", "backend", (1 - F.col("distance")).alias("similarity")).orderBy(F.desc("similarity"), "id")
    )


#: Rows of a block: two of them and their distances to each other are a task's work.
BLOCK = 2048


def block_pairs(rows: DataFrame, keys: list[str], block: int = BLOCK, id_col: str = "id") -> DataFrame:
    """rows by (keys.., row, col) with ``first``: every two blocks of a group meet once, as the rows of one and of the other.

    Blocks are dealt by a hash of the id, as many as the group's rows need, so a
    task holds two of them however large a group is, and no pairs are shuffled.
    """
    many = rows.groupBy(*keys).agg(F.ceil(F.count("*") / block).alias("_blocks"))
    placed = rows.join(many, keys).withColumn("_own", F.pmod(F.xxhash64(id_col), F.col("_blocks")))
    one = placed.withColumns({"row": F.col("_own"), "col": F.explode(F.sequence(F.col("_own"), F.col("_blocks") - 1)), "first": F.lit(True)})
    other = placed.withColumns({"col": F.col("_own"), "row": F.explode(F.sequence(F.lit(0).cast("long"), F.col("_own"))), "first": F.lit(False)})
    return one.unionByName(other).drop("_own", "_blocks")


def mergeable_pairs(centroids: DataFrame, threshold: float, limit: int = 50, block: int = BLOCK) -> DataFrame:
    """(a, b, distance): the closest pairs of active centroids of one combination below a threshold.

    Blocks of centroids are compared by a product of matrices; of each only its
    closest pairs are kept, as many as are asked for.
    """
    keys = ["plugin_type", "model_id", "dim"]
    own = active(centroids).select("id", *keys, "centroid")

    def closest(rows: pd.DataFrame) -> pd.DataFrame:
        sides = [rows[rows["first"]].sort_values("id"), rows[~rows["first"]].sort_values("id")]
        names = [side["id"].to_numpy() for side in sides]
        vectors = [np.stack(side["centroid"].to_list()).astype(np.float64) for side in sides]
        gap = cosine_distances(*vectors)
        gap[names[0][:, None] >= names[1][None, :] if rows["row"].iloc[0] == rows["col"].iloc[0] else np.zeros(gap.shape, dtype=bool)] = np.inf
        near = np.flatnonzero(gap.ravel() < threshold)
        if len(near) > limit:  # with all that tie with the last
            near = near[gap.ravel()[near] <= np.partition(gap.ravel()[near], limit - 1)[limit - 1]]
        i, j = np.unravel_index(near, gap.shape)
        x, y = names[0][i], names[1][j]
        return pd.DataFrame({"a": np.where(x < y, x, y), "b": np.where(x < y, y, x), "distance": gap[i, j]})

    kind = centroids.schema["id"].dataType.simpleString()
    pairs = block_pairs(own, keys, block).groupBy(*keys, "row", "col").applyInPandas(closest, f"a {kind}, b {kind}, distance double")
    return pairs.orderBy("distance", "a", "b").limit(limit)


def nearest_distances(embeddings: DataFrame, block: int = BLOCK) -> DataFrame:
    """(plugin_type, model_id, id, distance) of every vector to the nearest other of its combination and dimension."""
    keys = ["plugin_type", "model_id", "dim"]
    own = embeddings.withColumn("dim", F.size("embedding")).select("id", *keys, "embedding")
    kind = embeddings.schema["id"].dataType.simpleString()

    def closest(rows: pd.DataFrame) -> pd.DataFrame:
        sides = [rows[rows["first"]], rows[~rows["first"]]]
        names = [side["id"].to_numpy() for side in sides]
        gap = cosine_distances(*(np.stack(side["embedding"].to_list()).astype(np.float64) for side in sides))
        gap[names[0][:, None] == names[1][None, :]] = np.inf
        found = pd.DataFrame({"id": np.concatenate(names), "distance": np.concatenate([gap.min(1), gap.min(0)])})
        found = found[np.isfinite(found["distance"])]
        return found.assign(plugin_type=rows["plugin_type"].iloc[0], model_id=rows["model_id"].iloc[0])[["plugin_type", "model_id", "id", "distance"]]

    parts = block_pairs(own, keys, block).groupBy(*keys, "row", "col").applyInPandas(closest, f"plugin_type string, model_id string, id {kind}, distance double")
    return parts.groupBy("plugin_type", "model_id", "id").agg(F.min("distance").alias("distance"))


def cosine_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Between all rows of two matrices, 1 where it is undefined."""
    lengths = [np.sqrt((m * m).sum(1)) for m in (x, y)]
    whole = lengths[0][:, None] * lengths[1][None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(whole == 0, 1.0, np.clip(1 - (x @ y.T) / whole, 0.0, 2.0))
