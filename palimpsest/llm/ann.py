"""Approximate nearest neighbours with a forest of random-projection trees.

Each tree splits space by random directions at the median of a bounded sample of
vectors. All vectors are indexed: every one is dealt to its leaf in every tree.
A query searches all trees through one priority queue ordered by the margin to
the splits passed, takes leaves until enough vectors are expected in them, and
ranks the vectors found by their exact Euclidean distance in double precision.

How many are enough is found on the table itself: the true neighbours of some
probes, by a pass over all vectors, tell which share of the vectors must be
visited to find RECALL of them. So the share doesn't fall as the table grows,
unless its neighbours get easier to find.

A leaf is dealt to as many cells as its share of the vectors needs, so that a
cell has CELL_ROWS of them or so however large the table is, and queries are
dealt in blocks of QUERY_ROWS; a cell's vectors pass by its queries batch by
batch. The best of each query are kept per task, not per leaf.

Equal vectors are one entry of the index, of which at most as many members as
neighbours are wanted (and one for the query itself) can matter, the ones of
least id; so copies of a vector fill no leaf. Vectors that are null, zero, of
another length than the most common one, or hold null or non-finite components
take no part, nor do rows of a null id. Rows with an equal id and vector are
candidates each. A query gets all candidates found if there are fewer than asked.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm import kernels
from palimpsest.llm.spark_io import Scratch

TREES = 8
LEAF = 48
#: Vectors expected in the leaves a query visits, over all trees, at least.
SEARCH = 40_000
#: Share of the probes' true neighbours that a search must find, and the number of probes.
RECALL, PROBES = 0.95, 64
#: Bound of the sample the trees are fitted on.
SAMPLE = 20_000
#: Vectors of a cell, about, and queries that a cell has at most, about.
CELL_ROWS, QUERY_ROWS = 20_000, 50_000
#: Found rows a task holds before it keeps the best of each query alone.
HELD_ROWS = 1 << 20


@dataclass
class Forest:
    """Nodes of all trees in arrays. A child below 0 is leaf -child - 1."""

    planes: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    roots: np.ndarray
    share: np.ndarray  # of the vectors, by leaf

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        out = np.empty((len(vectors), len(self.roots)), dtype=np.int64)
        rows = np.arange(len(vectors))
        for t, root in enumerate(self.roots):
            at = np.full(len(vectors), root)
            while (inner := rows[at >= 0]).size:
                node = at[inner]
                side = (np.einsum("ij,ij->i", vectors[inner], self.planes[node]) >= self.offsets[node]).astype(np.int64)
                at[inner] = self.children[node, side]
            out[:, t] = -at - 1
        return out

    def needed(self, margins: np.ndarray, leaves: np.ndarray) -> np.ndarray:
        """The ``wanted`` above which a visit finds each vector, given its leaves in all trees."""
        before, got = np.full(len(self.share), np.inf), 0.0
        for leaf in self.visit(margins, np.inf):
            before[leaf] = got
            got += self.share[leaf]
        return before[leaves].min(axis=1)

    def visit(self, margins: np.ndarray, wanted: float) -> list[int]:
        """Leaves in order of the shared queue until a share ``wanted`` of all vectors is expected; at least one a tree."""
        heap = [(0.0, int(r)) for r in self.roots]
        heapq.heapify(heap)
        found, got = [], 0.0
        while heap and (got < wanted or heap[0][0] == 0.0):  # nothing lies between a query and the leaf it falls into
            worst, node = heapq.heappop(heap)
            if node < 0:
                found.append(-node - 1)
                got += self.share[-node - 1]
                continue
            gap = margins[node]
            near = int(gap >= 0)
            heapq.heappush(heap, (worst, int(self.children[node, near])))
            heapq.heappush(heap, (max(worst, abs(gap)), int(self.children[node, 1 - near])))
        return found


def grow(sample: np.ndarray, population: int, trees: int = TREES, leaf: int = LEAF, seed: int = 11) -> Forest:
    """Trees over a sample that stands for ``population`` vectors."""
    rng = np.random.default_rng(seed)
    least = max(4, leaf * len(sample) // max(1, population))
    planes, offsets, children, share, roots = [], [], [], [], []

    def build(rows: np.ndarray) -> int:
        stack = [(rows, None, 0)]
        root = None
        while stack:
            own, parent, side = stack.pop()
            node = None
            if len(own) > least:
                direction = rng.normal(size=sample.shape[1])
                direction /= np.linalg.norm(direction) or 1.0
                places = sample[own] @ direction
                cut = float(np.median(places))
                right = places >= cut
                if 0 < right.sum() < len(own):
                    node = len(planes)
                    planes.append(direction)
                    offsets.append(cut)
                    children.append([0, 0])
                    stack += [(own[~right], node, 0), (own[right], node, 1)]
            if node is None:
                share.append(len(own) / max(1, len(sample)))
                node = -len(share)
            if parent is None:
                root = node
            else:
                children[parent][side] = node
        return root

    for _ in range(trees):
        roots.append(build(np.arange(len(sample))))
    dim = sample.shape[1]
    return Forest(
        np.array(planes).reshape(-1, dim), np.array(offsets), np.array(children, dtype=np.int64).reshape(-1, 2), np.array(roots, dtype=np.int64), np.array(share)
    )


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def usable_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) of the rows that take part."""
    v = F.col("vector")
    good = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).where(
        F.col("id").isNotNull()
        & v.isNotNull()
        & (F.size(v) > 0)
        & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists(v, lambda x: x != 0)
    )
    usual = good.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).select("n").first()
    return good.where(F.size("vector") == (usual.n if usual else 0))


def _share_for(reps: DataFrame, forest: Forest, shared, slot, count: int, k: int) -> float:
    """The share of all vectors to visit that finds RECALL of the true neighbours of the probes."""
    # the other end of the order the sample is taken from
    thin = reps.where(slot >= F.lit((1 << 20) * (1 - 4.0 * PROBES / count))) if count > 4 * PROBES else reps
    probes = np.array([r.vector for r in thin.orderBy(slot.desc(), "rep").limit(PROBES).collect()], dtype=np.float64)
    asked = reps.sparkSession.sparkContext.broadcast(probes)

    def closest(batches) -> Iterator[pa.RecordBatch]:
        """The nearest of each probe in a part of the table, and their leaves."""
        own, held = shared.value, None
        for batch in batches:
            vectors = _matrix(batch.column(1))
            for lo in range(0, len(vectors), 4096):
                part = vectors[lo : lo + 4096]
                score = np.stack([((part - p) ** 2).sum(1) for p in asked.value])
                top = np.argsort(score, 1, kind="stable")[:, : k + 1]
                score, near = np.take_along_axis(score, top, 1), part[top]
                if held is not None:
                    score, near = np.concatenate([held[0], score], 1), np.concatenate([held[1], near], 1)
                    top = np.argsort(score, 1, kind="stable")[:, : k + 1]
                    score, near = np.take_along_axis(score, top, 1), np.take_along_axis(near, top[..., None], 1)
                held = score, near
        if held is not None:
            scores, near = held
            leaves = own.leaves(near.reshape(-1, near.shape[2]))
            names = ["probe", "score", "leaves"]
            columns = [pa.array(np.repeat(np.arange(len(scores)), scores.shape[1]), pa.int64()), pa.array(scores.reshape(-1)), pa.array(leaves.tolist(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    found = reps.select("rep", "vector").mapInArrow(kernels.tidy(closest), "probe long, score double, leaves array<long>")
    order = Window.partitionBy("probe").orderBy("score")
    # the first is the probe itself
    best = found.withColumn("n", F.row_number().over(order)).where((F.col("n") > 1) & (F.col("n") <= k + 1)).select("probe", "leaves").collect()
    by_probe: dict[int, list] = {}
    for r in best:
        by_probe.setdefault(r.probe, []).append(r.leaves)
    margins = probes @ forest.planes.T - forest.offsets if len(forest.planes) else np.zeros((len(probes), 0))
    needs = [forest.needed(margins[p], np.array(leaves)) for p, leaves in by_probe.items()]
    if not needs:
        return 0.0
    needs = np.sort(np.concatenate(needs))
    return float(np.nextafter(needs[min(len(needs), int(np.ceil(RECALL * len(needs)))) - 1], np.inf))


def closest_of(names: np.ndarray, asked: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, distance) of the k closest vectors to each query, by exact distance and then by id.

    A product of matrices tells which can be among them; of these the distance is
    worked out from the differences.
    """
    out = []
    lengths = (vectors * vectors).sum(1)
    for lo in range(0, len(asked), max(1, (1 << 21) // max(1, len(ids)))):
        own = asked[lo : lo + max(1, (1 << 21) // max(1, len(ids)))]
        with np.errstate(over="ignore", invalid="ignore"):
            near = lengths[None, :] - 2 * (own @ vectors.T)
            room = 1e-9 * (1 + lengths.max() + (own * own).sum(1))  # what rounding may hide
            if not np.isfinite(near).all() or not np.isfinite(room).all():  # squares beyond double precision
                near = np.stack([((vectors - v) ** 2).sum(1) for v in own])
                room = np.zeros(len(own))
        last = np.partition(near, k - 1, axis=1)[:, k - 1] if len(ids) > k else np.full(len(own), np.inf)
        row, col = np.nonzero(near <= (last + room)[:, None])
        gap = vectors[col] - own[row]
        out.append((names[lo + row], ids[col], np.sqrt((gap * gap).sum(1))))
    return best_of(out, k)


def best_of(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query among all that was found, each id once."""
    query, ids, score = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((ids, score, query))
    query, ids, score = query[order], ids[order], score[order]
    # an id found again has the same distance, so it stands beside itself
    again = np.concatenate([[False], (query[1:] == query[:-1]) & (ids[1:] == ids[:-1])])
    query, ids, score = query[~again], ids[~again], score[~again]
    head = np.concatenate([[True], query[1:] != query[:-1]])
    nth = np.arange(len(query)) - np.maximum.accumulate(np.where(head, np.arange(len(query)), 0))
    return query[nth < k], ids[nth < k], score[nth < k]


def nearest(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = 10, trees: int = TREES, leaf: int = LEAF, search: int = SEARCH, sample_rows: int = SAMPLE) -> DataFrame:
    """(query_id, rank, id_col, score) for queries whose id is divisible by ``every``, against all other rows."""
    spark = df.sparkSession
    scratch = Scratch(spark, "ann")
    rows = usable_vectors(df, id_col, vector_col)
    alike = Window.partitionBy("vector").orderBy("id")
    members = scratch.write(
        rows.select("id", "vector", F.row_number().over(alike).alias("nth"), F.first("id").over(alike).alias("rep")).where(F.col("nth") <= k + 1)
    )
    reps = members.where("nth = 1").select("rep", "vector")
    queries = rows.where(F.col("id") % every == 0)
    count = reps.count()
    empty = "query_id long, rank int, " + f"{id_col} long, score double"
    if not count:
        return spark.createDataFrame([], empty)
    slot = F.pmod(F.xxhash64("rep"), F.lit(1 << 20))
    picked = reps.where(slot <= F.lit(float(1 << 20) * 1.2 * sample_rows / count)).orderBy(slot, "rep").limit(sample_rows)
    sample = np.array([r.vector for r in picked.select("vector").toLocalIterator()], dtype=np.float64)
    forest = grow(sample, count, trees, leaf)
    shared = spark.sparkContext.broadcast(forest)
    wanted = max(search / count, _share_for(reps, forest, shared, slot, count, k) if search < trees * count else 0.0)
    kind = reps.schema["vector"].dataType.simpleString()
    placed = f"cell long, asks boolean, id long, vector {kind}"
    asked_rows = queries.count()
    slices = np.maximum(1, np.ceil(forest.share * count / CELL_ROWS)).astype(np.int64)  # of each leaf
    first = np.concatenate([[0], np.cumsum(slices)])
    blocks = max(1, -(-asked_rows // QUERY_ROWS))

    def spread(ids: np.ndarray, salt: int, among) -> np.ndarray:
        return (kernels.mix64(ids.astype(np.uint64) + np.uint64(salt)) % np.asarray(among, dtype=np.uint64)).astype(np.int64)

    def place(batch: pa.RecordBatch, rows: np.ndarray, cells: np.ndarray, asks: bool) -> pa.RecordBatch:
        at = pa.array(rows)
        return pa.RecordBatch.from_arrays([pa.array(cells), pa.array(np.full(len(rows), asks)), batch.column(0).take(at), batch.column(1).take(at)], names=["cell", "asks", "id", "vector"])

    def deal(batches) -> Iterator[pa.RecordBatch]:
        """A vector goes to one cell of its leaf in each tree, once for every block of queries."""
        own = shared.value
        for batch in batches:
            if batch.num_rows:
                leaves = own.leaves(_matrix(batch.column(1)))
                cells = first[leaves] + spread(np.asarray(batch.column(0))[:, None], 1, slices[leaves])
                whole = (cells.reshape(-1)[:, None] * blocks + np.arange(blocks)).reshape(-1)
                yield place(batch, np.repeat(np.arange(batch.num_rows), leaves.shape[1] * blocks), whole, False)

    def ask(batches) -> Iterator[pa.RecordBatch]:
        """A query goes to all cells of the leaves it visits, in its block."""
        own = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                margins = _matrix(batch.column(1)) @ own.planes.T - own.offsets if len(own.planes) else np.zeros((batch.num_rows, 0))
                visits = [np.array(own.visit(m, wanted), dtype=np.int64) for m in margins]
                cells = [np.concatenate([np.arange(first[leaf], first[leaf + 1]) for leaf in v]) for v in visits]
                rows = np.repeat(np.arange(len(cells)), [len(c) for c in cells])
                yield place(batch, rows, np.concatenate(cells) * blocks + spread(np.asarray(batch.column(0)), 2, blocks)[rows], True)

    def search_cells(batches) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell, queries first; a cell may run over several batches."""
        cell, names, asked_, held, size = None, [], [], [], 0
        for batch in batches:
            own = np.asarray(batch.column(0))
            if not len(own):
                continue
            asks = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), dtype=bool)
            ids, vectors = np.asarray(batch.column(2)), _matrix(batch.column(3))
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [len(own)]])
            for lo, hi in zip(cuts, cuts[1:]):
                if own[lo] != cell:
                    cell, names, asked_ = own[lo], [], []
                middle = lo + int(asks[lo:hi].sum())
                if middle > lo:
                    names.append(ids[lo:middle])
                    asked_.append(vectors[lo:middle])
                if middle < hi and names:
                    names, asked_ = [np.concatenate(names)], [np.concatenate(asked_)]
                    held.append(closest_of(names[0], asked_[0], ids[middle:hi], vectors[middle:hi], k + 1))
                    size += len(held[-1][0])
            if size > HELD_ROWS:
                held = [best_of(held, k + 1)]
                size = len(held[0][0])
                if size > HELD_ROWS // 2:  # many queries: what is found so far goes out
                    yield told(held[0])
                    held, size = [], 0
        if held:
            yield told(best_of(held, k + 1))

    def told(found) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["query", "rep", "score"])

    # queries with the same vector share one search
    asked = scratch.write(queries.join(reps.withColumnRenamed("vector", "v"), F.col("vector") == F.col("v")).select(F.col("id").alias("query_id"), "rep"))
    distinct = asked.select("rep").distinct().join(reps, "rep").select("rep", "vector")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = reps.select("rep", "vector").mapInArrow(kernels.tidy(deal), placed).unionByName(distinct.mapInArrow(kernels.tidy(ask), placed))
    scored = cells.repartition(parts, "cell").sortWithinPartitions("cell", F.desc("asks")).mapInArrow(kernels.tidy(search_cells), "query long, rep long, score double")
    # a vector found in several trees has one score
    scored = scored.groupBy("query", "rep").agg(F.min("score").alias("score"))
    near = Window.partitionBy("query").orderBy("score", "rep")
    best = scored.withColumn("n", F.row_number().over(near)).where(F.col("n") <= k + 1).drop("n")
    expanded = (
        asked.withColumnRenamed("rep", "query").join(best, "query").join(members.select("rep", "id"), "rep").where(F.col("id") != F.col("query_id"))
    )
    last = Window.partitionBy("query_id").orderBy("score", "id")
    ranked = expanded.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
    return scratch.last(ranked.select("query_id", "rank", F.col("id").alias(id_col), "score"))
