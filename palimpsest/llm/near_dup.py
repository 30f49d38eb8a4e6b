"""Near-duplicate documents by bottom-k sketches from one hash function.

A text's set is its distinct word shingles. Its sketch is the ``k`` least hash
values of the set. Inverted lists generate overlaps: a list is kept for every
two retained values that follow each other in a sketch, so a list of a common
value is split by its neighbour. Two sets over the threshold have such a pair
in common: if sketches hold the sets whole, always, for at a similarity of 0.8
or more the differing values are too few to part all common ones. Long lists are
split by a third value; of sets held whole only four values against the same
and one more can share two values in a row and no three, so such pairs are
found by themselves: a set of five meets the sets of four it contains. If
sketches don't hold the sets whole, two share a pair with
a chance of all but 2e-12 at a similarity of exactly 0.8 (no two of 40 draws of
chance 0.8 in a row). The sketch of the union then filters (at least 16 of its
40 values are shared but for a chance of 2e-7), and the exact Jaccard
similarity of the full sets decides.

Texts without words (null, empty, white space) have an empty set, are linked
with nothing and stay. Rows with an equal set are one class before anything is
compared, so copies never multiply pairs. Rows with an equal id are one document:
it is linked with what any of its texts is, and its rows are kept or not
together. A row of a null id stands for itself: it is kept, and of no one's
component.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import kernels
from palimpsest.llm.components import Side, linked_groups, meets
from palimpsest.llm.spark_io import Scratch

SKETCH = 40
LEAST_SHARED = 16
#: Ids up to this many are broadcast to fetch their texts; more are joined by a shuffle.
BROADCAST_IDS = 200_000


def _sketch_batches(shingle: int, k: int):
    def run(batches):
        for batch in batches:
            data, offsets = kernels.utf8(batch.column(1))
            for lo, hi in kernels.chunks(offsets):
                part = offsets[lo : hi + 1]
                sizes, marks, sketches = [], [], []
                for run_ in kernels.text_sets(data[part[0] : part[-1]], part - part[0], shingle):
                    sizes.append(len(run_))
                    marks.append(hashlib.blake2b(run_.tobytes(), digest_size=16).digest() if len(run_) else None)
                    sketches.append(run_[:k])
                lengths = np.array([len(s) for s in sketches], dtype=np.int32)
                flat = np.concatenate(sketches) if sketches else np.zeros(0, dtype=np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), lists],
                    names=["id", "n", "mark", "sketch"],
                )

    return run


def _set_batches(shingle: int):
    def run(batches):
        for batch in batches:
            data, offsets = kernels.utf8(batch.column(1))
            for lo, hi in kernels.chunks(offsets):
                part = offsets[lo : hi + 1]
                packed = [s.tobytes() for s in kernels.text_sets(data[part[0] : part[-1]], part - part[0], shingle)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(packed, pa.binary())], names=["id", "payload"])

    return run


def _jaccard_batches(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                left, right = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
                keep.append(_similar(left, right, percent))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _links_within(percent: int, k: int, least_shared: int):
    """Links between seekers and sought (packed sorted sets) of different groups, a link for two groups at least."""

    def run(seekers, sought, side: Side, other_side: Side):
        mine, theirs = [np.frombuffer(p, np.int64) for p in seekers], [np.frombuffer(p, np.int64) for p in sought]
        sizes = np.array([len(t) for t in theirs])
        heads = [t[:k] for t in theirs]
        values = np.concatenate(heads) if heads else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(heads)), [len(h) for h in heads])
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        for i, own in enumerate(mine):
            lo, hi = np.searchsorted(values, own[:k], "left"), np.searchsorted(values, own[:k], "right")
            many = hi - lo
            at = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())
            shared = np.bincount(owner[at], minlength=len(theirs))
            # a sketch that holds its set whole shows the least overlap the similarity allows
            need = np.where(np.maximum(sizes, len(own)) <= k, -(-np.maximum(sizes, len(own)) * percent // 100), least_shared)
            near = (shared >= np.minimum(need, least_shared)) & (100 * np.minimum(sizes, len(own)) >= percent * np.maximum(sizes, len(own)))
            done = set()
            for j in np.flatnonzero(near & meets(side, i, other_side)):
                if other_side.groups[j] not in done and _similar(own, theirs[j], percent):
                    done.add(other_side.groups[j])
                    yield i, j

    return run


def _similar(left: np.ndarray, right: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have that Jaccard similarity."""
    both = np.concatenate([left, right])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, k: int = SKETCH, least_shared: int = LEAST_SHARED) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) of every row; ids are longs."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near_dup")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketched = scratch.write(texts.mapInArrow(kernels.tidy(_sketch_batches(shingle, k)), "id long, n long, mark binary, sketch array<long>"))

    worded = sketched.where("mark is not null and id is not null")
    reps = scratch.write(worded.groupBy("mark").agg(F.min("id").alias("id"), F.any_value("n").alias("n"), F.any_value("sketch").alias("sketch")))

    def runs(rows: DataFrame, length: int) -> DataFrame:
        """rows with ``runs``, all runs of that many neighbours of their sketches as structs of v0, v1 and so on."""
        parts = {f"v{i}": F.expr(f"slice(sketch, {i + 1}, greatest(size(sketch) - {length - 1}, 0))") for i in range(length)}
        return rows.withColumns(parts).withColumn("runs", F.arrays_zip(*parts)).drop("sketch", *parts)

    pairs_of = runs(reps.select("id", "sketch"), 2).select("id", F.explode("runs").alias("v"))
    postings = pairs_of.select(F.xxhash64("v.v0", "v.v1").alias("key"), "id")

    def finer(rows: DataFrame, _: DataFrame) -> DataFrame:
        """A list of two neighbours is split by the next; other runs of a sketch are left out before they are rows."""
        longer = runs(rows.join(reps.select("id", "sketch"), "id"), 3)
        own = F.filter("runs", lambda r: F.xxhash64(r["v0"], r["v1"]) == F.col("parent"))
        return longer.withColumn("v", F.explode(own)).withColumn("key", F.xxhash64("v.v0", "v.v1", "v.v2"))

    def sets_of(wanted: DataFrame) -> DataFrame:
        """(id, payload) of a table of ids: their full sets, made again from the texts."""
        few = wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        chosen = texts.join(F.broadcast(wanted) if few else wanted, "id", "left_semi")
        return chosen.mapInArrow(kernels.tidy(_set_batches(shingle)), "id long, payload binary")

    def verify(pairs: DataFrame) -> DataFrame:
        sketches = reps.select("id", "sketch", "n")
        near = (
            pairs.join(sketches.select(F.col("id").alias("a"), F.col("sketch").alias("sa"), F.col("n").alias("na")), "a")
            .join(sketches.select(F.col("id").alias("b"), F.col("sketch").alias("sb"), F.col("n").alias("nb")), "b")
            .where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
        )
        # the union's sketch: the k least of both, each counted as shared if both hold it
        union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
        hits = F.size(F.array_intersect(union, F.array_intersect("sa", "sb")))
        whole = (F.greatest("na", "nb") <= k) & (F.size(F.array_union("sa", "sb")) <= k)
        near = near.where(F.when(whole, hits * 100 >= F.size(union) * percent).otherwise(hits >= least_shared))
        near = scratch.write(near.select("a", "b"))
        if near.isEmpty():
            return near
        wanted = scratch.write(near.select("a").union(near.select("b")).distinct().withColumnRenamed("a", "id"))
        sets = scratch.write(sets_of(wanted))
        full = near.join(sets.select(F.col("id").alias("b"), F.col("payload").alias("mb")), "b").join(
            sets.select(F.col("id").alias("a"), F.col("payload").alias("ma")), "a"
        )
        return full.select("a", "b", "ma", "mb").mapInArrow(kernels.tidy(_jaccard_batches(percent)), "a long, b long")

    four = reps.where("n = 4").select(F.col("sketch").alias("values"), F.col("id").alias("s"))
    fives = reps.where("n = 5").select(F.explode(F.array(*(F.array(*(F.col("sketch")[i] for i in range(5) if i != gone)) for gone in range(5)))).alias("values"), F.col("id").alias("t"))
    contained = fives.join(four, "values").select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b"))
    # an id with several texts links the classes of them all
    several = worded.groupBy("id").agg(F.min("mark").alias("lo"), F.max("mark").alias("hi")).where("lo <> hi").select("id")
    own = worded.select("id", "mark").join(several, "id").distinct().join(reps.select("mark", F.col("id").alias("rep")), "mark").where("id <> rep")
    certain = own.select(F.least("id", "rep").alias("a"), F.greatest("id", "rep").alias("b"))
    groups = linked_groups(scratch, postings, finer, verify, sets_of, _links_within(percent, k, least_shared), contained, certain)
    classes = reps.select("mark", "id").join(groups, "id", "left").select("mark", F.coalesce("component", "id").alias("component"))
    linked = worded.select("id", "n", "mark").join(classes, "mark").select("id", "n", "component")
    alone = sketched.where("mark is null or id is null").select("id", "n", F.col("id").alias("component"))
    result = linked.union(alone).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("component").eqNullSafe(F.col("id")).alias("kept")
    )
    return scratch.last(result)
