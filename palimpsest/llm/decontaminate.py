"""Benchmark decontamination by size-partitioned containment search.

Items are parted by the size of their sets of five-word shingles (powers of
two). In each part an item is sketched by its least hash values, as many as a
fifth of the part's largest size and eight more. A text that holds four fifths
of an item's shingles lacks a fifth at most, so it holds a known number of the
sketch: texts that do are candidates, whatever their length. Exact containment
of the full shingle sets decides.

Items are broadcast in blocks of bounded size, so a benchmark of any size is
searched whole. One block is one pass over the texts. With more, each pass tells
what it found by a digest of the text, as that depends on nothing else, and the
findings meet the documents once: texts are read again, but never written.
Null and empty texts and items without words match nothing; an item or text of
fewer than five words has its whole sequence as its shingle. Repeated items match
each for itself, repeated documents are found each. Items of a null id are left
out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import kernels
from palimpsest.llm.spark_io import Scratch, free_name, with_fields

SHINGLE = 5
PERCENT = 80
SPARE = 8
#: Bound of one broadcast block of items, in bytes of text.
BLOCK_BYTES = 8 << 20
#: Texts with findings up to this many are broadcast to the documents; more are joined by a shuffle.
BROADCAST_FOUND = 200_000


@dataclass
class ItemIndex:
    ids: list[int]
    sets: list[np.ndarray]
    least: np.ndarray  # sketch values a text must hold
    values: np.ndarray  # sketch values, sorted, with the item of each
    owners: np.ndarray

    def search(self, data: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
        """The items contained in each text."""
        found: list[list[int]] = [[] for _ in range(len(offsets) - 1)]
        if not len(self.values):
            return found
        starts, ends, first = kernels.word_spans(data, offsets)
        hashes, owner = kernels.shingle_hashes(kernels.span_hashes(data, starts, ends), first, SHINGLE)
        hashes = hashes.view(np.int64)
        lo = np.searchsorted(self.values, hashes, side="left")
        lo_in = np.minimum(lo, len(self.values) - 1)
        hit = np.flatnonzero(self.values[lo_in] == hashes)
        if not len(hit):
            return found
        many = np.searchsorted(self.values, hashes[hit], side="right") - lo[hit]
        at = np.repeat(lo[hit] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        triples = np.unique(np.stack([np.repeat(owner[hit], many), self.owners[at], at]), axis=1)
        pairs, count = np.unique(triples[:2], axis=1, return_counts=True)
        bounds = np.searchsorted(owner, np.arange(len(offsets)))
        for text, item in pairs[:, count >= self.least[pairs[1]]].T.tolist():
            own = np.unique(hashes[bounds[text] : bounds[text + 1]])
            inside = int(np.isin(self.sets[item], own, assume_unique=True).sum())
            if 100 * inside >= PERCENT * len(self.sets[item]):
                found[text].append(self.ids[item])
        return found


def build_index(ids: list[int], texts: list[bytes]) -> ItemIndex:
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    sets = list(kernels.text_sets(data, offsets, SHINGLE))
    values, owners, least = [], [], np.zeros(len(sets), dtype=np.int64)
    for i, members in enumerate(sets):
        n = len(members)
        if not n:
            continue
        largest = 1 << (n - 1).bit_length()  # of its part
        lacking = n - (-(-PERCENT * n // 100))
        sketch = members[: largest * (100 - PERCENT) // 100 + SPARE]
        least[i] = max(1, len(sketch) - lacking)
        values.append(sketch)
        owners.append(np.full(len(sketch), i))
    flat = np.concatenate(values) if values else np.zeros(0, dtype=np.int64)
    own = np.concatenate(owners) if owners else np.zeros(0, dtype=np.int64)
    order = np.lexsort((own, flat))
    return ItemIndex(ids, sets, least, flat[order], own[order])


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[ItemIndex]:
    """Indexes over the items, each of a bounded size."""
    ids, texts, size = [], [], 0
    rows = items.where((F.length(F.trim(text_col)) > 0) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    for row in rows.orderBy("id", "text").toLocalIterator():
        ids.append(row.id)
        texts.append(row.text.encode())
        size += len(texts[-1])
        if size >= block_bytes:
            yield build_index(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield build_index(ids, texts)


def _search_batches(shared, at: int):
    """For each batch the items contained in each of its texts."""

    def found(batch: pa.RecordBatch) -> list[list[int]]:
        data, offsets = kernels.utf8(batch.column(at))
        out: list[list[int]] = []
        for lo, hi in kernels.chunks(offsets):
            part = offsets[lo : hi + 1]
            out += shared.value.search(data[part[0] : part[-1]], part - part[0])
        return out

    return found


def find_items(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with ``items``, the sorted ids of the items each text contains; a column by that name is replaced."""
    kept = docs.drop("items")
    blocks = item_blocks(items, item_id, item_text, block_bytes)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return kept.withColumn("items", F.expr("cast(array() as array<bigint>)"))
    context = docs.sparkSession.sparkContext
    if second is None:
        search = _search_batches(context.broadcast(first), kept.columns.index(text_col))
        names = [*kept.columns, "items"]

        def tell(batches) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([sorted(f) for f in search(batch)], pa.list_(pa.int64()))], names=names)

        return kept.mapInArrow(kernels.tidy(tell), with_fields(kept.schema, items="array<bigint>"))
    scratch = Scratch(docs.sparkSession, "decontaminate")
    digest = [F.xxhash64(text_col), F.xxhash64(F.lit(1), text_col)]
    texts = kept.where(F.length(text_col) > 0).select(F.col(text_col).alias("text"), *(d.alias(f"d{k}") for k, d in enumerate(digest)))
    passes = []
    for index in chain([first, second], blocks):
        shared = context.broadcast(index)
        passes.append(scratch.write(texts.mapInArrow(kernels.tidy(_finding_batches(_search_batches(shared, 0))), "d0 long, d1 long, items array<bigint>").distinct()))
        shared.destroy()
    found = scratch.last(reduce(DataFrame.union, passes).groupBy("d0", "d1").agg(F.sort_array(F.flatten(F.collect_list("items"))).alias("items")))  # a row a block at most
    few = found.limit(BROADCAST_FOUND + 1).count() <= BROADCAST_FOUND
    named = [free_name(kept, n) for n in ("d0", "d1")]
    keyed = kept.withColumns(dict(zip(named, digest)))
    told = found.withColumnsRenamed(dict(zip(("d0", "d1"), named)))
    joined = keyed.join(F.broadcast(told) if few else told, named, "left")
    return joined.select(*kept.columns, F.coalesce("items", F.expr("cast(array() as array<bigint>)")).alias("items"))


def _finding_batches(search):
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = search(batch)
            hit = [i for i, f in enumerate(found) if f]
            if hit:
                rows = batch.take(pa.array(hit))
                yield pa.RecordBatch.from_arrays([rows.column(1), rows.column(2), pa.array([sorted(found[i]) for i in hit], pa.list_(pa.int64()))], names=["d0", "d1", "items"])

    return run
