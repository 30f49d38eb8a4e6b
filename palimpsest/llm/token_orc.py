"""Token ids in ORC files, written in document order and read back stripe by stripe.

ORC stores the ids as run-length encoded integers. Each stripe has a row index
and a Bloom filter on the document id, so readers split files by stripe and look
up documents by metadata. Ids come from the tokenizers library, one end id after
each document.

Encoding works on white-space-delimited pieces: the vocabulary's normaliser and
splitter never join text across ASCII white space, so a piece's ids do not depend
on its neighbours, and each distinct piece is encoded once and kept in a bounded
cache. Where a text spells out an added token of the vocabulary, as written there,
the library gives that token's id: texts are cut there, and what lies between is
encoded by pieces. Null and empty texts hold just the end id. Rows with one id are
ordered by text and each kept; a null id sorts first. Other columns are left out.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm import kernels
from palimpsest.llm.spark_io import with_fields

#: Pieces of one generation of the cache; two are kept.
CACHE_PIECES = 550_000
#: Pieces encoded in one call, and marks tried to keep them apart: the first that is a single id is used.
GROUP = 64
MARKS = "©®™°±§¶†"

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
# Second bytes of the letters U+00C0 to U+00FF; the two signs among them are none.
_ACCENTED = np.zeros(256, dtype=bool)
_ACCENTED[0x80:0xC0] = True
_ACCENTED[[0x97, 0xB7]] = False
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".,!?;:")] = True


def spread(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with a blank before each stop that ends a word of Latin letters and digits, and where they were put in.

    The splitter parts such a stop from its word anyway; apart, both are met more often.
    """
    if len(data) < 3:
        return data, np.zeros(0, dtype=np.int64)
    letter = _WORD[data[:-2]]
    letter[1:] |= (data[:-3] == 0xC3) & _ACCENTED[data[1:-2]]
    at = np.flatnonzero(_STOP[data[1:-1]] & _SPACE[data[2:]] & letter) + 1
    return np.insert(data, at, 0x20), at


class PieceEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("a vocabulary with added tokens that take in what surrounds them")
        self.added = {t.content.encode(): np.array([i], dtype="<u4").tobytes() for i, t in added.items()}
        self.cut = re.compile(b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if added else None
        # texts are cut at added tokens first; a piece that becomes one in lower case is plain text
        self.tokenizer.encode_special_tokens = True
        self.mark = next((m for m in MARKS if len(self.ids(m)) == 1), None)
        self.mark_id = self.ids(self.mark)[0] if self.mark else -1
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def learn(self, pieces: list[bytes]) -> None:
        """Encode new pieces, several in a call, split again at the mark between them."""
        texts = [p.decode("utf-8") for p in pieces]
        alone = [] if self.mark else list(range(len(texts)))
        plain = [i for i, t in enumerate(texts) if self.mark not in t] if self.mark else []
        if len(plain) + len(alone) < len(texts):
            alone += sorted(set(range(len(texts))) - set(plain))
        groups = [plain[i : i + GROUP] for i in range(0, len(plain), GROUP)]
        for at in range(0, len(groups), 256):
            some = groups[at : at + 256]
            joined = self.tokenizer.encode_batch_fast([f" {self.mark} ".join(texts[i] for i in g) for g in some], add_special_tokens=False)
            for group, encoding in zip(some, joined):
                flat = np.array(encoding.ids, dtype="<u4")
                cuts = np.flatnonzero(flat == self.mark_id)
                starts, ends = [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(flat)]
                raw = flat.tobytes()
                for i, a, b in zip(group, starts, ends, strict=True):
                    self.cache[pieces[i]] = raw[4 * a : 4 * b]
        for i in alone:
            self.cache[pieces[i]] = np.array(self.ids(texts[i]), dtype="<u4").tobytes()

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        raw = data.tobytes()
        if not any(token in raw for token in self.added):
            return self.encode_plain(data, offsets)
        edges, first, tokens = [0], [0], {}
        for a, b in zip(offsets.tolist(), offsets[1:].tolist()):
            for found in self.cut.finditer(raw, a, b):
                tokens[len(edges)] = self.added[found[0]]
                edges += found.span()
            edges.append(b)
            first.append(len(edges) - 1)
        parts = self.encode_plain(data, np.array(edges, dtype=np.int64))
        for i, own in tokens.items():
            parts[i] = own
        return [b"".join(parts[a:b]) for a, b in zip(first, first[1:])]

    def encode_plain(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Ids of each text, whatever it spells out taken as plain text."""
        if len(self.cache) > CACHE_PIECES:
            self.cache, self.older = {}, self.cache
        apart, put = spread(data)
        edges = (offsets + np.searchsorted(put, offsets)).tolist()
        raw = apart.tobytes().lower()  # A-Z only; the normaliser does the same
        split = [raw[a:b].split() for a, b in zip(edges, edges[1:])]
        cache, older = self.cache, self.older
        missing = set().union(*split).difference(cache)
        known = {piece: older[piece] for piece in missing if piece in older}
        cache.update(known)
        new = missing.difference(known)
        if new:
            self.learn(sorted(new))
        get = cache.__getitem__
        return [b"".join(map(get, pieces)) for pieces in split]


@lru_cache(2)
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


FILE_SCHEMA = "doc_id long, part int, part_start long, n_tokens long, token_ids array<int>"


def write_token_orc(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, partitions: int | None = None, stripe_bytes: int = 16 << 20, index_stride: int = 1000) -> None:
    """Write ids of every row in ascending order of the id, one file per range of ids."""
    spark = docs.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches) -> Iterator[pa.RecordBatch]:
        pieces, part, start = piece_encoder(vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            data, bounds = kernels.utf8(batch.column(1))
            for lo, hi in kernels.chunks(bounds):
                at = bounds[lo : hi + 1] - bounds[lo]
                rows = [ids + end for ids in pieces.encode(data[bounds[lo] : bounds[hi]], at)]
                counts = np.array([len(r) // 4 for r in rows], dtype=np.int64)
                ends = np.concatenate([[0], np.cumsum(counts)])
                ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(rows), dtype="<i4")))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.full(hi - lo, part, np.int32)), pa.array(start + ends[:-1]), pa.array(counts), ids],
                    names=["doc_id", "part", "part_start", "n_tokens", "token_ids"],
                )
                start += int(ends[-1])

    ranged = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        .repartitionByRange(partitions, "doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    (
        ranged.mapInArrow(kernels.tidy(run), FILE_SCHEMA)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", str(index_stride))
        .option("orc.stripe.size", str(stripe_bytes))
        .orc(path)
    )


def read_token_orc(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, token_ids) from files; doc_ids prunes stripes by index and Bloom filter.

    start counts the ids of all documents before: the files' own totals, a row
    per file, are summed in order and added to the place within the file.
    """
    files = spark.read.schema(FILE_SCHEMA).orc(path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # one row per file
    rows = files if doc_ids is None else files.where(F.col("doc_id").isin(doc_ids))
    return rows.join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "token_ids")


def with_crc(tokens: DataFrame) -> DataFrame:
    """token_ids replaced by ids_crc32, the crc32 of the ids as little-endian unsigned 32-bit integers."""
    kept = [c for c in tokens.columns if c not in ("token_ids", "ids_crc32")]
    at = tokens.columns.index("token_ids")
    kept_at = [tokens.columns.index(c) for c in kept]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(at)
            flat = np.asarray(lists.values).astype("<i4", copy=False)
            bounds = np.asarray(lists.offsets).tolist()
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept_at), pa.array(crc, pa.int64())], names=[*kept, "ids_crc32"])

    return tokens.mapInArrow(kernels.tidy(run), with_fields(tokens.select(*kept).schema, ids_crc32="long"))
