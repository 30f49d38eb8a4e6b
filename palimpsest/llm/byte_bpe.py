"""Byte-level BPE encoding and decoding.

Pre-tokens are found without a regular expression. Every code point has a class;
every class is a function from automaton state to automaton state. The functions
that arise by composing them form a small monoid, whose multiplication table is
computed once; a prefix scan with that table over blocks of the batch gives the
state after every code point, and the borders of pre-tokens follow from pairs of
states. The slices feed a cached pair merge. Token offsets are kept with the ids:
decoding places the bytes of any run of tokens by them.

Null and empty texts have no tokens and decode to no bytes. Texts are taken
whole; a batch holds several texts or one long one.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import kernels
from palimpsest.llm.spark_io import with_fields

# Symbols: what the automaton can tell of a code point.
LETTER, NUMBER, OTHER, BLANK, SPACE, QUOTE, ONE, R, V, L, E, TEXT_END = range(12)
# States: what the last code point was part of.
START, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_BLANK, AFTER_SPACE, QUOTED, SUFFIX, MAYBE_R, MAYBE_V, MAYBE_L, SUFFIX_2 = range(12)

#: The code points of the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

BLOCK = 64
CACHE_WORDS = 150_000


def _step(state: int, symbol: int) -> int:
    if symbol == TEXT_END:
        return START
    if symbol in (LETTER, ONE, R, V, L, E):
        if state == QUOTED:
            return {ONE: SUFFIX, R: MAYBE_R, V: MAYBE_V, L: MAYBE_L}.get(symbol, IN_LETTERS)
        if (state, symbol) in ((MAYBE_R, E), (MAYBE_V, E), (MAYBE_L, L)):
            return SUFFIX_2
        return IN_LETTERS
    if symbol == QUOTE:  # opens a suffix only where a pre-token can begin
        return IN_OTHER if state in (AFTER_BLANK, IN_OTHER, QUOTED) else QUOTED
    return {NUMBER: IN_NUMBERS, OTHER: IN_OTHER, BLANK: AFTER_BLANK, SPACE: AFTER_SPACE}[symbol]


def _begins(before: int, after: int) -> bool:
    """Whether the code point that led from one state to the other begins a pre-token, as far as the past tells."""
    if before == START:
        return True
    if after in (SUFFIX, SUFFIX_2):
        return False
    letters = (IN_LETTERS, MAYBE_R, MAYBE_V, MAYBE_L)
    others = (IN_OTHER, QUOTED)
    spaces = (AFTER_BLANK, AFTER_SPACE)
    if after in spaces:
        return before not in spaces
    if before == AFTER_BLANK:
        return False
    for kind in (letters, (IN_NUMBERS,), others):
        if after in kind:
            return before not in kind
    return True


@lru_cache(1)
def _automaton():
    """Monoid elements as state tuples, the element of each symbol, the product table and the state after START."""
    base = [tuple(_step(s, a) for s in range(12)) for a in range(12)]
    ident = tuple(range(12))
    elements, index = [ident, *dict.fromkeys(base)], {}
    index = {e: i for i, e in enumerate(elements)}
    at = 0
    while at < len(elements):
        for b in base:
            made = tuple(b[s] for s in elements[at])
            if made not in index:
                index[made] = len(elements)
                elements.append(made)
        at += 1
    table = np.array(elements, dtype=np.int64)
    product = np.empty((len(elements), len(elements)), dtype=np.uint16)
    for i, left in enumerate(elements):
        for j, right in enumerate(elements):
            product[i, j] = index[tuple(right[s] for s in left)]
    of_symbol = np.array([index[b] for b in base], dtype=np.uint16)
    begins = np.array([[_begins(s, t) for t in range(12)] for s in range(12)])
    return product, of_symbol, table[:, START].astype(np.uint8), begins


@lru_cache(1)
def _classes() -> np.ndarray:
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            out[cp] = LETTER
        elif kind == "N":
            out[cp] = NUMBER
    out[WHITE_SPACE] = SPACE
    out[0x20] = BLANK
    for letters, symbol in (("'", QUOTE), ("stmd", ONE), ("r", R), ("v", V), ("l", L), ("e", E)):
        for c in letters:
            out[ord(c)] = symbol
    return out


def states(symbols: np.ndarray) -> np.ndarray:
    """The state after each symbol, by a blocked prefix scan of composed functions."""
    product, of_symbol, from_start, _ = _automaton()
    n = len(symbols)
    rows = -(-n // BLOCK)
    work = np.zeros(rows * BLOCK, dtype=np.uint16)  # element 0 changes nothing
    work[:n] = of_symbol[symbols]
    work = np.ascontiguousarray(work.reshape(rows, BLOCK).T)
    for k in range(1, BLOCK):
        work[k] = product[work[k - 1], work[k]]
    carry, gap = work[-1].copy(), 1
    while gap < rows:  # inclusive scan over the blocks, by doubling
        carry[gap:] = product[carry[:-gap], carry[gap:]]
        gap *= 2
    work[:, 1:] = product[carry[:-1], work[:, 1:]]
    return from_start[work.T.reshape(-1)[:n]]


def pre_token_starts(points: np.ndarray, text_ends: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in code points of joined texts; text_ends holds the end of each text."""
    n = len(points)
    if not n:
        return np.zeros(0, dtype=np.int64)
    symbols = _classes()[points]
    # the end of a text is a symbol of its own, put in between and taken out again
    ends = text_ends[text_ends < n]
    woven = np.insert(symbols, ends, TEXT_END)
    after = states(woven)
    before = np.empty_like(after)
    before[0], before[1:] = START, after[:-1]
    begins = _automaton()[3][before, after]
    ends_here = woven == TEXT_END
    # a two-letter suffix takes its first letter back
    begins[np.flatnonzero(after[1:] == SUFFIX_2)] = False
    # the last of several spaces goes apart when text follows
    spaced = (after == AFTER_BLANK) | (after == AFTER_SPACE)
    begins[np.flatnonzero(spaced[:-1] & ~spaced[1:] & ~ends_here[1:])] = True
    return np.flatnonzero(begins[~ends_here])


class Encoder:
    """Pair merging by ranks, with a bounded cache of pre-tokens."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        size = max(self.ranks.values()) + 1
        words = [b""] * size
        for word, rank in self.ranks.items():
            words[rank] = word
        self.lengths = np.array([len(w) for w in words], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.blob = np.frombuffer(b"".join(words), dtype=np.uint8)
        self.cache: dict[bytes, bytes] = {}

    def merge(self, piece: bytes) -> bytes:
        """Ids of a pre-token as little-endian 32-bit integers; of the pairs of least rank the first merges first."""
        ranks = self.ranks
        if piece in ranks:
            return ranks[piece].to_bytes(4, "little")
        if len(piece) <= 48:
            parts = [piece[i : i + 1] for i in range(len(piece))]
            while len(parts) > 1:
                best, at = None, 0
                for i in range(len(parts) - 1):
                    rank = ranks.get(parts[i] + parts[i + 1])
                    if rank is not None and (best is None or rank < best):
                        best, at = rank, i
                if best is None:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            return b"".join(ranks[p].to_bytes(4, "little") for p in parts)
        return self._merge_long(piece)

    def _merge_long(self, piece: bytes) -> bytes:
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # of the part that starts here; 0 once it is merged away
        prior = list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            j = end[i]
            if j < n:
                rank = ranks.get(piece[i : end[j]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, j, end[j]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, j, k = heapq.heappop(heap)
            if end[i] != j or j >= n or end[j] != k:
                continue
            end[i], end[j] = k, 0
            if k < n:
                prior[k] = i
            offer(i)
            if prior[i] >= 0:
                offer(prior[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]].to_bytes(4, "little"))
            i = end[i]
        return b"".join(out)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a batch, and the index of the first id of each text (one more at the end)."""
        raw = data.tobytes()
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        width = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
        place = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
        starts = place[pre_token_starts(points, np.searchsorted(place, offsets[1:]))]
        cache, merge = self.cache, self.merge
        if len(cache) > CACHE_WORDS:
            cache.clear()
        bounds = [*starts.tolist(), len(raw)]
        out = []
        for a, b in zip(bounds, bounds[1:]):
            piece = raw[a:b]
            ids = cache.get(piece)
            if ids is None:
                ids = merge(piece)
                if b - a <= 64:
                    cache[piece] = ids
            out.append(ids)
        counts = np.fromiter(map(len, out), dtype=np.int64, count=len(out)) // 4
        first = np.concatenate([[0], np.cumsum(counts)])
        return np.frombuffer(b"".join(out), dtype="<u4"), first[np.searchsorted(starts, offsets)]

    def token_offsets(self, ids: np.ndarray) -> np.ndarray:
        """The byte at which each token starts, and the end."""
        return np.concatenate([[0], np.cumsum(self.lengths[ids])])

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bytes of the tokens, each placed at its offset."""
        lengths = np.diff(offsets)
        at = np.repeat(self.starts[ids] - offsets[:-1], lengths) + np.arange(offsets[-1])
        return self.blob[at]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


kernels.KEPT[__name__] = encoder.cache_clear


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values).tobytes())]).cast(pa.binary())


def encode(df: DataFrame, vocabulary: str, text_col: str = "text", offsets: bool = True) -> DataFrame:
    """df with ``ids`` (binary, little-endian unsigned 32-bit) and, if asked for, ``token_starts``.

    token_starts (binary, little-endian unsigned 64-bit) holds the byte offset of
    each token and the end. Columns of df by these names are replaced.
    """
    kept = df.drop("ids", "token_starts")
    text_at = kept.columns.index(text_col)
    extra = ["ids", "token_starts"] if offsets else ["ids"]
    names = [*kept.columns, *extra]

    def run(batches) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in batches:
            data, bounds = kernels.utf8(batch.column(text_at))
            for lo, hi in kernels.chunks(bounds):
                part = bounds[lo : hi + 1]
                ids, first = bpe.encode(data[part[0] : part[-1]], part - part[0])
                columns = [*batch.slice(lo, hi - lo).columns, _binary(ids, first * 4)]
                if offsets:
                    flat = [bpe.token_offsets(ids[a:b]) for a, b in zip(first, first[1:])]
                    ends = np.concatenate([[0], np.cumsum([len(f) for f in flat])])
                    columns.append(_binary(np.concatenate(flat).astype("<u8"), ends * 8))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return kept.mapInArrow(kernels.tidy(run), with_fields(kept.schema, **dict.fromkeys(extra, "binary")))


def decode(df: DataFrame, vocabulary: str, ids_col: str = "ids", starts_col: str = "token_starts") -> DataFrame:
    """df with ``decoded``, the bytes of its ids, in place of the ids and offsets it is made from."""
    ids_at, starts_at = df.columns.index(ids_col), df.columns.index(starts_col)
    kept = [i for i, name in enumerate(df.columns) if name not in (starts_col, "decoded")]
    names = [*(df.columns[i] for i in kept), "decoded"]

    def run(batches) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in batches:
            ids, id_bounds = kernels.utf8(batch.column(ids_at))
            places, place_bounds = kernels.utf8(batch.column(starts_at))
            for lo, hi in kernels.chunks(id_bounds):
                made, ends = [], [0]
                for i in range(lo, hi):
                    own = ids[id_bounds[i] : id_bounds[i + 1]].tobytes()
                    at = places[place_bounds[i] : place_bounds[i + 1]].tobytes()
                    out = bpe.decode(np.frombuffer(own, "<u4"), np.frombuffer(at, "<u8").astype(np.int64)) if at else b""
                    made.append(out)
                    ends.append(ends[-1] + len(out))
                text = _binary(np.frombuffer(b"".join(bytes(m) for m in made), np.uint8), np.array(ends))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(lo, hi - lo) for i in kept), text], names=names
                )

    return df.mapInArrow(kernels.tidy(run), with_fields(df.drop(starts_col, "decoded").schema, decoded="binary"))


def token_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of documents."""
    coded = decode(encode(docs.select("doc_id", "text"), vocabulary).drop("text"), vocabulary)
    return coded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
