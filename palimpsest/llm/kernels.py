"""Numpy kernels over UTF-8 bytes: words, hashes and sets of many texts at once.

A batch is one byte array and the offsets of its texts. Words are runs of bytes
other than ASCII white space (0x20, 0x09-0x0D), with A-Z lower-cased, unless a
function says otherwise. No kernel looks across the border of two texts.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes of text that a kernel takes in one go; a longer text is taken alone.
CHUNK_BYTES = 1 << 19


#: By module, what makes a worker forget what it keeps for the next tasks of that module; tasks of other modules do so.
KEPT: dict[str, Callable[[], None]] = {}


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` with its memory given back when a task ends: workers live on, and an executor's memory holds them all."""

    def task(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        for owner, forget in KEPT.items():
            if owner != run.__module__:
                forget()
        try:
            yield from run(batches)
        finally:
            gc.collect()
            give_back()

    return task


def give_back() -> None:
    """Free memory goes back to the system, for the other workers of the executor."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (shifts and odd multipliers)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE_KEY = mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93
_POWERS = {False: np.ones(1, dtype=U64), True: np.ones(1, dtype=U64)}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n position multipliers (odd, modulo 2**64), or what undoes them."""
    if len(_POWERS[inverse]) < n:
        size = 1 << (n - 1).bit_length()
        _POWERS[inverse] = np.cumprod(np.concatenate([[U64(1)], np.full(size - 1, pow(_BASE, -1, 1 << 64) if inverse else _BASE, dtype=U64)]), dtype=U64)
    return _POWERS[inverse][:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES):
    """Ranges of texts of about ``size`` bytes together."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the index of the first word of each text (one more at the end)."""
    solid = ~_SPACE[data]
    edge = np.ones(len(data) + 1, dtype=bool)
    if len(data):
        edge[1:-1] = False
    edge[offsets] = True
    before = np.concatenate([[False], solid[:-1]]) if len(solid) else solid
    starts = np.flatnonzero(solid & (edge[:-1] | ~before))
    after = np.concatenate([solid[1:], [False]]) if len(solid) else solid
    ends = np.flatnonzero(solid & (edge[1:] | ~after)) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_WORD_KEY = _BYTE_KEY.copy()
_WORD_KEY[_SPACE] = 0
_FOLDED_KEY = _WORD_KEY[_LOWER]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each word; words are ascending, with nothing but white space between."""
    if not len(starts):
        return np.zeros(0, dtype=U64)
    lengths = ends - starts
    keys = _FOLDED_KEY if fold else _WORD_KEY
    nexts = np.append(starts[1:], ends[-1])  # white space after a word has the key 0
    out = np.empty(len(starts), dtype=U64)
    for lo, hi in chunks(np.append(starts, ends[-1])):
        first = starts[lo]
        at = np.arange(nexts[hi - 1] - first) - np.repeat(starts[lo:hi] - first, nexts[lo:hi] - starts[lo:hi])
        longest = int(lengths[lo:hi].max())
        np.minimum(at, longest, out=at)
        values = keys[data[first : nexts[hi - 1]]]
        values *= powers(longest + 1)[at]
        out[lo:hi] = np.add.reduceat(values, starts[lo:hi] - first)
    return mix64(out + lengths.astype(U64) * U64(0xA24BAED4963EE407))


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` words and the text each belongs to.

    A text of fewer words, one at least, has its whole sequence as its only shingle.
    """
    n_words = np.diff(first)
    owner = np.repeat(np.arange(len(n_words)), n_words)
    parts, owners = [], []
    if len(words) >= size:
        total = np.zeros(len(words) - size + 1, dtype=U64)
        for k in range(size):
            total += mix64(words[k : k + len(total)] + U64(k + 1)) * U64(2 * k + 3)
        whole = owner[: len(total)] == owner[size - 1 :]
        parts.append(mix64(total[whole]))
        owners.append(owner[: len(total)][whole])
    for i in np.flatnonzero((n_words > 0) & (n_words < size)):
        run = words[first[i] : first[i + 1]]
        with np.errstate(over="ignore"):
            one = (mix64(run + np.arange(1, len(run) + 1, dtype=U64)) * (2 * np.arange(len(run), dtype=U64) + U64(3))).sum(dtype=U64)
            parts.append(mix64(np.array([one + U64(len(run)) * U64(0x9E3779B97F4A7C15)], dtype=U64)))
        owners.append(np.array([i]))
    if not parts:
        return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
    hashes, owner = np.concatenate(parts), np.concatenate(owners)
    if len(parts) > 1:
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
    return hashes, owner


def text_sets(data: np.ndarray, offsets: np.ndarray, size: int):
    """For each text its sorted distinct shingle hashes (as signed 64-bit)."""
    starts, ends, first = word_spans(data, offsets)
    hashes, owner = shingle_hashes(span_hashes(data, starts, ends), first, size)
    bounds = np.searchsorted(owner, np.arange(len(offsets)))
    signed = hashes.view(np.int64)
    for i in range(len(offsets) - 1):
        run = np.sort(signed[bounds[i] : bounds[i + 1]])
        if len(run) > 1:
            run = run[np.concatenate([[True], run[1:] != run[:-1]])]
        yield run
