"""NumPy helpers over Arrow text columns: byte views, words, shingle hashes. All work on whole texts."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
ASCII_LOWER_BYTES = ASCII_LOWER.tobytes()
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
WORD_BASE = np.uint64(0x9E3779B97F4A7C15)
SHINGLE_BASE = np.uint64(0xC2B2AE3D27D4EB4F)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run as a task, which gives freed memory back at its end: Python workers wait for the next task and would keep it."""

    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # not every C library can
                ctypes.CDLL(None).malloc_trim(0)

    return task


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of the batch with at most max_bytes of text together, or one longer row."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(lengths, dtype=np.int64)
    at = 0
    while at < len(lengths):
        before = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, before + max_bytes, side="right")))
        yield batch.slice(at, end - at)
        at = end


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column (null: empty) and the len + 1 offsets into them."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[ends[0] : ends[-1]]
    return data, ends - ends[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word [^\\x20\\x09-\\x0D]+ after lower-casing A-Z, and per text the len + 1 word offsets."""
    n = len(data)
    if not n:
        return np.empty(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    word = ~IS_SPACE[data]
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    first, last = offsets[:-1][offsets[:-1] < offsets[1:]], offsets[1:][offsets[:-1] < offsets[1:]] - 1
    start[first], end[last] = word[first], word[last]
    starts, lengths = np.flatnonzero(start), None
    lengths = np.flatnonzero(end) + 1 - starts
    if not len(starts):
        return np.empty(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    heads = np.cumsum(lengths) - lengths
    within = np.arange(lengths.sum()) - np.repeat(heads, lengths)
    values = (ASCII_LOWER[data[word]].astype(np.uint64) + np.uint64(1)) * powers(WORD_BASE, int(lengths.max()))[within]
    return mix(np.add.reduceat(values, heads)), np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text the sorted distinct hashes of its width-word shingles, one after another, and the len + 1 offsets.

    A text of fewer words has one shingle, the whole sequence; a text without words has none.
    """
    words, at = word_hashes(data, offsets)
    counts = np.diff(at)
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    ends = np.concatenate([[0], np.cumsum(n)])
    doc = np.repeat(np.arange(len(n)), n)
    first = at[doc] + np.arange(ends[-1]) - ends[doc]
    size = np.minimum(counts[doc], width)
    hashes = size.astype(np.uint64)
    for k in range(width):
        there = size > k
        hashes[there] = hashes[there] * SHINGLE_BASE + words[first[there] + k]
    hashes = mix(hashes)
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        hashes[a:b].sort()
    keep = np.ones(len(hashes), dtype=bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[keep], np.concatenate([[0], np.cumsum(keep)])[ends]
