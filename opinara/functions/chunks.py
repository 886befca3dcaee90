"""Word arrays as numbers inside a task: Arrow batches cut into chunks of bounded size, words as codes of a chunk."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words of a chunk, unless one review alone has more: the bound of what a task holds.
CHUNK_WORDS = 1 << 19


def chunks(batch: pa.RecordBatch, column: str, most: int = CHUNK_WORDS) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of a batch with at most ``most`` words in ``column`` (one row at least), and the words of each row."""
    sizes = pc.fill_null(pc.list_value_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start), sizes[start:stop]
        start = stop


def coded(items: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Whole-number codes of the items, -1 for NULL, and the distinct items by code."""
    encoded = items.dictionary_encode()
    return pc.fill_null(encoded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary


def gram_codes(codes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, code) of every run of ``n`` words of one row without a NULL; equal codes are equal runs."""
    if len(codes) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    last = len(codes) - n + 1
    whole = rows[:last] == rows[n - 1:]
    for shift in range(n):
        whole &= codes[shift:shift + last] >= 0
    starts = np.flatnonzero(whole)
    out, distinct, width = codes[starts], int(codes.max(initial=0)) + 1, int(codes.max(initial=0)) + 1
    for shift in range(1, n):
        if distinct * width >= 1 << 62:
            values, out = np.unique(out, return_inverse=True)
            distinct = len(values)
        out, distinct = out * width + codes[starts + shift], distinct * width
    return starts, out


def gram_texts(codes: np.ndarray, words: pa.Array, starts: np.ndarray, n: int) -> pa.Array:
    """The runs of ``n`` words from each start, joined by a space."""
    parts = [words.take(pa.array(codes[starts + shift])) for shift in range(n)]
    return parts[0] if n == 1 else pc.binary_join_element_wise(*parts, " ")
