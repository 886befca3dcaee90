"""Vectorised word hashing inside Arrow batches, shared by the operators that run in Python tasks.

A word is a maximal run of characters outside ``[\\x20\\x09-\\x0D]``.  All of those characters are
ASCII, so words are found on UTF-8 bytes.  Words are identified by 64-bit hashes: two of n different
words collide with odds of about n^2 / 2^65 (one in 10^6 for six million different words).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SPACES = b" \t\n\x0b\x0c\r"
_SLICE_BYTES = 1 << 20
_U = np.uint64
_RADIX = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_CODES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words(NamedTuple):
    """Words of some consecutive rows: word ``k`` is ``data[starts[k]:ends[k]]``, of row ``rows[k]``.

    ``row_starts`` has the byte at which each row begins and, last, the end of the data; a separating
    newline follows each row.  Row ``i`` has the words ``first[i]`` to ``first[i + 1]``.
    """

    data: np.ndarray
    row_starts: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    first: np.ndarray
    hashes: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        tables = []
        for base in (_RADIX, _INVERSE):
            table = np.full(n, base, np.uint64)
            table[0] = 1
            tables.append(np.multiply.accumulate(table))
        if n > 4 * _SLICE_BYTES:
            return tuple(tables)
        _powers = tuple(tables)
    return _powers


def _words(texts: list[bytes], lower: bool) -> Words:
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    row_starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1, out=row_starts[1:])
    if lower:
        data = _LOWER[data]
    inside = ~IS_SPACE[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    powers, inverses = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[data] * powers[: len(data)], out=sums[1:])
    values = (sums[ends] - sums[starts]) * inverses[starts]
    hashes = mix(values + (ends - starts).astype(np.uint64))
    first = np.searchsorted(starts, row_starts)
    rows = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(data, row_starts, starts, ends, rows, first, hashes)


def slices(texts: pa.Array, lower: bool) -> Iterator[tuple[int, int, Words]]:
    """``(from_row, to_row, words)`` over whole texts; null counts as empty.

    Rows are taken together up to about a megabyte, so memory depends on the longest text only.
    """
    at, size, held = 0, 0, []
    # A part of the batch at a time is held as Python strings.
    values = (v for start in range(0, len(texts), 256) for v in texts.slice(start, 256).to_pylist())
    for i, text in enumerate(values):
        encoded = b"" if text is None else text.encode()
        if held and size + len(encoded) > _SLICE_BYTES:
            yield at, i, _words(held, lower)
            at, size, held = i, 0, []
        held.append(encoded)
        size += len(encoded) + 1
    if held:
        yield at, at + len(held), _words(held, lower)


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """``(rows, hashes)`` of all runs of ``width`` words; a row with fewer words has its whole sequence as one."""
    n = len(words.hashes)
    counts = np.diff(words.first)
    out_rows, out = [], []
    if n >= width:
        value = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            value = value * _RADIX + words.hashes[k : n - width + 1 + k]
        whole = words.rows[: n - width + 1] == words.rows[width - 1 :]
        out_rows.append(words.rows[: n - width + 1][whole])
        out.append(mix(value[whole]))
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        value = _U(0)
        with np.errstate(over="ignore"):
            for h in words.hashes[words.first[i] : words.first[i + 1]]:
                value = value * _RADIX + h
        out_rows.append(np.array([i]))
        out.append(mix(np.array([value + _U(counts[i])], np.uint64)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(out_rows), np.concatenate(out)


def sets_by_row(rows: np.ndarray, hashes: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row as signed longs: ``(values, first)``, ascending within each row."""
    values = hashes.view(np.int64)
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    if len(values):
        fresh = np.ones(len(values), bool)
        fresh[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
        rows, values = rows[fresh], values[fresh]
    return values, np.searchsorted(rows, np.arange(n_rows + 1))


def list_array(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, kind))
