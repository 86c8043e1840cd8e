"""Words and word shingles of many texts at once, over the bytes of an Arrow batch.

Words are maximal runs of bytes other than space and ``\\t`` to ``\\r``; A-Z count as a-z. A shingle is ``k`` words in
a row; a text of fewer words is one shingle, a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from quirekit.llm.common import seed_of

BLANK = np.zeros(256, bool)
BLANK[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = np.uint64(seed_of("word base"))
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


_MIX = np.uint64(seed_of("mix 1")), np.uint64(seed_of("mix 2"))
_LENGTH = np.uint64(seed_of("length"))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * _MIX[0]
    x = x ^ (x >> np.uint64(29))
    x = x * _MIX[1]
    return x ^ (x >> np.uint64(32))


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(size: int) -> list[np.ndarray]:
    if len(_powers[0]) < size:
        for i, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[i] = np.multiply.accumulate(table)
    return _powers


@dataclass
class Words:
    """Words of a batch: byte ranges, 64-bit hashes, and where each text's words begin (``first`` has n + 1 entries)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column without nulls, and its n + 1 offsets into them."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(column: pa.Array, blank: np.ndarray = BLANK, lower: bool = True) -> Words:
    """``blank`` tells which bytes part words; without ``lower``, A-Z stay as they are."""
    data, offsets = text_bytes(column)
    data = LOWER[data] if lower else data
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    inside = ~blank[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    edges = offsets[:-1][np.diff(offsets) > 0]
    begins[edges] = inside[edges]
    edges = offsets[1:][np.diff(offsets) > 0] - 1
    stops[edges] = inside[edges]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    size = 1 << max(16, int(len(data)).bit_length())
    powers, inverse = _power_tables(size)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _LENGTH)
    return Words(data, starts, ends, hashes, np.searchsorted(starts, offsets).astype(np.int64))


def window_keys(values: np.ndarray, at: np.ndarray, n: int, sums: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hashes of the windows of ``n`` values that begin at ``at``, and the running sums they are read off.

    A window's hash is a difference of two running sums of ``value * base ** place``, brought back to place 0.
    """
    powers, inverse = _power_tables(1 << max(16, int(len(values)).bit_length()))
    if sums is None:
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers[: len(values)], out=sums[1:])
    return mix((sums[at + n] - sums[at]) * inverse[at] + np.uint64(n * int(_LENGTH) % (1 << 64))), sums


def shingle_starts(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Word index of each shingle's first word, and the n + 1 places where each text's shingles begin."""
    counts = np.diff(first)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    begin = np.zeros(len(first), np.int64)
    np.cumsum(n, out=begin[1:])
    return np.arange(begin[-1]) - np.repeat(begin[:-1] - first[:-1], n), begin


def shingle_hashes(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, repeats included, and the n + 1 places where each text's begin."""
    at, begin = shingle_starts(words.first, k)
    last = np.repeat(words.first[1:], np.diff(begin))
    total = np.zeros(len(at), np.uint64)
    for j in range(k):
        here = at + j
        known = here < last
        part = words.hashes[np.where(known, here, at)] * np.uint64(seed_of(f"place {j}"))
        total += np.where(known, part, np.uint64(0))
    return mix(total), begin


def slices(batch: pa.RecordBatch, text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``limit`` text bytes (one row at least)."""
    at = batch.schema.get_field_index(text)
    if not batch.num_rows:
        return
    _, offsets = text_bytes(batch.column(at))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop
