"""Words of many texts at once, hashed in numpy: text columns come as Arrow buffers and stay byte arrays.

A word is a run of bytes other than blank, tab, line feed, vertical tab, form feed and carriage return; the ASCII letters
A-Z count as a-z. Words and n-grams are 64-bit hashes: two different ones agree with a chance of about 2^-57.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20  # texts are worked on together up to this size; a longer one is a slice of its own

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_factors = np.zeros(0, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def factors(count: int) -> np.ndarray:
    """Odd pseudo-random factors, one per byte position of a word."""
    global _factors
    if len(_factors) < count:
        size = max(count, 2 * len(_factors), 1 << 12)
        _factors = mix((np.arange(size, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return _factors


def binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text or binary column as one byte array and the offsets of its rows; null is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows [first, last) with at most `limit` bytes (or one row), their bytes and their offsets from 0."""
    data, offsets = binary(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the row it belongs to. Words end where a row ends."""
    inside = ~_IS_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[heads] = inside[heads]
    starts = np.flatnonzero(begins)
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    tails = heads[1:] - 1
    ends[tails] |= inside[tails]
    stops = np.flatnonzero(ends) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, stops, rows


def hash_spans(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans that do not overlap and come in order."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = stops - starts
    total = int(lengths.sum())
    bounds = np.zeros(len(starts), np.int64)
    np.cumsum(lengths[:-1], out=bounds[1:])
    place = np.arange(total, dtype=np.int64)
    place -= np.repeat(bounds, lengths)
    source = place + np.repeat(starts, lengths)
    values = (data[source].astype(np.uint64) + np.uint64(1)) * factors(int(lengths.max()))[place]
    return mix(np.add.reduceat(values, bounds) + lengths.astype(np.uint64))


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def shingles(hashes: np.ndarray, rows: np.ndarray, count: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `width` successive words and their rows; a row of 1 to width-1 words gives one of all its words."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    per_row = np.bincount(rows, minlength=count)
    out_hash, out_row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n >= width:
        whole = rows[: n - width + 1] == rows[width - 1 :]
        mixed = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            mixed = mix(mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[k : n - width + 1 + k])
        out_hash, out_row = mixed[whole], rows[: n - width + 1][whole]
    short = np.flatnonzero((per_row > 0) & (per_row < width))
    if len(short):
        first = np.searchsorted(rows, short)
        extra = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            there = k < per_row[short]
            extra[there] = mix(extra[there] * np.uint64(0xD1342543DE82EF95) + hashes[first[there] + k] + np.uint64(k + 1))
        out_hash, out_row = np.concatenate([out_hash, extra]), np.concatenate([out_row, short])
        order = np.argsort(out_row, kind="stable")
        out_hash, out_row = out_hash[order], out_row[order]
    return out_hash, out_row


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of every row in ascending order, and the offsets of the rows in them."""
    count = len(offsets) - 1
    starts, stops, rows = split(data, offsets)
    hashes, owners = shingles(hash_spans(lower(data), starts, stops), rows, count, width)
    order = np.lexsort((hashes, owners))
    hashes, owners = hashes[order], owners[order]
    if len(hashes):
        keep = np.ones(len(hashes), bool)
        keep[1:] = (hashes[1:] != hashes[:-1]) | (owners[1:] != owners[:-1])
        hashes, owners = hashes[keep], owners[keep]
    bounds = np.zeros(count + 1, np.int64)
    np.cumsum(np.bincount(owners, minlength=count), out=bounds[1:])
    return hashes, bounds
