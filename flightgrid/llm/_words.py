"""Vectorised splitting and hashing of words over Arrow string batches.

All functions work on UTF-8 bytes: both word patterns of this subpackage are
classes of ASCII bytes against everything else, so no code point is ever cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

#: Bytes of words split at ASCII white space: all but 0x20 and 0x09-0x0D.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of words of letters and digits, after lower-casing: 0-9, a-z and non-ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_SEED = np.uint64(0x9E3779B97F4A7C15)


def chunks(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of ``batch`` with at most ``most`` bytes of text each
    (a longer text is a slice of its own)."""
    col = batch.column(batch.schema.get_field_index(column))
    sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes end to end (eight zero bytes follow) and their offsets.
    Nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    col = pa.concat_arrays([col]) if col.offset else col
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and len(col) else np.zeros(0, np.uint8)
    return np.concatenate([raw, np.zeros(8, np.uint8)]), off - off[0]


def split(data: np.ndarray, offsets: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the maximal runs of ``members`` bytes;
    no run passes the end of its text."""
    n = int(offsets[-1])
    inside = members[data[:n]]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    first[heads] = inside[heads]
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets[1:], starts, side="right")


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span; equal bytes, equal hash."""
    length = (ends - starts).astype(np.int64)
    h = mix(length.astype(np.uint64) * _SEED + _SEED)
    if not len(starts):
        return h
    lanes = np.ndarray(shape=(len(data) - 7,), dtype="<u8", buffer=np.ascontiguousarray(data), strides=(1,))
    live, at, left = None, starts, length
    while True:
        v = lanes[at]
        short = left < 8
        if short.any():
            v = np.where(short, v & ((np.uint64(1) << (np.uint64(8) * np.minimum(left, 7).astype(np.uint64))) - np.uint64(1)), v)
        if live is None:
            h = mix(h ^ v)
            live = np.flatnonzero(left > 8)
            at, left = at[live] + 8, left[live] - 8
        else:
            h[live] = mix(h[live] ^ v)
            more = left > 8
            live, at, left = live[more], at[more] + 8, left[more] - 8
        if not len(live):
            return h


def hash_text(text: str) -> int:
    """hash_spans of one text."""
    raw = np.concatenate([np.frombuffer(text.encode(), np.uint8), np.zeros(8, np.uint8)])
    return int(hash_spans(raw, np.array([0]), np.array([len(raw) - 8]))[0])
