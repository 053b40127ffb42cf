"""Sets of hashed word shingles, computed over whole Arrow columns with NumPy.

Words are runs of other bytes than ASCII white space, A-Z lower-cased; UTF-8 needs no
decoding for that. A word's hash is a polynomial over its bytes modulo 2^64, taken from
running sums, and mixed; a shingle's hash is a polynomial over its words' hashes, mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

WORDS = 5
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)
#: Bytes that are hashed at a time.
SPAN = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (public finaliser constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    out = []
    for b in (_BASE, inverse):
        p = np.full(n, b, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def word_hashes(data: np.ndarray) -> np.ndarray:
    """The hash of every word of a text's bytes, in order."""
    if not len(data):
        return np.zeros(0, np.uint64)
    found, at = [], 0
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    while at < len(data):
        end = min(len(data), at + SPAN)
        if end < len(data):
            gaps = np.flatnonzero(blank[end:])
            end = end + int(gaps[0]) if len(gaps) else len(data)
        found.append(_span(data[at:end], blank[at:end]))
        at = end
    return found[0] if len(found) == 1 else np.concatenate(found)


def _span(data: np.ndarray, blank: np.ndarray) -> np.ndarray:
    edges = np.diff(np.concatenate(([1], blank.view(np.int8), [1])))
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = max(SPAN, 1 << (len(data) - 1).bit_length())
    power, inverse = _powers(size)
    lower = data + ((data >= 65) & (data <= 90)) * np.uint8(32)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((lower.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * inverse[starts])


def shingle_set(data: np.ndarray, words: int = WORDS) -> np.ndarray:
    """The sorted distinct shingle hashes of a text's bytes; all words as one where they are fewer; empty without words."""
    w = word_hashes(data)
    if not len(w):
        return w
    take = min(words, len(w))
    mixed = np.full(len(w) - take + 1, take, np.uint64)
    for k in range(take):
        mixed = mixed * _STEP + w[k : len(w) - take + 1 + k]
    hashes = np.sort(mix64(mixed))
    return hashes[np.concatenate(([True], hashes[1:] != hashes[:-1]))]


def column_bytes(column: pa.Array) -> Iterator[np.ndarray]:
    """The UTF-8 bytes of each text of an Arrow string column, without copies; a null gives none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2] if len(column) else None
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield data[offsets[i] : offsets[i + 1]] if valid[i] else data[:0]
