"""Vectorised words of Arrow text columns: bounds, hashes and counts in numpy.

Null texts count as empty.  Words never cross documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)

#: Bytes that are in words: anything but white space, and the plainer kind of letters and digits only.
ANY = np.ones(256, bool)
ANY[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit of ``x``."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    x *= U64(0xA3B195354A39B70D)
    return x ^ (x >> U64(32))


_BYTE = mix(np.arange(1, 257, dtype=U64) * _ODD) | U64(1)
_BYTE_LOWER = _BYTE[LOWER]
_INVERSE = U64(pow(int(_ODD), -1, 1 << 64))


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    up, down = np.full(n, _ODD, U64), np.full(n, _INVERSE, U64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)


def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the n + 1 offsets of its rows in them."""
    col = batch.column(batch.schema.get_field_index(name))
    if col.null_count:
        col = pc.fill_null(col, "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    if not len(col) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32, len(col) + 1, col.offset * (8 if wide else 4)).astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, name: str, most: int = 1 << 21) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Consecutive rows of about ``most`` bytes of text, a longer text alone, with bytes and offsets."""
    data, offs = column(batch, name)
    lo, n = 0, batch.num_rows
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield batch.slice(lo, hi - lo), data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def bounds(data: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the n + 1 offsets of the rows in the list of words.

    ``inside`` says by byte, after any lower-casing, what belongs to words.
    """
    m = inside[data]
    first, last = m.copy(), m.copy()
    first[1:] &= ~m[:-1]
    last[:-1] &= ~m[1:]
    at = offs[:-1][np.diff(offs) > 0]
    first[at] = m[at]
    last[at[1:] - 1] = m[at[1:] - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hashes of the words data[starts:ends], of ASCII lower-cased bytes if ``lower``."""
    if not len(starts):
        return np.zeros(0, U64)
    up, down = _powers(max(21, int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64))


def hash_of(word: bytes, lower: bool = True) -> int:
    data = np.frombuffer(word, np.uint8)
    return int(hashes(data, np.array([0]), np.array([len(data)]), lower)[0])


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n consecutive words from each word on; the last n - 1 words of the list start none."""
    if len(h) < n:
        return np.zeros(0, U64)
    out = np.zeros(len(h) - n + 1, U64)
    for k in range(n):
        out = (out + h[k : len(h) - n + 1 + k]) * U64(0x9FB21C651E98DF25 + 2 * k)
        out ^= out >> U64(31)
    return mix(out)


def spread(counts: np.ndarray) -> np.ndarray:
    """Row numbers, each repeated as often as ``counts`` says."""
    return np.repeat(np.arange(len(counts)), counts)
