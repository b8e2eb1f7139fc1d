"""Vectorised 64-bit fingerprints of words, shingles and byte windows, over whole Arrow columns of text."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once; a longer text is a chunk of its own.
CHUNK = 1 << 20

_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits after which every bit depends on every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def seeds(n: int, stream: int) -> np.ndarray:
    """``n`` fixed 64-bit numbers; another ``stream`` gives others."""
    start = _U((stream * 0xD1B54A32D192ED03) & (2**64 - 1))
    return mix64(start + np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))


# two independent families: byte values, base and its inverse modulo 2**64
_BYTES = (seeds(256, 1), seeds(256, 7))
_BASES = tuple(int(seeds(1, stream)[0]) | 1 for stream in (2, 8))
_INVERSES = tuple(pow(base, -1, 2**64) for base in _BASES)


@functools.lru_cache(maxsize=8)
def _powers_upto(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64; the array is kept for the next call."""
    return _powers_upto(base, 1 << max(20, (n - 1).bit_length()))[:n]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and each row's first byte (and the last row's end); null is empty."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at.astype(np.int64)


def chunks(ends: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of rows (first, last + 1) with about ``size`` bytes, or one row that is longer."""
    first = 0
    while first < len(ends) - 1:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + size, "right")) - 1)
        yield first, last
        first = last


def prefix_hashes(data: np.ndarray, family: int = 0) -> np.ndarray:
    """h[i]: polynomial hash of the first i bytes; see ``window_hashes``."""
    out = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTES[family][data] * powers(_BASES[family], len(data)), out=out[1:])
    return out


def window_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, family: int = 0) -> np.ndarray:
    """Fingerprints of data[start:end]; they do not depend on where the bytes stand."""
    return mix64((prefix[end] - prefix[start]) * powers(_INVERSES[family], len(prefix))[start])


def rolling_hashes(prefix: np.ndarray, size: int, family: int = 0) -> np.ndarray:
    """Unmixed fingerprints of all windows of ``size`` bytes."""
    n = len(prefix) - size
    return (prefix[size:] - prefix[:n]) * powers(_INVERSES[family], len(prefix))[:n] if n > 0 else np.zeros(0, _U)


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word ``[^\\x20\\x09-\\x0D]+``, A-Z in lower case; rows are data[ends[i]:ends[i+1]]."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    low = np.where((data >= 65) & (data <= 90), data | 32, data)
    first = ends[:-1][ends[:-1] < len(data)]
    before = np.empty(len(data), bool)
    before[1:] = space[:-1]
    before[first] = True
    start = np.flatnonzero(~space & before)
    after = np.empty(len(data), bool)
    after[:-1] = space[1:]
    after[first[first > 0] - 1] = True
    if len(data):
        after[-1] = True
    end = np.flatnonzero(~space & after) + 1
    return window_hashes(prefix_hashes(low), start, end), np.searchsorted(ends, start, "right") - 1


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct fingerprints of its shingles of ``words`` words.

    A text with fewer words has one shingle, its whole sequence; one without words has none.
    """
    data, at = text_buffer(column)
    factors = seeds(words + 1, 3) | _U(1)
    for first, last in chunks(at):
        part, ends = data[at[first] : at[last]], at[first : last + 1] - at[first]
        hashes, row = word_hashes(part, ends)
        bounds = np.searchsorted(row, np.arange(last - first + 1))
        whole = max(len(hashes) - words + 1, 0)
        shingles = np.full(whole, factors[words], _U)
        for i in range(words):
            shingles += hashes[i : i + whole] * factors[i]
        shingles = mix64(shingles)
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if hi - lo >= words:
                yield np.unique(shingles[lo : hi - words + 1])
            elif hi > lo:
                n = hi - lo
                one = _U(n) + (hashes[lo:hi] * factors[:n]).sum(dtype=_U, keepdims=True)
                yield mix64(one)
            else:
                yield np.zeros(0, _U)
