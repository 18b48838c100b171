"""Words of whole texts as numpy arrays: byte spans, 64-bit hashes, hashes of word windows.

All work is done on the UTF-8 bytes of an Arrow column at once. A word is a run of bytes that
``word_bytes`` marks, so it suits contracts whose separators are ASCII. Window hashes are
polynomials over the word hashes (differences of prefix sums), so every window of a text
costs the same whatever its width.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Byte classes of the contracts.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALPHANUMERIC = np.zeros(256, bool)  # digits, ASCII letters, every byte of a longer character
ALPHANUMERIC[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_rng = np.random.default_rng(20240229)
_BYTE_CODE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93]
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Bijective scrambling of 64-bit values (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64; kept up to 8 MB, as idle workers hold on to it."""
    base &= 0xFFFFFFFFFFFFFFFF
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(n + 1, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 1 << 20:
            _powers[base] = have
    return have[:n + 1]


def rolling(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """Polynomial hash of values[starts:ends] for every pair of bounds."""
    base = _BASES[which]
    inverse = pow(base, -1, 1 << 64)
    prefix = np.empty(len(values) + 1, np.uint64)
    prefix[0] = 0
    np.cumsum(values * _power(base, len(values))[:-1], out=prefix[1:])
    return (prefix[ends] - prefix[starts]) * _power(inverse, len(values))[starts]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


@dataclass
class Words:
    data: np.ndarray    # the bytes
    starts: np.ndarray  # of each word
    ends: np.ndarray
    first: np.ndarray   # number of words before each row, and of all

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        return mix(rolling(_BYTE_CODE[self.data], self.starts, self.ends, 0))

    def word(self, i: int) -> str:
        return self.data[self.starts[i]:self.ends[i]].tobytes().decode("utf-8", "replace")


def words(column: pa.Array, word_bytes: np.ndarray = NOT_SPACE, lower: bool = False) -> Words:
    data, at = flat(column)
    if lower:
        data = LOWER[data]
    inside = word_bytes[data]
    cut = np.zeros(len(data) + 1, bool)  # a row begins here
    cut[at] = True
    begin = inside & (cut[:-1] | np.r_[True, ~inside[:-1]][:len(data)])
    end = inside & (cut[1:] | np.r_[~inside[1:], True][:len(data)])
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(end) + 1
    return Words(data, starts, ends, np.searchsorted(starts, at))


def windows(hashes: np.ndarray, first: np.ndarray, width: int, which: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which ``width`` words of one row start, and their hashes."""
    n = np.diff(first)
    last = np.repeat(first[1:], n) - width  # the last start within the row
    at = np.flatnonzero(np.arange(len(hashes)) <= last)
    return at, mix(rolling(mix(hashes, which), at, at + width, which), which)
