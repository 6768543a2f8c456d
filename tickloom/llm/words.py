"""Words of many texts at once, as arrays: places, hashes and hashes of windows.

Hashes are polynomial and taken modulo 2**64: with prefix sums the hash of any stretch is one
difference and one product (the rolling hash of Rabin and Karp, for all windows at once).
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Bytes (or words) that are hashed in one step; bounds memory whatever the length of a text.
STEP = 1 << 19
#: Longer words are hashed one by one, by XXH64: from 1,024 bytes on, two words of two letters in
#: the order of Thue and Morse have one polynomial hash, whatever its base.
LONG = 512
MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15


def byte_class(outside: bytes) -> np.ndarray:
    """Which bytes belong to words, given those that do not."""
    inside = np.ones(256, bool)
    inside[np.frombuffer(outside, np.uint8)] = False
    return inside


#: Words are runs of [^\x20\x09-\x0D].
SPACED = byte_class(b" \t\n\x0b\x0c\r")


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, base, np.uint64)]), dtype=np.uint64)


UP = _powers(BASE, STEP + 2 * LONG)
DOWN = _powers(pow(BASE, -1, 1 << 64), STEP + 2 * LONG)
BYTES = np.array([xxhash.xxh64_intdigest(bytes([b]), 7) for b in range(256)], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def spans(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of words of each text."""
    within = np.zeros(len(data) + 1, bool)
    within[:-1] = inside[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[bounds] = True
    before = np.zeros(len(data) + 1, bool)
    before[1:] = within[:-1]
    starts = np.flatnonzero(within & (~before | cut))
    ends = np.flatnonzero(before & (~within | cut))
    return starts, ends, np.diff(np.searchsorted(starts, bounds))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTES) -> np.ndarray:
    """A 64-bit hash of each word; `table` gives a number to each byte."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    long = np.flatnonzero(ends - starts > LONG)
    first = 0
    while first < len(starts):
        low = int(starts[first])
        last = int(np.searchsorted(starts, low + STEP))
        a, b = starts[first:last] - low, ends[first:last] - low
        b = np.where(b - a > LONG, a, b)
        high = int(b.max())
        sums = np.zeros(high + 1, np.uint64)
        np.cumsum(table[data[low : low + high]] * UP[:high], out=sums[1:])
        out[first:last] = (sums[b] - sums[a]) * DOWN[a]
        first = last
    out = mixed(out)
    for i in long.tolist():
        codes = table[data[starts[i] : ends[i]]]
        out[i] = xxhash.xxh64_intdigest(codes.tobytes(), 11)
    return out


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of `width` entries, one per start."""
    n = max(0, len(words) - width + 1)
    out = np.empty(n, np.uint64)
    for low in range(0, n, STEP):
        high = min(n, low + STEP)
        part = words[low : high + width - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * UP[: len(part)], out=sums[1:])
        out[low:high] = (sums[width:] - sums[:-width]) * DOWN[: high - low]
    return mixed(out)


def windows_inside(counts: np.ndarray, width: int) -> np.ndarray:
    """Whether the run of `width` words that starts at a word ends in the same text."""
    left = np.repeat(np.cumsum(counts), counts) - np.arange(counts.sum())
    return left >= width
