"""Rolling hashes, word spans and minimizers over byte arrays, in numpy.

All hashes are polynomials modulo 2**64 (Rabin-Karp): with prefix sums of
value * base**i, the hash of any window is one difference and one product with
a power of the base's inverse. Results are mixed, so all 64 bits count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes that separate words: the space and U+0009 to U+000D. They never occur inside a UTF-8 sequence.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Fixed odd bases.
BYTE_BASE, WORD_BASE, WORD_BASE_2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
#: Bytes hashed at a time.
PIECE = 1 << 19

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over all bits (the finalizer of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        m = max(n, 1 << 16)
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(m, b, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        have = _POWERS[base] = (made[0], made[1])
    return have[0][:n], have[1][:n]


def prefix_sums(values: np.ndarray, base: int) -> np.ndarray:
    """S with S[j] = sum of values[i] * base**i for i below j."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values))[0], out=out[1:])
    return out


def windows(values: np.ndarray, size: int, base: int) -> np.ndarray:
    """Mixed hashes of all windows of `size` values."""
    if len(values) < size:
        return np.zeros(0, np.uint64)
    s = prefix_sums(values, base)
    return mix((s[size:] - s[:-size]) * powers(base, len(values) - size + 1)[1])


def spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Mixed hashes of values[start:end], one for each pair; the length counts too."""
    s = prefix_sums(values, base)
    return mix((s[ends] - s[starts]) * powers(base, len(values) + 1)[1][starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a byte array start and end."""
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = ~IS_SPACE[buf]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, computed over pieces of the array."""
    out = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        stop = int(np.searchsorted(ends, starts[k] + PIECE, "right"))
        stop = max(stop, k + 1)
        low = starts[k]
        out[k:stop] = spans(buf[low : ends[stop - 1]].astype(np.uint64) + np.uint64(1), starts[k:stop] - low, ends[k:stop] - low, BYTE_BASE)
        k = stop
    return out


def sliding_min(a: np.ndarray, size: int) -> np.ndarray:
    """The least value of every window of `size`, from running minima of blocks to the right and to the left."""
    n = len(a)
    if n < size:
        return a[:0]
    blocks = np.full(-(-n // size) * size, np.iinfo(a.dtype).max, a.dtype)
    blocks[:n] = a
    blocks = blocks.reshape(-1, size)
    right = np.minimum.accumulate(blocks, axis=1).ravel()
    left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(left[: n - size + 1], right[size - 1 : n])


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One byte array of all texts, each followed by a line feed, and the place of each text, with the end at last."""
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    return np.frombuffer(b"\n".join([*texts, b""]), np.uint8), np.concatenate([np.zeros(1, np.int64), ends])


def runs(limit: int, sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of items with about `limit` in size each, one item at least."""
    start = held = 0
    for k, n in enumerate(sizes):
        held += n
        if held >= limit:
            yield start, k + 1
            start, held = k + 1, 0
    if start < len(sizes):
        yield start, len(sizes)
