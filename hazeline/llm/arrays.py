"""Vectorised text primitives: word cutting and polynomial hashes over whole batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def eights_of(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number (zeros behind the end)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, "<u8", padded.data, strides=(1,))


def _steps(eights: np.ndarray, starts: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which strings, their next eight bytes or what is left of them), step by step."""
    own, at, left = np.arange(len(starts)), starts, size
    while len(own):
        part = eights[at]
        short = left < 8
        part[short] &= (U64(1) << (left[short].astype(U64) * U64(8))) - U64(1)
        yield own, part
        more = left > 8
        own, at, left = own[more], at[more] + 8, left[more] - 8


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings data[start:end], eight bytes a step.

    Each step is mixed, so no family of strings collides by its form, as the
    words of Thue and Morse do under polynomials modulo 2**64.
    """
    size = ends - starts
    out = mix(size.astype(U64) + U64(0x8CB92BA72F3D8DD7))
    for own, part in _steps(eights_of(data), starts, size):
        out[own] = mix((out[own] ^ part) * U64(0xD6E8FEB86659FD93) + U64(0x589965CC75374CC3))
    return out


def same_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each string equals, byte for byte, the one numbered ``other``."""
    eights, size = eights_of(data), ends - starts
    out = size == size[other]
    own = np.flatnonzero(out & (other != np.arange(len(other))))
    mine, its = (_steps(eights, starts[which], size[own]) for which in (own, other[own]))
    for (which, a), (_, b) in zip(mine, its, strict=True):
        out[own[which[a != b]]] = False
    return out


def shared_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bytes that each string has in common with the one before it at their beginnings; 0 for the first."""
    eights, size = eights_of(data), ends - starts
    most = np.minimum(size, np.concatenate([np.zeros(1, size.dtype), size[:-1]]))
    out = np.zeros(len(starts), np.int64)
    own = np.flatnonzero(most > 0)
    while len(own):
        differ = eights[starts[own] + out[own]] ^ eights[starts[own - 1] + out[own]]
        lowest = differ & (~differ + U64(1))
        same = np.where(differ == 0, 8, np.log2(np.maximum(lowest, U64(1)).astype(np.float64)).astype(np.int64) // 8)
        out[own] += same
        own = own[(same == 8) & (out[own] < most[own])]
    return np.minimum(out, most)


def chunks(texts: list, limit: int) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of texts of at most ``limit`` characters together; one longer text stands alone."""
    i, total = 0, 0
    for j, t in enumerate(texts):
        if j > i and total + len(t) > limit:
            yield i, j
            i, total = j, 0
        total += len(t)
    if i < len(texts):
        yield i, len(texts)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated aranges: start, start+1, ... of each count."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(counts) - counts
    return np.repeat(starts - first, counts) + np.arange(total)
