"""Numpy kernels over blocks of texts: words, their hashes and hashes of byte n-grams, for use inside Arrow batches."""

from __future__ import annotations

import functools

import numpy as np

U = np.uint64
#: Fixed odd multipliers of the hashes.
BASE = 0x9E3779B97F4A7C15
MIX_1, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
SHINGLE = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)
#: Bytes of text that a kernel takes at once; a longer text is taken alone.
BLOCK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(MIX_1)
    x = (x ^ (x >> U(27))) * U(MIX_2)
    return x ^ (x >> U(31))


@functools.lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """By byte: whether it is white space, and itself with A-Z in lower case."""
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    lower = np.arange(256, dtype=np.uint8)
    lower[ord("A") : ord("Z") + 1] += 32
    return space, lower


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * BLOCK)
        inverse = pow(BASE, -1, 1 << 64)
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, U), np.full(size - 1, b, U)])) for b in (BASE, inverse)]
    return _powers[0][:n], _powers[1][:n]


def words(texts: list[bytes], prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, list[np.ndarray]]:
    """Document number of every word of the texts, and its hash, followed by the hashes of its prefixes of so many bytes.

    A word is a maximal run of anything but white space; equal words (A-Z lowered) have equal 64-bit hashes. A word that
    is no longer than a prefix stands for it.
    """
    space, lower = tables()
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    gap = space[data]
    data = lower[data]
    edge = np.diff(gap.astype(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    ends = ends[1:] if len(ends) > len(starts) else ends
    up, down = powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, U), np.cumsum((data.astype(U) + U(1)) * up[: len(data)])])
    cuts = [ends, *[np.minimum(starts + n, ends) for n in prefixes]]
    hashes = [mix((sums[at] - sums[starts]) * down[starts] + (at - starts).astype(U) * U(SHINGLE[0])) for at in cuts]
    first = np.cumsum([0, *[len(t) + 1 for t in texts]])
    doc = np.searchsorted(first, starts, side="right") - 1
    return doc, hashes


def shingle_sets(texts: list[bytes], k: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; fewer words make one shingle, no words none."""
    doc, (h,) = words(texts)
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    if len(h) >= k:
        total = sum((mix(h[i : len(h) - k + 1 + i] + U(SHINGLE[i % 5] >> (i // 5))) * U(SHINGLE[(i + 1) % 5]) for i in range(k)), np.zeros(len(h) - k + 1, U))
        total = mix(total)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= k:
            out.append(np.unique(total[a : b - k + 1]))
        elif b > a:
            short = np.array([b - a], U)
            for i in range(a, b):
                short = mix(short * U(SHINGLE[1]) + h[i : i + 1])
            out.append(short)
        else:
            out.append(np.zeros(0, U))
    return out


def as_bytes(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
