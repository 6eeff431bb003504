"""Sets of word shingles as sorted arrays of 64-bit codes, by vector operations over many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 2 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(z: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _spread(n: int, seed: int) -> np.ndarray:
    return mix((np.arange(n, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


BYTES = _spread(256, 1000)


def word_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all words of all texts (A-Z lower-cased) and the first word of each text, with the number at the end."""
    buffer = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    inside = ~SPACE[buffer]
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=np.int8(0)))
    start, end = edge[0::2], edge[1::2]
    first = np.concatenate(([0], np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]))))
    if not len(start):
        return np.zeros(0, np.uint64), first
    size = end - start
    at = np.cumsum(size) - size
    place = np.arange(size.sum(), dtype=np.int64) - np.repeat(at, size)
    codes = BYTES[buffer[inside]] * _spread(int(size.max()), 5000)[place]
    return mix(np.add.reduceat(codes, at) + size.astype(np.uint64)), first


def shingle_sets(texts: list[bytes], k: int = 5) -> list[np.ndarray]:
    """Per text the sorted codes of its distinct k-word shingles; a text of fewer words has one, without words none."""
    w, first = word_codes(texts)
    odd = _spread(k, 9000)
    n = len(w) - k + 1
    full = mix(sum((w[i : n + i] * odd[i] for i in range(1, k)), w[:n] * odd[0])) if n > 0 else np.zeros(0, np.uint64)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(full[a : b - k + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            out.append(mix(np.array([(w[a:b] * odd[: b - a]).sum() + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def pieces(column: pa.Array, size: int = PIECE) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as UTF-8) of a string column, about ``size`` bytes at a time; null counts as empty."""
    rows, total, at = [], 0, 0
    for i, t in enumerate(column.cast(pa.large_binary())):
        t = t.as_py() or b""
        rows.append(t)
        total += len(t)
        if total >= size:
            yield at, rows
            rows, total, at = [], 0, i + 1
    if rows:
        yield at, rows
