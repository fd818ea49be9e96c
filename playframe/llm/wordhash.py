"""Word and shingle hashes of a batch of texts, whole batches at a time.

Words are runs of anything but ASCII white space in the lower-cased text. The
hash of a word is a polynomial of its UTF-8 bytes modulo 2**64 taken from prefix
sums, so no word becomes a Python object.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: texts are hashed together up to about this many bytes; a longer text stands alone
BLOCK_BYTES = 1 << 20

_space = np.zeros(256, dtype=bool)
_space[[9, 10, 11, 12, 13, 32]] = True
_powers = {"n": 0}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _grow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        size = max(n, BLOCK_BYTES * 2)
        for key, base in (("up", BASE), ("down", INVERSE)):
            p = np.full(size, U(base), dtype=U)
            p[0] = 1
            _powers[key] = np.multiply.accumulate(p)
        _powers["n"] = size
    return _powers["up"], _powers["down"]


def blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BLOCK_BYTES."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BLOCK_BYTES:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and per text where its words start (one more at the end)."""
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    buf = np.frombuffer(b" ".join([*raw, b""]) + b" ", dtype=np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw])
    word = ~_space[buf]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if word[0]:
        edge = np.concatenate(([0], edge))
    first, last = edge[0::2], edge[1::2]
    up, down = _grow(len(buf) + 1)
    total = np.empty(len(buf) + 1, dtype=U)
    total[0] = 0
    np.cumsum((buf.astype(U) + U(1)) * up[: len(buf)], out=total[1:])
    hashes = mix((total[last] - total[first]) * down[first] + (last - first).astype(U))
    offsets = np.concatenate(([0], np.searchsorted(first, ends)))
    return hashes, offsets


def shingles(hashes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``n`` words of each text and their offsets. A text
    of 1 to n-1 words has one shingle, of all its words; one without has none."""
    counts = np.diff(offsets)
    made = np.where(counts >= n, counts - n + 1, (counts > 0).astype(counts.dtype))
    out_offsets = np.concatenate(([0], np.cumsum(made)))
    total = int(out_offsets[-1])
    if not total:
        return np.empty(0, dtype=U), out_offsets
    at = np.arange(total) - np.repeat(out_offsets[:-1], made) + np.repeat(offsets[:-1], made)
    stop = np.repeat(offsets[1:], made)
    padded = np.concatenate((hashes, np.zeros(n, dtype=U)))
    acc = np.zeros(total, dtype=U)
    short = np.repeat(counts < n, made)
    for j in range(n):
        part = padded[at + j]
        if short.any():
            part = np.where(at + j < stop, part, U(0))
        acc = mix(acc * U(BASE) + part + U(j + 1))
    return acc, out_offsets


def distinct(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, how often each occurs, and offsets."""
    parts, counts, sizes = [], [], []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        u, c = np.unique(values[a:b], return_counts=True)
        parts.append(u)
        counts.append(c)
        sizes.append(len(u))
    out = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    if not parts:
        return np.empty(0, dtype=U), np.empty(0, dtype=np.int64), out
    return np.concatenate(parts), np.concatenate(counts), out
