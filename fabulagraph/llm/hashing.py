"""Hashes of words and of runs of words, over arrays of bytes.

Words are hashed by a polynomial over a fixed random table of bytes (prefix sums modulo
2 ** 64 give every word's sum at once), mixed with the length.  The same text has the same
hashes on every executor and in every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes hashed at once.
CHUNK = 1 << 20

_U = np.uint64
_RATIO = 0x9E3779B97F4A7C15 | 1
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_POWERS: list[np.ndarray] = []

#: Byte tables: what a byte becomes, 0 where it parts words.
_SPACES = {9, 10, 11, 12, 13, 32}
FOLDED = np.array([0 if b in _SPACES else b + 32 if 65 <= b <= 90 else b if b else 256 for b in range(256)], np.uint16)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 2 * CHUNK)
        _POWERS.clear()
        for base in (_RATIO, pow(_RATIO, -1, 1 << 64)):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _POWERS.append(np.multiply.accumulate(step))
    return _POWERS[0], _POWERS[1]


def word_hashes(text: bytes, table: np.ndarray = FOLDED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of the words of one text or of several joined by white space; offsets are in bytes."""
    n = len(text)
    if n == 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none
    kinds = table[np.frombuffer(text, np.uint8)]
    inside = np.zeros(n + 2, np.int8)
    inside[1:-1] = kinds != 0
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    out = np.empty(len(starts), np.uint64)
    up, down = _powers(min(n, 2 * CHUNK))
    values = _BYTES[kinds & np.uint16(255)]
    done = 0
    while done < len(starts):
        # whole words within a chunk; a word longer than a chunk has one for itself
        first = starts[done]
        upto = max(done + 1, int(np.searchsorted(ends, first + CHUNK, "right")))
        size = int(ends[upto - 1] - first)
        if size > len(up):
            up, down = _powers(size)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(values[first : first + size] * up[:size], out=sums[1:])
        a, b = starts[done:upto] - first, ends[done:upto] - first
        out[done:upto] = (sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * _U(0xD6E8FEB86659FD93)
        done = upto
    return mix(out), starts, ends


def runs(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words; order counts."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    h = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        h = mix(h + words[k : len(words) - n + 1 + k] * _U(2 * k + 3))
    return h


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """The set of runs of ``n`` words, ascending; fewer words, but not none, are one shingle."""
    if len(words) == 0:
        return np.zeros(0, np.uint64)
    return np.unique(runs(words, min(n, len(words))))


def batches_of_words(texts: list[bytes], table: np.ndarray = FOLDED) -> Iterator[tuple[int, np.ndarray]]:
    """(number, word hashes) of each text; small texts are hashed together."""
    group: list[int] = []
    held = 0
    for i in range(len(texts) + 1):
        if i == len(texts) or held >= CHUNK:
            joined = b"\n".join(texts[g] for g in group)
            hashes, starts, _ = word_hashes(joined, table)
            at = np.searchsorted(starts, np.cumsum([0] + [len(texts[g]) + 1 for g in group]))
            for k, g in enumerate(group):
                yield g, hashes[at[k] : at[k + 1]]
            group, held = [], 0
        if i < len(texts):
            group.append(i)
            held += len(texts[i])
