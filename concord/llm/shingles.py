"""Hashed word shingles of whole texts, by whole arrays.

Words are maximal runs without ASCII white space, with A-Z lower-cased.  Each
word gets a 64-bit hash from a table of random numbers and powers of an odd
base; each shingle mixes its words' hashes with their places.  A text with
fewer words than the width has one shingle, its whole sequence; a text without
words has none.
"""

from __future__ import annotations

import numpy as np

#: Bytes of text that are hashed together.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_COUNTER = np.arange(1, 257, dtype=np.uint64)
with np.errstate(over="ignore"):
    _BYTE = mix(_COUNTER * np.uint64(0x9E3779B97F4A7C15))
    _PLACE = mix(_COUNTER * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_BASE = np.uint64(0x2545F4914F6CDD1D)
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and how many each text has."""
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    inside = _IS_WORD[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.concatenate([[0], edges])
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    lengths = ends - starts
    letters = data[inside]
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(letters)) - np.repeat(first, lengths)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(lengths.max()), _BASE, dtype=np.uint64))
        hashes = mix(np.add.reduceat(_BYTE[letters] * powers[place], first) + lengths.astype(np.uint64))
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(starts, bounds), prepend=0)


def _shingles(texts: list[bytes], width: int) -> list[np.ndarray]:
    hashes, counts = _word_hashes(texts)
    ends = np.cumsum(counts)
    with np.errstate(over="ignore"):
        full = np.zeros(max(len(hashes) - width + 1, 0), dtype=np.uint64)
        for j in range(width):
            full += hashes[j : j + len(full)] * _PLACE[j]
        full = mix(full)
        out = []
        for end, n in zip(ends.tolist(), counts.tolist(), strict=True):
            if n >= width:
                found = full[end - n : end - width + 1]
            elif n:
                found = mix((hashes[end - n : end] * _PLACE[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
            else:
                found = hashes[:0]
            out.append(np.unique(found))
    return out


def shingle_sets(texts: list[str | None], width: int):
    """For each text the sorted distinct hashes of its shingles (uint64), made about a megabyte at a time."""
    some: list[bytes] = []
    size = 0
    for text in texts:
        some.append((text or "").encode("utf-8", "surrogatepass"))
        size += len(some[-1])
        if size >= CHUNK:
            yield from _shingles(some, width)
            some, size = [], 0
    if some:
        yield from _shingles(some, width)


def signed(hashes: np.ndarray) -> np.ndarray:
    """The same order as signed integers, as Spark has no unsigned ones."""
    return (hashes ^ np.uint64(1 << 63)).view(np.int64)
