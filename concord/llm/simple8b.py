"""Simple-8b: unsigned integers packed into 64-bit words, vectorised.

The low four bits of a word are its selector: how many values it holds and how
wide they are.  Selector 0 is an escape: the next word is one value of more
than 60 bits, as it stands.  A block's last word may hold fewer values than its
selector says; the block's own count tells.
"""

from __future__ import annotations

import numpy as np

# Fixed values of the published Simple-8b format: values per word, bits per value (selectors 2 to 15).
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
ESCAPE, FIRST = 0, 2
WIDEST = 60


def encode(values: np.ndarray) -> np.ndarray:
    """uint64 words of a block of unsigned integers, in order.  An empty block has no words."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    most = int(values.max())
    small = values.astype(np.uint32) if most < 1 << 32 else values
    places = np.arange(n, dtype=np.int32)
    left = n - places
    choice = np.full(n, len(COUNTS), dtype=np.int8)  # beyond the last: escape
    start = next((k for k in range(len(COUNTS)) if most < 1 << BITS[k]), None)
    if start is None:
        choice[values < np.uint64(1 << WIDEST)] = start = len(COUNTS) - 1
    else:
        choice[:] = start
        choice[left < COUNTS[start]] = start
    for k in range(start - 1, -1, -1):
        at = np.flatnonzero(small >= (1 << BITS[k]))
        # how far it is from each place to the next value that is too wide
        ends = np.append(at, n)
        gaps = np.diff(ends, prepend=-1)
        if gaps.max() <= COUNTS[k] and n >= COUNTS[k]:
            break  # no run is long enough for this selector, so none is for denser ones
        nearest = np.repeat(ends, gaps).astype(np.int32)[:n]
        choice[nearest - places >= np.minimum(COUNTS[k], left)] = k
    steps = np.array([*COUNTS, 1])[choice].tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += steps[at]
    first = np.array(starts)
    chosen = choice[first]
    room = np.where(chosen == len(COUNTS), 2, 1)
    slot = np.cumsum(room) - room
    words = np.zeros(int(room.sum()), dtype=np.uint64)
    padded = np.concatenate([values, np.zeros(max(COUNTS), dtype=np.uint64)])
    for k in np.unique(chosen):
        own = chosen == k
        at = first[own]
        if k == len(COUNTS):
            words[slot[own]] = ESCAPE
            words[slot[own] + 1] = values[at]
            continue
        word = np.full(len(at), FIRST + k, dtype=np.uint64)
        for j in range(COUNTS[k]):
            take = padded[at + j] if at[-1] + COUNTS[k] <= n else np.where(at + j < n, padded[at + j], np.uint64(0))
            word |= take << np.uint64(4 + j * BITS[k])
        words[slot[own]] = word
    return words


def decode(words: np.ndarray, n: int) -> np.ndarray:
    """The n values of a block."""
    words = np.ascontiguousarray(words, dtype=np.uint64)
    out = np.zeros(n + max(COUNTS), dtype=np.uint64)
    if not n:
        return out[:0]
    selector = (words & np.uint64(15)).astype(np.int64)
    real = np.ones(len(words), dtype=bool)
    if (selector == ESCAPE).any():  # a raw word may look like anything, so walk over the escapes in order
        at = 0
        for e in np.flatnonzero(selector == ESCAPE).tolist():
            if e >= at and real[e]:
                real[e + 1] = False
                at = e + 2
    held = np.where(selector == ESCAPE, 1, np.array([0, 0, *COUNTS])[selector])
    held[~real] = 0
    start = np.cumsum(held) - held
    escapes = np.flatnonzero(real & (selector == ESCAPE))
    out[start[escapes]] = words[escapes + 1] if len(escapes) else 0
    for k in range(len(COUNTS)):
        own = np.flatnonzero(real & (selector == FIRST + k))
        if len(own):
            mask = np.uint64((1 << BITS[k]) - 1)
            for j in range(COUNTS[k]):
                place = start[own] + j
                inside = place < n
                out[place[inside]] = (words[own[inside]] >> np.uint64(4 + j * BITS[k])) & mask
    return out[:n]
