"""Array kernels with no SQL counterpart: affine-gap and CRF string distances, centroid linkage with a flat cut.

The string distances take whole columns: pairs of one shape class are computed
together, one row of the recurrence for all pairs at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the affine-gap distance.
MATCH, MISMATCH, GAP_OPEN, GAP_EXTEND, ABBREVIATION = 1.0, 11.0, 10.0, 7.0, 0.125
_FAR = np.float32(2.0**31)

# Fixed values of the CRF edit model: for start, match, delete and insert, of both states, the weights of bias and match.
CRF_WEIGHTS = np.array(
    [
        [-0.22937526, 0.51326066],
        [0.01038001, -0.13348901],
        [-0.03062821, 0.13769178],
        [0.02024813, -0.01835538],
        [0.09208272, 0.15466022],
        [-0.08170265, -0.02484392],
        [-0.01762858, 0.17504624],
        [0.02800866, -0.04442708],
    ]
)

#: Pairs of strings that are computed together, by the cells of their tables.
CELLS = 4_000_000


def _codes(texts: list[str], width: int) -> np.ndarray:
    """Code points as rows of one array, padded with -1."""
    out = np.full((len(texts), width), -1, dtype=np.int32)
    for row, text in zip(out, texts, strict=True):
        row[: len(text)] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.int32)
    return out


def _batched(pairs: list[tuple[str, str]], kernel: Callable[[list[str], list[str]], np.ndarray]) -> np.ndarray:
    """Run a kernel on groups of pairs of like lengths; pairs are (shorter, longer)."""
    out = np.full(len(pairs), np.nan)
    order = sorted(range(len(pairs)), key=lambda i: (len(pairs[i][1]), len(pairs[i][0])))
    at = 0
    while at < len(order):
        width = len(pairs[order[at]][1])
        end = at
        while end < len(order) and (end - at + 1) * (len(pairs[order[end]][1]) + 1) <= CELLS and len(pairs[order[end]][1]) <= width + 8:
            end += 1
        end = max(end, at + 1)
        some = order[at:end]
        out[some] = kernel([pairs[i][0] for i in some], [pairs[i][1] for i in some])
        at = end
    return out


def _affine_rows(short: list[str], long: list[str]) -> np.ndarray:
    """Affine-gap distances.  Insertions beyond the shorter length cost less, and column by column is the only order."""
    n_short = np.array([len(s) for s in short])
    n_long = np.array([len(s) for s in long])
    b, a = _codes(short, int(n_short.max(initial=0))), _codes(long, int(n_long.max(initial=0)))
    rows, width = len(long), a.shape[1]
    f = np.float32
    best = np.zeros((width + 1, rows), dtype=f)
    best[1:] = (f(GAP_OPEN) + f(GAP_EXTEND) * np.arange(1, width + 1, dtype=f))[:, None]
    down = np.full((width + 1, rows), _FAR, dtype=f)
    scale = np.where(np.arange(1, width + 1)[:, None] <= n_short[None, :], f(1), f(ABBREVIATION)).astype(f)
    result = best[n_long, np.arange(rows)].copy()
    columns = np.ascontiguousarray(a.T)
    for i in range(1, b.shape[1] + 1):
        above = best.copy()
        letter = b[:, i - 1]
        best[0] = f(GAP_OPEN) + f(GAP_EXTEND) * f(i)
        right = np.full(rows, _FAR, dtype=f)
        for j in range(1, width + 1):
            k = scale[j - 1]
            right = np.minimum(right, best[j - 1] + f(GAP_OPEN) * k) + f(GAP_EXTEND) * k
            down[j] = np.minimum(down[j], above[j] + f(GAP_OPEN)) + f(GAP_EXTEND)
            step = above[j - 1] + np.where(columns[j - 1] == letter, f(MATCH), f(MISMATCH))
            best[j] = np.minimum(np.minimum(right, down[j]), step)
        done = n_short == i
        result[done] = best[n_long[done], np.flatnonzero(done)]
    return result


def affine_gap(left: list[str | None], right: list[str | None]) -> np.ndarray:
    """Normalised affine-gap distances; NaN where a side is null or both are empty."""
    out = np.full(len(left), np.nan, dtype=np.float32)
    pairs: dict[tuple[str, str], list[int]] = {}
    for i, (x, y) in enumerate(zip(left, right, strict=True)):
        if x is None or y is None:
            continue
        if x == y:
            out[i] = 0.5 if x else np.nan
            continue
        pair = (y, x) if (len(x), x) > (len(y), y) else (x, y)
        pairs.setdefault(pair, []).append(i)
    distinct = list(pairs)
    for pair, value in zip(distinct, _batched(distinct, _affine_rows), strict=True):
        out[pairs[pair]] = np.float32(value) / np.float32(len(pair[0]) + len(pair[1]))
    return out


def _crf_rows(short: list[str], long: list[str]) -> np.ndarray:
    """Probability of the second state at the end of the lattice, over anti-diagonal-free rows of all pairs."""
    n_short = np.array([len(s) for s in short])
    n_long = np.array([len(s) for s in long])
    a, b = _codes(short, int(n_short.max())), _codes(long, int(n_long.max()))
    rows = np.arange(len(short))
    final = np.zeros((2, len(short)))
    for s in (0, 1):
        own, match, delete, insert = (CRF_WEIGHTS[p + s] for p in (0, 2, 4, 6))
        previous = None
        for i in range(a.shape[1]):
            same = (a[:, i : i + 1] == b).astype(float)
            here, step, gone, come = (w[0] + w[1] * same for w in (own, match, delete, insert))
            current = np.empty_like(here)
            current[:, 0] = here[:, 0] + (0.0 if previous is None else previous[:, 0] + come[:, 0])
            for j in range(1, b.shape[1]):
                left = current[:, j - 1] + gone[:, j]
                if previous is not None:
                    left = np.logaddexp(np.logaddexp(previous[:, j] + come[:, j], left), previous[:, j - 1] + step[:, j])
                current[:, j] = here[:, j] + left
            done = n_short == i + 1
            final[s, done] = current[rows[done], n_long[done] - 1]
            previous = current
    return np.exp(final[1] - np.logaddexp(final[0], final[1]))


def crf_distance(left: list[str | None], right: list[str | None]) -> np.ndarray:
    """CRF edit distances; NaN where a side is null or empty."""
    out = np.full(len(left), np.nan, dtype=np.float32)
    pairs: dict[tuple[str, str], list[int]] = {}
    for i, (x, y) in enumerate(zip(left, right, strict=True)):
        if x and y:
            pairs.setdefault((y, x) if len(x) > len(y) else (x, y), []).append(i)
    distinct = list(pairs)
    for pair, value in zip(distinct, _batched(distinct, _crf_rows), strict=True):
        out[pairs[pair]] = value
    return out


def _nullable(values: np.ndarray) -> pd.Series:
    return pd.Series(values.astype(np.float32)).astype("Float32").mask(pd.Series(np.isnan(values)))


def _affine_batches(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in batches:
        yield _nullable(affine_gap([None if pd.isna(x) else x for x in left], [None if pd.isna(x) else x for x in right]))


def _crf_batches(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in batches:
        yield _nullable(crf_distance([None if pd.isna(x) else x for x in left], [None if pd.isna(x) else x for x in right]))


def affine_gap_column(a: Column, b: Column) -> Column:
    return F.pandas_udf(_affine_batches, "float")(a, b)


def crf_column(a: Column, b: Column) -> Column:
    return F.pandas_udf(_crf_batches, "float")(a, b)


# -- centroid linkage --------------------------------------------------------------------------------


class _Queue:
    """A binary heap of the candidates' distances in which a key's value can change.

    Among equal values the order is that of a plain array heap: built bottom up,
    the left child preferred, moved only on strict comparison.
    """

    def __init__(self, values: np.ndarray):
        self.values = values.tolist()
        self.keys = list(range(len(self.values)))
        self.places = list(range(len(self.values)))
        self.size = len(self.values)
        for place in reversed(range(self.size // 2)):
            self._down(place)

    def _swap(self, a: int, b: int) -> None:
        v, k = self.values, self.keys
        v[a], v[b], k[a], k[b] = v[b], v[a], k[b], k[a]
        self.places[k[a]], self.places[k[b]] = a, b

    def _down(self, place: int) -> None:
        v = self.values
        while (child := 2 * place + 1) < self.size:
            child += child + 1 < self.size and v[child + 1] < v[child]
            if not v[place] > v[child]:
                return
            self._swap(place, child)
            place = child

    def _up(self, place: int) -> None:
        v = self.values
        while place and v[parent := (place - 1) // 2] > v[place]:
            self._swap(place, parent)
            place = parent

    def top(self) -> tuple[int, float]:
        return self.keys[0], self.values[0]

    def pop(self) -> None:
        self._swap(0, self.size - 1)
        self.size -= 1
        self._down(0)

    def change(self, key: int, value: float) -> None:
        place = self.places[key]
        old, self.values[place] = self.values[place], value
        if value < old:
            self._up(place)
        else:
            self._down(place)


def centroid_linkage(distances: np.ndarray, sizes: np.ndarray | None = None) -> list[tuple[int, int, float, int]]:
    """Merges (cluster, cluster, distance, size) by centroid linkage of a full distance matrix, which is overwritten.

    ``sizes`` says how many points at distance 0 of each other a row stands for.

    Müllner's generic algorithm (2011): every row keeps a lower bound of the
    distance to its nearest later neighbour in a queue; a bound that turns out
    too low is raised, and the first that holds is merged.
    """
    n = len(distances)
    if n < 2:
        return []
    d = distances
    size = np.ones(n, dtype=np.int64) if sizes is None else sizes.astype(np.int64)
    label = np.arange(n)
    alive = np.ones(n, dtype=bool)
    nearest = np.zeros(n, dtype=np.int64)
    bound = np.zeros(n)

    def search(x: int) -> tuple[int, float]:
        later = np.flatnonzero(alive[x + 1 :]) + x + 1
        row = d[x, later]
        best = int(row.argmin())
        return int(later[best]), float(row[best])

    for x in range(n - 1):
        nearest[x], bound[x] = search(x)
    queue = _Queue(bound[: n - 1])
    merges = []
    for step in range(n - 1):
        while True:
            x, distance = queue.top()
            y = int(nearest[x])
            if distance == d[x, y]:
                break
            y, distance = search(x)
            nearest[x], bound[x] = y, distance
            queue.change(x, distance)
        queue.pop()
        a, b = sorted((int(label[x]), int(label[y])))
        nx, ny = int(size[x]), int(size[y])
        merges.append((a, b, distance, nx + ny))
        # x goes, y stands for both
        alive[x] = False
        size[x], size[y], label[y] = 0, nx + ny, n + step
        others = np.flatnonzero(alive)
        others = others[others != y]
        with np.errstate(invalid="ignore"):
            new = np.sqrt((nx * d[x, others] ** 2 + ny * d[y, others] ** 2 - nx * ny * distance * distance / (nx + ny)) / (nx + ny))
        d[y, others] = d[others, y] = new
        # neighbours that pointed at x now point at y
        before = others[others < x]
        nearest[before[nearest[before] == x]] = y
        for z in others[others < y].tolist():
            if d[z, y] < bound[z]:
                nearest[z], bound[z] = y, d[z, y]
                queue.change(z, float(d[z, y]))
        if y < n - 1 and alive[y + 1 :].any():
            nearest[y], bound[y] = search(y)
            queue.change(y, float(bound[y]))
    return merges


def flat_cut(merges: list[tuple[int, int, float, int]], n: int, most: float) -> list[list[int]]:
    """Clusters as the maximal subtrees in which no merge is further than ``most``; centroid distances may shrink again on the way up."""
    members: dict[int, list[int]] = {i: [i] for i in range(n)}
    worst = dict.fromkeys(range(n), -np.inf)
    parts: dict[int, list[list[int]]] = {i: [[i]] for i in range(n)}
    top = 0
    for step, (a, b, distance, _) in enumerate(merges):
        top = n + step
        worst[top] = max(distance, worst[a], worst[b])
        members[top] = members.pop(a) + members.pop(b)
        split = parts.pop(a) + parts.pop(b)
        parts[top] = [members[top]] if worst[top] <= most else split
    found = parts[top] if merges else [p for k in parts for p in parts[k]]
    return [sorted(c) for c in found]


def cluster_component(ids: list, pairs: list[tuple[int, int, float]] | tuple[np.ndarray, ...], threshold: float, weights: np.ndarray | None = None) -> list[tuple[list, list[float]]]:
    """Clusters of two or more and each member's confidence, of one component.

    ``pairs`` are (place, place, score) over the sorted ids, as a list or as a
    tuple of three arrays; an absent pair has distance 1.  A single edge is a cluster if its score is above the threshold.
    ``weights`` says how many equal records each id stands for; one that stands for several is a cluster even alone.
    """
    n = len(ids)
    weights = np.ones(n, dtype=np.int64) if weights is None else weights
    left, right, scores = pairs if isinstance(pairs, tuple) else map(np.array, zip(*pairs, strict=True))
    if n == 2 and weights.sum() == 2:
        score = float(scores[0])
        return [(list(ids), [score, score])] if score > threshold else []
    left, right = np.minimum(left, right), np.maximum(left, right)
    last = len(left) - 1 - np.unique((left * np.int64(n) + right)[::-1], return_index=True)[1]  # of pairs that repeat
    left, right = left[last], right[last]
    edges = np.float32(1) - np.asarray(scores, dtype=np.float32)[last]
    d = np.ones((n, n))  # the only matrix; linkage overwrites it
    d[left, right] = d[right, left] = edges
    clusters = flat_cut(centroid_linkage(d, weights), n, 1 - threshold)
    del d
    of = np.empty(n, dtype=np.int64)
    for number, cluster in enumerate(clusters):
        of[cluster] = number
    # absent pairs count 1 each; what the edges inside a cluster differ from that is added up by member
    inside = of[left] == of[right]
    gain = (edges * edges).astype(np.float64)[inside] - 1
    total = np.bincount(left[inside], gain * weights[right[inside]], n) + np.bincount(right[inside], gain * weights[left[inside]], n)
    out = []
    for cluster in clusters:
        size = int(weights[cluster].sum())
        if size > 1:
            confidence = 1 - np.sqrt(np.maximum(total[cluster] + (size - weights[cluster]), 0.0) / (size - 1))
            out.append(([ids[i] for i in cluster], confidence.tolist()))
    return out


# -- best pairs by one number ----------------------------------------------------------------------------


def best_later(ids: np.ndarray, values: np.ndarray, likeness: Callable[[float, float], float], threshold: float, n: int) -> tuple[list, list, list]:
    """(id, other id, score) of, for each record, at least the n best pairs above a threshold with larger ids, by score, then larger other id.

    ``likeness`` must fall, or stay, as finite values part.  By ascending id, values of which no larger id
    is left drop out of a linked list, so that a record's nearest neighbours are steps away.
    Of records of one value the n largest ids are enough for all.  NaN is like everything, infinity like itself, as NaN is above all scores.
    """
    order = np.argsort(ids, kind="stable")
    ids, values = ids[order], values[order]
    known, place = np.unique(values, return_inverse=True)
    by_place = np.argsort(place, kind="stable")
    stops = np.searchsorted(place[by_place], np.arange(len(known)), side="right").tolist()
    top = [ids[by_place[max(stop - n, start) : stop]].tolist()[::-1] for start, stop in zip([0, *stops], stops, strict=False)]
    last, whole = [x[0] for x in top], ids[-n:].tolist()[::-1]
    finite = np.flatnonzero(np.isfinite(known)).tolist()
    anything = top[-1] if len(known) and np.isnan(known[-1]) else []
    known = known.tolist()
    low, high = (finite[0], finite[-1]) if finite else (0, -1)
    before, after = list(range(-1, len(known) - 1)), list(range(1, len(known) + 1))
    leaving = sorted(finite, key=last.__getitem__)
    gone, left_out = [False] * len(known), 0
    a, b, scores = [], [], []

    def add(x, others, score):
        count = len(a)
        for y in others:
            if y > x:
                a.append(x)
                b.append(y)
                scores.append(score)
        return len(a) - count

    for x, at in zip(ids.tolist(), place.tolist(), strict=True):
        while left_out < len(leaving) and last[leaving[left_out]] <= x:
            out = leaving[left_out]
            gone[out] = True
            p, q = before[out], after[out]
            if p >= low:
                after[p] = q
            if q <= high:
                before[q] = p
            left_out += 1
        value = known[at]
        if value != value:
            add(x, whole, math.nan)
            continue
        add(x, anything, math.nan)
        if not low <= at <= high:
            add(x, top[at], math.nan)
            continue
        p = q = at
        if gone[at]:
            p, q = before[at], after[at]
        else:
            q = after[at]
        found, bar = 0, threshold
        down = likeness(value, known[p]) if p >= low else -1.0
        up = likeness(value, known[q]) if q <= high else -1.0
        while (score := max(down, up)) > threshold and (found < n or score >= bar):
            if down >= up:
                found += add(x, top[p], score)
                p = before[p]
                down = likeness(value, known[p]) if p >= low else -1.0
            else:
                found += add(x, top[q], score)
                q = after[q]
                up = likeness(value, known[q]) if q <= high else -1.0
            if found >= n and bar == threshold:
                bar = score
    return a, b, scores
