"""Choosing blocking rules: the cheapest set of predicates that covers the known matches.

Covers come from the cluster; what is searched here are small sets on the driver.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.operators.blocking import block_keys
from concord.operators.predicates import Compound

#: Calls that the search may make, rounds of the conjunction search.
SEARCH_CALLS, FOREST_ROUNDS = 2500, 5000


def comparison_cover(records: DataFrame, predicates: list, id_col: str, keep: Callable, other: DataFrame | None = None, context: DataFrame | None = None) -> dict[int, set[tuple]]:
    """For each predicate the pairs of sampled records that share a key.  Predicates that pair nothing, or put all records in one block, are left out.  Searches count terms over the ``context`` records too."""
    n = records.count()
    if other is None:
        blocks = keep(block_keys(records, predicates, id_col, keep, context=context), "cover-keys")
        full = blocks.groupBy("predicate", "key").count().filter(F.col("count") >= n).select("predicate").distinct()
        right = blocks
        on = F.col("a.id") < F.col("b.id")
    else:
        m = other.count()
        blocks = keep(block_keys(records, predicates, id_col, keep, searched=other, context=context), "cover-keys")
        right = keep(block_keys(other, predicates, id_col, keep, is_target=True), "cover-keys")
        sizes = blocks.groupBy("predicate", "key").agg(F.count("*").alias("x")).join(right.groupBy("predicate", "key").agg(F.count("*").alias("y")), ["predicate", "key"])
        full = sizes.filter((F.col("x") >= n) & (F.col("y") >= m)).select("predicate").distinct()
        on = F.lit(True)
    a, b = blocks.join(full, "predicate", "left_anti").alias("a"), right.alias("b")
    pairs = a.join(b, (F.col("a.predicate") == F.col("b.predicate")) & (F.col("a.key") == F.col("b.key")) & on)
    cover: dict[int, set[tuple]] = {}
    for row in pairs.select("a.predicate", F.col("a.id").alias("x"), F.col("b.id").alias("y")).distinct().toLocalIterator():
        cover.setdefault(row[0], set()).add((row["x"], row["y"]))
    return cover


def match_cover(keys_left: DataFrame, keys_right: DataFrame, pairs: list[tuple]) -> dict[int, frozenset[int]]:
    """For each predicate the numbers of the labelled pairs whose two records share a key.  Keys are (predicate, key, id)."""
    spark = keys_left.sparkSession
    if not pairs:
        return {}
    kind = keys_left.schema["id"].dataType.simpleString()
    labelled = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], f"pair int, x {kind}, y {kind}")
    left = labelled.join(keys_left.withColumnRenamed("id", "x"), "x").select("pair", "predicate", "key")
    right = labelled.join(keys_right.withColumnRenamed("id", "y"), "y").select("pair", "predicate", "key")
    cover: dict[int, set[int]] = {}
    for row in left.join(right, ["pair", "predicate", "key"]).select("predicate", "pair").distinct().collect():
        cover.setdefault(row["predicate"], set()).add(row["pair"])
    return {k: frozenset(v) for k, v in cover.items()}


def simple_candidates(matches: dict[int, frozenset[int]], compared: dict[int, set]) -> list[tuple[tuple[int, ...], frozenset[int], float]]:
    """(predicates, matches covered, cost) of single predicates; the cost is how many pairs it compares."""
    return [((p,), matches[p], float(len(compared[p]))) for p in sorted(matches) if p in compared]


def conjunction_candidates(matches: dict[int, frozenset[int]], compared: dict[int, set], longest: int, seed: int = 0, rounds: int = FOREST_ROUNDS) -> list:
    """Candidates with conjunctions of up to ``longest`` predicates, grown greedily on bootstrap samples of matches and predicates."""
    rng = random.Random(seed)
    names = [p for p in sorted(matches) if p in compared]
    everything = sorted(set().union(*matches.values())) if matches else []
    found = {c[0]: c for c in simple_candidates(matches, compared)}
    sample_size = max(5, int(math.sqrt(len(names))))
    for _ in range(rounds if names else 0):
        some = rng.sample(names, min(sample_size, len(names)))
        weight: dict[int, int] = {}
        for m in rng.choices(everything, k=len(everything)):
            weight[m] = weight.get(m, 0) + 1
        chosen: list[int] = []
        held, pairs = set(everything), None
        while len(chosen) < longest:
            best = None
            for p in some:
                if p in chosen:
                    continue
                both = held & matches[p]
                cost = compared[p] if pairs is None else pairs & compared[p]
                gain = sum(weight.get(m, 0) for m in both) / max(len(cost), 1)
                if both and (best is None or gain > best[0]):
                    best = (gain, p, both, cost)
            if best is None:
                break
            _, p, held, pairs = best
            chosen.append(p)
            key = tuple(sorted(chosen))
            if key not in found:
                whole = frozenset.intersection(*[matches[q] for q in key])
                found[key] = (key, whole, float(len(pairs)))
    return list(found.values())


def cheapest_cover(candidates: list, target: int, calls: int = SEARCH_CALLS) -> list:
    """Candidates that together cover ``target`` matches at the least summed cost, by depth-first branch and bound.

    The next to decide is the candidate that covers most of what is open, and of
    those the cheapest; one branch takes it, the other does without it.  Within
    the budget of calls the best found is returned.
    """
    best: list = []
    least = math.inf
    left = calls

    def reach(open_candidates):
        return len(frozenset().union(*[c[1] for c in open_candidates])) if open_candidates else 0

    def undominated(options):
        ordered = sorted(options, key=lambda c: (-len(c[1]), c[2]))
        kept: list = []
        for c in ordered:
            if not any(k[1] >= c[1] and k[2] <= c[2] for k in kept):
                kept.append(c)
        return kept

    def search(options, chosen, covered, cost):
        nonlocal best, least, left
        if left <= 0:
            return
        left -= 1
        if len(covered) >= target:
            if cost < least:
                best, least = list(chosen), cost
            return
        rest = undominated([(n, m - covered, c) for n, m, c in options if m - covered and cost + c < least])
        if len(covered) + reach(rest) < target:
            return
        pick = max(rest, key=lambda c: (len(c[1]), -c[2]))
        others = [c for c in rest if c is not pick]
        search(others, [*chosen, pick[0]], covered | pick[1], cost + pick[2])
        search(others, chosen, covered, cost)

    search(list(candidates), [], frozenset(), 0.0)
    return best


def learn(predicates: list, matches: dict[int, frozenset[int]], compared: dict[int, set], n_matches: int, recall: float = 1.0, seed: int = 0) -> list:
    """The predicates, or conjunctions of them, that cover the asked share of matches as far as any do."""
    longest = max(1, int(math.log10(n_matches))) if n_matches else 1
    candidates = conjunction_candidates(matches, compared, longest, seed) if longest > 1 else simple_candidates(matches, compared)
    coverable = len(frozenset().union(*[c[1] for c in candidates])) if candidates else 0
    target = min(int(recall * n_matches), coverable)
    if not target:
        return []
    chosen = cheapest_cover(candidates, target)
    return [predicates[c[0]] if len(c) == 1 else Compound(tuple(predicates[i] for i in c)) for c in chosen]
