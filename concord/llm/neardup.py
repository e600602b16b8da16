"""Near-duplicate groups from bottom-k sketches of one hash function.

1. Every text becomes its set of hashed shingles; texts with equal sets form one
   class.  A class keeps the k smallest hashes of its set, its sketch.
2. Inverted lists of retained values generate candidates.  A pair that is
   similar enough shares at least ``overlap`` retained values (all but about
   1 in 1e9 such pairs, see ``sure_overlap``; all of them where the sketches
   hold the whole sets), so with the values of each sketch ordered from rare to common
   only a prefix of it has to be listed.  A common passage is at the end of the
   order and makes no list unless little else is in the text.
3. Every list's members are compared with its centre, the class whose retained
   values are the most common: edits of one text have it as their centre.  The links found
   are joined to components.  Lists whose members are all in one component are
   done; in the others, all pairs that lie in different components are compared.
   So no link between components is missed, and a large group of copies costs a
   linear number of comparisons.
4. Before a comparison, the union of both sketches estimates the resemblance
   and drops pairs that can't reach the threshold.  What is left is decided on
   the full sets.  Across components the union of wider sketches is used, and a
   pair is looked at under the first value that both list.
"""

from __future__ import annotations

import math
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import remove, set_up, slices, stash, stashed, text_or_empty, tidy
from concord.llm.shingles import shingle_sets, signed
from concord.operators.graph import connected_components

#: Retained values of a sketch, and of the wider ones that decide which pairs across components are verified.
K, WIDE = 64, 1024
#: Share of the similar pairs that may have fewer retained values in common than is asked.
LOST = 1e-9
#: Longest list whose pairs are joined as they are; sizes of the chunks that longer ones are cut into.
SMALL_LIST, CHUNK_MEMBERS, CHUNK_OTHERS = 32, 2000, 1000


def _key(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*arrays, np.zeros(0, np.int64)]).astype(np.int64)))


def _sketcher(width: int, k: int):
    def sketch(batches):
        for batch in batches:
            for some in slices(batch, 1):
                ns, keys, kept = [], [], []
                for hashes in shingle_sets(some.column(1).to_pylist(), width):
                    ns.append(len(hashes))
                    keys.append(_key(hashes))
                    kept.append(signed(hashes[:k]))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(ns, type=pa.int64()), pa.array(keys, type=pa.binary()), _lists(kept)], names=["doc_id", "n", "key", "sketch"])

    return sketch


def _setter(width: int):
    def full(batches):
        for batch in batches:
            for some in slices(batch, 0):
                sets = list(shingle_sets(some.column(0).to_pylist(), width))
                yield pa.RecordBatch.from_arrays([pa.array([_key(s) for s in sets], type=pa.binary()), _lists([signed(s) for s in sets])], names=["key", "hashes"])

    return full


def _estimate(k: int, overlap: int, percent: int):
    """Whether the bottom-k sketch of the union of a and b allows the threshold; where both are whole sets, their own sizes decide.

    Values may be shortened hashes: what a set loses by equal ones counts as common, so that no pair is lost.
    """
    both, doubled = F.array_intersect("a", "b"), F.size("a") - F.size(F.array_distinct("a"))
    common = F.size(both) + doubled
    whole = (F.size("a") < k) & (F.size("b") < k)
    union = F.slice(F.array_sort(F.array_union("a", "b")), 1, k)
    shared = F.size(F.array_intersect(both, union)) + doubled
    return F.when(whole, 100 * common >= percent * (F.size("a") + F.size("b") - common)).otherwise(shared >= F.least(F.lit(overlap), F.size("a"), F.size("b")))


def _small_lists(across: DataFrame, percent: int) -> DataFrame:
    """Pairs across components under lists of a bounded length, by a join of narrow rows."""
    one = across.filter("not is_main").select("v", F.col("c").alias("ca"), F.col("n").alias("na"), F.col("comp").alias("pa"))
    two = across.select("v", F.col("c").alias("cb"), F.col("n").alias("nb"), F.col("comp").alias("pb"), "is_main")
    near = (F.col("pa") != F.col("pb")) & (F.col("is_main") | (F.col("ca") < F.col("cb"))) & (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return one.join(two, (one["v"] == two["v"]) & near).select(F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")).distinct()


def _large_lists(across: DataFrame, sketches: DataFrame, percent: int, wide: int, overlap: int) -> DataFrame:
    """The pairs under long lists that the union of the wider sketches allows: every chunk of members meets every chunk of those outside the main component."""
    spread = [F.pmod(F.xxhash64("c"), "nm").cast("int"), F.pmod(F.xxhash64("c", F.lit(1)), "no").cast("int")]
    members = across.select("v", "c", "n", "comp", "is_main", F.lit(0).alias("role"), spread[0].alias("m"), F.explode(F.sequence(F.lit(0), F.col("no") - 1)).alias("o"))
    others = across.filter("not is_main").select("v", "c", "n", "comp", "is_main", F.lit(1).alias("role"), F.explode(F.sequence(F.lit(0), F.col("nm") - 1)).alias("m"), spread[1].alias("o"))
    rows = members.unionByName(others).join(sketches, "c").select("v", "m", "o", "role", "c", "n", "comp", "is_main", "vs", "wide")
    return rows.groupBy("v", "m", "o").applyInArrow(_chunk_pairs(percent, wide, overlap), "ca bigint, cb bigint").distinct()


def _inverted(lists: pa.ChunkedArray) -> tuple[list[np.ndarray], dict[int, np.ndarray]]:
    """Each row's values, and for each value the rows that have it."""
    flat = lists.combine_chunks()
    values, offsets = flat.flatten().to_numpy(zero_copy_only=False), flat.offsets.to_numpy()
    offsets = offsets - offsets[0]
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.argsort(values, kind="stable")
    found, starts = np.unique(values[order], return_index=True)
    split = np.split(rows[order], starts[1:]) if len(found) else []
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)], dict(zip(found.tolist(), split, strict=True))


def _chunk_pairs(percent: int, wide: int, overlap: int):
    def run(table: pa.Table) -> pa.Table:
        role = table["role"].to_numpy()
        members, others = table.filter(pa.array(role == 0)), table.filter(pa.array(role == 1))
        left, right = [], []
        if members.num_rows and others.num_rows:
            v = members["v"][0].as_py()
            _, listed = _inverted(members["vs"])
            wides, held = _inverted(members["wide"])
            own_lists, _ = _inverted(others["vs"])
            own_wides, _ = _inverted(others["wide"])
            n, comp, ids = members["n"].to_numpy(), members["comp"].to_numpy(), members["c"].to_numpy()
            main = members["is_main"].to_numpy(zero_copy_only=False)
            width = np.array([len(w) for w in wides])
            for i, (c, size, own) in enumerate(zip(others["c"].to_pylist(), others["n"].to_pylist(), others["comp"].to_pylist(), strict=True)):
                open_ = (comp != own) & (100 * np.minimum(n, size) >= percent * np.maximum(n, size)) & (main | (ids > c))
                # a pair is compared under the first of the values that it shares
                for x in own_lists[i].tolist():
                    if x == v:
                        break
                    if x in listed:
                        open_[listed[x]] = False
                if not open_.any():
                    continue
                common = np.zeros(len(n), dtype=np.int64)
                for x in own_wides[i].tolist():
                    if x in held:
                        common[held[x]] += 1
                mine = len(own_wides[i])
                whole = (width < wide) & (mine < wide)
                near = np.where(whole, 100 * common >= percent * (width + mine - common), common >= np.minimum(np.minimum(overlap, mine), width))
                found = ids[open_ & near]
                left.append(np.minimum(found, c))
                right.append(np.maximum(found, c))
        none = np.zeros(0, dtype=np.int64)
        return pa.table({"ca": np.concatenate([none, *left]), "cb": np.concatenate([none, *right])})

    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", k: int = K, overlap: int | None = None, wide: int = WIDE, small_list: int = SMALL_LIST) -> DataFrame:
    """For every row: (doc_id, n_shingles, component_id, kept).

    Two rows are linked where 100 * intersection >= percent * union of their
    shingle sets; component_id is the smallest doc_id that links reach, and the
    row that has it is kept.  Texts without words, null texts and rows with a
    null id are linked with nothing: component_id is their own doc_id and they
    are kept.  Rows that repeat an id are one document whose texts belong
    together.  A table without rows gives none; other columns are ignored.
    ``overlap`` follows from ``percent`` where it isn't given, and for a small
    ``percent`` the sketches are made longer until similar pairs share a value.
    Lists of up to ``small_list`` members are joined as they are, longer ones in
    chunks; the links are the same.
    """
    if not 0 < percent <= 100:
        raise ValueError(f"percent is above 0 and at most 100, not {percent!r}")
    set_up(docs.sparkSession)
    if overlap is None:
        while not (overlap := sure_overlap(k, percent / 100, LOST)):
            k *= 2
    while not (wide_overlap := sure_overlap(wide, percent / 100, LOST)):
        wide *= 2

    steps: list[str] = []

    def keep(df, label):
        df, path = stashed(df, f"near-{label}")
        steps.append(path)
        return df

    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"))
    sketches = keep(rows.mapInArrow(tidy(_sketcher(width, k)), "doc_id bigint, n bigint, key binary, sketch array<bigint>"), "sketches")
    linkable = sketches.filter("n > 0 and doc_id is not null")
    classes = linkable.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    # a number stands for the class from here on, as the rows of the lists should be narrow
    classes = keep(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    members = linkable.select("doc_id", "key").join(classes.select("key", "c", "n"), "key").select("doc_id", "n", "c")
    alone = sketches.filter("n = 0 or doc_id is null").select("doc_id", "n", F.lit(None).cast("bigint").alias("c"))
    members = keep(members.unionByName(alone), "members")
    remove(docs.sparkSession, steps.pop(0))

    # inverted lists of the rare prefix of each sketch
    values = classes.select("c", F.explode("sketch").alias("v"))
    common = values.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1")
    shared = values.join(common, "v").groupBy("c").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("vs"), F.sum(F.log("df")).alias("mass"))
    shared = shared.join(classes.select("c", "rep", "n", F.size("sketch").alias("s")), "c")
    needed = F.least(F.lit(overlap), F.ceil(F.col("s") * percent / 100)).cast("int")
    listed = (F.col("s") - needed + 1 - (F.col("s") - F.size("vs"))).cast("int")
    shared = shared.withColumn("listed", listed).filter("listed > 0").withColumn("vs", F.transform(F.slice("vs", F.lit(1), F.col("listed")), lambda x: x["v"]))
    shared = keep(shared.select("c", "rep", "n", "mass", "vs"), "shared")
    postings = shared.select("c", "rep", "n", "mass", F.explode("vs").alias("v"))
    heads = postings.groupBy("v").agg(F.count("*").alias("size"), F.max(F.struct("mass", "c", "n")).alias("head")).filter("size > 1").select("v", "head")
    postings = keep(postings.join(heads, "v").select("v", "c", "rep", "n", "head"), "postings")
    stars = postings.filter("c <> head.c").filter(f"100 * least(n, head.n) >= {percent} * greatest(n, head.n)")
    stars = keep(stars.select(F.col("head.c").alias("ca"), F.col("c").alias("cb")).distinct(), "stars")

    # full sets of the classes that are in some list of several
    wanted = keep(postings.select("c", "rep").distinct().join(classes.select("c", "key"), "c"), "wanted")
    texts = rows.join(wanted.select("rep").distinct(), rows["doc_id"] == F.col("rep"), "left_semi").select("text")
    sets = texts.mapInArrow(tidy(_setter(width)), "key binary, hashes array<bigint>").join(wanted.select("key", "c"), "key")
    sets = keep(sets.groupBy("key").agg(F.first("c").alias("c"), F.first("hashes").alias("hashes")).select("c", "hashes"), "sets")

    def attached(pairs, found):
        """Pairs with what ``found``, a (c, value), has for either side."""
        return pairs.join(found.toDF("cb", "b"), "cb").join(found.toDF("ca", "a"), "ca")

    def verified(pairs):
        both = F.size(F.array_intersect("a", "b"))
        full = attached(pairs.select("ca", "cb"), sets).withColumn("i", both)
        return full.filter(100 * F.col("i") >= percent * (F.size("a") + F.size("b") - F.col("i"))).select("ca", "cb")

    sketch = sets.select("c", F.slice("hashes", 1, k))
    stars = attached(stars, sketch).filter(_estimate(k, overlap, percent))
    nodes = wanted.select("c", "rep")

    def links(pairs):
        """Verified pairs as links between documents, so that rows that repeat an id belong together."""
        return verified(pairs).join(nodes.toDF("ca", "ra"), "ca").join(nodes.toDF("cb", "rb"), "cb").select("ra", "rb")

    found = connected_components(keep(links(stars), "links"), keep, "ra", "rb")

    # lists that still hold several components: all pairs across, the largest component's members only against the others
    placed = postings.select("v", "c", "n", "rep").join(found, F.col("rep") == F.col("node"), "left").select("v", "c", "n", F.coalesce("component", "rep").alias("comp"))
    placed = keep(placed, "placed")
    open_lists = placed.groupBy("v", "comp").agg(F.count("*").alias("size")).groupBy("v").agg(F.max_by("comp", F.struct("size", "comp")).alias("main"), F.sum("size").alias("size"), (F.sum("size") - F.max("size")).alias("others")).filter("others > 0")
    sizes = open_lists.select("v", "main", (F.col("size") > small_list).alias("large"), F.ceil(F.col("size") / CHUNK_MEMBERS).cast("int").alias("nm"), F.ceil(F.col("others") / CHUNK_OTHERS).cast("int").alias("no"))
    across = placed.join(sizes, "v")
    across = keep(across.select("v", "c", "n", "comp", (F.col("comp") == F.col("main")).alias("is_main"), "large", "nm", "no"), "across")
    wider = sets.select("c", F.transform(F.slice("hashes", 1, wide), lambda h: F.shiftright(h, 32).cast("int")).alias("wide"))
    pairs = attached(_small_lists(across.filter("not large"), percent), wider).filter(_estimate(wide, wide_overlap, percent)).select("ca", "cb")
    pairs = pairs.unionByName(_large_lists(across.filter("large"), wider.join(shared.select("c", "vs"), "c"), percent, wide, wide_overlap)).distinct()
    more = keep(links(pairs), "links")
    # what links across components is decided between components, not documents
    over = more.join(found, F.col("ra") == F.col("node"), "left").select(F.coalesce("component", "ra").alias("ca"), "rb")
    over = over.join(found, F.col("rb") == F.col("node"), "left").select("ca", F.coalesce("component", "rb").alias("cb"))
    merged = connected_components(keep(over.distinct(), "across-links"), keep, "ca", "cb").toDF("part", "whole")
    first_id = F.coalesce("component", "rep")
    groups = classes.select("c", "rep").join(found, F.col("rep") == F.col("node"), "left").select("c", first_id.alias("part_id"))
    groups = groups.join(merged, F.col("part_id") == F.col("part"), "left").select("c", F.coalesce("whole", "part_id").alias("component_id"))
    linked = members.filter("c is not null").join(groups, "c").select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
    return linked.unionByName(members.filter("c is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")))


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that near_duplicates keeps, with all their columns.

    Null and empty texts and rows with a null id stay; rows that repeat an id
    stay or go together; of a group the smallest id stays; a table without rows
    gives none; columns of any name are carried along.
    """
    lost = near_duplicates(docs, width, percent, id_col, text_col).filter("not kept").select("doc_id").distinct()
    lost = stash(lost, "near-lost")
    return docs.join(lost, docs[id_col].cast("bigint") == lost["doc_id"], "left_anti")


def sure_overlap(k: int, similarity: float, lost: float) -> int:
    """The largest overlap that a pair of that similarity has in a bottom-k sketch with probability of at least 1 - lost."""
    if similarity >= 1:
        return k
    below, t = 0.0, 0
    # by logarithms, as the coefficients of long sketches exceed a float
    while below + (p := math.exp(math.lgamma(k + 1) - math.lgamma(t + 1) - math.lgamma(k - t + 1) + t * math.log(similarity) + (k - t) * math.log1p(-similarity))) <= lost:
        below, t = below + p, t + 1
    return t
