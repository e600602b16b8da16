"""From scored pairs to entities: clusters, one-to-one, many-to-one, top-N and canonical records."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from concord.functions.compare import string
from concord.functions.keys import as_text, truthy
from concord.functions.kernels import cluster_component
from concord.operators.graph import connected_components
from concord.shipping import ship

Keep = Callable[[DataFrame, str], DataFrame]
#: Largest component that is clustered as a whole; a larger one loses its weakest edges first.
MAX_COMPONENT = 30_000


def components(scores: DataFrame, keep: Keep, max_component: int = MAX_COMPONENT) -> DataFrame:
    """(id_a, id_b, score, component): the scored pairs with the component they are in.

    A component of more than ``max_component`` records is cut at
    sigmoid(logit(lowest score) + 1), keeping at least its two best edges, until
    every part is small enough.
    """
    edges = keep(scores.select("id_a", "id_b", "score"), "scores")
    done = None
    while True:
        found = connected_components(edges, keep, "id_a", "id_b")
        labelled = keep(edges.join(found, edges["id_a"] == found["node"]).select("id_a", "id_b", "score", "component"), "labelled")
        sizes = found.groupBy("component").agg(F.count("*").alias("n"))
        large = sizes.filter(F.col("n") > max_component).select("component")
        part = labelled.join(large, "component", "left_anti").select("id_a", "id_b", "score", "component")
        done = part if done is None else done.unionByName(part)
        rest = labelled.join(large, "component")
        if rest.isEmpty():
            return done
        # the lowest score and the two best edges are aggregates, so that a large component is no hot spot
        rest = rest.withColumn("order", F.struct((-F.col("score")).alias("score"), "id_a", "id_b"))
        first = keep(rest.groupBy("component").agg(F.min("order").alias("first"), F.min("score").cast("double").alias("low")), "best")
        after = rest.join(first, "component").filter(F.col("order") > F.col("first"))
        second = keep(after.groupBy("component").agg(F.min("order").alias("second")), "second")
        cut = 1 / (1 + F.exp(-(F.log(F.col("low") / (1 - F.col("low"))) + 1)))
        bounds = first.join(second, "component", "left").select("component", cut.alias("cut"), F.coalesce("second", "first").alias("last"))
        kept = rest.join(bounds, "component").filter((F.col("score") >= F.col("cut")) | (F.col("order") <= F.col("last")))
        edges = keep(kept.select("id_a", "id_b", "score"), "cut")


def cluster(scores: DataFrame, keep: Keep, threshold: float = 0.5, max_component: int = MAX_COMPONENT, copies: DataFrame | None = None) -> DataFrame:
    """(cluster_id, id, confidence) of clusters of two or more; cluster_id is the smallest id.

    Components of a single pair are decided in SQL; larger ones by centroid
    linkage, one component at a time, whose size is bounded.  ``copies`` (id, of) are records equal to the
    record ``of``, which has a smaller id: they have no pairs of their own and are points at distance 0 of it, so
    that they weigh in its cluster; ``max_component`` counts without them.
    """
    ship(scores.sparkSession)
    kind = scores.schema["id_a"].dataType
    edges = keep(components(scores, keep, max_component), "components")
    counts = edges.groupBy("component").agg(F.count("*").alias("n"))
    edges = edges.join(counts, "component")
    alone = F.col("n") == 1
    if copies is not None:
        weights = copies.groupBy("of").agg((F.count("*") + 1).alias("w"))
        for end in ("a", "b"):
            edges = edges.join(weights.toDF(f"id_{end}", f"w_{end}"), f"id_{end}", "left").fillna(1, [f"w_{end}"])
        alone = alone & (F.col("w_a") + F.col("w_b") == 2)
    else:
        edges = edges.withColumns({"w_a": F.lit(1), "w_b": F.lit(1)})
    single = edges.filter(alone & (F.col("score") > threshold))
    pairs = single.select(F.least("id_a", "id_b").alias("cluster_id"), F.explode(F.array("id_a", "id_b")).alias("id"), F.col("score").cast("double").alias("confidence"))
    name = kind.simpleString()

    def run(table: pa.Table) -> pa.Table:
        ends = [table["id_a"].combine_chunks(), table["id_b"].combine_chunks()]
        ids = sorted(set(pc.unique(ends[0]).to_pylist()) | set(pc.unique(ends[1]).to_pylist()))
        known = pa.array(ids, type=ends[0].type)
        left, right = (pc.index_in(x, value_set=known).to_numpy() for x in ends)
        weights = np.ones(len(ids), dtype=np.int64)
        weights[left], weights[right] = table["w_a"].to_numpy(), table["w_b"].to_numpy()
        found = cluster_component(ids, (left, right, table["score"].to_numpy()), threshold, weights)
        out = [(members[0], x, c) for members, confidences in found for x, c in zip(members, confidences, strict=True)]
        a, b, c = zip(*out, strict=True) if out else ((), (), ())
        own = table.schema.field("id_a").type
        return pa.table({"cluster_id": pa.array(a, type=own), "id": pa.array(b, type=own), "confidence": pa.array(c, type=pa.float64())})

    many = edges.filter(~alone).select("component", "id_a", "id_b", "score", "w_a", "w_b").groupBy("component").applyInArrow(run, f"cluster_id {name}, id {name}, confidence double")
    found = pairs.unionByName(many)
    if copies is None:
        return found
    found = keep(found, "clusters")
    apart = weights.join(edges.select(F.explode(F.array("id_a", "id_b")).alias("of")), "of", "left_anti")
    found = found.unionByName(apart.select(F.col("of").alias("cluster_id"), F.col("of").alias("id"), F.lit(1.0).alias("confidence")))
    more = copies.select(F.col("id").alias("copy"), "of").join(found, F.col("of") == F.col("id"))
    return found.unionByName(more.select("cluster_id", F.col("copy").alias("id"), "confidence"))


def with_singletons(clusters: DataFrame, records: DataFrame, id_col: str) -> DataFrame:
    """The clusters, and every other record as a cluster of its own with confidence 1."""
    ids = records.select(F.col(id_col).alias("id"))
    alone = ids.join(clusters.select("id"), "id", "left_anti")
    return clusters.unionByName(alone.select(F.col("id").alias("cluster_id"), "id", F.lit(1.0).alias("confidence")))


def many_to_many(scores: DataFrame, threshold: float = 0.0) -> DataFrame:
    return scores.filter(F.col("score") > threshold)


def top_n(scores: DataFrame, threshold: float = 0.0, n: int = 1) -> DataFrame:
    """The n best pairs of each id_a, by score, then by the larger id_b; n = 0 gives all."""
    good = scores.filter(F.col("score") > threshold)
    if not n:
        return good
    rank = F.row_number().over(Window.partitionBy("id_a").orderBy(F.desc("score"), F.desc("id_b")))
    return good.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def many_to_one(scores: DataFrame, threshold: float = 0.0) -> DataFrame:
    return top_n(scores, threshold, 1)


def one_to_one(scores: DataFrame, keep: Keep, threshold: float = 0.0) -> DataFrame:
    """Greedy matching by score, ties to larger ids: each record in one pair at most.

    A pair that is the best of both its ends is in the greedy matching, so all
    such pairs are taken at once, their ends leave, and the rest goes another
    round.  An end's best pair is an aggregate, so a record with very many pairs is no hot spot.
    """
    left = keep(scores.filter(F.col("score") > threshold).select("id_a", "id_b", "score"), "pairs")
    taken = None
    while True:
        best = F.max(F.struct("score", "id_a", "id_b"))
        best_a = left.groupBy("id_a").agg(best.alias("best")).select("best.*")
        best_b = left.groupBy("id_b").agg(best.alias("best")).select("best.*")
        new = keep(best_a.join(best_b, ["id_a", "id_b", "score"]), "matched")
        if new.isEmpty():
            return taken if taken is not None else new
        taken = new if taken is None else taken.unionByName(new)
        left = keep(left.join(new.select("id_a"), "id_a", "left_anti").join(new.select("id_b"), "id_b", "left_anti").select("id_a", "id_b", "score"), "pairs")


def canonical(records: DataFrame, clusters: DataFrame, id_col: str, fields: list[str] | None = None) -> DataFrame:
    """(cluster_id, field, value): of each field, the variant with the least mean affine-gap distance to all values of its cluster.

    Values that don't count are left out and all become text; equal values are
    compared once and weighed by how often they occur; ties go to the variant of the smallest id.
    """
    ship(records.sparkSession)
    names = fields or [c for c in records.columns if c != id_col]
    stacked = F.array(
        *[F.struct(F.lit(c).alias("field"), F.when(truthy(F.col(c), records.schema[c].dataType), as_text(F.col(c), records.schema[c].dataType)).alias("value")) for c in names]
    )
    rows = records.select(F.col(id_col).alias("id"), F.inline(stacked)).filter("value is not null")
    members = rows.join(clusters.select("cluster_id", "id"), "id")
    variants = members.groupBy("cluster_id", "field", "value").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    a, b = variants.alias("a"), variants.alias("b")
    both = a.join(b, ["cluster_id", "field"]).select("cluster_id", "field", F.col("a.value").alias("value"), F.col("a.first").alias("first"), F.col("b.value").alias("other"), F.col("b.n").alias("n"))
    ones = both.filter("value = other").withColumn("d", F.lit(0.0))
    apart = both.filter("value <> other")
    apart = apart.withColumn("d", F.coalesce(string(F.col("value"), F.col("other"))[0].cast("double"), F.lit(math.inf)))
    # the variant itself counts as 0, its repeats as two equal strings do
    own = ones.withColumn("d", F.when(F.col("n") > 1, F.lit(0.5) * (F.col("n") - 1)).otherwise(F.lit(0.0)))
    sums = own.unionByName(apart.withColumn("d", F.col("d") * F.col("n"))).groupBy("cluster_id", "field", "value", "first").agg(F.sum("d").alias("d"), F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("cluster_id", "field").orderBy(F.col("d") / F.col("n"), "first"))
    return sums.withColumn("rank", rank).filter("rank = 1").select("cluster_id", "field", "value")


def canonical_records(records: DataFrame, clusters: DataFrame, id_col: str, fields: list[str] | None = None) -> DataFrame:
    """(cluster_id, a text column for each field): one record that stands for each cluster; NULL where no member has a value that counts."""
    names = fields or [c for c in records.columns if c != id_col]
    found = canonical(records, clusters, id_col, names)
    picked = [F.max(F.when(F.col("field") == c, F.col("value"))).alias(c) for c in names]
    return clusters.select("cluster_id").distinct().join(found, "cluster_id", "left").groupBy("cluster_id").agg(*picked)
