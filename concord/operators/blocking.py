"""Blocks and candidate pairs."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.operators.predicates import Compound, Index, index_parts, parts_of
from concord.operators.similarity import search_tables, search_target_keys


def block_keys(records: DataFrame, predicates: list, id_col: str, keep: Callable[[DataFrame, str], DataFrame], searched: DataFrame | None = None, is_target: bool = False, context: DataFrame | None = None) -> DataFrame:
    """(predicate int, key, id): every record's keys under every predicate, each once.

    Predicates without a similarity search are evaluated in one pass over the
    records.  For links, ``searched`` is the other side, whose values are
    searched; ``is_target`` says that these records are that side themselves.
    ``context`` records count for the term frequencies of the searches, and get no keys.
    """
    schema = records.schema
    parts = []
    plain = [(i, p) for i, p in enumerate(predicates) if not index_parts([p])]
    if plain:
        found = F.array(*[F.struct(F.lit(i).alias("predicate"), p.keys(schema).alias("keys")) for i, p in plain])
        parts.append(records.select(F.col(id_col).alias("id"), F.inline(found)).select("predicate", F.explode("keys").alias("key"), "id"))
    indexes = index_parts(predicates)
    tables = {i: search_target_keys(records, i, id_col) for i in indexes} if is_target else search_tables(records, list(indexes), id_col, keep, searched, context)
    for i, p in enumerate(predicates):
        if isinstance(p, Index):
            parts.append(tables[p].select(F.lit(i).alias("predicate"), "key", "id"))
        elif isinstance(p, Compound) and index_parts([p]):
            joined = None
            for part in parts_of(p):
                own = tables[part] if isinstance(part, Index) else records.select(F.col(id_col).alias("id"), F.explode(part.keys(schema)).alias("key"))
                own = own.select("id", F.replace("key", F.lit(":"), F.lit("\\:")).alias("key"))
                joined = own if joined is None else joined.join(own.withColumnRenamed("key", "more"), "id").select("id", F.concat_ws(":", "key", "more").alias("key"))
            parts.append(joined.select(F.lit(i).alias("predicate"), "key", "id"))
    if not parts:
        raise ValueError("there are no predicates")
    return reduce(DataFrame.unionByName, parts).distinct()


def block_sizes(blocks: DataFrame) -> DataFrame:
    """(predicate, key, n) of blocks of two or more records."""
    return blocks.groupBy("predicate", "key").agg(F.count("*").alias("n")).filter("n > 1")


def pairs_within(blocks: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: distinct pairs of records that share a block.

    Blocks of one record go before the join.  That is an aggregate per block, so a block of any
    size is no hot spot there; the join itself is skewed where a block is, and is split by size.
    """
    several = blocks.join(block_sizes(blocks).select("predicate", "key"), ["predicate", "key"])
    a, b = several.alias("a"), several.alias("b")
    on = (F.col("a.predicate") == F.col("b.predicate")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id"))
    return a.join(b, on).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")).distinct()


def pairs_between(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id_a, id_b): distinct pairs of a left and a right record that share a block."""
    return left.withColumnRenamed("id", "id_a").join(right.withColumnRenamed("id", "id_b"), ["predicate", "key"]).select("id_a", "id_b").distinct()
