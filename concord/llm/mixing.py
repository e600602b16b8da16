"""Mixing sources to target weights, in DataFrame operations only.

Sizes are added up per source before anything is shuffled; the targets come from
one pass over the sources; then every document is emitted floor(rate) times,
and once more where a hash of its id falls below the rate's fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.llm.common import WORD_PATTERN, stash, text_or_empty


def word_count(text: Column) -> Column:
    """Words of a text: runs without ASCII white space."""
    return F.regexp_count(text, F.lit(WORD_PATTERN)).cast("bigint")


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Sources in code-point order, null last, take the weights in turn and share
    ``share`` times all sizes; a target stops at ``most`` times its source's
    size, and what is over goes to the others by weight until none is above.
    Sorted by size per weight, the sources that stop come first, so running
    sums find the common level at once.  The windows hold one row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    weighed = totals.withColumn("place", F.row_number().over(order)).withColumn("weight", turn.cast("bigint"))
    everything = Window.partitionBy()
    by_room = Window.orderBy((F.lit(float(most)) * F.col("source_size") / F.col("weight")).asc(), "place")
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_room.rowsBetween(0, Window.unboundedFollowing)
    level = (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0))) / F.sum("weight").over(onward)
    levels = weighed.withColumn("level", level).withColumn("cap", (most * F.col("source_size")).cast("double"))
    free = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    common = F.first(free, ignorenulls=True).over(by_room.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return levels.select("source", "source_size", F.least(F.col("cap"), F.coalesce(common * F.col("weight"), F.col("cap"))).alias("target"))


def uniform(seed: str, column: str) -> Column:
    """A number in [0, 1) from a hash of the seed and a column; the same in every run."""
    text = F.concat(F.lit(seed), F.lit("|"), F.coalesce(F.col(column).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def mixing_rates(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: int = 2, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """For every row: (doc_id, size, source_size, target, copies).

    Null texts have size 0; rows with a null source form a source of their own;
    rows that repeat an id draw alike; a source without words has target 0 and
    no copies; a table without rows gives none; other columns are ignored.
    """
    sizes = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[source_col].cast("string").alias("source"), word_count(text_or_empty(text_col)).alias("size"))
    sizes = stash(sizes, "sizes")
    targets = source_targets(sizes, weights, share, most).withColumnRenamed("source", "of_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rated = sizes.join(targets, F.col("source").eqNullSafe(F.col("of_source"))).withColumn("rate", rate)
    copies = F.floor("rate") + F.when(uniform(seed, "doc_id") < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return rated.select("doc_id", "size", "source_size", "target", copies.cast("int").alias("copies"))


def mix_documents(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: int = 2, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with all their columns.

    Null and empty texts have size 0 and are taken at their source's rate; rows
    with a null source form a source of their own; rows that repeat an id draw
    alike; a source without words gives no rows, and so does a table without
    rows; columns of any name are carried along.
    """
    sizes = docs.select(docs[source_col].cast("string").alias("source"), word_count(text_or_empty(text_col)).alias("size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = stash(source_targets(sizes, weights, share, most).select("source", rate.alias("rate")), "rates")
    # the table's own columns go along as one struct, so that none can clash
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[source_col].cast("string").alias("of"), uniform(seed, id_col).alias("draw"))
    joined = rows.join(targets, rows["of"].eqNullSafe(targets["source"]))
    copies = F.floor("rate") + F.when(F.col("draw") < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return joined.select("row", F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select("row.*")


ORACLE = r"""
with sizes as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents),
totals as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) as place from sizes group by source),
weighed as (select *, [3, 1, 2][(place - 1) % 3 + 1] as weight from totals),
levels as (select *, (1.5::double * sum(source_size) over () - coalesce(sum(2 * source_size) over (order by 2.0::double * source_size / weight, place rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by 2.0::double * source_size / weight, place rows between current row and unbounded following) as level from weighed),
common as (select arg_min(level, (2.0::double * source_size / weight, place)) as level from levels where level * weight <= 2 * source_size),
targets as (select source, source_size, least((2 * source_size)::double, coalesce((select level from common) * weight, (2 * source_size)::double)) as target from levels),
rated as (select s.doc_id, s.size, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size else 0.0::double end as rate,
    cast('0x' || substr(md5('mix|' || coalesce(s.doc_id::varchar, '')), 1, 12) as bigint)::double / 281474976710656.0::double as u
  from sizes s join targets t on s.source is not distinct from t.source)
select doc_id, size, source_size, target, cast(size * (floor(rate) + case when u < rate - floor(rate) then 1 else 0 end) as bigint) as taken from rated
"""
