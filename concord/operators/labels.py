"""Samples of records and pairs, and labels from a common key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sample_records(records: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Up to n records, uniformly and without replacement."""
    return records.withColumn("_r", F.rand(seed)).orderBy("_r").limit(n).drop("_r")


def random_pairs(spark, n: int, size: int, seed: int = 0) -> DataFrame:
    """(i, j), i < j < n: ``size`` distinct unordered pairs of row numbers, or all there are."""
    total = n * (n - 1) // 2
    if size >= total:
        linear = spark.range(total)
    else:  # distinct draws: a little too many, then as many as asked
        drawn = spark.range(int(size * 1.2) + 50).select(F.floor(F.rand(seed) * total).cast("bigint").alias("id")).distinct()
        linear = drawn.orderBy(F.xxhash64("id")).limit(size) if size * 4 < total else spark.range(total).withColumn("_r", F.rand(seed)).orderBy("_r").limit(size).drop("_r")
    # pair number k is (i, j) with k = j (j - 1) / 2 + i
    j = F.floor((1 + F.sqrt(1 + 8 * F.col("id").cast("double"))) / 2).cast("bigint")
    pairs = linear.select("id", j.alias("j"))
    pairs = pairs.withColumn("j", F.when(F.col("j") * (F.col("j") - 1) / 2 > F.col("id"), F.col("j") - 1).when(F.col("j") * (F.col("j") + 1) / 2 <= F.col("id"), F.col("j") + 1).otherwise(F.col("j")))
    return pairs.select((F.col("id") - F.col("j") * (F.col("j") - 1) / 2).cast("bigint").alias("i"), "j")


def random_pairs_between(spark, n: int, m: int, size: int, seed: int = 0) -> DataFrame:
    """(i, j), i < n, j < m: ``size`` distinct pairs, or all there are."""
    total = n * m
    if size * 4 >= total:
        linear = spark.range(total).withColumn("_r", F.rand(seed)).orderBy("_r").limit(min(size, total)).drop("_r")
    else:
        linear = spark.range(int(size * 1.2) + 50).select(F.floor(F.rand(seed) * total).cast("bigint").alias("id")).distinct().orderBy(F.xxhash64("id")).limit(size)
    return linear.select(F.floor(F.col("id") / m).cast("bigint").alias("i"), (F.col("id") % m).alias("j"))


def common_key_matches(left: DataFrame, key: str, id_col: str, right: DataFrame | None = None, null_matches: bool = False) -> DataFrame:
    """(id_a, id_b) of records with one common key; within one table id_a < id_b.  Nulls match each other only where asked."""
    a = left.select(F.col(id_col).alias("id_a"), F.col(key).alias("ka"))
    b = (right if right is not None else left).select(F.col(id_col).alias("id_b"), F.col(key).alias("kb"))
    same = F.col("ka").eqNullSafe(F.col("kb")) if null_matches else F.col("ka") == F.col("kb")
    if right is None:
        same = same & (F.col("id_a") < F.col("id_b"))
    return a.join(b, same).select("id_a", "id_b")


def training_pairs(left: DataFrame, key: str, id_col: str, right: DataFrame | None = None, size: int = 50_000, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(matches, distinct): up to ``size`` matches by a common key, and as many random pairs that are none."""
    matches = common_key_matches(left, key, id_col, right)
    spark = left.sparkSession

    def numbered(df, name):
        # a partition's number and the place in it, and how many rows the partitions before have: one row for each partition
        at = F.monotonically_increasing_id()
        rows = df.select(F.col(id_col).alias(name), F.shiftright(at, 33).alias("part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("place"))
        counts = rows.groupBy("part").agg(F.count("*").alias("rows"))
        before = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = counts.select("part", before.alias("start"))
        return rows.join(F.broadcast(starts), "part").select((F.col("start") + F.col("place")).alias("n"), name)

    n = left.count()
    m = right.count() if right is not None else n
    drawn = random_pairs(spark, n, size, seed) if right is None else random_pairs_between(spark, n, m, size, seed)
    pairs = drawn.join(numbered(left, "id_a").withColumnRenamed("n", "i"), "i").join(numbered(right if right is not None else left, "id_b").withColumnRenamed("n", "j"), "j").select("id_a", "id_b")
    if right is None:
        pairs = pairs.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
    # only the drawn pairs are looked up: all matches of a common key may be very many
    keyed = pairs.join(left.select(F.col(id_col).alias("id_a"), F.col(key).alias("ka")), "id_a")
    keyed = keyed.join((right if right is not None else left).select(F.col(id_col).alias("id_b"), F.col(key).alias("kb")), "id_b")
    same = keyed.filter(F.col("ka") == F.col("kb"))
    if right is None:
        same = same.filter("id_a < id_b")
    distinct = pairs.join(same.select("id_a", "id_b").distinct(), ["id_a", "id_b"], "left_anti")
    return matches.orderBy(F.rand(seed)).limit(size), distinct


def label_pair(pair: tuple, label: str) -> dict:
    """One answer as labels: 'match', 'distinct', or 'unsure', which counts as both."""
    if label not in ("match", "distinct", "unsure"):
        raise ValueError(f"a label is match, distinct or unsure, not {label!r}")
    return {"match": [pair] if label in ("match", "unsure") else [], "distinct": [pair] if label in ("distinct", "unsure") else []}
