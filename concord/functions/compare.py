"""Distance columns between two values, as column expressions.

An undefined distance is NULL.  Each function gives a list of float columns.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.functions.keys import as_text, tokens, truthy
from concord.functions.kernels import affine_gap_column, crf_column

EARTH_KM = 6371.0


def string(a: Column, b: Column, crf: bool = False) -> list[Column]:
    """Normalised affine-gap distance, or the CRF edit distance."""
    return [(crf_column if crf else affine_gap_column)(a.cast("string"), b.cast("string"))]


def exact(a: Column, b: Column) -> list[Column]:
    return [F.when(a == b, F.lit(1.0)).otherwise(F.when(a.isNotNull() & b.isNotNull(), F.lit(0.0))).cast("float")]


def categorical_names(categories: list[str]) -> list[tuple[str, str]]:
    """The unordered pairs with a column of their own: self pairs first, the first of them being the base level."""
    return [(c, c) for c in categories][1:] + list(combinations(categories, 2))


def categorical(a: Column, b: Column, categories: list[str]) -> list[Column]:
    both = a.isNotNull() & b.isNotNull()

    def column(x, y):
        hit = ((a == x) & (b == y)) | ((a == y) & (b == x))
        return F.when(both, F.when(hit, 1.0).otherwise(0.0)).cast("float")

    return [column(x, y) for x, y in categorical_names(categories)]


def exists(a: Column, b: Column, kind: T.DataType) -> list[Column]:
    """Both there; exactly one there."""
    x, y = truthy(a, kind), truthy(b, kind)
    return [F.when(x & y, 1.0).otherwise(0.0).cast("float"), F.when(x != y, 1.0).otherwise(0.0).cast("float")]


def price(a: Column, b: Column) -> list[Column]:
    x, y = a.cast("double"), b.cast("double")
    return [F.when((x > 0) & (y > 0), F.abs(F.log10(x) - F.log10(y))).cast("float")]


def lat_long(a: Column, b: Column) -> list[Column]:
    """Square root of the great-circle distance in km.  Values are structs or arrays of two numbers; (0, 0) counts as no place."""
    (la, oa), (lb, ob) = ((F.radians(p[0].cast("double")), F.radians(p[1].cast("double"))) for p in (a, b))
    h = F.pow(F.sin((lb - la) / 2), 2) + F.cos(la) * F.cos(lb) * F.pow(F.sin((ob - oa) / 2), 2)
    return [F.sqrt(2 * EARTH_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))).cast("float")]


def custom(a: Column, b: Column, function) -> list[Column]:
    """A user's comparison: a function of two columns that gives a column, an Arrow or pandas function, or a Python function of two values, whose errors and non-numbers count as 0."""
    if hasattr(function, "returnType") or getattr(function, "on_columns", False):
        found = function(a, b)
    else:

        def safe(x, y):
            try:
                return float(function(x, y))
            except Exception:  # noqa: BLE001 - whatever the user's function raises counts as no likeness
                return 0.0

        found = F.udf(safe, "double", useArrow=True)(a, b)
    return [F.when(a.isNotNull() & b.isNotNull(), found.cast("float"))]


# -- cosine over a corpus ------------------------------------------------------------------------------


def terms(x: Column, kind: T.DataType) -> Column:
    """Terms of a text (split at white space) or of a set."""
    return F.transform(x, lambda v: as_text(v, kind.elementType)) if isinstance(kind, T.ArrayType) else tokens(x.cast("string"))


def term_vectors(values: DataFrame, column: str, corpus: DataFrame | None = None) -> DataFrame:
    """(value, weights map<string,double>, norm) of each distinct value of a column.

    Weights are term counts times ln(N / df) over the corpus; a term that the
    corpus hasn't is worth ln N; without a corpus every term is worth 1.
    """
    kind = values.schema[column].dataType
    distinct = values.select(F.col(column).alias("value")).filter(F.col("value").isNotNull()).distinct()
    counted = distinct.select("value", F.explode(terms(F.col("value"), kind)).alias("term")).groupBy("value", "term").agg(F.count("*").alias("tf"))
    if corpus is None:
        weighed = counted.withColumn("w", F.col("tf").cast("double"))
    else:
        own = corpus.select(F.col(corpus.columns[0]).alias("value")).filter(truthy(F.col("value"), corpus.schema[0].dataType))
        n = own.agg(F.count("*").cast("double").alias("n"))
        df = own.select(F.explode(F.array_distinct(terms(F.col("value"), corpus.schema[0].dataType))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        weighed = counted.join(df, "term", "left").crossJoin(F.broadcast(n)).withColumn("w", F.col("tf") * F.log(F.when(F.col("df").isNull(), F.col("n")).otherwise(F.col("n") / F.col("df"))))
    return weighed.groupBy("value").agg(F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("weights"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def cosine(a: Column, b: Column) -> list[Column]:
    """Cosine of two term vectors (structs of weights and norm); NULL where a norm is zero."""
    zero = F.lit(0.0)
    dot = F.aggregate(F.map_entries(a["weights"]), zero, lambda s, e: s + e["value"] * F.coalesce(F.try_element_at(b["weights"], e["key"]), zero))
    return [F.when((a["norm"] > 0) & (b["norm"] > 0), dot / (a["norm"] * b["norm"])).cast("float")]
