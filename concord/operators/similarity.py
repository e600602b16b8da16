"""Similarity search over the values of a field, and the block keys that come of it.

Values become documents (distinct cleaned values or term lists).  A neighbour
table (query, document) is found by joins: on terms for TF-IDF, on segments for
edit distance.  Search keys are the neighbour table; canopy keys come from the
lexicographically first maximal independent set, in rounds.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.functions.keys import as_text, prepared, truthy, word_tokens

#: Terms in more documents than this, or than that share of them, are left out.
STOP_LEAST, STOP_SHARE = 1000, 0.05
#: Most links among documents whose canopies are found by one task.
FEW_LINKS = 1_000_000


def document(x: Column, kind: T.DataType, family: str) -> Column:
    """What a value is searched by: an array of terms, or for edit distance the cleaned text.  NULL for values that don't count."""
    if family == "TfidfSet":
        element = kind.elementType if isinstance(kind, T.ArrayType) else T.StringType()
        found = F.transform(x, lambda v: as_text(v, element))
    elif family == "TfidfText":
        found = word_tokens(as_text(x, kind))
    else:
        clean = prepared(as_text(x, kind))
        if family == "Levenshtein":
            found = clean
        else:
            empty = F.expr("cast(array() as array<string>)")
            grams = F.transform(F.sequence(F.lit(1), F.length(clean) - 1), lambda i: F.substring(clean, i, F.lit(2)))
            found = F.array_sort(F.when(F.length(clean) >= 2, grams).otherwise(empty))
    return F.when(truthy(x, kind), found)


def documents(records: DataFrame, field: str, family: str, id_col: str) -> DataFrame:
    """(id, doc, doc_id): each record's document and the document's id, the smallest id of a record that has it."""
    kind = records.schema[field].dataType
    own = records.select(F.col(id_col).alias("id"), document(F.col(field), kind, family).alias("doc")).filter("doc is not null")
    first = own.groupBy("doc").agg(F.min("id").alias("doc_id"))
    return own.join(first, "doc")


def postings(docs: DataFrame) -> DataFrame:
    """(doc_id, term, tf, w): w is (1 + ln tf) over the document's norm, as a float."""
    terms = docs.select("doc_id", F.explode("doc").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    raw = terms.withColumn("raw", 1.0 + F.log(F.col("tf").cast("double")))
    norms = raw.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norms, "doc_id").select("doc_id", "term", "tf", (F.col("raw") / F.col("norm")).cast("float").alias("w"))


def inverse_frequencies(posted: DataFrame, n_docs: int) -> DataFrame:
    """(term, idf) of the terms that aren't stop words; idf = ln(1 + N / df)."""
    most = math.trunc(max(STOP_LEAST, STOP_SHARE * n_docs))
    return posted.groupBy("term").agg(F.count("*").alias("df")).filter(F.col("df") <= most).select("term", F.log(1.0 + F.lit(float(n_docs)) / F.col("df")).alias("idf"))


def tfidf_scores(docs: DataFrame, queries: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score, qnorm) of all pairs that share a term; docs and queries are (doc_id, doc), each document once.

    Term frequencies and stop words are those of docs, or of ``counted``, documents of which docs are a part.
    One pass serves every threshold: a pair is near at t if score >= float(qnorm * t).
    """
    posted = postings(docs)
    idf = inverse_frequencies(posted, docs.count()) if counted is None else inverse_frequencies(postings(counted), counted.count())
    asked = queries.select(F.col("doc_id").alias("query_id"), F.explode("doc").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("n")).join(idf, "term")
    asked = asked.select("query_id", "term", "n", "idf")
    norms = asked.groupBy("query_id").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("qnorm"))
    hits = asked.join(posted.select("doc_id", "term", "w"), "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("n") * F.col("idf") * F.col("w").cast("double")).cast("float").alias("score"))
    return hits.join(norms, "query_id")


def _reaches(threshold: float) -> Column:
    return F.col("score") >= (F.col("qnorm") * F.lit(float(threshold))).cast("float")


def tfidf_neighbours(docs: DataFrame, queries: DataFrame, threshold: float) -> DataFrame:
    return tfidf_scores(docs, queries).filter(_reaches(threshold)).select("query_id", "doc_id", "score")


def _segments(text: Column, k: int, at: Column, length: Column) -> Column:
    """The k + 1 pieces of a text that are cut as even as possible: (number, start, piece)."""
    base, longer = F.floor(length / (k + 1)), length % (k + 1)
    del at

    def piece(i):
        start = i * base + F.greatest(i - (k + 1 - longer), F.lit(0))
        size = base + F.when(i >= k + 1 - longer, 1).otherwise(0)
        return F.struct(i.alias("i"), start.cast("int").alias("start"), F.substring(text, start.cast("int") + 1, size.cast("int")).alias("piece"))

    return F.transform(F.sequence(F.lit(0), F.lit(k)), piece)


def levenshtein_neighbours(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id) of documents within an edit distance of k; both sides are (doc_id, doc string), each once.

    A document's text is cut into k + 1 pieces; within k edits one of them stands
    unchanged in the query, moved by no more than k.  Short texts have empty
    pieces, which match by length alone.
    """
    cut = docs.select("doc_id", "doc", F.length("doc").alias("size"), F.inline(_segments(F.col("doc"), k, F.lit(0), F.length("doc"))))
    sizes = F.sequence(F.greatest(F.length("doc") - k, F.lit(0)), F.length("doc") + k)
    asked = queries.select(F.col("doc_id").alias("query_id"), F.col("doc").alias("query"), F.explode(sizes).alias("size"))
    blank = F.expr("''")
    asked = asked.select("query_id", "query", "size", F.inline(_segments(F.rpad(blank, F.col("size"), " "), k, F.lit(0), F.col("size")))).withColumn("width", F.length("piece")).drop("piece")
    shifts = F.sequence(F.greatest(F.col("start") - k, F.lit(0)), F.col("start") + k)
    asked = asked.withColumn("piece", F.explode(F.array_distinct(F.transform(shifts, lambda s: F.substring(F.col("query"), s + 1, F.col("width")))))).filter(F.length("piece") == F.col("width"))
    hits = asked.join(cut, ["size", "i", "piece"]).select("query_id", "query", "doc_id", "doc").distinct()
    return hits.filter(F.levenshtein("query", "doc", k) >= 0).select("query_id", "doc_id")


def _canopies_in_order(batches):
    centre_of: dict = {}
    kind = centre = last = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for asked, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if asked != last:
                last, centre = asked, centre_of.setdefault(asked, asked)
            if centre == asked:
                centre_of.setdefault(found, asked)
    if kind is not None:
        yield pa.RecordBatch.from_arrays([pa.array(list(x), type=kind) for x in (centre_of.keys(), centre_of.values())], names=["doc_id", "canopy"])


def canopies(near: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(doc_id, canopy) from a neighbour table among the documents.

    In the order of their ids, a document that no earlier centre has claimed
    becomes a centre and claims its unclaimed neighbours; a document without
    other neighbours forms no canopy.  A document can be decided as soon as all earlier documents
    that list it are, so all such are decided at once, round by round.  Up to
    ``FEW_LINKS`` links, which one task holds, the order is simply gone through.
    """
    near = keep(near.filter("query_id <> doc_id").select("query_id", "doc_id").distinct(), "near")
    if near.count() <= FEW_LINKS:
        kind = near.schema["doc_id"].dataType.simpleString()
        return near.coalesce(1).sortWithinPartitions("query_id").mapInArrow(_canopies_in_order, f"doc_id {kind}, canopy {kind}")
    earlier = keep(near.filter("query_id < doc_id"), "earlier")
    everyone = keep(near.select(F.col("query_id").alias("doc_id")).union(near.select("doc_id")).distinct(), "everyone")
    lists = keep(near.select("query_id").distinct(), "lists")
    states = None  # (doc_id, centre boolean)
    while True:
        if states is None:
            waiting = everyone.join(earlier.select("doc_id").distinct(), "doc_id", "left_anti")
            new = waiting.select("doc_id", F.lit(True).alias("centre"))
        else:
            told = earlier.join(states.select(F.col("doc_id").alias("query_id"), "centre"), "query_id", "left").join(states.select("doc_id"), "doc_id", "left_anti")
            told = told.groupBy("doc_id").agg(F.max(F.coalesce("centre", F.lit(False))).alias("claimed"), F.max(F.col("centre").isNull()).alias("open"))
            new = told.filter("claimed or not open").select("doc_id", (~F.col("claimed")).alias("centre"))
        # a centre needs a list of its own
        new = new.join(lists.withColumnRenamed("query_id", "doc_id").withColumn("has_list", F.lit(True)), "doc_id", "left").select("doc_id", (F.col("centre") & F.coalesce("has_list", F.lit(False))).alias("centre"))
        new = keep(new, "round")
        if new.isEmpty():
            break
        states = new if states is None else keep(states.unionByName(new), "states")
    if states is None:
        return everyone.select("doc_id", F.col("doc_id").alias("canopy")).limit(0)
    centres = states.filter("centre").select("doc_id")
    own = centres.select("doc_id", F.col("doc_id").alias("canopy"))
    claims = near.join(centres.withColumnRenamed("doc_id", "query_id"), "query_id").join(centres, "doc_id", "left_anti")
    return own.unionByName(claims.groupBy("doc_id").agg(F.min("query_id").alias("canopy")))


def search_tables(records: DataFrame, indexes: list, id_col: str, keep, target: DataFrame | None = None, context: DataFrame | None = None) -> dict:
    """For each similarity predicate its (id, key); those of one field and family share their documents and scores.

    For a canopy the key is its centre.  For a search the records ask and every
    document within the threshold is a key; with ``target`` records, those are
    what is searched, and their own document is their key (``target`` rows come
    from search_target_keys).  Terms are counted over what is searched, and the
    ``context`` records where given.
    """
    tables = {}
    shared: dict[tuple, list] = {}
    for index in indexes:
        shared.setdefault((index.field, index.family), []).append(index)
    for (field, family), group in shared.items():
        own = keep(documents(records, field, family, id_col), "documents")
        asked = own.select("doc_id", "doc").dropDuplicates(["doc_id"])
        docs = asked if target is None else keep(documents(target, field, family, id_col), "documents").select("doc_id", "doc").dropDuplicates(["doc_id"])
        thresholds = sorted({index.threshold for index in group})
        if family == "Levenshtein":
            near = {t: keep(levenshtein_neighbours(docs, asked, int(t)), "near") for t in thresholds}
        else:
            counted = None
            if context is not None:
                value = document(F.col(field), context.schema[field].dataType, family).alias("doc")
                counted = context.select(value).filter("doc is not null").union(docs.select("doc")).distinct()
                counted = keep(counted.select(F.monotonically_increasing_id().alias("doc_id"), "doc"), "counted")
            scores = keep(tfidf_scores(docs, asked, counted).filter(_reaches(thresholds[0])), "near-scores")
            near = {t: scores.filter(_reaches(t)).select("query_id", "doc_id") for t in thresholds}
        for index in group:
            if index.mode == "Canopy":
                found = canopies(near[index.threshold], keep).withColumnRenamed("canopy", "near_id")
            else:
                found = near[index.threshold].select(F.col("query_id").alias("doc_id"), F.col("doc_id").alias("near_id"))
            tables[index] = own.select("id", "doc_id").join(found, "doc_id").select("id", F.col("near_id").cast("string").alias("key"))
    return tables


def search_target_keys(target: DataFrame, index, id_col: str) -> DataFrame:
    """(id, key) of the records that are searched: their own document."""
    return documents(target, index.field, index.family, id_col).select("id", F.col("doc_id").cast("string").alias("key"))
