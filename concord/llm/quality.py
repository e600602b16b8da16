"""Quality classifier: regularised quadratic discriminant analysis of document statistics.

Every text becomes a short vector of transformed statistics.  Each class gets a
mean and a covariance, shrunk towards its own diagonal and the pooled
covariance, and a Cholesky factor that is computed once.  A score is the
posterior of label 1 from the difference of the two log densities, each a
Mahalanobis distance and a log determinant; it is tempered, as the statistics aren't normal.

Fitting needs only sums of the vectors and of their products per class, which are
added up on the cluster, so all labelled rows count and none is sampled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import set_up, slices, stash, text_or_empty, tidy
from concord.llm.words import STOP_WORDS

STATISTICS = ("words", "word length", "symbols", "marks", "capitals", "digits", "repeats", "distinct", "bare", "stops", "top line")
#: Weight of the class's diagonal and of the pooled covariance in a class covariance, and what is added to each variance.
DIAGONAL, POOLED, FLOOR = 0.05, 0.05, 1e-3
#: What a difference of log densities is multiplied by.
TEMPER = 0.5
THRESHOLD = 0.3
FOLDS = 5

_CLASS = np.zeros((256, 6))
for _c in range(256):
    _t = chr(_c)
    if _c < 128 and _t in ".,;:'\"?()-":
        _CLASS[_c, 1] = 1
    elif _c < 128 and not _t.isalnum() and _c > 32:
        _CLASS[_c, 0] = 1
    elif 65 <= _c <= 90:
        _CLASS[_c, 2] = 1
    elif 48 <= _c <= 57:
        _CLASS[_c, 3] = 1
    elif _c > 32 and not 128 <= _c < 192:
        _CLASS[_c, 4] = 1
    if _c > 32 and not 128 <= _c < 192:
        _CLASS[_c, 5] = 1


def _log_odds(part: float, whole: float, usual: float, weight: float) -> float:
    """Log odds of a share, pulled towards the usual one as by that many characters or words."""
    return math.log((part + usual * weight) / (whole - part + (1 - usual) * weight))


def statistics(text: str) -> list[float]:
    """The vector of a text; every entry is finite, for an empty text too."""
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8), minlength=256)
    symbols, marks, capitals, digits, others, chars = (counts @ _CLASS).tolist()
    words = text.lower().split()
    n = len(words)
    distinct = len(set(words))
    repeats = sum(map(eq, words, words[1:]))
    stops = sum(map(STOP_WORDS.__contains__, words))
    bare = sum(not w.isalpha() and not any(map(str.isalpha, w)) for w in words if len(w) < 4)
    lines = [x for x in text.split("\n") if x]
    return [
        math.log1p(n),
        math.log((chars + 5) / (n + 1)),
        _log_odds(symbols, chars, 0.001, 100),
        _log_odds(marks, chars, 0.03, 100),
        _log_odds(capitals, capitals + others, 0.02, 200),
        _log_odds(digits, chars, 0.001, 100),
        _log_odds(repeats, n, 0.005, 20),
        math.log((distinct + 3) / (n + 3)) / math.log(n + 20),
        _log_odds(bare, n, 0.005, 20),
        _log_odds(stops, n, 0.24, 10),
        math.log((len(set(lines)) + 1) / (len(lines) + 1)),
    ]


@dataclass
class Discriminant:
    """Two normal densities with their cached factors."""

    means: np.ndarray
    factors: np.ndarray  # lower Cholesky factors of the shrunk covariances
    prior: float

    @classmethod
    def from_sums(cls, n: np.ndarray, sums: np.ndarray, products: np.ndarray) -> Discriminant:
        """From the number of rows, sums and sums of outer products of each class.  A class without rows takes the other's density."""
        size = sums.shape[1]
        if not n.any():
            return cls(np.zeros((2, size)), np.stack([np.eye(size)] * 2), 0.0)
        means = sums / np.maximum(n, 1)[:, None]
        scatter = products - n[:, None, None] * means[:, :, None] * means[:, None, :]
        pooled = scatter.sum(0) / max(n.sum() - 2, 1)
        factors = []
        for k in (0, 1):
            own = scatter[k] / max(n[k] - 1, 1) if n[k] > size else pooled
            shrunk = (1 - DIAGONAL - POOLED) * own + DIAGONAL * np.diag(np.diag(own)) + POOLED * pooled
            factors.append(np.linalg.cholesky(shrunk + FLOOR * np.eye(size)))
        if not n.all():
            means[:] = means[int(n[1] > 0)]
        return cls(means, np.stack(factors), math.log((n[1] + 1) / (n[0] + 1)))

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        """Posterior of label 1."""
        density = []
        for mean, factor in zip(self.means, self.factors, strict=True):
            z = np.linalg.solve(factor, (vectors - mean).T)
            density.append(-0.5 * (z * z).sum(0) - np.log(np.diag(factor)).sum())
        logit = np.clip(TEMPER * (density[1] - density[0]) + self.prior, -700, 700)
        return 1 / (1 + np.exp(-logit))


def _vectors(batches):
    for batch in batches:
        for some in slices(batch, 1):
            found = [statistics(t) for t in some.column(1).to_pylist()]
            flat = pa.array(np.asarray(found).ravel())
            offsets = pa.array(np.arange(len(found) + 1, dtype=np.int32) * len(STATISTICS))
            yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(offsets, flat)], names=["doc_id", "vector"])


def _class_sums(batches):
    size = len(STATISTICS)
    sums = np.zeros((2, 1 + size + size * size))
    for batch in batches:
        labels = np.asarray(batch.column(0))
        x = np.asarray(batch.column(1).flatten()).reshape(-1, size)
        for k in (0, 1):
            own = x[labels == k]
            sums[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
    width = sums.shape[1]
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], width).astype(np.int32)), pa.array(np.tile(np.arange(width), 2).astype(np.int32)), pa.array(sums.ravel())], names=["label", "place", "value"])


def document_vectors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, vector) for every row, stored so that texts are read once."""
    set_up(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return stash(rows.mapInArrow(tidy(_vectors), "doc_id bigint, vector array<double>"), "vectors")


def held_out(id_col: str = "doc_id"):
    """Rows that are never learnt from: one in five, by a checksum of the id."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def fit(vectors: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id") -> Discriminant:
    """Learn from the labelled rows that aren't held out.

    Null labels are left out; an id with several labels takes their majority, 1
    if even; rows that repeat an id count each.  The driver gets one number for
    each class and pair of statistics.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).cast("bigint").alias("doc_id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
    sums = vectors.join(known, "doc_id").select("label", "vector").mapInArrow(_class_sums, "label int, place int, value double")
    size = len(STATISTICS)
    total = np.zeros((2, 1 + size + size * size))
    for row in sums.groupBy("label", "place").agg(F.sum("value").alias("value")).collect():
        total[row["label"], row["place"]] = row["value"]
    return Discriminant.from_sums(total[:, 0], total[:, 1 : 1 + size], total[:, 1 + size :].reshape(2, size, size))


def score(vectors: DataFrame, model: Discriminant) -> DataFrame:
    """(doc_id, score) for every row."""
    set_up(vectors.sparkSession)

    def run(batches):
        for batch in batches:
            x = np.asarray(batch.column(1).flatten()).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], names=["doc_id", "score"])

    return vectors.select("doc_id", "vector").mapInArrow(run, "doc_id bigint, score double")


def score_documents(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """For every row: (doc_id, held_out, score, predicted).

    Null texts count as empty and are scored; rows that repeat an id are scored
    each; null ids are scored and never learnt from; without labels every score
    is 0.5; a table without rows gives none; other columns are ignored.
    """
    vectors = document_vectors(docs, id_col, text_col)
    scored = score(vectors, fit(vectors, labels, label_col, id_col))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with all their columns.

    Null texts count as empty and are scored as such; rows with a null id are
    scored and never learnt from; rows that repeat stay or go each by itself;
    without labels every score is 0.5; a table without rows gives none; columns
    of any name are carried along.
    """
    vectors = document_vectors(docs, id_col, text_col)
    model = fit(vectors, labels, label_col, id_col)
    names = docs.columns
    n = len(names)

    def run(batches):
        for batch in batches:
            for some in slices(batch, n):
                x = np.asarray([statistics(t) for t in some.column(n).to_pylist()])
                good = pa.array(model.scores(x) >= threshold)
                yield pa.RecordBatch.from_arrays([c.filter(good) for c in some.columns[:n]], names=names)

    rows = docs.select(*[docs[c] for c in names], text_or_empty(text_col)).toDF(*[f"c{i}" for i in range(n + 1)])
    return rows.mapInArrow(tidy(run), docs.schema)
