"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the k smallest distinct hashes of a document's word shingles.
Sketches of parts merge to the sketch of the whole; two sketches estimate
resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import partitions, set_up, slices, text_or_empty
from concord.llm.shingles import shingle_sets

K, WIDTH = 128, 5
_SPACE = float(1 << 64)


def merge(sketches: list[np.ndarray], k: int = K) -> np.ndarray:
    """The sketch of the union of what the sketches stand for."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *sketches]))[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Jaccard likeness, from the share of the union's sketch that both have.  1 for two empty sketches, 0 for an empty and another."""
    union = merge([a, b], k)
    if not len(union):
        return 1.0
    common = np.intersect1d(a, b, assume_unique=True)
    return float(np.count_nonzero(common <= union[-1])) / len(union)


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) * _SPACE / (float(a[k - 1]) + 1.0)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has: intersection over a; 1 for an empty a."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct(merge([a, b], k), k) / distinct(a, k))


def to_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u8").tobytes().hex()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), dtype=">u8").astype(np.uint64)


def sketches(texts: list[str | None], k: int = K, width: int = WIDTH):
    for hashes in shingle_sets(texts, width):
        yield hashes[:k]


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, width: int = WIDTH) -> DataFrame:
    """For every row: (doc_id, n_chars, fingerprint), where equal texts have equal fingerprints.

    Null texts count as empty, and a text without words has an empty
    fingerprint; a null id stays null; repeated rows have a fingerprint each; a
    table without rows gives none; other columns are ignored.  No shuffle.
    """

    set_up(docs.sparkSession)

    def run(batches):
        for some in (x for batch in batches for x in slices(batch, 1)):
            texts = some.column(1).to_pylist()
            prints = [to_text(s) for s in sketches(texts, k, width)]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array([len(t) for t in texts], type=pa.int64()), pa.array(prints, type=pa.string())], names=["doc_id", "n_chars", "fingerprint"])

    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_chars bigint, fingerprint string")


def merge_fingerprints(prints: DataFrame, key: str, column: str = "fingerprint", k: int = K) -> DataFrame:
    """(key, fingerprint): the sketch of everything under a key.

    Each task first merges what it reads, so that a key of any size leaves one
    sketch per task, and no group is collected.  Null fingerprints count as
    empty; rows with a null key belong together; repeats change nothing; a table
    without rows gives none; the key may have any name but ``fingerprint``.
    """

    set_up(prints.sparkSession)

    def partial(batches):
        held: dict = {}
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sketch = from_text(text or "")
                held[name] = merge([held[name], sketch], k) if name in held else sketch
            if len(held) > 10_000:
                yield flush(held)
        if held:
            yield flush(held)

    def flush(held):
        out = pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([to_text(s) for s in held.values()], type=pa.string())], names=[key, "fingerprint"])
        held.clear()
        return out

    if key == "fingerprint":
        raise ValueError("the key needs another name than the result's column")
    kind = prints.schema[key].dataType.simpleString()
    rows = prints.select(F.col(key), F.col(column).alias("fingerprint"))
    schema = f"`{key}` {kind}, fingerprint string"
    once = rows.mapInArrow(partial, schema)
    return once.repartition(key).sortWithinPartitions(key).mapInArrow(_merge_sorted(key, k), schema)


def _merge_sorted(key: str, k: int):
    def run(batches):
        name, held, any_row = None, np.zeros(0, np.uint64), False
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            done = []
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if any_row and own != name:
                    done.append((name, to_text(held)))
                    held = np.zeros(0, np.uint64)
                name, any_row, held = own, True, merge([held, from_text(text)], k)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], type=kind), pa.array([d[1] for d in done], type=pa.string())], names=[key, "fingerprint"])
        if any_row:
            yield pa.RecordBatch.from_arrays([pa.array([name], type=kind), pa.array([to_text(held)], type=pa.string())], names=[key, "fingerprint"])

    return run


_FIRST = -(1 << 63)  # where rows with a null id come in descending order: last


def _dealer(points: list[int], firsts: dict[int, int], last: int):
    """Parts are ranges of ids in descending order; the first rows of a part also go to the part before, as its tail."""
    cuts = np.array(points, dtype=np.int64)

    def deal(batches):
        for batch in batches:
            ids = np.asarray(batch.column(0))
            part = len(cuts) - np.searchsorted(cuts, ids, side="left")
            yield pa.RecordBatch.from_arrays([pa.array(part, type=pa.int32()), pa.array(np.zeros(len(ids), np.int32)), batch.column(0), batch.column(1)], names=["part", "tail", "doc", "text"])
            for p in np.unique(part).tolist():
                rows = np.flatnonzero((part == p) & (ids == firsts[p]))
                if len(rows):
                    to = p - 1 if p else last
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), to), type=pa.int32()), pa.array(np.ones(len(rows), np.int32)), batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows))], names=["part", "tail", "doc", "text"])

    return deal


_EDITED = "doc bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _editor(k: int, width: int):
    def run(batches):
        held = None  # the row that waits for its next: (part, doc, text, sketch)
        for batch in batches:
            parts, tails, docs = (batch.column(i).to_pylist() for i in range(3))
            for at in range(0, len(docs), 256):
                texts = batch.column(3).slice(at, 256).to_pylist()
                ready = []
                for part, tail, doc, text, sketch in zip(parts[at : at + 256], tails[at : at + 256], docs[at : at + 256], texts, sketches(texts, k, width), strict=True):
                    if held is not None and held[0] == part:
                        own, n = held[2], len(held[2])
                        ready.append((held[1], n, own[: n - n // 3] + text[: n // 3], held[3], sketch))
                    held = None if tail else (part, doc, text, sketch)
                if ready:
                    rows = []
                    for (doc, n, edited, own, after), sketch in zip(ready, sketches([r[2] for r in ready], k, width), strict=True):
                        rows.append((doc, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), to_text(own), to_text(sketch), resemblance(own, sketch, k), resemblance(own, after, k)))
                    columns = list(zip(*rows, strict=True))
                    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=[f.split()[0] for f in _EDITED.split(", ")])

    return run


def fingerprint_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, width: int = WIDTH) -> DataFrame:
    """Fingerprints of each text and of the text with its last third replaced by the next document's beginning, and how like they are.

    The next document is the one with the next smaller id; after the last comes
    the first.  Rows with equal ids go by their text; null ids come last; null
    texts count as empty; a single row is its own next; a table without rows
    gives none; other columns are ignored.  One shuffle of the texts, by ranges of the id; what
    the driver holds is one number per range.
    """
    spark = docs.sparkSession
    set_up(spark)
    rows = docs.select(F.coalesce(docs[id_col].cast("bigint"), F.lit(_FIRST)).alias("doc"), text_or_empty(text_col).alias("text"))
    n = partitions(spark)
    points = sorted({int(x) for x in docs.select(docs[id_col].cast("bigint").alias("doc")).approxQuantile("doc", [i / n for i in range(1, n)], 0.1 / n)})
    cuts = np.array(points, dtype=np.int64)

    def part_of(batches):
        for batch in batches:
            ids = np.asarray(batch.column(0))
            part = len(cuts) - np.searchsorted(cuts, ids, side="left")
            found = {p: int(ids[part == p].max()) for p in np.unique(part).tolist()}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), type=pa.int32()), pa.array(list(found.values()), type=pa.int64())], names=["part", "first"])

    firsts = {r["part"]: r["first"] for r in rows.select("doc").mapInArrow(part_of, "part int, first bigint").groupBy("part").agg(F.max("first").alias("first")).collect()}
    names = {p: i for i, p in enumerate(sorted(firsts))}  # ranges without rows go
    if len(names) < len(points) + 1:
        points = sorted(firsts[p] for p in list(sorted(firsts))[1:])
        firsts = {names[p]: f for p, f in firsts.items()}
    dealt = rows.mapInArrow(_dealer(points, firsts, max(len(firsts) - 1, 0)), "part int, tail int, doc bigint, text string")
    dealt = dealt.repartitionById(max(len(firsts), 1), F.col("part")).sortWithinPartitions("part", "tail", F.col("doc").desc(), "text")
    out = dealt.select("part", "tail", "doc", "text").mapInArrow(_editor(k, width), _EDITED)
    return out.select(F.when(F.col("doc") != _FIRST, F.col("doc")).alias("doc_id"), *[c.split()[0] for c in _EDITED.split(", ")[1:]])
