"""Line de-duplication with levelled sorted runs of line hashes.

The store is a list of runs: tables of (hash, owner) sorted by hash, disjoint
from each other.  A batch's hashes are merged against every run and what is new
becomes a run of level 0; as soon as a level holds ``fanout`` runs, they are
compacted to one run of the next level.  Batches are ranges of doc_id in
ascending order, so the batch that brings a hash first also has the smallest
document that holds it: its owner.  A line goes from every other document.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm.common import SPACES, new_path, set_up, slices, stash, text_or_empty, tidy

#: Shortest key that counts, in code points.
LEAST_CHARS = 10
_STRIP = SPACES.encode()
_LAST = (1 << 63) - 1  # where rows with a null id come in the order


def line_key(line: bytes, least: int) -> bytes | None:
    """The 16-byte hash of a line's key; None for short keys."""
    key = line.strip(_STRIP).lower()
    if len(key) < least or (len(key) < 4 * least and len(key.decode("utf-8", "surrogatepass")) < least):
        return None
    return xxhash.xxh3_128_digest(key)


def _hasher(least: int):
    def hashes(batches):
        for batch in batches:
            for some in slices(batch, 2):
                counts, found = [], []
                for text in some.column(2).to_pylist():
                    own = {line_key(line, least) for line in text.encode("utf-8", "surrogatepass").split(b"\n")}
                    own.discard(None)
                    counts.append(len(own))
                    found += own
                ids = [pa.array(np.repeat(np.asarray(c), counts)) for c in some.columns[:2]]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(found, type=pa.binary())], names=["doc", "row", "h"])

    return hashes


class LineRuns:
    """The levelled store.  add() takes a batch of (h, doc) whose documents come after all earlier ones."""

    SCHEMA = "h binary, owner bigint"

    def __init__(self, spark: SparkSession, fanout: int = 2):
        self.spark, self.fanout = spark, fanout
        self.levels: list[list[str]] = []

    def _write(self, run: DataFrame, level: int) -> None:
        path = new_path(self.spark, f"run-{level}")
        run.repartition("h").sortWithinPartitions("h").write.option("compression", "zstd").parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)
        if len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            self._write(self._read(runs), level + 1)

    def _read(self, paths: list[str]) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.spark.read.schema(self.SCHEMA).parquet(p) for p in paths])

    def add(self, batch: DataFrame) -> None:
        new = batch.groupBy("h").agg(F.min("doc").alias("owner"))
        for run in (p for level in self.levels for p in level):
            new = new.join(self._read([run]).select("h").hint("merge"), "h", "left_anti")
        self._write(new, 0)

    def all(self) -> DataFrame:
        return self._read([p for level in self.levels for p in level])


def _dropper(least: int):
    def drop(batches):
        for batch in batches:
            for some in slices(batch, 1, 256):
                out: list[tuple] = []
                for text, hashes in zip(some.column(1).to_pylist(), some.column(2).to_pylist(), strict=True):
                    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
                    gone = set(hashes or ())
                    kept = [x for x in lines if line_key(x, least) not in gone] if gone else lines
                    out.append((len(lines), len(lines) - len(kept), b"\n".join(kept).decode("utf-8", "surrogatepass")))
                lines, dropped, kept = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(lines, type=pa.int64()), pa.array(dropped, type=pa.int64()), pa.array(kept, type=pa.string())], names=["doc_id", "n_lines", "n_dropped", "text"])

    return drop


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 4, fanout: int = 2, least: int = LEAST_CHARS) -> DataFrame:
    """For every row: (doc_id, n_lines, n_dropped, text), the text without the lines that an earlier document has.

    Null texts count as empty, and an empty text is one empty line; rows with a
    null id come last and count as one document, as do rows that repeat an id;
    a line that repeats inside the document that owns it stays; a table without rows gives none; other columns are ignored.
    """
    spark = docs.sparkSession
    set_up(spark)
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"))
    order = F.coalesce("doc_id", F.lit(_LAST))
    # rows of one document are told apart by their text, so that each is joined with its own lines only
    row = F.xxhash64("text")
    lines = stash(rows.select(order.alias("doc"), row.alias("row"), "text").mapInArrow(tidy(_hasher(least)), "doc bigint, row bigint, h binary"), "lines")
    cuts = sorted({int(x) for x in rows.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.02)})
    runs = LineRuns(spark, fanout)
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = lines if low is None else lines.filter(F.col("doc") > low)
        runs.add(part if high is None else part.filter(F.col("doc") <= high))
    lost = lines.join(runs.all().hint("merge"), "h").filter("owner < doc").groupBy("doc", "row").agg(F.collect_set("h").alias("lost"))
    joined = rows.join(lost, (order == lost["doc"]) & (row == lost["row"]), "left").select("doc_id", "text", "lost")
    return joined.mapInArrow(tidy(_dropper(least)), "doc_id bigint, n_lines bigint, n_dropped bigint, text string")


ORACLE = r"""
with lines as (
    select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as place from documents),
keyed as (select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
owned as (select *, length(key) >= 10 and min(doc_id) over (partition by key) < doc_id as lost from keyed)
select doc_id, count(*) as n_lines, count(*) filter (where lost) as n_dropped,
    sha256(coalesce(string_agg(line, chr(10) order by place) filter (where not lost), '')) as kept_sha256
from owned group by doc_id
"""


