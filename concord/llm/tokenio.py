"""Token-id files: Simple-8b blocks in ascending document order, and their reader.

A token file is a Parquet folder whose rows are blocks.  A block holds whole
documents: its ids as Simple-8b words (zigzag-free, word-aligned), the number of
ids of each document, and how many ids come before it in its shard.  Shards are
ranges of doc_id, numbered in ascending order.  Any block can be read alone, and
it is decoded by whole arrays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from concord.llm import simple8b
from concord.llm.common import partitions, set_up, slices, text_or_empty, tidy
from concord.llm.tokens import encoder

#: Ids from which a block is closed.
BLOCK_IDS = 1 << 16
BLOCKS = "shard int, block bigint, before bigint, n_ids bigint, doc_ids array<bigint>, doc_lengths array<bigint>, words binary"
_BLOCK = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64())), ("words", pa.binary())])
TOKENS = "doc_id bigint, shard int, within bigint, n_tokens bigint, ids binary"
_TOKEN = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("within", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def _writer(path: str, end_id: int, block_ids: int):
    def write(batches):
        shard, coder, end = TaskContext.get().partitionId(), encoder(path), np.uint32(end_id).astype("<u4").tobytes()
        docs: list = []
        lengths: list[int] = []
        held: list[bytes] = []
        before = block = 0

        def out():
            nonlocal before, block
            ids = np.frombuffer(b"".join(held), dtype="<u4")
            row = [[shard], [block], [before], [len(ids)], [docs.copy()], [lengths.copy()], [simple8b.encode(ids).astype("<u8").tobytes()]]
            found = pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(row, _BLOCK.types, strict=True)], schema=_BLOCK)
            before, block = before + len(ids), block + 1
            for x in (docs, lengths, held):
                x.clear()
            return found

        size = 0
        for batch in batches:
            for some in slices(batch, 1, 2048):
                for doc, coded in zip(some.column(0).to_pylist(), coder.encode(some.column(1)), strict=True):
                    docs.append(doc)
                    held.append(coded + end)
                    lengths.append(len(held[-1]) // 4)
                    size += lengths[-1]
                    if size >= block_ids:
                        yield out()
                        size = 0
        if docs:
            yield out()

    return write


def write_token_file(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None, block_ids: int = BLOCK_IDS) -> None:
    """Encode every text, append the end id, and write blocks in ascending id order.

    Null and empty texts are the end id alone; null ids come first; rows with
    equal ids are ordered by their text; a table without rows gives a file
    without blocks; other columns are ignored.  One shuffle, by ranges of the id.
    """
    set_up(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = rows.repartitionByRange(shards or partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(tidy(_writer(tokenizer, end_id, block_ids), lambda: encoder(tokenizer).forget()), BLOCKS).write.option("compression", "zstd").parquet(path)


def _read(batches):
    for row in (x for batch in batches for at in range(batch.num_rows) for x in batch.slice(at, 1).to_pylist()):
        ids = simple8b.decode(np.frombuffer(row["words"], dtype="<u8"), row["n_ids"]).astype("<u4").tobytes()
        lengths = row["doc_lengths"]
        ends = np.cumsum(lengths, dtype=np.int64)
        starts = (ends - lengths).tolist()
        columns = [row["doc_ids"], [row["shard"]] * len(lengths), [row["before"] + s for s in starts], lengths, [ids[4 * s : 4 * e] for s, e in zip(starts, ends.tolist(), strict=True)]]
        yield pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(columns, _TOKEN.types, strict=True)], schema=_TOKEN)


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document; start counts all ids before it in the file, ids are uint32 bytes.

    A document without text has its end id alone; null ids stay null and come first;
    repeated rows are documents each; a file without blocks gives no rows. A
    block is decoded by itself. A window adds up the shards' totals: as many rows as there are shards.
    """
    set_up(spark)
    blocks = spark.read.schema(BLOCKS).parquet(path)
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("shard", F.coalesce(F.sum("total").over(order), F.lit(0)).alias("shard_start"))
    tokens = blocks.mapInArrow(tidy(_read), TOKENS)
    return tokens.join(F.broadcast(offsets), "shard").select("doc_id", (F.col("shard_start") + F.col("within")).alias("start"), "n_tokens", "ids")
