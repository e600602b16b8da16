"""Exact de-duplication with static binary-fuse filters.

Documents arrive in batches.  Rows that are equal within a batch are grouped
first.  Each batch's new digests become an immutable snapshot: an exact table
(the buckets), and one binary-fuse filter for each bucket, built once.  The
digests of a later batch are screened by the filters of all earlier snapshots;
negatives open a class, and only positives join the exact buckets to find theirs.
A class of one row is that row; the others are joined to their rows, and the
bytes of their texts are compared before anything is dropped.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import new_path, partitions, set_up, stash, text_or_empty

#: Digests that one filter bucket is meant to hold.
BUCKET_KEYS = 200_000
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3 over keys and a seed."""
    with np.errstate(over="ignore"):
        x = keys + np.uint64(seed) * _GOLDEN
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


class BinaryFuse:
    """A binary-fuse filter of three segments and 16-bit fingerprints: no false negatives, about 1 in 65,536 false positives."""

    def __init__(self, seed: int, length: int, segments: int, table: np.ndarray):
        self.seed, self.length, self.segments, self.table = seed, length, segments, table

    @staticmethod
    def _places(hashes: np.ndarray, length: int, segments: int) -> np.ndarray:
        """Three slots, one in each of three neighbouring segments."""
        first = ((hashes >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64) * length
        mask = np.uint64(length - 1)
        return np.stack([first + (hashes & mask).astype(np.int64), first + length + (hashes >> np.uint64(14) & mask).astype(np.int64), first + 2 * length + (hashes >> np.uint64(28) & mask).astype(np.int64)])

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse:
        """From 64-bit keys; repeats count once.  Seeds are tried in order, so equal keys give equal filters."""
        keys = np.unique(np.asarray(keys, dtype=np.uint64))
        n = len(keys)
        # sizes as published for arity 3
        length = min(1 << 14, 1 << max(2, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25))))
        room = n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2))) if n > 1 else 8
        segments = max(1, int(np.ceil(room / length)) - 2)
        for seed in range(1, 1000):
            if seed % 16 == 0:
                segments += 1 + segments // 8
            hashes = _mix(keys, seed)
            where = cls._places(hashes, length, segments)
            slots = (segments + 2) * length
            count = np.bincount(where.ravel(), minlength=slots)
            folded = np.zeros(slots, dtype=np.int64)
            ids = np.arange(n)
            for w in where:
                np.bitwise_xor.at(folded, w, ids)
            rounds, left = [], n
            ready = np.flatnonzero(count == 1)
            while len(ready):
                who, pick = np.unique(folded[ready], return_index=True)
                rounds.append((who, ready[pick]))
                left -= len(who)
                touched = where[:, who].ravel()
                np.subtract.at(count, touched, 1)
                np.bitwise_xor.at(folded, touched, np.tile(who, 3))
                touched = np.unique(touched)
                ready = touched[count[touched] == 1]
            if not left:
                break
        else:
            raise ValueError("no seed gives a filter")
        table = np.zeros(slots, dtype=np.uint16)
        prints = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint16)
        for who, slot in reversed(rounds):
            table[slot] = 0
            a, b, c = where[:, who]
            table[slot] = prints[who] ^ table[a] ^ table[b] ^ table[c]
        return cls(seed, length, segments, table)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        hashes = _mix(np.asarray(keys, dtype=np.uint64), self.seed)
        a, b, c = self._places(hashes, self.length, self.segments)
        return (hashes ^ (hashes >> np.uint64(32))).astype(np.uint16) == self.table[a] ^ self.table[b] ^ self.table[c]


def _keys(digests: pa.ChunkedArray) -> np.ndarray:
    """The first eight bytes of each digest."""
    return np.array([int.from_bytes(d[:8], "little") for d in digests.to_pylist()], dtype=np.uint64)


FILTERS = "snapshot int, bucket int, seed bigint, length bigint, segments bigint, prints binary"


def _build(table: pa.Table) -> pa.Table:
    built = BinaryFuse.build(_keys(table["digest"]))
    row = {"snapshot": table["snapshot"][:1], "bucket": table["bucket"][:1], "seed": [built.seed], "length": [built.length], "segments": [built.segments], "prints": [built.table.astype("<u2").tobytes()]}
    return pa.table({k: pa.chunked_array([v.combine_chunks()]) if isinstance(v, pa.ChunkedArray) else v for k, v in row.items()})


def _screen(incoming: pa.Table, filters: pa.Table) -> pa.Table:
    keys = _keys(incoming["digest"])
    hit = np.zeros(len(keys), dtype=bool)
    for f in filters.to_pylist():
        hit |= BinaryFuse(f["seed"], f["length"], f["segments"], np.frombuffer(f["prints"], dtype="<u2")).holds(keys)
    return incoming.append_column("positive", pa.array(hit))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 3, digest=lambda text: F.unhex(F.sha2(text, 256))) -> DataFrame:
    """For every row: (doc_id, digest, keep_id, group_size, kept), where equal texts form a group and its largest id stays.

    Batches are cut by doc_id modulo ``batches``; the result doesn't depend on
    them.  Null texts count as empty; rows with a null id belong to their text's
    group and stay only if no other row has it; rows that repeat an id are each
    counted and share one decision.  A table without rows gives none, and other
    columns are ignored.  ``digest`` may be any function to binary of at least eight bytes: texts
    with equal digests but different bytes stay apart.
    """
    spark = docs.sparkSession
    set_up(spark)
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), text_or_empty(text_col).alias("text"))
    batch = F.coalesce(F.pmod("doc_id", F.lit(batches)), F.lit(0)).cast("int")
    digests = stash(rows.select("doc_id", batch.alias("batch"), digest(F.col("text")).alias("digest")), "digests")
    n_buckets = max(partitions(spark), -(-digests.count() // BUCKET_KEYS))
    groups = digests.groupBy("batch", "digest").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
    groups = stash(groups.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(n_buckets)).cast("int")), "digest-groups")

    snapshots = new_path(spark, "snapshots")
    filters = new_path(spark, "filters")
    schema = "snapshot int, bucket int, digest binary, n bigint, last bigint"
    more = []  # what later batches add to the classes of earlier ones
    for b in range(batches):
        incoming = groups.filter(F.col("batch") == b).select(F.lit(b).alias("snapshot"), "bucket", "digest", "n", "last")
        if b:
            earlier = spark.read.schema(FILTERS).parquet(filters)
            screened = incoming.groupBy("bucket").cogroup(earlier.groupBy("bucket")).applyInArrow(_screen, schema + ", positive boolean")
            screened = stash(screened, f"screened-{b}")
            exact = spark.read.schema(schema).parquet(snapshots).select("digest", F.lit(True).alias("known"))
            positive = stash(screened.filter("positive").join(exact, "digest", "left"), f"positive-{b}")
            more.append(positive.filter("known").select("digest", "n", "last"))
            new = screened.filter("not positive").unionByName(positive.filter("known is null").drop("known")).drop("positive")
            new = stash(new, f"new-{b}")
        else:
            new = incoming
        new.write.mode("append").parquet(snapshots)
        if b < batches - 1:
            new.select("snapshot", "bucket", "digest").groupBy("bucket").applyInArrow(_build, FILTERS).write.mode("append").parquet(filters)

    classes = spark.read.schema(schema).parquet(snapshots).select("digest", "n", "last")
    if more:
        added = reduce(DataFrame.unionByName, more).groupBy("digest").agg(F.sum("n").alias("more_n"), F.max("last").alias("more_last"))
        total = F.col("n") + F.coalesce("more_n", F.lit(0))
        classes = classes.join(added, "digest", "left").select("digest", total.alias("n"), F.greatest("last", "more_last").alias("last"))
    classes = stash(classes, "classes")
    several = digests.join(classes.filter("n > 1"), "digest").select("doc_id", "digest", "n", "last")
    members = classes.filter("n = 1").select(F.col("last").alias("doc_id"), "digest", "n", "last").unionByName(several)
    same = _compare_bytes(rows, stash(members.filter("n > 1").select("doc_id").distinct(), "members"), digest)
    kept = F.col("doc_id").eqNullSafe(F.col("last"))
    if same is None:
        return members.select("doc_id", "digest", F.col("last").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"))
    clashes, exact = same
    clean = members.join(clashes, "digest", "left_anti").select("doc_id", "digest", "n", "last")
    apart = rows.withColumn("digest", digest(F.col("text"))).join(exact, ["digest", "text"]).select("doc_id", "digest", "n", "last")
    return clean.unionByName(apart).select("doc_id", "digest", F.col("last").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"))


def _compare_bytes(rows: DataFrame, members: DataFrame, digest):
    """None if equal digests always mean equal bytes; else the digests that don't, and their texts' groups."""
    texts = rows.join(members, rows["doc_id"].eqNullSafe(members["doc_id"]), "left_semi").select(digest(F.col("text")).alias("digest"), "text", "doc_id")
    groups = texts.groupBy("digest", "text").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
    clashes = stash(groups.groupBy("digest").count().filter("count > 1").select("digest"), "clashes")
    if clashes.isEmpty():
        return None
    return clashes, groups.join(clashes, "digest", "left_semi")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 3) -> DataFrame:
    """The rows of docs that exact_groups keeps, with all their columns.  Rows that share an id stay or go together, and they stay if one of them is kept."""
    decided = exact_groups(docs, id_col, text_col, batches).groupBy("doc_id").agg(F.max("kept").alias("kept"))
    lost = stash(decided.filter("not kept").select(F.col("doc_id").alias("_lost_id")), "exact-lost")
    return docs.join(lost, docs[id_col].cast("bigint").eqNullSafe(lost["_lost_id"]), "left_anti")
