"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import uuid
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.shipping import ship
from concord.storage import shared_dir

#: White space and letters that the operators treat specially: ASCII only.
SPACES = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Bytes from which Spark ends an Arrow batch of several rows, where the session doesn't say: each task holds a batch in the JVM and in Python.
BATCH_BYTES = 8 << 20


def set_up(spark: SparkSession) -> None:
    """Send the package to the executors, and bound the Arrow batches unless the session has a bound of its own."""
    ship(spark)
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if bound not in spark.conf.getAll:
        spark.conf.set(bound, str(BATCH_BYTES))


def new_path(spark: SparkSession, label: str) -> str:
    """An unused path in the shared folder, removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/concord/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def stashed(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write a DataFrame to the shared folder and read it back, and where it is: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stash(df: DataFrame, label: str) -> DataFrame:
    return stashed(df, label)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a stash that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def tidy(function, *forget):
    """A function of Arrow batches that gives its memory back at its end, as Python workers wait for later tasks; ``forget`` is called before."""

    @wraps(function)
    def run(batches):
        try:
            yield from function(batches)
        finally:
            for f in forget:
                f()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
            if trim:
                trim(0)

    return run


def slices(batch, column: int, rows: int = 512, size: int = 4 << 20):
    """Parts of an Arrow batch of at most that many rows, and of that many bytes in the column unless one row has more."""
    at = 0
    while at < batch.num_rows:
        n = min(rows, batch.num_rows - at)
        while n > 1 and batch.column(column).slice(at, n).nbytes > size:
            n //= 2
        yield batch.slice(at, n)
        at += n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
