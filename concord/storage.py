"""Where intermediate tables go: the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's; one of our own only in local mode, where there is one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        found = context._jsc.sc().getCheckpointDir()
        if found.isEmpty():
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="concord-"))
            found = context._jsc.sc().getCheckpointDir()
        base = found.get()
    return base.rstrip("/")


def keeper(spark: SparkSession):
    """A function that stores a DataFrame in the shared folder and reads it back, which cuts its lineage."""
    jvm = spark.sparkContext._jvm

    def keep(df: DataFrame, label: str) -> DataFrame:
        path = f"{shared_dir(spark)}/concord/{label}-{uuid.uuid4().hex}"
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
        df.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return keep
