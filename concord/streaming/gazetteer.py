"""Look-ups of a stream of records in a gazetteer that doesn't change meanwhile."""

from __future__ import annotations

from pyspark.sql import DataFrame


def search_stream(gazetteer, stream: DataFrame, path: str, checkpoint: str, threshold: float = 0.0, n_matches: int = 1):
    """Start a query that writes each micro-batch's matches as Parquet, one folder per batch, so that a repeated batch overwrites its own."""

    def probe(batch: DataFrame, number: int) -> None:
        gazetteer.search(batch, threshold, n_matches).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(probe).option("checkpointLocation", checkpoint)
