"""Arriving vectors into an existing index: each micro-batch is assigned and appended to its lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from orrery.operators import ivf


def assign_stream(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """A stream of (vec_id, embedding) with cluster_id and dist_to_c; centroids are a small static table."""
    return ivf.assign(vectors, centroids)


def append_to_lists(vectors: DataFrame, centroids: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Writes a stream of vectors to ``path``, partitioned by list; ``checkpoint`` makes restarts exactly-once."""
    out = assign_stream(vectors, centroids).writeStream.format("parquet").partitionBy("cluster_id")
    return out.option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
