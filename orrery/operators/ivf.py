"""Inverted lists: nearest-centroid assignment, probing, list statistics and search over raw vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.operators import arrays


def _with(schema: T.StructType, **more: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in schema.fields if f.name not in more), *(T.StructField(k, v) for k, v in more.items())])


def assign(base: DataFrame, centroids: DataFrame) -> DataFrame:
    """``base`` with cluster_id (nearest centroid, ties to the smaller id) and dist_to_c (Euclidean)."""
    cids, c = arrays.collect_centroids(centroids)
    shared = base.sparkSession.sparkContext.broadcast((cids.astype(np.int32), c))
    schema = _with(base.schema, cluster_id=T.IntegerType(), dist_to_c=T.DoubleType())
    names = [f.name for f in schema.fields[:-2]]

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            d = arrays.sqr_l2(arrays.matrix(batch["embedding"]), x)
            best = d.argmin(1)
            columns = [batch[n] for n in names] + [pa.array(ids[best]), pa.array(np.sqrt(d[np.arange(len(best)), best]))]
            yield pa.record_batch(columns, [f.name for f in schema.fields])

    return base.mapInArrow(nearest, schema)


def by_list(rows: DataFrame) -> DataFrame:
    """Rows dealt by list; Spark cuts a list that is too long for one task, and joins small ones."""
    return rows.hint("rebalance", "cluster_id")


def inverted_lists(assigned: DataFrame) -> DataFrame:
    """Rows clustered by list and sorted in it: the layout that is written, so that probes prune files."""
    return by_list(assigned).sortWithinPartitions("cluster_id", "vec_id")


def cluster_sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))


def cluster_stats(assigned: DataFrame) -> DataFrame:
    """One row: lists that have rows, rows, and mean, largest and smallest list."""
    n = F.col("n")
    return cluster_sizes(assigned).agg(
        F.count(n).alias("clusters"), F.sum(n).alias("vectors"), F.avg(n).alias("mean_size"), F.max(n).alias("max_size"), F.min(n).alias("min_size")
    )


def size_histogram(assigned: DataFrame, bins: int = 10) -> DataFrame:
    """bin, low, high, lists: equal-width histogram of list sizes."""
    sizes = cluster_sizes(assigned)
    span = sizes.agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    at = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("n") - F.col("lo")) / width).cast("int"))).otherwise(0)
    return (
        sizes.join(F.broadcast(span), F.lit(True)).withColumn("bin", at).groupBy("bin", "lo", "hi").agg(F.count(F.lit(1)).alias("lists"))
        .select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), "lists")
    )


def coarse_probe(queries: DataFrame, centroids: DataFrame, nprobe: int | None) -> DataFrame:
    """qid, rank, cluster_id, sqr_y: the nprobe nearest centroids of every query (all, if None), nearest first."""
    cids, c = arrays.collect_centroids(centroids)
    shared = queries.sparkSession.sparkContext.broadcast((cids.astype(np.int32), c))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = shared.value
        n = min(nprobe or len(ids), len(ids))
        for batch in batches:
            if not batch.num_rows:
                continue
            d = arrays.sqr_l2(arrays.matrix(batch["q"]), x)
            at = np.stack([arrays.smallest(row, ids, n) for row in d])
            yield pa.record_batch(
                [pa.array(np.repeat(batch["qid"].to_numpy(), n)), pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(d))), pa.array(ids[at].reshape(-1)), pa.array(np.take_along_axis(d, at, 1).reshape(-1))],
                ["qid", "rank", "cluster_id", "sqr_y"],
            )

    return queries.select("qid", "q").mapInArrow(probe, "qid long, rank int, cluster_id int, sqr_y double")


def ivf_flat_search(lists: DataFrame, queries: DataFrame, centroids: DataFrame, nprobe: int, k: int) -> DataFrame:
    """qid, rank, vec_id, dist: exact distances inside the probed lists; lists carry cluster_id."""
    from orrery.operators import scan

    return scan.flat_search(lists, queries, centroids, [nprobe], k).drop("nprobe")


def candidates(lists: DataFrame, probes: DataFrame, *columns: str) -> DataFrame:
    """Every (query, row of a probed list): probes joined to lists on cluster_id."""
    return probes.join(lists.select("cluster_id", "vec_id", *columns), "cluster_id")


def sample_rows(df: DataFrame, n: int, key: str = "vec_id", seed: int = 123) -> DataFrame:
    """n rows without replacement, the same ones each time: those whose seed and key have the smallest MD5."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def running_probe_share(probes: DataFrame) -> DataFrame:
    """probes with the share of their query's lists visited so far."""
    return probes.withColumn("visited", F.col("rank") / F.count(F.lit(1)).over(Window.partitionBy("qid")))
