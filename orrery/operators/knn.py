"""Exact k-nearest-neighbour join and per-query top-k."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import vector as V
from orrery.operators import arrays

FOUND = "qid long, vec_id long, dist double"


def top_k(scored: DataFrame, k: int, dist: str | tuple[str, ...] = "dist", key: str | tuple[str, ...] = "qid", tie: str = "vec_id") -> DataFrame:
    """The k smallest of each key with their rank from 1; Spark limits each partition before the exchange."""
    names = lambda x: (x,) if isinstance(x, str) else x
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*names(key)).orderBy(*names(dist), tie))).where(F.col("rank") <= k)


def exact_knn_join(base: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """qid, rank, vec_id, dist: for every query (qid, q) its k nearest rows of base (vec_id, embedding).

    Parts of the queries, of bounded size, are broadcast; every task keeps the k best of each over all its rows.
    """
    spark = base.sparkSession

    def scan(part: DataFrame) -> DataFrame:
        shared = spark.sparkContext.broadcast(arrays.collect_vectors(part, "qid", "q"))

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, x = shared.value
            best = arrays.Best(len(ids), k)
            for batch in batches:
                if batch.num_rows:
                    vec = batch["vec_id"].to_numpy()
                    for i, row in enumerate(arrays.sqr_l2(x, arrays.matrix(batch["embedding"]))):
                        best.give(i, row, vec)
            i, d, vec = best.rows()
            yield pa.record_batch([pa.array(ids[i]), pa.array(vec), pa.array(d)], ["qid", "vec_id", "dist"])

        return base.select("vec_id", "embedding").mapInArrow(nearest, FOUND)

    found = reduce(DataFrame.unionByName, [scan(part) for part in arrays.query_parts(queries, most=max(1, arrays.HELD // k))])
    return top_k(found, k).select("qid", "rank", "vec_id", "dist")


def exact_knn_single(base: DataFrame, query: list[float], k: int) -> DataFrame:
    """vec_id, dist of the k rows nearest to one vector: a sort-free take of ordered rows."""
    q = V.double(F.from_json(F.lit(str([float(x) for x in query])), "array<double>"))
    return base.select("vec_id", V.sqr_l2(F.col("embedding"), q).alias("dist")).orderBy("dist", "vec_id").limit(k)


def gather(base: DataFrame, ids: DataFrame, key: str = "vec_id") -> DataFrame:
    """The rows of base with these ids."""
    return base.join(ids.select(key).distinct(), key, "left_semi")


def radius_join(base: DataFrame, queries: DataFrame, centroids: DataFrame, limit: float) -> DataFrame:
    """Rows of base within a squared distance of each query; both sides meet only in lists whose ball can reach.

    By the triangle inequality a vector x of cluster c is out of reach of q unless |q - c| - |x - c| <= r.
    """
    from orrery.operators import ivf

    lists = ivf.assign(base, centroids)
    reach = lists.groupBy("cluster_id").agg(F.max("dist_to_c").alias("radius"))
    probes = ivf.coarse_probe(queries, centroids, None).join(reach, "cluster_id").where(F.sqrt("sqr_y") - F.col("radius") <= limit**0.5 + 1e-9)
    pairs = probes.join(queries, "qid").join(lists, "cluster_id")
    return pairs.select("qid", "vec_id", V.sqr_l2(F.col("q"), F.col("embedding")).alias("dist")).where(F.col("dist") <= limit)
