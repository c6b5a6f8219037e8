"""The bucket collector: large top-k sets from a mergeable histogram instead of a sort.

Distances of a query fall into ``logical`` equal-width buckets between a lower and an upper end; buckets of
about equal depth are merged into ``physical`` ones.  Counts by (query, bucket) are partial aggregates, so
what crosses the network is buckets, not rows; the bucket in which the running count reaches k bounds the
k-th distance, and only rows below it are looked at again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions import vector as V


def codebook(scored: DataFrame, k: int, logical: int = 256, sample_share: float | None = 0.01, dist: str = "est") -> DataFrame:
    """qid, low, delta: a query's range [smallest, k-th smallest + 1e-5] over its sampled lists.

    Sampled are the first max(1, share * lists) of a query's lists by rank; all rows with ``sample_share`` None.
    A query with fewer than k sampled rows takes the largest.
    """
    if sample_share is not None:
        lists = scored.groupBy("qid").agg(F.max("rank").alias("lists"))
        scored = scored.join(lists, "qid").where(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.lit(sample_share) * F.col("lists"))))
    nth = Window.partitionBy("qid").orderBy(dist, "vec_id")
    first = scored.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= k)
    ends = first.groupBy("qid").agg(F.min(dist).alias("low"), F.max(dist).alias("high"))
    return ends.select("qid", "low", ((F.col("high") + 1e-5 - F.col("low")) / logical).alias("delta"))


def with_buckets(scored: DataFrame, book: DataFrame, logical: int = 256, **columns: str) -> DataFrame:
    """``scored`` with a bucket column for each name=distance pair."""
    out = scored.join(book, "qid")
    for name, dist in columns.items():
        out = out.withColumn(name, V.bucket_code(F.col(dist), F.col("low"), F.col("delta"), logical))
    return out.drop("low", "delta")


def histogram(bucketed: DataFrame, bucket: str = "bucket") -> DataFrame:
    """qid, bucket, n."""
    return bucketed.groupBy("qid", F.col(bucket).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def equal_depth(hist: DataFrame, physical: int = 32) -> DataFrame:
    """qid, bucket, n, upto, code: logical buckets merged so that each physical one holds about a share of the rows."""
    so_far = Window.partitionBy("qid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy("qid")
    return (
        hist.withColumn("upto", F.sum("n").over(so_far)).withColumn("target", F.sum("n").over(every) / physical)
        .withColumn("code", F.least(F.lit(physical - 1), F.floor((F.col("upto") - F.col("n")) / F.col("target")).cast("int"))).drop("target")
    )


def threshold(hist: DataFrame, k: int, beyond: int) -> DataFrame:
    """qid, th: the first bucket after the one where the running count reaches k; ``beyond`` where it never does."""
    so_far = Window.partitionBy("qid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = hist.withColumn("upto", F.sum("n").over(so_far))
    return reached.groupBy("qid").agg((F.coalesce(F.min(F.when(F.col("upto") >= k, F.col("bucket"))), F.lit(beyond)) + 1).alias("th"))


def predicted(hist: DataFrame, k: int, visited: float, beyond: int) -> DataFrame:
    """qid, th, pred: also the bucket that is expected to hold the share ``visited`` of k, capped by th."""
    share = threshold(hist, max(1, int(visited * k)), beyond).withColumnRenamed("th", "pred")
    return threshold(hist, k, beyond).join(share, "qid").withColumn("pred", F.least("pred", "th"))


def bucket_top_k(scored: DataFrame, k: int, logical: int = 256, dist: str = "dist") -> DataFrame:
    """qid, rank and the columns of ``scored`` for its k smallest: histogram, threshold, then a sort of what is left.

    The range is each query's smallest to largest distance, so no row is lost whatever their distribution.
    """
    ends = scored.groupBy("qid").agg(F.min(dist).alias("low"), F.max(dist).alias("hi")).select("qid", "low", ((F.col("hi") - F.col("low")) / logical).alias("delta"))
    bucketed = with_buckets(scored, ends, logical, bucket=dist)
    th = threshold(histogram(bucketed), k, logical)
    left = bucketed.join(th, "qid").where(F.col("bucket") < F.col("th")).drop("bucket", "th")
    from orrery.operators.knn import top_k

    return top_k(left, k, dist=dist)
