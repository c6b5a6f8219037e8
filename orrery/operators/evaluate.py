"""Evaluation against exact answers: recall, distance ratio, throughput and re-rank counts."""

from __future__ import annotations

import resource
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.knn import exact_knn_join


def ground_truth(base: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """qid, gt: the ids of the k nearest rows, ascending."""
    found = exact_knn_join(base, queries, k)
    return found.groupBy("qid").agg(F.array_sort(F.collect_list("vec_id")).alias("gt"))


def long_form(truth: DataFrame) -> DataFrame:
    return truth.select("qid", F.explode("gt").alias("vec_id"))


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """qid, hits, recall: the share of each query's true rows that were found; both have qid, vec_id."""
    want = truth.select("qid", "vec_id").distinct()
    hits = want.join(found.select("qid", "vec_id").distinct().withColumn("hit", F.lit(1)), ["qid", "vec_id"], "left")
    return hits.groupBy("qid").agg(F.count("hit").alias("hits"), (F.count("hit") / F.count(F.lit(1))).alias("recall"))


def mean_recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    return recall(found, truth).agg(F.count(F.lit(1)).alias("queries"), F.avg("recall").alias("recall"))


def distance_ratio(found: DataFrame, truth: DataFrame) -> DataFrame:
    """qid, ratio: mean of sqrt(found / true distance) rank by rank, without true distances up to 1e-5."""
    pairs = found.select("qid", "rank", F.col("dist").alias("d")).join(truth.select("qid", "rank", F.col("dist").alias("g")), ["qid", "rank"])
    return pairs.where(F.col("g") > 1e-5).groupBy("qid").agg(F.avg(F.sqrt(F.col("d") / F.col("g"))).alias("ratio"))


def usage(spark: SparkSession) -> dict[str, float]:
    """Seconds that tasks ran so far on all executors, user CPU of the driver's Python, and its and the driver JVM's memory in MB."""
    executors = spark._jsc.sc().statusStore().executorList(False)
    own, vm = resource.getrusage(resource.RUSAGE_SELF), spark._jvm.java.lang.Runtime.getRuntime()
    return {
        "task_s": sum(executors.apply(i).totalDuration() for i in range(executors.size())) / 1000.0, "driver_cpu_s": own.ru_utime,
        "driver_peak_mb": own.ru_maxrss / 1024.0, "driver_jvm_mb": (vm.totalMemory() - vm.freeMemory()) / 2.0**20,
    }


def timed(name: str, run: Callable[[], DataFrame], truth: DataFrame, n_queries: int, counts: DataFrame | None = None, **parameters: int) -> DataFrame:
    """One metrics row of a search: parameters, recall, microseconds a query, queries a second, CPU, memory and re-rank count.

    ``counts`` (qid, class, n) tells what the search did with its rows; without it the re-rank count is null.
    """
    spark = truth.sparkSession
    before, began = usage(spark), time.perf_counter()
    found = run().persist()
    found.count()
    took, after = time.perf_counter() - began, usage(spark)
    spent = {c: after[c] - before[c] if c.endswith("_s") else after[c] for c in after}
    verified = counts.where(F.col("class") == "verify").agg(F.sum("n")).first()[0] or 0 if counts is not None else None
    row = mean_recall(found, truth).select(
        F.lit(name).alias("method"), *[F.lit(v).alias(p) for p, v in parameters.items()], "recall",
        F.lit(took / max(1, n_queries) * 1e6).alias("us_per_query"), F.lit(n_queries / took).alias("qps"),
        F.lit(None if verified is None else verified / max(1, n_queries)).cast("double").alias("avg_rerank"), *[F.lit(float(v)).alias(c) for c, v in spent.items()],
    )
    out = spark.createDataFrame(row.collect(), row.schema)
    found.unpersist()
    return out


def sweep(found: DataFrame, truth: DataFrame) -> DataFrame:
    """nprobe, recall of a result that has the answers for several nprobe (as ``scan.flat_search`` gives)."""
    want = truth.select("qid", "vec_id").distinct()
    queries = want.select("qid").distinct().count()
    sizes = want.groupBy("qid").agg(F.count(F.lit(1)).alias("total"))
    hits = found.join(want, ["qid", "vec_id"], "left_semi").groupBy("nprobe", "qid").agg(F.countDistinct("vec_id").alias("hits"))
    share = hits.join(sizes, "qid").groupBy("nprobe").agg((F.sum(F.col("hits") / F.col("total")) / max(1, queries)).alias("recall"))
    return found.select("nprobe").distinct().join(share, "nprobe", "left").select("nprobe", F.coalesce("recall", F.lit(0.0)).alias("recall"))
