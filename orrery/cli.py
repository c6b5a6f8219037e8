"""Command line: build an index from vector files, search it, log what the search cost.

    python -m orrery.cli index --base base.fvecs --index /path --clusters 4096
    python -m orrery.cli search --index /path --query query.fvecs --truth top10.ivecs --method bucket --nprobe 64 --k 10
"""

from __future__ import annotations

import argparse
import dataclasses
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.config import SearchParams
from orrery.functions import vector as V
from orrery.operators import evaluate, ivf, pq, scan, signcode, training
from orrery.sources import store, vecs

METHODS = ("flat", "bound", "bucket", "pq", "pq-bucket")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="orrery", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    todo = top.add_subparsers(dest="command", required=True)
    index, search = todo.add_parser("index"), todo.add_parser("search")
    index.add_argument("--base", required=True, help="vector file or folder")
    for name in ("--query", "--truth"):
        search.add_argument(name, required=True, help="vector file or folder")
    for sub in (index, search):
        sub.add_argument("--index", required=True, help="folder of the index")
        for f in dataclasses.fields(SearchParams):
            sub.add_argument(f"--{f.name.replace('_', '-')}", dest=f.name, type=type(f.default), default=f.default)
    index.add_argument("--seed", type=int, default=42)
    search.add_argument("--method", choices=METHODS, default="bucket")
    search.add_argument("--log", help="table that the metrics are appended to")
    search.add_argument("--dither-seed", type=int, help="draw the dither of the query codes; one half without it")
    return top


def params(given: argparse.Namespace) -> SearchParams:
    return SearchParams(**{f.name: getattr(given, f.name) for f in dataclasses.fields(SearchParams)})


def build(spark: SparkSession, given: argparse.Namespace) -> None:
    p, base = params(given), vecs.read_vecs(spark, given.base)
    centroids = training.train_centroids(base, p.clusters, seed=given.seed)
    lists = ivf.assign(base, centroids)
    dim = len(centroids.first().centroid)
    turn = signcode.random_rotation(V.code_dim(dim), given.seed)
    book = training.train_codebook(training.residuals_of(lists, centroids), sub_dim=p.sub_dim)
    signs = signcode.index(lists, centroids, turn, p.epsilon)
    codes = signs.join(pq.index(lists, centroids, book).select("vec_id", "pq"), "vec_id")
    store.save_index(given.index, codes.drop("embedding"), codes, {"centroids": centroids})
    training.save_model(turn, spark, f"{given.index}/rotation")
    training.save_model(book.reshape(len(book), -1), spark, f"{given.index}/codebook")


def search(spark: SparkSession, given: argparse.Namespace) -> DataFrame:
    p, held = params(given), store.load_index(spark, given.index, "centroids")
    rows, centroids = held["vectors"], held["centroids"]
    queries = vecs.read_vecs(spark, given.query).select(F.col("vec_id").alias("qid"), V.double(F.col("embedding")).alias("q"))
    truth = vecs.read_vecs(spark, given.truth, column="gt").select(F.col("vec_id").alias("qid"), F.slice("gt", 1, p.k).alias("gt"))
    counts = None
    if given.method in ("bound", "bucket"):
        turn = training.load_model(spark, f"{given.index}/rotation")
        dither = 0.5 if given.dither_seed is None else signcode.random_dither(len(turn), given.dither_seed)
        estimator = scan.SignEstimator(turn, p.query_bits, dither)
        method = scan.bound_search if given.method == "bound" else scan.collector_search
        run = lambda: method(rows, queries, centroids, estimator, p)
        counts = scan.collector_counts(rows, queries, centroids, estimator, p) if given.method == "bucket" else None
    elif given.method == "flat":
        run = lambda: ivf.ivf_flat_search(rows, queries, centroids, p.nprobe, p.k)
    else:
        flat = training.load_model(spark, f"{given.index}/codebook")
        estimator = scan.PqEstimator(flat.reshape(len(flat), -1, p.sub_dim))
        run = lambda: scan.pq_search(rows, queries, centroids, estimator, p, given.method == "pq-bucket")
    metrics = evaluate.timed(given.method, run, evaluate.long_form(truth), queries.count(), counts, nprobe=p.nprobe, k=p.k, num_cand=p.num_cand)
    if given.log:
        store.append_metrics(given.log, metrics)
    return metrics


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    given = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("orrery").getOrCreate()
    if given.command == "index":
        build(spark, given)
    else:
        search(spark, given).show(truncate=False)


if __name__ == "__main__":
    main()
