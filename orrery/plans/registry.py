"""Registered vector queries: base vectors are all rows of ``embeddings``, queries those with vec_id divisible by 50.

Where SQL must give the same rows, the trained parts are stated ones: centroids are the vectors 0 to 15, the
rotation is the Hadamard matrix, codewords are the sub-vectors of vectors 0 to 15, dither is one half.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions import vector as V
from orrery.config import SearchParams
from orrery.operators import arrays, collector, evaluate, ivf, knn, pq, scan, signcode, training
from orrery.plans.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]

CLUSTERS, NPROBE, K, NUM_CAND, DIM = 16, 4, 10, 100, 64
PARAMS = SearchParams(clusters=CLUSTERS, nprobe=NPROBE, k=K, num_cand=NUM_CAND)
HALF = SearchParams(clusters=CLUSTERS, nprobe=CLUSTERS, k=500, num_cand=1000)
LARGE = SearchParams(clusters=CLUSTERS, nprobe=CLUSTERS, k=1000, num_cand=2000)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def base(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding")


def asked(spark: SparkSession, d: str) -> DataFrame:
    return base(spark, d).where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), V.double(F.col("embedding")).alias("q"))


def centres(spark: SparkSession, d: str) -> DataFrame:
    return base(spark, d).where(F.col("vec_id") < CLUSTERS).select(F.col("vec_id").cast("int").alias("cluster_id"), V.double(F.col("embedding")).alias("centroid"))


def held_centres(spark: SparkSession, d: str) -> tuple[np.ndarray, np.ndarray]:
    """The centroids, collected once for all steps of a search."""
    return arrays.collect_centroids(centres(spark, d))


def lists(spark: SparkSession, d: str, c: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    return ivf.assign(base(spark, d), c or centres(spark, d))


def codewords(spark: SparkSession, d: str):
    """Codebook column: word j of piece m is piece m of vector j."""
    rows = centres(spark, d).orderBy("cluster_id").collect()
    words = [[float(x) for x in r.centroid] for r in rows]
    return F.from_json(F.lit(str([[w[4 * m : 4 * m + 4] for w in words] for m in range(DIM // 4)])), "array<array<array<double>>>")


def entries(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """A vector column as rows (keys, i, x)."""
    return df.select(*keys, F.posexplode(column).alias("i", "x")).select(*keys, F.col("i").cast("int"), (F.round("x", 5) + F.lit(0.0)).alias("x"))


# --- vector functions -------------------------------------------------------------------------------------------


@query
def exact_knn_join(spark: SparkSession, d: str) -> DataFrame:
    return knn.exact_knn_join(base(spark, d), asked(spark, d), K).withColumn("dist", F.round("dist", 5))


@query
def exact_knn_single(spark: SparkSession, d: str) -> DataFrame:
    q = base(spark, d).where("vec_id = 0").first().embedding
    return knn.exact_knn_single(base(spark, d), q, 100).withColumn("dist", F.round("dist", 5))


@query
def inf_check(spark: SparkSession, d: str) -> DataFrame:
    return base(spark, d).agg(F.count(F.lit(1)).alias("n"), F.sum(V.has_inf(F.col("embedding")).cast("long")).alias("n_inf"))


@query
def pad_vectors(spark: SparkSession, d: str) -> DataFrame:
    return entries(base(spark, d).select("vec_id", V.pad(F.col("embedding"), 72).alias("v")), "v", "vec_id")


@query
def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("embedding")
    return base(spark, d).select("vec_id", F.round(V.norm(v), 5).alias("norm"), F.round(V.sqr_norm(v), 5).alias("sqr_norm"), F.round(V.dot(v, v), 5).alias("self_dot"))


@query
def normalize_vectors(spark: SparkSession, d: str) -> DataFrame:
    return entries(base(spark, d).select("vec_id", V.normalize(V.scale(F.col("embedding"), 0.5)).alias("v")), "v", "vec_id")


@query
def vector_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("embedding")
    return base(spark, d).select("vec_id", F.round(V.total(V.add(v, F.reverse(v))), 5).alias("sum_reversed"), F.round(V.total(V.scale(v, 4.0)), 5).alias("quarter_sum"))


@query
def residuals(spark: SparkSession, d: str) -> DataFrame:
    return entries(training.residuals_of(lists(spark, d), centres(spark, d)), "r", "vec_id", "cluster_id")


@query
def residual_norms(spark: SparkSession, d: str) -> DataFrame:
    r = training.residuals_of(lists(spark, d), centres(spark, d))
    return r.select("vec_id", "cluster_id", F.round(V.sqr_norm(F.col("r")), 5).alias("sqr_norm"))


@query
def sign_code_words(spark: SparkSession, d: str) -> DataFrame:
    r = training.residuals_of(lists(spark, d), centres(spark, d))
    return r.select("vec_id", F.element_at(V.sign_words(F.col("r")), 1).alias("word0"))


@query
def popcount_codes(spark: SparkSession, d: str) -> DataFrame:
    r = training.residuals_of(lists(spark, d), centres(spark, d))
    return r.select("vec_id", V.popcount(V.sign_words(F.col("r"))).alias("bits"))


@query
def binary_inner_product(spark: SparkSession, d: str) -> DataFrame:
    """Codes of the queries against the codes of the rows of the lists they probe."""
    codes = lists(spark, d).select("cluster_id", "vec_id", V.sign_words(V.double(F.col("embedding"))).alias("b"))
    probes = ivf.coarse_probe(asked(spark, d), centres(spark, d), NPROBE).join(asked(spark, d), "qid").select("qid", "cluster_id", V.sign_words(F.col("q")).alias("a"))
    return probes.join(codes, "cluster_id").select("qid", "vec_id", V.binary_dot(F.col("a"), F.col("b")).alias("ip"))


@query
def byte_binary_inner_product(spark: SparkSession, d: str) -> DataFrame:
    """Quantised queries against codes, bit-serially and as a plain dot product."""
    prepared = quantized(spark, d).withColumn("planes", V.bit_planes(F.col("qcode")))
    pairs = prepared.join(codes(spark, d).select("vec_id", "cluster_id", "code"), "cluster_id")
    return pairs.select("qid", "vec_id", V.byte_binary_dot(F.col("planes"), F.col("code")).alias("ip"), signcode.code_dot(F.col("qcode"), F.col("code")).alias("ip_direct"))


@query
def vector_gather(spark: SparkSession, d: str) -> DataFrame:
    wanted = exact_knn_join(spark, d).select("vec_id")
    return knn.gather(base(spark, d), wanted).select("vec_id", F.round(V.total(V.double(F.col("embedding"))), 5).alias("total"))


# --- lists --------------------------------------------------------------------------------------------------------


@query
def assign_nearest_centroid(spark: SparkSession, d: str) -> DataFrame:
    return lists(spark, d).select("vec_id", "cluster_id", F.round("dist_to_c", 5).alias("dist_to_c"))


@query
def cluster_sizes(spark: SparkSession, d: str) -> DataFrame:
    return ivf.cluster_sizes(lists(spark, d))


@query
def cluster_stats(spark: SparkSession, d: str) -> DataFrame:
    return ivf.cluster_stats(lists(spark, d)).withColumn("mean_size", F.round("mean_size", 5))


@query
def cluster_size_histogram(spark: SparkSession, d: str) -> DataFrame:
    return ivf.size_histogram(lists(spark, d)).select("bin", F.round("low", 5).alias("low"), F.round("high", 5).alias("high"), "lists")


@query
def inverted_lists(spark: SparkSession, d: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy("vec_id")) - 1
    return ivf.inverted_lists(lists(spark, d)).select("cluster_id", place.alias("place"), "vec_id")


@query
def deterministic_sample(spark: SparkSession, d: str) -> DataFrame:
    return ivf.sample_rows(base(spark, d), 200).select("vec_id")


@query
def coarse_probe(spark: SparkSession, d: str) -> DataFrame:
    return ivf.coarse_probe(asked(spark, d), centres(spark, d), NPROBE).withColumn("sqr_y", F.round("sqr_y", 5))


@query
def ivf_flat_search(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d, NPROBE).withColumn("dist", F.round("dist", 5))


@query
def radius_join(spark: SparkSession, d: str) -> DataFrame:
    return knn.radius_join(base(spark, d), asked(spark, d), centres(spark, d), 1.2).withColumn("dist", F.round("dist", 5))


# --- evaluation ---------------------------------------------------------------------------------------------------


@query
def ground_truth_topk(spark: SparkSession, d: str) -> DataFrame:
    truth = evaluate.ground_truth(base(spark, d), asked(spark, d), K)
    return truth.select("qid", F.array_join("gt", ",").alias("gt"))


def _found(spark: SparkSession, d: str, nprobe: int) -> DataFrame:
    c = held_centres(spark, d)
    return ivf.ivf_flat_search(lists(spark, d, c), asked(spark, d), c, nprobe, K)


@query
def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    truth = evaluate.long_form(evaluate.ground_truth(base(spark, d), asked(spark, d), K))
    return evaluate.recall(_found(spark, d, NPROBE), truth).withColumn("recall", F.round("recall", 5))


@query
def mean_recall(spark: SparkSession, d: str) -> DataFrame:
    truth = knn.exact_knn_join(base(spark, d), asked(spark, d), K)
    return evaluate.mean_recall(_found(spark, d, NPROBE), truth).withColumn("recall", F.round("recall", 5))


@query
def distance_ratio(spark: SparkSession, d: str) -> DataFrame:
    truth = knn.exact_knn_join(base(spark, d), asked(spark, d), K)
    return evaluate.distance_ratio(_found(spark, d, NPROBE), truth).withColumn("ratio", F.round("ratio", 5))


@query
def nprobe_sweep_recall(spark: SparkSession, d: str) -> DataFrame:
    truth = knn.exact_knn_join(base(spark, d), asked(spark, d), K)
    c = held_centres(spark, d)
    found = scan.flat_search(lists(spark, d, c), asked(spark, d), c, [1, 2, 4, 8, 16], K)
    return evaluate.sweep(found, truth).withColumn("recall", F.round("recall", 5))


# --- sign codes ---------------------------------------------------------------------------------------------------


def codes(spark: SparkSession, d: str) -> DataFrame:
    return signcode.build(lists(spark, d), centres(spark, d), V.hadamard(DIM), DIM)


def quantized(spark: SparkSession, d: str, nprobe: int = NPROBE) -> DataFrame:
    probes = ivf.coarse_probe(asked(spark, d), centres(spark, d), nprobe)
    return signcode.quantize_queries(asked(spark, d), probes, centres(spark, d), V.hadamard(DIM), DIM)


def scored(spark: SparkSession, d: str) -> DataFrame:
    return signcode.estimates(codes(spark, d), quantized(spark, d))


@query
def rotate_vectors(spark: SparkSession, d: str) -> DataFrame:
    return entries(signcode.rotate_rows(base(spark, d), "embedding", V.hadamard(DIM), "r", DIM), "r", "vec_id")


@query
def signcode_factors(spark: SparkSession, d: str) -> DataFrame:
    names = ("x0", "d_c", "sqr_x", "error", "factor_ip", "factor_ppc")
    return codes(spark, d).select("vec_id", "cluster_id", F.element_at("code", 1).alias("word0"), *[(F.round(n, 5) + F.lit(0.0)).alias(n) for n in names])


@query
def quantized_query(spark: SparkSession, d: str) -> DataFrame:
    return quantized(spark, d).select("qid", "cluster_id", *[F.round(n, 5).alias(n) for n in ("sqr_y", "low", "width")], F.array_join("qcode", ",").alias("qcode"), "sum_q")


@query
def signcode_estimate(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("qid", "vec_id", *[F.round(n, 5).alias(n) for n in ("est", "lb", "ub")])


def hadamard() -> np.ndarray:
    i = np.arange(DIM)
    return np.where(np.bitwise_count(i[:, None] & i) % 2 == 0, 1.0, -1.0) / DIM**0.5


def sign_searched(spark: SparkSession, d: str) -> tuple:
    """Index, queries, centroids and estimator of the searches over sign codes."""
    c = held_centres(spark, d)
    return signcode.index(lists(spark, d, c), c, hadamard()), asked(spark, d), c, scan.SignEstimator(hadamard())


def _bound_search(spark: SparkSession, d: str, p: SearchParams) -> DataFrame:
    found = scan.bound_search(*sign_searched(spark, d), p)
    return found.withColumn("dist", F.round("dist", 5))


@query
def signcode_search(spark: SparkSession, d: str) -> DataFrame:
    return _bound_search(spark, d, PARAMS)


@query
def signcode_search_k1000(spark: SparkSession, d: str) -> DataFrame:
    return _bound_search(spark, d, LARGE)


# --- product codes ------------------------------------------------------------------------------------------------


def pq_codes(spark: SparkSession, d: str) -> DataFrame:
    return pq.code_lists(lists(spark, d), centres(spark, d), codewords(spark, d))


def pq_tables(spark: SparkSession, d: str) -> DataFrame:
    probes = ivf.coarse_probe(asked(spark, d), centres(spark, d), NPROBE)
    return pq.tables(asked(spark, d), probes, centres(spark, d), codewords(spark, d))


def pq_scored(spark: SparkSession, d: str, quantized: bool = False) -> DataFrame:
    return pq.estimates(pq_codes(spark, d), pq_tables(spark, d), quantized)


@query
def pq_lut(spark: SparkSession, d: str) -> DataFrame:
    rows = pq_tables(spark, d).select("qid", "cluster_id", F.posexplode("lut").alias("m", "row"))
    return rows.select("qid", "cluster_id", F.col("m").cast("int"), F.posexplode("row").alias("j", "x")).select("qid", "cluster_id", "m", F.col("j").cast("int"), F.round("x", 5).alias("x"))


@query
def pq_encode(spark: SparkSession, d: str) -> DataFrame:
    return pq_codes(spark, d).select("vec_id", "cluster_id", F.array_join("pq", ",").alias("pq"))


@query
def pq_adc_distance(spark: SparkSession, d: str) -> DataFrame:
    return pq_scored(spark, d).select("qid", "vec_id", F.round("est", 5).alias("est"))


@query
def pq_quantized_distance(spark: SparkSession, d: str) -> DataFrame:
    return pq_scored(spark, d, quantized=True).select("qid", "vec_id", F.round("est", 5).alias("est"))


def _pq_search(spark: SparkSession, d: str, p: SearchParams, collector: bool) -> DataFrame:
    c = held_centres(spark, d)
    book = c[1].reshape(len(c[1]), DIM // 4, 4).transpose(1, 0, 2)
    found = scan.pq_search(pq.index(lists(spark, d, c), c, book), asked(spark, d), c, scan.PqEstimator(book), p, collector)
    return found.withColumn("dist", F.round("dist", 5))


@query
def pq_search(spark: SparkSession, d: str) -> DataFrame:
    return _pq_search(spark, d, PARAMS, False)


# --- collector and re-ranking -------------------------------------------------------------------------------------


def exact_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Exact distances of all rows of probed lists, with the rank of their list."""
    probes = ivf.coarse_probe(asked(spark, d), centres(spark, d), NPROBE)
    pairs = ivf.candidates(lists(spark, d), probes, "embedding").join(asked(spark, d), "qid")
    return pairs.select("qid", "rank", "vec_id", V.sqr_l2(F.col("q"), F.col("embedding")).alias("est"))


def book_and_buckets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pairs = exact_pairs(spark, d)
    book = collector.codebook(pairs, K)
    return book, collector.with_buckets(pairs, book, 256, bucket="est")


@query
def bucket_codebook(spark: SparkSession, d: str) -> DataFrame:
    return collector.codebook(exact_pairs(spark, d), K).select("qid", F.round("low", 5).alias("low"), F.round("delta", 7).alias("delta"))


@query
def bucket_histogram(spark: SparkSession, d: str) -> DataFrame:
    return collector.histogram(book_and_buckets(spark, d)[1])


@query
def bucket_equal_depth(spark: SparkSession, d: str) -> DataFrame:
    return collector.equal_depth(collector.histogram(book_and_buckets(spark, d)[1]), 32)


@query
def bucket_threshold(spark: SparkSession, d: str) -> DataFrame:
    return collector.predicted(collector.histogram(book_and_buckets(spark, d)[1]), K, 0.5, 256)


@query
def bucket_topk(spark: SparkSession, d: str) -> DataFrame:
    pairs = exact_pairs(spark, d).withColumnRenamed("est", "dist").select("qid", "vec_id", "dist")
    return collector.bucket_top_k(pairs, 100).select("qid", "rank", "vec_id", F.round("dist", 5).alias("dist"))


@query
def bound_classify(spark: SparkSession, d: str) -> DataFrame:
    """What the collector drops, accepts and verifies of each query: the last is its re-rank count."""
    return scan.collector_counts(*sign_searched(spark, d), PARAMS)


@query
def bound_classify_k500(spark: SparkSession, d: str) -> DataFrame:
    return scan.collector_counts(*sign_searched(spark, d), HALF)


def _bucket_rerank(spark: SparkSession, d: str, p: SearchParams) -> DataFrame:
    found = scan.collector_search(*sign_searched(spark, d), p)
    return found.select("qid", "rank", "vec_id", F.round("dist", 5).alias("dist"), "exact")


@query
def bucket_rerank(spark: SparkSession, d: str) -> DataFrame:
    return _bucket_rerank(spark, d, PARAMS)


@query
def bucket_rerank_k500(spark: SparkSession, d: str) -> DataFrame:
    return _bucket_rerank(spark, d, HALF)


@query
def bucket_rerank_k1000(spark: SparkSession, d: str) -> DataFrame:
    return _bucket_rerank(spark, d, LARGE)


@query
def pq_bucket_search(spark: SparkSession, d: str) -> DataFrame:
    return _pq_search(spark, d, PARAMS, True)


@query
def pq_bucket_search_k500(spark: SparkSession, d: str) -> DataFrame:
    return _pq_search(spark, d, HALF, True)


# --- training: no SQL, tested by what it must improve -----------------------------------------------------------------


@query
def train_kmeans(spark: SparkSession, d: str) -> DataFrame:
    return training.train_centroids(base(spark, d), CLUSTERS)


@query
def train_product_codebook(spark: SparkSession, d: str) -> DataFrame:
    book = training.train_codebook(training.residuals_of(lists(spark, d), centres(spark, d)))
    rows = [(m, j, [float(x) for x in word]) for m, words in enumerate(book) for j, word in enumerate(words)]
    return spark.createDataFrame(rows, "m int, j int, cw array<double>")


@query
def train_rotation(spark: SparkSession, d: str) -> DataFrame:
    r = training.train_rotation(training.residuals_of(lists(spark, d), centres(spark, d)), rounds=4)
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(r)], "i int, row array<double>")
