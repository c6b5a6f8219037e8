"""One-bit sign codes: rotation of residuals, codes with their factors, distance estimates with bounds.

For a residual r = (x - c) P of B entries the code holds the signs of r.  With d = |x - c| and the alignment
x0 = sum|r_i| / (sqrt(B) |r|), a query's estimate needs only the code, four factors of the row and the
query's quantised residual; the error bound scales with sqrt(1/x0**2 - 1).  Bounds hold with the chance that
``epsilon`` standard deviations give, not always.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import vector as V
from orrery.operators import arrays

#: Alignment of a row on its centroid, where the quotient has no value.
DEGENERATE_X0 = 0.8


def random_rotation(dim: int, seed: int = 0) -> np.ndarray:
    """A random orthogonal matrix: the Q factor of a Gaussian one."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def random_dither(dim: int, seed: int = 0) -> np.ndarray:
    """A dither for each entry, uniform in [0, 1): quantisation without bias; the same one each time for a seed."""
    return np.random.default_rng(seed).random(dim)


def rotation_columns(matrix: np.ndarray) -> Column:
    """A rotation for right multiplication (v P) as a constant expression."""
    return V.matrix_literal(np.asarray(matrix).T)


def rotate_rows(df: DataFrame, column: str, columns: Column, out: str, dim: int) -> DataFrame:
    return df.withColumn(out, V.rotate(V.pad(F.col(column), dim), columns))


def build(assigned: DataFrame, centroids: DataFrame, columns: Column, dim: int, epsilon: float = 1.9) -> DataFrame:
    """vec_id, cluster_id, code, x0, d_c and the factors sqr_x, error, factor_ip, factor_ppc of every row.

    ``assigned`` has vec_id, embedding, cluster_id; ``centroids`` has cluster_id, centroid (a small table).
    """
    b = float(dim)
    r = (
        assigned.select("vec_id", "embedding", "cluster_id").join(centroids.select("cluster_id", "centroid"), "cluster_id")
        .withColumn("r", V.rotate(V.pad(V.residual(F.col("embedding"), F.col("centroid")), dim), columns))
        .select("vec_id", "cluster_id", V.sign_words(F.col("r")).alias("code"), V.norm(F.col("r")).alias("d_c"), V.total(F.transform("r", F.abs)).alias("l1"))
    )
    xx0 = F.col("d_c") / F.col("x0")
    return (
        r.withColumn("x0", F.when(F.col("d_c") > 0, F.col("l1") / (F.lit(b**0.5) * F.col("d_c"))).otherwise(F.lit(DEGENERATE_X0)))
        .withColumn("sqr_x", F.col("d_c") * F.col("d_c"))
        .withColumn("error", 2 * epsilon / (b - 1) ** 0.5 * F.sqrt(F.greatest(xx0 * xx0 - F.col("sqr_x"), F.lit(0.0))))
        .withColumn("factor_ip", -2 * xx0 / b**0.5)
        .withColumn("factor_ppc", F.col("factor_ip") * (2 * V.popcount(F.col("code")) - dim))
        .drop("l1")
    )


INDEX = "cluster_id int, vec_id long, embedding array<float>, code array<long>, x0 double, d_c double, sqr_x double, error double, factor_ip double, factor_ppc double"


def index(assigned: DataFrame, centroids: DataFrame, rotation: np.ndarray, epsilon: float = 1.9) -> DataFrame:
    """What ``build`` gives, with the vectors, from one pass of matrix products: the rows that searches scan."""
    cids, c = arrays.collect_centroids(centroids)
    shared = assigned.sparkSession.sparkContext.broadcast((cids, c, np.asarray(rotation, float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, centres, turn = shared.value
        b = float(len(turn))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = arrays.matrix(batch["embedding"])
            r = np.zeros((len(x), len(turn)))
            r[:, : x.shape[1]] = x - centres[np.searchsorted(ids, batch["cluster_id"].to_numpy())]
            r = r @ turn
            bits = r > 0
            words = np.packbits(bits, axis=1).view(">i8").astype(np.int64)
            d_c = np.sqrt((r * r).sum(1))
            x0 = np.divide(np.abs(r).sum(1), b**0.5 * d_c, out=np.full(len(r), DEGENERATE_X0), where=d_c > 0)
            xx0, sqr_x = d_c / x0, d_c * d_c
            ip = -2 * xx0 / b**0.5
            code = pa.ListArray.from_arrays(pa.array(np.arange(len(r) + 1, dtype=np.int32) * words.shape[1]), pa.array(words.reshape(-1)))
            columns = [code, *map(pa.array, (x0, d_c, sqr_x, 2 * epsilon / (b - 1) ** 0.5 * np.sqrt(np.maximum(xx0 * xx0 - sqr_x, 0)), ip, ip * (2 * bits.sum(1) - b)))]
            yield pa.record_batch([batch["cluster_id"], batch["vec_id"], batch["embedding"].cast(pa.list_(pa.float32())), *columns], [f.split()[0] for f in INDEX.split(", ")])

    return assigned.select("cluster_id", "vec_id", "embedding").mapInArrow(run, INDEX)


def quantize_queries(queries: DataFrame, probes: DataFrame, centroids: DataFrame, columns: Column, dim: int, bits: int = 4, dither: float = 0.5) -> DataFrame:
    """probes with the prepared query of each list: sqr_y, low, width, qcode and sum_q."""
    t = (
        probes.select("qid", "rank", "cluster_id").join(queries.select("qid", "q"), "qid").join(centroids, "cluster_id")
        .withColumn("t", V.rotate(V.pad(V.residual(F.col("q"), F.col("centroid")), dim), columns))
        .select("qid", "rank", "cluster_id", "t", V.sqr_norm(F.col("t")).alias("sqr_y"), F.array_min("t").alias("low"))
        .withColumn("width", (F.array_max("t") - F.col("low")) / (2**bits - 1))
        .withColumn("qcode", V.quantize(F.col("t"), F.col("low"), F.col("width"), dither)).drop("t")
    )
    return t.withColumn("sum_q", F.aggregate("qcode", F.lit(0), lambda acc, x: acc + x))


def code_dot(qcode: Column, code: Column) -> Column:
    """Dot product of small integers and the bits of a code."""
    return F.aggregate(
        F.transform(qcode, lambda x, i: x * F.call_function("shiftright", F.element_at(code, (i / 64).cast("int") + 1), 63 - i % 64).bitwiseAND(F.lit(1).cast("long"))),
        F.lit(0).cast("long"), lambda acc, x: acc + x,
    )


def estimates(codes: DataFrame, prepared: DataFrame) -> DataFrame:
    """qid, vec_id, est, lb, ub for every row of every probed list."""
    pairs = prepared.join(codes, "cluster_id").withColumn("ip", code_dot(F.col("qcode"), F.col("code")))
    est = F.col("sqr_x") + F.col("sqr_y") + F.col("factor_ppc") * F.col("low") + (2 * F.col("ip") - F.col("sum_q")) * F.col("factor_ip") * F.col("width")
    bound = F.col("error") * F.sqrt("sqr_y")
    return pairs.select("qid", "rank", "cluster_id", "vec_id", est.alias("est"), bound.alias("bound")).select(
        "qid", "rank", "cluster_id", "vec_id", "est", (F.col("est") - F.col("bound")).alias("lb"), (F.col("est") + F.col("bound")).alias("ub")
    )
