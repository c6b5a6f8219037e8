"""Training of centroids, rotations and codebooks on bounded samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import arrays, ivf


def lloyd(x: np.ndarray, k: int, rounds: int = 25, seed: int = 42) -> np.ndarray:
    """k-means centres in numpy; an empty one moves to the point that is worst served."""
    r = np.random.default_rng(seed)
    c = x[r.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        d = (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)
        at = d.argmin(1)
        n = np.bincount(at, minlength=len(c))
        new = np.zeros_like(c)
        np.add.at(new, at, x)
        full = n > 0
        new[full] /= n[full, None]
        if not full.all():
            new[~full] = x[np.argsort(-d.min(1))[: (~full).sum()]]
        if np.allclose(new, c):
            break
        c = new
    return c


def train_centroids(base: DataFrame, clusters: int, seed: int = 42, max_iter: int = 20) -> DataFrame:
    """cluster_id, centroid by distributed k-means over all rows of base (embedding)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = base.select(array_to_vector("embedding").alias("features")).persist()  # read once, not in every round
    model = KMeans(k=clusters, seed=seed, maxIter=max_iter).fit(rows)
    rows.unpersist()
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return base.sparkSession.createDataFrame(rows, "cluster_id int, centroid array<double>")


def _sample(residuals: DataFrame, column: str, n: int) -> np.ndarray:
    return arrays.matrix(ivf.sample_rows(residuals, n).select(column).toArrow()[column])


def train_codebook(residuals: DataFrame, column: str = "r", words: int = 16, sub_dim: int = 4, sample: int = 20_000, seed: int = 42) -> np.ndarray:
    """(M, words, sub_dim) codewords: k-means of every sub-vector over a sample of at most ``sample`` rows."""
    return codebook_of(_sample(residuals, column, sample), words, sub_dim, seed=seed)


def codebook_of(x: np.ndarray, words: int = 16, sub_dim: int = 4, rounds: int = 15, seed: int = 42) -> np.ndarray:
    if x.shape[1] % sub_dim:
        raise ValueError("dimension must be a multiple of the sub-vector length")
    parts = x.reshape(len(x), -1, sub_dim)
    return np.stack([_padded(lloyd(parts[:, m], words, rounds, seed), words) for m in range(parts.shape[1])])


def _padded(c: np.ndarray, words: int) -> np.ndarray:
    return np.concatenate([c, np.repeat(c[-1:], words - len(c), 0)]) if len(c) < words else c


def decode(codes: np.ndarray, book: np.ndarray) -> np.ndarray:
    return book[np.arange(book.shape[0])[None, :], codes].reshape(len(codes), -1)


def encode_rows(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    parts = x.reshape(len(x), book.shape[0], -1)
    return ((parts[:, :, None, :] - book[None]) ** 2).sum(3).argmin(2)


def train_rotation(residuals: DataFrame, column: str = "r", rounds: int = 10, words: int = 16, sub_dim: int = 4, sample: int = 20_000, seed: int = 42) -> np.ndarray:
    """An orthogonal R for right multiplication that lowers product-code error: codebook and Procrustes steps in turn."""
    x = _sample(residuals, column, sample)
    r = np.eye(x.shape[1])
    for i in range(rounds):
        y = x @ r
        book = codebook_of(y, words, sub_dim, rounds=5, seed=seed + i)
        u, _, vt = np.linalg.svd(x.T @ decode(encode_rows(y, book), book))
        r = u @ vt
    return r


def save_model(rows: np.ndarray, spark, path: str) -> None:
    """A matrix as a table (i, row)."""
    spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(np.asarray(rows))], "i int, row array<double>").write.mode("overwrite").parquet(path)


def load_model(spark, path: str) -> np.ndarray:
    return arrays.matrix(spark.read.parquet(path).select("i", "row").toArrow().sort_by("i")["row"])


def unit_check(matrix: np.ndarray) -> float:
    """Largest deviation of a rotation from orthogonality."""
    return float(np.abs(matrix @ matrix.T - np.eye(len(matrix))).max())


def residuals_of(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    from orrery.functions import vector as V

    return assigned.join(centroids, "cluster_id").select("vec_id", "cluster_id", V.residual(F.col("embedding"), F.col("centroid")).alias("r"))
