"""Product codes of 4 bits: encoding, lookup tables, asymmetric distances and two-level search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions import vector as V
from orrery.operators import arrays


def sub_vectors(v: Column, sub_dim: int = 4) -> Column:
    """v cut into pieces of sub_dim entries."""
    count = (F.size(v) / sub_dim).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda m: F.slice(V.double(v), m * sub_dim + 1, sub_dim))


def table_of(v: Column, codebook: Column, sub_dim: int = 4) -> Column:
    """lut[m][j]: squared distance of the m-th piece of v to its j-th codeword."""
    return F.transform(F.arrays_zip(sub_vectors(v, sub_dim).alias("t"), codebook.alias("w")), lambda p: F.transform(p["w"], lambda word: V.sqr_l2(p["t"], word)))


def encode(residuals: DataFrame, column: str, codebook: Column, sub_dim: int = 4) -> DataFrame:
    """``residuals`` with pq: for each piece the number (from 0) of its nearest codeword, the first of equals."""
    lut = table_of(F.col(column), codebook, sub_dim)
    return residuals.withColumn("pq", F.transform(lut, lambda row: (F.array_position(row, F.array_min(row)) - 1).cast("int")))


def float_distance(lut: Column, code: Column) -> Column:
    return V.total(F.zip_with(lut, code, lambda row, c: F.element_at(row, c + 1)))


def quantized_table(lut: Column) -> Column:
    """struct(lut8, low, scale): the table in 0..255, with what restores it."""
    low = F.array_min(F.transform(lut, F.array_min))
    high = F.array_max(F.transform(lut, F.array_max))
    scale = F.when(high > low, 255 / (high - low)).otherwise(F.lit(1.0))
    return F.struct(low.alias("low"), scale.alias("scale"), F.transform(lut, lambda row: F.transform(row, lambda x: F.floor((x - low) * scale).cast("int"))).alias("lut8"))


def quantized_distance(table: Column, code: Column) -> Column:
    total = F.aggregate(F.zip_with(table["lut8"], code, lambda row, c: F.element_at(row, c + 1)), F.lit(0), lambda acc, x: acc + x)
    return total / table["scale"] + F.size(code) * table["low"]


def tables(queries: DataFrame, probes: DataFrame, centroids: DataFrame, codebook: Column, columns: Column | None = None, sub_dim: int = 4) -> DataFrame:
    """probes with lut, the table of the (rotated) query residual of each probed list."""
    r = V.residual(F.col("q"), F.col("centroid"))
    r = V.rotate(r, columns) if columns is not None else r
    both = probes.select("qid", "rank", "cluster_id").join(queries.select("qid", "q"), "qid").join(centroids, "cluster_id")
    return both.withColumn("t", r).select("qid", "rank", "cluster_id", table_of(F.col("t"), codebook, sub_dim).alias("lut"))


def code_lists(assigned: DataFrame, centroids: DataFrame, codebook: Column, columns: Column | None = None, sub_dim: int = 4) -> DataFrame:
    """vec_id, cluster_id, pq of every row."""
    r = V.residual(F.col("embedding"), F.col("centroid"))
    r = V.rotate(r, columns) if columns is not None else r
    both = assigned.select("vec_id", "embedding", "cluster_id").join(centroids, "cluster_id").withColumn("r", r)
    return encode(both, "r", codebook, sub_dim).select("vec_id", "cluster_id", "pq")


def estimates(codes: DataFrame, luts: DataFrame, quantized: bool = False) -> DataFrame:
    """qid, rank, cluster_id, vec_id, est for every row of every probed list."""
    if quantized:
        luts = luts.withColumn("lut", quantized_table(F.col("lut")))
    d = quantized_distance(F.col("lut"), F.col("pq")) if quantized else float_distance(F.col("lut"), F.col("pq"))
    return luts.join(codes, "cluster_id").select("qid", "rank", "cluster_id", "vec_id", d.alias("est"))


def index(assigned: DataFrame, centroids: DataFrame, book: np.ndarray, rotation: np.ndarray | None = None) -> DataFrame:
    """What ``code_lists`` gives, with the vectors, from one pass in numpy: the rows that searches scan."""
    cids, c = arrays.collect_centroids(centroids)
    shared = assigned.sparkSession.sparkContext.broadcast((cids, c, np.asarray(book, float), rotation))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, centres, words, turn = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            r = arrays.matrix(batch["embedding"]) - centres[np.searchsorted(ids, batch["cluster_id"].to_numpy())]
            r = r if turn is None else r @ turn
            pieces, _, size = words.shape
            code = np.empty((len(r), pieces), np.int32)
            for m in range(pieces):
                code[:, m] = arrays.sqr_l2(r[:, m * size : (m + 1) * size], words[m]).argmin(1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(r) + 1, dtype=np.int32) * pieces), pa.array(code.reshape(-1)))
            yield pa.record_batch([batch["cluster_id"], batch["vec_id"], batch["embedding"].cast(pa.list_(pa.float32())), lists], ["cluster_id", "vec_id", "embedding", "pq"])

    return assigned.select("cluster_id", "vec_id", "embedding").mapInArrow(run, "cluster_id int, vec_id long, embedding array<float>, pq array<int>")
