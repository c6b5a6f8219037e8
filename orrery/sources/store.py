"""Index tables on disk: lists partitioned by cluster, small model tables beside them, and the metrics log."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.operators.ivf import by_list
from orrery.sources.vecs import file_system

#: Tables of an index, by name; ``codes`` and ``vectors`` are partitioned by list, so probes prune folders.
LISTED = ("codes", "vectors")


def save_index(path: str, codes: DataFrame, vectors: DataFrame, models: dict[str, DataFrame]) -> None:
    """Writes codes and vectors (both with cluster_id) clustered by list, and each model table."""
    for name, df in zip(LISTED, (codes, vectors)):
        by_list(df).sortWithinPartitions("cluster_id", "vec_id").write.mode("overwrite").partitionBy("cluster_id").parquet(f"{path}/{name}")
    for name, df in models.items():
        if name in LISTED:
            raise ValueError(f"{name} is a table of the index itself")
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_index(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in (*LISTED, *names)}


def probed(table: DataFrame, probes: DataFrame) -> DataFrame:
    """Rows of probed lists only: a join on the partition column, which prunes folders at run time."""
    return table.join(probes.select("cluster_id").distinct(), "cluster_id", "left_semi")


def append_metrics(path: str, metrics: DataFrame) -> None:
    metrics.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(path)


def write_rotation_bin(path: str, codebooks: np.ndarray, rotation: np.ndarray) -> None:
    """int32 dim, M, bits; codebooks (M, 2**bits, dim / M) and rotation (dim, dim) as float32."""
    m, words, sub = codebooks.shape
    system, inner = file_system(path)
    with system.open_output_stream(inner) as f:
        f.write(struct.pack("<3i", m * sub, m, int(words).bit_length() - 1))
        f.write(np.ascontiguousarray(codebooks, np.float32).tobytes() + np.ascontiguousarray(rotation, np.float32).tobytes())


def read_rotation_bin(path: str) -> tuple[np.ndarray, np.ndarray]:
    system, inner = file_system(path)
    with system.open_input_stream(inner) as f:
        dim, m, bits = struct.unpack("<3i", f.read(12))
        flat = np.frombuffer(f.read(), np.float32)
    if len(flat) != dim * (1 << bits) + dim * dim:
        raise ValueError(f"{path} does not hold what its header says")
    return flat[: dim << bits].reshape(m, 1 << bits, dim // m), flat[dim << bits :].reshape(dim, dim)
