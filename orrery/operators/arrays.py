"""Numpy views of Arrow vector columns and the distance kernels that the operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.config import BROADCAST_BYTES

#: Results (queries by k) that a task holds at once at most: a part of the queries has no more than that allows.
HELD = 1 << 24


def matrix(column: pa.Array) -> np.ndarray:
    """An ARRAY column as a float64 matrix; raises on null or ragged rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    if column.null_count:
        raise ValueError("null vector")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(column.offsets.to_numpy())
    if (size != size[0]).any():
        raise ValueError("vectors of different lengths")
    return flat.reshape(len(column), -1)


def sqr_l2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b, by differences in blocks (no cancellation)."""
    out = np.empty((len(a), len(b)))
    step = max(1, (1 << 21) // max(1, b.size))
    for i in range(0, len(a), step):
        d = a[i : i + step, None, :] - b[None, :, :]
        out[i : i + step] = np.einsum("ijk,ijk->ij", d, d)
    return out


def smallest(d: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest, ties to the smaller id."""
    if k < len(d):
        edge = np.partition(d, k - 1)[k - 1]
        at = np.flatnonzero(d <= edge)
    else:
        at = np.arange(len(d))
    return at[np.lexsort((ids[at], d[at]))[:k]]


def collect_vectors(df: DataFrame, key: str, column: str) -> tuple[np.ndarray, np.ndarray]:
    """(keys, matrix) of a small table on the driver, sorted by key."""
    rows = df.select(key, column).toArrow().sort_by(key)
    return rows[key].to_numpy(), matrix(rows[column])


def collect_centroids(centroids: DataFrame | tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix) of centroids, small enough to broadcast; what was collected before is taken as it is."""
    ids, c = centroids if isinstance(centroids, tuple) else collect_vectors(centroids, "cluster_id", "centroid")
    if c.nbytes > BROADCAST_BYTES:
        raise ValueError("centroids exceed the broadcast bound; train fewer clusters")
    return ids, c


class Best:
    """The k smallest of what each of n queries was given, ties to the smaller id, with further values of those rows."""

    def __init__(self, n: int, k: int, extra: int = 0):
        self.k, self.held = k, [(np.zeros(0), np.zeros(0, np.int64), *[np.zeros(0)] * extra) for _ in range(n)]
        self.new: list[list[tuple[np.ndarray, ...]]] = [[] for _ in range(n)]
        self.size = [0] * n

    def limit(self, i: int) -> float:
        """Nothing larger is kept any more."""
        d = self.held[i][0]
        return d[-1] if len(d) == self.k else np.inf

    def give(self, i: int, d: np.ndarray, ids: np.ndarray, *extra: np.ndarray) -> None:
        near = d <= self.limit(i)
        if near.any():
            self.new[i].append(tuple(x[near] for x in (d, ids, *extra)))
            self.size[i] += int(near.sum())
            if self.size[i] > max(1024, self.k):
                self._merge(i)

    def _merge(self, i: int) -> None:
        if self.new[i]:
            both = [np.concatenate(x) for x in zip(self.held[i], *self.new[i])]
            at = smallest(both[0], both[1], self.k)
            self.held[i], self.new[i], self.size[i] = tuple(x[at] for x in both), [], 0

    def rows(self) -> tuple[np.ndarray, ...]:
        """(query, value, id, further values) of all."""
        for i in range(len(self.held)):
            self._merge(i)
        n = [len(h[0]) for h in self.held]
        flat = [np.concatenate(x) for x in zip(*self.held)] if self.held else [np.zeros(0), np.zeros(0, np.int64)]
        return np.repeat(np.arange(len(n)), n), *flat


def query_parts(queries: DataFrame, column: str = "q", each: int = BROADCAST_BYTES, most: int | None = None) -> list[DataFrame]:
    """The queries, cut by a hash of qid into parts that each fit a broadcast and hold about ``most`` at most; one part if all do."""
    size = queries.agg(F.count(F.lit(1)), F.max(F.size(column))).first()
    parts = max(1, -(-(size[0] * (size[1] or 1) * 8) // each), -(-size[0] // most) if most else 1)
    return [queries] if parts == 1 else [queries.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == i) for i in range(parts)]
