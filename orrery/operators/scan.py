"""Searches as scans: blocks of queries are broadcast, index rows never leave the task that reads them.

A block holds as many queries as ``Block`` bounds allow, with the lists each probes.  A pass maps over the rows of the
probed lists (partition pruned where the index is partitioned by list), scores them in Arrow batches with matrix
products, and gives back per task what is bounded by the queries: histograms, or the k best of each.  Passes of one
search read the index again instead of shuffling scored pairs or vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.config import SearchParams
from orrery.operators import arrays
from orrery.operators.arrays import Best
from orrery.operators.knn import FOUND, top_k


@dataclass
class Block:
    """qids (sorted) and their vectors; centroid ids and centroids; ranks[i, j]: rank from 1 of list j for query i, 0 if not probed."""

    qids: np.ndarray
    q: np.ndarray
    cids: np.ndarray
    centroids: np.ndarray
    ranks: np.ndarray

    @classmethod
    def of(cls, part: DataFrame, centroids: tuple[np.ndarray, np.ndarray], nprobe: int | None) -> Block:
        qids, q = arrays.collect_vectors(part, "qid", "q")
        cids, c = centroids
        n = min(nprobe or len(cids), len(cids))
        ranks = np.zeros((len(qids), len(cids)), np.int32)
        for i, row in enumerate(arrays.sqr_l2(q, c) if len(q) else ()):
            ranks[i, arrays.smallest(row, cids, n)] = np.arange(1, n + 1)
        return cls(qids, q, cids, c, ranks)

    def parts(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
        """(list, queries that probe it, its rows) of a batch."""
        cluster = batch["cluster_id"].to_numpy()
        order = np.argsort(cluster, kind="stable")
        lists, first = np.unique(cluster[order], return_index=True)
        for c, rows in zip(lists.tolist(), np.split(order, first[1:])):
            j = int(np.searchsorted(self.cids, c))
            if j < len(self.cids) and self.cids[j] == c and len(who := np.flatnonzero(self.ranks[:, j])):
                yield j, who, batch if len(lists) == 1 else batch.take(pa.array(rows))

    @property
    def probed(self) -> list[int]:
        return self.cids[(self.ranks > 0).any(0)].tolist()


def blocks(queries: DataFrame, centroids: DataFrame, nprobe: int | None, k: int) -> Iterator[tuple[Block, Broadcast]]:
    held = arrays.collect_centroids(centroids)
    for part in arrays.query_parts(queries, most=max(1, arrays.HELD // max(k, len(held[0])))):
        block = Block.of(part, held, nprobe)
        yield block, queries.sparkSession.sparkContext.broadcast(block)


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def probed_rows(index: DataFrame, block: Block, *columns: str) -> DataFrame:
    return index.where(F.col("cluster_id").isin(block.probed)).select("cluster_id", *columns)


# --- exact distances --------------------------------------------------------------------------------------------------


def flat_search(index: DataFrame, queries: DataFrame, centroids: DataFrame, nprobes: list[int], k: int) -> DataFrame:
    """nprobe, qid, rank, vec_id, dist: exact distances inside the probed lists, for several nprobe from one scan."""

    def scan(block: Block, shared: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            b = shared.value
            best = {n: Best(len(b.qids), k) for n in nprobes}
            for batch in batches:
                for j, who, rows in b.parts(batch):
                    vec, d = rows["vec_id"].to_numpy(), arrays.sqr_l2(b.q[who], arrays.matrix(rows["embedding"]))
                    for n in nprobes:
                        for i in np.flatnonzero(b.ranks[who, j] <= n):
                            best[n].give(who[i], d[i], vec)
            for n in nprobes:
                i, d, vec = best[n].rows()
                yield pa.record_batch([pa.array(np.full(len(i), n, np.int32)), pa.array(b.qids[i]), pa.array(vec), pa.array(d)], ["nprobe", "qid", "vec_id", "dist"])

        return probed_rows(index, block, "vec_id", "embedding").mapInArrow(run, "nprobe int, " + FOUND)

    found = union([scan(*x) for x in blocks(queries, centroids, max(nprobes), k * len(nprobes))])
    return top_k(found, k, key=("nprobe", "qid")).select("nprobe", "qid", "rank", "vec_id", "dist")


# --- estimators -------------------------------------------------------------------------------------------------------


class SignEstimator:
    """Distances from one-bit codes (columns code and factors), with bounds; see :mod:`orrery.operators.signcode`."""

    columns = ("code", "sqr_x", "error", "factor_ip", "factor_ppc")

    def __init__(self, rotation: np.ndarray, bits: int = 4, dither: float | np.ndarray = 0.5):
        self.rotation, self.levels, self.dither = np.asarray(rotation, float), 2**bits - 1, dither

    def prepare(self, q: np.ndarray, centroid: np.ndarray) -> tuple[np.ndarray, ...]:
        t = np.zeros((len(q), len(self.rotation)))
        t[:, : q.shape[1]] = q - centroid
        t = t @ self.rotation
        low = t.min(1, keepdims=True)
        width = (t.max(1, keepdims=True) - low) / self.levels
        code = np.floor(np.divide(t - low, width, out=np.zeros_like(t), where=width > 0) + self.dither * (width > 0))
        return (t * t).sum(1)[:, None], low, width, code, code.sum(1)[:, None]

    def bounds(self, state: tuple[np.ndarray, ...], rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """(estimates, half widths of the bounds) of all queries and rows."""
        sqr_y, low, width, code, total = state
        words = rows["code"].flatten().to_numpy().reshape(rows.num_rows, -1)
        bits = np.unpackbits(np.ascontiguousarray(words.astype(">i8")).view(np.uint8), axis=1)
        sqr_x, error, ip_by, ppc_by = (rows[c].to_numpy() for c in self.columns[1:])
        ip = code @ bits.T.astype(float)
        return sqr_x + sqr_y + ppc_by * low + (2 * ip - total) * ip_by * width, error * np.sqrt(sqr_y)


class PqEstimator:
    """Distances from product codes (column pq) by table look-up; without bounds."""

    columns = ("pq",)

    def __init__(self, book: np.ndarray, rotation: np.ndarray | None = None):
        self.book, self.rotation = np.asarray(book, float), rotation

    def prepare(self, q: np.ndarray, centroid: np.ndarray) -> np.ndarray:
        r = q - centroid
        r = r if self.rotation is None else r @ self.rotation
        pieces, words, size = self.book.shape
        d = r.reshape(len(r), pieces, 1, size) - self.book[None]
        return np.einsum("qmjs,qmjs->qmj", d, d)

    def bounds(self, table: np.ndarray, rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        code = rows["pq"].flatten().to_numpy().reshape(rows.num_rows, -1)
        est = np.zeros((len(table), len(code)))
        for m in range(code.shape[1]):
            est += table[:, m, code[:, m]]
        return est, np.zeros_like(est)


def _estimates(b: Block, estimator, batches: Iterator[pa.RecordBatch], lists: int | None = None):
    """(queries, rows, estimates, half widths) list by list; with ``lists``, only of the first so many of a query."""
    states: dict[int, object] = {}
    for batch in batches:
        for j, who, rows in b.parts(batch):
            if j not in states:
                states[j] = estimator.prepare(b.q[who], b.centroids[j])
            est, half = estimator.bounds(states[j], rows)
            if lists is not None:
                own = b.ranks[who, j] <= lists
                who, est, half = who[own], est[own], half[own]
            if len(who):
                yield who, rows, est, half


# --- the collector ----------------------------------------------------------------------------------------------------


@dataclass
class Books:
    """Of every query: the smallest sampled distance, the width of a logical bucket, the physical bucket of each logical one,
    the threshold, the first physical bucket that no result is in, and the first bucket that must be verified."""

    low: np.ndarray
    delta: np.ndarray
    codes: np.ndarray
    physical: int
    th: np.ndarray | None = None
    safe: np.ndarray | None = None

    def code(self, who: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Physical buckets of distances of queries ``who``; beyond the range the last."""
        last, delta = self.codes.shape[1] - 1, self.delta[who][:, None]
        at = np.floor(np.divide(d - self.low[who][:, None], delta, out=np.zeros_like(d), where=delta > 0))
        return np.take_along_axis(self.codes[who], np.clip(at, 0, last).astype(np.int64), 1)


def sampled_lists(nprobe: int, share: float = 0.01) -> int:
    return max(1, int(share * nprobe))


def code_books(index: DataFrame, block: Block, shared: Broadcast, estimator, k: int, lists: int, p: SearchParams) -> Books:
    """Ranges from the k smallest estimates of each query in its first lists; logical buckets merged to equal depth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        best = Best(len(b.qids), k)
        for who, rows, est, _ in _estimates(b, estimator, batches, lists):
            vec = rows["vec_id"].to_numpy()
            for i, d in zip(who, est):
                best.give(i, d, vec)
        i, d, vec = best.rows()
        yield pa.record_batch([pa.array(i), pa.array(vec), pa.array(d)], ["i", "vec_id", "est"])

    def book(rows: pa.Table) -> pa.Table:
        d = rows["est"].to_numpy()
        d = d[arrays.smallest(d, rows["vec_id"].to_numpy(), k)]
        low, delta = d[0], (d[-1] + 1e-5 - d[0]) / p.logical
        n = np.bincount(np.clip(np.floor((d - low) / delta), 0, p.logical - 1).astype(np.int64), minlength=p.logical)
        codes = np.minimum((np.cumsum(n) - n) * p.physical // len(d), p.physical - 1)
        return pa.table({"i": rows["i"][:1], "low": [low], "delta": [delta], "codes": pa.array([codes], pa.list_(pa.int64()))})

    first = block.cids[((block.ranks > 0) & (block.ranks <= lists)).any(0)].tolist()
    sample = index.where(F.col("cluster_id").isin(first)).select("cluster_id", "vec_id", *estimator.columns).mapInArrow(run, "i long, vec_id long, est double")
    held = sample.groupBy("i").applyInArrow(book, "i long, low double, delta double, codes array<long>").toArrow()  # one row a query
    n = len(block.qids)
    out = Books(np.zeros(n), np.zeros(n), np.full((n, p.logical), p.physical - 1, np.int64), p.physical)  # nothing sampled: one bucket
    at = held["i"].to_numpy()
    out.low[at], out.delta[at] = held["low"].to_numpy(), held["delta"].to_numpy()
    if len(at):
        out.codes[at] = held["codes"].combine_chunks().flatten().to_numpy().reshape(len(at), -1)
    return out


def depths(index: DataFrame, block: Block, shared: Broadcast, books: Broadcast, estimator) -> np.ndarray:
    """n[i, l, u]: rows of query i whose lower end lies in physical bucket l and whose upper end lies in u."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, book = shared.value, books.value
        p = book.physical
        n = np.zeros(len(b.qids) * p * p, np.int64)
        for who, _, est, half in _estimates(b, estimator, batches):
            cell = (who[:, None] * p + book.code(who, est - half)) * p + book.code(who, est + half)
            found, times = np.unique(cell, return_counts=True)
            n[found] += times
        cell = np.flatnonzero(n)
        yield pa.record_batch([pa.array(cell), pa.array(n[cell])], ["cell", "n"])

    p = books.value.physical
    counts = probed_rows(index, block, *estimator.columns).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(block.qids) * p * p, np.int64)
    out[counts["cell"].to_numpy()] = counts["n"].to_numpy()
    return out.reshape(-1, p, p)


def threshold(n: np.ndarray, k: int) -> np.ndarray:
    """The bucket after the one in which the running count reaches k; all buckets where it never does."""
    reached = np.cumsum(n, axis=1) >= k
    return np.where(reached.any(1), reached.argmax(1) + 1, n.shape[1])


def safe_bucket(n: np.ndarray, th: np.ndarray) -> np.ndarray:
    """The first bucket that a row reaches down to which also reaches the threshold bucket: rows that end below are certain."""
    lower, upper = np.arange(n.shape[1])[:, None], np.arange(n.shape[1])[None, :]
    open_ = (n > 0) & (upper >= th[:, None, None] - 1) & (lower < th[:, None, None])
    return np.minimum(np.where(open_.any(2), lower[:, 0], n.shape[1]).min(1, initial=n.shape[1]), th - 1)


def _collector(index: DataFrame, queries: DataFrame, centroids: DataFrame, estimator, p: SearchParams, k: int):
    """(block, its broadcast, depths, books with thresholds) of each block, from a pass over the sampled lists and one over all probed."""
    for block, shared in blocks(queries, centroids, p.nprobe, max(k, 16 * p.physical**2)):
        books = code_books(index, block, shared, estimator, k, sampled_lists(p.nprobe), p)
        n = depths(index, block, shared, queries.sparkSession.sparkContext.broadcast(books), estimator)
        books.th = threshold(n.sum(1), k)
        books.safe = safe_bucket(n, books.th)
        yield block, shared, n, books


CLASSES = ("drop", "accept", "verify")


def classes(lower: np.ndarray, upper: np.ndarray, th: np.ndarray, safe: np.ndarray) -> np.ndarray:
    """0: cannot be a result; 1: certain, no exact distance needed; 2: to be measured."""
    return np.where(lower >= th[:, None], 0, np.where(upper < safe[:, None], 1, 2))


def collector_counts(index: DataFrame, queries: DataFrame, centroids: DataFrame, estimator: SignEstimator, p: SearchParams) -> DataFrame:
    """qid, class, n: what the collector does with the rows of each query; those verified are its re-rank count."""
    found = []
    codes = np.arange(p.physical)
    for block, _, n, books in _collector(index, queries, centroids, estimator, p, p.k):
        of = classes(np.repeat(codes, p.physical)[None], np.tile(codes, p.physical)[None], books.th, books.safe)
        for c, name in enumerate(CLASSES):
            rows = (n.reshape(len(n), -1) * (of == c)).sum(1)
            found += [(int(q), name, int(x)) for q, x in zip(block.qids, rows) if x]
    return queries.sparkSession.createDataFrame(found, "qid long, class string, n long")


def collector_search(index: DataFrame, queries: DataFrame, centroids: DataFrame, estimator: SignEstimator, p: SearchParams) -> DataFrame:
    """qid, rank, vec_id, dist, exact: the k nearest by the bucket collector.

    Rows are upper (they end below the threshold), lower (they begin below it) or dropped.  Buckets are peeled from the
    threshold down: every bucket that a row reaches which may still go either way is verified by exact distances; rows that
    end below the last of those are accepted unverified, with their lower bound, and come first.
    """

    def scan(block: Block, shared: Broadcast, books: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            b, book = shared.value, books.value
            certain, best = Best(len(b.qids), p.k), Best(len(b.qids), p.k)
            for who, rows, est, half in _estimates(b, estimator, batches):
                vec, x = rows["vec_id"].to_numpy(), None
                found = classes(book.code(who, est - half), book.code(who, est + half), book.th[who], book.safe[who])
                for i, row in enumerate(found):
                    if len(at := np.flatnonzero(row == 1)):
                        certain.give(who[i], (est - half)[i, at], vec[at])
                    if len(at := np.flatnonzero(row == 2)):
                        x = arrays.matrix(rows["embedding"]) if x is None else x
                        best.give(who[i], arrays.sqr_l2(b.q[who[i]][None], x[at])[0], vec[at])
            for exact, held in ((False, certain), (True, best)):
                i, d, vec = held.rows()
                yield pa.record_batch([pa.array(b.qids[i]), pa.array(vec), pa.array(d), pa.array(np.full(len(i), exact))], ["qid", "vec_id", "dist", "exact"])

        return probed_rows(index, block, "vec_id", "embedding", *estimator.columns).mapInArrow(run, FOUND + ", exact boolean")

    send = queries.sparkSession.sparkContext.broadcast
    found = union([scan(block, shared, send(books)) for block, shared, _, books in _collector(index, queries, centroids, estimator, p, p.k)])
    return top_k(found, p.k, dist=("exact", "dist")).select("qid", "rank", "vec_id", "dist", "exact")


def _kth(rows: DataFrame, block: Block, k: int) -> np.ndarray:
    """The k-th smallest value of each query over all tasks; infinite where there are fewer."""
    held = top_k(rows, k, dist="v", key="i").where(F.col("rank") == k).select("i", "v").toArrow()
    out = np.full(len(block.qids), np.inf)
    out[held["i"].to_numpy()] = held["v"].to_numpy()
    return out


def bound_search(index: DataFrame, queries: DataFrame, centroids: DataFrame, estimator: SignEstimator, p: SearchParams) -> DataFrame:
    """qid, rank, vec_id, dist: exact distances of the rows whose lower bound does not exceed the k-th smallest upper bound."""

    def scan(block: Block, shared: Broadcast) -> DataFrame:
        def uppers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(len(shared.value.qids), p.k)
            for who, rows, est, half in _estimates(shared.value, estimator, batches):
                vec = rows["vec_id"].to_numpy()
                for i, d in zip(who, est + half):
                    best.give(i, d, vec)
            i, d, vec = best.rows()
            yield pa.record_batch([pa.array(i), pa.array(vec), pa.array(d)], ["i", "vec_id", "v"])

        limit = _kth(probed_rows(index, block, "vec_id", *estimator.columns).mapInArrow(uppers, "i long, vec_id long, v double"), block, p.k)

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            b = shared.value
            best = Best(len(b.qids), p.k)
            for who, rows, est, half in _estimates(b, estimator, batches):
                vec, x = rows["vec_id"].to_numpy(), None
                for i, lower in zip(who, est - half):
                    if len(at := np.flatnonzero(lower <= limit[i])):
                        x = arrays.matrix(rows["embedding"]) if x is None else x
                        best.give(i, arrays.sqr_l2(b.q[i][None], x[at])[0], vec[at])
            i, d, vec = best.rows()
            yield pa.record_batch([pa.array(b.qids[i]), pa.array(vec), pa.array(d)], ["qid", "vec_id", "dist"])

        return probed_rows(index, block, "vec_id", "embedding", *estimator.columns).mapInArrow(nearest, FOUND)

    found = union([scan(*x) for x in blocks(queries, centroids, p.nprobe, p.k)])
    return top_k(found, p.k).select("qid", "rank", "vec_id", "dist")


def _best_estimates(index: DataFrame, block: Block, shared: Broadcast, books: Broadcast | None, estimator: PqEstimator, p: SearchParams) -> DataFrame:
    """qid, vec_id, est, dist of each task's ``num_cand`` smallest estimates below the threshold, measured in the same pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b, book = shared.value, books.value if books is not None else None
        best = Best(len(b.qids), p.num_cand, extra=1)
        for who, rows, est, _ in _estimates(b, estimator, batches):
            near = est <= np.array([best.limit(i) for i in who])[:, None]
            if book is not None:
                near &= book.code(who, est) < book.th[who][:, None]
            if near.any():
                vec, x = rows["vec_id"].to_numpy(), arrays.matrix(rows["embedding"])
                for i, row, at in zip(who, est, map(np.flatnonzero, near)):
                    if len(at):
                        best.give(i, row[at], vec[at], arrays.sqr_l2(b.q[i][None], x[at])[0])
        i, est, vec, d = best.rows()
        yield pa.record_batch([pa.array(b.qids[i]), pa.array(vec), pa.array(est), pa.array(d)], ["qid", "vec_id", "est", "dist"])

    return probed_rows(index, block, "vec_id", "embedding", *estimator.columns).mapInArrow(run, "qid long, vec_id long, est double, dist double")


def pq_search(index: DataFrame, queries: DataFrame, centroids: DataFrame, estimator: PqEstimator, p: SearchParams, collector: bool = False) -> DataFrame:
    """qid, rank, vec_id, dist: of the ``num_cand`` smallest estimates of a query the k nearest by exact distance.

    With ``collector`` the bucket threshold is found first, so that a task only holds and measures rows below it.
    """
    if collector:
        send = queries.sparkSession.sparkContext.broadcast
        found = _collector(index, queries, centroids, estimator, p, p.num_cand)
        parts = [_best_estimates(index, block, shared, send(books), estimator, p) for block, shared, _, books in found]
    else:
        parts = [_best_estimates(index, block, shared, None, estimator, p) for block, shared in blocks(queries, centroids, p.nprobe, p.num_cand)]
    best = top_k(union(parts), p.num_cand, dist="est").drop("rank", "est")
    return top_k(best, p.k).select("qid", "rank", "vec_id", "dist")
