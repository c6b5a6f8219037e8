"""Approximate nearest neighbours by cosine, over balanced posting lists.

Centroids are fitted on a bounded sample and split until no list is much larger than the mean.  Their number
grows as the table does up to ``TOP`` lists of ``LIST_ROWS`` rows, then as ``GROWTH`` times the square root of
its rows: beyond ``TOP`` the sample is dealt to the first centroids and each part of it is clustered by a task
of its own.  Centroids are held in memory as a graph: each is tied to its nearest others and a few far ones,
and a beam walks it to the lists nearest to a vector.  A vector near several centroids is put in the lists of
all whose distance is within ``COPY_RATIO`` of the nearest (``COPIES`` at most, the further ones only ever add
recall).  A query reads the lists within ``PROBE_RATIO`` of its nearest, and further ones, nearest first, until
those read hold k rows besides its own; a query whose walk ends before that is compared with every vector.

Equal vectors cannot crowd a list: they score alike, so of a vector only the k + 1 smallest ids can be an answer
(one may be the query's own), and the rows beyond them are told apart from these before the lists are filled.
Equal queries are asked once.  Long lists are cut into chunks that are scored apart.  Scores are computed in
double precision on the original vectors.

Defined results: null vectors, vectors with null or non-finite entries, zero vectors, vectors of another
length than most (of two lengths as frequent, the longer counts), and rows without an id take no part; rows
that repeat an id with the same vector are one; of rows with one id and several vectors the best score counts;
fewer than k candidates give as many as there are; equal scores go to the smaller id; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm.runtime import hashed_sample, table, thinned

#: Vectors of the first sample; vectors a list has in the second; rows of a list; lists of the first level; growth beyond.
SAMPLE, PER_LIST, LIST_ROWS, TOP, GROWTH = 20_000, 20, 128, 1024, 8
COPIES, COPY_RATIO, PROBE_RATIO, BEAM = 4, 1.15, 1.5, 128
CHUNK, PART = 4096, 1 << 14
NEAR, FAR = 16, 4
#: Cells (rows by lists) of a walk's memory of where it was; queries compared with every vector at once.
SEEN, EXACT = 1 << 25, 2048
_FOUND = "h1 long, h2 long, vec_id long, score double"
_RESULT = "query_id long, rank int, vec_id long, score double"


def unit(x: np.ndarray) -> np.ndarray:
    largest = np.abs(x).max(1, keepdims=True)  # entries near the ends of the double range stay finite
    x = x / np.where(largest > 0, largest, 1)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def rows_of(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    step = max(1, (1 << 24) // max(1, len(c)))
    return np.concatenate([(x[i : i + step] @ c.T).argmax(1) for i in range(0, len(x), step)]) if len(x) else np.zeros(0, np.int64)


def _mean_directions(x: np.ndarray, at: np.ndarray, c: np.ndarray) -> np.ndarray:
    new = np.zeros_like(c)
    np.add.at(new, at, x)
    size = np.sqrt((new * new).sum(1, keepdims=True))
    return np.where(size > 1e-12, new / np.maximum(size, 1e-12), c)


def balanced_centroids(x: np.ndarray, lists: int, seed: int = 3) -> np.ndarray:
    """About ``lists`` unit centroids; a list of over twice the mean size is split while its vectors differ."""
    r = np.random.default_rng(seed)
    c = x[r.choice(len(x), min(lists, len(x)), replace=False)].copy()
    for _ in range(8):
        c = _mean_directions(x, _nearest(x, c), c)
    for _ in range(6):
        at = _nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        halves = []
        for big in np.flatnonzero(n > max(8, 2 * len(x) / len(c))):
            own = x[at == big]
            pair = own[[int(own[:, 0].argmin()), int(own[:, 0].argmax())]]
            if np.allclose(pair[0], pair[1]):
                continue
            for _ in range(4):
                pair = _mean_directions(own, (own @ pair.T).argmax(1), pair)
            c[big] = pair[0]
            halves.append(pair[1])
        if not halves:
            break
        c = np.concatenate([c, halves])
    return c


def near_ties(c: np.ndarray, start: int, end: int) -> np.ndarray:
    """The NEAR centroids nearest to each of some."""
    s = c[start:end] @ c.T
    s[np.arange(end - start), np.arange(start, end)] = -np.inf
    n = min(NEAR, len(c) - 1)
    at = np.argpartition(-s, n - 1, axis=1)[:, :n] if n > 0 else np.zeros((end - start, 0), np.int64)
    return np.take_along_axis(at, np.argsort(-np.take_along_axis(s, at, 1), axis=1), 1).astype(np.int32)


@dataclass
class CentroidGraph:
    centroids: np.ndarray
    ties: np.ndarray

    @classmethod
    def of(cls, centroids: np.ndarray, near: np.ndarray | None = None, seed: int = 5) -> CentroidGraph:
        n = len(centroids)
        near = near_ties(centroids, 0, n) if near is None else near
        ring = [((np.arange(n) + s) % n)[:, None] for s in (1, max(1, n // 2))]  # no part is cut off
        far = np.random.default_rng(seed).integers(0, n, (n, FAR))
        return cls(centroids.astype(np.float32), np.concatenate([near, far, *ring], 1).astype(np.int32))

    def walk(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(lists, distances), nearest first, of up to ``beam`` centroids for every unit vector of x."""
        beam, step = min(beam, len(self.centroids)), max(1, SEEN // len(self.centroids))
        found = [self._walk(x[i : i + step].astype(np.float32), beam) for i in range(0, len(x), step)]
        return tuple(np.concatenate(f) for f in zip(*found)) if found else (np.zeros((0, beam), np.int64), np.zeros((0, beam)))

    def _walk(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        n, total = len(x), len(self.centroids)
        seen = np.zeros((n, total), bool)
        start = np.unique(np.linspace(0, total - 1, min(total, max(beam, 8))).astype(np.int64))
        seen[:, start] = True
        at = np.broadcast_to(start, (n, len(start)))
        at, d, done = self._best(at, self._distance(x, at), np.zeros(at.shape, bool), beam)
        rows = np.arange(n)
        while len(rows):
            ahead = np.where(done[rows], np.inf, d[rows])
            best = ahead.argmin(1)
            going = np.isfinite(ahead[np.arange(len(rows)), best])
            rows, best = rows[going], best[going]
            if not len(rows):
                break
            done[rows, best] = True
            to = self.ties[at[rows, best]].astype(np.int64)
            new = ~seen[rows[:, None], to]
            seen[rows[:, None], to] = True
            far = np.where(new & self._first(to), self._distance(x[rows], to), np.inf)
            at[rows], d[rows], done[rows] = self._best(np.concatenate([at[rows], to], 1), np.concatenate([d[rows], far], 1), np.concatenate([done[rows], ~np.isfinite(far)], 1), beam)
        return at, d

    @staticmethod
    def _first(to: np.ndarray) -> np.ndarray:
        """Whether an entry is the first of its row with that value."""
        order = np.argsort(to, axis=1, kind="stable")
        held = np.take_along_axis(to, order, 1)
        new = np.ones(to.shape, bool)
        new[:, 1:] = held[:, 1:] != held[:, :-1]
        out = np.empty(to.shape, bool)
        np.put_along_axis(out, order, new, 1)
        return out

    @staticmethod
    def _best(at: np.ndarray, d: np.ndarray, done: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(d, axis=1, kind="stable")[:, :beam]
        out = [np.take_along_axis(a, order, 1) for a in (at, d, done)]
        if (short := beam - order.shape[1]) > 0:
            out = [np.pad(a, ((0, 0), (0, short)), constant_values=v) for a, v in zip(out, (0, np.inf, True))]
        return tuple(out)

    def _distance(self, x: np.ndarray, to: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * np.einsum("nd,nkd->nk", x, self.centroids[to]).astype(np.float64), 0))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of the rows that take part."""
    v = F.col("embedding")
    fine = F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)
    fine &= F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    good = vectors.where(fine).select("vec_id", v.cast("array<double>").alias("embedding"))
    most = good.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return good.where(F.size("embedding") == (most.n if most else 0))


def list_count(total: int) -> int:
    return max(1, min(total // LIST_ROWS, max(TOP, int(GROWTH * total**0.5))))


def fit(vectors: DataFrame, total: int) -> CentroidGraph:
    spark, lists = vectors.sparkSession, list_count(total)
    x = unit(rows_of(hashed_sample(vectors, SAMPLE, "vec_id").toArrow()["embedding"]))
    first = balanced_centroids(x, min(lists, TOP))
    if lists <= TOP:
        return CentroidGraph.of(first)
    graph = spark.sparkContext.broadcast(CentroidGraph.of(first))
    sample = thinned(vectors, PER_LIST * lists, total, "vec_id").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    dealt = table(sample.mapInArrow(_places(graph, 2 * COPIES, 1.0, 1), "list int, id long, vector array<double>"), "sample")
    n = dealt.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts"))
    parted = dealt.join(n, "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts")
    found = parted.groupBy("list", "part").applyInArrow(_split, "centroid array<float>").distinct()
    c = unit(rows_of(found.toArrow()["centroid"]))  # about ``lists`` rows
    c = c[np.lexsort(c.T[::-1])]
    return CentroidGraph.of(c, _ties(spark, c))


def _split(rows: pa.Table) -> pa.Table:
    x = unit(rows_of(rows["vector"]))
    c = balanced_centroids(x, max(1, len(x) // PER_LIST)).astype(np.float32)
    return pa.table({"centroid": pa.array(list(c), pa.list_(pa.float32()))})


def _ties(spark: SparkSession, c: np.ndarray) -> np.ndarray:
    """Nearest centroids of each, in blocks that tasks work on."""
    shared, step = spark.sparkContext.broadcast(c.astype(np.float32)), max(1, (1 << 24) // len(c))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                found = near_ties(shared.value, i * step, min(len(shared.value), (i + 1) * step))
                yield pa.record_batch([pa.array([i], pa.int64()), pa.array([found.tobytes()], pa.binary())], ["i", "ties"])

    blocks = -(-len(c) // step)
    found = spark.range(0, blocks, 1, min(blocks, 1024)).mapInArrow(run, "i long, ties binary").toArrow().sort_by("i")
    return np.concatenate([np.frombuffer(t, np.int32) for t in found["ties"].to_pylist()]).reshape(len(c), -1)


def _places(graph, beam: int, ratio: float, most: int, rows=None, k: int = 0):
    """Rows of (id, vector), or of queries (h1, h2, vector), repeated for the lists they belong to or read.

    With ``rows`` (the rows of which a list is the nearest), lists are read on until k rows are held.
    """

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 2048):
                part = batch.slice(s, 2048)
                at, d = graph.value.walk(unit(rows_of(part.column(part.num_columns - 1))), beam)
                keep = d <= np.maximum(d[:, :1] * ratio, 1e-6)
                keep[:, most:] = False
                if rows is not None:
                    held = np.cumsum(rows.value[at] * np.isfinite(d), axis=1)
                    keep |= (held - rows.value[at]) < k
                keep &= np.isfinite(d)
                row, nth = np.nonzero(keep)
                out = [pa.array(at[row, nth].astype(np.int32)), pa.array((nth == 0))] if rows is None and most > 1 else [pa.array(at[row, nth].astype(np.int32))]
                names = ["list", "home"][: len(out)] + part.schema.names
                yield pa.record_batch([*out, *(c.take(pa.array(row)) for c in part.columns)], names)

    return run


def total(x: np.ndarray) -> np.ndarray:
    """Sums of rows, entry by entry from the first, so that a score is the same wherever and however it is computed."""
    return np.cumsum(x, axis=1)[:, -1]


def scored(q: np.ndarray, x: np.ndarray, vid: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, scores) of the k nearest of x to each row of q; equal scores by the smaller id."""
    q, x = (np.ldexp(v, -np.frexp(np.abs(v).max(1))[1][:, None]) for v in (q, x))  # powers of two: exact, and no square overflows
    qn, xn = np.sqrt(total(q * q)), np.sqrt(total(x * x))
    for s in range(0, len(q), 256):
        rough = (q[s : s + 256] @ x.T) / (qn[s : s + 256, None] * xn)
        edge = np.partition(rough, -k, axis=1)[:, -k] if len(x) > k else np.full(len(rough), -2.0)
        for i in range(len(rough)):
            at = np.flatnonzero(rough[i] >= edge[i] - 1e-9)
            exact = total(q[s + i] * x[at]) / (qn[s + i] * xn[at])
            best = np.lexsort((vid[at], -exact))[:k]
            yield s + i, vid[at[best]], exact[best]


def _score(k: int):
    def run(key, asked: pa.Table, held: pa.Table) -> pa.Table:
        h1, h2, ids, scores = [], [], [], []
        if asked.num_rows and held.num_rows:
            a, b = asked["h1"].to_numpy(), asked["h2"].to_numpy()
            for i, vid, score in scored(rows_of(asked["vector"]), rows_of(held["vector"]), held["id"].to_numpy(), k):
                h1.append(np.full(len(vid), a[i]))
                h2.append(np.full(len(vid), b[i]))
                ids.append(vid)
                scores.append(score)
        flat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return pa.table({"h1": flat(h1, np.int64), "h2": flat(h2, np.int64), "vec_id": flat(ids, np.int64), "score": flat(scores, np.float64)})

    return run


def _score_all(shared, k: int):
    """The k nearest of a task's vectors to each of some queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, q = shared.value
        best = [(np.zeros(0, np.int64), np.zeros(0)) for _ in a]
        for batch in batches:
            if batch.num_rows:
                for i, vid, score in scored(q, rows_of(batch.column("embedding")), batch.column("vec_id").to_numpy(), k):
                    vid, score = np.concatenate([best[i][0], vid]), np.concatenate([best[i][1], score])
                    order = np.lexsort((vid, -score))[:k]
                    best[i] = vid[order], score[order]
        n = [len(v) for v, _ in best]
        flat = lambda j, kind: np.concatenate([x[j] for x in best]) if best else np.zeros(0, kind)
        yield pa.record_batch([pa.array(np.repeat(a, n)), pa.array(np.repeat(b, n)), pa.array(flat(0, np.int64)), pa.array(flat(1, float))], ["h1", "h2", "vec_id", "score"])

    return run


def _best(found: DataFrame, k: int, *by: str) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", nth).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id ``every`` divides, its k nearest other rows found."""
    spark = vectors.sparkSession
    marked = usable(vectors).withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(17), "embedding")})
    # repeated rows are merged, and k + 1 rows of a vector kept, by every task before the exchange: copies do not meet
    single = marked.groupBy("h1", "h2", "vec_id").agg(F.first("embedding").alias("embedding"))
    nth = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))
    kept = table(single.withColumn("nth", nth).where(F.col("nth") <= k + 1).drop("nth"), "vectors")
    good = kept.select("vec_id", "embedding")
    total = good.count()
    if not total:
        return spark.createDataFrame([], _RESULT)
    graph = spark.sparkContext.broadcast(fit(good, total))
    lists = len(graph.value.centroids)
    postings = table(good.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")).mapInArrow(_places(graph, 4 * COPIES, COPY_RATIO, COPIES), "list int, home boolean, id long, vector array<double>"), "postings")
    sizes = table(postings.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"), F.sum(F.col("home").cast("long")).alias("n")), "sizes")
    rows = np.zeros(lists, np.int64)
    for r in sizes.select("list", "n").collect():  # one row a list, as the centroids
        rows[r.list] = r.n
    home = spark.sparkContext.broadcast(rows)
    queries = marked.where(F.col("vec_id") % every == 0).select("h1", "h2", F.col("vec_id").alias("query_id")).distinct()
    once = table(marked.where(F.col("vec_id") % every == 0).groupBy("h1", "h2").agg(F.first("embedding").alias("vector")), "queries")
    asked = once.mapInArrow(_places(graph, BEAM, PROBE_RATIO, BEAM, home, k + 1), "list int, h1 long, h2 long, vector array<double>")
    asked = asked.join(sizes.select("list", "chunks"), "list").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    held = postings.select("list", "id", "vector").join(sizes.select("list", "chunks"), "list").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).drop("chunks")
    read = asked.groupBy("list", "chunk").cogroup(held.groupBy("list", "chunk")).applyInArrow(_score(k + 1), _FOUND)
    found = table(_best(read.groupBy("h1", "h2", "vec_id").agg(F.max("score").alias("score")), k + 1, "h1", "h2").drop("rank"), "found")
    for extra in _short(once, found, good, min(k + 1, total)):
        found = found.unionByName(extra)
    answers = queries.join(found, ["h1", "h2"]).where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return _best(answers, k, "query_id").select("query_id", "rank", "vec_id", "score")


def _short(once: DataFrame, found: DataFrame, good: DataFrame, least: int) -> Iterator[DataFrame]:
    """Answers to the queries that hold fewer than ``least`` rows, from every vector, a bounded block of queries at a time."""
    enough = found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    short = table(once.join(enough, ["h1", "h2"], "left_anti"), "short")
    blocks = -(-short.count() // EXACT)
    numbered = short.withColumn("block", F.pmod(F.xxhash64("h1", "h2", F.lit(3)), F.lit(max(1, blocks))))
    for i in range(blocks):
        rows = numbered.where(F.col("block") == i).toArrow()
        if rows.num_rows:
            shared = once.sparkSession.sparkContext.broadcast((rows["h1"].to_numpy(), rows["h2"].to_numpy(), rows_of(rows["vector"])))
            part = good.mapInArrow(_score_all(shared, least), _FOUND)
            yield table(_best(part.dropDuplicates(["h1", "h2", "vec_id", "score"]), least, "h1", "h2").drop("rank"), "exact")
