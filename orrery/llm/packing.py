"""Best-fit decreasing packing of tokenised documents into sequences.

Lengths are integers up to the sequence length, so the whole input is known to the packer as one count per
length.  Best-fit decreasing runs over those counts on the driver: a segment tree over remaining
capacities finds the tightest capacity that still takes a piece in logarithmic time, and all pieces of one
length that fit the same bins are placed at once.  Its result, the plan, says for the r-th piece of a
length which bin and offset it gets; its size depends on the sequence length, not on the input.  Executors
number the pieces of each length (per-partition counts, then their prefix sums) and look the plan up.

Defined results: null and empty texts are the one id 1; only a document longer than a sequence is cut, and a text of any
length is tokenised whole; of bins with the same tightest capacity the one opened or left first is taken, and pieces of one
length take their places by partition and position in it; repeated rows are packed one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm import textblocks as tb
from orrery.llm.runtime import arrow_limits, table

END_ID = 1
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, pid int, nth long"
#: Distinct words whose ids a Python worker keeps; beyond it the cache starts again.
CACHE_WORDS = 1 << 20


class OpenBins:
    """Segment tree over capacities 0..top: counts bins, finds the smallest capacity of at least x that has one."""

    def __init__(self, top: int):
        self.size = 1 << top.bit_length()
        self.any = bytearray(2 * self.size)
        self.held: dict[int, deque[tuple[int, int]]] = {}

    def put(self, capacity: int, start: int, n: int) -> None:
        self.held.setdefault(capacity, deque()).append((start, n))
        i = self.size + capacity
        while i and not self.any[i]:
            self.any[i] = 1
            i >>= 1

    def tightest(self, least: int) -> int | None:
        i = self.size + least
        if self.any[i]:
            return least
        while i > 1:
            if not i & 1 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None

    def take(self, capacity: int, most: int) -> tuple[int, int]:
        """(first bin, number) of one run of bins, at most so many."""
        runs = self.held[capacity]
        start, n = runs.popleft()
        if n > most:
            runs.appendleft((start + most, n - most))
            n = most
        if not runs:
            i = self.size + capacity
            self.any[i] = 0
            i >>= 1
            while i and not (self.any[2 * i] or self.any[2 * i + 1]):
                self.any[i] = 0
                i >>= 1
        return start, n


def best_fit_plan(counts: dict[int, int], limit: int) -> np.ndarray:
    """Rows (length, first rank, first bin, offset, pieces a bin) sorted by length and rank.

    The r-th piece of a length, from the row with the last first rank <= r, goes to bin
    ``first bin + (r - first rank) // a``, at ``offset + (r - first rank) % a * length``.
    """
    bins, rows, opened = OpenBins(limit), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            capacity = bins.tightest(length)
            each = (capacity if capacity is not None else limit) // length
            wanted = -(-left // each)
            if capacity is None:
                capacity, start, n = limit, opened, wanted
                opened += n
            else:
                start, n = bins.take(capacity, wanted)
            placed = min(left, n * each)
            rows.append((length, rank, start, limit - capacity, each))
            full, rest = divmod(placed, each)
            if full and capacity - each * length:
                bins.put(capacity - each * length, start, full)
            if rest:
                bins.put(capacity - rest * length, start + full, 1)
            rank, left = rank + placed, left - placed
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


class WordIds:
    """Ids of whole words, each encoded once; the tokenizer drops white space, so a text's ids are its words' ids."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.clear()

    def clear(self) -> None:
        self.keys, self.checks, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def learn(self, keys: np.ndarray, checks: np.ndarray, texts: list[str]) -> None:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids = [x.ids for x in found]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(n.sum()))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        at = self.used + np.cumsum(n) - n
        self.used += len(flat)
        held = [np.concatenate(x) for x in ((self.keys, keys), (self.checks, checks), (self.at, at), (self.n, n))]
        order = np.lexsort((held[1], held[0]))
        self.keys, self.checks, self.at, self.n = (x[order] for x in held)

    def find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Places of pairs of hashes, -1 where not learned."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at, last = np.searchsorted(self.keys, keys), len(self.keys) - 1
        same = lambda i: (self.keys[np.minimum(i, last)] == keys) & (i <= last)
        found = same(at) & (self.checks[np.minimum(at, last)] == checks)
        while (more := ~found & same(at + 1)).any():  # words that share a 64-bit hash lie side by side
            at = at + more
            found |= same(at) & (self.checks[np.minimum(at, last)] == checks)
        return np.where(found, at, -1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids with END_ID after each text, offsets of texts)."""
        b = tb.words(texts)
        if len(self.keys) > CACHE_WORDS:
            self.clear()
        first, inverse, _ = tb.distinct(b.h, b.check)
        at = self.find(b.h[first], b.check[first])
        new = at < 0
        if new.any():
            raw = b.data.tobytes()
            w = first[new]
            self.learn(b.h[w], b.check[w], [raw[s:e].decode("utf-8", "replace") for s, e in zip(b.start[w].tolist(), b.end[w].tolist())])
            at = self.find(b.h[first], b.check[first])
        begin, n = (self.at[at][inverse], self.n[at][inverse]) if len(first) else (np.zeros(0, np.int64),) * 2
        total = np.cumsum(n)
        size = tb.per_text(b, n) + 1
        off = np.concatenate([[0], np.cumsum(size)])
        out = np.full(off[-1], END_ID, np.uint32)
        if len(n):
            before = total - n
            flat = np.arange(total[-1])
            out[flat + np.repeat(b.doc, n)] = self.pool[flat + np.repeat(begin - before, n)]
        return out, off


_held: dict[int, WordIds] = {}


def worker_ids(tokenizer_json: str) -> WordIds:
    """This Python worker's word ids, kept from task to task."""
    key = hash(tokenizer_json)
    if key not in _held:
        _held[key] = WordIds(tokenizer_json)
    return _held[key]


def pieces(docs: DataFrame, tokenizer_json: str, limit: int = 4096) -> DataFrame:
    """The pieces of all documents, with their partition and their number there among those as long."""
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = worker_ids(shared.value)
        pid, seen = TaskContext.get().partitionId(), np.zeros(limit + 1, np.int64)
        for batch in (x for whole in batches for x in tb.blocks(whole)):
            ids, off = mine.encode(batch["text"])
            size = np.diff(off)
            n = -(-size // limit)
            doc = np.repeat(np.arange(len(size)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * limit
            length = np.minimum(limit, size[doc] - start)
            raw, at = memoryview(ids.view(np.uint8)), 4 * (off[doc] + start)
            crc = np.fromiter((zlib.crc32(raw[a:z]) for a, z in zip(at.tolist(), (at + 4 * length).tolist())), np.int64, len(doc))
            order = np.argsort(length, kind="stable")
            by = length[order]
            nth = np.empty(len(doc), np.int64)
            nth[order] = np.arange(len(doc)) - np.searchsorted(by, by) + seen[by]
            np.add.at(seen, length, 1)
            yield pa.record_batch([
                batch["doc_id"].take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()), pa.array(np.full(len(doc), pid), pa.int32()), pa.array(nth, pa.int64()),
            ], ["doc_id", "piece", "start", "length", "ids_crc32", "pid", "nth"])

    arrow_limits(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer_json: str, limit: int = 4096) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    cut = table(pieces(docs, tokenizer_json, limit), "pieces")
    by_part = cut.groupBy("pid", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {int(r[0]): int(r[1]) for r in by_part.groupBy("length").agg(F.sum("n")).collect()}  # limit rows at most
    plan = spark.sparkContext.broadcast(best_fit_plan(counts, limit))
    before = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("pid", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(base, ["pid", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))

    @F.arrow_udf("struct<sequence_id:long,offset:long>")
    def look_up(length: pa.Array, rank: pa.Array) -> pa.Array:
        rows = plan.value
        size, r = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        if not len(r):
            return pa.StructArray.from_arrays([pa.array([], pa.int64())] * 2, names=["sequence_id", "offset"])
        shift = int(max(rows[:, 1].max(), r.max())) + 1
        row = rows[np.searchsorted(rows[:, 0] * shift + rows[:, 1], size * shift + r, "right") - 1]
        nth = r - row[:, 1]
        return pa.StructArray.from_arrays([pa.array(row[:, 2] + nth // row[:, 4]), pa.array(row[:, 3] + nth % row[:, 4] * size)], names=["sequence_id", "offset"])

    placed = ranked.withColumn("_at", look_up("length", "rank"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset"))
