"""Language-model scoring by context-tree weighting over binary-decomposed bytes.

A byte is eight binary choices, each in the context of the bits before it and of the last ``DEPTH`` bytes.
Every node of the tree (some last bytes, a bit prefix) holds how often the next bit was 0 and 1 in the
training texts.  A node's probability of its bits is half its own Krichevsky-Trofimov estimate and half the
product over its children, so all depths are mixed; the resulting weights give the next bit's probability
along the path of contexts, and a text's score is the sum of their logarithms.

A node is kept if it was seen ``LEAST`` times, however large the corpus; what the other children of a node saw
is kept in it as one further child.  Tasks send distinct byte strings of DEPTH + 1 bytes with counts to ranges,
where they are summed.  A range holds all strings whose last ``TOP`` + 1 context bytes are the same, hence whole
subtrees below depth TOP, and rebuilds them from the summed strings; those are never collected.  The nodes of
depth TOP or less are summed over the ranges and broadcast: there are 255 for each pair of neighbouring bytes at
most.  Groups of documents ask the ranges for the probabilities of their distinct byte strings.  Unigram counts for the base score
stay distributed as well: the same groups ask hash ranges for the counts of their words.

Word counts are kept by 64-bit hashes of the words (two words in a corpus of 10**9 distinct ones share one with
probability 0.03; their counts would then be added).

Defined results: null and empty texts have the end token alone; texts of any length are read whole; equal texts get equal scores; texts are lower-cased in A-Z; rows with a
null doc_id are scored but not learned from; repeated rows count each time; without training rows every bit
has probability one half; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm import packed as pk
from orrery.llm import textblocks as tb
from orrery.llm.groups import from_blob, packed
from orrery.llm.runtime import arrow_limits, ranges_for, table

DEPTH, PAD, END = 5, 0xFE, 0xFF  # neither byte occurs in UTF-8
LEAST, TOP = 2, 2
GROUP_BYTES, RANGE_BYTES, MOST_RANGES = 4 << 20, 8 << 20, 1 << 20
BLOCK = 1 << 20
PIECE = 1 << 18
WORDS, STRINGS = 0, 1
_U = np.uint64
_END_WORD = _U(0x5D8A4E1F27C3B961)
_MIX, _NEAR = 0x9E3779, 0xFFFFFF
_UNMIX = pow(_MIX, -1, 1 << 24)


def byte_strings(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the last DEPTH bytes and the byte itself as an integer for every byte and end, offsets of texts)."""
    data, off = tb.buffers(texts)
    n, extra = len(off) - 1, DEPTH + 1
    stream = np.full(len(data) + n * extra, PAD, np.uint8)
    owner = np.repeat(np.arange(n), np.diff(off))
    stream[np.arange(len(data)) + owner * extra + DEPTH] = tb.LOWER[data]
    stream[off[1:] + np.arange(n) * extra + DEPTH] = END
    at = np.flatnonzero(stream != PAD)
    wide = stream.astype(np.uint64)
    g = np.zeros(max(0, len(stream) - DEPTH), np.uint64)
    for j in range(extra):
        g |= wide[j : len(g) + j] << _U(8 * (DEPTH - j))
    return g[at - DEPTH], off + np.arange(n + 1)


def placed(strings: np.ndarray) -> np.ndarray:
    """Byte strings as keys that begin with the mixed last TOP + 1 context bytes, so that even ranges hold whole subtrees."""
    near = ((strings >> _U(8)) & _U(_NEAR)) * _U(_MIX) & _U(_NEAR)
    return near << _U(40) | (strings >> _U(32)) << _U(24) | (strings & _U(255)) << _U(16)


def unplaced(keys: np.ndarray) -> np.ndarray:
    near = (keys >> _U(40)) * _U(_UNMIX) & _U(_NEAR)
    return ((keys >> _U(24)) & _U(0xFFFF)) << _U(32) | near << _U(8) | (keys >> _U(16)) & _U(255)


def summed(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, sorted, and the sums of their counts."""
    if not len(keys):
        return keys, *counts
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[first], *(np.add.reduceat(c[order], first) for c in counts)


def nodes_of(strings: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node keys, zeros, ones) of one depth."""
    context = (strings >> _U(8)) & _U((1 << 8 * depth) - 1)
    byte = strings & _U(255)
    keys, bits = [], []
    for b in range(8):
        keys.append(_U(depth << 48) | (context << _U(8)) | ((byte | _U(256)) >> _U(8 - b)))
        bits.append((byte >> _U(7 - b)) & _U(1))
    bit, n = np.concatenate(bits).astype(np.int64), np.tile(counts, 8)
    return summed(np.concatenate(keys), n * (1 - bit), n * bit)


_SMALL = 1 << 12
_LOG_GAMMA = {shift: np.array([math.lgamma(i + shift) for i in range(_SMALL)]) for shift in (0.5, 1.0)}


def _log_gamma(n: np.ndarray, shift: float) -> np.ndarray:
    out = _LOG_GAMMA[shift][np.minimum(n, _SMALL - 1)]
    big = np.flatnonzero(n >= _SMALL)
    x = n[big] + shift
    out[big] = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural logarithm of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _log_gamma(zeros, 0.5) + _log_gamma(ones, 0.5) - _log_gamma(zeros + ones, 1.0) - math.log(math.pi)


def estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return (ones + 0.5) / (zeros + ones + 1.0)


def weigh(zeros: np.ndarray, ones: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weight of a node's own estimate, logarithm of its mixed probability); ``inside``: that of all its children."""
    alone = log_kt(zeros, ones)
    return 1 / (1 + np.exp(np.clip(inside - alone, -700, 700))), np.logaddexp(alone, inside) - math.log(2)


@dataclass
class ContextTree:
    """Sorted node keys; each node's estimate of a one, weight of its own estimate, and estimate of its pruned rest."""

    keys: np.ndarray
    one: np.ndarray
    own: np.ndarray
    rest: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, deeper: tuple[np.ndarray, ...] | None = None) -> ContextTree:
        """``deeper``: zeros, ones and summed log probabilities of the kept children that are held elsewhere."""
        order = np.argsort(keys)
        keys, zeros, ones = keys[order], zeros[order].astype(np.int64), ones[order].astype(np.int64)
        rest0, rest1 = zeros.copy(), ones.copy()
        weighted = log_kt(zeros, ones)
        children = np.zeros(len(keys))
        if deeper is not None:
            rest0, rest1, children = rest0 - deeper[0][order], rest1 - deeper[1][order], deeper[2][order]
        own = np.ones(len(keys))
        depth = (keys >> _U(48)).astype(np.int64)
        for d in range(DEPTH, -1, -1):
            here = np.flatnonzero(depth == d)
            if d < DEPTH:
                inside = children[here] + np.where(rest0[here] + rest1[here] > 0, log_kt(rest0[here], rest1[here]), 0.0)
                own[here], weighted[here] = weigh(zeros[here], ones[here], inside)
            if d:
                parent = _U(d - 1 << 48) | (((keys[here] >> _U(8)) & _U((1 << 8 * (d - 1)) - 1)) << _U(8)) | (keys[here] & _U(255))
                at = np.searchsorted(keys, parent)
                np.add.at(children, at, weighted[here])
                np.subtract.at(rest0, at, zeros[here])
                np.subtract.at(rest1, at, ones[here])
        small = np.float32  # 20 bytes a node
        return cls(keys, estimate(zeros, ones).astype(small), own.astype(small), estimate(rest0, rest1).astype(small))

    def mix(self, strings: np.ndarray, prefix: np.ndarray, p: np.ndarray, below: np.ndarray, deepest: int) -> np.ndarray:
        """Probability of a one after each string's context and the bits ``prefix``; ``p`` is that of deeper nodes where ``below``."""
        for d in range(deepest, -1, -1) if len(self.keys) else ():
            key = _U(d << 48) | (((strings >> _U(8)) & _U((1 << 8 * d) - 1)) << _U(8)) | prefix
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[at] == key
            deeper = np.where(below, p, self.rest[at]) if d < DEPTH else self.one[at]
            own = self.own[at].astype(float)
            p = np.where(found, own * self.one[at] + (1 - own) * deeper, p)
            below = below | found
        return p

    def log10(self, strings: np.ndarray) -> np.ndarray:
        """log10 of the probability of each string's last byte after the bytes before it."""
        out = np.zeros(len(strings))
        byte = strings & _U(255)
        for b in range(8):
            p = self.mix(strings, (byte | _U(256)) >> _U(8 - b), np.full(len(strings), 0.5), np.zeros(len(strings), bool), DEPTH)
            out += log_bit(p, (byte >> _U(7 - b)) & _U(1))
        return out


def log_bit(p: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return np.log10(np.maximum(np.where(bit.astype(bool), p, 1 - p), 1e-12))


class Subtrees:
    """All nodes deeper than TOP for one bit position of some strings, which sort into runs with the same node."""

    def __init__(self, strings: np.ndarray, counts: np.ndarray, b: int):
        byte = strings & _U(255)
        bit = (byte >> _U(7 - b)) & _U(1)
        # last TOP + 1 bytes, bit prefix, then one byte for each further depth
        key = ((strings >> _U(8)) & _U(_NEAR)) << _U(24) | ((byte | _U(256)) >> _U(8 - b)) << _U(16) | ((strings >> _U(32)) & _U(255)) << _U(8) | strings >> _U(40)
        self.order = np.argsort(key, kind="stable")
        key, self.bit = key[self.order], bit[self.order]
        n = counts[self.order]
        ones = n * self.bit.astype(np.int64)
        zeros = n - ones
        self.keys, self.parent, self.zeros, self.ones, self.kept, self.own, self.rest = [], [], [], [], [], [], []
        for d in range(DEPTH, TOP, -1):
            new = np.concatenate([[True], key[1:] != key[:-1]])
            first = np.flatnonzero(new)
            above = lambda x: np.add.reduceat(x, first)  # noqa: B023, E731
            if d == DEPTH:
                zeros, ones = above(zeros), above(ones)
                own, weighted, rest = np.ones(len(first)), log_kt(zeros, ones), None
            else:
                kept = self.kept[-1]
                held0, held1, inside = above(zeros * kept), above(ones * kept), above(weighted * kept)
                zeros, ones = above(zeros), above(ones)
                rest0, rest1 = zeros - held0, ones - held1
                own, weighted = weigh(zeros, ones, inside + np.where(rest0 + rest1 > 0, log_kt(rest0, rest1), 0.0))
                rest = estimate(rest0, rest1)
            self.parent.append(np.cumsum(new) - 1)
            key = key[first]
            for held, x in zip((self.keys, self.zeros, self.ones, self.kept, self.own, self.rest), (key, zeros, ones, zeros + ones >= LEAST, own, rest)):
                held.append(x)
            key = key >> _U(8)
        self.weighted = weighted

    def above(self) -> tuple[np.ndarray, ...]:
        """(key, zeros, ones, zeros, ones and log probability of kept children) of the nodes of depth TOP."""
        zeros, ones, kept = self.zeros[-1], self.ones[-1], self.kept[-1]
        node = _U(TOP << 48) | self.keys[-1] & _U(0xFFFFFF)
        return node, zeros, ones, zeros * kept, ones * kept, self.weighted * kept

    def log10(self, top: ContextTree) -> np.ndarray:
        """log10 of the probability of this bit of each string."""
        p, below = estimate(self.zeros[0], self.ones[0]), self.kept[0]
        up = np.arange(len(p))
        for j in range(1, DEPTH - TOP):
            up = self.parent[j][up]
            own = self.own[j][up]
            p = own * estimate(self.zeros[j], self.ones[j])[up] + (1 - own) * np.where(below, p, self.rest[j][up])
            below = self.kept[j][up]
        key = self.keys[0]
        p = top.mix(key >> _U(24) << _U(8), (key >> _U(16)) & _U(255), np.where(below, p, 0.5), below, TOP)
        out = np.empty(len(self.order))
        out[self.order] = log_bit(p[self.parent[0]], self.bit)
        return out


def pieces(keys: np.ndarray) -> Iterator[slice]:
    """Slices of sorted placed keys that hold whole subtrees, of about PIECE keys."""
    start = 0
    while start < len(keys):
        end = len(keys)
        if start + PIECE < end:  # up to the end of that key's subtree
            end = int(np.searchsorted(keys, keys[start + PIECE] | _U((1 << 40) - 1), side="right"))
        yield slice(start, end)
        start = end


def probabilities(keys: np.ndarray, counts: np.ndarray, top: ContextTree) -> np.ndarray:
    """log10 of the probability of the last byte of sorted placed keys, given with their counts in the training texts."""
    out = np.zeros(len(keys), np.float32)
    for s in pieces(keys):
        strings, n = unplaced(keys[s]), counts[s]
        out[s] = sum(Subtrees(strings, n, b).log10(top) for b in range(8))
    return out


# --- counting --------------------------------------------------------------------------------------------------------


def _count_strings(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush():
            keys, counts = summed(*(np.concatenate(x) for x in zip(*held)))
            held.clear()
            return keys, counts

        def rows(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
            yield from pk.send(TaskContext.get().partitionId(), keys, ranges, counts=counts).to_batches()

        for block in (x for batch in batches for x in tb.blocks(batch)):
            keys, counts = np.unique(placed(byte_strings(block["text"])[0]), return_counts=True)
            held.append((keys, counts.astype(np.int64)))
            if sum(len(k) for k, _ in held) > 1 << 21:
                keys, counts = flush()
                if len(keys) > 1 << 20:
                    yield from rows(keys, counts)
                else:
                    held.append((keys, counts))
        if held:
            yield from rows(*flush())

    return run


NODE = {"node": np.uint64, "zeros": np.int64, "ones": np.int64, "held0": np.int64, "held1": np.int64, "inside": np.float64}


def _sum_strings(rows: pa.Table) -> pa.Table:
    """A range's strings with their counts, and its share of the nodes of depth TOP."""
    keys, counts = summed(pk.keys_of(rows), pk.column_of(rows, "counts", np.int64))
    found = [Subtrees(unplaced(keys[s]), counts[s], b).above() for s in pieces(keys) for b in range(8)]
    nodes = summed(*(np.concatenate(x) for x in zip(*found)))
    row = {"rng": rows["rng"][:1], "keys": pa.array([pk.planes(np.diff(keys, prepend=_U(0)))], pa.binary()), "counts": pa.array([pk.planes(counts)], pa.binary())}
    return pa.table(row | {name: pa.array([pk.planes(x)], pa.binary()) for name, x in zip(NODE, nodes)})


def _node_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            yield pa.record_batch({name: pa.array(pk.unplanes(row[name], kind).astype(np.float64 if name == "inside" else np.int64)) for name, kind in NODE.items()})


def range_count(n_bytes: int) -> int:
    """A power of two, so that no range begins inside a subtree."""
    return min(MOST_RANGES, 1 << (ranges_for(n_bytes, RANGE_BYTES) - 1).bit_length())


def learned_strings(training: DataFrame, ranges: int) -> DataFrame:
    sent = training.select("text").mapInArrow(_count_strings(ranges), pk.SENT + ", counts binary")
    return sent.groupBy("rng").applyInArrow(_sum_strings, "rng long, keys binary, counts binary, " + ", ".join(f"{name} binary" for name in NODE))


def shared_top(strings: DataFrame) -> ContextTree:
    """The tree's nodes of depth TOP or less, summed over all ranges."""
    kinds = ", ".join(f"{name} {'double' if name == 'inside' else 'long'}" for name in NODE)
    # doubles are added in one order, so that a repeated run gives the same scores
    in_order = F.aggregate(F.sort_array(F.collect_list("inside")), F.lit(0.0), lambda a, x: a + x)
    parts = strings.select(*NODE).mapInArrow(_node_rows, kinds)
    found = parts.groupBy("node").agg(*(F.sum(name).alias(name) for name in ("zeros", "ones", "held0", "held1")), in_order.alias("inside")).toArrow()
    node, zeros, ones, held0, held1, inside = (found[name].to_numpy() for name in NODE)
    levels = [(node.astype(np.uint64), zeros, ones, held0, held1, inside)]
    for d in range(TOP - 1, -1, -1):
        keys, zeros, ones = levels[-1][:3]
        up = _U(d << 48) | (((keys >> _U(8)) & _U((1 << 8 * d) - 1)) << _U(8)) | (keys & _U(255))
        up, zeros, ones = summed(up, zeros, ones)
        levels.append((up, zeros, ones, np.zeros(len(up), np.int64), np.zeros(len(up), np.int64), np.zeros(len(up))))
    keys, zeros, ones, *deeper = (np.concatenate(x) for x in zip(*levels))
    keep = zeros + ones >= LEAST
    return ContextTree.of(keys[keep], zeros[keep], ones[keep], tuple(x[keep] for x in deeper))


def fit(training: DataFrame, n_bytes: int) -> ContextTree:
    """The whole tree in one place, for texts of a few MB: what the ranges and the shared top are together."""
    rows = learned_strings(training, range_count(n_bytes)).select("keys", "counts").toArrow()
    strings, counts = unplaced(pk.keys_of(rows)), pk.column_of(rows, "counts", np.int64)
    keys, zeros, ones = (np.concatenate(x) for x in zip(*(nodes_of(strings, counts, d) for d in range(DEPTH + 1))))
    keep = zeros + ones >= LEAST
    return ContextTree.of(keys[keep], zeros[keep], ones[keep])


# --- words -----------------------------------------------------------------------------------------------------------


def tokens(rows: pa.Table) -> tuple[tb.Block, np.ndarray, np.ndarray]:
    """(block, distinct token keys, place among them of every word, then of every text's end)."""
    b = tb.words(rows["text"], lower=True)
    keys, at = np.unique(np.concatenate([b.h, np.full(b.n, _END_WORD)]), return_inverse=True)
    return b, keys, at


def string_keys(rows: pa.Table) -> np.ndarray:
    """Distinct placed byte strings of all texts, sorted."""
    found = [np.unique(placed(byte_strings(x["text"])[0])) for batch in rows.select(["text"]).to_batches() for x in tb.blocks(batch, most=BLOCK)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def _ask(ranges: int):
    def ask(group: int, rows: pa.Table) -> pa.Table:
        b, keys, at = tokens(rows)
        learned = rows["learned"].to_numpy()
        mine = np.concatenate([learned[b.doc], learned])
        counts = np.bincount(at[mine], minlength=len(keys)).astype(np.int64)
        words = pk.send(group, keys, ranges, counts=counts)
        strings = pk.send(group, string_keys(rows), ranges)
        strings = strings.append_column("counts", pa.nulls(strings.num_rows, pa.binary()))
        return pa.concat_tables(x.append_column("kind", pa.array(np.full(x.num_rows, kind, np.int32))) for x, kind in ((words, WORDS), (strings, STRINGS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, blob in zip(batch["grp"].to_pylist(), batch["rows"]):
                yield from ask(group, from_blob(blob.as_buffer())).to_batches()

    return run


def _total(rows: pa.Table) -> tuple[list[bytes], int, int]:
    """The total count of every key sent, for who sent it; and the range's tokens and distinct tokens."""
    keys, counts = pk.keys_of(rows), pk.column_of(rows, "counts", np.int64)
    distinct, inverse = np.unique(keys, return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, inverse, counts)
    at = np.concatenate([[0], np.cumsum(rows["n"].to_numpy())])
    each = total[inverse]
    return [pk.planes(each[s:e]) for s, e in zip(at[:-1], at[1:])], total.sum(), (total > 0).sum()


def _log10(rows: pa.Table, learned: pa.Table, top: ContextTree) -> list[bytes]:
    """log10 of the probability of every string sent, for who sent it."""
    seen, counts = pk.keys_of(learned), pk.column_of(learned, "counts", np.int64)
    sent = lambda raw: np.cumsum(pk.unplanes(raw.as_py(), np.uint64))
    held, size = [seen], len(seen)
    for raw in rows["keys"]:  # a range that all groups ask much of is not unpacked at once
        held.append(sent(raw))
        size += len(held[-1])
        if size > max(1 << 21, 2 * len(held[0])):
            held = [np.unique(np.concatenate(held))]
            size = len(held[0])
    distinct = np.unique(np.concatenate(held))
    n = np.zeros(len(distinct), np.int64)
    n[np.searchsorted(distinct, seen)] = counts
    p = probabilities(distinct, n, top)
    return [pk.planes(p[np.searchsorted(distinct, sent(raw))]) for raw in rows["keys"]]


def _answer(shared):
    def run(rows: pa.Table, learned: pa.Table) -> pa.Table:
        rows, tokens_, seen = rows.combine_chunks(), 0, 0
        found: list[bytes] = []
        if rows.num_rows and rows["kind"][0].as_py() == WORDS:
            found, tokens_, seen = _total(rows)
        elif rows.num_rows:
            found = _log10(rows, learned, shared.value)
        return pa.table({
            "grp": rows["grp"], "rng": rows["rng"], "kind": rows["kind"], "found": pa.array(found, pa.binary()),
            "all_tokens": pa.array(np.full(len(found), tokens_, np.int64)), "seen_tokens": pa.array(np.full(len(found), seen, np.int64)),
        })

    return run


def _score(n_train: int, n_seen: int):
    def run(groups: pa.Table, answers: pa.Table) -> pa.Table:
        rows = from_blob(groups["rows"][0].as_buffer())
        found = sorted(zip(answers["kind"].to_pylist(), answers["rng"].to_pylist(), answers["found"].to_pylist()))
        told = lambda kind, of: np.concatenate([pk.unplanes(x, of) for k, _, x in found if k == kind])
        b, keys, at = tokens(rows)
        c = told(WORDS, np.int64)[at]
        each = np.log10((c + 1) / (n_train + n_seen + 1))
        words = len(b.h)
        n = np.diff(b.first) + 1
        known = tb.per_text(b, c[:words] > 0) + (c[words:] > 0)
        total = np.concatenate([[0], np.cumsum(each[:words])])
        base = total[b.first[1:]] - total[b.first[:-1]] + each[words:]
        held = []
        for batch in rows.select(["text"]).to_batches():
            for x in tb.blocks(batch, most=BLOCK):
                strings, off = byte_strings(x["text"])
                distinct, inverse = np.unique(placed(strings), return_inverse=True)
                held.append((distinct, inverse.astype(np.int32), off))
        keys, p = np.unique(np.concatenate([x for x, _, _ in held])), told(STRINGS, np.float32)
        score = np.concatenate([np.add.reduceat(p[np.searchsorted(keys, x)].astype(float)[inverse], off[:-1]) for x, inverse, off in held])
        return pa.table({
            "doc_id": rows["doc_id"], "held_out": rows["held_out"], "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(known, pa.int64()),
            "train_tokens": pa.array(np.full(len(n), n_train), pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(score, pa.float64()),
        })

    return run


def score_documents(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """Learn from rows whose crc32(doc_id) mod ``folds`` is not ``held``; score every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    arrow_limits(spark)
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))
    marked = docs.select("doc_id", "text", F.coalesce(remainder == held, F.lit(False)).alias("held_out"), F.coalesce(remainder != held, F.lit(False)).alias("learned"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    all_bytes = int(marked.agg(F.sum(size)).first()[0] or 0)
    ranges = range_count(all_bytes)
    strings = table(learned_strings(marked.where("learned"), ranges), "strings")
    shared = spark.sparkContext.broadcast(shared_top(strings))

    grouped = packed(marked, GROUP_BYTES)
    asked = grouped.mapInArrow(_ask(ranges), pk.SENT + ", counts binary, kind int")
    learned = strings.select("rng", "keys", "counts", F.lit(STRINGS).alias("kind"))
    answers = asked.groupBy("kind", "rng").cogroup(learned.groupBy("kind", "rng")).applyInArrow(
        _answer(shared), "grp long, rng long, kind int, found binary, all_tokens long, seen_tokens long"
    )
    answers = table(answers, "answers")
    by_range = answers.where(F.col("kind") == WORDS).groupBy("rng").agg(F.max("all_tokens").alias("a"), F.max("seen_tokens").alias("s"))
    n_train, n_seen = (int(x or 0) for x in by_range.agg(F.sum("a"), F.sum("s")).first())
    return grouped.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(
        _score(n_train, n_seen),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
