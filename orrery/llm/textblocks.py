"""Numpy kernels over blocks of texts: words, lines and their 64-bit hashes, with no per-word Python.

A block is an Arrow string column.  A span of its bytes (word, line) is hashed by chunks of eight bytes: each
chunk and its place go through a mixer, the results are summed and mixed again with the length, so no algebra
of the text carries over into the hash.  Spans of at most eight bytes and equal length never collide.  Lanes
are independent hashes of the same spans; results that rest on equality use two (128 bits), see ``distinct``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from orrery.llm.runtime import BLOCK_BYTES

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64
#: Salts of the independent hashes.
_LANES = ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0x51A2F9C36B8D07E5, 0x8F14E9B7D3A6C21D))
_PLACE, _LENGTH = _U(0xA0761D6478BD642F), _U(0xD6E8FEB86659FD93)
_JOIN, _FACTOR = 0xE7037ED1A0B428DB, _U(0x9FB21C651E98DF25)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """Hashes of the bytes [start, end) of each span."""
    salt, last = map(_U, _LANES[lane])
    held = np.concatenate([data, np.zeros(8, np.uint8)])
    chunk_at = np.ndarray(len(data) + 1, "<u8", held, 0, (1,))  # the eight bytes from any place on
    size = (end - start).astype(np.int64)
    short = np.minimum(size, 8).astype(np.uint64)
    masks = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
    total = mix((chunk_at[start] & masks[short]) ^ salt)
    long = np.flatnonzero(size > 8)
    if len(long):
        more = (size[long] - 1) // 8  # chunks after the first
        upto = np.cumsum(more)
        nth = np.arange(upto[-1]) - np.repeat(upto - more, more) + 1
        at = np.repeat(start[long], more) + 8 * nth
        left = np.minimum(np.repeat(end[long], more) - at, 8)
        each = mix((chunk_at[at] & masks[left]) ^ mix(nth.astype(np.uint64) * _PLACE + salt))
        total[long] += np.add.reduceat(each, upto - more)
    return mix(total + size.astype(np.uint64) * _LENGTH + last)


def join(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """Hashes of pairs in order; for a given salt and one side fixed, distinct others give distinct results."""
    return mix(mix(a + _U((salt + 1) * _JOIN & (2**64 - 1))) * _FACTOR + b)


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n neighbours of h (across documents too: callers mask those), by doubling."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    x, size = mix(h), 1
    while size < n:  # two windows that overlap or touch make the next
        step = min(size, n - size)
        x = join(x[: len(x) - step], x[step:], size + step)
        size += step
    return x


def distinct(keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, number, count) of the distinct pairs of 64-bit hashes: ``np.unique`` of 128 bits."""
    unique, first, inverse, counts = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    if (checks[first][inverse] == checks).all():
        return first, inverse, counts
    order = np.lexsort((checks, keys))  # two pairs share a key
    new = np.ones(len(order), bool)
    new[1:] = (keys[order][1:] != keys[order][:-1]) | (checks[order][1:] != checks[order][:-1])
    inverse = np.empty(len(order), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return order[new], inverse, np.bincount(inverse)


@dataclass
class Block:
    """data: all bytes; off: text boundaries; start, end, doc, h: of each word; first: words before each text."""

    data: np.ndarray
    off: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    h: np.ndarray
    first: np.ndarray

    @cached_property
    def check(self) -> np.ndarray:
        """A second, independent hash of each word."""
        return spans(self.data, self.start, self.end, 1)

    @property
    def n(self) -> int:
        return len(self.off) - 1

    def window_at(self, n: int) -> np.ndarray:
        """Word positions at which a window of n words of one text starts."""
        at = np.arange(max(0, len(self.doc) - n + 1))
        return at[self.doc[at] == self.doc[at + n - 1]] if len(at) else at


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0); null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    t = texts.cast(pa.large_string())
    if t.null_count:
        t = pc.fill_null(t, "")
    off = np.frombuffer(t.buffers()[1], np.int64)[t.offset : t.offset + len(t) + 1] if len(t) else np.zeros(1, np.int64)
    raw = t.buffers()[2] if len(t) else None
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def words(texts: pa.Array, lower: bool = False) -> Block:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every text; with ``lower``, A-Z are folded first."""
    data, off = buffers(texts)
    if lower:
        data = LOWER[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    space = SPACES[data]
    before, after = edge[:n].copy(), edge[1:].copy()
    before[1:] |= space[:-1]
    after[:-1] |= space[1:]
    solid = ~space
    start, end = np.flatnonzero(solid & before), np.flatnonzero(solid & after) + 1
    first = np.searchsorted(start, off)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    return Block(data, off, start, end, doc, spans(data, start, end), first)


def line_hashes(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, second hash, has a word) of every \\n-split line."""
    cut = np.flatnonzero(b.data == 10)
    start = np.concatenate([b.off[:-1], cut + 1])
    doc = np.concatenate([np.arange(b.n), np.searchsorted(b.off, cut, "right") - 1])
    order = np.lexsort((start, doc))
    start, doc = start[order], doc[order]
    # a line ends at the next start less its \n, or where its text ends
    stop = np.empty(len(start), np.int64)
    stop[:-1] = start[1:] - 1
    last = np.ones(len(start), bool)
    last[:-1] = doc[1:] != doc[:-1]
    stop[last] = b.off[doc[last] + 1]
    has = np.searchsorted(b.start, stop) > np.searchsorted(b.start, start)
    return doc, spans(b.data, start, stop), spans(b.data, start, stop, 1), has


def blocks(batch: pa.RecordBatch, column: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold at most ``most`` bytes together, a longer text alone."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(size)
    at = 0
    while at < len(size):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def per_text(b: Block, values: np.ndarray) -> np.ndarray:
    """Sums of word values by text."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[b.first[1:]] - total[b.first[:-1]]
