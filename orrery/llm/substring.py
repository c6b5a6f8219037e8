"""Removal of long word sequences that an earlier document has, found by recompression.

Words are symbols.  A step names maximal runs of a symbol, then pairs of a left and a right symbol, sides being
a bit of a symbol's identity.  What a step does to a symbol depends on it and its neighbours alone, so equal
word sequences get equal symbols but for the outermost ones at their ends.  A round takes some steps in every
group of documents, then names globally: groups send the distinct symbols they made to hash ranges; a symbol
that occurs in two documents gets a name, a number that no other has (its range, round and place there), and one that does not is dead: no repeat
runs over it, it takes part in no further symbol, and dead neighbours shrink to one.  So what is left to name
is soon the shared text alone, and its symbols grow (``STEPS``: 3 + 2 + 1 steps, six words on average, 50 at most).

A window of ``WINDOW`` words is a repeat candidate if all symbols inside it are shared in every round.  Its
canonical form is what the steps leave of it whatever stands around: in each step the outermost run and a
symbol that might pair with the outside are taken off at either end, the rest are the symbols inside.  Two
windows are equal if and only if their forms are, so the form (a 96-bit hash of its names) is the window's key;
ranges are asked whether a smaller document has it.

Groups are packed without a key (:mod:`orrery.llm.groups`), and only distinct symbols and keys cross the
network (:mod:`orrery.llm.packed`), so neither pairs nor groups of copies are ever formed.

Defined results: null and empty texts have no words; a document shorter than a window keeps all; texts of
any length are read whole; equal doc_ids are not smaller than each other, so repeated rows keep each
other's text; a null doc_id is larger than all others; of equal windows in one document none is smaller (ties
keep both); an empty table gives an empty result; other columns are kept (input columns named ``n_words``,
``n_removed``, ``kept_text`` are replaced).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm import packed as pk
from orrery.llm import textblocks as tb
from orrery.llm.groups import from_blob, packed
from orrery.llm.runtime import ranges_for, table, text_bytes

WINDOW = 50
#: Steps of each round; a round ends with the global naming of what its steps made.
STEPS = (3, 2, 1)
GROUP_BYTES, RANGE_BYTES = 2 << 20, 8 << 20
_U = np.uint64
_LAST = np.iinfo(np.int64).max
_RUN, _PAIR, _EDGE = 1 << 20, 2 << 20, 3 << 20


@dataclass
class Words:
    """A group's words in order: two hashes of each, its document's place, and the documents' ids."""

    h: np.ndarray
    check: np.ndarray
    doc: np.ndarray
    ids: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table) -> tuple[Words, tb.Block]:
        b = tb.words(rows["text"])
        ids = rows["doc_id"].combine_chunks().cast(pa.int64()).fill_null(_LAST).to_numpy(zero_copy_only=False)
        return cls(b.h, b.check, b.doc, ids), b

    def to_bytes(self, b: tb.Block) -> bytes:
        """The distinct words, most frequent first, and for every word which it is."""
        first, number, counts = tb.distinct(self.h, self.check)
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order))
        n = np.bincount(self.doc, minlength=len(self.ids))
        start = b.start[first][order]
        size = (b.end - b.start)[first][order]
        before = np.cumsum(size) - size
        raw = b.data[np.arange(int(size.sum())) + np.repeat(start - before, size)]
        parts = (self.ids, n.astype(np.int64), size.astype(np.uint32), rank[number])
        return pk.pile([*map(pk.planes, parts), raw.tobytes()])

    @classmethod
    def from_bytes(cls, blob: bytes) -> Words:
        *parts, raw = pk.unpile(blob)
        ids, n, size, at = (pk.unplanes(x, k) for x, k in zip(parts, (np.int64, np.int64, np.uint32, np.uint32)))
        end = np.cumsum(size, dtype=np.int64)
        data = np.frombuffer(raw, np.uint8)
        h, check = (tb.spans(data, end - size, end, lane) for lane in (0, 1))
        return cls(h[at], check[at], np.repeat(np.arange(len(ids)), n), ids)


@dataclass
class Symbols:
    """p, q: identity (0, 0 if dead); start: first word; end: words in all; made: by a step of this round."""

    p: np.ndarray
    q: np.ndarray
    start: np.ndarray
    made: np.ndarray
    end: int

    @property
    def past(self) -> np.ndarray:
        return np.append(self.start[1:], self.end) if len(self.start) else self.start

    def kill(self, dead: np.ndarray) -> None:
        self.p[dead] = self.q[dead] = 0


class Step:
    """One step over a group's symbols: ``runs`` and the next symbols, and the maps that windows follow."""

    def __init__(self, s: Symbols, doc: np.ndarray, level: int):
        head = np.ones(len(s.p), bool)
        d = doc[s.start]
        head[1:] = (s.p[1:] != s.p[:-1]) | (s.q[1:] != s.q[:-1]) | (d[1:] != d[:-1])
        self.p, self.q = s.p, s.q
        self.run_of = np.cumsum(head) - 1
        at = np.flatnonzero(head)
        self.run_start, self.run_end = at, np.append(at[1:], len(s.p)) if len(at) else at
        n = self.run_end - at
        runs = Symbols(s.p[at], s.q[at], s.start[at], s.made[at], s.end)
        many = (n > 1) & (runs.p != 0)
        k = n[many].astype(np.uint64)
        runs.p[many], runs.q[many] = tb.join(runs.p[many], k, _RUN + level), tb.join(runs.q[many], k, _RUN + level)
        runs.made[many] = True
        words = runs.past - runs.start
        runs.kill(words > WINDOW)  # inside no window
        self.runs = runs
        self.right = (tb.mix(runs.p ^ _U(0xA0761D6478BD642F * (2 * level + 3) & (2**64 - 1))) >> _U(63)).astype(bool)
        live, d = runs.p != 0, d[at]
        pair = np.zeros(len(at), bool)
        pair[:-1] = ~self.right[:-1] & self.right[1:] & live[:-1] & live[1:] & (d[1:] == d[:-1]) & (words[:-1] + words[1:] <= WINDOW)
        first = np.flatnonzero(pair)
        keep = np.ones(len(at), bool)
        keep[first + 1] = False
        p, q, made = runs.p.copy(), runs.q.copy(), runs.made.copy()
        p[first], q[first], made[first] = tb.join(p[first], p[first + 1], _PAIR + level), tb.join(q[first], q[first + 1], _PAIR + level), True
        self.unit_of = np.cumsum(keep) - 1
        self.next = Symbols(p[keep], q[keep], runs.start[keep], made[keep], s.end)


@dataclass
class Windows:
    """at: first words; l, r: first symbol and past the last inside; p, q: hashes of what was taken off."""

    at: np.ndarray
    l: np.ndarray  # noqa: E741
    r: np.ndarray
    p: np.ndarray
    q: np.ndarray

    def _take(self, who: np.ndarray, p: np.ndarray, q: np.ndarray, tag: int) -> None:
        self.p[who], self.q[who] = tb.join(self.p[who], p, _EDGE + tag), tb.join(self.q[who], q, _EDGE + tag)

    def only(self, keep: np.ndarray) -> None:
        self.at, self.l, self.r, self.p, self.q = self.at[keep], self.l[keep], self.r[keep], self.p[keep], self.q[keep]

    def all_live(self, s: Symbols) -> None:
        """Drops the windows with a dead symbol inside."""
        dead = np.concatenate([[0], np.cumsum(s.p == 0)])
        self.only(dead[self.r] == dead[self.l])

    def _inside(self, who: np.ndarray, l: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:  # noqa: E741
        """Those with symbols left; the others are emptied."""
        left = l < r
        self.l[who[~left]] = self.r[who[~left]] = 0
        return who[left], l[left], r[left]

    def follow(self, step: Step, level: int) -> None:
        """From a step's symbols to the next ones."""
        tag = 8 * level
        who = np.flatnonzero(self.l < self.r)
        l, r = self.l[who], self.r[who]  # noqa: E741
        to = np.minimum(step.run_end[step.run_of[l]], r)
        n = (to - l).astype(np.uint64)
        self._take(who, step.p[l] + n, step.q[l] + n, tag)
        who, l, r = self._inside(who, to, r)  # noqa: E741
        to = np.maximum(step.run_start[step.run_of[r - 1]], l)
        n = (r - to).astype(np.uint64)
        self._take(who, step.p[r - 1] + n, step.q[r - 1] + n, tag + 1)
        who, l, r = self._inside(who, l, to)  # noqa: E741
        l, r = step.run_of[l], step.run_of[r - 1] + 1  # noqa: E741
        for side in (0, 1):
            edge = l if side == 0 else r - 1
            loose = step.right[edge] == (side == 0)
            x = edge[loose]
            self._take(who[loose], step.runs.p[x], step.runs.q[x], tag + 2 + side)
            if side == 0:
                l = l + loose  # noqa: E741
            else:
                r = r - loose
            who, l, r = self._inside(who, l, r)  # noqa: E741
        self.l[who], self.r[who] = step.unit_of[l], step.unit_of[r - 1] + 1

    def close(self, s: Symbols) -> None:
        """Takes what is inside after the last step."""
        while len(who := np.flatnonzero(self.l < self.r)):
            self._take(who, s.p[self.l[who]], s.q[self.l[who]], 7)
            self.l[who] += 1


class Recompression:
    """A group's symbols, round by round, from its words and the names that were given so far."""

    def __init__(self, words: Words):
        self.words, self.level = words, 0
        self.symbols = Symbols(words.h.copy(), words.check.copy(), np.arange(len(words.h)), np.zeros(len(words.h), bool), len(words.h))
        self.windows: Windows | None = None

    def watch(self) -> None:
        at = np.arange(max(0, len(self.words.doc) - WINDOW + 1))
        at = at[self.words.doc[at] == self.words.doc[at + WINDOW - 1]]
        self.windows = Windows(at, at.copy(), at + WINDOW, np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64))

    def steps(self, n: int) -> None:
        """Takes n steps; then ``keys`` and ``checks`` are the distinct symbols to be named, ``here`` those two documents have."""
        self.symbols.made[:] = False
        for _ in range(n):
            step = Step(self.symbols, self.words.doc, self.level)
            if self.windows is not None:
                self.windows.follow(step, self.level)
            self.symbols, self.level = step.next, self.level + 1
        s = self.symbols
        self.at = np.flatnonzero(s.made & (s.p != 0))
        p, q = s.p[self.at], s.q[self.at] >> _U(32)
        first, self.number, _ = tb.distinct(p, q)
        order = np.lexsort((q[first], p[first]))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.number = rank[self.number]
        self.keys, self.checks = p[first][order], q[first][order].astype(np.uint32)

    def here(self) -> np.ndarray:
        ids = self.words.ids[self.words.doc[self.symbols.start[self.at]]]
        low, high = np.full(len(self.keys), _LAST), np.full(len(self.keys), np.iinfo(np.int64).min)
        np.minimum.at(low, self.number, ids)
        np.maximum.at(high, self.number, ids)
        return low < high

    def name(self, names: np.ndarray) -> None:
        """Gives the symbols of the last steps their names (0: dead)."""
        given = names[self.number]
        s = self.symbols
        s.p[self.at] = np.where(given != 0, tb.mix(given * _U(0x9FB21C651E98DF25)) | _U(1), 0)
        s.q[self.at] = np.where(given != 0, tb.mix(given + _U(0x51A2F9C36B8D07E5)), 0)
        if self.windows is not None:
            self.windows.all_live(s)

    def close(self) -> None:
        """Sets the windows that repeats may hold: their places, keys, and the distinct keys with their smallest documents."""
        w = self.windows
        w.close(self.symbols)
        if not self.level:  # nothing was shown to be shared
            w.only(np.zeros(len(w.at), bool))
        key, check = w.p, w.q >> _U(32)
        first, number, _ = tb.distinct(key, check)
        order = np.lexsort((check[first], key[first]))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.at, self.number = w.at, rank[number]
        self.keys, self.checks = key[first][order], check[first][order].astype(np.uint32)
        self.low = np.full(len(self.keys), _LAST)
        np.minimum.at(self.low, self.number, self.words.ids[self.words.doc[self.at]])

    def removed(self, smaller_elsewhere: np.ndarray) -> np.ndarray:
        """Words to remove."""
        gone = smaller_elsewhere[self.number] | (self.low[self.number] < self.words.ids[self.words.doc[self.at]])
        edge = np.zeros(len(self.words.h) + 1, np.int64)
        np.add.at(edge, self.at[gone], 1)
        np.add.at(edge, self.at[gone] + WINDOW, -1)
        return np.cumsum(edge[:-1]) > 0


def replay(words: Words, answers: pa.Table | None, steps: tuple[int, ...], rounds: int, watch: bool) -> Recompression:
    """A group's symbols after the named rounds and, if there is one, the steps of the next."""
    found = Recompression(words)
    if watch:
        found.watch()
    for i, n in enumerate(steps[: rounds + 1]):
        found.steps(n)
        if i < rounds:
            number, rng = pk.numbers_of(answers, i, len(found.keys))
            found.name(np.where(number != 0, (number << _U(24) | rng) * _U(len(steps)) + _U(i + 1), 0))
    return found


def joined(b: tb.Block, keep: np.ndarray) -> pa.Array:
    """The kept words of every text, joined by one space."""
    start, size, doc = b.start[keep], (b.end - b.start)[keep], b.doc[keep]
    last = np.ones(len(doc), bool)
    last[:-1] = doc[1:] != doc[:-1]
    width = size + ~last
    stop = np.cumsum(width)
    out = np.full(stop[-1] if len(stop) else 0, 32, np.uint8)
    to = np.arange(int(size.sum()))
    before = np.cumsum(size) - size
    out[to + np.repeat(stop - width - before, size)] = b.data[to + np.repeat(start - before, size)]
    off = np.concatenate([[0], stop])[np.searchsorted(doc, np.arange(b.n + 1))].astype(np.int64)
    return pa.LargeStringArray.from_buffers(b.n, pa.py_buffer(off.tobytes()), pa.py_buffer(out.tobytes())).cast(pa.string())


def _words_blob(rows: pa.Table) -> bytes:
    words, b = Words.of(rows)
    return words.to_bytes(b)


def _no_symbols(ranges: int) -> pa.Table:
    none = np.zeros(0, np.uint64)
    return pk.send(0, none, ranges, checks=none.astype(np.uint32), here=none.astype(bool))


def _symbols(ranges: int, steps: tuple[int, ...]):
    """The distinct symbols of the first round's steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for grp, more in zip(batch["grp"].to_pylist(), batch["more"]):
                g = replay(Words.from_bytes(more.as_py()), None, steps, 0, False)
                yield from pk.send(grp, g.keys, ranges, checks=g.checks, here=g.here()).to_batches()

    return run


def _more_symbols(ranges: int, steps: tuple[int, ...], rounds: int):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _no_symbols(ranges)
        g = replay(Words.from_bytes(rows["more"][0].as_py()), answers, steps, rounds, False)
        return pk.send(rows["grp"][0].as_py(), g.keys, ranges, checks=g.checks, here=g.here())

    return run


def _by_key(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sorting order, whether a distinct symbol begins there, its number there, the first places)."""
    key, check = pk.keys_of(rows), pk.column_of(rows, "checks", np.uint32)
    order = np.lexsort((check, key))
    k, c = key[order], check[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    return order, new, np.cumsum(new) - 1, np.flatnonzero(new)


def _name(number: int):
    """Names of the symbols that two groups, or two documents of one, have; 0 for the others."""

    def run(rows: pa.Table) -> pa.Table:
        order, new, which, first = _by_key(rows)
        if not len(order):
            return pk.reply(rows, np.zeros(0, np.uint64), number)
        here = pk.column_of(rows, "here", bool)[order]
        live = (np.diff(np.append(first, len(order))) > 1) | np.logical_or.reduceat(here, first)
        out = np.empty(len(order), np.uint64)
        out[order] = np.where(live, np.cumsum(live), 0).astype(np.uint64)[which]  # the name within the range and round
        return pk.reply(rows, out, number)

    return run


def _windows(ranges: int, steps: tuple[int, ...]):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            none = np.zeros(0, np.uint64)
            return pk.send(0, none, ranges, checks=none.astype(np.uint32), docs=none.astype(np.int64))
        g = replay(Words.from_bytes(rows["more"][0].as_py()), answers, steps, len(steps), True)
        g.close()
        return pk.send(rows["grp"][0].as_py(), g.keys, ranges, checks=g.checks, docs=g.low)

    return run


def _smaller(number: int):
    """1 for the windows of which another group has a smaller document."""

    def run(rows: pa.Table) -> pa.Table:
        order, _, which, first = _by_key(rows)
        doc = pk.column_of(rows, "docs", np.int64)[order]
        out = np.zeros(len(order), np.uint64)
        if len(order):
            out[order] = np.minimum.reduceat(doc, first)[which] < doc
        return pk.reply(rows, out, number)

    return run


def _remove(names: list[str], steps: tuple[int, ...]):
    def run(groups: pa.Table, answers: pa.Table) -> pa.Table:
        rows = from_blob(groups["rows"][0].as_buffer())
        words, b = Words.of(rows)
        g = replay(words, answers, steps, len(steps), True)
        g.close()
        out = g.removed(pk.numbers_of(answers, len(steps), len(g.keys))[0] != 0)
        found = rows.select(names)
        for name, column in (("n_words", pa.array(np.diff(b.first), pa.int64())), ("n_removed", pa.array(tb.per_text(b, out), pa.int64())), ("kept_text", joined(b, ~out))):
            found = found.append_column(name, column)
        return found

    return run


def remove_repeats(docs: DataFrame, steps: tuple[int, ...] = STEPS) -> DataFrame:
    """``docs`` (doc_id, text and others) with n_words, n_removed and kept_text: its kept words joined by a space."""
    _, size = text_bytes(docs)
    ranges = ranges_for(size, RANGE_BYTES)
    names = [c for c in docs.columns if c not in {"n_words", "n_removed", "kept_text"}]
    groups = packed(docs.select(*names), GROUP_BYTES, _words_blob)
    words, by_group = groups.select("grp", "more"), "grp"
    sent_as, answers = pk.SENT + ", checks binary, here binary", None
    for i in range(len(steps)):
        if answers is None:
            sent = words.mapInArrow(_symbols(ranges, steps), sent_as)
        else:
            sent = words.groupBy(by_group).cogroup(answers.groupBy(by_group)).applyInArrow(_more_symbols(ranges, steps, i), sent_as)
        named = table(sent.groupBy("rng").applyInArrow(_name(i), pk.REPLIED), "names")
        answers = named if answers is None else answers.unionByName(named)
    schema = T.StructType([*(docs.schema[c] for c in names), *(T.StructField(c, T.LongType()) for c in ("n_words", "n_removed")), T.StructField("kept_text", T.StringType())])
    if answers is None:
        answers = docs.sparkSession.createDataFrame([], pk.REPLIED)
    asked = words.groupBy(by_group).cogroup(answers.groupBy(by_group)).applyInArrow(_windows(ranges, steps), pk.SENT + ", checks binary, docs binary")
    answers = answers.unionByName(table(asked.groupBy("rng").applyInArrow(_smaller(len(steps)), pk.REPLIED), "smaller"))
    return groups.select("grp", "rows").groupBy(by_group).cogroup(answers.groupBy(by_group)).applyInArrow(_remove(names, steps), schema)


def edit_repeats(docs: DataFrame) -> DataFrame:
    """The rows and columns of ``docs``, each text without its repeats; a text that has none stays as it is."""
    own = [c for c in docs.columns if c not in {"n_words", "n_removed", "kept_text"}]
    clash = {c: f"_own_{i}" for i, c in enumerate(docs.columns) if c not in own}
    found = remove_repeats(docs.withColumnsRenamed(clash))
    edited = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")).alias("text")
    out = [edited if c == "text" else F.col(clash[c]).alias(c) if c in clash else F.col(c) for c in docs.columns]
    if "n_chars" in own:
        kind = docs.schema["n_chars"].dataType
        out[docs.columns.index("n_chars")] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast(kind)).otherwise(F.col("n_chars")).alias("n_chars")
    return found.select(*out)
