"""Byte-level BPE by Spark higher-order functions.

Groups of documents, as tasks read them, split their texts into pieces once: a text becomes numbers of distinct pieces,
and each distinct piece goes to a hash range.  There the distinct pieces of all groups are encoded, once each, by an
expression: ``aggregate`` folds one merge after another over the array of a piece's bytes, each time the adjacent pair
of lowest rank (the leftmost of equals), until no pair has a rank.  The ids of the distinct pieces then replace the
numbers of each text in order.  Decoding concatenates the byte strings of ids.

The ranks are a literal map from pairs of ids to the id of their bytes, laid out as a perfect hash of two
arrays (a displacement for each bucket, then the entry itself with its key), so a look-up reads two elements.
An element of the folded array holds, from the top, the rank of its pair with the next, its place in the
piece and its id: the least element is the merge to make.  A token that no merges of its own bytes lead to
still stands for a piece equal to it; those few are a second, small literal.

Texts are not shuffled, only their numbers; of pieces, a group sends a distinct one once, so that a piece which all
documents have reaches its range once a group.  Defined results: null and empty texts have no ids; texts of any length
are read whole; repeated rows are encoded one by one; an empty table gives an empty result; a null doc_id is kept; other
columns are ignored.  A piece of n bytes takes up to n folds of n steps: 16,000 letters without a space take some ten
seconds, 100,000 minutes, and a piece of 2**24 bytes or more is refused.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm import packed as pk
from orrery.llm import textblocks as tb
from orrery.llm.runtime import arrow_limits, ranges_for, text_bytes

#: Bits of an id and of a place; the rank is above them.
ID_BITS, PLACE_BITS = 17, 24
NONE = (1 << ID_BITS) - 1
_TOP = ID_BITS + PLACE_BITS
BUCKETS, FACTOR = 65521, 40503
#: Pieces of texts that are put together at once.
ASSEMBLE = 1 << 18
#: Text bytes of a group, and of what a range answers for.
GROUP_BYTES, RANGE_BYTES = 8 << 20, 2 << 20


def parse_ranks(text: str) -> dict[bytes, int]:
    """Lines of base64 token and rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in text.splitlines() if line)}


def merge_bytes(raw: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The fold in plain Python, for the driver's look at the vocabulary itself."""
    parts = [raw[i : i + 1] for i in range(len(raw))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], NONE), i) for i in range(len(parts) - 1))
        if rank == NONE:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def pair_table(ranks: dict[bytes, int]) -> tuple[list[int], list[int]]:
    """(displacements, entries): the perfect hash of all pairs of ids whose bytes together are a token."""
    keys, values = [], []
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
            if left is not None and right is not None:
                keys.append(left << ID_BITS | right)
                values.append(rank)
    key, value = np.array(keys, np.int64), np.array(values, np.int64)
    size = next(n for n in range(2 * len(key) + 11, 1 << 40) if all(n % f for f in range(2, int(n**0.5) + 1)))
    bucket, home = key % BUCKETS, key * FACTOR % size
    entries, shift = [-1] * size, [0] * BUCKETS
    groups: dict[int, list[int]] = {}
    for i, b in enumerate(bucket.tolist()):
        groups.setdefault(b, []).append(i)
    homes, full = home.tolist(), (key << ID_BITS | value).tolist()
    for b, g in sorted(groups.items(), key=lambda x: -len(x[1])):
        if len({homes[i] for i in g}) < len(g):
            raise ValueError("two pairs of one bucket share a home")
        d = next(d for d in range(size) if all(entries[(homes[i] + d) % size] < 0 for i in g))
        shift[b] = d
        for i in g:
            entries[(homes[i] + d) % size] = full[i]
    return shift, entries


class Ranks:
    """A vocabulary of ranks with its literals."""

    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values()) >= NONE or any(bytes([i]) not in ranks for i in range(256)):
            raise ValueError(f"ranks must lie below {NONE} and cover every byte")
        self.ranks = ranks
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        shift, entries = pair_table(ranks)
        self.size = len(entries)
        self.unreached = {t.decode("latin-1"): r for t, r in ranks.items() if len(t) > 1 and merge_bytes(t, ranks) != [r]}
        self.table = F.from_json(F.lit(json.dumps({"shift": shift, "entries": entries})), "shift array<int>, entries array<bigint>")


def rank_of(table: Column, size: int, left: Column, right: Column) -> Column:
    """The id of the bytes of two ids together, or NONE (also where one is null)."""
    key = F.shiftleft(left, ID_BITS).bitwiseOR(right)
    home = F.get(table["shift"], (key % BUCKETS).cast("int")) + key * FACTOR
    entry = F.get(table["entries"], (home % size).cast("int"))
    return F.coalesce(F.when(F.shiftright(entry, ID_BITS) == key, entry.bitwiseAND(F.lit(NONE).cast("long"))), F.lit(NONE).cast("long"))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def element(rank: Column, place_and_id: Column) -> Column:
    return F.shiftleft(rank, _TOP).bitwiseOR(place_and_id)


def encode_piece(piece: Column, table: Column, size: int) -> Column:
    """The ids of a piece, given as the ids of its bytes (bigint)."""
    id_of = lambda e: e.bitwiseAND(F.lit(NONE).cast("long"))
    low = lambda e: e.bitwiseAND(F.lit((1 << _TOP) - 1))
    start = F.transform(piece, lambda x, i: element(rank_of(table, size, x, F.get(piece, i + 1)), F.shiftleft(i.cast("long"), ID_BITS).bitwiseOR(x)))

    def merge(state: Column, least: Column) -> Column:
        made = F.shiftright(least, _TOP)
        place = least.bitwiseAND(F.lit((1 << _TOP) - 1 - NONE))

        def at(i: Column) -> Column:
            left = F.transform(F.slice(state, F.greatest(i - 1, F.lit(1)), F.least(i - 1, F.lit(1))), lambda e: element(rank_of(table, size, id_of(e), made), low(e)))
            both = element(rank_of(table, size, made, id_of(F.get(state, i + 1))), place.bitwiseOR(made))
            return F.concat(F.slice(state, F.lit(1), F.greatest(i - 2, F.lit(0))), left, F.array(both), F.slice(state, i + 2, F.size(state)))

        return let(F.array_position(state, least).cast("int"), at)

    def step(state: Column, _: Column) -> Column:
        return let(F.array_min(state), lambda least: F.when(F.shiftright(least, _TOP) < NONE, merge(state, least)).otherwise(state))

    return F.aggregate(F.slice(piece, F.lit(2), F.size(piece)), start, step, lambda state: F.transform(state, id_of))


def encode_pieces(pieces: Column, vocabulary: Ranks) -> Column:
    """The ids of every piece; the literal is bound once, so a task holds one copy of it."""
    return let(vocabulary.table, lambda table: F.transform(pieces, lambda p: encode_piece(p, table, vocabulary.size)))


def squeeze(raw: bytes) -> bytes:
    return pa.compress(raw, codec="zstd", asbytes=True)


def unsqueeze(raw: bytes, size: int) -> bytes:
    return pa.decompress(raw, decompressed_size=size, codec="zstd", asbytes=True)


def ranges_of(raw: list[bytes], ranges: int) -> np.ndarray:
    """The hash range of each piece."""
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    end = np.cumsum(size)
    h = tb.spans(np.frombuffer(b"".join(raw), np.uint8), end - size, end)
    return ((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.uint32)


def _split(pattern: str, ranges: int):
    """Of every group its distinct pieces for each range (key: the range), and its texts as numbers of pieces (key: beyond the ranges)."""

    def of(group: int, docs: list[pa.RecordBatch], find) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        numbers, counts, ids = [], [], []
        for batch in docs:
            ids += batch["doc_id"].to_pylist()
            for text in batch["text"]:
                found = find(text.as_py()) if text.is_valid else []
                counts.append(len(found))
                numbers.append(np.fromiter((known.setdefault(p, len(known)) for p in found), np.int32, len(found)))
        number = np.concatenate(numbers)
        by = np.argsort(-np.bincount(number, minlength=len(known)), kind="stable")  # most frequent first: small numbers
        place = np.empty(len(by), np.uint32)
        place[by] = np.arange(len(by))
        held = list(known)
        raw = [held[i].encode() for i in by.tolist()]
        part = ranges_of(raw, ranges)
        order = np.argsort(part, kind="stable")
        full, first = np.unique(part[order], return_index=True)
        runs = [[raw[i] for i in run.tolist()] for run in np.split(order, first[1:])] if len(raw) else []
        sizes = [pk.planes(np.array([len(x) for x in r], np.uint32)) for r in runs]
        none = lambda n, kind: pa.nulls(n, kind)
        yield pa.record_batch([pa.array(full, pa.int64()), pa.array([group] * len(runs), pa.int64()), pa.array(sizes, pa.binary()), pa.array([squeeze(b"".join(r)) for r in runs], pa.binary()), none(len(runs), pa.list_(pa.int64())), none(len(runs), pa.binary())], SPLIT_NAMES)
        texts = pk.pile([pk.planes(np.array(counts, np.int64)), pk.planes(part), pk.planes(place[number])])
        yield pa.record_batch([pa.array([ranges + group]), pa.array([group]), none(1, pa.binary()), none(1, pa.binary()), pa.array([ids], pa.list_(pa.int64())), pa.array([texts], pa.binary())], SPLIT_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(pattern).findall
        first, held, size, nth = TaskContext.get().partitionId() << 36, [], 0, 0
        for block in (x for batch in batches for x in tb.blocks(batch, most=GROUP_BYTES)):
            if held and size + block.nbytes > GROUP_BYTES:
                yield from of(first | nth, held, find)
                held, size, nth = [], 0, nth + 1
            held.append(block)
            size += block.nbytes
        if held:
            yield from of(first | nth, held, find)

    return run


SPLIT = "key long, grp long, sizes binary, raw binary, ids array<long>, texts binary"
SPLIT_NAMES = [f.split()[0] for f in SPLIT.split(", ")]


def _distinct(byte_ids: np.ndarray, unreached: dict[str, int]):
    """One row a range: the senders, how many pieces each sent, their numbers, and the distinct pieces as byte ids."""

    def run(rows: pa.Table) -> pa.Table:
        if rows["texts"][0].is_valid:  # a group's texts, which the answers will meet
            return pa.table({n: pa.array([], t) for n, t in (("rng", pa.int64()), ("grps", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("numbers", pa.binary()), ("pieces", pa.list_(pa.list_(pa.int64()))))})
        known: dict[bytes, int] = {}
        numbers, counts = [], []
        for sizes, raw in zip(rows["sizes"].to_pylist(), rows["raw"].to_pylist()):
            size = pk.unplanes(sizes, np.uint32).astype(np.int64)
            if size.max() >= 1 << PLACE_BITS:
                raise ValueError(f"a piece of {size.max()} bytes: places in a piece have {PLACE_BITS} bits")
            end = np.cumsum(size).tolist()
            raw = unsqueeze(raw, end[-1])
            numbers.append(np.fromiter((known.setdefault(raw[a:z], len(known)) for a, z in zip([0, *end], end)), np.int32, len(end)))
            counts.append(len(end))
        parts = [np.array([unreached[k]], np.int64) if (k := p.decode("latin-1")) in unreached else byte_ids[np.frombuffer(p, np.uint8)].astype(np.int64) for p in known]
        off = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(parts)))
        one = lambda x: pa.array([x], pa.list_(pa.int64()))
        return pa.table({
            "rng": pa.array([rows["key"][0].as_py()], pa.int64()), "grps": one(rows["grp"].to_pylist()), "counts": one(counts),
            "numbers": pa.array([pk.planes(np.concatenate(numbers))], pa.binary()), "pieces": pa.ListArray.from_arrays(pa.array([0, len(known)], pa.int32()), lists),
        })

    return run


def gather(flat: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(concatenated runs flat[at[i]:at[i + 1]] for i in which, lengths)."""
    n = at[which + 1] - at[which]
    before = np.cumsum(n) - n
    return flat[np.arange(int(n.sum())) + np.repeat(at[which] - before, n)], n


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            coded = batch["coded"][i].values
            flat, at = coded.flatten().to_numpy(zero_copy_only=False).astype(np.uint32), coded.offsets.to_numpy().astype(np.int64)
            at = at - at[0]
            numbers = pk.unplanes(batch["numbers"][i].as_py(), np.int32)
            ids, sizes, s = [], [], 0
            for n in batch["counts"][i].as_py():
                out, size = gather(flat, at, numbers[s : s + n])
                ids.append(squeeze(pk.planes(out)))
                sizes.append(pk.planes(size.astype(np.uint32)))
                s += n
            grps = batch["grps"][i].as_py()
            yield pa.record_batch([pa.array(grps, pa.int64()), pa.array([batch["rng"][i].as_py()] * len(grps), pa.int64()), pa.array(sizes, pa.binary()), pa.array(ids, pa.binary())], ["grp", "rng", "sizes", "ids"])


class Tokens:
    """The bytes of all ids, side by side."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = [b""] * (max(ranks.values()) + 1)
        for raw, rank in ranks.items():
            tokens[rank] = raw
        self.at = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def decoded(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids, how many each has)."""
        return gather(self.data, self.at, ids)


def binary(data: np.ndarray, size: np.ndarray) -> pa.Array:
    """Byte strings of these sizes from bytes side by side."""
    off = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def _assemble(ranges: int, ranks=None):
    """The ids of every text of a group from the answers to its pieces; with ``ranks`` (shared), decoded again."""

    def run(groups: pa.Table, answers: pa.Table) -> Iterator[pa.RecordBatch] | pa.Table:
        names = ["doc_id", "n_tokens", "ids"] + ["decoded"] * (ranks is not None)
        if not groups.num_rows or not groups["texts"][0].is_valid:  # a range's pieces
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.binary(), pa.binary())][: len(names)], names)
        counts, part, number = (pk.unplanes(x, k) for x, k in zip(pk.unpile(groups["texts"][0].as_py()), (np.int64, np.uint32, np.uint32)))
        found = sorted(zip(answers["rng"].to_pylist(), answers["sizes"].to_pylist(), answers["ids"].to_pylist()))
        sizes = np.concatenate([np.zeros(0, np.int64), *(pk.unplanes(x, np.uint32).astype(np.int64) for _, x, _ in found)])
        if len(sizes) != len(part):
            raise ValueError(f"{len(sizes)} answers to {len(part)} pieces")
        flat = np.concatenate([np.zeros(0, np.uint32), *(pk.unplanes(unsqueeze(x, 4 * int(pk.unplanes(n, np.uint32).sum())), np.uint32) for _, n, x in found)])
        order = np.argsort(part, kind="stable")  # answers come by range
        n, at = np.empty(len(part), np.int64), np.empty(len(part), np.int64)
        n[order], at[order] = sizes, np.cumsum(sizes) - sizes
        tokens, parts = Tokens(ranks.value) if ranks is not None else None, []
        edge = np.concatenate([[0], np.cumsum(counts)])
        start = 0
        while start < len(counts):  # some texts at a time
            end = max(start + 1, int(np.searchsorted(edge, edge[start] + ASSEMBLE, "right")) - 1)
            own = number[edge[start] : edge[end]]
            size = n[own]
            upto = np.concatenate([[0], np.cumsum(size)])
            ids = flat[np.arange(upto[-1]) + np.repeat(at[own] - upto[:-1], size)]
            each = np.diff(upto[edge[start : end + 1] - edge[start]])
            columns = [groups["ids"][0].values.slice(start, end - start), pa.array(each), binary(ids.view(np.uint8), 4 * each)]
            if tokens is not None:
                data, width = tokens.decoded(ids)
                total = np.concatenate([[0], np.cumsum(width)])
                columns.append(binary(data, np.diff(total[np.concatenate([[0], np.cumsum(each)])])))
            parts.append(pa.record_batch(columns, names))
            start = end
        return pa.Table.from_batches(parts)

    return run


def encode(docs: DataFrame, vocabulary: Ranks, pattern: str, decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) of every row of ``docs`` (doc_id, text).

    With ``decoded``, also what ``decode`` gives for the ids, in the same pass.  The rows of ``docs`` must come in the same
    order when they are read again, as those of files and tables do.
    """
    arrow_limits(docs.sparkSession)
    _, size = text_bytes(docs)
    ranges = ranges_for(size, RANGE_BYTES)
    # one exchange for pieces and texts, which both uses below read
    split = docs.select("doc_id", "text").mapInArrow(_split(pattern, ranges), SPLIT).groupBy("key")
    distinct = split.applyInArrow(_distinct(vocabulary.byte_ids, vocabulary.unreached), "rng long, grps array<long>, counts array<long>, numbers binary, pieces array<array<long>>")
    coded = distinct.select("rng", "grps", "counts", "numbers", encode_pieces(F.col("pieces"), vocabulary).alias("coded"))
    # an exchange, so that no task runs two Python workers at once
    answers = coded.repartition("rng").mapInArrow(_answer, "grp long, rng long, sizes binary, ids binary").withColumn("key", F.col("grp") + ranges)
    ranks = docs.sparkSession.sparkContext.broadcast(vocabulary.ranks) if decoded else None
    schema = "doc_id long, n_tokens long, ids binary" + ", decoded binary" * decoded
    return split.cogroup(answers.groupBy("key")).applyInArrow(_assemble(ranges, ranks), schema)


def decode(encoded: DataFrame, vocabulary: Ranks) -> DataFrame:
    """doc_id, n_tokens, ids and the bytes they stand for."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary.ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(shared.value)
        for batch in batches:
            texts = [tokens.decoded(np.frombuffer(x.as_py(), "<u4"))[0].tobytes() for x in batch["ids"]]
            yield pa.record_batch([batch["doc_id"], batch["n_tokens"], batch["ids"], pa.array(texts, pa.binary())], ["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")
