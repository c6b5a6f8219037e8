"""Exchange of sorted 64-bit keys between groups of documents and hash ranges, as compact binary rows.

A group of documents sends each distinct key once, however many of its documents hold it, so a key that a
third of all documents share reaches its range as one entry a group.  Ranges cut the (mixed) key space
evenly.  A row is (group, range, number of entries, columns as byte planes): sorted keys as differences,
whose high planes are zero and cost next to nothing after Spark's compression.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute


_CODEC = pa.Codec("zstd", compression_level=3)


def planes(x: np.ndarray) -> bytes:
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() if len(x) else b""


def unplanes(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def cuts(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Offsets at which each of the equal ranges begins in sorted keys."""
    edges = np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def send(group: int, keys: np.ndarray, ranges: int, **columns: np.ndarray) -> pa.Table:
    """Rows of a group for every range that has some of its sorted distinct keys."""
    at = cuts(keys, ranges)
    full = np.flatnonzero(np.diff(at))
    part = lambda x: [planes(x[at[r] : at[r + 1]]) for r in full]
    steps = [planes(np.diff(keys[at[r] : at[r + 1]], prepend=np.uint64(0))) for r in full]
    return pa.table(
        {"grp": pa.array(np.full(len(full), group), pa.int64()), "rng": pa.array(full, pa.int64()), "n": pa.array(np.diff(at)[full], pa.int64()), "keys": pa.array(steps, pa.binary())}
        | {name: pa.array(part(x), pa.binary()) for name, x in columns.items()}
    )


def keys_of(rows: pa.Table) -> np.ndarray:
    return np.concatenate([np.cumsum(unplanes(x, np.uint64)) for x in rows["keys"].to_pylist()]) if rows.num_rows else np.zeros(0, np.uint64)


def column_of(rows: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.concatenate([unplanes(x, kind) for x in rows[name].to_pylist()]) if rows.num_rows else np.zeros(0, kind)


def pile(parts: list[bytes]) -> bytes:
    """Byte strings as one, compressed."""
    raw = b"".join(parts)
    sizes = np.array([len(raw), *map(len, parts)], np.int64)
    return bytes([len(parts)]) + sizes.tobytes() + _CODEC.compress(raw, asbytes=True)


def unpile(blob: bytes) -> list[bytes]:
    n = blob[0]
    total, *sizes = np.frombuffer(blob, np.int64, n + 1, 1).tolist()
    raw = pa.decompress(blob[1 + 8 * (n + 1) :], decompressed_size=total, codec="zstd", asbytes=True)
    ends = np.cumsum(sizes).tolist()
    return [raw[e - s : e] for s, e in zip(sizes, ends)]


def reply(rows: pa.Table, numbers: np.ndarray, kind: int) -> pa.Table:
    """One number an entry, back to the groups that sent the rows; ``kind`` tells the replies of several passes apart.

    Numbers other than 0 must not fall as keys grow: they are sent as differences.
    """
    at = np.concatenate([[0], np.cumsum(rows["n"].to_numpy())])
    raw = []
    for s, e in zip(at[:-1], at[1:]):
        has = numbers[s:e] != 0
        raw.append(pile([np.packbits(has).tobytes(), planes(np.diff(numbers[s:e][has], prepend=np.uint64(0)))]))
    return pa.table({"grp": rows["grp"], "rng": rows["rng"], "n": rows["n"], "numbers": pa.array(raw, pa.binary()), "kind": pa.array(np.full(len(raw), kind), pa.int32())})


def numbers_of(rows: pa.Table, kind: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The replies to a group's n sorted keys, and the ranges that gave them."""
    mine = rows.filter(pa.compute.equal(rows["kind"], kind)).sort_by("rng")
    out = [np.zeros(0, np.uint64)]
    for m, raw in zip(mine["n"].to_pylist(), mine["numbers"].to_pylist()):
        bits, held = unpile(raw)
        has = np.unpackbits(np.frombuffer(bits, np.uint8), count=m).astype(bool)
        part = np.zeros(m, np.uint64)
        part[has] = np.cumsum(unplanes(held, np.uint64))
        out.append(part)
    found = np.concatenate(out)
    if len(found) != n:
        raise ValueError(f"{len(found)} replies to {n} keys")
    return found, np.repeat(mine["rng"].to_numpy().astype(np.uint64), mine["n"].to_numpy())


SENT = "grp long, rng long, n long, keys binary"
REPLIED = "grp long, rng long, n long, numbers binary, kind int"
