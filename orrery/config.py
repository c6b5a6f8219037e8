"""Parameters of index building and search."""

from __future__ import annotations

from dataclasses import dataclass

#: Driver-side arrays of more bytes than this are not broadcast; the work is cut into blocks instead.
BROADCAST_BYTES = 64 << 20


@dataclass(frozen=True)
class SearchParams:
    """clusters: inverted lists; nprobe: lists read per query; k: result size; num_cand: estimates re-ranked by the
    product-code search; logical and physical: buckets of the collector; query_bits: levels of query quantisation."""

    clusters: int = 16
    nprobe: int = 4
    k: int = 10
    num_cand: int = 200
    logical: int = 256
    physical: int = 32
    query_bits: int = 4
    sub_dim: int = 4
    epsilon: float = 1.9

    def __post_init__(self) -> None:
        if min(self.clusters, self.nprobe, self.k, self.logical, self.physical, self.query_bits) < 1:
            raise ValueError("search parameters must be positive")
        if self.physical > self.logical:
            raise ValueError("physical buckets cannot outnumber logical ones")
