"""Near-duplicate components by min-max hashing.

Each of ``PERMUTATIONS`` hash functions is evaluated once per shingle and gives two signature values, its
minimum and its maximum over the set; both agree between two sets with the Jaccard similarity as
probability.  Bands of four values make candidates: at similarity 0.75 a pair misses all bands with
probability 5e-6.  Every link is confirmed on the full shingle sets.

Rows with equal sets become one class first (its smallest doc_id stands for it).  A band's bucket is joined
to its smallest member only, no pairs are emitted; documents reachable over such unconfirmed steps form a
candidate cluster, which no link leaves.  Clusters are worked on in memory: pairs that share a band, most
similar signature first, are confirmed on full sets unless confirmed links already join them.  A cluster
of more than ``BLOCK`` documents or ``BLOCK_BYTES`` of text is dealt into blocks and every pair of blocks is a
task of its own, so no task holds an unbounded group.  Components of the confirmed links are the result.

Defined results: without words or text a document has no shingles and stays alone; with fewer than five
words its whole sequence is its only shingle; a null doc_id has no component (null) and is kept; rows that
share a doc_id are one document; of equally similar pairs the first by id is confirmed first; texts of any length
are read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm import textblocks as tb
from orrery.llm.runtime import arrow_limits, release, table

SHINGLE, PERMUTATIONS, BANDS = 5, 64, 32
LEAST_PERCENT = 75
#: Of 128 signature values, those that must agree before sets are compared: 5 standard deviations below 0.75.
SIGNATURE_LEAST = 71
#: Documents, and text bytes, of a cluster that one task compares with as many others; text bytes of a bin of small clusters.
BLOCK, BLOCK_BYTES, BIN_BYTES = 512, 4 << 20, 8 << 20
#: Tasks that share the rows of one large cluster.
SALTS = 64
_R = np.random.default_rng(1010)
_XOR = _R.integers(0, 2**64 - 1, PERMUTATIONS, dtype=np.uint64)
_MUL = _R.integers(0, 2**63 - 1, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _R.integers(0, 2**63 - 1, (BANDS, 4), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(b: tb.Block, h: np.ndarray) -> np.ndarray:
    """Hashes of the shingles of every text, from those of its words: all windows, then the short texts' sequences."""
    n = np.diff(b.first)
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    whole = np.zeros(len(short), np.uint64)
    for j in range(SHINGLE - 1):
        more = n[short] > j
        whole[more] = tb.join(whole[more], h[b.first[short[more]] + j], j)
    return np.concatenate([tb.windows(h, SHINGLE)[b.window_at(SHINGLE)], tb.mix(whole)])


def shingle_sets(texts: pa.Array, checks: bool = False) -> tuple[np.ndarray, ...]:
    """(text, hash) of the distinct shingles of every text, sorted; with ``checks`` their second hash too."""
    b = tb.words(texts, lower=True)
    n = np.diff(b.first)
    doc = np.concatenate([b.doc[b.window_at(SHINGLE)], np.flatnonzero((n > 0) & (n < SHINGLE))])
    h = shingles(b, b.h)
    order = np.lexsort((h, doc))
    other = shingles(b, b.check)[order] if checks else None
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    if other is not None:
        new[1:] |= other[1:] != other[:-1]
        return doc[new], h[new], other[new]
    return doc[new], h[new]


def min_max(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts that have shingles, signatures): min and max under each permutation, side by side."""
    have, first = np.unique(doc, return_index=True)
    out = np.empty((len(have), 2 * PERMUTATIONS), np.uint32)
    for k in range(PERMUTATIONS if len(have) else 0):
        x = (((h ^ _XOR[k]) * _MUL[k]) >> np.uint64(32)).astype(np.uint32)
        out[:, 2 * k], out[:, 2 * k + 1] = np.minimum.reduceat(x, first), np.maximum.reduceat(x, first)
    return have, out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    rows = signatures.reshape(len(signatures), BANDS, -1).astype(np.uint64)
    with np.errstate(over="ignore"):
        return tb.mix((tb.mix(rows + np.uint64(1)) * _BAND).sum(2, dtype=np.uint64)).view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (x for whole in batches for x in tb.blocks(whole)):
        doc, *hashes = shingle_sets(batch["text"], checks=True)
        have, signature = min_max(doc, hashes[0])
        first = np.searchsorted(doc, have)
        digest = [np.zeros(batch.num_rows, np.uint64) for _ in range(2)]
        for d, h, salt in zip(digest, hashes, (0x51ED270B, 0xB5297A4D)):
            if len(have):
                d[have] = np.add.reduceat(tb.mix(h ^ np.uint64(salt)), first)
        n = np.bincount(doc, minlength=batch.num_rows).astype(np.int64)
        keys = band_keys(signature).reshape(-1)
        off = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
        size = pa.array(np.diff(tb.buffers(batch["text"])[1]))
        yield pa.record_batch(
            [batch["doc_id"], size, pa.array(n), pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)), pa.ListArray.from_arrays(pa.array(off), pa.array(keys))],
            ["doc_id", "size", "n_shingles", "d1", "d2", "bands"],
        )


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, bytes of the text, n_shingles, a digest of the set and its band keys, for every row."""
    arrow_limits(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_sign, "doc_id long, size long, n_shingles long, d1 long, d2 long, bands array<long>")


def confirmed(doc_id: np.ndarray, texts: pa.Array, bands: np.ndarray) -> list[tuple[int, int]]:
    """Confirmed links among these documents that connect all that are similar; none joins what others join."""
    doc, h = shingle_sets(texts)
    have, signature = min_max(doc, h)
    at = np.searchsorted(doc, np.arange(len(doc_id) + 1))
    sets = [h[at[i] : at[i + 1]] for i in range(len(doc_id))]
    size = np.diff(at)
    small = np.zeros((len(doc_id), 2 * PERMUTATIONS), np.uint8)
    small[have] = tb.mix(signature.astype(np.uint64)).astype(np.uint8)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(len(doc_id) - 1):
        rest = slice(i + 1, len(doc_id))
        low, high = np.minimum(size[i], size[rest]), np.maximum(size[i], size[rest])
        j = np.flatnonzero(100 * low >= LEAST_PERCENT * high) + i + 1  # else too unlike in size
        j = j[(bands[j] == bands[i]).any(1)]
        same = (small[j] == small[i]).sum(1)
        keep = same >= SIGNATURE_LEAST
        found.append((np.full(keep.sum(), i), j[keep], same[keep]))
    if not found:
        return []
    a, b, same = (np.concatenate(x) for x in zip(*found))
    parent = list(range(len(doc_id)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for k in np.argsort(-same, kind="stable").tolist():
        i, j = int(a[k]), int(b[k])
        ri, rj = root(i), root(j)
        if ri == rj:
            continue
        merged = np.concatenate([sets[i], sets[j]])
        merged.sort()
        shared = int((merged[1:] == merged[:-1]).sum())
        if 100 * shared >= LEAST_PERCENT * (len(merged) - shared):
            parent[max(ri, rj)] = min(ri, rj)
            links.append((int(doc_id[i]), int(doc_id[j])))
    return links


def _confirm_bin(bin_: pa.Table) -> pa.Table:
    """Links of all clusters (or pairs of blocks) of one bin."""
    bin_ = bin_.sort_by([("cluster", "ascending"), ("pair", "ascending"), ("doc_id", "ascending")]).combine_chunks()
    n = bin_.num_rows
    cluster, pair = bin_["cluster"].to_numpy(), bin_["pair"].to_numpy()
    cut = np.flatnonzero(np.concatenate([[True], (cluster[1:] != cluster[:-1]) | (pair[1:] != pair[:-1]), [True]])) if n else np.zeros(1, int)
    links: list[tuple[int, int]] = []
    for s, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
        part = bin_.slice(s, e - s).combine_chunks()
        bands = part["bands"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        links += confirmed(part["doc_id"].to_numpy(), part["text"].combine_chunks(), bands)
    a, b = zip(*links) if links else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def components(links: DataFrame) -> DataFrame:
    """id, label (smallest id reachable) of every id in ``links`` (a, b): minimum labels with pointer jumping."""
    spark = links.sparkSession
    edges = table(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = table(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("label")), "labels")
    while True:
        near = (
            edges.join(labels.select(F.col("id").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        )
        lower = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("low"))
        of = labels.select(F.col("id").alias("low"), F.col("label").alias("jump"))
        new = table(lower.join(of, "low").select("id", "old", F.least("low", "jump").alias("label")), "labels")
        release(labels)
        labels = new
        if not new.where("label < old").limit(1).count():
            release(edges)
            return labels.select("id", "label")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text)."""
    signed = table(signatures(docs), "signatures")
    sets = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # written, so that the join has an exchange of its own on either side and a large class can be split
    classes = table(sets.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")), "class_heads")
    classed = table(sets.join(classes, ["d1", "d2"]).select("doc_id", "rep", "size", F.when(F.col("doc_id") == F.col("rep"), F.col("bands")).alias("bands")), "classes")
    reps = classed.where("bands IS NOT NULL")

    keyed = reps.select("doc_id", F.explode("bands").alias("key"))
    buckets = keyed.groupBy("key").agg(F.min("doc_id").alias("b"), F.max("doc_id").alias("last")).where("b < last").drop("last")
    steps = keyed.join(buckets, "key").where("doc_id <> b").select(F.col("doc_id").alias("a"), "b").distinct()
    clusters = components(steps)  # id, label

    # repeated rows of a doc_id are one member, with its longest text
    sized = table(clusters.join(reps.groupBy(F.col("doc_id").alias("id")).agg(F.max("size").alias("size")), "id"), "members")
    bins = max(1, -(-int(sized.agg(F.sum("size")).first()[0] or 0) // BIN_BYTES))
    # only clusters that are cut are joined, their rows dealt over tasks
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") / BLOCK_BYTES)).cast("int")
    large = sized.groupBy("label").agg(blocks.alias("blocks")).where("blocks > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    members = (
        sized.withColumn("salt", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(SALTS)).cast("int")).join(large, ["label", "salt"], "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("pair", F.least("own", "other").cast("long") * F.col("blocks") + F.greatest("own", "other"))
        .select(F.col("label").alias("cluster"), "pair", "id", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("label"), F.lit(bins))).otherwise(-1).alias("small"))
        .withColumn("bin", F.when(F.col("small") >= 0, F.col("small")).otherwise(-1 - F.pmod(F.xxhash64("cluster", "pair"), F.lit(1 << 40))))
    )
    arrow_limits(docs.sparkSession)
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "text")
    whole = (
        members.join(reps.select(F.col("doc_id").alias("id"), "bands"), "id").join(texts, "id")
        .select("bin", "cluster", "pair", F.col("id").alias("doc_id"), "bands", "text")
    )
    links = whole.groupBy("bin").applyInArrow(_confirm_bin, "a long, b long")
    # rows that share a doc_id are one document, so their classes are linked too
    same = classed.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = components(table(links.union(same), "links").distinct())

    rows = signed.select("doc_id", "n_shingles")
    return rows.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"),
        F.coalesce(F.coalesce("label", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their component: its smallest doc_id, one row of it; null ids stay."""
    found = near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    row = F.struct(*docs.columns)  # of the rows of a doc_id the one with the smallest hash; tasks send one row of each
    one = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min_by(row, F.xxhash64(*docs.columns)).alias("row"))
    kept = one.join(found, "doc_id", "left_semi").select("row.*")
    return kept.unionByName(docs.where("doc_id IS NULL"))
