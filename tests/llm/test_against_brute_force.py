"""Operators against plain Python on small tables, and against held-out accuracy where they are trained."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest

from orrery.llm import ann, bpe, htmltext, langid, lm, minhash, packing, quality, queries, sharding, substring
from orrery.llm import textblocks as tb

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return queries.documents(spark, SMALL).select("doc_id", "text").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def test_words_and_lines():
    b = tb.words(pa.array(["a bb  ccc\n\na bb", None, "", " x ", "a bb\na bb", "é\x0bz"]))
    assert [bytes(b.data[s:e]).decode() for s, e in zip(b.start, b.end)] == ["a", "bb", "ccc", "a", "bb", "x", "a", "bb", "a", "bb", "é", "z"]
    assert b.h[0] == b.h[3] == b.h[6] and len(set(b.h.tolist())) == 6
    doc, line, _, has = tb.line_hashes(b)
    assert doc.tolist() == [0, 0, 0, 1, 2, 3, 4, 4, 5] and has.tolist() == [True, False, True, False, False, True, True, True, True]
    assert line[2] == line[6] == line[7]


def thue_morse(n):
    """Two words of 2**n letters, which every polynomial hash modulo a power of two confuses from n = 10 on."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("n", [10, 11, 12])
def test_words_that_polynomial_hashes_confuse(spark, n):
    a, b = thue_morse(n)
    rest = " ".join(f"w{i}" for i in range(60))
    block = tb.words(pa.array([a, b]))
    assert len(set(block.h.tolist())) == len(set(block.check.tolist())) == 2
    ids = packing.WordIds(queries.tokenizer("word_bpe_49k.json"))
    plain = [[*ids.tokenizer.encode(x, add_special_tokens=False).ids, 1] for x in (a, b)]
    found, off = ids.encode(pa.array([a, b]))
    assert [found[s:e].tolist() for s, e in zip(off, off[1:])] == plain
    assert set(minhash.shingle_sets(pa.array([a]))[1].tolist()) != set(minhash.shingle_sets(pa.array([b]))[1].tolist())
    rows = pa.table({"text": [f"{a} {b}"]})
    assert len(lm.tokens(rows)[1]) == 3
    texts = {1: f"{a}\n{b}", 2: f"{a} {rest}", 3: f"{b} {rest}"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.n_dup_lines for r in quality.ledger(df).collect()} == {1: 0, 2: 0, 3: 0}
    assert {x.doc_id: (x.n_words, x.n_removed, x.kept_text) for x in substring.remove_repeats(df).collect()} == repeats(texts.items())
    one = spark.createDataFrame([(1, f"{a} x y z u"), (2, f"{b} x y z u")], "doc_id long, text string")
    assert all(r.kept for r in minhash.near_duplicates(one).collect())


def test_pairs_of_hashes_that_share_one():
    keys, checks = np.array([5, 5, 7, 5, 5], np.uint64), np.array([1, 2, 1, 1, 2], np.uint64)
    first, number, counts = tb.distinct(keys, checks)
    assert len(first) == 3 and sorted(counts.tolist()) == [1, 2, 2] and number[0] == number[3] != number[1] == number[4]
    ids = packing.WordIds(queries.tokenizer("word_bpe_49k.json"))
    ids.learn(keys[:3], checks[:3], ["one", "two", "three"])
    assert len({int(x) for x in ids.find(keys, checks)}) == 3 and ids.find(np.array([5, 6], np.uint64), np.array([3, 1], np.uint64)).tolist() == [-1, -1]


def test_bpe_equals_tiktoken_and_round_trips(spark):
    import public_tokenizers as P
    import tiktoken

    ranks = bpe.parse_ranks(queries.tokenizer("byte_bpe_multi_50k.tiktoken"))
    vocabulary = bpe.Ranks(ranks)
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(3)
    pool = [chr(c) for c in [*range(0, 0x250), *range(0x300, 0x310), 0x1C, 0x1F, 0x85, 0xA0, 0x200B, 0x2028, 0x3000, 0x4E2D, 0x1F600, 0xFEFF]]
    rows = [(i, "".join(r.choice(pool if r.random() < 0.5 else list("abc thes'ill vertion ,.!? \n\t0123")) for _ in range(r.randint(0, 120)))) for i in range(200)]
    rows += [(900, None), (901, "a" * 500), (902, "it's don't WE'LL 're''s  '   x"), (903, "<|endoftext|> ordinary")]
    found = bpe.decode(bpe.encode(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), vocabulary, P.PATTERN), vocabulary)
    got = {x.doc_id: (bytes(x.ids), bytes(x.decoded), x.n_tokens) for x in found.collect()}
    for i, t in rows:
        ids = other.encode_ordinary(t or "")
        assert got[i] == (b"".join(struct.pack("<I", x) for x in ids), (t or "").encode(), len(ids))


def test_bpe_keeps_tokens_that_no_merges_reach(spark):
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"bc": 257, b"abcd": 258}
    vocabulary = bpe.Ranks(ranks)
    assert vocabulary.unreached == {"abcd": 258}
    df = spark.createDataFrame([(1, "abcd"), (2, "abc"), (3, "xabcd")], "doc_id long, text string")
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in bpe.encode(df, vocabulary, r"\w+").collect()}
    assert got == {1: [258], 2: [256, 99], 3: [120, 256, 99, 100]}


def repeats(rows):
    first, words = {}, {i: WORD.findall(t or "") for i, t in rows}
    for i in sorted(words):
        for k in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][k : k + 50]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup_on_runs_periods_and_edges(spark, monkeypatch, seed):
    monkeypatch.setattr(substring, "GROUP_BYTES", 20_000)
    monkeypatch.setattr(substring, "RANGE_BYTES", 100_000)
    r, stock = random.Random(seed), []
    for _ in range(120):
        words, base = [f"w{j}" for j in range(r.choice([1, 2, 2, 3, 5, 50, 1000]))], []
        while len(base) < r.randint(60, 300):
            part = [r.choice(words) for _ in range(r.randint(1, 7))]
            base += part * r.randint(1, 12) if r.random() < 0.5 else part
        stock.append(base)
    rows = []
    for i in range(160):
        t = []
        for _ in range(r.randint(1, 4)):
            y, n = r.choice(stock), r.choice([49, 50, 51, 52, 55, 60, 90])
            a = r.randint(0, max(0, len(y) - 50))
            t += y[a : a + n] + [f"u{r.randint(0, 10**6)}" for _ in range(r.randint(0, 9))]
        rows.append((i, " ".join(t)))
    found = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert {x.doc_id: (x.n_words, x.n_removed, x.kept_text) for x in found.collect()} == repeats(rows)


def test_substring_dedup_on_documents(spark, docs, texts):
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_text) for x in substring.remove_repeats(docs).collect()}
    assert got == repeats(texts.items())
    edited = {x.doc_id: x.text for x in substring.edit_repeats(docs).collect()}
    assert all(edited[i] == (texts[i] if not n else kept) for i, (_, n, kept) in got.items())


def test_best_fit_plan_equals_one_by_one():
    r = random.Random(0)
    for limit in (7, 64, 4096):
        lengths = [r.randint(1, limit) if r.random() < 0.8 else r.choice([1, limit, limit // 2 or 1]) for _ in range(600)]
        counts = collections.Counter(lengths)
        plan = packing.best_fit_plan(counts, limit)
        held, rows = collections.defaultdict(list), [tuple(x) for x in plan.tolist()]
        for length, n in counts.items():
            mine = [x for x in rows if x[0] == length]
            for rank in range(n):
                row = [x for x in mine if x[1] <= rank][-1]
                held[row[2] + (rank - row[1]) // row[4]].append((row[3] + (rank - row[1]) % row[4] * length, length))
        for pieces in held.values():
            pieces.sort()
            assert [o for o, _ in pieces] == [sum(x for _, x in pieces[:i]) for i in range(len(pieces))] and sum(x for _, x in pieces) <= limit
        bins = []
        for length in sorted(lengths, reverse=True):
            fits = [i for i, c in enumerate(bins) if c >= length]
            best = min(fits, key=bins.__getitem__) if fits else None
            if best is None:
                bins.append(limit - length)
            else:
                bins[best] -= length
        assert len(held) == len(bins)


def test_packing_ids(spark, docs, texts):
    from tokenizers import Tokenizer

    source = queries.tokenizer("word_bpe_49k.json")
    plain, rows = Tokenizer.from_str(source), collections.defaultdict(list)
    found = packing.pack(docs, source).collect()
    for x in found:
        rows[x.doc_id].append(x)
    for i, text in texts.items():
        ids = [*plain.encode(text, add_special_tokens=False).ids, 1]
        mine = sorted(rows[i], key=lambda x: x.piece)
        assert [(x.start, x.length) for x in mine] == [(s, min(4096, len(ids) - s)) for s in range(0, len(ids), 4096)]
        assert all(x.ids_crc32 == zlib.crc32(b"".join(struct.pack("<I", t) for t in ids[x.start : x.start + x.length])) for x in mine)
    by = collections.defaultdict(list)
    for x in found:
        by[x.sequence_id].append((x.offset, x.length))
    assert all(sorted(v)[i][0] == sum(n for _, n in sorted(v)[:i]) for v in by.values() for i in range(len(v)))
    assert len(by) <= -(-sum(x.length for x in found) // 4096) + 2


def test_base_score_and_tree_normalise(spark, docs, texts):
    rows = {r.doc_id: r for r in lm.score_documents(docs).collect()}
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    tokens = {i: [*WORD.findall(t.translate(lower)), "\0end"] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    c = collections.Counter(w for i in tokens if not held[i] for w in tokens[i])
    n, v = sum(c.values()), len(c)
    for i, w in tokens.items():
        assert rows[i].base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel=1e-9)
        assert (rows[i].held_out, rows[i].n_tokens, rows[i].n_known, rows[i].train_tokens) == (held[i], len(w), sum(c[x] > 0 for x in w), n)
    learned = pa.array([t for i, t in texts.items() if not held[i]])
    tree = reference_tree(learned, 2)
    context = lm.byte_strings(pa.array(["the thing"]))[0][5] & ~np.uint64(255)
    assert (10 ** tree.log10(context | np.arange(256, dtype=np.uint64))).sum() == pytest.approx(1.0, abs=1e-5)


def reference_tree(texts: pa.Array, least: int) -> lm.ContextTree:
    strings, counts = np.unique(lm.byte_strings(texts)[0], return_counts=True)
    keys, zeros, ones = (np.concatenate(x) for x in zip(*(lm.nodes_of(strings, counts, d) for d in range(lm.DEPTH + 1))))
    keep = zeros + ones >= least
    return lm.ContextTree.of(keys[keep], zeros[keep], ones[keep])


def test_distributed_tree_equals_local(spark, docs, texts):
    n_bytes = sum(len(t.encode()) + 1 for t in texts.values())
    tree = lm.fit(docs, n_bytes)
    local = reference_tree(pa.array(list(texts.values())), lm.LEAST)
    assert (tree.keys == local.keys).all() and np.allclose(tree.one, local.one) and np.allclose(tree.own, local.own, atol=1e-6)


def test_scores_of_a_larger_corpus_keep_all_contexts(spark, monkeypatch):
    """Past 512 KB too every context seen twice is kept; scores from ranges equal those of the whole tree."""
    rng = random.Random(3)
    filler = ["".join(rng.choice("abcdefghij ") for _ in range(2000)) for _ in range(500)]
    rare = "Zyx qwv ÿ kjh vut!"
    rows = [*enumerate([*filler, rare, rare, rare, rare, "", None, "never seen: 0123"]), (None, rare)]
    monkeypatch.setattr(lm, "RANGE_BYTES", 1 << 16)
    monkeypatch.setattr(lm, "GROUP_BYTES", 1 << 17)
    monkeypatch.setattr(lm, "PIECE", 1 << 10, raising=False)
    found = lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    learned = pa.array([t for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2])
    assert len(found) == len(rows) and sum(len(t or "") for t in learned.to_pylist()) > 2 << 18
    tree, texts = reference_tree(learned, 2), dict(rows)
    for r in found:
        strings = lm.byte_strings(pa.array([texts[r.doc_id]], pa.string()))[0]
        assert r.score == pytest.approx(tree.log10(strings).sum(), rel=1e-5)


def test_context_tree_weights_by_recursion():
    """Root weight and prediction of a depth-bounded tree, recomputed by the definition for one bit position."""
    texts = pa.array(["abababab", "abba"])
    tree = reference_tree(texts, 1)
    strings, counts = np.unique(lm.byte_strings(texts)[0], return_counts=True)

    def kt(a, b):
        return math.exp(math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi))

    def weighted(depth, match):
        a = sum(int(n) for s, n in zip(strings, counts) if match(int(s)) and not int(s) & 128)
        b = sum(int(n) for s, n in zip(strings, counts) if match(int(s)) and int(s) & 128)
        if depth == lm.DEPTH:
            return kt(a, b), kt(a, b)
        inside = 1.0
        for byte in {int(s) >> 8 * (depth + 1) & 255 for s in strings if match(int(s))}:
            inside *= weighted(depth + 1, lambda s, y=byte: match(s) and (s >> 8 * (depth + 1) & 255) == y)[0]
        return 0.5 * kt(a, b) + 0.5 * inside, kt(a, b)

    total, own = weighted(0, lambda s: True)
    at = np.flatnonzero(tree.keys == np.uint64(1))[0]  # the root of the first bit
    assert tree.own[at] == pytest.approx(0.5 * own / total, rel=1e-5)


def test_quality_measures(spark, docs, texts):
    for r in quality.ledger(docs).collect():
        t = texts[r.doc_id]
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        seen = collections.Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        cover = {p for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        assert r.n_stutters == sum(a == b for a, b in zip(w, w[1:]))
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words, r.n_symbols) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(cover), len(re.findall(r"[#*$%&|<>]", t)))
    entries = quality.ledger(docs)
    report = quality.ablation(entries, "v1").first()
    assert report.kept == quality.apply_policy(entries, "v1").count() and report.too_short_alone <= report.too_short_fails


def test_quality_verdict_follows_labels(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = quality.ledger(queries.documents(spark, "/root/testdata/sf0.1")).join(labels, "doc_id").where("n_words >= 20").select("quality", "rule_bits").collect()
    clean = [r.rule_bits & quality.mask("v1") == 0 for r in rows if r.quality == 1]
    junk = [r.rule_bits & quality.mask("v1") != 0 for r in rows if r.quality == 0]
    assert sum(clean) / len(clean) > 0.98 and sum(junk) / len(junk) > 0.97


def test_nearest_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    table = rows.toPandas()
    ids, x = table.vec_id.to_numpy(), np.array(table.embedding.tolist(), float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    found, hits, total = collections.defaultdict(dict), 0, 0
    for r in ann.nearest(rows).collect():
        found[r.query_id][r.vec_id] = r.score
    for i in np.flatnonzero(ids % 50 == 0):
        s = x @ x[i]
        s[i] = -9
        best = ids[np.argsort(-s, kind="stable")[:5]]
        hits, total = hits + len(set(best) & set(found[ids[i]])), total + 5
        assert all(abs(v - s[np.flatnonzero(ids == k)[0]]) < 1e-12 for k, v in found[ids[i]].items())
    assert hits / total >= 0.95


def neighbours(rows, k=5):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    out = {}
    for i in np.flatnonzero(ids % 50 == 0):
        s = x @ x[i]
        best = [j for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), s[j]) for j in best]
    return out


def found_neighbours(df):
    out = collections.defaultdict(list)
    for r in sorted(ann.nearest(df).collect(), key=lambda r: (r.query_id, r["rank"])):
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_neighbours_of_an_isolated_pair_and_of_copies(spark):
    pair = [(i, [-1.0, 0.0, 0.0]) for i in (0, 1)] + [(i, [1.0, 0.0, 0.0]) for i in range(2, 1000)]
    found = found_neighbours(spark.createDataFrame(pair, "vec_id long, embedding array<double>").repartition(5))
    assert [v for v, _ in found[0]] == [1, 2, 3, 4, 5] and [v for v, _ in found[50]] == [2, 3, 4, 5, 6]
    assert all(len(v) == 5 for v in found.values()) and len(found) == 20
    r = np.random.default_rng(2)
    rows = [(i, (r.standard_normal(8) * 10.0 ** r.integers(-3, 3)).tolist()) for i in range(900)] + [(i, [3.0] * 8) for i in range(900, 1500)]
    df = spark.createDataFrame(rows + rows[:100] + rows[-100:], "vec_id long, embedding array<double>").repartition(5)
    found, true = found_neighbours(df), neighbours(rows)
    assert set(found) == set(true) and all(len(found[q]) == 5 for q in true)
    assert all([v for v, _ in found[q]] == [v for v, _ in true[q]] for q in true if q >= 900)
    hits = sum(len({v for v, _ in found[q]} & {v for v, _ in true[q]}) for q in true)
    assert hits / (5 * len(true)) >= 0.9


def test_queries_whose_walk_ends_early_are_compared_with_all(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST_ROWS", 2)
    monkeypatch.setattr(ann, "BEAM", 1)
    monkeypatch.setattr(ann, "EXACT", 4)
    r = np.random.default_rng(8)
    rows = [(i, r.standard_normal(6).tolist()) for i in range(600)]
    found, true = found_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), neighbours(rows)
    assert all(len(found[q]) == 5 for q in true)


def test_recall_beyond_the_first_level_of_lists(spark, monkeypatch):
    monkeypatch.setattr(ann, "TOP", 16)
    monkeypatch.setattr(ann, "LIST_ROWS", 16)
    monkeypatch.setattr(ann, "GROWTH", 4)
    monkeypatch.setattr(ann, "SAMPLE", 400)
    monkeypatch.setattr(ann, "PART", 256)
    r = np.random.default_rng(6)
    centres = r.standard_normal((60, 24))
    rows = [(i, (centres[r.integers(60)] + 0.5 * r.standard_normal(24)).tolist()) for i in range(6000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4).cache()
    assert ann.list_count(6000) == 309
    graph = ann.fit(ann.usable(df), 6000)
    assert 200 < len(graph.centroids) < 700
    found, true = found_neighbours(df), neighbours(rows)
    hits = sum(len({v for v, _ in found[q]} & {v for v, _ in true[q]}) for q in true)
    assert set(found) == set(true) and hits / (5 * len(true)) >= 0.9


def test_sample_is_never_short(spark):
    from orrery.llm.runtime import hashed_sample

    same = spark.createDataFrame([(1, "x")] * 5000, "a long, b string").repartition(4)
    assert hashed_sample(same, 50, "a", "b").count() == 50 and hashed_sample(same.limit(20), 50, "a", "b").count() == 20


def test_graph_walk_finds_nearest_centroids():
    r = np.random.default_rng(0)
    graph = ann.CentroidGraph.of(ann.unit(r.standard_normal((300, 16))))
    x = ann.unit(r.standard_normal((200, 16)))
    at, d = graph.walk(x, 32)
    true = (x @ graph.centroids.T).argmax(1)
    assert (at[:, 0] == true).mean() > 0.99 and (np.diff(d, axis=1) >= 0).all()


PAGES = {
    "<html><head><title>T</title><script>var x='<p>no</p>';</script></head><body><nav><ul><li><a href=/a>Home</a></li></ul></nav><div class=\"ad\">Buy the best of this and that now.</div>"
    "<article><h1>A &amp; B</h1><p>The house of the man was by the sea and it was not far from the town that he had left.<p>Short.</p><aside>See also</aside></article>"
    "<section id='comments'><article><p>I like this and that of the text and so on.</p></article></section><footer>&copy; x</footer></body></html>":
    "A & B\nThe house of the man was by the sea and it was not far from the town that he had left.\nShort.",
    "<body><!-- <p>hidden</p> --><div class='cookie-banner'>We use the cookies of this site and that one.</div><main><p>One&nbsp;two\n three</p></main></body>": "One two three",
    "<article><p>a</p><form><p>Name</p><input></form><p>b</p></article>": "a\nb",
}


def test_pages():
    for page, text in PAGES.items():
        assert htmltext.main_text(page) == text


def test_language_accuracy_on_held_out(spark):
    table = queries.documents(spark, "/root/testdata/sf0.01")
    found = langid.identify(table).join(table.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert sum(r.lang == r.lang_pred for r in found) / len(found) > 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_network_equals_plain_loops():
    """Forward pass and pooling by loops; the gradient by differences."""
    r = np.random.default_rng(5)
    net = langid.ByteCnn.fresh(["a", "b", "c"])
    for name in ("embed", "out", "bias"):
        setattr(net, name, getattr(net, name).astype(float))
    net.kernels, net.shifts = [k.astype(float) for k in net.kernels], [s + r.standard_normal(len(s)) * 0.1 for s in net.shifts]
    x, y = r.integers(97, 123, (3, langid.WIDTH)).astype(np.uint8), np.array([0, 2, 1])

    def forward(row):
        h = []
        for w, k, s in zip(langid.WIDTHS, net.kernels, net.shifts):
            for f in range(langid.FILTERS):
                z = [sum(net.embed[row[i + j]][d] * k[j * langid.DIM + d, f] for j in range(w) for d in range(langid.DIM)) for i in range(langid.WIDTH - w + 1)]
                h.append(max(max(z) + s[f], 0.0))
        z = [sum(a * b for a, b in zip(h, net.out[:, c])) + net.bias[c] for c in range(3)]
        e = [math.exp(v - max(z)) for v in z]
        return [v / sum(e) for v in e]

    assert net.probabilities(x[:1])[0] == pytest.approx(forward(x[0]), rel=1e-9)
    loss = lambda: -np.log(net.probabilities(x)[np.arange(3), y]).mean()
    for w, g in zip(net.weights, net.gradient(x, y)):
        flat, given = w.reshape(-1), g.reshape(-1)
        for i in {int(np.abs(given).argmax()), *r.integers(0, len(flat), 6).tolist()}:
            held = flat[i]
            flat[i] = held + 1e-6
            up = loss()
            flat[i] = held - 1e-6
            down = loss()
            flat[i] = held
            assert given[i] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-7)


@pytest.mark.parametrize("doc_id", [1, 4, 8])
def test_language_of_many_equal_rows(spark, doc_id):
    df = spark.range(40_000).selectExpr(f"cast({doc_id} as long) doc_id", "'the cat sat on the mat by the door' text", "'en' lang", "1 _has", "2 _lang")
    found = langid.identify(df.repartition(4)).groupBy("lang_pred").count().collect()
    assert [(r.lang_pred, r["count"]) for r in found] == [("en" if zlib.crc32(str(doc_id).encode()) % 4 != 2 else "und", 40_000)]
    if found[0].lang_pred == "en":
        kept = langid.filter_language(df)
        assert kept.columns == df.columns and kept.where("_has = 1 AND _lang = 2").count() == 40_000


def test_shards(spark, docs, texts):
    rows = sharding.shard_by_bytes(docs, 16).collect()
    bins = collections.defaultdict(list)
    for r in rows:
        assert r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        bins[r.shard].append(r)
    mean = sum(r.size for r in rows) / 16
    assert all(abs(sum(r.size for r in b) - mean) <= max(r.size for r in rows) and sorted(r.slot for r in b) == list(range(len(b))) for b in bins.values())


def components(rows):
    lower, sets = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)}), {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(lower))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


@pytest.mark.parametrize("block", [8, 512])
def test_near_duplicates_in_large_borderline_groups(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    r, rows = random.Random(9), []
    for g in range(4):
        base = [f"g{g}w{k}" for k in range(60)]
        for _ in range(30):
            t = list(base)
            for _ in range(r.randint(0, 4)):
                t[r.randrange(len(t))] = f"x{r.randint(0, 9)}"
            rows.append((len(rows) * 3 + 1, " ".join(t).title() if r.random() < 0.3 else " ".join(t)))
    rows += [(5000, "a b"), (5001, "a  B"), (5002, ""), (5003, None), (5004, rows[0][1])]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in found.collect()} == components(rows)


def test_pipeline_rows_against_stages_by_hand(spark, tmp_path):
    """Each stage's decision on its own input, recomputed plainly."""
    import corpus_pipeline

    d = str(tmp_path)
    source = queries.documents(spark, SMALL)
    source.write.parquet(f"{d}/documents.parquet")
    step, held = source, {}
    for name, stage in corpus_pipeline.STAGES:
        held[name] = before = {r.doc_id: r.text or "" for r in step.collect()}
        step = stage(spark, step, d).cache()
        after = {r.doc_id: getattr(r, "text", None) for r in step.collect()}
        if name == "near_dedup":
            assert set(after) == {i for i, (_, _, kept) in components(before.items()).items() if kept}
        elif name == "substring_dedup":
            want = repeats(before.items())
            assert after == {i: kept if n else before[i] for i, (_, n, kept) in want.items()}
        elif name != "best_fit_packing":
            assert set(after) <= set(before) and all(after[i] == before[i] for i in after)
    digest = lambda df: hashlib.sha256(repr(sorted(map(tuple, df.select("doc_id", "piece", "length", "ids_crc32").collect()))).encode()).hexdigest()
    assert digest(corpus_pipeline.run(spark, d)) == digest(step)


def test_rounds_reveal_the_repeats(spark):
    """Symbols grow from round to round, equal passages get equal ones, and without rounds nothing is found."""
    r = random.Random(4)
    passage = [f"p{r.randint(0, 400)}" for _ in range(200)]
    rows = [(i, " ".join([f"u{i}x{k}" for k in range(i)] + passage)) for i in range(4)]
    whole = {i: n for i, (_, n, _) in repeats(rows).items()}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: x.n_removed for x in substring.remove_repeats(df).collect()} == whole and whole[3] == 200
    words, _ = substring.Words.of(pa.table({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]}))
    g, spans = substring.Recompression(words), []
    for n in substring.STEPS:
        g.steps(n)
        here = g.here()
        g.name(np.where(here, np.arange(1, len(here) + 1), 0).astype(np.uint64))
        live = g.symbols.p != 0
        spans.append((g.symbols.past - g.symbols.start)[live].mean())
    assert spans[0] > 1.5 and all(b > 1.15 * a for a, b in zip(spans, spans[1:])) and (g.symbols.past - g.symbols.start)[live].max() >= 8
    at = {int(p): k for k, p in enumerate(g.symbols.p) if p}
    assert len(at) < live.sum() / 3  # the four copies share their symbols
    assert {x.n_removed for x in substring.remove_repeats(df, steps=()).collect()} == {0}
    assert {x.doc_id: x.n_removed for x in substring.remove_repeats(df, steps=(1, 1)).collect()} == whole


def test_groups_pack_every_row_once(spark):
    from orrery.llm import groups

    rows = [(i, "x" * (i % 50)) for i in range(400)] + [(7, "y" * 5000)] * 3 + [(None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = groups.packed(df, 1000).collect()
    assert len({g.grp for g in found}) == len(found)
    parts = [groups.from_blob(g.rows).to_pylist() for g in found]
    assert sorted(((r["doc_id"] or -1, r["text"] or "") for p in parts for r in p)) == sorted((i or -1, t or "") for i, t in rows)
    assert all(sum(len(r["text"] or "") for r in p) <= 1000 or len(p) == 1 for p in parts)
