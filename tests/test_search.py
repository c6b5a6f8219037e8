"""Search, collection, re-ranking and training: micro fixtures and invariants that need no oracle."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import vector as V
from orrery.config import SearchParams
from orrery.operators import arrays, collector, evaluate, ivf, knn, pq, scan, signcode, training
from orrery.sources import store, vecs
from orrery.streaming import ingest

N, D, C, Q, K = 400, 64, 8, 10, 10


@pytest.fixture(scope="module")
def data(spark):
    r = np.random.default_rng(1)
    x = r.standard_normal((N, D)).astype(np.float32)
    x[17] = x[3]  # a tie
    base = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>").repartition(3).cache()
    queries = base.where(f"vec_id < {Q}").select(F.col("vec_id").alias("qid"), V.double(F.col("embedding")).alias("q")).cache()
    centres = base.where(f"vec_id >= 20 AND vec_id < {20 + C}").select((F.col("vec_id") - 20).cast("int").alias("cluster_id"), V.double(F.col("embedding")).alias("centroid")).cache()
    return x.astype(float), base, queries, centres


def exact(x, k):
    d = ((x[:Q, None] - x[None]) ** 2).sum(2)
    return {q: [int(i) for i in np.lexsort((np.arange(N), d[q]))[:k]] for q in range(Q)}


def as_lists(found):
    rows = sorted(found.collect(), key=lambda r: (r.qid, r["rank"]))
    return {q: [r.vec_id for r in rows if r.qid == q] for q in {r.qid for r in rows}}


def test_exact_join(data):
    x, base, queries, _ = data
    assert as_lists(knn.exact_knn_join(base, queries, K)) == exact(x, K)
    assert [r.vec_id for r in knn.exact_knn_single(base, x[5].tolist(), 3).collect()] == exact(x, 3)[5]
    everything = knn.exact_knn_join(base, queries, N + 50).groupBy("qid").count().collect()
    assert {r["count"] for r in everything} == {N}


def test_query_parts_give_the_same_rows(data, monkeypatch):
    x, base, queries, centres = data
    monkeypatch.setattr(arrays.query_parts, "__defaults__", ("q", 3 * 8 * D, None))
    assert len(arrays.query_parts(queries)) == 4 and len(arrays.query_parts(queries, each=1 << 20, most=4)) == 3
    assert as_lists(knn.exact_knn_join(base, queries, K)) == exact(x, K)
    assert as_lists(ivf.ivf_flat_search(ivf.assign(base, centres), queries, centres, C, K)) == exact(x, K)
    none = queries.limit(0)
    assert knn.exact_knn_join(base, none, K).count() == 0 and ivf.ivf_flat_search(ivf.assign(base, centres), none, centres, C, K).count() == 0


def test_ivf_is_exact_over_all_lists_and_recall_grows(data):
    x, base, queries, centres = data
    lists, truth = ivf.assign(base, centres).cache(), knn.exact_knn_join(base, queries, K)
    assert as_lists(ivf.ivf_flat_search(lists, queries, centres, C, K)) == exact(x, K)
    recalls = [r.recall for r in evaluate.sweep(scan.flat_search(lists, queries, centres, [1, 3, C], K), truth).orderBy("nprobe").collect()]
    assert recalls == sorted(recalls) and recalls[-1] == 1.0
    ratio = evaluate.distance_ratio(ivf.ivf_flat_search(lists, queries, centres, 2, K), truth).collect()
    assert all(r.ratio >= 1 for r in ratio)
    assert ivf.cluster_stats(lists).first().vectors == N
    near = {(r.qid, r.vec_id) for r in knn.radius_join(base, queries, centres, 90.0).collect()}
    d = ((x[:Q, None] - x[None]) ** 2).sum(2)
    assert near == {(int(a), int(b)) for a, b in np.argwhere(d <= 90.0)}


def test_sign_code_micro_fixture(spark):
    base = spark.createDataFrame([(0, [1.0, 2.0, -1.0, 0.5] + [0.0] * 60, 0)], "vec_id long, embedding array<double>, cluster_id int")
    centres = spark.createDataFrame([(0, [0.0, 1.0, 0.0, 1.0] + [0.0] * 60)], "cluster_id int, centroid array<double>")
    r = signcode.build(base, centres, V.matrix_literal(np.eye(64)), 64).first()
    norm = 3.25**0.5
    assert r.d_c == pytest.approx(norm) and r.x0 == pytest.approx(3.5 / (8 * norm)) and r.code == [3 << 62 if 3 << 62 < 2**63 else (3 << 62) - 2**64]
    assert r.factor_ip == pytest.approx(-2 * norm / r.x0 / 8) and r.factor_ppc == pytest.approx(r.factor_ip * (4 - 64))
    same = signcode.build(base.withColumn("embedding", F.array(*[F.lit(v) for v in [0.0, 1.0, 0.0, 1.0] + [0.0] * 60])), centres, V.matrix_literal(np.eye(64)), 64).first()
    assert same.x0 == 0.8 and same.sqr_x == 0.0 and same.error == 0.0


@pytest.fixture(scope="module")
def scored(data):
    _, base, queries, centres = data
    columns = signcode.rotation_columns(signcode.random_rotation(D))
    codes = signcode.build(ivf.assign(base, centres), centres, columns, D)
    prepared = signcode.quantize_queries(queries, ivf.coarse_probe(queries, centres, C), centres, columns, D)
    return signcode.estimates(codes, prepared).cache()


def test_bounds_cover_the_distance(data, scored):
    x, *_ = data
    rows = scored.collect()
    d = {(r.qid, r.vec_id): ((x[r.qid] - x[r.vec_id]) ** 2).sum() for r in rows}
    assert len(rows) == Q * N and all(r.lb <= r.est <= r.ub for r in rows)
    assert np.mean([r.lb - 1e-9 <= d[r.qid, r.vec_id] <= r.ub + 1e-9 for r in rows]) > 0.88


def sign_search(data, k, nprobe=C, dither=0.5, epsilon=1.9):
    x, base, queries, centres = data
    turn = signcode.random_rotation(D)
    index = signcode.index(ivf.assign(base, centres), centres, turn, epsilon)
    return index, queries, centres, scan.SignEstimator(turn, dither=dither), SearchParams(clusters=C, nprobe=nprobe, k=k)


def test_index_equals_the_expressions(data):
    x, base, queries, centres = data
    index, *_ = sign_search(data, K)
    codes = signcode.build(ivf.assign(base, centres), centres, signcode.rotation_columns(signcode.random_rotation(D)), D)
    a, b = (sorted(df.collect(), key=lambda r: r.vec_id) for df in (index, codes))
    for r, s in zip(a, b, strict=True):
        assert (r.vec_id, r.cluster_id, r.code) == (s.vec_id, s.cluster_id, s.code)
        assert [r[c] for c in ("x0", "d_c", "sqr_x", "error", "factor_ip", "factor_ppc")] == pytest.approx([s[c] for c in ("x0", "d_c", "sqr_x", "error", "factor_ip", "factor_ppc")], rel=1e-9, abs=1e-9)


def test_bound_and_bucket_search(data):
    x, base, queries, _ = data
    truth = exact(x, K)
    for run in (scan.bound_search, scan.collector_search):
        for dither in (0.5, signcode.random_dither(D, 3)):
            got = as_lists(run(*sign_search(data, K, dither=dither)))
            assert all(len(v) == len(set(v)) == K for v in got.values())
            assert np.mean([len(set(got[q]) & set(truth[q])) / K for q in truth]) > 0.9
    few = as_lists(scan.collector_search(*sign_search(data, N * 2)))
    assert all(len(v) == N for v in few.values())
    none = sign_search(data, K)
    assert scan.collector_search(none[0], queries.limit(0), *none[2:]).count() == 0


def test_collector_accepts_without_measuring_and_counts_what_it_measures(data, monkeypatch):
    x, *_ = data
    truth = {q: set(v) for q, v in exact(x, 100).items()}
    args = sign_search(data, 100, epsilon=0.2)  # narrow bounds: these vectors have no structure
    found = scan.collector_search(*args).collect()
    accepted = {(r.qid, r.vec_id) for r in found if not r.exact}
    assert len(accepted) > 5 * Q and np.mean([v in truth[q] for q, v in accepted]) > 0.6
    counts = {(r.qid, r["class"]): r.n for r in scan.collector_counts(*args).collect()}
    assert all(sum(counts.get((q, c), 0) for c in scan.CLASSES) == N for q in range(Q))
    assert sum(n for (_, c), n in counts.items() if c == "accept") == len(accepted)
    assert 0 < sum(n for (_, c), n in counts.items() if c == "verify") < 0.8 * N * Q
    monkeypatch.setattr(arrays, "HELD", 300)  # three queries a block
    again = scan.collector_search(*args).collect()
    plain = lambda rows: sorted((r.qid, r["rank"], r.vec_id, round(r.dist, 6), r.exact) for r in rows)
    assert plain(again) == plain(found)


def test_books_and_thresholds():
    books = scan.Books(np.array([0.0]), np.array([1.0]), np.array([[0, 0, 1, 1]]), 2)
    assert books.code(np.array([0]), np.array([[0, 0.4, 1.9, 2.5, 3.9, 4.0, -1.0]])).tolist() == [[0, 0, 0, 1, 1, 1, 0]]
    assert scan.threshold(np.array([[3, 2, 1, 2]]), 4).tolist() == [2] and scan.threshold(np.array([[3, 2, 1, 2]]), 99).tolist() == [4]
    assert scan.sampled_lists(4) == 1 and scan.sampled_lists(350) == 3
    lower, upper = np.array([[0, 0, 1, 2, 3]]), np.array([[0, 1, 2, 3, 4]])
    assert scan.classes(lower, upper, np.array([3]), np.array([1])).tolist() == [[1, 2, 2, 2, 0]]


def test_best_keeps_the_smallest_of_many():
    r = np.random.default_rng(0)
    best, seen = arrays.Best(2, 7, extra=1), [[], []]
    for _ in range(300):
        for i in (0, 1):
            d, ids = r.integers(0, 50, 20).astype(float), r.integers(0, 10**6, 20)
            best.give(i, d, ids, -d)
            seen[i] += list(zip(d, ids))
    i, d, ids, extra = best.rows()
    assert [sorted(seen[q])[:7] for q in (0, 1)] == [list(zip(d[i == q], ids[i == q])) for q in (0, 1)] and (extra == -d).all()


def test_bucket_micro_fixture(spark):
    d = [0, 0.4, 0.9, 1.2, 1.9, 2.5, 3.9, 4.0]
    rows = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(d)], "qid long, vec_id long, dist double")
    book = spark.createDataFrame([(0, 0.0, 1.0)], "qid long, low double, delta double")
    hist = collector.histogram(collector.with_buckets(rows, book, 4, bucket="dist"))
    assert {r.bucket: r.n for r in hist.collect()} == {0: 3, 1: 2, 2: 1, 3: 2}
    assert collector.threshold(hist, 4, 4).first().th == 2 and collector.threshold(hist, 99, 4).first().th == 5
    assert {r.bucket: r.code for r in collector.equal_depth(hist, 2).collect()} == {0: 0, 1: 0, 2: 1, 3: 1}
    assert [r.vec_id for r in collector.bucket_top_k(rows, 4, 4).orderBy("rank").collect()] == [0, 1, 2, 3]
    flat = spark.createDataFrame([(0, i, 1.0) for i in range(5)], "qid long, vec_id long, dist double")
    assert [r.vec_id for r in collector.bucket_top_k(flat, 3).orderBy("rank").collect()] == [0, 1, 2]


def test_collector_equals_sort(data):
    x, base, queries, _ = data
    pairs = knn.exact_knn_join(base, queries, N).drop("rank")
    for k in (1, 50, N, 2 * N):
        assert as_lists(collector.bucket_top_k(pairs, k)) == exact(x, k)


def test_product_codes(spark, data):
    x, base, queries, centres = data
    lists = ivf.assign(base, centres)
    residuals = training.residuals_of(lists, centres)
    book = training.train_codebook(residuals)
    column = F.from_json(F.lit(str(book.tolist())), "array<array<array<double>>>")
    codes = pq.code_lists(lists, centres, column).cache()
    r = {row.vec_id: np.array(row.r) for row in residuals.collect()}
    for row in codes.limit(20).collect():
        assert row.pq == training.encode_rows(r[row.vec_id][None], book)[0].tolist()
    luts = pq.tables(queries, ivf.coarse_probe(queries, centres, C), centres, column)
    est = pq.estimates(codes, luts).cache()
    index = pq.index(lists, centres, book)
    assert {r.vec_id: r.pq for r in index.collect()} == {r.vec_id: r.pq for r in codes.collect()}
    params = lambda n: SearchParams(clusters=C, nprobe=C, k=K, num_cand=n)
    found = lambda n, collector: as_lists(scan.pq_search(index, queries, centres, scan.PqEstimator(book), params(n), collector))
    assert found(N, False) == found(N, True) == exact(x, K) and found(60, True) == found(60, False)
    gap = est.join(pq.estimates(codes, luts, quantized=True).withColumnRenamed("est", "rough"), ["qid", "vec_id"]).agg(F.max(F.abs(F.col("est") - F.col("rough")))).first()[0]
    assert gap < 5.0


def test_training(data):
    x, base, _, _ = data
    centres = training.train_centroids(base, C).cache()
    assert centres.count() == C
    r = training.residuals_of(ivf.assign(base, centres), centres).cache()
    rotation = training.train_rotation(r, rounds=4)
    assert training.unit_check(rotation) < 1e-8
    rows = arrays.matrix(r.select("r").toArrow()["r"])

    def loss(m):
        y = rows @ m
        book = training.codebook_of(y)
        return ((y - training.decode(training.encode_rows(y, book), book)) ** 2).sum()

    assert loss(rotation) < loss(np.eye(D)) * 1.02
    assert len({v.vec_id for v in ivf.sample_rows(base, 50).collect()} & {v.vec_id for v in ivf.sample_rows(base.repartition(5), 50).collect()}) == 50


@pytest.mark.parametrize("kind,extension", [("float32", "fvecs"), ("int32", "ivecs"), ("uint64", "Ivecs"), ("uint8", "bvecs")])
def test_vector_files_round_trip(spark, tmp_path, kind, extension):
    rows = [(i, [i % 200, (i * 7) % 251, 3]) for i in range(257)]
    if kind == "uint64":
        rows = [(i, [-1 - i, i, 2**40 + i]) for i in range(257)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<long>").repartition(4)
    vecs.write_vecs(df, str(tmp_path / "v"), dtype=kind, order="vec_id", single=True)
    (part,) = [p for p in (tmp_path / "v").iterdir() if p.name.startswith("part-")]
    assert part.suffix == f".{extension}"
    got = vecs.read_vecs(spark, str(part)).orderBy("vec_id").collect()
    assert [(r.vec_id, [int(v) for v in r.embedding]) for r in got] == rows
    raw = np.fromfile(part, np.uint8)
    assert raw[:4].view("<i4")[0] == 3


def test_bad_vector_files_are_rejected(spark, tmp_path):
    (tmp_path / "bad.fvecs").write_bytes(np.array([2, 0, 0, 3, 0, 0], "<i4").tobytes())
    with pytest.raises(Exception, match="different dimensions"):
        vecs.read_vecs(spark, str(tmp_path / "bad.fvecs")).collect()
    (tmp_path / "cut.fvecs").write_bytes(b"\x02\x00\x00\x00\x00\x00")
    with pytest.raises(Exception, match="whole number"):
        vecs.read_vecs(spark, str(tmp_path / "cut.fvecs")).collect()
    (tmp_path / "lists.ivecs").write_bytes(np.array([2, 5, 6, 0, 1, 9], "<i4").tobytes())
    assert [r.embedding for r in vecs.read_vecs(spark, str(tmp_path / "lists.ivecs"), ragged=True).orderBy("vec_id").collect()] == [[5, 6], [], [9]]


def test_command_line(spark, data, tmp_path, capsys):
    from orrery import cli

    x, base, queries, _ = data
    d = str(tmp_path)
    vecs.write_vecs(base, f"{d}/base", order="vec_id", single=True)
    vecs.write_vecs(queries.select(F.col("qid").alias("vec_id"), F.col("q").alias("embedding")), f"{d}/query", order="vec_id", single=True)
    truth = spark.createDataFrame([(q, v) for q, v in exact(x, K).items()], "vec_id long, embedding array<long>")
    vecs.write_vecs(truth, f"{d}/truth", dtype="int32", order="vec_id", single=True)
    file = lambda name: "file://" + str(next((tmp_path / name).glob("part-*")))
    cli.main(["index", "--base", file("base"), "--index", f"{d}/index", "--clusters", str(C), "--seed", "1"], spark)
    for method, extra in (("bucket", ["--dither-seed", "5"]), ("bound", []), ("flat", [])):
        cli.main(["search", "--index", f"{d}/index", "--query", file("query"), "--truth", file("truth"), "--method", method, "--nprobe", str(C), "--k", str(K), "--log", f"{d}/log", *extra], spark)
    rows = spark.read.parquet(f"{d}/log").collect()
    assert {r.method for r in rows} == {"bucket", "bound", "flat"} and all(r.recall > 0.9 for r in rows) and all(r.k == K and r.nprobe == C for r in rows)
    assert next(r for r in rows if r.method == "bucket").avg_rerank > 0
    with pytest.raises(SystemExit):
        cli.main(["search", "--index", f"{d}/index"], spark)


def test_index_store_and_stream(spark, data, tmp_path):
    _, base, queries, centres = data
    lists = ivf.assign(base, centres)
    store.save_index(str(tmp_path / "index"), lists.select("vec_id", "cluster_id", "dist_to_c"), lists.select("vec_id", "cluster_id", "embedding"), {"centroids": centres})
    index = store.load_index(spark, str(tmp_path / "index"), "centroids")
    probes = ivf.coarse_probe(queries, index["centroids"], 2)
    a = as_lists(ivf.ivf_flat_search(store.probed(index["vectors"], probes), queries, index["centroids"], 2, K))
    assert a == as_lists(ivf.ivf_flat_search(lists, queries, centres, 2, K))
    metrics = evaluate.timed("ivf", lambda: ivf.ivf_flat_search(lists, queries, centres, 2, K), knn.exact_knn_join(base, queries, K), Q, counts=None, nprobe=2, k=K)
    assert metrics.first().recall > 0 and metrics.first().task_s > 0 and metrics.first().driver_peak_mb > 0
    store.append_metrics(str(tmp_path / "log"), metrics)
    store.append_metrics(str(tmp_path / "log"), metrics)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    book, rotation = np.random.default_rng(0).random((16, 16, 4)).astype(np.float32), np.eye(64, dtype=np.float32)
    store.write_rotation_bin(str(tmp_path / "m.bin"), book, rotation)
    assert all((p == q).all() for p, q in zip(store.read_rotation_bin(str(tmp_path / "m.bin")), (book, rotation)))
    base.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(base.schema).parquet(str(tmp_path / "in"))
    ingest.append_to_lists(stream, centres, str(tmp_path / "lists"), str(tmp_path / "state")).awaitTermination()
    got = {(r.vec_id, r.cluster_id) for r in spark.read.parquet(str(tmp_path / "lists")).collect()}
    assert got == {(r.vec_id, r.cluster_id) for r in lists.collect()}
