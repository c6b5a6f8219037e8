"""DuckDB SQL that gives the rows of the registered vector queries."""

from __future__ import annotations


def l2(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]))"


def minus(a: str, b: str) -> str:
    return f"list_transform(list_zip({a}, {b}), lambda p: p[1] - p[2])"


def word(r: str) -> str:
    """Signs of 64 entries as a signed 64-bit word, entry 0 the highest bit."""
    u = f"list_reduce(list_transform({r}, lambda x: (x > 0)::INT::UBIGINT), lambda a, b: (a << 1) | b)"
    return f"CAST(CASE WHEN {u} >= 9223372036854775808 THEN {u}::HUGEINT - 18446744073709551616 ELSE {u}::HUGEINT END AS BIGINT)"


def bits(r: str) -> str:
    return f"list_sum(list_transform({r}, lambda x: (x > 0)::INT))"


_V = """v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
q AS (SELECT vec_id AS qid, e AS q FROM v WHERE vec_id % 50 = 0),
c AS (SELECT vec_id::INT AS cluster_id, e AS cen FROM v WHERE vec_id < 16)"""
_TRUTH = f"""pairs AS (SELECT qid, vec_id, {l2("q", "e")} AS dist FROM q, v),
truth AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS rank FROM pairs) WHERE rank <= 10)"""
_LISTS = f"""near AS (SELECT vec_id, e, cluster_id, cen, {l2("e", "cen")} AS d2 FROM v, c),
a AS (SELECT vec_id, e, cluster_id, cen, d2 FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, cluster_id) AS n FROM near) WHERE n = 1)"""
_PROBES = f"""all_probes AS (SELECT qid, q, cluster_id, cen, sqr_y, row_number() OVER (PARTITION BY qid ORDER BY sqr_y, cluster_id) AS rank
  FROM (SELECT qid, q, cluster_id, cen, {l2("q", "cen")} AS sqr_y FROM q, c)),
p AS (SELECT * FROM all_probes WHERE rank <= 4)"""
_IVF = f"""hits AS (SELECT p.qid, p.rank AS list_rank, a.vec_id, {l2("p.q", "a.e")} AS dist FROM all_probes p JOIN a USING (cluster_id)),
found AS (SELECT * FROM (SELECT qid, vec_id, dist, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS rank FROM hits WHERE list_rank <= 4) WHERE rank <= 10)"""
_SIZES = "s AS (SELECT cluster_id, count(*) AS n FROM a GROUP BY cluster_id)"
_HADAMARD = """had AS (SELECT list(col ORDER BY i) AS h FROM (
  SELECT i, list(CASE WHEN bit_count(i & j) % 2 = 0 THEN 0.125::DOUBLE ELSE -0.125::DOUBLE END ORDER BY j) AS col
  FROM (SELECT unnest(range(64)) AS i), (SELECT unnest(range(64)) AS j) GROUP BY i))"""


def turned(r: str) -> str:
    return f"list_transform(h, lambda col: list_sum(list_transform(list_zip({r}, col), lambda p: p[1] * p[2])))"


_CODES = f"""r AS (SELECT vec_id, cluster_id, {turned(minus("e", "cen"))} AS r FROM a, had),
r1 AS (SELECT vec_id, cluster_id, r, sqrt({dot("r", "r")}) AS d_c, list_sum(list_transform(r, lambda x: abs(x))) AS l1, {bits("r")} AS ones FROM r),
r2 AS (SELECT *, CASE WHEN d_c > 0 THEN l1 / (8.0::DOUBLE * d_c) ELSE 0.8::DOUBLE END AS x0, d_c * d_c AS sqr_x FROM r1),
r3 AS (SELECT *, 2 * 1.9::DOUBLE / sqrt(63.0::DOUBLE) * sqrt(greatest((d_c / x0) * (d_c / x0) - sqr_x, 0)) AS error, -2 * (d_c / x0) / 8.0::DOUBLE AS factor_ip FROM r2),
code AS (SELECT *, factor_ip * (2 * ones - 64) AS factor_ppc FROM r3)"""
_PREPARED = f"""t0 AS (SELECT qid, rank, cluster_id, {turned(minus("q", "cen"))} AS t FROM p, had),
t1 AS (SELECT *, {dot("t", "t")} AS sy, list_min(t) AS low, (list_max(t) - list_min(t)) / 15 AS width FROM t0),
prep AS (SELECT *, CASE WHEN width > 0 THEN list_transform(t, lambda x: CAST(floor((x - low) / width + 0.5::DOUBLE) AS BIGINT)) ELSE list_transform(t, lambda x: 0::BIGINT) END AS qcode FROM t1),
prepared AS (SELECT *, list_sum(qcode) AS sum_q FROM prep)"""
_IP = "list_sum(list_transform(list_zip(qcode, r), lambda p: CASE WHEN p[2] > 0 THEN p[1] ELSE 0 END))"
_SCORED = f"""ip AS (SELECT qid, rank, vec_id, sqr_x, sy, factor_ppc, low, {_IP} AS ip, sum_q, factor_ip, width, error FROM prepared JOIN code USING (cluster_id)),
est AS (SELECT qid, rank, vec_id, sqr_x + sy + factor_ppc * low + (2 * ip - sum_q) * factor_ip * width AS est, error * sqrt(sy) AS bound FROM ip),
scored AS (SELECT qid, rank, vec_id, est, est - bound AS lb, est + bound AS ub FROM est)"""


def _sub(v: str, m: str) -> str:
    return f"list_slice({v}, 4 * {m} + 1, 4 * {m} + 4)"


_BOOK = f"""pieces AS (SELECT unnest(range(16)) AS m),
book AS (SELECT m, cluster_id AS j, {_sub("cen", "m")} AS w FROM c, pieces)"""
_PQ_CODES = f"""pr AS (SELECT vec_id, cluster_id, m, {_sub("res", "m")} AS t FROM (SELECT vec_id, cluster_id, {minus("e", "cen")} AS res FROM a), pieces),
pqc AS (SELECT vec_id, cluster_id, m, j FROM (
  SELECT vec_id, cluster_id, m, j, row_number() OVER (PARTITION BY vec_id, m ORDER BY d, j) AS n
  FROM (SELECT vec_id, cluster_id, m, j, {l2("t", "w")} AS d FROM pr JOIN book USING (m))) WHERE n = 1)"""
_PQ_LUT = f"""lut AS (SELECT qid, cluster_id, m, j, {l2("t", "w")} AS x FROM (
  SELECT qid, cluster_id, m, {_sub("res", "m")} AS t FROM (SELECT qid, cluster_id, {minus("q", "cen")} AS res FROM p), pieces) JOIN book USING (m))"""
_PQ_EST = """pqe AS (SELECT qid, vec_id, list_sum(list(x ORDER BY m)) AS est FROM lut JOIN pqc USING (cluster_id, m, j) GROUP BY qid, vec_id)"""
_COLLECT = f"""e AS (SELECT qid, list_rank AS rank, vec_id, dist AS est FROM hits WHERE list_rank <= 4),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY est, vec_id) AS nth FROM e WHERE rank <= 1) WHERE nth <= 10),
cb AS (SELECT qid, min(est) AS low, (max(est) + 1e-5::DOUBLE - min(est)) / 256 AS delta FROM first GROUP BY qid),
b AS (SELECT qid, vec_id, CAST(CASE WHEN delta > 0 THEN greatest(0, least(255, floor((est - low) / delta))) ELSE 0 END AS INT) AS bucket FROM e JOIN cb USING (qid)),
h AS (SELECT qid, bucket, count(*) AS n FROM b GROUP BY 1, 2),
hu AS (SELECT *, CAST(sum(n) OVER (PARTITION BY qid ORDER BY bucket) AS BIGINT) AS upto, sum(n) OVER (PARTITION BY qid) AS tot FROM h)"""


def scored(nprobe: int) -> tuple[str, ...]:
    return _LISTS, _PROBES.replace("rank <= 4", f"rank <= {nprobe}"), _HADAMARD, _CODES, _PREPARED, _SCORED


def books(source: str, k: int) -> str:
    """Ranges and physical buckets of each query from the k smallest estimates in its nearest list."""
    return f"""sample AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY est, vec_id) AS nth FROM {source} WHERE rank <= 1) WHERE nth <= {k}),
book_range AS (SELECT qid, min(est) AS low, (max(est) + 1e-5::DOUBLE - min(est)) / 256 AS delta, count(*) AS total FROM sample GROUP BY qid),
depths AS (SELECT qid, greatest(0, least(255, floor((est - low) / delta)))::INT AS b, count(*) AS n FROM sample JOIN book_range USING (qid) GROUP BY 1, 2),
lut AS (SELECT qid, b, least(31, ((upto - n) * 32) // total)::INT AS code FROM (
  SELECT r.qid, l.b, coalesce(d.n, 0) AS n, r.total, sum(coalesce(d.n, 0)) OVER (PARTITION BY r.qid ORDER BY l.b) AS upto
  FROM book_range r, (SELECT unnest(range(256)) AS b) l LEFT JOIN depths d ON d.qid = r.qid AND d.b = l.b))"""


def classes(nprobe: int, k: int) -> tuple[str, ...]:
    at = lambda x: f"CASE WHEN delta > 0 THEN greatest(0, least(255, floor(({x} - low) / delta)))::INT ELSE 0 END"
    return *scored(nprobe), books("scored", k), f"""ends AS (SELECT s.*, coalesce({at("lb")}, 255) AS l_lb, coalesce({at("ub")}, 255) AS l_ub FROM scored s LEFT JOIN book_range USING (qid)),
bk AS (SELECT e.qid, e.vec_id, e.lb, coalesce(x.code, 31) AS b_lb, coalesce(y.code, 31) AS b_ub FROM ends e LEFT JOIN lut x ON x.qid = e.qid AND x.b = e.l_lb LEFT JOIN lut y ON y.qid = e.qid AND y.b = e.l_ub),
hist AS (SELECT qid, b_ub, sum(count(*)) OVER (PARTITION BY qid ORDER BY b_ub) AS upto FROM bk GROUP BY 1, 2),
th AS (SELECT qid, coalesce(min(CASE WHEN upto >= {k} THEN b_ub END), 31) + 1 AS th FROM hist GROUP BY qid),
safe AS (SELECT qid, min(b_lb) AS safe FROM bk JOIN th USING (qid) WHERE b_ub >= th - 1 AND b_lb < th GROUP BY qid),
cls AS (SELECT bk.*, CASE WHEN b_lb >= th THEN 'drop' WHEN b_ub < least(coalesce(safe, th - 1), th - 1) THEN 'accept' ELSE 'verify' END AS class
  FROM bk JOIN th USING (qid) LEFT JOIN safe USING (qid))"""


def bound_search(nprobe: int, k: int) -> str:
    return sql(f"""SELECT qid, CAST(rank AS INT) AS rank, vec_id, round(dist, 5) AS dist FROM (SELECT qid, vec_id, dist, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS rank FROM (
      SELECT s.qid, s.vec_id, {l2('q.q', 'v.e')} AS dist FROM scored s LEFT JOIN lim USING (qid) JOIN q ON q.qid = s.qid JOIN v ON v.vec_id = s.vec_id WHERE lim.ub IS NULL OR s.lb <= lim.ub)) WHERE rank <= {k}""",
      *scored(nprobe), f"lim AS (SELECT qid, ub FROM (SELECT qid, ub, row_number() OVER (PARTITION BY qid ORDER BY ub, vec_id) AS n FROM scored) WHERE n = {k})")


def bucket_search(nprobe: int, k: int) -> str:
    return sql(f"""SELECT qid, CAST(rank AS INT) AS rank, vec_id, round(dist, 5) AS dist, exact FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY exact, dist, vec_id) AS rank FROM (
      SELECT qid, vec_id, lb AS dist, false AS exact FROM cls WHERE class = 'accept' UNION ALL
      SELECT cls.qid, cls.vec_id, {l2('q.q', 'v.e')}, true FROM cls JOIN q ON q.qid = cls.qid JOIN v ON v.vec_id = cls.vec_id WHERE class = 'verify')) WHERE rank <= {k}""",
      *classes(nprobe, k))


def pq_search(nprobe: int, num_cand: int, k: int) -> str:
    best = f"""best AS (SELECT qid, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY est, vec_id) AS n FROM pqe) WHERE n <= {num_cand}),
exact AS (SELECT qid, vec_id, dist, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS rank FROM (
  SELECT b.qid, b.vec_id, {l2("q.q", "v.e")} AS dist FROM best b JOIN q ON q.qid = b.qid JOIN v ON v.vec_id = b.vec_id))"""
    lists = _PROBES.replace("rank <= 4", f"rank <= {nprobe}")
    return sql(f"SELECT qid, CAST(rank AS INT) AS rank, vec_id, round(dist, 5) AS dist FROM exact WHERE rank <= {k}", _LISTS, lists, _BOOK, _PQ_CODES, _PQ_LUT, _PQ_EST, best)


def sql(select: str, *ctes: str) -> str:
    return f"WITH {', '.join([_V, *ctes])} {select}"


def entries(source: str, column: str, keys: str, *ctes: str) -> str:
    return sql(f"SELECT {keys}, CAST(i AS INT) AS i, round({column}[i + 1], 5) + 0.0::DOUBLE AS x FROM (SELECT {keys}, {column}, unnest(range(len({column}))) AS i FROM {source})", *ctes)


_NO_COUNT = "SELECT bin, round(low, 5) AS low, round(high, 5) AS high, lists FROM hb"
ORACLES: dict[str, str] = {
    "exact_knn_join": sql("SELECT qid, CAST(rank AS INT) AS rank, vec_id, round(dist, 5) AS dist FROM truth", _TRUTH),
    "exact_knn_single": sql(f"SELECT vec_id, round(dist, 5) AS dist FROM (SELECT v.vec_id, {l2('v.e', 'z.e')} AS dist FROM v, (SELECT e FROM v WHERE vec_id = 0) z) t ORDER BY t.dist, vec_id LIMIT 100"),
    "inf_check": "SELECT count(*) AS n, CAST(sum(CASE WHEN len(list_filter(embedding, lambda x: isinf(x))) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_inf FROM embeddings",
    "pad_vectors": entries("(SELECT vec_id, list_concat(e, list_transform(range(72 - len(e)), lambda x: 0.0::DOUBLE)) AS w FROM v)", "w", "vec_id"),
    "vector_norms": sql(f"SELECT vec_id, round(sqrt({dot('e', 'e')}), 5) AS norm, round({dot('e', 'e')}, 5) AS sqr_norm, round({dot('e', 'e')}, 5) AS self_dot FROM v"),
    "normalize_vectors": entries("(SELECT vec_id, list_transform(g, lambda x: x / n) AS w FROM (SELECT vec_id, g, sqrt(" + dot("g", "g") + ") AS n FROM (SELECT vec_id, list_transform(e, lambda x: x / 0.5::DOUBLE) AS g FROM v)))", "w", "vec_id"),
    "vector_arithmetic": sql("SELECT vec_id, round(list_sum(list_transform(list_zip(e, list_reverse(e)), lambda p: p[1] + p[2])), 5) AS sum_reversed, round(list_sum(list_transform(e, lambda x: x / 4)), 5) AS quarter_sum FROM v"),
    "residuals": entries("res", "w", "vec_id, cluster_id", _LISTS, f"res AS (SELECT vec_id, cluster_id, {minus('e', 'cen')} AS w FROM a)"),
    "residual_norms": sql("SELECT vec_id, cluster_id, round(d2, 5) AS sqr_norm FROM a", _LISTS),
    "sign_code_words": sql(f"SELECT vec_id, {word(minus('e', 'cen'))} AS word0 FROM a", _LISTS),
    "popcount_codes": sql(f"SELECT vec_id, CAST({bits(minus('e', 'cen'))} AS INT) AS bits FROM a", _LISTS),
    "binary_inner_product": sql("SELECT qid, vec_id, CAST(list_sum(list_transform(list_zip(q, e), lambda p: (p[1] > 0 AND p[2] > 0)::INT)) AS INT) AS ip FROM p JOIN a USING (cluster_id)", _LISTS, _PROBES),
    "byte_binary_inner_product": sql("SELECT qid, vec_id, CAST(ip AS BIGINT) AS ip, CAST(ip AS BIGINT) AS ip_direct FROM ip", _LISTS, _PROBES, _HADAMARD, _CODES, _PREPARED, _SCORED),
    "vector_gather": sql("SELECT vec_id, round(list_sum(e), 5) AS total FROM v WHERE vec_id IN (SELECT vec_id FROM truth)", _TRUTH),
    "assign_nearest_centroid": sql("SELECT vec_id, cluster_id, round(sqrt(d2), 5) AS dist_to_c FROM a", _LISTS),
    "cluster_sizes": sql("SELECT * FROM s", _LISTS, _SIZES),
    "cluster_stats": sql("SELECT count(*) AS clusters, CAST(sum(n) AS BIGINT) AS vectors, round(avg(n), 5) AS mean_size, max(n) AS max_size, min(n) AS min_size FROM s", _LISTS, _SIZES),
    "cluster_size_histogram": sql(_NO_COUNT, _LISTS, _SIZES, """sp AS (SELECT min(n) AS lo, max(n) AS hi, (max(n) - min(n)) / 10.0::DOUBLE AS w FROM s),
      hb AS (SELECT bin, lo + bin * w AS low, lo + (bin + 1) * w AS high, count(*) AS lists FROM (SELECT lo, w, CAST(CASE WHEN w > 0 THEN least(9, floor((n - lo) / w)) ELSE 0 END AS INT) AS bin FROM s, sp) GROUP BY bin, lo, w)"""),
    "inverted_lists": sql("SELECT cluster_id, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY vec_id) - 1 AS INT) AS place, vec_id FROM a", _LISTS),
    "coarse_probe": sql("SELECT qid, CAST(rank AS INT) AS rank, cluster_id, round(sqr_y, 5) AS sqr_y FROM p", _PROBES),
    "ivf_flat_search": sql("SELECT qid, CAST(rank AS INT) AS rank, vec_id, round(dist, 5) AS dist FROM found", _LISTS, _PROBES, _IVF),
    "radius_join": sql("SELECT qid, vec_id, round(dist, 5) AS dist FROM pairs WHERE dist <= 1.2", _TRUTH),
    "ground_truth_topk": sql("SELECT qid, array_to_string(list(vec_id ORDER BY vec_id), ',') AS gt FROM truth GROUP BY qid", _TRUTH),
    "recall_at_k": sql("SELECT t.qid, count(f.vec_id) AS hits, round(count(f.vec_id) / count(*), 5) AS recall FROM truth t LEFT JOIN found f ON f.qid = t.qid AND f.vec_id = t.vec_id GROUP BY t.qid", _TRUTH, _LISTS, _PROBES, _IVF),
    "mean_recall": sql("SELECT count(*) AS queries, round(avg(r), 5) AS recall FROM (SELECT t.qid, count(f.vec_id) / count(*) AS r FROM truth t LEFT JOIN found f ON f.qid = t.qid AND f.vec_id = t.vec_id GROUP BY t.qid)", _TRUTH, _LISTS, _PROBES, _IVF),
    "distance_ratio": sql("SELECT qid, round(avg(sqrt(f.dist / t.dist)), 5) AS ratio FROM found f JOIN truth t USING (qid, rank) WHERE t.dist > 1e-5 GROUP BY qid", _TRUTH, _LISTS, _PROBES, _IVF),
    "nprobe_sweep_recall": sql("SELECT CAST(nprobe AS INT) AS nprobe, round(avg(r), 5) AS recall FROM (SELECT nprobe, t.qid, count(f.vec_id) / count(*) AS r FROM (SELECT unnest([1, 2, 4, 8, 16]) AS nprobe), truth t LEFT JOIN hits f ON f.qid = t.qid AND f.vec_id = t.vec_id AND f.list_rank <= nprobe GROUP BY nprobe, t.qid) GROUP BY nprobe", _TRUTH, _LISTS, _PROBES, _IVF),
    "rotate_vectors": entries("rot", "w", "vec_id", _HADAMARD, f"rot AS (SELECT vec_id, {turned('e')} AS w FROM v, had)"),
    "signcode_factors": sql(f"SELECT vec_id, cluster_id, {word('r')} AS word0, round(x0, 5) + 0.0::DOUBLE AS x0, round(d_c, 5) + 0.0::DOUBLE AS d_c, round(sqr_x, 5) + 0.0::DOUBLE AS sqr_x, round(error, 5) + 0.0::DOUBLE AS error, round(factor_ip, 5) + 0.0::DOUBLE AS factor_ip, round(factor_ppc, 5) + 0.0::DOUBLE AS factor_ppc FROM code", _LISTS, _HADAMARD, _CODES),
    "quantized_query": sql("SELECT qid, cluster_id, round(sy, 5) AS sqr_y, round(low, 5) AS low, round(width, 5) AS width, array_to_string(qcode, ',') AS qcode, CAST(sum_q AS INT) AS sum_q FROM prepared", _PROBES, _HADAMARD, _PREPARED),
    "signcode_estimate": sql("SELECT qid, vec_id, round(est, 5) AS est, round(lb, 5) AS lb, round(ub, 5) AS ub FROM scored", _LISTS, _PROBES, _HADAMARD, _CODES, _PREPARED, _SCORED),
    "signcode_search": bound_search(4, 10),
    "signcode_search_k1000": bound_search(16, 1000),
    "pq_lut": sql("SELECT qid, cluster_id, CAST(m AS INT) AS m, CAST(j AS INT) AS j, round(x, 5) AS x FROM lut", _PROBES, _BOOK, _PQ_LUT),
    "pq_encode": sql("SELECT vec_id, cluster_id, array_to_string(list(j ORDER BY m), ',') AS pq FROM pqc GROUP BY vec_id, cluster_id", _LISTS, _BOOK, _PQ_CODES),
    "pq_adc_distance": sql("SELECT qid, vec_id, round(est, 5) AS est FROM pqe", _LISTS, _PROBES, _BOOK, _PQ_CODES, _PQ_LUT, _PQ_EST),
    "pq_quantized_distance": sql("SELECT qid, vec_id, round(sum(CAST(floor((x - low) * scale) AS BIGINT)) / any_value(scale) + 16 * any_value(low), 5) AS est FROM lut JOIN rng USING (qid, cluster_id) JOIN pqc USING (cluster_id, m, j) GROUP BY qid, vec_id",
      _LISTS, _PROBES, _BOOK, _PQ_CODES, _PQ_LUT, "rng AS (SELECT qid, cluster_id, min(x) AS low, CASE WHEN max(x) > min(x) THEN 255 / (max(x) - min(x)) ELSE 1.0::DOUBLE END AS scale FROM lut GROUP BY 1, 2)"),
    "bucket_codebook": sql("SELECT qid, round(low, 5) AS low, round(delta, 7) AS delta FROM cb", _LISTS, _PROBES, _IVF, _COLLECT),
    "bucket_histogram": sql("SELECT qid, bucket, n FROM h", _LISTS, _PROBES, _IVF, _COLLECT),
    "bucket_equal_depth": sql("SELECT qid, bucket, n, upto, CAST(least(31, floor((upto - n) / (tot / 32))) AS INT) AS code FROM hu", _LISTS, _PROBES, _IVF, _COLLECT),
    "bucket_threshold": sql("SELECT qid, CAST(coalesce(min(CASE WHEN upto >= 10 THEN bucket END), 256) + 1 AS INT) AS th, CAST(least(coalesce(min(CASE WHEN upto >= 5 THEN bucket END), 256) + 1, coalesce(min(CASE WHEN upto >= 10 THEN bucket END), 256) + 1) AS INT) AS pred FROM hu GROUP BY qid", _LISTS, _PROBES, _IVF, _COLLECT),
    "bucket_topk": sql("SELECT qid, CAST(rank AS INT) AS rank, vec_id, round(dist, 5) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS rank FROM hits WHERE list_rank <= 4) WHERE rank <= 100", _LISTS, _PROBES, _IVF),
    "bound_classify": sql("SELECT qid, class, count(*) AS n FROM cls GROUP BY qid, class", *classes(4, 10)),
    "bound_classify_k500": sql("SELECT qid, class, count(*) AS n FROM cls GROUP BY qid, class", *classes(16, 500)),
    "bucket_rerank": bucket_search(4, 10),
    "bucket_rerank_k500": bucket_search(16, 500),
    "bucket_rerank_k1000": bucket_search(16, 1000),
    "pq_search": pq_search(4, 100, 10),
    "pq_bucket_search": pq_search(4, 100, 10),
    "pq_bucket_search_k500": pq_search(16, 1000, 500),
    "deterministic_sample": "SELECT vec_id FROM embeddings ORDER BY md5('123:' || CAST(vec_id AS VARCHAR)), vec_id LIMIT 200",
}
