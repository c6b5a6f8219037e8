"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

#: CRC-32 by bytes, from the reflected polynomial 0xEDB88320.
_CRC = """
crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))
)"""

OP9 = f"""
WITH {_CRC},
d AS (SELECT doc_id, coalesce(text, '') AS s FROM documents),
sized AS (
  SELECT doc_id, CAST(strlen(s) + 1 AS BIGINT) AS size, substr(md5(s), 1, 16) AS key,
         CAST(xor(4294967295, list_reduce(
           list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(s)), '..'), lambda x: CAST('0x' || x AS BIGINT))),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS BIGINT) AS text_crc32
  FROM d, crc_table),
run AS (
  SELECT *, sum(size) OVER (ORDER BY key, doc_id, size, text_crc32 ROWS UNBOUNDED PRECEDING) AS upto,
         sum(size) OVER () AS total, row_number() OVER (ORDER BY key, doc_id, size, text_crc32) AS r FROM sized),
cut AS (SELECT *, CAST(least(15, ((2 * upto - size) * 16) // (2 * total)) AS INTEGER) AS shard FROM run)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, CAST(r - min(r) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM cut
"""

OP5 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS s FROM documents),
w AS (SELECT doc_id, s, regexp_extract_all(s, '[^\x20\x09-\x0D]+') AS ws FROM d),
grams AS (
  SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, l FROM (SELECT doc_id, unnest(string_split(s, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n FROM lines GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(s, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, coalesce(dup.n_lines, 0) AS n_lines,
         CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
         length(regexp_replace(s, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(s, '[^a-z]', '', 'g')) AS n_lower,
         len(list_filter(ws, lambda x: x LIKE '%!!')) AS n_shouts,
         len(list_filter(range(1, greatest(len(ws), 1)), lambda i: ws[i] = ws[i + 1])) AS n_stutters
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id)),
bits AS (
  SELECT *, CAST((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
         + 8 * (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines)::INT + 16 * (n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 20 * n_words))::INT
         + 32 * (n_upper > n_lower)::INT + 64 * (10 * n_shouts > n_words)::INT + 128 * (10 * n_stutters > 3 * n_words)::INT AS BIGINT) AS rule_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, rule_bits & 3 <> 0 AS base_failed, rule_bits = 0 AS kept, rule_bits FROM bits
"""

OP2 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 49), ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d WHERE len(ws) >= 50)),
hit AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY g) AS low FROM win) WHERE low < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM hit),
bad AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
kept AS (
  SELECT doc_id, len(ws) AS n, coalesce(len(ps), 0) AS r,
         CASE WHEN ps IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(ps, i)) END AS k
  FROM d LEFT JOIN bad USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(r AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM kept
"""

OP10 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, hash(g) AS g FROM (
    SELECT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS g
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM d WHERE len(ws) > 0))),
n AS (SELECT doc_id, count(*) AS c FROM sh GROUP BY doc_id),
inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM inter JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.c + y.c - i)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, seen) AS (
  SELECT a, a FROM both_ways UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON e.a = r.seen),
low AS (SELECT doc_id, min(seen) AS m FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(c, 0) AS BIGINT) AS n_shingles, coalesce(m, d.doc_id) AS component_id, coalesce(m, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN low ON low.doc_id = d.doc_id
"""

#: The article of these pages is one element whose blocks are h1 and p; entities are the five that escaping makes.
OP7 = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)(</article>|<footer>|$)', 1, 's') AS s FROM pages),
b AS (SELECT page_id, url, list_transform(string_split_regex(s, '</?(p|h1)>'), lambda x:
  trim(regexp_replace(replace(replace(replace(replace(regexp_replace(replace(regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g'),
    '&quot;', '"'), '&amp\b;?', chr(1), 'g'), '&lt;', '<'), '&gt;', '>'), '&#x27;', chr(39)), chr(1), '&'), '\s+', ' ', 'g'))) AS bs FROM a),
t AS (SELECT page_id, url, coalesce(array_to_string(list_filter(bs, lambda x: x <> ''), chr(10)), '') AS text FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM t
"""

#: Brute force; the approximate search misses none of these on small tables.
OP6 = r"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
n AS (SELECT vec_id, e, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda a, x: a + x)) AS s FROM v),
p AS (
  SELECT q.vec_id AS query_id, x.vec_id AS vec_id, list_reduce(list_transform(list_zip(q.e, x.e), lambda p: p[1] * p[2]), lambda a, y: a + y) / (q.s * x.s) AS score
  FROM n q JOIN n x ON x.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0 AND q.s > 0 AND x.s > 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank" FROM p)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 5
"""

ORACLES: dict[str, str] = {"op2_substring_dedup": OP2, "op5_quality_rules": OP5, "op6_nearest_neighbours": OP6, "op7_html_extraction": OP7, "op9_sharding": OP9, "op10_minhash_near_dedup": OP10}
