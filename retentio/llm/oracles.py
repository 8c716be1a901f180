"""DuckDB SQL of the operators that SQL can express, written without the operators' code."""

OP2 = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), shared AS (
  SELECT k, min(doc_id) AS keeper FROM keyed WHERE length(k) >= 10
  GROUP BY k HAVING count(DISTINCT doc_id) >= 2
)
SELECT doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE keeper IS NOT NULL AND keeper <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN shared USING (k)
GROUP BY doc_id
"""

OP8 = r"""
WITH cut AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') FROM benchmark
), shingles AS (
  SELECT DISTINCT kind, id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT kind, id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM cut WHERE len(w) > 0)
), sizes AS (SELECT id, count(*) AS n FROM shingles WHERE kind = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, n AS n_shingles, count(*) AS n_shared, count(*)::DOUBLE / n AS containment
FROM shingles d JOIN shingles i ON d.kind = 'd' AND i.kind = 'i' AND d.s = i.s JOIN sizes ON sizes.id = i.id
GROUP BY d.id, i.id, n HAVING 100 * count(*) >= 75 * n
"""


# Sharding: a binary search over capacities that walks one greedy step per recursion, then the cuts.
OP1 = r"""
WITH RECURSIVE bits(k, b, v) AS (
  SELECT 0, b, b FROM range(256) r(b)
  UNION ALL
  SELECT k + 1, b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8
), crc_table AS (SELECT list(v ORDER BY b) AS x FROM bits WHERE k = 8),
crcs AS (
  SELECT t, xor(list_reduce(list_transform(range(strlen(t)), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
                            lambda c, b: xor(c >> 8, x[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS crc
  FROM (SELECT DISTINCT coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h FROM documents), crc_table
), rows AS (
  SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) + 1 AS size,
         md5(coalesce(text, '')) AS grp
  FROM documents
), groups AS (
  SELECT grp, min(doc_id) AS first_id, sum(size)::BIGINT AS bytes FROM rows GROUP BY grp
), ends AS MATERIALIZED (
  SELECT grp, sum(bytes) OVER (ORDER BY first_id, grp)::BIGINT AS e FROM groups
), total AS (SELECT max(e) AS t FROM ends),
search(lo, hi, pos, used) AS (
  SELECT (t + 7) // 8, t, 0::BIGINT, 0 FROM total
  UNION ALL
  SELECT CASE WHEN pos < t AND used = 8 THEN (lo + hi) // 2 + 1 ELSE lo END,
         CASE WHEN pos = t THEN (lo + hi) // 2 ELSE hi END,
         CASE WHEN pos = t OR used = 8 THEN 0
              ELSE greatest(pos, coalesce((SELECT max(e) FROM ends WHERE e <= pos + (lo + hi) // 2), 0)) END,
         CASE WHEN pos = t OR used = 8 THEN 0 ELSE used + 1 END
  FROM search, total WHERE lo < hi
), capacity AS (SELECT min(hi) AS c FROM search WHERE lo >= hi),
tail(j, e) AS (
  SELECT 8, t FROM total
  UNION ALL
  SELECT j - 1, CASE WHEN e - c <= 0 THEN 0 ELSE (SELECT min(x.e) FROM ends x WHERE x.e >= tail.e - c) END
  FROM tail, capacity WHERE j > 1
), cuts(j, e) AS (
  SELECT 0, 0::BIGINT
  UNION ALL
  SELECT cuts.j + 1,
         greatest(cuts.e, coalesce((SELECT max(x.e) FROM ends x WHERE x.e <= least(
           greatest(coalesce((SELECT max(y.e) FROM ends y WHERE y.e <= (SELECT t FROM total) * (cuts.j + 1) // 8), 0), l.e),
           cuts.e + c)), 0))
  FROM cuts JOIN tail l ON l.j = cuts.j + 1, capacity WHERE cuts.j < 7
), placed AS (
  SELECT grp, (SELECT count(*) FROM cuts WHERE cuts.j >= 1 AND cuts.e < ends.e)::INT AS shard FROM ends
)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, NULL::INT AS grown_shard
FROM (SELECT * FROM rows JOIN placed USING (grp) JOIN crcs USING (t))
"""

OP3 = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN first_id END AS refers_to
FROM f
"""

OP7 = r"""
WITH cut AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM cut WHERE len(w) >= 50)
), firsts AS (SELECT s, min(doc_id) AS first_id FROM windows GROUP BY s),
gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS i FROM windows JOIN firsts USING (s) WHERE first_id < doc_id
), words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM cut),
kept AS (
  SELECT words.doc_id, count(*) FILTER (WHERE gone.i IS NOT NULL) AS n_removed,
         string_agg(word, ' ' ORDER BY words.i) FILTER (WHERE gone.i IS NULL) AS t
  FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.i = words.i GROUP BY words.doc_id
)
SELECT cut.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM cut LEFT JOIN kept ON kept.doc_id = cut.doc_id
"""

OP6 = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""

OP10 = r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM cut WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
), groups AS (SELECT a AS doc_id, least(a, min(b)) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id,
       coalesce(component_id, doc_id) = doc_id AS kept
FROM cut LEFT JOIN sizes USING (doc_id) LEFT JOIN groups USING (doc_id)
"""

# Periodic runs: pairs of equal words at most a quarter of the text apart, grouped to stretches by distance.
OP11 = r"""
WITH RECURSIVE bits(k, b, v) AS (
  SELECT 0, b, b FROM range(256) r(b)
  UNION ALL
  SELECT k + 1, b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8
), crc_table AS (SELECT list(v ORDER BY b) AS x FROM bits WHERE k = 8),
cut AS (
  SELECT doc_id, w, len(w) AS n,
         xor(list_reduce(list_transform(range(strlen(doc_id::VARCHAR)), lambda i: ascii(substr(doc_id::VARCHAR, i + 1, 1))::BIGINT),
                         lambda c, b: xor(c >> 8, x[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents), crc_table
), parts AS (
  SELECT doc_id, w, n, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n ELSE n END AS a, h // 10 AS g FROM cut
), words AS MATERIALIZED (
  SELECT doc_id, n, i, w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END] AS word
  FROM (SELECT doc_id, w, n, a, g, unnest(range(n)) AS i FROM parts)
), agree AS (
  SELECT x.doc_id, y.i - x.i AS d, x.i FROM words x JOIN words y
  ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), stretches AS (
  SELECT doc_id, d, min(i) AS start, count(*) + d AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, d ORDER BY i) AS island FROM agree)
  GROUP BY doc_id, d, island HAVING count(*) + d >= greatest(6, 4 * d)
), runs AS MATERIALIZED (
  SELECT doc_id, start, length, min(d) AS period FROM stretches GROUP BY doc_id, start, length
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
), collapsed AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.i) AS t
  FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.i = words.i WHERE gone.i IS NULL GROUP BY words.doc_id
), told AS (
  SELECT doc_id, count(*) AS n_runs, first({'s': start, 'l': length, 'p': period} ORDER BY length DESC, start, period) AS top,
         string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
  FROM runs GROUP BY doc_id
)
SELECT cut.doc_id, coalesce(n_runs, 0) AS n_runs, top.s::BIGINT AS start, top.l::BIGINT AS length, top.p::BIGINT AS period,
       (1000 * top.l // top.p)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM cut LEFT JOIN told ON told.doc_id = cut.doc_id LEFT JOIN collapsed ON collapsed.doc_id = cut.doc_id
"""

OP12 = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""

ORACLES = {"op1_sharding": OP1, "op2_line_dedup": OP2, "op3_warc": OP3, "op6_topk": OP6, "op7_substring_dedup": OP7,
           "op8_decontaminate": OP8, "op10_near_dedup": OP10, "op11_periodic_runs": OP11, "op12_hard_negatives": OP12}
