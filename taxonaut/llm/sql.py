"""DuckDB SQL of the queries that SQL can express over whole tables.

The others have none: op1, op2, op4, op9 and op10 need tokenizers, models or spans of regular expressions, op8 may
return what an approximate search finds, and op11 needs eigenvectors.
"""

OP3 = r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS start FROM texts WHERE len(words) >= 20),
windows AS (SELECT doc_id, start, sha256(array_to_string(words[start : start + 19], ' ')) AS content FROM starts),
repeats AS (SELECT doc_id, start FROM windows QUALIFY row_number() OVER (PARTITION BY content ORDER BY doc_id, start) > 1),
positions AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM texts),
marked AS (
  SELECT doc_id, word, place, max(start) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM positions LEFT JOIN (SELECT doc_id, start, start AS place FROM repeats) USING (doc_id, place)),
kept AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY place) FILTER (WHERE NOT gone) AS text
  FROM marked GROUP BY doc_id)
SELECT t.doc_id, len(t.words)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k USING (doc_id)
"""

OP5 = r"""
WITH payloads AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS digest FROM pages),
answered AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS answer FROM payloads)
SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(digest, (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id < answer THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < answer THEN answer END AS refers_to
FROM answered
"""

OP6 = r"""
WITH RECURSIVE vectors AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
used AS (
  SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS norm FROM vectors
  WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(v, v) > 0),
links AS (
  SELECT a.vec_id AS src, b.vec_id AS dst FROM used a JOIN used b ON a.vec_id <> b.vec_id
  WHERE list_inner_product(a.v, b.v) / (a.norm * b.norm) >= 0.95),
reached AS (SELECT src AS id, dst AS found FROM links UNION SELECT r.id, l.dst FROM reached r JOIN links l ON l.src = r.found),
least AS (SELECT id, min(found) AS component FROM reached GROUP BY id),
counted AS (SELECT src AS id, count(*) AS n FROM links GROUP BY src)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(component, e.vec_id))::BIGINT AS component_id,
  e.vec_id = least(e.vec_id, coalesce(component, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN least l ON l.id = e.vec_id LEFT JOIN counted c ON c.id = e.vec_id
"""

OP7 = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 2))) AS start FROM texts WHERE len(words) > 0),
shingles AS (SELECT DISTINCT doc_id, md5_number(array_to_string(words[start : start + 3], ' ')) AS shingle FROM starts),
sets AS (SELECT doc_id, count(*) AS n, md5(string_agg(shingle::VARCHAR, ',' ORDER BY shingle)) AS content FROM shingles GROUP BY doc_id),
named AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY content) AS first FROM sets),
unlike AS (SELECT s.doc_id, s.shingle, d.n FROM shingles s JOIN named d ON d.doc_id = s.doc_id AND d.first = d.doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM unlike a JOIN unlike b ON a.shingle = b.shingle AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a AS src, b AS dst FROM shared WHERE 100 * c >= 85 * (na + nb - c) UNION ALL SELECT b, a FROM shared WHERE 100 * c >= 85 * (na + nb - c)),
reached AS (SELECT src AS id, dst AS found FROM links UNION SELECT r.id, l.dst FROM reached r JOIN links l ON l.src = r.found),
least AS (SELECT id, min(found) AS component FROM reached GROUP BY id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(coalesce(first, d.doc_id), coalesce(component, first, d.doc_id))::BIGINT AS component_id
FROM documents d LEFT JOIN named USING (doc_id) LEFT JOIN least l ON l.id = named.first
"""

OP12 = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run
    FROM documents)
  WHERE length(run) >= 7 GROUP BY doc_id, run),
bytes AS (SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS digits FROM runs),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(len(digits) // 2), lambda j: ('0x' || substr(digits, 2 * j + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]))) AS h
  FROM bytes, crc),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
places AS (SELECT word, n, unnest(range(length(word))) AS i FROM words),
holes AS (SELECT word, n, substr(word, 1, i) AS head, substr(word, i + 2) AS tail FROM places),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM holes a JOIN holes b ON a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION SELECT h.word, w.word, w.n FROM holes h JOIN words w ON w.word = h.head || h.tail
  UNION SELECT w.word, h.word, h.n FROM holes h JOIN words w ON w.word = h.head || h.tail),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM pairs GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN other_n >= 10 * w.n THEN other END AS form, CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root FROM formed UNION ALL SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.root FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)
"""

OP13 = r"""
WITH used AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM used q JOIN used c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""

QUERIES = {"op3_substring_dedup": OP3, "op5_warc_revisits": OP5, "op6_embedding_near_dedup": OP6, "op7_ngram_jaccard": OP7, "op12_spelling_variants": OP12, "op13_exact_top_k": OP13}
