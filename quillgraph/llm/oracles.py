"""SQL twins of the corpus queries that SQL can express.

Not expressible, and tested against brute-force versions instead: token counts
(a public tokenizer), SimHash (XXH64), learned models and rule lists, automata.
"""

SQL = {
    "op5_line_dedup": r"""
WITH l AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents WHERE text IS NOT NULL),
w AS (
  SELECT doc_id, text, pos, line AS a,
         lead(line, 1) OVER p AS b, lead(line, 2) OVER p AS c
  FROM l WINDOW p AS (PARTITION BY doc_id ORDER BY pos)),
f AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS nth
  FROM w WHERE c IS NOT NULL AND regexp_matches(a || b || c, '[^\x20\x09-\x0D]')),
gone AS (
  SELECT DISTINCT doc_id, pos + k AS pos FROM f, (SELECT unnest([0, 1, 2]) AS k) WHERE nth > 1),
kept AS (
  SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.pos) FILTER (WHERE gone.pos IS NULL) AS text,
         count(gone.pos) AS n_removed
  FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.pos = gone.pos GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
       coalesce(n_removed, 0) AS n_removed
FROM documents d LEFT JOIN kept ON d.doc_id = kept.doc_id
""",
    "op6_mixing": r"""
WITH z AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS k,
         CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT k, sum(size) AS source_size, min(CASE WHEN source IS NULL THEN 1 ELSE 0 END) AS nosource FROM z GROUP BY k),
o AS (
  SELECT *, CASE (row_number() OVER (ORDER BY nosource, k) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
         2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
c AS (
  SELECT *, cap * sum(weight) OVER (ORDER BY cap / weight, nosource, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
         <= (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, nosource, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight AS capped FROM o),
t AS (
  SELECT k, CAST(source_size AS BIGINT) AS source_size,
         CASE WHEN capped THEN cap ELSE (total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) / sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () * weight END AS target
  FROM c),
r AS (
  SELECT doc_id, k, size, row_number() OVER (
           PARTITION BY k ORDER BY length(CAST(size AS VARCHAR)), substr(CAST(size AS VARCHAR), 1, 2), substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 2), size, doc_id) AS n
  FROM z),
u AS (
  SELECT k, (SELECT sum((instr('0123456789abcdef', substr(md5(t.k || '#7'), i, 1)) - 1) / power(16.0::DOUBLE, i)) FROM (SELECT unnest([1, 2, 3, 4, 5, 6]) AS i)) AS v FROM t),
x AS (
  SELECT r.doc_id, r.size, t.source_size, t.target,
         CAST(floor(v + (t.target / t.source_size) * n) - floor(v + (t.target / t.source_size) * (n - 1)) AS BIGINT) AS copies
  FROM r JOIN t ON r.k = t.k JOIN u ON r.k = u.k)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM x
""",
    "op12_substring_dedup": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, CAST(len(w) AS BIGINT) - 33)) AS pos FROM d WHERE len(w) >= 35),
g AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY array_to_string(w[pos:pos + 34], ' ')) AS n FROM s),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM g, (SELECT unnest(range(35)) AS k) WHERE n > 1),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, CAST(len(w) AS BIGINT) + 1)) AS pos FROM d),
kept AS (
  SELECT x.doc_id, count(gone.pos) AS n_removed, string_agg(word, ' ' ORDER BY x.pos) FILTER (WHERE gone.pos IS NULL) AS kept
  FROM x LEFT JOIN gone ON x.doc_id = gone.doc_id AND x.pos = gone.pos GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
""",
    "op13_lexical_search": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
a AS (SELECT CAST(count(*) FILTER (WHERE len(t) > 0) AS BIGINT) AS docs, CAST(sum(len(t)) AS BIGINT) AS total FROM d),
q AS (
  SELECT item_id, term, count(*) AS often FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY item_id, term),
p AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY doc_id, n, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight FROM p, a GROUP BY term, docs),
s AS (
  SELECT q.item_id, p.doc_id, CAST(sum(q.often * w.weight * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (75 + (25 * p.n * a.docs) // a.total)))) AS BIGINT) AS score
  FROM q JOIN p ON q.term = p.term JOIN w ON q.term = w.term, a GROUP BY q.item_id, p.doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 20
""",
}
