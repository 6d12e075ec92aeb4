"""SQL twins of the registered graph queries, for an independent engine.

They state each query's meaning directly over the raw tables, sharing only the
derivation of the graph model with ``derive``.
"""

from quillgraph.functions.text import ACCENTED, LOWER, PLAIN, UPPER
from quillgraph.plans.derive import SQL_EDGES, SQL_FILES, SQL_NODES

ROOT = 1003
FUNCTIONAL = "edge_type <> 'ParentOf'"


def with_(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE" if recursive else "WITH") + ",".join(parts)


def impact(root: int, depth: int, types: str = FUNCTIONAL) -> str:
    """Nodes by walking distinct (node, level) pairs upwards."""
    return with_(
        SQL_NODES, SQL_EDGES,
        f"""
e AS (SELECT DISTINCT caller, callee FROM edges WHERE {types}),
walk AS (SELECT {root}::BIGINT AS id, 0 AS depth UNION SELECT e.caller, walk.depth + 1 FROM e JOIN walk ON e.callee = walk.id WHERE walk.depth < {depth}),
lev AS (SELECT id, min(depth)::BIGINT AS depth FROM walk WHERE depth > 0 GROUP BY id)
SELECT code.id, canonical_id, name, node_type, lev.depth FROM lev JOIN code ON code.id = lev.id""", recursive=True,
    )


ORDINAL = "CASE edge_type WHEN 'ProjectReference' THEN 0 WHEN 'ParentOf' THEN 1 WHEN 'MethodCall' THEN 2 WHEN 'Implements' THEN 3 WHEN 'Instantiates' THEN 4 WHEN 'FieldAccess' THEN 5 ELSE 6 END"
LABEL = "CASE edge_type WHEN 'HttpRequest' THEN 'http-request' ELSE lower(edge_type) END"
TYPE = "coalesce(lower(node_type), 'project')"

SCOPE = """
picked AS (SELECT id FROM dirs WHERE path LIKE 'blog.%' AND path NOT LIKE '%/%'),
inside AS (SELECT DISTINCT descendant AS directory_id FROM clos WHERE ancestor IN (SELECT id FROM picked)),
chosen AS (SELECT id FROM nodes WHERE document_id IN (SELECT docs.id FROM docs WHERE directory_id IN (SELECT directory_id FROM inside))),
rest AS (SELECT callee AS id FROM edges WHERE caller IN (SELECT id FROM chosen) UNION SELECT caller FROM edges WHERE callee IN (SELECT id FROM chosen) EXCEPT SELECT id FROM chosen),
both_phases AS (SELECT id, 0 AS phase FROM chosen UNION ALL SELECT id, 1 FROM rest),
scoped AS (SELECT caller, callee, edge_type, CASE WHEN caller IN (SELECT id FROM chosen) AND callee IN (SELECT id FROM chosen) THEN 'internal' ELSE 'boundary' END AS scope
  FROM edges WHERE caller IN (SELECT id FROM chosen) OR callee IN (SELECT id FROM chosen))"""

CORPUS = """
corpus AS (SELECT doc_id AS id, 'doc:' || doc_id AS canonical_id, lang || ' ' || doc_id AS display_name, source || '.' || lang || '.' || doc_id AS fqn, text AS body, source || '/' || doc_id || '.md' AS path, embedding
  FROM documents LEFT JOIN embeddings ON doc_id = vec_id)"""


def terms(column: str) -> str:
    return f"list_filter(regexp_split_to_array(translate(lower({column}), '{ACCENTED}', '{PLAIN}'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def bm25(phrases: list[str]) -> str:
    """BM25 of single-term prefix phrases over the four indexed columns."""
    f = ", ".join(f"len(list_filter(terms, lambda x: starts_with(x, '{p}'))) AS f{i}" for i, p in enumerate(phrases))
    n = ", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS n{i}" for i in range(len(phrases)))
    part = " + ".join(f"greatest(CASE WHEN n{i} < n + 0.5 THEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) ELSE 0 END, 0.000001) * f{i}::DOUBLE * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * size / mean))" for i in range(len(phrases)))
    some = " OR ".join(f"f{i} > 0" for i in range(len(phrases)))
    return f"""
bags AS (SELECT id, canonical_id, list_concat(list_concat({terms("display_name")}, {terms("fqn")}), list_concat({terms("body")}, {terms("path")})) AS terms FROM corpus),
freq AS (SELECT id, canonical_id, len(terms) AS size, {f} FROM bags),
stat AS (SELECT count(*)::DOUBLE AS n, avg(size)::DOUBLE AS mean, {n} FROM freq),
kw AS (SELECT id, canonical_id, {part} AS score FROM freq, stat WHERE {some}),
kwr AS (SELECT id, canonical_id, score, row_number() OVER (ORDER BY score DESC, canonical_id) AS rank FROM kw)"""


PHRASES = ["tion", "reand", "licensed"]
VECTOR = """
q AS (SELECT embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id = 7),
vr AS (SELECT id, canonical_id, list_cosine_similarity(embedding::DOUBLE[], qv) AS sim FROM corpus, q WHERE embedding IS NOT NULL),
vrr AS (SELECT id, canonical_id, sim, row_number() OVER (ORDER BY sim DESC, canonical_id) AS rank FROM vr)"""
NOTES = f"""
notes AS (SELECT lpad(conv_id::VARCHAR, 8, '0') || '-' || lpad(turn::VARCHAR, 4, '0') AS memory_id, conv_id AS id, 'doc:' || conv_id AS canonical_id, c.text AS content, source || '.' || lang || '.' || doc_id AS owner, role, turn,
  CASE turn % 5 WHEN 0 THEN 'Convention' WHEN 1 THEN 'Invariant' WHEN 2 THEN 'Todo' WHEN 3 THEN 'Warning' ELSE 'Decision' END AS intent,
  sha256(d.text) AS now_hash, CASE WHEN turn % 2 = 1 THEN 'x' || sha256(d.text) ELSE sha256(d.text) END AS target_hash
  FROM conversations c JOIN documents d ON doc_id = conv_id)"""


def noted(needle: str, where: str = "TRUE") -> str:
    fold = lambda c: f"translate({c}, '{UPPER}', '{LOWER}')"
    score = f"CASE WHEN contains({fold('content')}, '{needle}') THEN 12 ELSE 0 END + CASE WHEN contains({fold('owner')}, '{needle}') THEN 8 ELSE 0 END + CASE WHEN contains({fold('role')}, '{needle}') THEN 10 ELSE 0 END"
    return f"""
lex AS (SELECT memory_id, id, canonical_id, ({score})::BIGINT AS score FROM notes WHERE {where}),
lexr AS (SELECT *, row_number() OVER (ORDER BY score DESC, canonical_id, memory_id) AS rank FROM lex WHERE score > 0)"""


def fused(*lists: str) -> str:
    union = " UNION ALL ".join(f"SELECT id, canonical_id, rank FROM {name} WHERE rank <= 200" for name in lists)
    return f"""
fused AS (SELECT id, canonical_id, sum(1.0::DOUBLE / (60.0::DOUBLE + rank)) AS score FROM ({union}) GROUP BY id, canonical_id)
SELECT id, row_number() OVER (ORDER BY round(score, 12) DESC, canonical_id) AS rank, round(score, 6) AS score FROM fused QUALIFY rank <= 10"""


LINES = """
li AS (SELECT doc_id AS log_id, unnest(CASE WHEN string_split(text, chr(10))[-1] = '' THEN string_split(text, chr(10))[1:len(string_split(text, chr(10))) - 1] ELSE string_split(text, chr(10)) END) AS text,
  unnest(range(1, 1 + len(CASE WHEN string_split(text, chr(10))[-1] = '' THEN string_split(text, chr(10))[1:len(string_split(text, chr(10))) - 1] ELSE string_split(text, chr(10)) END))) AS line_number FROM documents)"""

LINKS = """
hrefs AS (SELECT page_id, regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1) AS h FROM pages),
links AS (SELECT page_id, unnest(h) AS href, unnest(range(1, len(h) + 1)) AS ord FROM hrefs)"""

SQL = {
    "impact_nation_d3": impact(ROOT, 3),
    "impact_all_types": impact(ROOT, 2, "TRUE"),
    "impact_filtered_methodcall": impact(1_000_007, 2, "edge_type = 'MethodCall'"),
    "impact_edges_d2": with_(SQL_NODES, SQL_EDGES, f"""
l1 AS (SELECT DISTINCT caller FROM edges WHERE {FUNCTIONAL} AND callee = {ROOT}),
met AS (SELECT * FROM edges WHERE {FUNCTIONAL} AND (callee = {ROOT} OR callee IN (SELECT caller FROM l1)))
SELECT DISTINCT caller, callee, a.canonical_id AS caller_canonical_id, b.canonical_id AS callee_canonical_id, edge_type, ({ORDINAL})::BIGINT AS edge_ordinal FROM met JOIN nodes a ON a.id = caller JOIN nodes b ON b.id = callee"""),
    "direct_callees": with_(SQL_NODES, SQL_EDGES, f"""
x AS (SELECT DISTINCT callee FROM edges WHERE caller = 10000001 AND {FUNCTIONAL})
SELECT id, canonical_id, node_type FROM code JOIN x ON callee = id"""),
    "trace_callee_budget": with_(SQL_NODES, SQL_EDGES, """
e AS (SELECT DISTINCT caller, callee FROM edges WHERE edge_type IN ('ParentOf', 'Implements')),
l0 AS (SELECT 1003::BIGINT AS id, 0::BIGINT AS ord, 0::BIGINT AS depth),
c1 AS (SELECT callee AS id, min(ord) AS parent FROM e JOIN l0 ON caller = l0.id WHERE callee NOT IN (SELECT id FROM l0) GROUP BY callee),
r1 AS (SELECT c1.id, row_number() OVER (ORDER BY parent, name, c1.id) AS n FROM c1 JOIN code ON code.id = c1.id),
l1 AS (SELECT id, n AS ord, 1::BIGINT AS depth FROM r1 WHERE n <= 39),
k1 AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1),
c2 AS (SELECT callee AS id, min(ord) AS parent FROM e JOIN l1 ON caller = l1.id WHERE callee NOT IN (SELECT id FROM k1) GROUP BY callee),
r2 AS (SELECT c2.id, row_number() OVER (ORDER BY parent, name, c2.id) + (SELECT count(*) FROM k1) - 1 AS n FROM c2 JOIN code ON code.id = c2.id)
SELECT * FROM k1 UNION ALL SELECT id, n, 2::BIGINT FROM r2 WHERE n <= 39"""),
    "edges_among_nodes": with_(SQL_NODES, SQL_EDGES, """
v AS (SELECT id FROM code WHERE node_type IN ('Method', 'Class'))""") + f" SELECT caller, callee, edge_type FROM edges WHERE {FUNCTIONAL} AND caller IN (SELECT id FROM v) AND callee IN (SELECT id FROM v)",
    "root_resolution": with_(SQL_NODES, f"""
asked AS (SELECT unnest(['1003', 'nation:4', 'NATION_7', 'nation_7', 'customer#000000011', 'Customer#000000012', 'blue bolt', 'BLUE BOLT', '99999999999', 'nobody', '12x']) AS identifier),
tries AS (
  SELECT identifier, 0 AS p, id FROM asked JOIN code ON CAST(id AS VARCHAR) = identifier
  UNION ALL SELECT identifier, 1, id FROM asked JOIN code ON canonical_id = identifier OR name = identifier
  UNION ALL SELECT identifier, 2, id FROM asked JOIN code ON translate(name, '{UPPER}', '{LOWER}') = translate(identifier, '{UPPER}', '{LOWER}')),
best AS (SELECT identifier, id, row_number() OVER (PARTITION BY identifier ORDER BY p, id) AS n FROM tries)
SELECT asked.identifier, best.id FROM asked LEFT JOIN best ON asked.identifier = best.identifier AND n = 1"""),
    "inheritors_nation": with_(SQL_NODES, SQL_EDGES, f"""
x AS (SELECT DISTINCT caller FROM edges WHERE edge_type = 'Implements' AND callee = {ROOT})
SELECT id, canonical_id, name FROM code JOIN x ON caller = id WHERE node_type = 'Class'"""),
    "context360_order": with_(SQL_NODES, SQL_EDGES, f"""
roots AS (SELECT unnest([10000003, {ROOT}]) AS root),
rel AS (
  SELECT DISTINCT root, caller AS id, CASE edge_type WHEN 'Implements' THEN 'implementers' WHEN 'ParentOf' THEN 'parents' ELSE 'callers' END AS relation FROM edges JOIN roots ON callee = root
  UNION SELECT DISTINCT root, callee, CASE edge_type WHEN 'Implements' THEN 'inherits' WHEN 'ParentOf' THEN 'children' ELSE 'callees' END FROM edges JOIN roots ON caller = root),
met AS (SELECT root, relation, rel.id, CASE WHEN node_type = 'Method' AND relation IN ('parents', 'children') THEN string_split(name, '(')[1] ELSE name END AS name, {TYPE} AS type
  FROM rel JOIN nodes ON nodes.id = rel.id WHERE relation IN ('parents', 'children') OR node_type IS NOT NULL),
num AS (SELECT *, row_number() OVER (PARTITION BY root, relation ORDER BY name, id) AS ord FROM met)
SELECT relation, ord, id, name, type FROM num WHERE ord <= 10"""),
    "connections_supplier": with_(SQL_NODES, SQL_EDGES, f"""
two AS (
  SELECT callee AS peer, edge_type, CASE WHEN callee = caller THEN 'self' ELSE 'outgoing' END AS direction FROM edges WHERE caller = 2000005
  UNION ALL SELECT caller, edge_type, 'incoming' FROM edges WHERE callee = 2000005 AND caller <> 2000005),
pg AS (SELECT DISTINCT peer FROM two ORDER BY peer LIMIT 100)
SELECT peer, name AS label, {TYPE} AS type, string_agg({LABEL} || '/' || direction, ',' ORDER BY {LABEL}, direction) AS relationships
FROM two JOIN nodes ON id = peer WHERE peer IN (SELECT peer FROM pg) GROUP BY peer, name, node_type"""),
    "scope_nodes_page": with_(SQL_NODES, SQL_EDGES, SQL_FILES, SCOPE, f"""
shown AS (SELECT phase::BIGINT AS phase, b.id, name AS label, {TYPE} AS type, CASE phase WHEN 0 THEN 'selected' ELSE 'external' END AS scope, project_id FROM both_phases b JOIN nodes ON nodes.id = b.id)
SELECT * FROM shown WHERE (phase, id) > (0, 1000100) ORDER BY phase, id LIMIT 500"""),
    "scope_edges_page": with_(SQL_NODES, SQL_EDGES, SQL_FILES, SCOPE).rstrip() + f"""
SELECT caller, callee, edge_type, {LABEL} AS label, scope FROM scoped WHERE (caller, callee, edge_type) > (1000100, 1005, 'Implements') ORDER BY caller, callee, edge_type LIMIT 700""",
    "scope_totals": with_(SQL_NODES, SQL_EDGES, SQL_FILES, SCOPE) + """
SELECT CASE phase WHEN 0 THEN 'selected' ELSE 'external' END AS scope, count(*) AS n FROM both_phases GROUP BY phase UNION ALL SELECT scope, count(*) FROM scoped GROUP BY scope""",
    "tree_children": with_(SQL_FILES) + """
SELECT 0::BIGINT AS kind_order, 'folder' AS kind, name AS label, d.path, n AS child_count, n > 0 AS has_children FROM (
  SELECT d.*, (SELECT count(*) FROM dirs c WHERE c.level = d.level + 1 AND (d.path = '' OR starts_with(c.path, d.path || '/'))) + (SELECT count(*) FROM docs WHERE directory_id = d.id) AS n FROM dirs d) d
WHERE level = 1 OR (level = 3 AND starts_with(d.path, 'spam-farm.example.org/en/'))
UNION ALL SELECT 2, 'file', file_name, relative_path, 0, FALSE FROM docs WHERE directory_id IN (SELECT id FROM dirs WHERE path IN ('', 'spam-farm.example.org/en'))""",
    "directory_closure": with_(SQL_FILES) + " SELECT ancestor, descendant, depth::BIGINT AS depth FROM clos",
    "graph_stats_counts": with_(SQL_NODES, SQL_EDGES, SQL_FILES) + """
SELECT 'documents' AS name, (SELECT count(*) FROM pages) AS n UNION ALL SELECT 'directories', (SELECT count(*) FROM dirs) UNION ALL SELECT 'projects', (SELECT count(*) FROM proj)
UNION ALL SELECT 'code_nodes', (SELECT count(*) FROM code) UNION ALL SELECT 'code_vectors', 0 UNION ALL SELECT 'edges', (SELECT count(*) FROM edges)
UNION ALL SELECT 'memories', 0 UNION ALL SELECT 'http_nodes', 0 UNION ALL SELECT 'package_nodes', 0""",
    "language_stats": "SELECT lang AS language, count(*) AS documents, count(embedding) AS vectors, sum(length(text))::BIGINT AS chars FROM documents LEFT JOIN embeddings ON doc_id = vec_id GROUP BY lang",
    "edge_type_stats": with_(SQL_EDGES) + " SELECT edge_type, count(*) AS n FROM edges GROUP BY edge_type",
    "bm25_topk": with_(CORPUS, bm25(PHRASES)) + " SELECT id, round(score, 6) AS score FROM kwr WHERE rank <= 200",
    "vector_topk": with_(CORPUS, VECTOR) + " SELECT id, rank, round(sim, 6) AS similarity FROM vrr WHERE rank <= 50",
    "memory_lexical_rank": with_(NOTES, noted("tion")) + " SELECT memory_id, id, score, rank FROM lexr WHERE rank <= 100",
    "hybrid_rrf": with_(CORPUS, bm25(PHRASES), VECTOR, fused("kwr", "vrr")),
    "normalised_tags": "SELECT conv_id, turn, CASE WHEN role < 'zeta' THEN role || ',zeta' ELSE 'zeta,' || role END AS tags, sha256(trim(text)) AS content_hash FROM conversations",
    "embedding_reuse_plan": "SELECT doc_id AS id, CASE WHEN embedding IS NOT NULL AND doc_id % 3 <> 0 THEN 'reused' ELSE 'generated' END AS action, CASE WHEN embedding IS NOT NULL AND doc_id % 3 <> 0 THEN len(embedding) ELSE 0 END::BIGINT AS dims FROM documents LEFT JOIN embeddings ON doc_id = vec_id",
    "snapshot_diff": """
WITH a AS (SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN c_name || '*' ELSE c_name END AS c_name, c_nationkey, c_mktsegment FROM customer WHERE c_custkey % 11 <> 0
  UNION ALL SELECT c_custkey + 1000000, c_name, c_nationkey, c_mktsegment FROM customer WHERE c_custkey % 17 = 0)
SELECT coalesce(b.c_custkey, a.c_custkey) AS c_custkey, CASE WHEN b.c_custkey IS NULL THEN 'added' WHEN a.c_custkey IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM customer b FULL OUTER JOIN a ON a.c_custkey = b.c_custkey
WHERE b.c_custkey IS NULL OR a.c_custkey IS NULL OR a.c_name <> b.c_name OR a.c_nationkey <> b.c_nationkey OR a.c_mktsegment <> b.c_mktsegment""",
    "canonicalize_last_wins": "SELECT user_id || '/' || event_type AS canonical_id, arg_max(value, event_id) AS value, max(event_id) AS ingest_ordinal FROM events GROUP BY user_id, event_type",
    "canonical_edges": """
WITH e AS (SELECT o_orderkey AS k, 'o:' || o_orderkey AS caller_id, CASE WHEN o_orderkey % 7 = 0 THEN 'package:p' || (o_orderkey % 3) ELSE 'o:' || (o_orderkey + 1) END AS callee_id, 'Import' AS edge_type, o_orderpriority AS metadata FROM orders),
n AS (SELECT 'o:' || o_orderkey AS id FROM orders WHERE o_orderkey % 5 <> 0)
SELECT caller_id, callee_id, edge_type, metadata FROM e WHERE caller_id IN (SELECT id FROM n) AND (starts_with(callee_id, 'package:') OR callee_id IN (SELECT id FROM n))""",
    "identity_assign": """
WITH m AS (SELECT max(c_custkey) AS m FROM customer WHERE c_custkey % 3 = 0)
SELECT c_name AS canonical_id, c_custkey AS id FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT c_name, m + row_number() OVER (ORDER BY c_name) FROM customer, m WHERE c_custkey % 3 <> 0""",
    "move_detection": """
WITH g AS (SELECT *, count(*) OVER (PARTITION BY p_name, p_brand, p_type, p_size) AS n FROM part WHERE p_partkey % 4 = 0)
SELECT CAST(p_partkey AS VARCHAR) AS old, 'moved/' || p_partkey AS new FROM g WHERE n = 1""",
    "log_windows": with_(LINES, """
t AS (SELECT log_id, max(line_number) AS total FROM li GROUP BY log_id),
m AS (SELECT li.log_id, greatest(1, line_number - 3) AS start, least(total, line_number + 3) AS stop FROM li JOIN t ON li.log_id = t.log_id
  WHERE len(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: starts_with(x, 'licens') OR x = 'reserved')) > 0),
o AS (SELECT *, CASE WHEN start > coalesce(max(stop) OVER (PARTITION BY log_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) + 1 THEN 1 ELSE 0 END AS fresh FROM m),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY log_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS block FROM o)""") + """
SELECT log_id, block::BIGINT AS block, min(start) AS start, max(stop) AS stop, count(*) AS n_matches FROM b GROUP BY log_id, block""",
    "log_budget": with_(LINES, """
w AS (SELECT *, coalesce(sum(octet_length(encode(text))) OVER (PARTITION BY log_id ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM li WHERE line_number <= 12),
k AS (SELECT *, octet_length(encode(text)) AS size FROM w WHERE used < 3000 OR (used = 3000 AND text = '')),
c AS (SELECT log_id, size, used, CASE WHEN size <= 3000 - used THEN size ELSE (SELECT coalesce(max(s), 0) FROM (SELECT sum(octet_length(encode(ch))) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM (SELECT unnest(string_split(k.text, '')) AS ch, unnest(range(length(k.text))) AS i)) WHERE s <= 3000 - used) END AS kept FROM k)""") + """
SELECT log_id, count(*) AS lines, sum(kept)::BIGINT AS bytes, bool_or(size > 3000 - used) AS cut FROM c GROUP BY log_id""",
    "log_range": with_(LINES) + " SELECT log_id, line_number, length(text) AS chars FROM li WHERE line_number BETWEEN 3 AND 5",
    "run_state_latest": """
SELECT user_id AS workspace, max(ts) AS last_attempt, arg_max(CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END, event_id) AS last_outcome, max(ts) FILTER (WHERE event_type <> 'error') AS last_success FROM events GROUP BY user_id""",
    "notification_reduce": """
WITH e AS (SELECT user_id, event_id, props, CASE WHEN event_type = 'purchase' AND value > 80 THEN 'succeeded' ELSE event_type END AS kind FROM events),
x AS (SELECT user_id, min(event_id) AS stop FROM e WHERE kind = 'succeeded' GROUP BY user_id),
k AS (SELECT e.* FROM e LEFT JOIN x ON e.user_id = x.user_id WHERE stop IS NULL OR event_id <= stop)
SELECT user_id AS operation_id, max(event_id) AS sequence, arg_max(kind, event_id) AS kind, arg_max(props, event_id) AS message, count(*) AS accepted, arg_max(kind, event_id) = 'succeeded' AS finished FROM k GROUP BY user_id""",
    "change_batches": """
WITH RECURSIVE opens AS (
  SELECT user_id, min(ts) AS o, 1::BIGINT AS batch FROM events GROUP BY user_id
  UNION ALL SELECT p.user_id, (SELECT min(ts) FROM events e WHERE e.user_id = p.user_id AND e.ts > p.o + INTERVAL 6 HOUR), p.batch + 1 FROM opens p
  WHERE EXISTS (SELECT 1 FROM events e WHERE e.user_id = p.user_id AND e.ts > p.o + INTERVAL 6 HOUR)),
r AS (SELECT *, lead(o) OVER (PARTITION BY user_id ORDER BY o) AS nxt FROM opens)
SELECT r.user_id, batch, count(*) AS n, min(event_id) AS first_event FROM r JOIN events e ON e.user_id = r.user_id AND ts >= o AND (nxt IS NULL OR ts < nxt) GROUP BY r.user_id, batch""",
    "change_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "change_sessions": """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
    "slugify_titles": r"""
WITH t AS (SELECT page_id, regexp_replace(regexp_replace(lower(trim(regexp_extract(html, '<title>([^<]*)</title>', 1))), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM pages)
SELECT page_id, CASE WHEN s = '' THEN 'section' ELSE s END AS slug FROM t""",
    "synthetic_http_nodes": with_(LINKS) + " SELECT DISTINCT 'http:GET:' || url_encode(href) AS canonical_id, 'Http' AS kind, 'GET ' || href AS label FROM links",
    "page_links": with_(LINKS) + " SELECT page_id, ord, href FROM links",
    "document_paths": with_(SQL_FILES) + r""" SELECT page_id, path, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS parent, string_split(path, '/')[-1] AS file_name,
  lower(regexp_extract(string_split(path, '/')[-1], '(\.[^.]+)$', 1)) AS extension, 'Other' AS kind FROM paths""",
    "toon_search_groups": with_(SQL_NODES, SQL_FILES, """
h AS (SELECT c.id, c.name, n.document_id, row_number() OVER (ORDER BY c.name, c.id) AS rank FROM code c JOIN nodes n ON n.id = c.id WHERE c.node_type = 'Class'),
l AS (SELECT CASE WHEN contains(relative_path, '/') THEN regexp_replace(relative_path, '/[^/]*$', '') ELSE '' END AS directory, file_name AS file, rank,
  '    [C] `' || h.id || '` ' || h.name || ' L' || (h.id % 100 + 1) || '-' || (h.id % 100 + 11) AS line FROM h JOIN docs ON docs.id = document_id ),
f AS (SELECT directory, file, min(rank) AS rank, string_agg(line, chr(10) ORDER BY rank) AS lines FROM l GROUP BY directory, file)""") + """
SELECT directory, min(rank) AS ord, string_agg('  ' || file || chr(10) || lines, chr(10) ORDER BY rank) AS body FROM f GROUP BY directory""",
    "path_chains": with_(SQL_NODES, SQL_EDGES, f"""
u AS (SELECT DISTINCT caller, callee FROM edges WHERE {FUNCTIONAL})
SELECT '3000005>' || caller AS ids, c.name || ' -> ' || p.name AS chain FROM u JOIN code c ON c.id = caller JOIN code p ON p.id = 3000005 WHERE callee = 3000005"""),
    "path_chains_page": with_(SQL_EDGES, f"""
u AS (SELECT DISTINCT caller, callee FROM edges WHERE {FUNCTIONAL}),
one AS (SELECT caller AS a FROM u WHERE callee = 1003 AND caller <> 1003),
two AS (SELECT a, caller AS b FROM one JOIN u ON callee = a WHERE caller NOT IN (a, 1003)),
c AS (SELECT a, b FROM two UNION ALL SELECT a, NULL FROM one WHERE a NOT IN (SELECT a FROM two)),
r AS (SELECT *, row_number() OVER (ORDER BY a, b NULLS FIRST) AS n FROM c)""") + """
SELECT '1003>' || a || CASE WHEN b IS NULL THEN '' ELSE '>' || b END AS ids FROM r WHERE n BETWEEN 41 AND 80""",
    "json_rows": """SELECT '{"sSuppkey":' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN ',"sName":"' || s_name || '"' ELSE '' END || '}' AS json FROM supplier""",
    "fact_edges": """
SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS caller_id, CAST(o_custkey AS VARCHAR) AS callee_id, CASE WHEN o_custkey % 3 = 0 THEN 'MethodCall' ELSE 'Instantiates' END AS edge_type FROM orders WHERE o_orderkey <> o_custkey
UNION SELECT CAST(c_custkey AS VARCHAR), CAST(c_nationkey AS VARCHAR), 'Implements' FROM customer WHERE c_custkey <> c_nationkey
UNION SELECT CAST(s_suppkey AS VARCHAR), CAST(s_nationkey AS VARCHAR), 'FieldAccess' FROM supplier WHERE s_suppkey <> s_nationkey""",
    "enclosing_declaration": """
WITH p AS (SELECT p_partkey AS declaration_id, p_brand AS path, p_partkey % 200 AS a, p_partkey % 200 + p_size * 3 AS b FROM part),
c AS (SELECT o_orderkey AS call_id, 'Brand#' || (o_custkey % 25 + 1) AS path, o_orderkey % 330 AS line FROM orders),
m AS (SELECT call_id, declaration_id, row_number() OVER (PARTITION BY call_id ORDER BY b - a, a, declaration_id) AS n FROM c JOIN p ON p.path = c.path AND line BETWEEN a AND b)
SELECT call_id, declaration_id FROM m WHERE n = 1""",
    "visible_projection": with_(SQL_NODES, SQL_EDGES, """
v AS (SELECT id, lower(node_type) AS type FROM nodes WHERE lower(node_type) IN ('class', 'interface') AND (contains(lower(name), 'er') OR contains(lower(node_type), 'er') OR contains(lower(canonical_id), 'er')))""") + """
SELECT type AS kind, count(*) AS n FROM v GROUP BY type UNION ALL SELECT edge_type, count(*) FROM edges WHERE caller IN (SELECT id FROM v) AND callee IN (SELECT id FROM v) GROUP BY edge_type""",
    "contribution_reuse": """
WITH t AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 10 = 0)
SELECT c_custkey AS contribution_id, c_custkey NOT IN (SELECT o_custkey FROM t) AND c_custkey % 2 <> 0 AS reuse FROM customer""",
    "context_lines": with_(SQL_NODES, SQL_EDGES, f"""
rel AS (
  SELECT DISTINCT caller AS id, CASE edge_type WHEN 'Implements' THEN 'implementers' WHEN 'ParentOf' THEN 'parents' ELSE 'callers' END AS relation FROM edges WHERE callee = {ROOT}
  UNION SELECT DISTINCT callee, CASE edge_type WHEN 'Implements' THEN 'inherits' WHEN 'ParentOf' THEN 'children' ELSE 'callees' END FROM edges WHERE caller = {ROOT}),
met AS (SELECT relation, rel.id, name, {TYPE} AS type, row_number() OVER (PARTITION BY relation ORDER BY name, rel.id) AS ord
  FROM rel JOIN nodes ON nodes.id = rel.id WHERE relation IN ('parents', 'children') OR node_type IS NOT NULL)
SELECT relation, count(*) AS n, string_agg('  ' || name || ' (' || type || ') `' || id || '`', chr(10) ORDER BY ord) AS body FROM met WHERE ord <= 10 GROUP BY relation"""),
    "memory_blocks": with_(NOTES) + """
SELECT id AS node_id, count(*) AS n, count(*) FILTER (WHERE now_hash <> target_hash) AS stale,
  string_agg('- ' || upper(intent) || CASE WHEN now_hash <> target_hash THEN ' [stale: the code has changed]' ELSE '' END || ' #' || role || chr(10) || '  ' || content, chr(10) ORDER BY memory_id) AS body FROM notes GROUP BY id""",
    "log_summary": with_(LINES, """
m AS (SELECT log_id, line_number, len(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x = 'the')) > 0 AND len(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x = 'licensed')) = 0 AS hit FROM li),
h AS (SELECT log_id, line_number, CASE WHEN line_number - lag(line_number) OVER (PARTITION BY log_id ORDER BY line_number) = 1 THEN 0 ELSE 1 END AS fresh FROM m WHERE hit),
b AS (SELECT log_id, count(*) AS matched, sum(fresh)::BIGINT AS n_blocks FROM h GROUP BY log_id),
t AS (SELECT log_id, max(line_number) AS total_lines FROM li GROUP BY log_id)""") + """
SELECT t.log_id, total_lines, coalesce(matched, 0) AS matched, coalesce(n_blocks, 0) AS n_blocks,
  CASE WHEN matched IS NULL THEN 'no match in ' || total_lines || ' lines' ELSE matched || ' of ' || total_lines || ' lines match, in ' || n_blocks || ' blocks' END AS summary FROM t LEFT JOIN b ON t.log_id = b.log_id""",
}
