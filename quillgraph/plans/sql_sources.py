"""SQL twins of ``catalogue_sources``: what the sample sources must give, stated
over the raw tables."""

from quillgraph.plans.derive import SQL_EDGES, SQL_FILES, SQL_NODES
from quillgraph.plans.sql import CORPUS, LABEL, LINES, LINKS, NOTES, ROOT, SCOPE, VECTOR, bm25, fused, impact, noted, terms, with_
from quillgraph.plans.sql_typescript import SQL as TYPESCRIPT

TURNS = """
tu AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
md AS (SELECT DISTINCT conv_id, 'code:doc:docs/c' || conv_id || '.md#' AS base FROM conversations),
ch AS (
  SELECT conv_id, -2 AS o, base || 'document-root' AS id, 'c' || conv_id AS shown, NULL AS title, 1 AS a, 1 AS b, 0 AS level FROM md
  UNION ALL SELECT conv_id, -1, base || 'talk-' || conv_id, 'c' || conv_id || '#talk-' || conv_id, 'Talk ' || conv_id, 1, 2, 1 FROM md
  UNION ALL SELECT tu.conv_id, i, base || 'turn-' || turn, 'c' || tu.conv_id || '#turn-' || turn, 'Turn ' || turn, 4 + 9 * i, 4 + 9 * i + CASE WHEN i = n - 1 THEN 9 ELSE 7 END, turn % 3 + 1 FROM tu JOIN md ON md.conv_id = tu.conv_id),
pa AS (SELECT c.conv_id, c.o, arg_max(p.id, p.o) AS parent FROM ch c JOIN ch p ON p.conv_id = c.conv_id AND p.o < c.o AND p.level < c.level GROUP BY c.conv_id, c.o),
ln AS (SELECT 'docs/c' || conv_id || '.md' AS relative_path, 6 + 9 * i AS n, conv_id, turn, i FROM tu),
tg AS (SELECT relative_path, n, conv_id, turn, 'c' || (conv_id + 1) || '.md#turn-' || turn AS target, 'code:doc:docs/c' || (conv_id + 1) || '.md#turn-' || turn AS target_id FROM ln
  UNION ALL SELECT relative_path, n, conv_id, turn, 'c' || (conv_id + 2) || '.md', 'code:doc:docs/c' || (conv_id + 2) || '.md#document-root' FROM ln)"""

LISTING = r"""
li AS (SELECT DISTINCT c_custkey % 10 AS form, CASE c_custkey % 10
  WHEN 0 THEN 'src/n' || c_nationkey || '/c' || c_custkey || '.cs' WHEN 1 THEN 'docs/n' || c_nationkey || '/c' || c_custkey || '.md' WHEN 2 THEN 'docs/BIN/c' || c_custkey || '.md'
  WHEN 3 THEN 'gen/c' || c_custkey || '.md' WHEN 4 THEN 'gen/keep/c' || c_custkey || '.md' WHEN 5 THEN 'app/dist/c' || c_custkey || '.tsx' WHEN 6 THEN 'app/n' || c_nationkey || '/c' || c_custkey || '.ts'
  WHEN 7 THEN 'app/n' || c_nationkey || '/tsconfig.json' WHEN 8 THEN 'lib/n' || c_nationkey || '/Core.csproj' ELSE 'lib/n' || c_nationkey || '/Directory.Build.props' END AS path FROM customer)"""

NOTE_VECTORS = """
nv AS (SELECT memory_id, notes.id, notes.canonical_id, role, list_cosine_similarity(embedding::DOUBLE[], qv) AS sim FROM notes JOIN embeddings ON vec_id = notes.id, q)"""


def _phrases(pairs: list[tuple[str, str]]) -> str:
    """BM25 of two-word phrases whose last word is a prefix, column by column."""
    columns = ("display_name", "fqn", "body", "path")
    count = lambda t, a, b: f"len(list_filter(range(1, len({t})), lambda i: {t}[i] = '{a}' AND starts_with({t}[i + 1], '{b}')))"
    f = ", ".join(" + ".join(count(f"t{j}", a, b) for j in range(4)) + f" AS f{i}" for i, (a, b) in enumerate(pairs))
    n = ", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS n{i}" for i in range(len(pairs)))
    part = " + ".join(f"greatest(CASE WHEN n{i} < n + 0.5 THEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) ELSE 0 END, 0.000001) * f{i}::DOUBLE * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * size / mean))" for i in range(len(pairs)))
    some = " OR ".join(f"f{i} > 0" for i in range(len(pairs)))
    bags = ", ".join(f"{terms(c)} AS t{j}" for j, c in enumerate(columns))
    return f"""
bags AS (SELECT id, canonical_id, {bags} FROM corpus),
freq AS (SELECT id, canonical_id, len(t0) + len(t1) + len(t2) + len(t3) AS size, {f} FROM bags),
stat AS (SELECT count(*)::DOUBLE AS n, avg(size)::DOUBLE AS mean, {n} FROM freq),
kw AS (SELECT id, canonical_id, {part} AS score FROM freq, stat WHERE {some}),
kwr AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, canonical_id) AS rank FROM kw)"""


BLOCKS = """
t AS (SELECT log_id, max(line_number) AS total FROM li GROUP BY log_id),
m AS (SELECT li.log_id, greatest(1, line_number - 3) AS start, least(total, line_number + 3) AS stop FROM li JOIN t ON li.log_id = t.log_id
  WHERE len(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: starts_with(x, 'licens') OR x = 'reserved')) > 0),
o AS (SELECT *, CASE WHEN start > coalesce(max(stop) OVER (PARTITION BY log_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) + 1 THEN 1 ELSE 0 END AS fresh FROM m),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY log_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS block FROM o),
bl AS (SELECT log_id, block, min(start) AS start, max(stop) AS stop FROM b GROUP BY log_id, block),
ins AS (SELECT li.log_id, line_number, line_number || '| ' || text AS line, CASE WHEN row_number() OVER (PARTITION BY li.log_id ORDER BY line_number) = 1 THEN 0 WHEN line_number = start THEN 2 ELSE 1 END AS gap
  FROM li JOIN bl ON bl.log_id = li.log_id AND line_number BETWEEN start AND stop),
us AS (SELECT *, 160 - gap - coalesce(sum(gap + length(line)) OVER (PARTITION BY log_id ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM ins),
sh AS (SELECT *, coalesce(bool_or(length(line) > room) OVER (PARTITION BY log_id ORDER BY line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS spent FROM us)"""

_PHRASE = with_(CORPUS, _phrases([("de", "la"), ("under", "cc")])) + " SELECT id, round(score, 6) AS score FROM kwr WHERE rank <= 200"

SQL = TYPESCRIPT | {
    "markdown_chunks": with_(TURNS) + " SELECT id AS canonical_id, shown AS display_name, title, a AS start_line, b AS end_line, level, parent AS parent_id FROM ch LEFT JOIN pa ON pa.conv_id = ch.conv_id AND pa.o = ch.o",
    "markdown_edges": with_(TURNS) + """
SELECT parent AS caller_id, id AS callee_id, 'ParentOf' AS edge_type FROM ch JOIN pa ON pa.conv_id = ch.conv_id AND pa.o = ch.o
UNION SELECT 'code:doc:docs/c' || conv_id || '.md#turn-' || turn, target_id, 'DocumentLink' FROM tg WHERE target_id IN (SELECT id FROM ch)""",
    "markdown_links": with_(TURNS) + " SELECT relative_path, n, target, target_id FROM tg",
    "markdown_nested": """
WITH c AS (SELECT DISTINCT conv_id AS k, 'code:doc:docs/wiki/c' || conv_id || '.md#' AS base FROM conversations)
SELECT base || 'document-root' AS canonical_id, NULL AS title, 1 AS start_line, 1 AS end_line, 0 AS level, NULL AS parent_id FROM c
UNION ALL SELECT base || 'talk-' || k, 'Talk ' || k, 1, CASE WHEN k % 2 = 0 THEN 19 ELSE 20 END, 1, base || 'document-root' FROM c
UNION ALL SELECT base || 'in-short', 'In short', CASE WHEN k % 2 = 0 THEN 20 ELSE 21 END, CASE WHEN k % 2 = 0 THEN 24 ELSE 25 END, 2, base || 'talk-' || k FROM c""",
    "markdown_wiki_links": """
WITH c AS (SELECT DISTINCT conv_id AS k, 'docs/wiki/c' || conv_id || '.md' AS relative_path FROM conversations)
SELECT relative_path, 5 AS n, 'wiki' AS kind, 'c' || (k + 1) || '|next' AS target, 'code:doc:docs/wiki/c' || (k + 1) || '.md#document-root' AS target_id FROM c
UNION ALL SELECT relative_path, 9, 'wiki', 'c' || k || '#In Short', 'code:doc:docs/wiki/c' || k || '.md#in-short' FROM c
UNION ALL SELECT relative_path, CASE WHEN k % 2 = 0 THEN 24 ELSE 25 END, 'wiki', k || '/up', 'code:doc:docs/wiki/' || k || '/up.md#document-root' FROM c""",
    "files_discovered": with_(LISTING) + " SELECT path AS relative_path FROM li WHERE form IN (0, 1, 4)",
    "files_sources": with_(LISTING) + """
SELECT 'CSharp' AS kind, path FROM li WHERE form = 8 UNION ALL SELECT 'TypeScript', path FROM li WHERE form = 7
UNION SELECT 'Markdown', regexp_replace(path, '[^/]*$', '*.md') FROM li WHERE form IN (1, 3, 4)""",
    "files_rules": with_(LISTING) + " SELECT path, form = 6 AS typescript, form = 8 AS project, form IN (8, 9) AS config, starts_with(path, 'app/n') AND NOT starts_with(path, 'app/n1/') AS root FROM li",
    "memory_staleness": with_(NOTES) + " SELECT intent, count(*) AS notes, count(*) FILTER (WHERE now_hash <> target_hash) AS stale, count(DISTINCT id) AS nodes FROM notes GROUP BY intent",
    "memories_by_node": with_(NOTES) + " SELECT doc_id AS id, coalesce(string_agg(intent, ',' ORDER BY turn, intent), '') AS intents, count(memory_id) AS notes, count(*) FILTER (WHERE now_hash <> target_hash) AS stale FROM documents LEFT JOIN notes ON id = doc_id WHERE doc_id > 0 GROUP BY doc_id",
    "memory_batch": with_(NOTES) + """
SELECT a.id, n.intent, n.now_hash <> n.target_hash AS stale FROM (SELECT lpad((conv_id + turn % 2 * 1000)::VARCHAR, 8, '0') || '-' || lpad(turn::VARCHAR, 4, '0') AS id FROM conversations) a LEFT JOIN notes n ON n.memory_id = a.id""",
    "memory_attach": """
SELECT CAST(event_id AS VARCHAR) AS id, user_id AS target_code_node_id, sha256(text) AS target_code_hash, props AS content, sha256(props) AS content_hash, 'a,' || event_type AS tags,
  CASE WHEN event_id % 2 = 0 THEN 'Todo' ELSE 'Convention' END AS intent FROM events JOIN documents ON doc_id = user_id""",
    "memory_delete": with_(NOTES) + " SELECT memory_id AS id, intent FROM notes WHERE memory_id <> '00000003-0001'",
    "memory_vector_rank": with_(CORPUS, VECTOR, NOTES, NOTE_VECTORS) + """,
r AS (SELECT memory_id, id, row_number() OVER (ORDER BY sim DESC, canonical_id, memory_id) AS rank, round(sim, 6) AS similarity FROM nv)
SELECT * FROM r WHERE rank <= 100""",
    "hybrid_rrf_memories": with_(CORPUS, bm25(["tion", "reand", "licensed"]), VECTOR, NOTES, NOTE_VECTORS, """
nvr AS (SELECT id, canonical_id, row_number() OVER (ORDER BY sim DESC, canonical_id, memory_id) AS rank FROM nv WHERE role IN ('user', 'system'))""", noted("tion reand licensed", "role IN ('user', 'system')"), fused("kwr", "vrr", "lexr", "nvr")),
    "hybrid_filtered": with_(CORPUS, bm25(["tion", "reand", "licensed"]), VECTOR, """
kf AS (SELECT id, canonical_id, row_number() OVER (ORDER BY score DESC, canonical_id) AS rank FROM kw WHERE id % 3 = 1 AND id % 2 = 0),
vf AS (SELECT id, canonical_id, row_number() OVER (ORDER BY sim DESC, canonical_id) AS rank FROM vr WHERE id % 3 = 1 AND id % 2 = 0)""", fused("kf", "vf")),
    "bm25_phrase": _PHRASE,
    "bm25_scan": _PHRASE,
    "bm25_layers": with_(CORPUS, bm25(["tion", "reand", "licensed"])) + " SELECT id, round(score, 6) AS score FROM kwr WHERE rank <= 200",
    "scope_root_nodes": with_(SQL_FILES, LINKS, """
hr AS (SELECT href, 10000000 + row_number() OVER (ORDER BY href) AS id FROM (SELECT DISTINCT href FROM links))""") + """
SELECT 0 AS phase, page_id + 1 AS id, path AS label, 'document' AS type, 'selected' AS scope FROM paths UNION ALL SELECT 1, id, 'GET ' || href, 'http', 'external' FROM hr""",
    "scope_root_edges": with_(LINKS, """
hr AS (SELECT href, 10000000 + row_number() OVER (ORDER BY href) AS id FROM (SELECT DISTINCT href FROM links))""") + """
SELECT DISTINCT page_id + 1 AS caller, id AS callee, 'HttpRequest' AS edge_type, 'http-request' AS label, 'boundary' AS scope FROM links JOIN hr ON hr.href = links.href""",
    "scope_root_totals": with_(SQL_NODES, SQL_EDGES) + " SELECT 'selected' AS scope, count(*) AS n FROM nodes UNION ALL SELECT 'internal', count(*) FROM edges",
    "scope_page_walk": with_(SQL_NODES, SQL_EDGES, SQL_FILES, SCOPE, """
pg AS (SELECT phase, b.id, row_number() OVER (ORDER BY phase, b.id) AS r, count(*) OVER () AS total FROM both_phases b JOIN nodes ON nodes.id = b.id)""") + """
SELECT (r - 1) // 5000 + 1 AS page, count(*) AS n, arg_min(id, r) AS first_id, arg_max(id, r) AS last_id, max(total) AS total FROM pg GROUP BY 1""",
    "connections_walk": with_(SQL_EDGES, """
pe AS (SELECT DISTINCT CASE WHEN caller = 2000005 THEN callee ELSE caller END AS peer FROM edges WHERE caller = 2000005 OR callee = 2000005),
pg AS (SELECT peer, row_number() OVER (ORDER BY peer) AS r, count(*) OVER () AS total FROM pe)""") + """
SELECT (r - 1) // 500 + 1 AS page, count(*) AS n, min(peer) AS first_peer, max(peer) AS last_peer, max(total) AS total FROM pg GROUP BY 1""",
    "highlight_nation": with_(SQL_EDGES, f"""
pe AS (SELECT callee AS id, 'outgoing' AS way FROM edges WHERE caller = {ROOT} UNION ALL SELECT caller, 'incoming' FROM edges WHERE callee = {ROOT})""") + f"""
SELECT id, CASE WHEN count(DISTINCT way) = 2 THEN 'both' ELSE min(way) END AS role FROM pe GROUP BY id UNION ALL SELECT {ROOT}, 'selected'""",
    "impact_cycle": "SELECT id, canonical_id, depth FROM (" + impact(ROOT, 3, "edge_type IN ('Implements', 'ParentOf')") + ")",
    "tree_projects": """
WITH f AS (SELECT n_nationkey AS n, n_regionkey AS r, unnest(['.csproj', '.cs', '.tsx', '.md', '.txt']) AS e FROM nation),
p AS (SELECT s_nationkey AS n, count(*) AS k, min(s_name) AS name, min(s_suppkey) + 1000 AS id FROM supplier GROUP BY s_nationkey)
SELECT 0 AS kind_order, 'folder' AS kind, 'r' || r_regionkey AS label, 'r' || r_regionkey AS path, (SELECT count(*) FROM f WHERE r = r_regionkey) AS child_count, (SELECT count(*) FROM f WHERE r = r_regionkey) > 0 AS has_children, NULL::BIGINT AS project_id FROM region
UNION ALL SELECT CASE WHEN e = '.csproj' THEN 1 ELSE 2 END, CASE WHEN e = '.csproj' THEN 'project' ELSE 'file' END, CASE WHEN e = '.csproj' AND k = 1 THEN name ELSE 'n' || f.n || e END,
  'r' || r || '/n' || f.n || e, 0, FALSE, CASE WHEN e = '.csproj' AND k = 1 THEN id END FROM f LEFT JOIN p ON p.n = f.n""",
    "extension_stats": """
WITH s AS (SELECT s_suppkey % 3 AS m, count(*) AS n FROM supplier GROUP BY 1), d AS (SELECT count(*) AS n FROM nation)
SELECT language, (CASE WHEN language = 'Other' THEN 2 ELSE 1 END) * d.n AS documents, coalesce(s.n, 0) AS nodes, CASE WHEN language = 'C#' THEN coalesce(s.n, 0) ELSE 0 END AS vectors
FROM (SELECT unnest(['C#', 'TSX', 'Markdown', 'Other']) AS language, unnest([0, 1, 2, 3]) AS m) l LEFT JOIN s ON s.m = l.m, d""",
    "unknown_edge_type": "SELECT 'Odd' AS edge_type",
    "graph_health": "SELECT unnest(['as it is', 'newer', 'older']) AS migrations, unnest(['ready', 'incompatible', 'upgrade_required']) AS state",
    "run_diagnostics": """
WITH x AS (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'cancelled' ELSE 'info' END AS severity, props || props || props || event_id AS m FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'cancelled' THEN 1 ELSE 2 END, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM x)
SELECT user_id, i, severity, CASE WHEN length(m) > 30 THEN left(m, 29) || '…' ELSE m END AS message FROM r WHERE n <= 20 OR i < 19
UNION ALL SELECT DISTINCT user_id, 19, 'truncated', (n - 19) || ' more' FROM r WHERE n > 20""",
    "first_wins": "SELECT user_id || '/' || event_type AS canonical_id, arg_min(value, event_id) AS value, min(event_id) AS ingest_ordinal FROM events GROUP BY user_id, event_type",
    "merge_conflicts": """
WITH e AS (SELECT l_suppkey, l_orderkey, string_agg(DISTINCT CAST(l_partkey % 5 AS VARCHAR), ',' ORDER BY CAST(l_partkey % 5 AS VARCHAR)) AS out FROM lineitem GROUP BY 1, 2),
v AS (SELECT DISTINCT l.l_orderkey, CASE WHEN l.l_orderkey % 4 = 0 THEN l_returnflag ELSE 'same' END AS shown, out FROM lineitem l JOIN e ON e.l_suppkey = l.l_suppkey AND e.l_orderkey = l.l_orderkey)
SELECT CAST(l_orderkey AS VARCHAR) AS canonical_id, count(*) AS n_variants FROM v GROUP BY l_orderkey HAVING count(*) > 1""",
    "merge_contributions": "SELECT c_name AS canonical_id, c_mktsegment AS display, c_mktsegment AS callee_id FROM customer",
    "emitted_only": "SELECT 'node' AS what, s_name AS canonical_id FROM supplier WHERE s_nationkey = 3 UNION ALL SELECT 'edge', s_name || '>x' FROM supplier WHERE s_nationkey = 3 UNION ALL SELECT 'edge', 'p3>' || c_name FROM customer WHERE c_nationkey = 3",
    "move_by_name": """
WITH g AS (SELECT *, count(*) OVER (PARTITION BY c_mktsegment, c_nationkey) AS n FROM customer WHERE c_custkey % 2 = 0)
SELECT CAST(c_custkey AS VARCHAR) AS old, 'm' || c_custkey AS new FROM g WHERE n = 1""",
    "log_render": with_(LINES, BLOCKS) + " SELECT log_id, line_number, CASE WHEN length(line) <= room THEN line ELSE left(line, (room - 3)::BIGINT) || '...' END AS shown, length(line) > room AS cut FROM sh WHERE NOT spent AND (length(line) <= room OR room > 3)",
    "log_result": with_(LINES, BLOCKS, """
rn AS (SELECT log_id, line_number, line, room, lag(line_number) OVER (PARTITION BY log_id ORDER BY line_number) AS prev, gap FROM sh WHERE NOT spent AND (length(line) <= room OR room > 3)),
tx AS (SELECT log_id, string_agg(CASE WHEN prev IS NULL THEN '' WHEN gap = 2 THEN chr(10) || chr(10) ELSE chr(10) END || CASE WHEN length(line) <= room THEN line ELSE left(line, (room - 3)::BIGINT) || '...' END, '' ORDER BY line_number) AS body,
  count(*) AS n_shown, bool_or(length(line) > room) AS cut, max(line_number) AS last FROM rn GROUP BY log_id),
en AS (SELECT log_id, max(stop) AS stop, count(*) AS n_blocks FROM bl GROUP BY log_id),
mt AS (SELECT log_id, count(*) AS matched FROM b GROUP BY log_id)""") + """
SELECT t.log_id, CASE WHEN matched IS NULL THEN 'no match in ' || total || ' lines' ELSE matched || ' of ' || total || ' lines match, in ' || n_blocks || ' blocks' END AS summary,
  coalesce(body, '') AS body, coalesce(n_shown, 0) AS n_shown, stop IS NOT NULL AND (coalesce(cut, TRUE) OR last < stop) AS truncated
FROM t LEFT JOIN tx ON tx.log_id = t.log_id LEFT JOIN en ON en.log_id = t.log_id LEFT JOIN mt ON mt.log_id = t.log_id""",
    "trace_tree": with_(SQL_NODES, SQL_EDGES, """
u AS (SELECT DISTINCT caller FROM edges WHERE edge_type <> 'ParentOf' AND callee = 3000005)""") + """
SELECT '3000005' AS ids, 0 AS depth, name AS line FROM code WHERE id = 3000005 UNION ALL SELECT '3000005>' || caller, 1, '  ' || name FROM u JOIN code ON id = caller""",
    "tree_parents": with_(SQL_FILES) + """
SELECT d.path, p.path AS parent_path, p.id AS parent_directory_id FROM dirs d LEFT JOIN dirs p ON d.path <> '' AND p.path = CASE WHEN contains(d.path, '/') THEN regexp_replace(d.path, '/[^/]*$', '') ELSE '' END
WHERE d.path IN ('', 'spam-farm.example.org', 'spam-farm.example.org/en')""",
    "run_history": """
WITH x AS (SELECT user_id, event_id, CASE event_type WHEN 'view' THEN 'index-cancelled' ELSE 'note' END AS code, CASE event_type WHEN 'error' THEN 'error' ELSE 'info' END AS severity, length(repeat(props, 120)) AS size FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN severity = 'error' THEN 0 WHEN code = 'index-cancelled' THEN 1 ELSE 2 END, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM x)
SELECT user_id, user_id % 7 <> 0 AS valid, CASE WHEN user_id % 7 <> 0 THEN 512 END AS scope, CASE WHEN user_id % 7 <> 0 THEN least(16, n) ELSE NULL END AS phases, CASE WHEN user_id % 7 <> 0 THEN least(20, n) ELSE NULL END AS diagnostics,
  CASE WHEN user_id % 7 <> 0 THEN max(CASE WHEN k = 1 THEN code || '/' || severity END) ELSE '' END AS first, CASE WHEN user_id % 7 <> 0 THEN max(CASE WHEN k = 1 THEN least(size, 1024) END) END AS message,
  CASE WHEN user_id % 7 <> 0 THEN CASE WHEN n > 20 THEN 'diagnostics-truncated' ELSE arg_max(code, k) END END AS last FROM r GROUP BY user_id, n""",
    "graph_snapshot": with_(SQL_NODES, SQL_EDGES, SQL_FILES, """
ty AS (SELECT edge_type, count(*) AS n FROM edges GROUP BY edge_type)""") + """
SELECT 'ready' AS state, (SELECT count(*) FROM pages) AS documents, (SELECT count(*) FROM dirs) AS directories, (SELECT count(*) FROM proj) AS projects, (SELECT count(*) FROM code) AS code_nodes, 0 AS code_vectors,
  (SELECT count(*) FROM edges) AS edges, 0 AS memories, 0 AS http_nodes, 0 AS package_nodes, 1 AS languages,
  (SELECT '[' || string_agg('{"edge_type":"' || edge_type || '","n":' || n || '}', ',' ORDER BY edge_type) || ']' FROM ty) AS edge_types""",
    "log_terms": with_(LINES, f"""
w AS (SELECT log_id, line_number, {terms("text")} AS t FROM li)""") + """
SELECT log_id, line_number FROM w WHERE len(list_filter(range(1, len(t)), lambda i: t[i] = 'de' AND starts_with(t[i + 1], 'la'))) > 0 AND NOT list_contains(t, 'le')""",
    "log_match": with_(LINES, f"""
w AS (SELECT log_id, line_number, {terms("text")} AS t FROM li),
h AS (SELECT *, len(list_filter(t, lambda x: starts_with(x, 'licens'))) > 0 AS a, len(list_filter(range(1, len(t)), lambda i: t[i] = 'de' AND t[i + 1] = 'la')) > 0 AS b, list_contains(t, 'la') AS c, list_contains(t, 'not') AND list_contains(t, 'there') AS never,
  list_contains(t, 'der') AND list_contains(t, 'und') AS e, list_contains(t, 'die') OR len(list_filter(t, lambda x: starts_with(x, 'wer'))) > 0 AS f, len(t) > 1 AND t[1] = 'the' AND starts_with(t[2], 're') AS g FROM w)""") + """
SELECT log_id, line_number FROM h WHERE ((a OR (b AND NOT c)) AND never AND len(list_filter(range(1, len(t)), lambda i: t[i] = 'not' AND t[i + 1] = 'there')) > 0) OR (e AND NOT f) OR g""",
    "fact_nodes": """
WITH h AS (SELECT *, CASE WHEN l_partkey % 4 <> 0 THEN upper(sha256(l_partkey::VARCHAR)) END AS th, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC) AS r FROM lineitem),
g AS (SELECT l_orderkey, count(*) AS n_parts, sha256(string_agg(th, '' ORDER BY th)) AS body_hash FROM h GROUP BY l_orderkey)
SELECT 'code:p' || h.l_orderkey % 3 || ':T:O' || h.l_orderkey AS canonical_id, 'src/' || h.l_orderkey || '/' || l_linenumber || '.cs' AS path, CAST(l_linenumber * 10 AS BIGINT) AS start_line,
  'O' || h.l_orderkey || chr(10) || 'Order ' || h.l_orderkey || ' Part' || l_partkey || ', line ' || l_linenumber || '.' || CASE WHEN l_linenumber % 2 = 0 THEN chr(10) || 'a < b' ELSE '' END AS search_text, body_hash, n_parts
FROM h JOIN g ON g.l_orderkey = h.l_orderkey WHERE r = 1""",
    "changes_normalised": """
WITH e AS (SELECT *, event_id % 6 AS a, 'src/' || user_id || '.md' AS old, 'docs/' || user_id || '.md' AS new, event_id % 5 <> 0 AS old_ok, event_id % 7 <> 0 AS new_ok FROM events),
c AS (
  SELECT ts, CASE a WHEN 3 THEN 'Deleted' ELSE 'DirectoryDeleted' END AS action, old AS path FROM e WHERE a IN (3, 5) AND old_ok
  UNION ALL SELECT ts, 'Added', new FROM e WHERE a IN (3, 5) AND new_ok
  UNION ALL SELECT ts, CASE a WHEN 0 THEN 'Added' WHEN 1 THEN 'Modified' WHEN 2 THEN 'Deleted' ELSE 'DirectoryDeleted' END, new FROM e WHERE a NOT IN (3, 5) AND new_ok),
k AS (SELECT DISTINCT 'docs/' || user_id || '.md' AS path FROM events WHERE user_id % 2 = 0)
SELECT CASE WHEN action = 'Added' AND path IN (SELECT path FROM k) THEN 'Modified' WHEN action = 'Modified' AND path NOT IN (SELECT path FROM k) THEN 'Added' ELSE action END AS action, path, count(*) AS n, min(ts) AS first FROM c GROUP BY 1, 2""",
    "node_lines": with_(SQL_NODES) + " SELECT id, '[' || CASE node_type WHEN 'Interface' THEN 'I' WHEN 'Class' THEN 'C' WHEN 'Field' THEN 'F' ELSE 'M' END || '] `' || id || '` ' || name AS line FROM code",
    "type_histogram": with_(SQL_NODES) + " SELECT coalesce(lower(node_type), 'project') AS type, count(*) AS n FROM nodes GROUP BY 1",
    "project_list": with_(SQL_NODES, SQL_FILES) + """
SELECT p.id, p.canonical_id, p.name, page_id AS project_document_id, path AS relative_path FROM proj p JOIN paths ON page_id = p.id % (SELECT count(*) FROM pages)""",
    "stored_revision": with_(SQL_NODES, SQL_EDGES) + """
SELECT 'graph_nodes' AS name, count(*) AS n, min(id) AS least, max(id) AS most FROM nodes UNION ALL SELECT 'code_nodes', count(*), min(id), max(id) FROM code UNION ALL SELECT 'project_nodes', count(*), min(id), max(id) FROM proj
UNION ALL SELECT 'documents', count(*), min(page_id), max(page_id) FROM pages UNION ALL SELECT 'dependency_edges', count(*), min(caller), max(caller) FROM edges UNION ALL SELECT 'inward', count(*), min(caller), max(caller) FROM edges""",
}
