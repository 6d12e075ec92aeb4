"""SQL twins of the TypeScript queries: what the sample sources must give, stated
over the raw tables."""

from quillgraph.plans.sql import with_

SCRIPTS = """
ns AS (SELECT count(*) AS n FROM supplier),
mo AS (SELECT s_suppkey AS k, s_nationkey AS nat, 'code:ts:src/n' || s_nationkey || '/s' || s_suppkey || '.ts:S' || s_suppkey AS id FROM supplier),
cu AS (SELECT c_custkey AS c, c_nationkey AS nat, c_custkey % n AS s FROM customer, ns WHERE c_custkey % n IN (SELECT s_suppkey FROM supplier)),
tg AS (
  SELECT c, id FROM cu JOIN mo ON k = s WHERE k % 3 <> 0
  UNION SELECT c, id FROM cu JOIN mo ON mo.nat = cu.nat WHERE c % 5 = 0 OR c % 7 = 0
  UNION SELECT c, 'package:src%2Fn' || nat FROM cu WHERE c % 5 = 0 AND nat NOT IN (SELECT nat FROM mo)
  UNION SELECT c, 'package:react:useState' FROM cu WHERE c % 7 = 0
  UNION SELECT c, 'code:ts:packages/kit/lib/main.ts:kit' FROM cu WHERE c % 11 = 0
  UNION SELECT c, unnest(['package:react:React', 'package:react:memo']) FROM cu),
ca AS (SELECT c, 'code:ts:app/c' || c || '.ts:C' || c AS id FROM cu UNION ALL SELECT c, 'code:ts:app/c' || c || '.ts:f' || c FROM cu WHERE c % 2 = 0),
cm AS (SELECT c, 'code:ts:app/c' || c || '.ts:C' || c || '.go' AS id FROM cu),
vi AS (SELECT c, 'code:ts:app/v' || c || '.tsx:' AS v FROM cu WHERE c % 13 = 0)"""

SQL = {
    "typescript_import_edges": with_(SCRIPTS) + """
SELECT x.id AS caller_id, tg.id AS callee_id, 'Import' AS edge_type FROM (SELECT * FROM ca UNION ALL SELECT * FROM cm) x JOIN tg ON tg.c = x.c
UNION ALL SELECT v || unnest(['V' || c, 'W' || c, 'W' || c || '.send', 'W' || c || '.all:static', 'E', 'E.A']), 'package:lib-ui:Box.Item', 'Import' FROM vi""",
    "typescript_exports": with_(SCRIPTS) + """
SELECT id AS canonical_id, 'Class' AS node_type FROM mo UNION ALL SELECT 'code:ts:src/n' || nat || '/s' || k || '.ts:make' || k, 'Method' FROM mo WHERE k % 2 = 0
UNION ALL SELECT id, CASE WHEN contains(id, ':C') THEN 'Class' ELSE 'Method' END FROM ca UNION ALL SELECT 'code:ts:packages/kit/lib/main.ts:kit', 'Field'
UNION ALL SELECT v || 'V' || c, 'Component' FROM vi UNION ALL SELECT v || unnest(['W' || c, 'E']), 'Class' FROM vi""",
    "typescript_members": with_(SCRIPTS) + """
SELECT id || unnest(['.run', '.hidden', '.size', '.constructor']) AS canonical_id, unnest(['Method', 'Property', 'Property', 'Method']) AS node_type, id AS parent_id FROM mo
UNION ALL SELECT id, 'Method', left(id, length(id) - 3) FROM cm UNION ALL SELECT v || 'W' || c || unnest(['.send', '.all:static']), 'Method', v || 'W' || c FROM vi
UNION ALL SELECT v || 'E.A', 'Field', v || 'E' FROM vi""",
    "typescript_nodes": with_(SCRIPTS, """
mt AS (SELECT *, 'src/n' || nat || '/s' || k || '.ts' AS p, 'S' || k AS s, chr(10) AS nl FROM mo),
ct AS (SELECT c, 'app/c' || c || '.ts' AS p, 3 + (c % 5 = 0)::INT + (c % 7 = 0)::INT + 2 * (c % 11 = 0)::INT AS l, ' { go(): void; go(x?: number) { return /[/}]/; } }' AS body FROM cu),
vt AS (SELECT c, 'app/v' || c || '.tsx' AS p, 'send() { return axios.post(''/w'', {}) }' AS send, 'static all() { fetch(`/w/${1}`) }' AS every FROM vi),
no AS (
  SELECT p, s AS name, s AS shown, 3 AS a, 10 AS b, 'Module ' || k || '.' AS note, 'class ' || s || ' {' || nl || '  run(x: number): void;' || nl || '  run(x: string): void { if (x) { go(x); } }' || nl || '  private hidden = 1;' || nl || '  #own = ''{'';' || nl || '  readonly size?: number;' || nl || '  constructor() {}' || nl || '}' AS code FROM mt
  UNION ALL SELECT p, s || '.run', s || '.run()', 5, 5, '', 'run(x: string): void { if (x) { go(x); } }' FROM mt
  UNION ALL SELECT p, s || '.hidden', s || '.hidden', 6, 6, '', 'private hidden = 1;' FROM mt
  UNION ALL SELECT p, s || '.size', s || '.size', 8, 8, '', 'readonly size?: number;' FROM mt
  UNION ALL SELECT p, s || '.constructor', s || '.constructor()', 9, 9, '', 'constructor() {}' FROM mt
  UNION ALL SELECT p, 'make' || k, 'make' || k || '()', 11, 11, '', 'function make' || k || '() {}' FROM mt WHERE k % 2 = 0
  UNION ALL SELECT p, 'C' || c, 'C' || c, l, l, '', 'class C' || c || body FROM ct
  UNION ALL SELECT p, 'C' || c || '.go', 'C' || c || '.go()', l, l, '', 'go(x?: number) { return /[/}]/; }' FROM ct
  UNION ALL SELECT p, 'f' || c, 'f' || c || '()', l + 3, l + 3, '', 'function f' || c || '() { return fetch(''/c/' || c || '''); }' FROM ct WHERE c % 2 = 0
  UNION ALL SELECT 'packages/kit/lib/main.ts', 'kit', 'kit', 1, 1, '', 'kit = 1'
  UNION ALL SELECT p, 'V' || c, 'V' || c, 2, 2, '', 'V' || c || ' = () => <Lib.Box.Item>don''t {`${''}''}`}</Lib.Box.Item>' FROM vt
  UNION ALL SELECT p, 'W' || c, 'W' || c, 3, 6, '', 'class W' || c || ' {' || chr(10) || '  ' || send || chr(10) || '  ' || every || chr(10) || '}' FROM vt
  UNION ALL SELECT p, 'W' || c || '.send', 'W' || c || '.send()', 4, 4, '', send FROM vt
  UNION ALL SELECT p, 'W' || c || '.all:static', 'W' || c || '.all [static]()', 5, 5, '', every FROM vt
  UNION ALL SELECT p, 'E', 'E', 7, 7, '', 'enum E { A = 1, B }' FROM vt
  UNION ALL SELECT p, 'E.A', 'E.A', 7, 7, '', 'A = 1' FROM vt)""") + """
SELECT 'code:ts:' || p || ':' || name AS canonical_id, shown AS display_name, 'ts:' || p || '::' || replace(shown, '()', '') AS fully_qualified_name, a AS start_line, b AS end_line,
  shown || CASE WHEN note = '' THEN '' ELSE chr(10) || note END AS search_text, sha256(code) AS body_hash FROM no""",
    "typescript_http_edges": with_(SCRIPTS) + """
SELECT 'code:ts:app/c' || c || '.ts:f' || c AS caller_id, 'http:GET:%2Fc%2F' || c AS callee_id, 'HttpRequest' AS edge_type FROM cu WHERE c % 2 = 0
UNION ALL SELECT v || 'W' || c || '.send', 'http:POST:%2Fw', 'HttpRequest' FROM vi""",
    "typescript_configs": """
SELECT 'web/n' || n_nationkey AS directory, 'web' AS base, CASE WHEN n_nationkey % 2 = 0 THEN '@app/*=src/*' ELSE '*=lib/*' END AS patterns,
  CASE WHEN n_nationkey % 2 = 0 THEN 'web/n' || n_nationkey ELSE 'web' END AS patterns_directory, CASE WHEN n_nationkey % 2 = 0 THEN 'web/node_modules/@cfg/strict/own.ts' END AS files,
  CASE WHEN n_nationkey % 2 = 0 THEN 'web/n' || n_nationkey || '/src/**/*' ELSE 'web/n3,web/n1/src/*' END AS include,
  CASE WHEN n_nationkey % 2 = 0 THEN 'web/node_modules/@cfg/strict/x/* none */y' ELSE 'web/**/gen*.ts,web/n' || n_nationkey || '/out' END AS exclude FROM nation
UNION ALL SELECT 'web/node_modules/@cfg/strict', NULL, '', 'web/node_modules/@cfg/strict', 'web/node_modules/@cfg/strict/own.ts', NULL, 'web/node_modules/@cfg/strict/x/* none */y'""",
    "typescript_root_files": """
WITH f AS (SELECT DISTINCT c_nationkey AS n, 'web/n' || c_nationkey || '/src/' || CASE WHEN c_custkey % 3 = 0 THEN 'gen' ELSE 'c' END || c_custkey || '.ts' AS path, c_custkey % 3 = 0 AS gen FROM customer)
SELECT 'web/n' || n_nationkey AS directory, path AS relative_path FROM f JOIN nation ON n_nationkey = n WHERE n % 2 = 0
UNION ALL SELECT 'web/n' || n_nationkey, path FROM f, nation WHERE n_nationkey % 2 = 1 AND n IN (1, 3) AND NOT gen""",
    "typescript_reachable": with_(SCRIPTS) + """
SELECT 'app/c' || c || '.ts' AS relative_path FROM cu WHERE c % 7 = 0 UNION SELECT unnest(['src/ring.ts', 'src/all.ts']) UNION SELECT 'src/n' || nat || '/index.ts' FROM mo
UNION SELECT 'src/n' || nat || '/s' || k || '.ts' FROM mo UNION SELECT 'packages/kit/lib/main.ts' FROM cu WHERE c % 77 = 0""",
}
