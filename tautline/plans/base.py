"""Registry of queries, and the SQL of the canonical tables for DuckDB."""

from __future__ import annotations

from tautline.operators.check import RANK

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def uid(e: str) -> str:
    return "(" + " || '-' || ".join(f"substr(sha256({e}), {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + ")"


def shape(e: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({e}, '\\p{{L}}+', 'w', 'g'), '[0-9]+', 'n', 'g'), '[ \\t\\r\\n]+', '', 'g')"


def ranked(e: str) -> str:
    """A text that orders states from best to worst, then by name."""
    ranks = {s: r for s, r in RANK.items() if s != "NONE"}
    return f"(CASE {e} {' '.join(f"WHEN '{s}' THEN '{r}'" for s, r in ranks.items())} ELSE '1' END || coalesce({e}, 'NONE'))"


LAYER = "CASE WHEN {0} = 0 THEN '.' ELSE array_to_string(list_transform(range(1, CAST({0} AS BIGINT) + 1), lambda t: '.stratum/t' || t), '/') END"
DOC_FILE = "'docs/' || source || '/' || doc_id || '.txt'"
LANG = "CASE regexp_extract(file, '\\.([A-Za-z0-9]+)$', 1) WHEN 'html' THEN 'html' WHEN 'java' THEN 'java' WHEN 'rs' THEN 'rust' WHEN 'md' THEN 'markdown' ELSE 'text' END"

#: One link of each document, its endpoints, current files and their lines.
DOC_LINKS = f"""
dl0 AS (SELECT *, string_split(text, chr(10)) AS ls, doc_id % 10 AS s, {DOC_FILE} AS file, {uid("'doc:' || doc_id")} AS uuid FROM documents),
dl1 AS (SELECT *, 1 + doc_id % len(ls) AS ln, ls[1 + doc_id % len(ls)] AS frag FROM dl0),
dl AS (SELECT *,
  CASE s WHEN 0 THEN NULL WHEN 1 THEN text || ' 0' WHEN 2 THEN replace(text, ' ', '  ') ELSE text END AS base0,
  CASE s WHEN 0 THEN NULL WHEN 1 THEN frag || ' 0' WHEN 2 THEN replace(frag, ' ', '  ') WHEN 4 THEN substr(frag, 4) ELSE frag END AS base1,
  CASE WHEN ln = 1 THEN 0 ELSE strlen(array_to_string(ls[1:ln - 1], chr(10))) + 1 END AS fstart, strlen(frag) AS flen FROM dl1)"""
DOC_ENDPOINTS = f"""{DOC_LINKS},
de AS (
  SELECT '.' AS layer, uuid, 0 AS n, 'structural' AS kind, file, NULL AS anchor_kind, NULL AS anchor_name, NULL AS target_layer, NULL AS task_id, sha256(base0) AS hash, NULL AS shape_hash, base0 AS accepted, strlen(base0) AS accepted_len FROM dl
  UNION ALL
  SELECT '.', uuid, 1, 'structural', file, 'line', (CASE WHEN s = 5 THEN 'X' ELSE '' END) || 'L' || ln, NULL, NULL, sha256(base1), sha256({shape("base1")}), base1, strlen(base1) FROM dl)"""
#: Current files of documents and their lines; what each document link's ends find there (rs); where the accepted digest lies in the anchor (dp).
SNAPSHOT = f"""{DOC_ENDPOINTS},
src AS (SELECT {DOC_FILE} AS file, text FROM documents WHERE doc_id % 10 <> 3),
sl0 AS (SELECT file, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM src),
sl AS (SELECT file, i, 'L' || i AS name, t, (sum(strlen(t) + 1) OVER (PARTITION BY file ORDER BY i) - strlen(t) - 1)::BIGINT AS a FROM sl0),
rs AS (SELECT dl.*, f.file IS NOT NULL AS there, f.text AS now, l.i AS node_line, l.t AS node, l.a AS na, l.a + strlen(l.t) AS nb, w.hash AS hash0, p.hash AS hash1, p.shape_hash AS shape1, p.accepted_len AS len1
  FROM dl JOIN de w ON w.uuid = dl.uuid AND w.n = 0 JOIN de p ON p.uuid = dl.uuid AND p.n = 1 LEFT JOIN src f ON f.file = w.file LEFT JOIN sl l ON l.file = p.file AND l.name = p.anchor_name),
dw AS (SELECT uuid, hash1, len1, encode(node) AS b, unnest(range(0, strlen(node) - len1 + 1)) AS i FROM rs WHERE hash1 <> sha256(node) AND len1 BETWEEN 1 AND strlen(node)),
dp AS (SELECT uuid, min(i) AS off FROM dw WHERE sha256(b[i + 1:i + len1]) = hash1 GROUP BY uuid)"""
#: Both states of document links.
DOC_STATES = f"""{SNAPSHOT},
ds AS (SELECT rs.*, off,
  CASE WHEN NOT there THEN 'BROKEN' WHEN hash0 IS NULL THEN 'PENDING' WHEN hash0 = sha256(now) THEN 'OK' ELSE 'ALTERED' END AS st0,
  CASE WHEN NOT there THEN 'BROKEN' WHEN node IS NULL THEN 'UNANCHORED' WHEN hash1 IS NULL THEN 'PENDING' WHEN hash1 = sha256(node) THEN 'OK' WHEN shape1 = sha256({shape("node")}) THEN 'RESTYLED'
    WHEN off IS NOT NULL THEN 'DISPLACED' ELSE 'ALTERED' END AS st1 FROM rs LEFT JOIN dp USING (uuid)),
dr AS (SELECT *, CASE WHEN there THEN 0 END AS r0a, strlen(now) AS r0b, CASE WHEN st1 = 'DISPLACED' THEN na + off ELSE na END AS r1a, CASE WHEN st1 = 'DISPLACED' THEN na + off + len1 ELSE nb END AS r1b FROM ds)"""
#: Pairs of neighbouring turns, each a chain of two layers; states of the upper and of the lower record's layer end.
PAIRS = f"""
pp AS (SELECT c.conv_id, c.turn, {uid("'pair:' || c.conv_id || ':' || c.turn")} AS uuid, 'chat/' || c.conv_id || '.txt' AS file, c.text AS up, l.text AS low, c.turn % 5 = 4 AS removed,
  CASE c.conv_id % 4 WHEN 0 THEN NULL WHEN 1 THEN sha256(l.text || ' old') ELSE sha256(l.text) END AS stored, {LAYER.format("c.turn")} AS upper, {LAYER.format("(c.turn + 1)")} AS lower
  FROM conversations c JOIN conversations l ON l.conv_id = c.conv_id AND l.turn = c.turn + 1),
pe AS (
  SELECT upper AS layer, uuid, 0 AS n, 'structural' AS kind, file, NULL AS target_layer, sha256(up) AS hash FROM pp
  UNION ALL SELECT upper, uuid, 1, 'layer', NULL, lower, stored FROM pp
  UNION ALL SELECT lower, uuid, 0, 'layer', NULL, upper, sha256(up) FROM pp WHERE NOT removed
  UNION ALL SELECT lower, uuid, 1, 'structural', file, NULL, sha256(low) FROM pp WHERE NOT removed),
ps AS (SELECT *, CASE WHEN removed AND stored IS NULL THEN 'TODO' WHEN removed THEN 'BROKEN' WHEN stored IS NULL THEN 'PENDING' WHEN stored = sha256(low) THEN 'OK' ELSE 'CHAIN_DIRTY' END AS st FROM pp)"""
TASKS = f"""
tk AS (SELECT doc_id, doc_id::VARCHAR AS task_id, quality || ':' || toxic AS text FROM labels),
tl AS (SELECT d.doc_id, {uid("'task:' || d.doc_id")} AS uuid, {DOC_FILE} AS file, d.text AS body, tk.text AS now, CASE WHEN d.doc_id % 6 = 1 THEN tk.text || ' old' ELSE tk.text END AS old
  FROM documents d JOIN tk USING (doc_id) WHERE d.doc_id % 10 <> 3)"""
SOURCES = f"""
sources0 AS (SELECT '.' AS layer, {DOC_FILE} AS file, text FROM documents
  UNION ALL SELECT '.stratum/web', 'pages/' || page_id || '.html', html FROM pages
  UNION ALL SELECT {LAYER.format("turn")}, 'chat/' || conv_id || '.txt', text FROM conversations),
sources AS (SELECT layer, file, {LANG} AS lang, strlen(text) AS n_bytes, text, sha256(text) AS hash FROM sources0)"""
#: Lines of documents: layer, file, line, start, end, text.
LINES = f"""
ln0 AS (SELECT '.' AS layer, {DOC_FILE} AS file, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
ln1 AS (SELECT *, sum(strlen(text) + 1) OVER (PARTITION BY layer, file ORDER BY line) AS upto FROM ln0),
lines AS (SELECT layer, file, line::INT AS line, (upto - strlen(text) - 1)::BIGINT AS "start", (upto - 1)::BIGINT AS "end", text FROM ln1)"""
COMMITS = """
commits AS (SELECT '.' AS layer, 'src/u' || user_id || '.txt' AS file, substr(sha256(event_id::VARCHAR), 1, 12) AS "commit", event_id AS seq, ts, event_type, value FROM events)"""
SYMBOLS = """
defs AS (SELECT 'p' || p_partkey || '/fn().' AS symbol, 'src/f' || (p_partkey % 50) || '.rs' AS file, (p_partkey // 50) * 1000 + 10 AS name_start, (p_partkey // 50) * 1000 + 20 AS name_end,
  (p_partkey // 50) * 1000 AS body_start, (p_partkey // 50) * 1000 + 900 AS body_end FROM part),
occ AS (SELECT 'p' || l_partkey || '/fn().' AS symbol, 'src/f' || (l_orderkey % 50) || '.rs' AS file, (l_orderkey // 50) * 1000 + 100 + l_linenumber * 50 AS "start",
  (l_orderkey // 50) * 1000 + 110 + l_linenumber * 50 AS "end" FROM lineitem)"""
EDGES = f"""{SYMBOLS},
edges AS (SELECT DISTINCT d.symbol AS caller, o.symbol AS callee FROM defs d JOIN occ o ON o.file = d.file AND o."start" >= d.body_start AND o."end" <= d.body_end
  WHERE o.symbol <> d.symbol AND o.symbol IN (SELECT symbol FROM defs))"""
