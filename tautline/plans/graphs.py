"""Queries on chains, lookups, the link graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from tautline.functions import text as T
from tautline.operators import chain, check, fragments, graph
from tautline.operators.ranges import spans_containing
from tautline.plans.base import DOC_ENDPOINTS, DOC_LINKS, DOC_STATES, LAYER, LINES, PAIRS, TASKS, query, ranked, uid
from tautline.plans.links import KEYS, doc_lines
from tautline.sources import tables as S
from tautline.sources.records import parse_endpoints

#: A chain for each conversation: its turns are nested layers, the first and the last one tips.
CHAINS = f"""
cc AS (SELECT conv_id, turn, text, {uid("'conv:' || conv_id")} AS uuid, {LAYER.format("turn")} AS layer, 'chat/' || conv_id || '.txt' AS file, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
cl AS (SELECT *, CASE WHEN turn = 0 THEN file ELSE '<' END AS link0, CASE WHEN turn = last THEN file ELSE '>t' || (turn + 1) END AS link1 FROM cc)"""


def chat_chains(spark, d):
    c = S.table(spark, d, "conversations")
    per = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("turn")), T.turn_layer).alias("layers"))
    file = F.concat(F.lit("chat/"), F.col("conv_id").cast("string"), F.lit(".txt"))
    return per.select(T.link_id(F.lit("conv"), F.col("conv_id").cast("string")).alias("uuid"), "layers", file.alias("first"), file.alias("last"))


def chain_ends(spark, d):
    """Endpoints of the conversation chains with the layers that they point to."""
    e = parse_endpoints(chain.chain_create(chat_chains(spark, d)))
    up = F.regexp_replace("layer", r"/?\.stratum/[^/]+$", "")
    up = F.when(up == "", ".").otherwise(up)
    down = F.concat(F.when(F.col("layer") == ".", "").otherwise(F.concat("layer", F.lit("/"))), F.lit(".stratum/"), F.substring("target_layer", 2, 1 << 30))
    return e.withColumn("target_layer", F.when(F.col("target_layer") == "<", up).when(F.col("target_layer").startswith(">"), down))


@query("chain_create", f"WITH {CHAINS} SELECT layer, uuid, link0, link1 FROM cl")
def chain_create(spark, d):
    return chain.chain_create(chat_chains(spark, d))


@query("chain_roles", f"WITH {CHAINS} SELECT layer, uuid, CASE WHEN turn IN (0, last) THEN 'tip' ELSE 'mid' END AS role, (turn + 1)::INT AS hop, last + 1 AS length FROM cl")
def chain_roles(spark, d):
    return chain.chain_roles(chain_ends(spark, d))


PAIR_STATES = f"""{PAIRS}, pst AS (SELECT upper AS layer, uuid, 'OK' AS state0, st AS state1, file || '' AS link0, lower AS link1 FROM ps
UNION ALL SELECT lower, uuid, 'OK', 'OK', upper, file FROM ps WHERE NOT removed),
ov AS (SELECT uuid, CASE WHEN bool_or(state0 = 'BROKEN' OR state1 = 'BROKEN') THEN 'BROKEN' WHEN bool_or(state1 = 'CHAIN_DIRTY') THEN 'DIRTY' ELSE 'OK' END AS overall, count(*) AS nodes FROM pst GROUP BY uuid)"""


def pair_states(spark, d):
    e = S.pair_endpoints(spark, d)
    return check.check_links(e, S.chat_sources(spark, d), doc_lines(spark, d), S.tasks(spark, d))


@query("chain_list", f"WITH {PAIR_STATES} SELECT * FROM ov ORDER BY uuid")
def chain_list(spark, d):
    return chain.chain_list(pair_states(spark, d))


@query("chain_status", f"WITH {PAIR_STATES} SELECT layer, uuid, state0, state1, link0, link1, overall FROM pst JOIN ov USING (uuid) WHERE overall <> 'OK'")
def chain_status(spark, d):
    states = pair_states(spark, d)
    e = S.pair_endpoints(spark, d)
    written = F.coalesce("file", "target_layer")
    links = e.groupBy("layer", "uuid").agg(F.max(F.when(F.col("n") == 0, written)).alias("link0"), F.max(F.when(F.col("n") == 1, written)).alias("link1"))
    return chain.chain_status(states, links, chain.overall(states).filter("overall <> 'OK'").select("uuid"))


@query("file_index_build", f"WITH {DOC_ENDPOINTS}, {PAIRS.strip()} SELECT file, uuid || '.' || n AS ref, layer FROM de UNION ALL SELECT file, uuid || '.' || n, layer FROM pe WHERE kind = 'structural'")
def file_index_build(spark, d):
    return chain.file_index_build(S.doc_endpoints(spark, d).unionByName(S.pair_endpoints(spark, d)))


@query("file_index_status", f"""WITH {PAIRS}, rec AS (SELECT DISTINCT layer, uuid, conv_id AS modified FROM pe JOIN pp USING (uuid)),
b AS (SELECT layer, count(*) AS refs, max(modified) - CASE WHEN layer LIKE '%t3%' THEN 1 ELSE 0 END AS built_at FROM rec WHERE layer <> '.stratum/t1' GROUP BY layer)
SELECT rec.layer, CASE WHEN max(built_at) IS NULL THEN 'MISSING' WHEN count(*) FILTER (WHERE modified > built_at) > 0 THEN 'STALE' ELSE 'OK' END AS status,
  count(*) FILTER (WHERE modified > built_at) AS newer, greatest(count(*) - coalesce(max(refs), 0), 0) AS missing_refs FROM rec LEFT JOIN b ON b.layer = rec.layer GROUP BY rec.layer""")  # fmt: skip
def file_index_status(spark, d):
    """Records are as new as their conversation's number; the index of one layer is missing and those below turn 3 are old."""
    e = S.pair_endpoints(spark, d).select("layer", "uuid").distinct()
    rec = e.join(S.chat_pairs(spark, d).select("uuid", F.col("conv_id").alias("modified")), "uuid")
    old = F.when(F.col("layer").contains("t3"), 1).otherwise(0)
    built = rec.filter("layer <> '.stratum/t1'").groupBy("layer").agg(F.count("*").alias("refs"), F.max("modified").alias("m")).select("layer", "refs", (F.col("m") - old).alias("built_at"))
    return chain.file_index_status(rec, built)


def ranged(spark, d):
    """Document endpoints with their current states and ranges."""
    e = S.doc_endpoints(spark, d)
    now = check.check_whole_file(e, S.doc_sources(spark, d)).unionByName(check.check_fragment(e, doc_lines(spark, d), S.doc_sources(spark, d)))
    return e.drop("state", "range_start", "range_end").join(now, KEYS)


@query("lookup_by_file", f"""WITH {DOC_STATES}, f AS (SELECT DISTINCT file FROM dl WHERE doc_id IN (SELECT doc_id FROM labels))
SELECT file, '.' AS layer, uuid, 0 AS n, r0a AS range_start, r0b AS range_end, file || ' :: ' || (CASE WHEN s = 5 THEN 'X' ELSE '' END) || 'L' || ln AS other FROM dr WHERE file IN (SELECT file FROM f) AND r0a IS NOT NULL
UNION ALL SELECT file, '.', uuid, 1, r1a, r1b, file FROM dr WHERE file IN (SELECT file FROM f) AND r1a IS NOT NULL""")  # fmt: skip
def lookup_by_file(spark, d):
    labelled = S.table(spark, d, "documents").join(S.table(spark, d, "labels"), "doc_id", "left_semi").select(S.doc_file().alias("file"))
    return chain.lookup_by_file(labelled, ranged(spark, d))


@query("lookup_by_position", f"""WITH {DOC_STATES}, p0 AS (SELECT event_id, user_id, event_id * 37 % 2000 AS byte, 1 + event_id % 41 AS col FROM events),
p AS (SELECT event_id, doc_id AS user_id, CASE WHEN event_id % 2 = 0 THEN byte WHEN col - 1 <= length(l.t) THEN l.a + strlen(substr(l.t, 1, col - 1)) END AS pos FROM p0 JOIN dl ON doc_id = user_id LEFT JOIN sl l ON l.file = dl.file AND l.i = 1 + event_id % len(ls)),
r AS (SELECT doc_id, uuid, 0 AS n, r0a AS a, r0b AS b FROM dr UNION ALL SELECT doc_id, uuid, 1, r1a, r1b FROM dr)
SELECT event_id, uuid, n FROM p JOIN r ON r.doc_id = p.user_id AND a <= pos AND pos < b""")  # fmt: skip
def lookup_by_position(spark, d):
    """Half of the points are bytes, half lines and columns (in characters)."""
    docs = S.table(spark, d, "documents").select(F.col("doc_id").alias("user_id"), S.doc_file().alias("file"), F.size(F.split("text", "\n")).alias("lines"))
    e = S.table(spark, d, "events").select("event_id", "user_id").join(docs, "user_id").withColumn("layer", F.lit("."))
    by_byte = e.filter("event_id % 2 = 0").select("event_id", "layer", "file", (F.col("event_id") * 37 % 2000).alias("at"))
    by_line = e.filter("event_id % 2 <> 0").select("event_id", "layer", "file", (1 + F.col("event_id") % F.col("lines")).cast("int").alias("line"), (1 + F.col("event_id") % 41).cast("int").alias("col"))
    asked = by_line.select("layer", "file").distinct()
    table = fragments.line_offsets(S.doc_sources(spark, d).join(asked, ["layer", "file"], "left_semi"))
    points = by_byte.unionByName(fragments.positions(by_line, table).filter("at is not null").select("event_id", "layer", "file", "at"))
    spans = ranged(spark, d).filter("range_start is not null").select("layer", "file", "uuid", "n", F.col("range_start").alias("start"), F.col("range_end").alias("end"))
    return spans_containing(points, spans, ["layer", "file"]).select("event_id", "uuid", "n")


@query("lens_counts", f"""WITH {DOC_STATES}, x AS (SELECT file, 1 AS line, uuid FROM dr WHERE r0a IS NOT NULL UNION ALL SELECT file, ln, uuid FROM dr WHERE r1a IS NOT NULL)
SELECT '.' AS layer, file, line::INT AS line, count(*) AS links, string_agg(uuid, ',' ORDER BY uuid) AS uuids FROM x GROUP BY file, line""")  # fmt: skip
def lens_counts(spark, d):
    return chain.lens_counts(ranged(spark, d), fragments.line_offsets(S.doc_sources(spark, d)))


@query("status_report", f"""WITH {DOC_STATES}, {PAIRS.strip()}, r AS (
  SELECT '.' AS layer, uuid, regexp_extract(file, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(file, '([^/]*)$', 1) AS name, st0 AS state0, st1 AS state1 FROM dr
  UNION ALL SELECT upper, uuid, 'chat', conv_id || '.txt', 'OK', st FROM ps UNION ALL SELECT lower, uuid, 'chat', conv_id || '.txt', 'OK', 'OK' FROM ps WHERE NOT removed)
SELECT dir, layer, uuid, CASE WHEN name = lag(name) OVER (PARTITION BY dir ORDER BY name, uuid, layer) THEN '' ELSE name END AS name, state0, state1 FROM r""")  # fmt: skip
def status_report(spark, d):
    e = S.doc_endpoints(spark, d).unionByName(S.pair_endpoints(spark, d))
    states = check.check_links(e, S.doc_sources(spark, d).unionByName(S.chat_sources(spark, d)), doc_lines(spark, d), S.tasks(spark, d))
    return chain.status_report(e, states.select("layer", "uuid", "state0", "state1"))


@query("graph_adjacency", f"WITH {PAIRS} SELECT uuid, upper AS layer, lower AS to_layer FROM pp WHERE NOT removed UNION ALL SELECT uuid, lower, upper FROM pp WHERE NOT removed")
def graph_adjacency(spark, d):
    return graph.graph_adjacency(S.pair_endpoints(spark, d))


@query("graph_starts", f"""WITH {PAIRS}, rec AS (SELECT DISTINCT uuid, layer FROM pe),
sel AS (SELECT '.' AS selector UNION SELECT '*' UNION SELECT substr(uuid, 1, 13) FROM pp UNION SELECT file FROM pp)
SELECT DISTINCT selector, uuid, layer FROM sel JOIN rec ON selector = '*' OR (selector = '.' AND layer = '.') OR (length(selector) = 13 AND starts_with(uuid, selector))
UNION SELECT selector, uuid, layer FROM sel JOIN pe ON selector = file""")  # fmt: skip
def graph_starts(spark, d):
    p = S.chat_pairs(spark, d)
    selectors = p.select(F.explode(F.array(F.lit("."), F.lit("*"), F.substring("uuid", 1, 13), "file")).alias("selector")).distinct()
    return graph.graph_starts(selectors, S.pair_endpoints(spark, d))


@query("graph_traverse", f"""WITH {CHAINS}, tips AS (SELECT *, CASE conv_id % 3 WHEN 0 THEN sha256(text || ' old') WHEN 2 THEN sha256(text) END AS tip, CASE WHEN conv_id % 3 = 2 THEN sha256('old') END AS mine FROM cl),
sides AS (SELECT *, CASE WHEN turn IN (0, last) THEN tip END AS side FROM tips), near AS (SELECT *, lag(side) OVER w AS up, lead(side) OVER w AS down FROM sides WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
st AS (SELECT *, CASE WHEN tip IS NULL THEN 'PENDING' WHEN tip = sha256(text) THEN 'OK' ELSE 'ALTERED' END AS st_tip,
  CASE WHEN up IS NULL OR mine IS NULL THEN 'PENDING' WHEN up = mine THEN 'OK' ELSE 'CHAIN_DIRTY' END AS st_up, CASE WHEN down IS NULL OR mine IS NULL THEN 'PENDING' WHEN down = mine THEN 'OK' ELSE 'CHAIN_DIRTY' END AS st_down FROM near)
SELECT uuid || '@.' AS root, uuid, layer, turn::INT AS depth, link0, link1, CASE WHEN turn = 0 THEN st_tip ELSE st_up END AS state0, CASE WHEN turn = last THEN st_tip ELSE st_down END AS state1 FROM st""")  # fmt: skip
def graph_traverse(spark, d):
    """Every conversation's chain from the root layer on: the tips of a third of them hold the current digest, of a third an old one; where
    they hold the current one, the ends that point to layers hold an old digest."""
    e, src = chain_ends(spark, d), S.chat_sources(spark, d)
    conv = S.table(spark, d, "conversations").select(T.link_id(F.lit("conv"), F.col("conv_id").cast("string")).alias("uuid"), T.turn_layer(F.col("turn")).alias("layer"), (F.col("conv_id") % 3).alias("third"), "text")
    tip = F.when(F.col("third") == 0, T.digest(F.concat("text", F.lit(" old")))).when(F.col("third") == 2, T.digest(F.col("text")))
    held = F.when(F.col("kind") == "structural", tip).when(F.col("third") == 2, T.digest(F.lit("old")))
    ends = e.join(conv, ["layer", "uuid"]).withColumn("hash", held).withColumn("anchor_name", F.col("query"))
    states = check.check_whole_file(ends, src).unionByName(check.check_layer(ends))
    reached = graph.graph_traverse(e.filter("layer = '.'").select("uuid", "layer").distinct(), graph.graph_adjacency(e))
    return graph.graph_flat(reached, chain.chain_create(chat_chains(spark, d)), states)


@query("graph_nodes", f"WITH {DOC_STATES} SELECT file || '@.#L' || ln AS id, file, '.' AS layer, ln::INT AS start_line, sha256(frag) AS content_hash, uuid FROM dr WHERE r1a IS NOT NULL")
def graph_nodes(spark, d):
    spans = ranged(spark, d).filter("n = 1 and range_start is not null").select("layer", "file", "uuid", F.col("range_start").alias("start"), F.col("range_end").alias("end"))
    n = graph.graph_nodes(spans, fragments.line_offsets(S.doc_sources(spark, d)))
    return n.select("id", "file", "layer", "start_line", T.digest(F.col("content")).alias("content_hash"), "uuid")


@query("graph_edges", f"""WITH {DOC_STATES}, {PAIRS.strip()}, e AS (SELECT file || '@.#L1' AS a, file || '@.#L' || ln AS b, uuid, st0, st1 FROM dr
  UNION ALL SELECT file || '@' || upper || '#L1', file || '@' || lower || '#L1', uuid, st, 'OK' FROM ps WHERE NOT removed),
f AS (SELECT least(a, b) AS source, greatest(a, b) AS target, substr(uuid, 1, 8) AS label, CASE WHEN a > b THEN st1 ELSE st0 END AS s, CASE WHEN a > b THEN st0 ELSE st1 END AS t FROM e)
SELECT source, target, label, arg_max(s, {ranked("s")}) AS source_state, arg_max(t, {ranked("t")}) AS target_state FROM f GROUP BY source, target, label""")  # fmt: skip
def graph_edges(spark, d):
    r = ranged(spark, d)
    line = F.coalesce(F.regexp_extract("anchor_name", r"([0-9]+)$", 1), F.lit("1"))
    at = lambda n, c: F.max(F.when(F.col("n") == n, c))
    node = F.concat("file", F.lit("@"), "layer", F.lit("#L"), line)
    both = r.groupBy("uuid").agg(at(0, node).alias("a"), at(1, node).alias("b"), at(0, F.col("state")).alias("state_a"), at(1, F.col("state")).alias("state_b"))
    turned = both.select(F.col("b").alias("a"), F.col("a").alias("b"), "uuid", F.col("state_b").alias("state_a"), F.col("state_a").alias("state_b")).filter("a <> b")
    e = S.pair_endpoints(spark, d)
    layers = graph.layer_edges(e, check.check_whole_file(e, S.chat_sources(spark, d)).unionByName(check.check_layer(e)))
    return graph.graph_edges(both.unionByName(turned).select("a", "b", "uuid", "state_a", "state_b").unionByName(layers))


@query("graph_bipartite", f"""WITH {PAIRS}, {TASKS.strip()}
SELECT 'structural' AS type, uuid || '@' || layer AS source, file || '@' || layer AS target, '.' || n AS label FROM pe WHERE kind = 'structural'
UNION ALL SELECT 'structural', uuid || '@.', file || '@.', '.0' FROM tl UNION ALL SELECT 'task', uuid || '@.', 'task ' || doc_id, '.1' FROM tl
UNION ALL SELECT 'chain', least(uuid || '@' || upper, uuid || '@' || lower), greatest(uuid || '@' || upper, uuid || '@' || lower), 'dashed' FROM pp WHERE NOT removed""")  # fmt: skip
def graph_bipartite(spark, d):
    p = S.pair_endpoints(spark, d)
    return graph.graph_bipartite(p.unionByName(S.task_endpoints(spark, d)), graph.graph_adjacency(p))


@query("graph_layout", f"""WITH {DOC_LINKS}, n AS (SELECT file || '@.#L' || ln AS id, file, '.' AS layer, ln AS start_line, 0 AS x FROM dl
  UNION ALL SELECT 'chat/' || conv_id || '.txt@' || {LAYER.format("turn")} || '#L1', 'chat/' || conv_id || '.txt', {LAYER.format("turn")}, 1, turn FROM conversations),
g AS (SELECT *, 'fg_' || regexp_replace(file, '[/.-]', '_', 'g') || '_' || regexp_replace(layer, '[/.-]', '_', 'g') AS "group", regexp_extract(file, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(file, '([^/]*)$', 1) AS name FROM n),
h AS (SELECT *, coalesce(("group" <> lag("group") OVER w)::INT, 0) AS gap, row_number() OVER w AS r FROM g WINDOW w AS (PARTITION BY x ORDER BY layer, dir, name, start_line, id))
SELECT id, x::INT AS x, r - 1 + sum(gap) OVER (PARTITION BY x ORDER BY r) AS y, "group" FROM h""")  # fmt: skip
def graph_layout(spark, d):
    docs = S.doc_links(spark, d).select("file", F.lit(".").alias("layer"), F.col("ln").alias("start_line"))
    chats = S.chat_sources(spark, d).select("file", "layer", F.lit(1).alias("start_line"))
    n = docs.unionByName(chats)
    return graph.graph_layout(n.withColumn("id", F.concat("file", F.lit("@"), "layer", F.lit("#L"), F.col("start_line").cast("string"))))
