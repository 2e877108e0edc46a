"""Queries on links: sources, fingerprints, fragments, drift, acceptance."""

from __future__ import annotations

from pyspark.sql import functions as F

from tautline.functions import text as T
from tautline.operators import accept, check, fragments
from tautline.plans.base import DOC_ENDPOINTS, DOC_FILE, DOC_LINKS, DOC_STATES, LINES, PAIRS, SNAPSHOT, SOURCES, TASKS, query, shape
from tautline.sources import tables as S

KEYS = ["layer", "uuid", "n"]


def doc_lines(spark, d):
    """The lines of documents that ends name."""
    return fragments.named_fragments(S.doc_sources(spark, d))


def all_doc_lines(spark, d):
    return fragments.fragments_extract(S.doc_sources(spark, d), ("line",))


@query("scan_sources", f"WITH {SOURCES} SELECT layer, file, lang, n_bytes, hash FROM sources")
def scan_sources(spark, d):
    return S.all_sources(spark, d).drop("text")


@query("endpoints_explode", f"""WITH {DOC_ENDPOINTS}, {PAIRS.strip()}, {TASKS.strip()}
SELECT uuid, n, layer, kind, file, anchor_name AS query, target_layer, task_id FROM de
UNION ALL SELECT uuid, n, layer, kind, file, NULL, target_layer, NULL FROM pe
UNION ALL SELECT uuid, 0, '.', 'structural', file, NULL, NULL, NULL FROM tl UNION ALL SELECT uuid, 1, '.', 'task', NULL, NULL, NULL, doc_id::VARCHAR FROM tl""")  # fmt: skip
def endpoints_explode(spark, d):
    e = S.doc_endpoints(spark, d).unionByName(S.pair_endpoints(spark, d)).unionByName(S.task_endpoints(spark, d))
    written = F.when(F.col("kind") == "task", F.concat(F.lit("task "), "task_id")).when(F.col("kind") == "layer", F.col("target_layer")).otherwise(F.concat_ws(" :: ", "file", "anchor_name"))
    at = lambda n: F.max(F.when(F.col("n") == n, F.struct(written.alias("t"))))["t"]
    records = e.groupBy("layer", "uuid").agg(at(0).alias("link0"), at(1).alias("link1"))
    from tautline.sources.records import parse_endpoints

    return parse_endpoints(records).select("uuid", "n", "layer", "kind", "file", "query", "target_layer", "task_id")


@query("fingerprint_fragments", f"WITH {LINES} SELECT layer, file, line::INT AS ord, sha256(text) AS hash, sha256({shape('text')}) AS shape_hash FROM lines")
def fingerprint_fragments(spark, d):
    f = fragments.fragments_extract(S.doc_sources(spark, d, current=False), ("line",))
    return fragments.fingerprint(f).select("layer", "file", "ord", "hash", "shape_hash")


@query("line_offsets", f"WITH {LINES} SELECT layer, file, line, \"start\", \"end\", sha256(text) AS hash FROM lines")
def line_offsets(spark, d):
    return fragments.line_offsets(S.doc_sources(spark, d, current=False)).select("layer", "file", "line", "start", "end", T.digest(F.col("text")).alias("hash"))


@query("fragments_extract", f"""WITH {LINES},
full_ AS (SELECT *, sum((trim(text, ' ') = '')::INT) OVER (PARTITION BY file ORDER BY line) AS run FROM lines),
par AS (SELECT layer, file, min("start") AS s, max("end") AS e, string_agg(text, chr(10) ORDER BY line) AS text FROM full_ WHERE trim(text, ' ') <> '' GROUP BY layer, file, run),
hp0 AS (SELECT page_id, unnest(x) AS p, generate_subscripts(x, 1) AS i FROM (SELECT page_id, string_split(regexp_replace(html, '(?i)(<h[1-6][\\s>])', chr(1) || '\\1', 'g'), chr(1)) AS x FROM pages)),
hp AS (SELECT *, 'pages/' || page_id || '.html' AS file, sum(strlen(p)) OVER (PARTITION BY page_id ORDER BY i) - strlen(p) AS b FROM hp0),
tag AS (SELECT file, i, lower(regexp_extract(p, '{fragments.HEADING}', 1)) AS name, regexp_extract(p, '{fragments.HEADING}', 2) AS inr, b + strlen(regexp_extract(p, '(?i)^<h[1-6](?:\\s[^>]*)?>')) AS s FROM hp),
ep AS (SELECT page_id, html, unnest(x) AS p, generate_subscripts(x, 1) AS i FROM (SELECT *, regexp_extract_all(html, '{fragments.HTML_PIECE}') AS x FROM pages)),
eo AS (SELECT *, sum(strlen(p)) OVER (PARTITION BY page_id ORDER BY i) AS after, regexp_extract(p, '^<(/?)([a-zA-Z][a-zA-Z0-9]*)', 1) = '/' AS closes, lower(regexp_extract(p, '^<(/?)([a-zA-Z][a-zA-Z0-9]*)', 2)) AS name FROM ep),
el AS (SELECT *, sum(CASE WHEN closes THEN -1 ELSE 1 END) OVER (PARTITION BY page_id, name ORDER BY i) + closes::INT AS lv FROM eo WHERE name NOT IN ('', 'script', 'style', {", ".join(f"'{x}'" for x in fragments.HTML_VOID)}) AND p NOT LIKE '%/>'),
ec AS (SELECT *, lead(closes) OVER w AS nc, lead(after - strlen(p)) OVER w AS e, lag(closes) OVER w AS lc FROM el WINDOW w AS (PARTITION BY page_id, name, lv ORDER BY i)),
ed AS (SELECT *, 'pages/' || page_id || '.html' AS file, sum(CASE WHEN closes THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY i) - 1 AS depth FROM ec WHERE (NOT closes AND nc) OR (closes AND NOT lc)),
em AS (SELECT * FROM ed WHERE NOT closes),
pt AS (SELECT p_partkey AS k, 'parts/p' || p_partkey AS file, 'pub mod m' || p_partkey || ' {{' || chr(10) AS rs0, '    pub fn p' || p_partkey || '() {{' || chr(10) || '        // ' || p_name || chr(10) || '    }}' || chr(10) || '}}' || chr(10) AS rs1,
  '# Part ' || p_partkey || chr(10) || p_type || chr(10) AS md0, '## Name' || chr(10) || p_name AS md1 FROM part)
SELECT layer, file, 'line' AS kind, 'L' || line AS name, line AS ord, 0 AS depth, "start", "end", sha256(text) AS hash FROM lines
UNION ALL SELECT layer, file, 'paragraph', 'P' || row_number() OVER (PARTITION BY file ORDER BY s), (row_number() OVER (PARTITION BY file ORDER BY s))::INT, 0, s, e, sha256(text) FROM par
UNION ALL SELECT '.stratum/web', file, 'element', name, (row_number() OVER (PARTITION BY file ORDER BY after))::INT, depth::INT, after::BIGINT, e::BIGINT, sha256(decode(encode(html)[after + 1:e])) FROM em
UNION ALL SELECT '.stratum/web', file, 'heading', name, (row_number() OVER (PARTITION BY file ORDER BY i))::INT, substr(name, 2, 1)::INT, s::BIGINT, (s + strlen(inr))::BIGINT, sha256(inr) FROM tag WHERE name <> ''
UNION ALL SELECT '.', file || '.rs', 'declaration', 'm' || k, 1, 0, 0, strlen(rs0 || rs1), sha256(rs0 || rs1) FROM pt
UNION ALL SELECT '.', file || '.rs', 'declaration', 'p' || k, 2, 1, strlen(rs0), strlen(rs0 || rs1), sha256(rs1) FROM pt
UNION ALL SELECT '.', file || '.md', 'heading', 'Part ' || k, 1, 0, 0, strlen(md0 || md1), sha256(md0 || md1) FROM pt
UNION ALL SELECT '.', file || '.md', 'heading', 'Name', 2, 1, strlen(md0), strlen(md0 || md1), sha256(md1) FROM pt
UNION ALL SELECT '.', file || '.md', 'heading', 'End', 3, 0, strlen(md0 || md1) + 1, strlen(md0 || md1) + 7, sha256('# End' || chr(10)) FROM pt""")  # fmt: skip
def fragments_extract(spark, d):
    """Lines and paragraphs of documents, elements and headings of pages, declarations of the files that parts stand for."""
    f = fragments.fragments_extract(S.doc_sources(spark, d, current=False), ("line", "paragraph")).unionByName(fragments.fragments_extract(S.page_sources(spark, d), ("element", "heading")))
    f = f.unionByName(fragments.fragments_extract(S.part_sources(spark, d), ("declaration",)))
    return f.select("layer", "file", "kind", "name", "ord", "depth", "start", "end", T.digest(F.col("text")).alias("hash"))


@query("anchor_resolve", f"WITH {SNAPSHOT} SELECT uuid, 1 AS n, na AS node_start, nb AS node_end FROM rs")
def anchor_resolve(spark, d):
    return fragments.anchor_resolve(S.doc_endpoints(spark, d), doc_lines(spark, d)).select("uuid", "n", "node_start", "node_end")


@query("subrange_slice", f"WITH {SNAPSHOT} SELECT uuid, na + 2 AS frag_start, CASE WHEN node IS NOT NULL THEN least(na + 12, nb) END AS frag_end, sha256(node) AS whole_hash FROM rs")
def subrange_slice(spark, d):
    r = fragments.anchor_resolve(S.doc_endpoints(spark, d), doc_lines(spark, d))
    part = fragments.subrange_slice(r.withColumn("rel_start", F.lit(2).cast("long")).withColumn("rel_end", F.lit(12).cast("long"))).select("uuid", "frag_start", "frag_end")
    return part.join(fragments.subrange_slice(r).select("uuid", T.digest(F.col("frag")).alias("whole_hash")), "uuid")


@query("anchor_capture", f"""WITH {SNAPSHOT}, sel AS (SELECT file, ls, fstart, frag, ln, doc_id FROM rs WHERE there AND len(ls) > 1),
cs AS (SELECT file, ln, fstart, frag, unnest([0, 1, 2, 3]) AS k, ls FROM sel),
cp AS (SELECT *, CASE WHEN k = 1 THEN least(2, length(frag)) ELSE 0 END AS c0, CASE k WHEN 0 THEN length(frag) WHEN 1 THEN least(9, length(frag)) ELSE 0 END AS c1 FROM cs WHERE k < 3 OR ln < len(ls)),
cb AS (SELECT *, fstart + strlen(substr(frag, 1, c0)) AS a, CASE WHEN k = 3 THEN fstart + strlen(frag) + 1 ELSE fstart + strlen(substr(frag, 1, c1)) END AS b FROM cp),
cd AS (SELECT DISTINCT ON (file, a, b) * FROM cb)
SELECT '.' AS layer, file, a AS sel_start, b AS sel_end, CASE WHEN k = 3 THEN 'text' ELSE 'line' END AS kind, CASE WHEN k = 3 THEN 'all' ELSE 'L' || ln END AS name, CASE WHEN k < 3 THEN 'all' END AS parent_name,
  CASE WHEN k = 3 THEN a WHEN a <> b AND (a <> fstart OR b <> fstart + strlen(frag)) THEN a - fstart END AS rel_start, CASE WHEN k = 3 THEN b WHEN a <> b AND (a <> fstart OR b <> fstart + strlen(frag)) THEN b - fstart END AS rel_end,
  CASE WHEN k = 3 THEN sha256(frag || chr(10)) WHEN a = b THEN sha256(frag) ELSE sha256(substr(frag, c0 + 1, c1 - c0)) END AS hash FROM cd""")  # fmt: skip
def anchor_capture(spark, d):
    """Selections by line and column in each document's linked line: all of it, some characters inside, a point, and one up to the next line; the line and the whole
    text are anchors."""
    src, lines = S.doc_sources(spark, d), all_doc_lines(spark, d)
    table = fragments.line_offsets(src)
    links = S.doc_links(spark, d).filter("size(split(text, '\n')) > 1").select("file", "ln", F.length("frag").alias("chars"), F.size(F.split("text", "\n")).alias("last"))
    place = lambda k, to, c0, c1: F.struct(F.lit(k).alias("k"), to.alias("to_line"), (c0 + 1).alias("from_col"), (c1 + 1).alias("to_col"))
    zero, chars, ln = F.lit(0), F.col("chars"), F.col("ln")
    four = F.array(place(0, ln, zero, chars), place(1, ln, F.least(F.lit(2), chars), F.least(F.lit(9), chars)), place(2, ln, zero, zero), place(3, F.when(ln < F.col("last"), ln + 1), zero, zero))
    sel = links.select("file", "ln", F.explode(four).alias("s")).select(F.concat_ws("#", "file", F.col("s.k").cast("string")).alias("id"), F.lit(".").alias("layer"), "file", ln.alias("from_line"), "s.from_col", "s.to_line", "s.to_col")
    spans = fragments.selection_spans(sel.filter("to_line is not null"), table)
    whole = src.select("layer", "file", F.lit("text").alias("kind"), F.lit("all").alias("name"), F.lit(0).alias("ord"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end"), "text")
    mine = links.select("file", F.concat(F.lit("L"), F.col("ln").cast("string")).alias("name"))
    return fragments.anchor_capture(spans, lines.join(mine, ["file", "name"], "left_semi").unionByName(whole))


@query("fragment_get", f"""WITH {SNAPSHOT} SELECT uuid AS id, min(sl.i)::INT AS first_line, max(sl.i)::INT AS last_line, sha256(string_agg(t, chr(10) ORDER BY sl.i)) AS content_hash
FROM rs JOIN sl ON sl.file = rs.file AND sl.i BETWEEN node_line - 1 AND node_line + 1 GROUP BY uuid""")  # fmt: skip
def fragment_get(spark, d):
    r = fragments.anchor_resolve(S.doc_endpoints(spark, d), doc_lines(spark, d)).filter("node_start is not null")
    spans = r.select("layer", "file", F.col("uuid").alias("id"), F.col("node_start").alias("start"), F.col("node_end").alias("end"))
    got = fragments.fragment_get(spans, fragments.line_offsets(S.doc_sources(spark, d)), 1, 1)
    return got.select("id", "first_line", "last_line", T.digest(F.col("content")).alias("content_hash"))


@query("fragment_label", f"""WITH {DOC_LINKS}, x AS (SELECT *, list_transform(list_filter(ls, lambda y: trim(y, ' ') <> ''), lambda y: trim(y, ' ')) AS l, list_filter(string_split(frag, ' '), lambda y: y <> '') AS w FROM dl)
SELECT uuid, replace(concat_ws('\\l', file, array_to_string(w[1:6], ' ') || CASE WHEN len(w) > 6 THEN '…' ELSE '' END, 'bytes 0~' || strlen(text),
  CASE WHEN len(l) = 0 THEN NULL WHEN l[1] = l[-1] THEN l[1] ELSE concat_ws('\\l', l[1], '…', l[-1]) END), '"', '''') || '\\l' AS label FROM x""")  # fmt: skip
def fragment_label(spark, d):
    links = S.doc_links(spark, d).select("uuid", "file", F.col("frag").alias("query"), F.lit(0).alias("start"), F.octet_length("text").alias("end"), "text")
    return fragments.fragment_label(links).select("uuid", "label")


@query("check_whole_file", f"WITH {DOC_STATES} SELECT '.' AS layer, uuid, 0 AS n, st0 AS state, r0a AS range_start, r0b AS range_end FROM dr")
def check_whole_file(spark, d):
    return check.check_whole_file(S.doc_endpoints(spark, d), S.doc_sources(spark, d))


@query("check_fragment", f"WITH {DOC_STATES} SELECT '.' AS layer, uuid, 1 AS n, st1 AS state, r1a AS range_start, r1b AS range_end FROM dr")
def check_fragment(spark, d):
    return check.check_fragment(S.doc_endpoints(spark, d), doc_lines(spark, d), S.doc_sources(spark, d))


@query("find_displaced", f"WITH {SNAPSHOT} SELECT uuid, na + off AS new_start, na + off + len1 AS new_end FROM rs JOIN dp USING (uuid)")
def find_displaced(spark, d):
    r = fragments.subrange_slice(fragments.anchor_resolve(S.doc_endpoints(spark, d), doc_lines(spark, d))).filter("hash <> sha2(frag, 256)")
    return check.find_displaced(r).select("uuid", "new_start", "new_end")


@query("check_layer", f"""WITH {PAIRS} SELECT upper AS layer, uuid, 1 AS n, st AS state FROM ps
UNION ALL SELECT lower, uuid, 0, 'OK' FROM ps WHERE NOT removed""")  # fmt: skip
def check_layer(spark, d):
    return check.check_layer(S.pair_endpoints(spark, d)).select("layer", "uuid", "n", "state")


@query("check_task", f"WITH {TASKS} SELECT '.' AS layer, uuid, 1 AS n, CASE WHEN now = old THEN 'OK' ELSE 'ALTERED' END AS state, 0 AS range_start, strlen(now) AS range_end FROM tl")
def check_task(spark, d):
    return check.check_task(S.task_endpoints(spark, d), S.tasks(spark, d))


def everything(spark, d):
    """Endpoints, current sources and fragments, tasks of all links."""
    e = S.doc_endpoints(spark, d).unionByName(S.pair_endpoints(spark, d)).unionByName(S.task_endpoints(spark, d))
    return e, S.doc_sources(spark, d).unionByName(S.chat_sources(spark, d)), doc_lines(spark, d), S.tasks(spark, d)


CHECKED = f"""{DOC_STATES}, {PAIRS.strip()}, {TASKS.strip()},
checked AS (
  SELECT '.' AS layer, uuid, st0 AS state0, st1 AS state1, r0a AS start0, r0b AS end0, r1a AS start1, r1b AS end1, TRUE AS updated FROM dr
  UNION ALL SELECT upper, uuid, 'OK', st, 0, strlen(up), NULL, NULL, TRUE FROM ps
  UNION ALL SELECT lower, uuid, 'OK', 'OK', NULL, NULL, 0, strlen(low), TRUE FROM ps WHERE NOT removed
  UNION ALL SELECT '.', uuid, 'OK', CASE WHEN now = old THEN 'OK' ELSE 'ALTERED' END, 0, strlen(body), 0, strlen(now), TRUE FROM tl)"""


@query("check_links", f"WITH {CHECKED} SELECT * FROM checked")
def check_links(spark, d):
    return check.check_links(*everything(spark, d))


@query("clean_report", f"WITH {CHECKED} SELECT layer, uuid, state0, state1 FROM checked WHERE state0 NOT IN {check.CLEAN} OR state1 NOT IN {check.CLEAN}")
def clean_report(spark, d):
    return check.clean_report(check.check_links(*everything(spark, d))).select("layer", "uuid", "state0", "state1")


LATEST = "CASE WHEN doc_id % 4 <> 3 THEN substr(sha256(file || ':2'), 1, 12) END"


@query("accept_endpoints", f"""WITH {SNAPSHOT}, {PAIRS.strip()}, {TASKS.strip()}, acc AS (
SELECT '.' AS layer, uuid, 0 AS n, sha256(now) AS new_hash, NULL AS new_shape, CASE WHEN there THEN {LATEST} END AS new_commit, CASE WHEN NOT there THEN 'no such file' END AS error FROM rs
UNION ALL SELECT '.', uuid, 1, sha256(node), sha256({shape("node")}), CASE WHEN node IS NOT NULL THEN {LATEST} END, CASE WHEN NOT there THEN 'no such file' WHEN node IS NULL THEN 'anchor not found' END FROM rs
UNION ALL SELECT upper, uuid, 0, sha256(up), NULL, NULL, NULL FROM pp UNION ALL SELECT lower, uuid, 1, sha256(low), NULL, NULL, NULL FROM pp WHERE NOT removed
UNION ALL SELECT upper, uuid, 1, CASE WHEN NOT removed THEN sha256(low) END, NULL, CASE WHEN NOT removed THEN substr(sha256(low), 1, 12) END, CASE WHEN removed THEN 'neighbour has no digest' END FROM pp
UNION ALL SELECT lower, uuid, 0, sha256(up), NULL, substr(sha256(up), 1, 12), NULL FROM pp WHERE NOT removed
UNION ALL SELECT '.', uuid, 0, sha256(body), NULL, {LATEST}, NULL FROM tl UNION ALL SELECT '.', uuid, 1, sha256(now), NULL, substr(sha256('.stratum/worklist/' || doc_id || '.task:2'), 1, 12), NULL FROM tl),
ov AS (SELECT '.' AS layer, uuid, 0 AS n, NULL AS hash, 'pinned' AS "commit" FROM dl WHERE doc_id % 12 = 8 UNION ALL SELECT '.', uuid, 1, 'fixed', NULL FROM dl WHERE doc_id % 12 = 9)
SELECT layer, uuid, n, CASE WHEN error IS NULL THEN coalesce(hash, new_hash) END AS new_hash, new_shape, CASE WHEN error IS NULL THEN coalesce("commit", new_commit) END AS new_commit, error FROM acc LEFT JOIN ov USING (layer, uuid, n)""")  # fmt: skip
def accept_endpoints(spark, d):
    """All ends; some are accepted with a given commit, some with a given digest."""
    twelfth = S.doc_links(spark, d).select(F.lit(".").alias("layer"), "uuid", (F.col("doc_id") % 12).alias("k")).filter("k in (8, 9)")
    given = twelfth.select("layer", "uuid", (F.col("k") - 8).cast("int").alias("n"), F.when(F.col("k") == 9, "fixed").alias("hash"), F.when(F.col("k") == 8, "pinned").alias("commit"))
    return accept.accept_endpoints(*everything(spark, d), S.link_commits(spark, d), given)


@query("accept_bulk", f"""WITH {DOC_STATES}, {PAIRS.strip()}
SELECT uuid, n, new_hash FROM (
  SELECT uuid, 0 AS n, st0 AS st, hash0 IS NULL AS fresh, sha256(now) AS new_hash FROM dr
  UNION ALL SELECT uuid, 1, st1, hash1 IS NULL, sha256(node) FROM dr
  UNION ALL SELECT uuid, 1, st, stored IS NULL, CASE WHEN NOT removed THEN sha256(low) END FROM ps)
WHERE fresh OR st IN ('ALTERED', 'RESTYLED', 'CHAIN_DIRTY')""")  # fmt: skip
def accept_bulk(spark, d):
    e, src, frags, tasks = everything(spark, d)
    now = check.check_endpoints(e, src, frags, tasks).select(*KEYS, "state")
    picked = accept.accept_bulk(accept.upsert_links(e, now))
    new = accept.accept_endpoints(e, src, frags, tasks)
    return picked.select(*KEYS).join(new, KEYS).select("uuid", "n", "new_hash")


@query("upsert_links", f"""WITH {DOC_STATES} SELECT uuid, 0 AS n, st0 AS state, r0a AS range_start, hash0 AS hash FROM dr UNION ALL SELECT uuid, 1, st1, r1a, hash1 FROM dr""")
def upsert_links(spark, d):
    e = S.doc_endpoints(spark, d)
    now = check.check_whole_file(e, S.doc_sources(spark, d)).unionByName(check.check_fragment(e, doc_lines(spark, d), S.doc_sources(spark, d)))
    return accept.upsert_links(e, now).select("uuid", "n", "state", "range_start", "hash")


@query("remove_links", f"""WITH {PAIRS} SELECT upper AS layer, uuid, CASE WHEN stored IS NULL THEN 'TODO' ELSE 'BROKEN' END AS state FROM pp""")
def remove_links(spark, d):
    """All lower records go; what the upper ones then are."""
    e = S.pair_endpoints(spark, d)
    lower = e.filter("n = 0 and kind = 'layer'").select("layer", "uuid")
    return check.check_layer(accept.remove_links(e, lower)).select("layer", "uuid", "state")


@query("resolve_id_prefix", f"""WITH {DOC_LINKS}, req AS (SELECT substr(uuid, 1, 13) AS request FROM dl UNION SELECT uuid FROM dl UNION SELECT 'ffffffff-' || s FROM dl)
SELECT request, min(uuid) AS uuid, count(uuid) AS matches FROM req LEFT JOIN dl ON starts_with(uuid, request) GROUP BY request""")  # fmt: skip
def resolve_id_prefix(spark, d):
    links = S.doc_links(spark, d)
    req = links.select(F.substring("uuid", 1, 13).alias("request")).union(links.select("uuid")).union(links.select(F.concat(F.lit("ffffffff-"), F.col("s").cast("string")))).distinct()
    return accept.resolve_id_prefix(req, links)


@query("worst_state", f"""WITH {DOC_STATES}, e AS (SELECT file, 0 AS n, st0 AS st FROM dr UNION ALL SELECT file, 1, st1 FROM dr),
r AS (SELECT *, CASE st WHEN 'OK' THEN 2 WHEN 'DISPLACED' THEN 3 WHEN 'RESTYLED' THEN 3 WHEN 'PENDING' THEN 5 WHEN 'ALTERED' THEN 6 WHEN 'UNANCHORED' THEN 7 WHEN 'BROKEN' THEN 9 END AS k FROM e)
SELECT file, arg_max(st, k * 10 + n) AS worst FROM r GROUP BY file""")  # fmt: skip
def worst_state(spark, d):
    e = S.doc_endpoints(spark, d)
    now = check.check_whole_file(e, S.doc_sources(spark, d)).unionByName(check.check_fragment(e, doc_lines(spark, d), S.doc_sources(spark, d)))
    return check.worst_state(now.join(e.select(*KEYS, "file"), KEYS), "file")
