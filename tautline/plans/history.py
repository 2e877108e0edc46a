"""Queries on symbols, versions, detectors and streams."""

from __future__ import annotations

import uuid as _uuid

from pyspark.sql import functions as F

from tautline.functions import text as T
from tautline.functions.durable import durable, shared_dir
from tautline.operators import accept, check, detect, fragments, hunks, symbols
from tautline.operators.closure import closure
from tautline.operators.sized import sized
from tautline.plans.base import COMMITS, DOC_LINKS, DOC_STATES, EDGES, PAIRS, SNAPSHOT, SYMBOLS, query, shape
from tautline.plans.links import CHECKED, KEYS, all_doc_lines, doc_lines, everything
from tautline.sources import records
from tautline.sources import tables as S
from tautline.streaming import transitions, watch

#: What each symbol's body says, what is recorded of it: none, an old digest, or the current one.
BODIES = "bodies AS (SELECT 'p' || p_partkey || '/fn().' AS symbol, p_name || ' ' || p_type AS text, p_partkey % 7 AS s FROM part), st AS (SELECT symbol, CASE WHEN s = 1 THEN 'ALTERED' ELSE 'OK' END AS state, s = 0 AS is_new FROM bodies)"
ROOT = "(SELECT min(symbol) FROM defs)"


def bodies(spark, d):
    return S.table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit("/fn().")).alias("symbol"), F.concat_ws(" ", "p_name", "p_type").alias("text"), (F.col("p_partkey") % 7).alias("s"))


def recorded(spark, d):
    b = bodies(spark, d).filter("s <> 0")
    return b.select("symbol", T.digest(F.when(F.col("s") == 1, F.concat("text", F.lit(" old"))).otherwise(F.col("text"))).alias("hash"))


def callees(spark, d):
    return symbols.direct_callees(S.definitions(spark, d), S.occurrences(spark, d))


def reached(spark, d, max_depth=None):
    """Symbols reached from the smallest one."""
    edges = callees(spark, d).select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
    root = S.definitions(spark, d).agg(F.min("symbol").alias("root"))
    return closure(root.select("root", F.col("root").alias("node")), edges, max_depth)


@query("symbol_id_collisions", """WITH x AS (SELECT DISTINCT p_brand || '#' || p_type || '().' AS symbol FROM part UNION SELECT DISTINCT 'scip://' || p_brand || '#' || replace(p_type, ' ', '') || '()' FROM part),
k AS (SELECT symbol, regexp_replace(replace(replace(replace(replace(regexp_replace(symbol, '^(?:scip://)+', ''), '/', '.'), '#', '..'), '()', ''), ' ', ''), '\\.+$', '') || '.sciplink' AS key FROM x)
SELECT key, count(*) AS symbols FROM k GROUP BY key HAVING count(*) > 1""")  # fmt: skip
def symbol_id_collisions(spark, d):
    p = S.table(spark, d, "part")
    a = p.select(F.concat("p_brand", F.lit("#"), "p_type", F.lit("().")).alias("symbol"))
    b = p.select(F.concat(F.lit("scip://"), "p_brand", F.lit("#"), F.replace("p_type", F.lit(" "), F.lit("")), F.lit("()")).alias("symbol"))
    return symbols.symbol_id_collisions(a.union(b))


@query("occurrence_ranges", f"""WITH {SNAPSHOT} SELECT uuid AS id, fstart + strlen(substr(frag, 1, 2)) AS "start", fstart + strlen(substr(frag, 1, 9)) AS "end" FROM rs WHERE there""")
def occurrence_ranges(spark, d):
    raw = S.doc_links(spark, d).select(F.lit(".").alias("layer"), "file", F.col("uuid").alias("id"), F.col("ln").alias("line"), F.lit(2).alias("from_char"), F.when(F.col("s") % 2 == 0, F.col("ln")).alias("to_line"), F.lit(9).alias("to_char"))
    return symbols.occurrence_ranges(raw, fragments.line_offsets(S.doc_sources(spark, d)))


@query("symbol_definitions", f"WITH {SYMBOLS} SELECT * FROM defs")
def symbol_definitions(spark, d):
    """Defining occurrences come from two index documents; the older one has other places."""
    defs = S.definitions(spark, d)
    new = defs.select("symbol", "file", F.lit(1).alias("roles"), F.col("name_start").alias("start"), F.col("name_end").alias("end"), F.lit(1).alias("doc_seq"))
    old = new.withColumns({"start": F.col("start") + 300, "end": F.col("end") + 300, "doc_seq": F.lit(0)})
    return symbols.symbol_definitions(new.unionByName(old), defs.select("file", F.col("body_start").alias("start"), F.col("body_end").alias("end")))


@query("direct_callees", f"WITH {EDGES} SELECT * FROM edges")
def direct_callees(spark, d):
    return callees(spark, d)


@query("callable_at", f"""WITH {SYMBOLS}, sp AS (SELECT DISTINCT file, "start", "end" FROM occ) SELECT sp.file, sp."start", sp."end", min(symbol) AS symbol FROM sp JOIN defs d ON d.file = sp.file AND d.body_start <= sp."start" AND sp."end" <= d.body_end GROUP BY ALL""")
def callable_at(spark, d):
    return symbols.callable_at(S.occurrences(spark, d).select("file", "start", "end"), S.definitions(spark, d))


@query("callable_in_file", f"WITH {SYMBOLS} SELECT file, min(symbol) AS symbol FROM defs GROUP BY file")
def callable_in_file(spark, d):
    return symbols.callable_in_file(S.definitions(spark, d))


@query("occurrences_in_range", f"""WITH {SYMBOLS} SELECT d.symbol AS inside, o.symbol, o."start", count(*) AS n FROM defs d JOIN occ o ON o.file = d.file AND o."start" >= d.body_start AND o."end" <= d.body_end GROUP BY ALL""")
def occurrences_in_range(spark, d):
    spans = S.definitions(spark, d).select(F.col("symbol").alias("inside"), "file", F.col("body_start").alias("o_start"), F.col("body_end").alias("o_end"))
    return symbols.occurrences_in_range(spans, S.occurrences(spark, d)).groupBy("inside", "symbol", "start").agg(F.count("*").alias("n"))


@query("declaration_by_name", f"""WITH {SYMBOLS} SELECT file, symbol AS name, body_start AS "start", body_end AS "end" FROM defs""")
def declaration_by_name(spark, d):
    defs = S.definitions(spark, d)
    body = defs.select("file", F.lit("declaration").alias("kind"), F.col("symbol").alias("name"), F.col("body_start").alias("start"), F.col("body_end").alias("end"))
    name = defs.select("file", F.lit("name").alias("kind"), F.col("symbol").alias("name"), F.col("name_start").alias("start"), F.col("name_end").alias("end"))
    return symbols.declaration_by_name(defs.select("file", F.col("symbol").alias("name")), body.unionByName(name), ["declaration", "name"])


@query("symbol_check", f"WITH {BODIES} SELECT * FROM st")
def symbol_check(spark, d):
    return symbols.symbol_check(bodies(spark, d), recorded(spark, d))


RENAMES = """rn AS (SELECT 'old' || p_partkey || '/fn().' AS symbol, CASE WHEN p_partkey % 5 = 1 THEN 'RENAMED' ELSE 'DELETED' END AS state,
  CASE WHEN p_partkey % 5 = 1 THEN 'p' || p_partkey || '/fn().' END AS new_symbol FROM part WHERE p_partkey % 5 IN (1, 2))"""


@query("symbol_renames", f"WITH {RENAMES} SELECT * FROM rn")
def symbol_renames(spark, d):
    """Records of two fifths of the symbols have other names: half of them at the symbol's place, half where nothing is defined."""
    defs, key = S.definitions(spark, d), F.regexp_extract("symbol", "([0-9]+)", 1).cast("long")
    old = defs.filter((key % 5).isin(1, 2)).withColumn("away", F.when(key % 5 == 2, 905).otherwise(5))
    rec = old.select(F.concat(F.lit("old"), key.cast("string"), F.lit("/fn().")).alias("symbol"), "file", (F.col("body_start") + F.col("away")).alias("start"), (F.col("body_start") + F.col("away") + 10).alias("end"))
    return symbols.symbol_renames(rec, defs)


@query("subgraph_check", f"""WITH RECURSIVE {EDGES}, {BODIES}, {RENAMES}, r AS (SELECT {ROOT} AS symbol UNION SELECT callee FROM r JOIN edges ON caller = symbol)
SELECT {ROOT} AS root, symbol, state FROM r JOIN st USING (symbol) UNION ALL SELECT symbol, symbol, state FROM rn""")  # fmt: skip
def subgraph_check(spark, d):
    """From the smallest symbol, and from every recorded symbol that has another name or none now."""
    renamed = symbol_renames(spark, d)
    roots = S.definitions(spark, d).agg(F.min("symbol").alias("root")).union(renamed.select("symbol"))
    return symbols.subgraph_check(roots, callees(spark, d), symbols.symbol_check(bodies(spark, d), recorded(spark, d)), renamed)


DEPTHS = f"""{EDGES}, w AS (SELECT {ROOT} AS symbol, 0 AS depth UNION SELECT callee, depth + 1 FROM w JOIN edges ON caller = symbol WHERE depth < 3), mn AS (SELECT symbol, min(depth) AS depth FROM w GROUP BY symbol)"""


@query("callee_tree", f"""WITH RECURSIVE {DEPTHS}, {BODIES} SELECT symbol, depth, file, body_start, body_end, (body_start // 1000 + 1)::INT AS first_line, (body_start // 1000 + 1)::INT AS last_line, sha256(rpad(text, 999, ' ')) AS hash
FROM mn JOIN defs USING (symbol) JOIN bodies USING (symbol)""")  # fmt: skip
def callee_tree(spark, d):
    """Three steps from the smallest symbol."""
    r = reached(spark, d, 3).select(F.col("node").alias("symbol"), "depth")
    t = symbols.callee_tree(r, S.definitions(spark, d), S.symbol_lines(spark, d))
    return t.select("symbol", "depth", "file", "body_start", "body_end", F.col("first_line").cast("int").alias("first_line"), F.col("last_line").cast("int").alias("last_line"), T.digest(F.col("content")).alias("hash"))


@query("callee_diff", f"""WITH RECURSIVE {EDGES}, r AS (SELECT {ROOT} AS symbol UNION SELECT callee FROM r JOIN edges ON caller = symbol),
fv AS (SELECT 'p' || p_partkey || '/fn().' AS symbol, '        // ' || p_name || chr(10) AS now, '        // ' || p_name || CASE WHEN p_partkey % 7 = 1 THEN ' old' ELSE '' END || chr(10) AS was FROM part)
SELECT symbol, CASE WHEN was = now THEN 'OK' ELSE 'ALTERED' END AS state FROM r JOIN fv USING (symbol)""")  # fmt: skip
def callee_diff(spark, d):
    """The function of every symbol reached, in its file as accepted and as it is."""
    k = F.regexp_extract("node", "([0-9]+)", 1)
    r = reached(spark, d).select(F.col("node").alias("symbol"), F.lit(".").alias("layer"), F.concat(F.lit("parts/p"), k, F.lit(".rs")).alias("file"), F.concat(F.lit("p"), k).alias("name"), F.lit(1).cast("long").alias("accepted_seq"))
    return detect.callee_diff(r, S.part_versions(spark, d), S.part_sources(spark, d), ["declaration"])


@query("subgraph_health", f"""WITH RECURSIVE {EDGES}, {BODIES}, bad AS (SELECT symbol FROM st WHERE state NOT IN ('OK', 'PENDING') UNION SELECT caller FROM bad JOIN edges ON callee = symbol)
SELECT symbol AS root, symbol NOT IN (SELECT symbol FROM bad) AS healthy FROM defs""")  # fmt: skip
def subgraph_health(spark, d):
    """Each symbol as the root of a link's subgraph."""
    states = symbols.symbol_check(bodies(spark, d), recorded(spark, d))
    return symbols.subgraph_health(S.definitions(spark, d).select(F.col("symbol").alias("root")), callees(spark, d), states)


@query("link_symbol_retrofit", f"""WITH {SYMBOLS}, ff AS (SELECT file, min(symbol) AS f FROM defs GROUP BY file), o AS (SELECT file, l_linenumber AS k, "start", "end" FROM
  (SELECT *, 'src/f' || (l_orderkey % 50) || '.rs' AS file, (l_orderkey // 50) * 1000 + 100 + l_linenumber * 50 AS "start", (l_orderkey // 50) * 1000 + 110 + l_linenumber * 50 AS "end" FROM lineitem))
SELECT o.file, CASE WHEN k = 1 THEN 'set' WHEN k = 2 THEN f ELSE d.symbol END AS subgraph, count(*) AS n FROM o LEFT JOIN ff ON ff.file = o.file LEFT JOIN defs d ON d.file = o.file AND d.body_start <= o."start" AND o."end" <= d.body_end GROUP BY ALL""")  # fmt: skip
def link_symbol_retrofit(spark, d):
    start = F.expr("(l_orderkey div 50) * 1000 + 100 + l_linenumber * 50")
    anchored = F.col("l_linenumber") == 2
    ends = S.table(spark, d, "lineitem").select(
        F.concat_ws(".", "l_orderkey", "l_linenumber").alias("id"), F.concat(F.lit("src/f"), (F.col("l_orderkey") % 50).cast("string"), F.lit(".rs")).alias("file"),
        F.when(~anchored, start).alias("start"), F.when(~anchored, start + 10).alias("end"), F.when(F.col("l_linenumber") == 1, "set").alias("subgraph"),
    )
    return symbols.link_symbol_retrofit(ends, S.definitions(spark, d)).groupBy("file", "subgraph").agg(F.count("*").alias("n"))


ACCEPTED = f"{COMMITS}, acc AS (SELECT file, max(seq) // 2 AS accepted_seq FROM commits GROUP BY file)"


def accepted(spark, d):
    return S.commits(spark, d).groupBy("file").agg(F.expr("max(seq) div 2").alias("accepted_seq"))


@query("latest_commit", f'WITH {COMMITS} SELECT layer, file, arg_max("commit", seq) AS "commit" FROM commits GROUP BY layer, file')
def latest_commit(spark, d):
    return detect.latest_commit(S.commits(spark, d))


@query("file_at_version", f'WITH {ACCEPTED} SELECT file, accepted_seq, arg_max("commit", seq) AS "commit", arg_max(value, seq) AS value FROM acc JOIN commits USING (file) WHERE seq <= accepted_seq GROUP BY file, accepted_seq')
def file_at_version(spark, d):
    return detect.file_at_version(accepted(spark, d), S.commits(spark, d))


@query("change_source", f"""WITH {DOC_STATES}, dc AS (SELECT file, substr(sha256(event_id::VARCHAR), 1, 12) AS "commit", event_id AS seq FROM events JOIN documents ON doc_id = user_id JOIN (SELECT doc_id AS k, file FROM dl) ON k = doc_id),
en AS (SELECT uuid, 0 AS n, file, st0 AS state, CASE WHEN hash0 IS NOT NULL THEN doc_id * 7 END AS acc FROM dr UNION ALL SELECT uuid, 1, file, st1, CASE WHEN hash1 IS NOT NULL THEN doc_id * 7 END FROM dr),
fc AS (SELECT uuid, n, arg_min("commit", seq) AS "first" FROM en JOIN dc USING (file) WHERE seq > acc GROUP BY uuid, n)
SELECT '.' AS layer, uuid, n, file, state, CASE WHEN acc IS NOT NULL THEN coalesce("first", 'UNCOMMITTED') END AS source FROM en LEFT JOIN fc USING (uuid, n) WHERE state <> 'OK'""")  # fmt: skip
def change_source(spark, d):
    """Every event is a commit on the file of the document with its user's number; ends without a digest were never accepted."""
    e = S.doc_endpoints(spark, d)
    now = check.check_whole_file(e, S.doc_sources(spark, d)).unionByName(check.check_fragment(e, doc_lines(spark, d), S.doc_sources(spark, d)))
    number = F.regexp_extract("file", r"([0-9]+)\.txt$", 1).cast("long")
    ends = now.select(*KEYS, "state").join(e.select(*KEYS, "file", F.when(F.col("hash").isNotNull(), number * 7).alias("accepted_seq")), KEYS)
    return detect.change_source(ends, S.doc_commits(spark, d))


#: Ends of all links, what their states are now, and which of them have to be looked at for it.
RECHECKED = f"""all_ends AS (
  SELECT layer, uuid, 0 AS n, state0 AS state, start0::BIGINT AS range_start, end0::BIGINT AS range_end FROM checked UNION ALL SELECT layer, uuid, 1, state1, start1::BIGINT, end1::BIGINT FROM checked),
looked AS (SELECT uuid, 0 AS n FROM dl WHERE doc_id % 4 < 2 UNION ALL SELECT uuid, 1 FROM dl WHERE doc_id % 4 < 2 UNION ALL SELECT uuid, 0 FROM tl WHERE doc_id % 4 < 2 UNION ALL SELECT uuid, 1 FROM tl
  UNION ALL SELECT uuid, n FROM pe WHERE kind = 'layer')"""


@query("prune_unchanged", f"WITH {CHECKED}, {RECHECKED} SELECT e.layer, e.uuid, e.n, state, range_start, range_end, k.uuid IS NOT NULL AS rechecked FROM all_ends e LEFT JOIN (SELECT DISTINCT layer, uuid, n FROM looked JOIN (SELECT layer, uuid FROM checked) USING (uuid) WHERE (layer, uuid, n) IN (SELECT layer, uuid, n FROM pe WHERE kind = 'layer') OR layer = '.' AND uuid NOT IN (SELECT uuid FROM pe)) k ON k.layer = e.layer AND k.uuid = e.uuid AND k.n = e.n")
def prune_unchanged(spark, d):
    """All links checked in an older state of the files, then again where commits came after: a quarter of the documents has changed since,
    for another quarter the accepted commit isn't known."""
    e, src, frags, tasks = everything(spark, d)
    before = S.doc_sources(spark, d, before=True).unionByName(S.chat_sources(spark, d))
    e = e.drop("accepted")  # ends are checked by digests and lengths: accepted texts need not go along
    lines = lambda s: fragments.named_fragments(s.filter(F.col("file").startswith("docs/")))
    cached = durable(accept.upsert_links(e, check.check_endpoints(e, before, lines(before), tasks)), "cached-states")
    rest = F.regexp_extract("file", r"^docs/.*/([0-9]+)\.txt$", 1).try_cast("long") % 4
    ends = cached.withColumn("accepted_seq", F.when(~F.coalesce(rest == 1, F.lit(False)), F.lit(1).cast("long")))
    seq = F.when(rest == 0, 2).otherwise(1).cast("long")
    commits = S.doc_sources(spark, d, current=False).select("layer", "file", seq.alias("seq"))
    return check.recheck(cached, detect.prune_unchanged(ends, commits), src, lines, tasks)


def _trim(e: str) -> str:
    return f"regexp_replace({e}, '\\s+$', '')"


@query("fragment_diff", f"""WITH {SNAPSHOT}, {PAIRS.strip()}, ends AS (
  SELECT upper AS layer, uuid, 0 AS n, file, up AS t FROM pp UNION ALL SELECT lower, uuid, 1, file, low FROM pp WHERE NOT removed
  UNION ALL SELECT upper, uuid, 1, file, low FROM pp WHERE NOT removed UNION ALL SELECT lower, uuid, 0, file, up FROM pp WHERE NOT removed)
SELECT '.' AS layer, uuid, 0 AS n, file, substr(hash0, 1, 12) AS "commit", {_trim("base0")} <> {_trim("now")} AS changed, 1 AS first_line, len(string_split(now, chr(10)))::INT AS last_line FROM rs WHERE there AND hash0 IS NOT NULL
UNION ALL SELECT '.', uuid, 1, file, substr(hash1, 1, 12), {_trim("base1")} <> {_trim("node")}, node_line::INT, node_line::INT FROM rs WHERE node IS NOT NULL AND hash1 IS NOT NULL
UNION ALL SELECT layer, uuid, n, file, substr(sha256(t), 1, 12), FALSE, 1, len(string_split(t, chr(10)))::INT FROM ends""")  # fmt: skip
def fragment_diff(spark, d):
    """Ends of document links and of pairs of turns, in the version that was accepted and in the current one."""
    e = S.doc_endpoints(spark, d).unionByName(S.pair_endpoints(spark, d))
    versions = S.doc_versions(spark, d).unionByName(S.chat_versions(spark, d))
    r = detect.fragment_diff(e, versions, S.doc_sources(spark, d).unionByName(S.chat_sources(spark, d)))
    return r.withColumns({c: F.col(c).cast("int") for c in ("first_line", "last_line")})


@query("line_delta", f"""WITH {DOC_LINKS}, b AS (SELECT uuid AS id, unnest(string_split(base0, chr(10))) AS t FROM dl WHERE s NOT IN (0, 3)), a AS (SELECT uuid AS id, unnest(ls) AS t FROM dl WHERE s NOT IN (0, 3)),
bn AS (SELECT id, sha256(t) AS hash, row_number() OVER (PARTITION BY id, t) AS k FROM b), an AS (SELECT id, sha256(t) AS hash, row_number() OVER (PARTITION BY id, t) AS k FROM a)
SELECT id, hash, '-' AS sign, k FROM bn ANTI JOIN an USING (id, hash, k) UNION ALL SELECT id, hash, '+', k FROM an ANTI JOIN bn USING (id, hash, k)""")  # fmt: skip
def line_delta(spark, d):
    return detect.line_delta(S.doc_links(spark, d).filter("s not in (0, 3)").select(F.col("uuid").alias("id"), F.col("base0").alias("before"), F.col("text").alias("after")))


def missing(spark, d, ends=None):
    """Whole-file ends whose file is gone."""
    return (S.doc_endpoints(spark, d) if ends is None else ends).filter("n = 0").join(S.doc_sources(spark, d), ["layer", "file"], "left_anti").select("uuid", "n", "hash", F.col("accepted").alias("text"))


MISSING = f"{SNAPSHOT}, cur AS (SELECT * FROM rs WHERE there), mis AS (SELECT * FROM rs WHERE NOT there)"


@query("detect_moved", f"WITH {MISSING} SELECT m.uuid, 0 AS n, min(c.file) AS new_file, count(*) AS candidates FROM mis m JOIN cur c ON c.text = m.text GROUP BY m.uuid")
def detect_moved(spark, d):
    return detect.detect_moved(missing(spark, d), S.doc_sources(spark, d))


@query("detect_moved_similar", f"""WITH {MISSING}, a AS (SELECT DISTINCT uuid, sha256(t) AS h FROM (SELECT uuid, unnest(ls) AS t FROM mis)), b AS (SELECT DISTINCT file, sha256(t) AS h FROM (SELECT file, unnest(ls) AS t FROM cur)),
na AS (SELECT uuid, count(*) AS na FROM a GROUP BY uuid), nb AS (SELECT file, count(*) AS nb FROM b GROUP BY file), p AS (SELECT uuid, file, count(*) AS common FROM a JOIN b USING (h) GROUP BY uuid, file),
j AS (SELECT uuid, file, round(common / (na + nb - common), 6) AS similarity FROM p JOIN na USING (uuid) JOIN nb USING (file))
SELECT uuid, file AS new_file, similarity FROM j WHERE similarity >= 0.5 QUALIFY row_number() OVER (PARTITION BY uuid ORDER BY similarity DESC, file) = 1""")  # fmt: skip
def detect_moved_similar(spark, d):
    return detect.detect_moved_similar(missing(spark, d).select("uuid", "text"), S.doc_sources(spark, d).select("file", "text"))


@query("detect_reanchored", f"WITH {SNAPSHOT} SELECT uuid, 1 AS n, 'L' || min(sl.i) AS new_name FROM rs JOIN sl ON sl.file = rs.file AND sha256(sl.t) = hash1 WHERE node IS NULL GROUP BY uuid")
def detect_reanchored(spark, d):
    r = fragments.anchor_resolve(S.doc_endpoints(spark, d).join(S.doc_sources(spark, d).select("layer", "file"), ["layer", "file"], "left_semi"), doc_lines(spark, d))
    return reanchored(spark, d, r.filter("node_start is null"))


def reanchored(spark, d, ends):
    """Only lines of files with an end that has lost its anchor are looked at."""
    ends = durable(ends.select("uuid", "n", "layer", "file", "anchor_kind", "anchor_name", "hash"), "unanchored")
    files = durable(ends.select("layer", "file").distinct(), "unanchored-files")
    src = S.doc_sources(spark, d).join(sized(files, other="shuffle_hash"), ["layer", "file"], "left_semi")
    return detect.detect_reanchored(ends, fragments.fragments_extract(src, ("line",)))


def written_ends(spark, d):
    """The document links' ends, worked out once; of accepted texts those of anchors alone."""
    return durable(S.doc_endpoints(spark, d).withColumn("accepted", F.when(F.col("anchor_name").isNotNull(), F.col("accepted"))), "ends")


#: Whether the line of a link still holds what was accepted of it, with its shape.
GROWN = f"""base1 <> '' AND contains(frag, base1) AND {shape("substr(frag, 1, instr(frag, base1) - 1)")} || {shape("base1")} || {shape("substr(frag, instr(frag, base1) + length(base1))")} = {shape("frag")}"""


@query("detect_expanded", f"WITH {SNAPSHOT} SELECT uuid, 1 AS n, CASE WHEN {GROWN} THEN 'EXPANDED' ELSE 'ALTERED' END AS state FROM rs WHERE hash1 <> sha256(node)")
def detect_expanded(spark, d):
    r = fragments.subrange_slice(fragments.anchor_resolve(S.doc_endpoints(spark, d), doc_lines(spark, d))).filter("node_start is not null and hash is not null and hash <> sha2(frag, 256)")
    return detect.detect_expanded(r)


@query("detect_deleted", f"""WITH {MISSING} SELECT m.uuid, 0 AS n, 'DELETED' AS state, (SELECT substr(sha256(max(d.doc_id)::VARCHAR), 1, 12) FROM dl d WHERE d.text = m.text) AS "commit" FROM mis m WHERE m.text NOT IN (SELECT text FROM cur)""")
def detect_deleted(spark, d):
    docs = S.table(spark, d, "documents")
    versions = docs.select(T.digest(F.col("text")).alias("hash"), F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 12).alias("commit"), F.col("doc_id").alias("seq"))
    return detect.detect_deleted(missing(spark, d), S.doc_sources(spark, d), versions)


@query("hunk_overlap", f"""WITH {DOC_LINKS}, df AS (SELECT file, i FROM (SELECT file, unnest(string_split(base0, chr(10))) AS b, unnest(ls) AS t, generate_subscripts(ls, 1) AS i FROM dl WHERE s NOT IN (0, 3)) WHERE b <> t),
hi AS (SELECT file, i, i - row_number() OVER (PARTITION BY file ORDER BY i) AS g FROM df), hk AS (SELECT file, min(i) AS a, max(i) AS b FROM hi GROUP BY file, g),
fh AS (SELECT uuid, file, ln, a, b FROM dl JOIN hk USING (file))
SELECT uuid, file, 'WITHIN' AS place, a AS hunk_start, b AS hunk_end, 1 AS hunks, NULL::BIGINT AS shift FROM fh WHERE ln BETWEEN a AND b
UNION ALL SELECT uuid, file, 'BEFORE', max(a), max(b), count(*), 0 FROM fh WHERE b < ln GROUP BY uuid, file UNION ALL SELECT uuid, file, 'AFTER', min(a), min(b), count(*), NULL FROM fh WHERE a > ln GROUP BY uuid, file""")  # fmt: skip
def hunk_overlap(spark, d):
    """The lines of document links against the hunks between the accepted and the current text."""
    links = S.doc_links(spark, d)
    pairs = links.filter("s not in (0, 3)").select(F.col("file").alias("id"), F.col("base0").alias("before"), F.col("text").alias("after"))
    found = durable(hunks.line_hunks(pairs).withColumnRenamed("id", "file"), "hunks")
    return hunks.hunk_overlap(found, links.select("file", "uuid", F.col("ln").alias("first"), F.col("ln").alias("last")))


FIXES = f"""{DOC_STATES}, cur AS (SELECT * FROM dr WHERE there), fx AS (
SELECT m.uuid, 0 AS n, 'MOVED' AS state, 'file' AS field, m.file AS old, min(c.file) AS "new" FROM dr m JOIN cur c ON c.text = m.text WHERE NOT m.there GROUP BY m.uuid, m.file
UNION ALL SELECT uuid, 1, CASE WHEN {GROWN} THEN 'EXPANDED' ELSE 'DISPLACED' END, 'range', CASE WHEN {GROWN} THEN r1a || '~' || r1b ELSE fstart || '~' || (fstart + flen) END,
  CASE WHEN {GROWN} THEN fstart || '~' || (fstart + flen) ELSE r1a || '~' || r1b END FROM dr WHERE st1 = 'DISPLACED'
UNION ALL SELECT dr.uuid, 1, 'REANCHORED', 'anchor', max(de.anchor_name), 'L' || min(sl.i) FROM dr JOIN de ON de.uuid = dr.uuid AND de.n = 1 JOIN sl ON sl.file = dr.file AND sha256(sl.t) = hash1 WHERE st1 = 'UNANCHORED' GROUP BY dr.uuid)"""


@query("pending_fixes", f"WITH {FIXES} SELECT * FROM fx")
def pending_fixes(spark, d, ends=None):
    """uuid, n, state, field, old, new of what moved, displaced, expanded and reanchored ends would store. An anchor without a range of its own
    whose accepted text has only grown is widened to what it is now; any other place of the accepted text is where the end was displaced to."""
    e, lines = written_ends(spark, d) if ends is None else ends, doc_lines(spark, d)
    fix = lambda df, state, field, old, new: df.select("uuid", "n", F.lit(state).alias("state"), F.lit(field).alias("field"), old.alias("old"), new.alias("new"))
    span = lambda a, b: F.concat_ws("~", F.col(a).cast("string"), F.col(b).cast("string"))
    file = fix(detect.detect_moved(missing(spark, d, e), S.doc_sources(spark, d)).join(e.select("uuid", "n", "file"), ["uuid", "n"]), "MOVED", "file", F.col("file"), F.col("new_file"))
    states = durable(check.check_fragment(e, lines, S.doc_sources(spark, d)).select(*KEYS, "state"), "states")
    of = lambda state: e.join(states.filter(F.col("state") == state).select(*KEYS), KEYS, "left_semi")
    found = durable(check.find_displaced(fragments.subrange_slice(fragments.anchor_resolve(of("DISPLACED"), lines))), "displaced")
    found = found.join(detect.detect_expanded(found).withColumnRenamed("state", "grown"), ["uuid", "n"])
    wider = (F.col("grown") == "EXPANDED") & F.col("rel_start").isNull() & F.col("rel_end").isNull()
    ranges = fix(found.filter(wider), "EXPANDED", "range", span("new_start", "new_end"), span("node_start", "node_end")).unionByName(fix(found.filter(~wider), "DISPLACED", "range", span("frag_start", "frag_end"), span("new_start", "new_end")))
    anchor = fix(reanchored(spark, d, of("UNANCHORED")).join(e.select("uuid", "n", "anchor_name"), ["uuid", "n"]), "REANCHORED", "anchor", F.col("anchor_name"), F.col("new_name"))
    return file.unionByName(ranges).unionByName(anchor)


@query("apply_fixes", f"""WITH {FIXES}, e AS (SELECT uuid, 0 AS n, file, NULL AS name FROM dl UNION ALL SELECT uuid, 1, file, (CASE WHEN s = 5 THEN 'X' ELSE '' END) || 'L' || ln FROM dl)
SELECT e.uuid, e.n, coalesce(f."new", e.file) AS file, coalesce(a."new", e.name) AS anchor_name, split_part(r."new", '~', 1)::BIGINT AS range_start, split_part(r."new", '~', 2)::BIGINT AS range_end FROM e
LEFT JOIN fx f ON f.uuid = e.uuid AND f.n = e.n AND f.field = 'file' LEFT JOIN fx a ON a.uuid = e.uuid AND a.n = e.n AND a.field = 'anchor' LEFT JOIN fx r ON r.uuid = e.uuid AND r.n = e.n AND r.field = 'range'""")  # fmt: skip
def apply_fixes(spark, d):
    """The document links' ends with all pending fixes stored."""
    ends = written_ends(spark, d)
    fixed = accept.apply_fixes(ends, pending_fixes(spark, d, ends).withColumn("layer", F.lit(".")))
    return fixed.select("uuid", "n", "file", "anchor_name", "range_start", "range_end")


@query("opposite_fragment", f"""WITH {SNAPSHOT}, {PAIRS.strip()}, op AS (
  SELECT '.' AS layer, uuid, 0 AS n, 'side' AS route, file, node_line AS first_line, node_line AS last_line, node AS t FROM rs WHERE node IS NOT NULL
  UNION ALL SELECT '.', uuid, 1, 'side', file, 1, len(string_split(now, chr(10))), now FROM rs WHERE there
  UNION ALL SELECT upper, uuid, 0, 'layer', file, 1, len(string_split(low, chr(10))), low FROM pp WHERE NOT removed UNION ALL SELECT upper, uuid, 1, 'side', file, 1, len(string_split(up, chr(10))), up FROM pp
  UNION ALL SELECT lower, uuid, 0, 'side', file, 1, len(string_split(low, chr(10))), low FROM pp WHERE NOT removed UNION ALL SELECT lower, uuid, 1, 'layer', file, 1, len(string_split(up, chr(10))), up FROM pp WHERE NOT removed)
SELECT layer, uuid, n, route, file, first_line::INT AS first_line, last_line::INT AS last_line, sha256(t) AS other_hash FROM op""")  # fmt: skip
def opposite_fragment(spark, d):
    """What stands opposite every end of the document links and of the pairs of turns."""
    e = S.doc_endpoints(spark, d).unionByName(S.pair_endpoints(spark, d))
    src = S.doc_sources(spark, d).unionByName(S.chat_sources(spark, d))
    got = fragments.opposite_fragment(e.select(*KEYS), e, src, doc_lines(spark, d))
    return got.select(*KEYS, "route", "file", F.col("first_line").cast("int").alias("first_line"), F.col("last_line").cast("int").alias("last_line"), T.digest(F.col("content")).alias("other_hash"))


def _modified():
    return F.when(F.col("event_type") == "click", "modify").otherwise(F.col("event_type"))


@query("watch_alerts", """WITH ch AS (SELECT event_id, 'src/u' || user_id || '.txt' AS file FROM events WHERE event_type = 'click'),
li AS (SELECT 'c' || c_custkey AS uuid, CASE c_custkey % 4 WHEN 0 THEN 'repo/src/u' || c_custkey || '.txt' WHEN 1 THEN 'src/u' || c_custkey || '.txt' WHEN 2 THEN c_custkey || '.txt' ELSE 'src/u' || c_custkey || '.txt.bak' END AS linked FROM customer),
fp AS (SELECT file, uuid FROM (SELECT DISTINCT file FROM ch) JOIN li ON contains(file, linked) OR contains(linked, file))
SELECT event_id, file, uuid FROM ch JOIN fp USING (file)""")  # fmt: skip
def watch_alerts(spark, d):
    """Clicks are changes of a user's file; every customer's file is linked: by a path within the repository, by the same one, by the end of one that
    other files have as well, or by that of a copy beside it."""
    schema = S.table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    changes = stream.select("event_id", F.concat(F.lit("src/u"), F.col("user_id").cast("string"), F.lit(".txt")).alias("file"), _modified().alias("event_type"))
    name = F.concat(F.col("c_custkey").cast("string"), F.lit(".txt"))
    form = F.col("c_custkey") % 4
    path = F.when(form == 0, F.concat(F.lit("repo/src/u"), name)).when(form == 1, F.concat(F.lit("src/u"), name)).when(form == 2, name).otherwise(F.concat(F.lit("src/u"), name, F.lit(".bak")))
    linked = S.table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("uuid"), path.alias("file"))
    out = f"{shared_dir(spark)}/alerts-{_uuid.uuid4().hex}"
    alerts = watch.watch_alerts(changes, linked)
    watch.run_available(alerts, f"{out}/rows", f"{out}/checkpoint")
    return spark.read.schema(alerts.schema).parquet(f"{out}/rows")


#: What an event makes of the text of its user's document; the states of its ends for each of these texts; an acceptance in the first pair of the user's conversation.
VARIANTS = """CASE k WHEN 0 THEN now WHEN 1 THEN now || ' 0' WHEN 2 THEN replace(now, ' ', '  ') END"""


@query("watch_transitions", f"""WITH {SNAPSHOT}, {PAIRS.strip()},
vt AS (SELECT uuid, doc_id, k, hash0, hash1, shape1, len1, {VARIANTS.replace("now", "text")} AS t, ln, s FROM (SELECT rs.*, unnest(range(0, 4)) AS k FROM rs WHERE doc_id IN (SELECT user_id FROM events))),
vn AS (SELECT vt.*, CASE WHEN e.anchor_name = 'L' || ln THEN string_split(t, chr(10))[ln] END AS nd FROM vt JOIN de e ON e.uuid = vt.uuid AND e.n = 1),
vw AS (SELECT uuid, k, hash1, len1, encode(nd) AS b, unnest(range(0, strlen(nd) - len1 + 1)) AS i FROM vn WHERE hash1 <> sha256(nd) AND len1 BETWEEN 1 AND strlen(nd)),
vd AS (SELECT DISTINCT uuid, k, TRUE AS hit FROM vw WHERE sha256(b[i + 1:i + len1]) = hash1),
vs AS (SELECT uuid, doc_id, k, CASE WHEN t IS NULL THEN 'BROKEN' WHEN hash0 IS NULL THEN 'PENDING' WHEN hash0 = sha256(t) THEN 'OK' ELSE 'ALTERED' END AS st0,
  CASE WHEN t IS NULL THEN 'BROKEN' WHEN nd IS NULL THEN 'UNANCHORED' WHEN hash1 IS NULL THEN 'PENDING' WHEN hash1 = sha256(nd) THEN 'OK' WHEN shape1 = sha256({shape("nd")}) THEN 'RESTYLED' WHEN hit THEN 'DISPLACED' ELSE 'ALTERED' END AS st1 FROM vn LEFT JOIN vd USING (uuid, k)),
pa AS (SELECT uuid, upper, lower, stored, event_id, CASE WHEN event_id % 2 = 0 THEN sha256(low) ELSE sha256(low || ' x') END AS hash FROM pp JOIN events ON user_id = conv_id WHERE turn = 0 AND event_type = 'purchase'),
tr AS (SELECT uuid, '.' AS layer, 0 AS n, event_id, st0 AS st FROM events JOIN vs ON doc_id = user_id AND k = event_id % 4 UNION ALL SELECT uuid, '.', 1, event_id, st1 FROM events JOIN vs ON doc_id = user_id AND k = event_id % 4
  UNION ALL SELECT uuid, upper, 1, event_id, CASE WHEN stored IS NULL THEN 'PENDING' WHEN stored = hash THEN 'OK' ELSE 'CHAIN_DIRTY' END FROM pa UNION ALL SELECT uuid, lower, 1, event_id, 'OK' FROM pa),
tc AS (SELECT *, lag(st) OVER (PARTITION BY uuid, layer, n ORDER BY event_id) AS was FROM tr)
SELECT uuid, layer, n, event_id, was AS state, st AS new_state FROM tc WHERE was IS NULL OR was <> st""")  # fmt: skip
def watch_transitions(spark, d):
    """Every event gives the document with its user's number another text, or takes its file away; purchases also accept a digest in the lower record of
    the first pair of turns of the conversation with that number."""
    schema = S.table(spark, d, "events").schema
    e = S.doc_endpoints(spark, d).unionByName(S.pair_endpoints(spark, d))
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).select("event_id", "user_id", "event_type")
    docs = S.table(spark, d, "documents").select(F.col("doc_id").alias("user_id"), S.doc_file().alias("file"), "text")
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.col("text")).when(k == 1, F.concat("text", F.lit(" 0"))).when(k == 2, F.replace("text", F.lit(" "), F.lit("  ")))
    none = lambda t, c: F.lit(None).cast(t).alias(c)
    files = stream.join(docs, "user_id").select("event_id", F.lit("file").alias("what"), F.lit(".").alias("layer"), "file", text.alias("text"), none("string", "uuid"), none("int", "n"), none("string", "hash"), none("string", "shape_hash"), none("long", "accepted_len"))
    pairs = S.chat_pairs(spark, d).filter("turn = 0").select(F.col("conv_id").alias("user_id"), "uuid", "low")
    low = F.when(F.col("event_id") % 2 == 0, F.col("low")).otherwise(F.concat("low", F.lit(" x")))
    accepts = stream.filter("event_type = 'purchase'").join(pairs, "user_id").select("event_id", F.lit("accept").alias("what"), T.turn_layer(F.lit(1)).alias("layer"), none("string", "file"), none("string", "text"), "uuid", F.lit(1).alias("n"), T.digest(low).alias("hash"), none("string", "shape_hash"), F.octet_length(low).cast("long").alias("accepted_len"))
    out = f"{shared_dir(spark)}/transitions-{_uuid.uuid4().hex}"
    found = transitions.transitions(files.unionByName(accepts), e)
    watch.run_available(found, f"{out}/rows", f"{out}/checkpoint")
    return spark.read.schema(found.schema).parquet(f"{out}/rows").drop("step")


@query("scan_links", f"WITH {DOC_LINKS} SELECT '.' AS layer, uuid, file AS link0, file || ' :: L' || ln AS link1, sha256(base0) AS hash0, 'OK' AS state0, NULL::VARCHAR AS error FROM dl")
def scan_links(spark, d):
    """Document links as records in text form, many to a file, read back."""
    links = S.doc_links(spark, d)
    value = F.concat_ws("\n", F.lit("# a link"), F.concat(F.lit("link.0 = "), "file"), F.concat(F.lit("link.1 = "), "file", F.lit(" ::")), F.concat(F.lit("  L"), F.col("ln").cast("string")), F.concat(F.lit("hash.0 = "), T.digest(F.col("base0"))), F.lit("state.0 = OK"))
    texts = durable(links.select(F.lit(".").alias("layer"), "uuid", value.alias("value")), "link-texts")
    return records.link_records(texts).select("layer", "uuid", "link0", "link1", "hash0", "state0", "error")


@query("scan_symbol_links", f"""WITH {SYMBOLS}, {BODIES} SELECT symbol, file, name_start AS range_start, name_end AS range_end, sha256(CASE WHEN s = 1 THEN text || ' old' ELSE text END) AS hash, NULL::VARCHAR AS error
FROM defs JOIN bodies USING (symbol) WHERE s <> 0""")  # fmt: skip
def scan_symbol_links(spark, d):
    r = S.definitions(spark, d).join(recorded(spark, d), "symbol")
    value = F.concat_ws("\n", F.concat(F.lit("symbol = "), "symbol"), F.concat(F.lit("file = "), "file"), F.concat(F.lit("range = "), F.col("name_start").cast("string"), F.lit("~"), F.col("name_end").cast("string")), F.concat(F.lit("hash = "), "hash"))
    texts = durable(r.select(symbols.symbol_key(F.col("symbol")).alias("record"), value.alias("value")), "symbol-texts")
    return records.symbol_records(texts).select("symbol", "file", "range_start", "range_end", "hash", "error")


@query("write_links", f"WITH {DOC_LINKS} SELECT uuid, sha256(base0) AS hash0, sha256(base1) AS hash1 FROM dl")
def write_links(spark, d):
    """The link table written by layer and read back."""
    links = S.doc_links(spark, d).select(F.lit(".").alias("layer"), "uuid", T.digest(F.col("base0")).alias("hash0"), T.digest(F.col("base1")).alias("hash1"))
    path = f"{shared_dir(spark)}/table-{_uuid.uuid4().hex}"
    records.write_links(links, path)
    return spark.read.parquet(path).select("uuid", "hash0", "hash1")
