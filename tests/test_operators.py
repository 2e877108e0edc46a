"""Behaviour of the engine's operators on small tables."""

from pyspark.sql import functions as F

from tautline.functions import text as T
from tautline.operators import accept, chain, check, closure, detect, fragments, graph, ranges, symbols
from tautline.sources import records
from tautline.sources.tables import ENDPOINT


def endpoints(spark, *rows):
    names = [x.split()[0] for x in ENDPOINT.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ENDPOINT.replace(" ", ":").replace(",:", ", "))


def sources(spark, rows):
    df = spark.createDataFrame(rows, "layer string, file string, text string")
    return df.select("layer", "file", T.language(F.col("file")).alias("lang"), F.octet_length("text").cast("long").alias("n_bytes"), "text", T.digest(F.col("text")).alias("hash"))


def sha(spark, text):
    return spark.range(1).select(T.digest(F.lit(text))).first()[0]


def test_endpoints_are_parsed(spark):
    rows = [("Persona.java :: (q)", "docs/x.md"), ("persona-voting-impl", ">tech-decisions>impl"), ("task 3a", "a.java :: (q) :: 42~87")]
    df = spark.createDataFrame([(".", str(i), a, b) for i, (a, b) in enumerate(rows)], "layer string, uuid string, link0 string, link1 string")
    got = {(r.uuid, r.n): r for r in records.parse_endpoints(df).collect()}
    assert [got[k].kind for k in sorted(got)] == ["structural", "structural", "layer", "layer", "task", "structural"]
    assert got["2", 0].task_id == "3a"
    assert (got["2", 1].query, got["2", 1].rel_start, got["2", 1].rel_end) == ("(q)", 42, 87)
    assert got["0", 1].query is None and got["0", 1].file == "docs/x.md"


def test_whole_file_states(spark):
    src = sources(spark, [(".", "a.md", "text")])
    e = endpoints(
        spark, dict(layer=".", uuid="1", n=0, kind="structural", file="a.md"), dict(layer=".", uuid="2", n=0, kind="structural", file="a.md", hash=sha(spark, "text")),
        dict(layer=".", uuid="3", n=0, kind="structural", file="a.md", hash="x"), dict(layer=".", uuid="4", n=0, kind="structural", file="missing.md", hash="x"),
    )
    assert {r.uuid: r.state for r in check.check_whole_file(e, src).collect()} == {"1": "PENDING", "2": "OK", "3": "ALTERED", "4": "BROKEN"}


def test_fragment_cascade_with_multibyte_text(spark):
    src = sources(spark, [(".", "a.txt", "é1\nfoo bär baz")])
    frags = fragments.fragments_extract(src, ("line",))
    cases = {"ok": "foo bär baz", "restyled": "foo  bär baz", "displaced": "bär baz", "altered": "other words 7"}
    e = endpoints(spark, *[dict(layer=".", uuid=k, n=1, kind="structural", file="a.txt", anchor_kind="line", anchor_name="L2", hash=sha(spark, v), shape_hash=spark.range(1).select(T.digest(T.shape(F.lit(v)))).first()[0], accepted=v, accepted_len=len(v.encode())) for k, v in cases.items()],
                  dict(layer=".", uuid="gone", n=1, kind="structural", file="a.txt", anchor_kind="line", anchor_name="L9", hash="x"))
    got = {r.uuid: r for r in check.check_fragment(e, frags, src).collect()}
    assert {k: r.state for k, r in got.items()} == {"ok": "OK", "restyled": "RESTYLED", "displaced": "DISPLACED", "altered": "ALTERED", "gone": "UNANCHORED"}
    assert (got["displaced"].range_start, got["displaced"].range_end) == (8, 16)


def test_layer_states(spark):
    h = "h"
    e = endpoints(
        spark, dict(layer=".", uuid="ok", n=1, kind="layer", target_layer="b", hash=h), dict(layer="b", uuid="ok", n=1, kind="structural", file="b.md", hash=h),
        dict(layer=".", uuid="dirty", n=1, kind="layer", target_layer="b", hash="old"), dict(layer="b", uuid="dirty", n=0, kind="structural", file="b.md", hash=h),
        dict(layer=".", uuid="todo", n=1, kind="layer", target_layer="b"), dict(layer=".", uuid="broken", n=1, kind="layer", target_layer="b", hash=h),
        dict(layer=".", uuid="pending", n=1, kind="layer", target_layer="b", hash=h), dict(layer="b", uuid="pending", n=0, kind="layer", target_layer="."),
    )
    got = {r.uuid: r.state for r in check.check_layer(e).filter("layer = '.'").collect()}
    assert got == {"ok": "OK", "dirty": "CHAIN_DIRTY", "todo": "TODO", "broken": "BROKEN", "pending": "PENDING"}


def test_check_after_accept_is_ok(spark):
    src = sources(spark, [(".", "a.txt", "one\ntwo")])
    frags = fragments.fragments_extract(src, ("line",))
    tasks = spark.createDataFrame([], "task_id string, text string")
    e = endpoints(spark, dict(layer=".", uuid="1", n=0, kind="structural", file="a.txt"), dict(layer=".", uuid="1", n=1, kind="structural", file="a.txt", anchor_kind="line", anchor_name="L2"))
    new = accept.accept_endpoints(e, src, frags, tasks).filter("error is null").select("layer", "uuid", "n", F.col("new_hash").alias("hash"))
    r = check.check_links(accept.upsert_links(e, new), src, frags, tasks).first()
    assert (r.state0, r.state1, r.updated) == ("OK", "OK", True)


def test_chain_create(spark):
    df = spark.createDataFrame([("1", ["."] * 2, "a.md", "b.md"), ("2", [".", ".stratum/impl"], "a.md", "b.md"), ("3", [".", ".stratum/td", ".stratum/td/.stratum/impl"], "a.md", "c.md")], "uuid string, layers array<string>, first string, last string")
    got = {(r.uuid, r.layer): (r.link0, r.link1) for r in chain.chain_create(df).collect()}
    assert got == {("1", "."): ("a.md", "b.md"), ("2", "."): ("a.md", ">impl"), ("2", ".stratum/impl"): ("<", "b.md"), ("3", "."): ("a.md", ">td"), ("3", ".stratum/td"): ("<", ">impl"), ("3", ".stratum/td/.stratum/impl"): ("<", "c.md")}


def test_relative_layer(spark):
    df = spark.createDataFrame([(".stratum/a/.stratum/b", "."), (".", ".stratum/td/.stratum/impl"), (".stratum/a", ".stratum/b")], "x string, y string")
    assert [r[0] for r in df.select(T.relative_layer(F.col("x"), F.col("y"))).collect()] == ["<<", ">td>impl", "<>b"]


def test_symbol_key(spark):
    df = spark.createDataFrame([("scip://rust . voting/Repo#save().",)], "s string")
    assert df.select(symbols.symbol_key(F.col("s"))).first()[0] == "rust.voting.Repo..save.sciplink"


def test_file_index_status(spark):
    rec = spark.createDataFrame([("a", "1", 5), ("a", "2", 9), ("b", "3", 1), ("c", "4", 1)], "layer string, uuid string, modified int")
    built = spark.createDataFrame([("a", 7, 2), ("b", 7, 1)], "layer string, built_at int, refs int")
    assert {r.layer: (r.status, r.newer) for r in chain.file_index_status(rec, built).collect()} == {"a": ("STALE", 1), "b": ("OK", 0), "c": ("MISSING", 0)}


def test_range_joins_match_brute_force(spark):
    import random

    rnd = random.Random(3)
    spans = [(f"f{rnd.randrange(3)}", a := rnd.randrange(5000), a + rnd.randrange(1, 3000)) for _ in range(60)]
    points = [(f"f{rnd.randrange(3)}", rnd.randrange(8000)) for _ in range(60)]
    s = spark.createDataFrame(spans, "file string, start long, end long")
    p = spark.createDataFrame(points, "file string, at long")
    got = sorted((r.file, r.at, r.start, r.end) for r in ranges.spans_containing(p, s, ["file"]).collect())
    assert got == sorted((f, x, a, b) for f, x in points for g, a, b in spans if f == g and a <= x < b)
    o = s.select("file", F.col("start").alias("o_start"), F.col("end").alias("o_end"))
    got = sorted((r.file, r.start, r.end, r.o_start, r.o_end) for r in ranges.spans_overlapping(s, o, ["file"]).collect())
    assert got == sorted((f, a, b, c, e) for f, a, b in spans for g, c, e in spans if f == g and a < e and c < b)


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    starts = spark.createDataFrame([("a", "a"), ("d", "d")], "root string, node string")
    assert {(r.root, r.node, r.depth) for r in closure.closure(starts, edges).collect()} == {("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("a", "d", 3), ("d", "d", 0)}


def test_resolve_id_prefix(spark):
    links = spark.createDataFrame([("aaaaaaaa-1",), ("aaaaaaaa-12",), ("bbbbbbbb-1",)], "uuid string")
    req = spark.createDataFrame([("aaaaaaaa-1",), ("bbbbbbbb",), ("cccccccc",)], "request string")
    assert {r.request: (r.uuid, r.matches) for r in accept.resolve_id_prefix(req, links).collect()} == {"aaaaaaaa-1": ("aaaaaaaa-1", 2), "bbbbbbbb": ("bbbbbbbb-1", 1), "cccccccc": (None, 0)}


def test_records_round_trip(spark, tmp_path):
    (tmp_path / "layer=." / "x").mkdir(parents=True)
    uid = "01234567-89ab-cdef-0123-456789abcdef"
    (tmp_path / "layer=." / f"{uid}.link").write_text("# c\n\nlink.0 = a.md\nlink.1 = b.java ::\n  (q)\nhash.0 = h\n")
    (tmp_path / "layer=." / ".pending").mkdir()
    (tmp_path / "layer=." / ".pending" / f"{uid}.link").write_text("link.0 = z\n")
    (tmp_path / "layer=." / "11111111-89ab-cdef-0123-456789abcdef.link").write_text("link.0 = a.md\n")
    got = {r.uuid: r for r in records.scan_links(spark, str(tmp_path)).collect()}
    assert (got[uid].link0, got[uid].link1, got[uid].hash0, got[uid].error) == ("a.md", "b.java :: (q)", "h", None)
    assert got["11111111-89ab-cdef-0123-456789abcdef"].error == "a link is missing" and len(got) == 2


def test_declarations_and_capture(spark):
    text = "package x;\npublic class Persona {\n  private int n;\n  public int vote(int k) {\n    return k;\n  }\n}\n"
    src = sources(spark, [(".", "Persona.java", text)])
    assert [r.name for r in fragments.declarations(src).orderBy("start").collect()] == ["Persona", "vote"]


def test_line_delta_and_hunks(spark):
    pairs = spark.createDataFrame([("1", "a\nb\nb", "a\nb\nc")], "id string, before string, after string")
    assert sorted((r.sign, r.k) for r in detect.line_delta(pairs).collect()) == [("+", 1), ("-", 2)]


def test_plans_have_no_python_and_no_cartesian_product(spark):
    from tautline.plans import catalog

    d = "/root/testdata/sf0.001"
    for name in ("check_links", "lookup_by_position", "direct_callees", "detect_moved_similar", "lens_counts"):
        plan = catalog.QUERIES[name](spark, d)._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan and "CartesianProduct" not in plan, name


def test_graph_layout(spark):
    n = spark.createDataFrame([("1", "a/x.md", ".", 1), ("2", "a/x.md", ".", 5), ("3", "b/y.md", ".", 1), ("4", "z.md", ".stratum/i", 1)], "id string, file string, layer string, start_line int")
    assert {r.id: (r.x, r.y) for r in graph.graph_layout(n).collect()} == {"1": (0, 0), "2": (0, 1), "3": (0, 3), "4": (1, 0)}


def test_headings_with_attributes_and_markup(spark):
    html = '<h1 class="t">a<b>é</b></h1>\n<p>x</p><H2>c\nd</H2><h3>open'
    src = sources(spark, [(".", "p.html", html)])
    rows = fragments.fragments_extract(src, ("heading",)).orderBy("ord").collect()
    raw = html.encode()
    assert [(r.name, r.ord, r.depth, r.text) for r in rows] == [("h1", 1, 1, "a<b>é</b>"), ("h2", 2, 2, "c\nd")]
    assert all(raw[r.start : r.end].decode() == r.text for r in rows)


def test_declarations_end_at_the_next_of_their_depth(spark):
    text = "mod a {\n    fn é() {\n    }\n    fn g() {\n    }\n}\nfn h() {\n}\n".replace("é", "f")
    src = sources(spark, [(".", "a.rs", text), (".", "a.md", "# One\n## Two\ntext\n# Three\n")])
    got = {(r.file, r.name): (r.depth, r.text) for r in fragments.declarations(src).collect()}
    assert got["a.rs", "a"] == (0, text[: text.index("fn h") - 1]) and got["a.rs", "f"] == (1, "    fn f() {\n    }") and got["a.rs", "h"] == (0, "fn h() {\n}\n")
    assert got["a.md", "One"] == (0, "# One\n## Two\ntext") and got["a.md", "Two"] == (1, "## Two\ntext") and got["a.md", "Three"] == (0, "# Three\n")


def test_edges_carry_the_worst_state_of_each_side(spark):
    links = spark.createDataFrame([("x", "y", "aaaaaaaa-1", "OK", "ALTERED"), ("y", "x", "aaaaaaaa-2", "PENDING", "BROKEN"), ("x", "y", "aaaaaaaa-3", None, "OK")], "a string, b string, uuid string, state_a string, state_b string")
    assert [tuple(r) for r in graph.graph_edges(links).collect()] == [("x", "y", "aaaaaaaa", "BROKEN", "ALTERED")]


def test_expanded_needs_whole_words(spark):
    df = spark.createDataFrame([("1", 0, "b c", "a b c d"), ("2", 0, "b c", "ab c"), ("3", 0, "", "a"), ("4", 0, "x", "a")], "uuid string, n int, accepted string, node_text string")
    assert {r.uuid: r.state for r in detect.detect_expanded(df).collect()} == {"1": "EXPANDED", "2": "ALTERED", "3": "ALTERED", "4": "ALTERED"}


def test_accept_with_commits_and_overrides(spark):
    src = sources(spark, [(".", "a.txt", "one\ntwo 2"), ("b", "b.txt", "x")])
    e = endpoints(
        spark, dict(layer=".", uuid="1", n=0, kind="structural", file="a.txt", anchor_kind="line", anchor_name="L2"), dict(layer=".", uuid="1", n=1, kind="layer", target_layer="b"),
        dict(layer="b", uuid="1", n=0, kind="structural", file="b.txt", hash="h", commit="c9"), dict(layer=".", uuid="2", n=0, kind="structural", file="gone.txt"),
    )
    commits = spark.createDataFrame([(".", "a.txt", "c1", 1), (".", "a.txt", "c2", 2), (".", "gone.txt", "c3", 3)], "layer string, file string, commit string, seq int")
    given = spark.createDataFrame([("b", "1", 0, "mine", "pinned"), (".", "2", 0, "mine", "pinned")], "layer string, uuid string, n int, hash string, commit string")
    tasks = spark.createDataFrame([], "task_id string, text string")
    got = {(r.layer, r.uuid, r.n): r for r in accept.accept_endpoints(e, src, fragments.fragments_extract(src, ("line",)), tasks, commits, given).collect()}
    assert got[".", "1", 0][3:] == (sha(spark, "two 2"), sha(spark, "wn"), "c2", None)
    assert got[".", "1", 1][3:] == ("h", None, "c9", None) and got["b", "1", 0][3:] == ("mine", None, "pinned", None)
    assert got[".", "2", 0][3:] == (None, None, None, "no such file")


def test_health_reaches_beyond_direct_callees(spark):
    calls = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("d", "d")], "caller string, callee string")
    states = spark.createDataFrame([("c", "ALTERED"), ("a", "OK"), ("d", "PENDING")], "symbol string, state string")
    roots = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",)], "root string")
    assert {r.root: r.healthy for r in symbols.subgraph_health(roots, calls, states).collect()} == {"a": False, "b": False, "c": False, "d": True, "e": True}


def test_elements_nest(spark):
    import re

    html = "<!doctype html><html><body class='x'><!-- <p>no</p> --><article id=a><h1>é <b>t</b></h1><section><p>one<br>two</p><p>open<section><P>in</P></section></section></article><script>if (a < b) '<p>'</script><img src=x/></p><div/></body></html>"
    src = sources(spark, [(".", "p.html", html), (".", "q.html", "no tags <"), (".", "r.html", ""), (".", "s.txt", "<p>x</p>")])
    got = [(r.name, r.depth, r.text) for r in fragments.fragments_extract(src, ("element",)).filter("file = 'p.html'").orderBy("ord").collect()]
    # the same with a stack for each name
    stacks, spans = {}, []
    for m in re.finditer(fragments.HTML_PIECE, html):
        t = re.match("<(/?)([a-zA-Z][a-zA-Z0-9]*)", m[0])
        if not t or t[2].lower() in ("script", "style", *fragments.HTML_VOID) or m[0].endswith("/>"):
            continue
        name = t[2].lower()
        if not t[1]:
            stacks.setdefault(name, []).append(m.end())
        elif stacks.get(name):
            spans.append((stacks[name].pop(), m.start(), name))
    spans.sort()
    assert [(n, t) for n, _, t in got] == [(n, html[a:b]) for a, b, n in spans]
    assert {n: d for n, d, _ in got if n in ("html", "body", "article", "h1", "b")} == {"html": 0, "body": 1, "article": 2, "h1": 3, "b": 4}
    assert ("p", 4, "one<br>two") in got and ("section", 5, "<P>in</P>") in got  # the open <p> before it ends with the last </p>
    assert fragments.elements(src).filter("file <> 'p.html'").count() == 0


def test_short_and_long_chains_are_walked_alike(spark, monkeypatch):
    edges = [("u", "a", "b"), ("u", "b", "a"), ("u", "b", "c"), ("u", "c", "d"), ("u", "a", "c"), ("v", "x", "x"), ("w", "p", "q")]
    adjacency = spark.createDataFrame(edges, "uuid string, layer string, to_layer string")
    starts = spark.createDataFrame([("u", "a"), ("u", "d"), ("v", "x"), ("none", "z"), ("u", "a")], "uuid string, layer string")
    whole = {("u@a", "u", "a", 0), ("u@a", "u", "b", 1), ("u@a", "u", "c", 1), ("u@a", "u", "d", 2), ("u@d", "u", "d", 0), ("v@x", "v", "x", 0), ("none@z", "none", "z", 0)}
    for walk in (256, 2, 0):
        monkeypatch.setattr(graph, "WALK", walk)
        rows = [tuple(r) for r in graph.graph_traverse(starts, adjacency).select("root", "uuid", "layer", "depth").collect()]
        assert set(rows) == whole and len(rows) == len(whole), walk
        assert {tuple(r) for r in graph.graph_traverse(starts, adjacency, 1).select("root", "uuid", "layer", "depth").collect()} == {x for x in whole if x[3] <= 1}


def test_similar_files_match_brute_force(spark):
    import random

    rnd = random.Random(7)
    text = lambda: "\n".join(str(rnd.randrange(14)) for _ in range(rnd.randrange(1, 9)))
    missing, added = [(f"u{k}", text()) for k in range(40)], [(f"f{k:02}", text()) for k in range(60)]
    missing += [("copy", missing[0][1]), ("empty", "")]
    want = {}
    for u, t in missing:
        a = set(t.split("\n"))
        best = min((-round(len(a & b) / len(a | b), 6), f) for f, x in added for b in [set(x.split("\n"))])
        if -best[0] >= 0.5:
            want[u] = best[1], -best[0]
    got = detect.detect_moved_similar(spark.createDataFrame(missing, "uuid string, text string"), spark.createDataFrame(added, "file string, text string"))
    assert {r.uuid: (r.new_file, r.similarity) for r in got.collect()} == want and len(want) > 10
