"""Joins don't go by the size of files: what isn't counted to be small doesn't pass through the driver."""

import pytest

from tautline.functions.durable import durable
from tautline.operators import asof, detect, fragments, ranges, symbols
from tautline.operators.sized import sized


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def spans(spark):
    return spark.createDataFrame([("f", 0, 900, "a"), ("f", 1000, 1900, "b")], "file string, o_start long, o_end long, name string")


def test_only_counted_sides_are_broadcast(spark, spans):
    assert "BroadcastHashJoin" in plan(sized(spans).join(spans, "name")) and "Broadcast" not in plan(sized(spans, 1).join(spans, "name"))


def test_range_joins_do_not_broadcast_what_was_not_counted(spark, spans):
    inner = spans.select("file", (spans.o_start + 5).alias("start"), (spans.o_start + 9).alias("end"))
    for df in (ranges.spans_around(inner, spans, ["file"]), ranges.spans_overlapping(inner, spans, ["file"]), ranges.spans_around(inner, spans, ["file"], hint="shuffle_hash")):
        assert sorted(r.name for r in df.collect()) == ["a", "b"] and "Broadcast" not in plan(df)


def test_texts_of_lines_are_not_broadcast(spark, tmp_path, monkeypatch):
    """Padded lines: 200 bytes in a file, megabytes as rows."""
    spark.range(2000).selectExpr("'.' as layer", "'f' as file", "cast(id + 1 as int) as line", "id * 1000 as start", "id * 1000 + 999 as end", "rpad('x', 999, ' ') as text").write.parquet(str(tmp_path / "lines"))
    lines = spark.read.parquet(str(tmp_path / "lines"))
    ends = spark.createDataFrame([(".", "f", "a", 2000, 2900), (".", "f", "b", 5990, 6010)], "layer string, file string, id string, start long, end long")
    few = {r.id: (r.first_line, r.last_line, len(r.content)) for r in fragments.fragment_get(ends, lines).collect()}
    assert few == {"a": (3, 3, 999), "b": (6, 7, 1999)}
    monkeypatch.setattr(fragments, "FEW", 1)
    many = fragments.fragment_get(ends, lines)
    assert {r.id: (r.first_line, r.last_line, len(r.content)) for r in many.collect()} == few and "Broadcast" not in plan(many)


def test_health_of_many_roots_is_joined_without_the_driver(spark):
    roots = spark.createDataFrame([("a",), ("b",), ("c",)], "root string")
    calls, states = spark.createDataFrame([("a", "b")], "caller string, callee string"), spark.createDataFrame([("a", "OK"), ("b", "ALTERED"), ("c", "OK")], "symbol string, state string")
    df = symbols.subgraph_health(roots, calls, states)
    assert {r.root: r.healthy for r in df.collect()} == {"a": False, "b": False, "c": True} and "Broadcast" not in plan(df)


def test_spans_of_callables_are_streamed_to_the_join(spark):
    defs = spark.createDataFrame([("a/fn().", "f", 0, 900), ("b/fn().", "f", 100, 200), ("c/T#", "f", 100, 150)], "symbol string, file string, body_start long, body_end long")
    spans = spark.createDataFrame([("f", 110, 120)] * 3 + [("f", 300, 310), ("f", 2000, 2010)], "file string, start long, end long")
    df = symbols.callable_at(spans, defs)
    assert sorted(tuple(r) for r in df.collect()) == [("f", 110, 120, "b/fn()."), ("f", 300, 310, "a/fn().")]
    # nothing is sorted or gathered before the join
    assert "ShuffledHashJoin" in plan(df) and not any(x in plan(df) for x in ("Broadcast", "SortMergeJoin"))


def test_versions_of_callees_are_worked_out_once(spark, monkeypatch):
    versions = spark.createDataFrame([(".", "f.rs", 1, "fn a() {\n}\n")], "layer string, file string, seq long, text string")
    asked = spark.createDataFrame([("a", ".", "f.rs", "a", 1)], "symbol string, layer string, file string, name string, accepted_seq long")
    src = versions.selectExpr("layer", "file", "'rust' as lang", "cast(octet_length(text) as long) as n_bytes", "text")
    written = []
    monkeypatch.setattr(detect, "durable", lambda df, name: written.append((name, plan(df).count("Window"))) or durable(df, name))
    df = detect.callee_diff(asked, versions, src, ["declaration"])
    assert [tuple(r) for r in df.collect()] == [("a", "OK")] and "Window" not in plan(df) and "Broadcast" not in plan(df)
    assert [n for n, windows in written if windows] == ["callees-then"]


def test_versions_are_carried_on_without_a_broadcast(spark):
    v, r = spark.createDataFrame([("a", 1, "x")], "f string, seq long, name string"), spark.createDataFrame([("a", 2)], "f string, at long")
    assert "Broadcast" not in plan(asof.as_of(r, v, ["f"], "at", "seq", ["name"]))


def test_named_lines_are_those_of_the_table(spark):
    src = spark.createDataFrame([(".", "f", "text", "a\n\né\na"), (".", "g", "text", ""), (".", "h", "text", None), (".", "r.rs", "rust", "fn a() {\n}\n")], "layer string, file string, lang string, text string").selectExpr("*", "cast(octet_length(text) as long) as n_bytes")
    names = [("f", "line", n) for n in ("L1", "L3", "L4", "L5", "L0", "L03", "XL1", "L99999999999")] + [("g", "line", "L1"), ("g", "line", "L2"), ("h", "line", "L1"), ("none", "line", "L1"), ("r.rs", "declaration", "a"), ("r.rs", "line", "L1")]
    e = spark.createDataFrame([(".", f, k, n, "structural") for f, k, n in [*names, names[0]]], "layer string, file string, anchor_kind string, anchor_name string, kind string")
    kinds = ("line", "declaration")
    table = fragments.anchor_resolve(e, fragments.fragments_extract(src, kinds))
    named = fragments.anchor_resolve(e, fragments.named_fragments(src, kinds))
    assert table.columns == named.columns and sorted(map(str, named.collect())) == sorted(map(str, table.collect()))
    assert {r.anchor_name: r.node_text for r in named.collect() if r.file == "f"} == {"L1": "a", "L3": "é", "L4": "a", **dict.fromkeys(("L5", "L0", "L03", "XL1", "L99999999999"))}


def test_texts_of_versions_are_not_sorted(spark, monkeypatch):
    """Whole files are compared without shuffling texts; of lines only those that ends name are shuffled."""
    e = spark.createDataFrame([(".", "a", 0, "structural", "f", None, None, "c1"), (".", "a", 1, "structural", "f", "line", "L2", "c1")], "layer string, uuid string, n int, kind string, file string, anchor_kind string, anchor_name string, commit string")
    e = e.selectExpr("*", "cast(null as long) as rel_start", "cast(null as long) as rel_end", "cast(null as string) as target_layer")
    versions = spark.createDataFrame([(".", "f", "c1", 1, "x\ny\n"), (".", "f", "c0", 1, "never"), (".", "f", "c2", 2, "x\nz")], "layer string, file string, commit string, seq long, text string")
    src = spark.createDataFrame([(".", "f", "text", 4, "x\nz  ")], "layer string, file string, lang string, n_bytes long, text string")
    plans = {}
    monkeypatch.setattr(detect, "durable", lambda df, name: plans.setdefault(name, plan(df)) and durable(df, name))
    got = sorted((r.n, r.changed, r.first_line, r.last_line) for r in detect.fragment_diff(e, versions, src).collect())
    assert got == [(0, True, 1, 2), (1, True, 2, 2)]
    assert "ShuffledHashJoin" in plans["ends-both"] and "max_by(text" not in "".join(plans.values())


def test_states_are_cached_without_accepted_texts(spark, monkeypatch):
    from tautline.plans import history

    written = {}
    monkeypatch.setattr(history, "durable", lambda df, name: written.setdefault(name, df.columns) and durable(df, name))
    assert history.prune_unchanged(spark, "/root/testdata/sf0.001").count() > 0
    assert "accepted" not in written["cached-states"]


def test_fixes_work_out_ends_once(spark, monkeypatch):
    from tautline.plans import history

    asked = []
    ends = history.S.doc_endpoints
    monkeypatch.setattr(history.S, "doc_endpoints", lambda *a: asked.append(1) or ends(*a))
    assert history.apply_fixes(spark, "/root/testdata/sf0.001").count() > 0 and len(asked) == 1
