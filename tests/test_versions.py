"""As-of joins, diffs through versions, displacement by digest, and checking again only what changed, on small tables."""

import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from tautline.operators import accept, asof, check, detect, fragments
from test_operators import endpoints, sha, sources


@pytest.mark.parametrize("rows", [asof.RANGE, 7])
@pytest.mark.parametrize("after", [False, True])
def test_as_of_matches_brute_force(spark, rows, after):
    rnd = random.Random(1)
    versions = [(rnd.choice("ab") if rnd.random() < 0.9 else None, rnd.randrange(60), f"v{k}") for k in range(80)] + [("a", None, "none")]
    requests = [(rnd.choice("abc"), rnd.randrange(-5, 70), k) for k in range(90)] + [("a", None, 999), ("a", 5, 1), ("a", 5, 1)]
    v, r = spark.createDataFrame(versions, "f string, seq long, name string"), spark.createDataFrame(requests, "f string, at long, id long")
    got = sorted(tuple(x) for x in asof.as_of(r, v, ["f"], "at", "seq", ["name"], after, rows).select("f", F.coalesce("at", F.lit(-99)), "id", F.coalesce("name", F.lit("-"))).collect())

    def held(f, at):
        fit = [(s, n) for g, s, n in versions if g == f and s is not None and at is not None and (s > at if after else s <= at)]
        return max((n for s, n in fit if s == (min if after else max)(fit)[0]), default="-")

    assert got == sorted((f, -99 if at is None else at, i, held(f, at)) for f, at, i in requests)
    assert asof.as_of(r, v.limit(0), ["f"], "at", "seq", ["name"], after).filter("name is not null").count() == 0
    assert asof.as_of(r.limit(0), v, ["f"], "at", "seq", ["name"], after).count() == 0


def test_as_of_has_no_product(spark):
    v, r = spark.createDataFrame([("a", 1, "x")], "f string, seq long, name string"), spark.createDataFrame([("a", 2)], "f string, at long")
    plan = asof.as_of(r, v, ["f"], "at", "seq", ["name"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def resolved(spark, rows):
    """rows: uuid, hash, accepted_len, node_start, node_text."""
    df = spark.createDataFrame(rows, "uuid string, hash string, accepted_len long, node_start long, node_text string")
    return df.selectExpr("'.' as layer", "uuid", "1 as n", "'a.txt' as file", "'text' as anchor_kind", "substr(node_text, 1, 9) as anchor_name", "hash", "accepted_len", "node_start", "node_text")


def test_displaced_is_found_by_digest_and_length(spark):
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    node = "äbc one two é one two éx tail"
    want = {"first": "one two é", "whole": node, "end": "x tail", "gone": "three", "long": node + "y", "start": "äb"}
    rows = [(k, digest(t), len(t.encode()), 100, node) for k, t in want.items()] + [("empty", digest(""), 0, 100, node), ("none", None, None, 100, node), ("split", hashlib.sha256("é".encode()[:1]).hexdigest(), 2, 100, node)]
    rows += [(f"same{k}", digest("two"), 3, 100, node) for k in range(5)] + [("no node", digest("two"), 3, None, None)]
    df = resolved(spark, rows)
    assert "accepted" not in df.columns
    out = check.find_displaced(df)
    got = {r.uuid: (r.new_start, r.new_end) for r in out.collect()}
    at = lambda t: (100 + node.encode().index(t.encode()), 100 + node.encode().index(t.encode()) + len(t.encode()))
    assert got == {k: at(want[k]) for k in ("first", "whole", "end", "start")} | {f"same{k}": at("two") for k in range(5)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize(("piece", "digests"), [(1, 1), (3, 2), (1024, 64)])
def test_displaced_over_the_edges_of_pieces(spark, monkeypatch, piece, digests):
    monkeypatch.setattr(check, "PIECE", piece)
    monkeypatch.setattr(check, "DIGESTS", digests)
    rnd = random.Random(2)
    node = "".join(rnd.choice("abé") for _ in range(60))
    raw = node.encode()
    rows, want = [], {}
    for k in range(40):
        part = "".join(rnd.choice("abé") for _ in range(rnd.randrange(1, 5)))
        rows.append((str(k), hashlib.sha256(part.encode()).hexdigest(), len(part.encode()), 0, node))
        if part.encode() in raw:
            want[str(k)] = raw.index(part.encode())
    assert {r.uuid: r.new_start for r in check.find_displaced(resolved(spark, rows)).collect()} == want


def test_a_megabyte_is_searched_in_seconds(spark):
    rnd = random.Random(5)
    node = "".join(rnd.choices("abcdefgh \n", k=1_000_000))
    want = node[700_000:700_080]
    df = resolved(spark, [("x", hashlib.sha256(want.encode()).hexdigest(), 80, 0, node)])
    begun = time.time()
    assert check.find_displaced(df).first().new_start == node.index(want)
    assert time.time() - begun < 30


def test_declarations_of_a_large_file_carry_no_copies_of_it(spark):
    text = "".join(f"pub fn f{k}() {{\n    {'x' * 900}\n}}\n" for k in range(300))
    src = sources(spark, [(".", "a.rs", text)])
    rows = fragments.declarations(src).collect()
    assert [r.name for r in rows] == [f"f{k}" for k in range(300)] and all(text.encode()[r.start : r.end].decode() == r.text for r in rows)
    assert sum(len(r.text) for r in rows) <= len(text)


def test_fragment_diff_reads_the_version_that_was_accepted(spark):
    versions = spark.createDataFrame(
        [(".", "a.txt", "c1", 1, "one\ntwo\nthree"), (".", "a.txt", "c3", 3, "one\nTWO\nthree"), (".", "b.txt", "c2", 2, "b"), ("in", "s.txt", "c1", 1, "side"), (".", "a.txt", "c5", 5, "later")],
        "layer string, file string, commit string, seq long, text string",
    )
    src = sources(spark, [(".", "a.txt", "one\nTWO  \nthree"), (".", "b.txt", "b \n"), ("in", "s.txt", "sidé")])
    line = dict(layer=".", kind="structural", file="a.txt", anchor_kind="line", anchor_name="L2")
    e = endpoints(
        spark, dict(line, uuid="1", n=0, commit="c1"), dict(line, uuid="2", n=0, commit="c3"), dict(line, uuid="3", n=0, commit="c2"), dict(line, uuid="4", n=0, commit=None), dict(line, uuid="5", n=0, commit="c1", anchor_name="L9"),
        dict(line, uuid="6", n=0, commit="c1", rel_start=0, rel_end=2), dict(layer=".", uuid="2", n=1, kind="structural", file="b.txt", commit="c2"),
        dict(layer=".", uuid="7", n=1, kind="layer", target_layer="in"), dict(layer="in", uuid="7", n=0, kind="structural", file="s.txt", commit="c1"),
    )
    by_file = {(r.layer, r.uuid, r.n): (r.file, r.commit, r.changed, r.first_line, r.last_line) for r in detect.fragment_diff(e, versions, src).collect()}
    assert by_file == {
        (".", "1", 0): ("a.txt", "c1", True, 2, 2), (".", "2", 0): ("a.txt", "c3", False, 2, 2), (".", "6", 0): ("a.txt", "c1", True, 2, 2), (".", "2", 1): ("b.txt", "c2", False, 1, 2),
        ("in", "7", 0): ("s.txt", "c1", True, 1, 1), (".", "7", 1): ("s.txt", "c1", True, 1, 1),
    }
    # an accepted commit that doesn't touch the file: the version that held then
    commits = spark.createDataFrame([(".", "c1", 1), (".", "c2", 2), (".", "c3", 3), ("in", "c1", 1)], "layer string, commit string, seq long")
    got = {(r.uuid, r.n): r.changed for r in detect.fragment_diff(e, versions, src, commits=commits).filter("layer = '.'").collect()}
    assert got == {("1", 0): True, ("2", 0): False, ("3", 0): True, ("6", 0): True, ("2", 1): False, ("7", 1): True}


def test_callee_diff_looks_up_declarations_in_both_versions(spark):
    old = "fn a() {\n    1\n}\nfn b() {\n    2\n}\nfn gone() {\n}\n"
    new = "// moved down\nfn b() {\n    2\n}\nfn a() {\n    7\n}\nfn fresh() {\n}   \n"
    versions = spark.createDataFrame([("x", "f.rs", 1, old), ("x", "f.rs", 4, new), ("y", "f.rs", 1, old)], "layer string, file string, seq long, text string").withColumn("commit", F.lit("c"))
    src = sources(spark, [("x", "f.rs", new), ("y", "f.rs", new)])
    asked = [(f"{layer}/{n}{at}", layer, "f.rs", n, at) for layer in "xy" for n, at in (("a", 1), ("a", 5), ("b", 3), ("fresh", 3), ("gone", 3), ("b", 0))]
    df = spark.createDataFrame(asked, "symbol string, layer string, file string, name string, accepted_seq long")
    got = {r.symbol: r.state for r in detect.callee_diff(df, versions, src, ["declaration"], "x").collect()}
    assert got == {"x/a1": "ALTERED", "x/a5": "OK", "x/b3": "OK", "x/fresh3": "ALTERED", "x/b0": "ALTERED"}
    assert detect.callee_diff(df, versions, src, ["declaration"]).filter("symbol like 'y%'").count() == 5


def test_change_source_is_the_first_commit_after_acceptance(spark):
    commits = spark.createDataFrame([(".", "a", "c2", 2), (".", "a", "c5", 5), (".", "a", "c7", 7), ("b", "a", "x", 4)], "layer string, file string, commit string, seq long")
    rows = [("1", "a", "ALTERED", 2), ("2", "a", "ALTERED", 7), ("3", "a", "OK", 2), ("4", "a", "BROKEN", None), ("5", "z", "BROKEN", 1), ("6", None, "CHAIN_DIRTY", 1)]
    df = spark.createDataFrame(rows, "uuid string, file string, state string, accepted_seq long").selectExpr("'.' as layer", "uuid", "0 as n", "file", "state", "accepted_seq")
    assert {r.uuid: r.source for r in detect.change_source(df, commits).collect()} == {"1": "c5", "2": "UNCOMMITTED", "4": None, "5": "UNCOMMITTED"}


@pytest.fixture
def links(spark):
    """Links of two files each, a chain of two layers and a task; their states as checked over the old files."""
    line = lambda uuid, file, text: dict(layer=".", uuid=uuid, n=1, kind="structural", file=file, anchor_kind="line", anchor_name="L1", hash=sha(spark, text), accepted_len=len(text), commit="c1")
    whole = lambda uuid, file, text: dict(layer=".", uuid=uuid, n=0, kind="structural", file=file, hash=sha(spark, text), accepted_len=len(text), commit="c1")
    e = endpoints(
        spark, whole("1", "same", "same"), line("1", "changed", "old line"), whole("2", "changed", "old line"), line("2", "same", "same"), whole("3", "gone", "g"), line("3", "moved", "text"),
        dict(layer=".", uuid="4", n=0, kind="structural", file="same", hash=sha(spark, "same"), commit="c1"), dict(layer=".", uuid="4", n=1, kind="layer", target_layer="in", hash="h1"),
        dict(layer="in", uuid="4", n=0, kind="structural", file="deep", hash="h1", commit="c1"), dict(layer="in", uuid="4", n=1, kind="layer", target_layer=".", hash=sha(spark, "same")),
        whole("5", "same", "same"), dict(layer=".", uuid="5", n=1, kind="task", task_id="t", hash=sha(spark, "todo")),
    )
    tasks = spark.createDataFrame([("t", "todo now")], "task_id string, text string")
    old = sources(spark, [(".", "same", "same"), (".", "changed", "old line"), (".", "gone", "g"), (".", "moved", "text"), ("in", "deep", "d")])
    lines = lambda s: fragments.fragments_extract(s, ("line",))
    return accept.upsert_links(e, check.check_endpoints(e, old, lines(old), tasks)), tasks, lines


def test_checking_what_changed_equals_checking_all(spark, links):
    cached, tasks, lines = links
    now = sources(spark, [(".", "same", "same"), (".", "changed", "an old line"), (".", "moved", "text"), ("in", "deep", "d")])
    ends = cached.withColumn("accepted_seq", F.when(F.col("file") != "moved", F.lit(1)))
    commits = spark.createDataFrame([(".", "changed", 1), (".", "changed", 2), (".", "same", 1)], "layer string, file string, seq long")
    changed = detect.prune_unchanged(ends, commits)
    assert {(r.uuid, r.n) for r in changed.collect()} == {("1", 1), ("2", 0), ("3", 1), ("5", 1)}
    key = lambda r: (r.layer, r.uuid, r.n, r.state, r.range_start, r.range_end)
    full = sorted(map(key, check.check_endpoints(cached, now, lines(now), tasks).collect()), key=str)
    got = check.recheck(cached, changed, now, lines, tasks).collect()
    assert sorted(map(key, got), key=str) == full
    again = {(r.layer, r.uuid, r.n) for r in got if r.rechecked}
    assert again == {(".", "1", 1), (".", "2", 0), (".", "3", 0), (".", "3", 1), (".", "5", 1), (".", "4", 1), ("in", "4", 1)}
    assert {(r.uuid, r.n): r.state for r in got if r.uuid in "123"} == {("1", 0): "OK", ("1", 1): "DISPLACED", ("2", 0): "ALTERED", ("2", 1): "OK", ("3", 0): "BROKEN", ("3", 1): "OK"}


def test_accepting_again_dirties_the_neighbours_layer_ends(spark, links):
    cached, tasks, lines = links
    now = sources(spark, [(".", "same", "same"), (".", "changed", "old line"), (".", "gone", "g"), (".", "moved", "text"), ("in", "deep", "d")])
    moved = accept.upsert_links(cached, spark.createDataFrame([("in", "4", 0, "h2")], "layer string, uuid string, n int, hash string"))
    none = cached.limit(0)
    for reaccepted, dirty in (([], set()), ([("in", "4")], {(".", "4", 1), ("in", "4", 1)})):
        r = spark.createDataFrame(reaccepted, "layer string, uuid string")
        got = check.recheck(moved, none, now, lines, tasks, r).collect()
        assert {(x.layer, x.uuid, x.n) for x in got if x.rechecked} == dirty
        assert next(x.state for x in got if (x.layer, x.uuid, x.n) == (".", "4", 1)) == ("CHAIN_DIRTY" if dirty else "OK")


def test_texts_of_unchanged_files_are_neither_hashed_nor_shuffled(spark, links):
    src = sources(spark, [(".", "same", "same"), (".", "changed", "x")])
    df = check.touched_sources(src, links[0].filter("file = 'changed'"))
    assert [r.file for r in df.collect()] == ["changed"]
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.index("sha2") < plan.index("LeftSemi") and "sha2" not in plan[plan.index("LeftSemi") :] and "BroadcastHashJoin" in plan
