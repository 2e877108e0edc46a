"""Lines and columns as bytes, captures, what stands opposite, and how much of a large file is shuffled."""

import hashlib
import random

from pyspark.sql import functions as F

from tautline.functions import text as T
from tautline.operators import fragments, graph
from test_operators import endpoints, sources

digest = lambda t: hashlib.sha256(t.encode()).hexdigest()


def written(spark, df):
    """Bytes of shuffle that a query writes, and its rows."""
    group = f"g{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    rows = df.collect()
    store, tracker = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext.statusTracker()
    total = 0
    for job in tracker.getJobIdsForGroup(group):
        for stage in tracker.getJobInfo(job).stageIds:
            total += store.lastStageAttempt(stage).shuffleWriteBytes()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return total, rows


def test_running_starts(spark):
    for n in (0, 1, 2, 3, 8, 9, 100):
        sizes = [random.Random(n).randrange(50) for _ in range(n)]
        df = spark.createDataFrame([(sizes,)], "x array<long>")
        assert df.select(T.running_starts(F.col("x"))).first()[0] == [sum(sizes[:k]) for k in range(n)]


def test_positions_of_lines_and_columns(spark):
    text = "aé b\n\nüx"
    lines = fragments.line_offsets(sources(spark, [(".", "f", text)]))
    asked = [(line, col) for line in range(5) for col in range(7)]
    points = spark.createDataFrame([(".", "f", a, b) for a, b in asked], "layer string, file string, line int, col int")
    rows = text.split("\n")
    start = lambda k: len("\n".join(rows[:k]).encode()) + (k > 0)
    want = {(a, b): start(a - 1) + len(rows[a - 1][: b - 1].encode()) if 1 <= a <= 3 and 1 <= b <= len(rows[a - 1]) + 1 else None for a, b in asked}
    assert {(r.line, r.col): r["at"] for r in fragments.positions(points, lines).collect()} == want
    want = {(a, b): start(a - 1) + b - 1 if 1 <= a <= 3 and 1 <= b <= len(rows[a - 1].encode()) + 1 else None for a, b in asked}
    assert {(r.line, r.col): r["at"] for r in fragments.positions(points, lines, "byte").collect()} == want


def test_capture_from_lines_and_columns(spark, monkeypatch):
    monkeypatch.setattr(fragments, "TOGETHER", 2)
    text = "pub mod é {\n    pub fn vote() {\n        ünder(1)\n    }\n}\n".replace("mod é", "mod m")
    src = sources(spark, [(".", "a.rs", text)])
    sel = [("in", 3, 9, 3, 14), ("point", 3, 9, 3, 9), ("fn", 2, 1, 4, 6), ("two", 1, 3, 2, 4), ("out", 9, 1, 9, 2), ("back", 3, 9, 3, 8), ("wide", 1, 1, 6, 1), ("in2", 3, 10, 3, 14), ("in3", 2, 5, 3, 14)]
    spans = fragments.selection_spans(spark.createDataFrame([(k, ".", "a.rs", *x) for k, *x in sel], "id string, layer string, file string, from_line int, from_col int, to_line int, to_col int"), fragments.line_offsets(src))
    at = {r.id: (r.sel_start, r.sel_end) for r in spans.collect()}
    assert set(at) == {k for k, *_ in sel} - {"out", "back"}
    got = {(r.sel_start, r.sel_end): r for r in fragments.anchor_capture(spans, fragments.declarations(src)).collect()}
    raw = text.encode()
    fn = text[text.index("    pub fn") :]
    row = lambda k: (got[at[k]].name, got[at[k]].parent_name, got[at[k]].rel_start is None, got[at[k]].hash)
    assert row("in") == ("vote", "m", False, digest("ünder")) and row("point") == ("vote", "m", True, digest(fn)) and row("in2")[3] == digest("nder")
    assert row("two") == ("m", None, False, digest(raw[at["two"][0] : at["two"][1]].decode()))
    for k, (a, b) in at.items():
        r = got[a, b]
        begin = raw.index(fn.encode()) if r.name == "vote" else 0
        assert r.rel_start is None or (r.rel_start, r.rel_end) == (a - begin, b - begin), k


def test_a_large_file_is_not_shuffled_for_each_bin(spark):
    rnd = random.Random(8)
    text = "".join(rnd.choices("abcdefgh ", k=1_000_000))
    src = sources(spark, [(".", "one-line.txt", text)])
    lines = fragments.line_offsets(src)
    one = lines.select("layer", "file", F.lit("line").alias("kind"), F.lit("L1").alias("name"), "start", "end", "text")
    picked = spark.createDataFrame([(".", "one-line.txt", k * 1000, k * 1000 + 7) for k in range(50)], "layer string, file string, sel_start long, sel_end long")
    size, rows = written(spark, fragments.anchor_capture(picked, one))
    assert {r.hash for r in rows} == {digest(text[k * 1000 : k * 1000 + 7]) for k in range(50)} and 0 < size < 10_000_000
    spans = spark.createDataFrame([(".", "one-line.txt", "u", 0, 1_000_000), (".", "one-line.txt", "t", 5, 900_000)], "layer string, file string, uuid string, start long, end long")
    size, rows = written(spark, graph.graph_nodes(spans, lines))
    assert [(r.id, r.uuid, r.content == text) for r in rows] == [("one-line.txt@.#L1", "t", True)] and 0 < size < 10_000_000


def test_opposite_fragments_by_both_routes(spark):
    src = sources(spark, [(".", "a.txt", "one\ntwo\nthree"), (".", "b.txt", "bee\n2"), ("in", "c.txt", "x\nsee")])
    line = dict(kind="structural", anchor_kind="line")
    e = endpoints(
        spark, dict(line, layer=".", uuid="1", n=0, file="a.txt", anchor_name="L2"), dict(layer=".", uuid="1", n=1, kind="structural", file="b.txt"),
        dict(line, layer=".", uuid="2", n=0, file="a.txt", anchor_name="L3"), dict(layer=".", uuid="2", n=1, kind="layer", target_layer="in"),
        dict(layer="in", uuid="2", n=0, kind="layer", target_layer="."), dict(line, layer="in", uuid="2", n=1, file="c.txt", anchor_name="L2", rel_start=1, rel_end=2),
        dict(layer=".", uuid="3", n=0, kind="structural", file="gone"), dict(layer=".", uuid="3", n=1, kind="layer", target_layer="nowhere"),
        dict(line, layer=".", uuid="4", n=0, file="a.txt", anchor_name="L9"), dict(layer=".", uuid="4", n=1, kind="task", task_id="t"),
    )
    lines = fragments.fragments_extract(src, ("line",))
    got = {(r.layer, r.uuid, r.n): (r.route, r.file, r.first_line, r.last_line, r.content) for r in fragments.opposite_fragment(e.select("layer", "uuid", "n"), e, src, lines).collect()}
    assert got == {
        (".", "1", 0): ("side", "b.txt", 1, 2, "bee\n2"), (".", "1", 1): ("side", "a.txt", 2, 2, "two"), (".", "2", 0): ("layer", "c.txt", 2, 2, "see"), (".", "2", 1): ("side", "a.txt", 3, 3, "three"),
        ("in", "2", 0): ("side", "c.txt", 2, 2, "see"), ("in", "2", 1): ("layer", "a.txt", 3, 3, "three"),
    }
    one = e.filter("uuid = '1' and n = 1").select("layer", "uuid", "n")
    assert [r.content for r in fragments.opposite_fragment(one, e, src, lines, 1, 5).collect()] == ["one\ntwo\nthree"]
