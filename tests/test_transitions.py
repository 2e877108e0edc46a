"""Transitions by keyed state: batches in both orders, a restart, and the same states as checking the last files."""

import itertools

import pytest
from pyspark.sql import functions as F

from tautline.operators import accept, check, fragments
from tautline.streaming import transitions, watch
from test_operators import endpoints, sha, sources

CHANGES = "event_id long, what string, layer string, file string, text string, uuid string, n int, hash string, shape_hash string, accepted_len long"


def ends(spark):
    shape = lambda t: sha(spark, transitions_shape(spark, t))
    line = lambda uuid, name, text: dict(layer=".", uuid=uuid, n=1, kind="structural", file="a", anchor_kind="line", anchor_name=name, hash=sha(spark, text), shape_hash=shape(text), accepted=text, accepted_len=len(text.encode()))
    whole = lambda uuid, file, text, layer=".", n=0: dict(layer=layer, uuid=uuid, n=n, kind="structural", file=file, hash=text and sha(spark, text), accepted_len=text and len(text))
    return endpoints(
        spark, whole("1", "a", "one\ntwo two"), line("1", "L2", "two two"), whole("2", "b", None), line("2", "L1", "é one"), whole("3", "b", "bee"), line("3", "L7", "x"),
        whole("4", "a", "other"), dict(layer=".", uuid="4", n=1, kind="layer", target_layer="in", hash=sha(spark, "deep")), whole("4", "d", "deep", "in"), dict(layer="in", uuid="4", n=1, kind="layer", target_layer=".", hash="old"),
    )


def transitions_shape(spark, text):
    from tautline.functions import text as T

    return spark.range(1).select(T.shape(F.lit(text))).first()[0]


def file(i, name, text, layer="."):
    return (i, "file", layer, name, text, None, None, None, None, None)


def batches(spark):
    deep = sha(spark, "deeper")
    return [
        [file(1, "a", "one\ntwo two"), file(2, "b", "bee"), file(3, "d", "deep", "in"), file(4, "a", "one\ntwo  two")],
        [file(5, "a", "and é one\ntwo two and more"), file(6, "b", None), file(7, "d", "deeper", "in"), (8, "accept", "in", None, None, "4", 0, deep, None, 6)],
        [file(9, "b", "bee\n2"), file(10, "a", "an é one\nand two two\n3"), (11, "accept", ".", None, None, "4", 1, deep, None, None), file(12, "d", "deeper", "in")],
    ]


def final(spark, e, rows):
    """The states after the transitions: of each end that of its last one, else the stored one."""
    last = {}
    for r in sorted(rows, key=lambda r: r.step):
        last[r.layer, r.uuid, r.n] = r.new_state
    return {k: v for k, v in last.items()}


def watched(spark, tmp_path, e, order, restart=False):
    src, out = tmp_path / "in", f"{tmp_path}/out"
    all_ = batches(spark)

    def run():
        stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(f"{src}/*")
        watch.run_available(transitions.transitions(stream, e), f"{out}/rows", f"{out}/checkpoint")

    for k, b in enumerate(order):
        spark.createDataFrame(all_[b], CHANGES).coalesce(1).write.parquet(f"{src}/{k}")
        if restart:
            run()
    if not restart:
        run()
    return spark.read.schema(transitions.OUT).parquet(f"{out}/rows").collect()


@pytest.mark.parametrize(("order", "restart"), [((0, 1, 2), False), ((2, 1, 0), False), ((0, 1, 2), True), ((2, 0, 1), True)])
def test_batches_in_any_order_end_like_a_check_of_the_last_files(spark, tmp_path, order, restart):
    e = ends(spark)
    rows = watched(spark, tmp_path, e, order, restart)
    assert len({(r.uuid, r.layer, r.n, r.event_id) for r in rows}) == len(rows) and all(r.state != r.new_state for r in rows)
    deep = sha(spark, "deeper")
    accepted = accept.upsert_links(e, spark.createDataFrame([("in", "4", 0, deep, 6), (".", "4", 1, deep, None)], "layer string, uuid string, n int, hash string, accepted_len long"))
    now = sources(spark, [(".", "a", "an é one\nand two two\n3"), (".", "b", "bee\n2"), ("in", "d", "deeper")])
    tasks = spark.createDataFrame([], "task_id string, text string")
    want = {(r.layer, r.uuid, r.n): r.state for r in check.check_endpoints(accepted, now, fragments.fragments_extract(now, ("line",)), tasks).collect()}
    got = final(spark, e, rows)
    del want["in", "4", 1]  # the neighbour that it points to never accepted anew: no row
    if not restart and order == (0, 1, 2):
        assert {"OK", "PENDING", "ALTERED", "RESTYLED", "DISPLACED", "BROKEN", "UNANCHORED", "CHAIN_DIRTY"} <= {r.new_state for r in rows}
    assert {k: v for k, v in got.items() if k != ("in", "4", 1)} == want


def test_each_change_is_one_transition(spark, tmp_path):
    rows = watched(spark, tmp_path, ends(spark), (0, 1, 2))
    one = [(r.event_id, r.state, r.new_state) for r in sorted(rows, key=lambda r: r.event_id) if (r.uuid, r.n) == ("1", 1)]
    assert one == [(1, None, "OK"), (4, "OK", "RESTYLED"), (5, "RESTYLED", "DISPLACED")]
    assert [b for _, b in itertools.pairwise([(r.event_id, r.new_state) for r in sorted(rows, key=lambda r: r.event_id) if (r.layer, r.uuid, r.n) == (".", "4", 1)])] == [(11, "OK")]


def test_a_text_that_comes_back_is_searched_once(monkeypatch):
    import json

    import pandas as pd

    from tautline.streaming import transitions

    searched, displaced = [], transitions._displaced
    monkeypatch.setattr(transitions, "_displaced", lambda *a: searched.append(a[0]) or displaced(*a))
    digest = transitions.hashlib.sha256(b"abc").hexdigest()
    end = {"layer": ".", "n": 1, "kind": "structural", "target_layer": None, "hash": digest, "shape_hash": "s", "accepted_len": 3, "state": None, "anchored": True}
    nodes = ["xabc", "nothing", "xabc", "abc", "nothing", "xabc"]
    row = lambda k, node: {"layer": ".", "n": 1, "event_id": k, "what": "file", "there": True, "now_hash": transitions.hashlib.sha256(node.encode()).hexdigest(), "now_shape": "t", "node": node, "hash": None, "shape_hash": None, "accepted_len": None, "ends": json.dumps([end])}
    state = type("State", (), {"exists": False, "update": lambda self, v: None})()
    (got,) = transitions._transitions(("u",), iter([pd.DataFrame([row(k, x) for k, x in enumerate(nodes)])]), state)
    assert list(got["new_state"]) == ["DISPLACED", "ALTERED", "DISPLACED", "OK", "ALTERED", "DISPLACED"] and sorted(searched) == ["nothing", "xabc"]
