"""Hunks against a plain diff, and their places from fragments against all pairs."""

import difflib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tautline.operators import hunks


def rebuilt(a, b, runs):
    """b from a and the runs alone; a run's lines of b are taken from b."""
    out, i = [], 0
    for p, q, r, s in runs:
        out += a[i:p] + b[r:s]
        i = q
    return out + a[i:]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh"), max_size=14), st.lists(st.sampled_from("abcdefgh"), max_size=14))
def test_runs_lead_from_one_text_to_the_other(a, b):
    runs = hunks.differing_runs(a, b)
    assert rebuilt(a, b, runs) == b and (runs == []) == (a == b)
    assert all((p < q or r < s) and a[p:q] != b[r:s] for p, q, r, s in runs)
    assert all(q < p2 or s < r2 for (_, q, _, s), (p2, _, r2, _) in zip(runs, runs[1:], strict=False))


def test_runs_of_distinct_lines_are_those_of_a_plain_diff():
    rnd = random.Random(6)
    for _ in range(60):
        a = [f"line {k}" for k in range(40)]
        b = [x for x in a if rnd.random() > 0.1]
        for _ in range(4):
            b.insert(rnd.randrange(len(b) + 1), f"new {rnd.random()}")
        plain = [tuple(x[1:]) for x in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if x[0] != "equal"]
        assert hunks.differing_runs(a, b) == plain


def test_line_hunks(spark):
    pairs = spark.createDataFrame([("1", "a\nb\nc", "a\nX\nc\nd"), ("2", "same", "same"), ("3", None, "x"), ("4", "x\ny", "y"), ("5", "", "")], "id string, before string, after string")
    got = sorted(tuple(r) for r in hunks.line_hunks(pairs).collect())
    assert got == [("1", 1, 2, 2, 2, 2), ("1", 2, 4, 3, 4, 4), ("3", 1, 1, 0, 1, 1), ("4", 1, 1, 1, 1, 0)]


def test_places_match_all_pairs(spark):
    rnd = random.Random(9)
    h, fr = [], []
    for f in "abc":
        at, shift = 1, 0
        for _ in range(rnd.randrange(0, 9)):
            start = at + rnd.randrange(1, 5)
            old, new = rnd.randrange(0, 4), rnd.randrange(0, 4)
            if old or new:
                h.append((f, start, start + old - 1, start + shift, start + shift + new - 1))
                at, shift = start + max(old, 1), shift + new - old
        fr += [(f, f"{f}{k}", x := rnd.randrange(1, 40), x + rnd.randrange(0, 6)) for k in range(20)]
    df = hunks.hunk_overlap(spark.createDataFrame(h, "file string, hunk_start long, hunk_end long, new_start long, new_end long"), spark.createDataFrame(fr, "file string, uuid string, first int, last int"))
    want = []
    for f, u, first, last in fr:
        mine = [x for x in h if x[0] == f]
        before, after = [x for x in mine if x[2] < first], [x for x in mine if x[1] > last and not x[2] < first]
        want += [(u, f, "WITHIN", x[1], x[2], 1, None) for x in mine if x[2] >= first and x[1] <= last]
        if before:
            x = max(before, key=lambda x: x[1])
            want.append((u, f, "BEFORE", x[1], x[2], len(before), sum((d - c) - (b - a) for _, a, b, c, d in before)))
        if after:
            x = min(after, key=lambda x: x[1])
            want.append((u, f, "AFTER", x[1], x[2], len(after), None))
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
