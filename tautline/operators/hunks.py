"""Hunks: the differing runs of lines of two versions of a text, and where they lie from fragments."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tautline.operators.asof import as_of
from tautline.operators.ranges import spans_overlapping


def _longest_rise(values: list[int]) -> list[int]:
    """Places of a longest rising run of values (not necessarily side by side)."""
    tails, places, before = [], [], [-1] * len(values)
    for k, v in enumerate(values):
        at = bisect_left(tails, v)
        tails[at : at + 1], places[at : at + 1] = [v], [k]
        before[k] = places[at - 1] if at else -1
    out, k = [], places[-1] if places else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def differing_runs(a: list[str], b: list[str]) -> list[tuple[int, int, int, int]]:
    """(i, j, k, l): lines i to j of a became lines k to l of b (ends exclusive, from 0). Lines that stand once on either side and in one order on both are
    kept; between them the same again, and where no line does so, equally long runs are compared line by line."""
    todo, found = [(0, len(a), 0, len(b))], []
    while todo:
        i, j, k, l = todo.pop()  # noqa: E741
        while i < j and k < l and a[i] == b[k]:
            i, k = i + 1, k + 1
        while i < j and k < l and a[j - 1] == b[l - 1]:
            j, l = j - 1, l - 1  # noqa: E741
        if i == j or k == l:
            if i < j or k < l:
                found.append((i, j, k, l))
            continue
        n, m = Counter(a[i:j]), Counter(b[k:l])
        place = {x: k + p for p, x in enumerate(b[k:l]) if m[x] == 1}
        both = [(i + p, place[x]) for p, x in enumerate(a[i:j]) if n[x] == 1 and x in place]
        kept = [both[p] for p in _longest_rise([y for _, y in both])]
        if kept:
            for x, y in [*kept, (j, l)]:
                todo.append((i, x, k, y))
                i, k = x + 1, y + 1
        elif j - i == l - k:
            found += [(i + p, i + p + 1, k + p, k + p + 1) for p in range(j - i) if a[i + p] != b[k + p]]
        else:
            found.append((i, j, k, l))
    out: list[tuple[int, int, int, int]] = []
    for x in sorted(found):
        if out and out[-1][1] == x[0] and out[-1][3] == x[2]:
            x = (out[-1][0], x[1], out.pop()[2], x[3])
        out.append(x)
    return out


def line_hunks(pairs: DataFrame) -> DataFrame:
    """pairs (id, before, after) -> id, hunk (from 1), hunk_start, hunk_end, new_start, new_end: the differing runs in lines (from 1) of both texts; a run without
    lines ends before it starts. Each pair is compared in its task; a null text has no lines."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut = lambda t: [] if t is None else t.split("\n")
        for x in batches:
            rows = [(i, n + 1, p + 1, q, r + 1, s) for i, a, b in zip(x["id"], x["before"], x["after"], strict=True) for n, (p, q, r, s) in enumerate(differing_runs(cut(a), cut(b)))]
            yield pd.DataFrame(rows, columns=["id", "hunk", "hunk_start", "hunk_end", "new_start", "new_end"])

    return pairs.select("id", "before", "after").mapInPandas(of, "id string, hunk int, hunk_start long, hunk_end long, new_start long, new_end long")


def hunk_overlap(hunks: DataFrame, fragments: DataFrame) -> DataFrame:
    """hunks (file, hunk_start, hunk_end, new_start, new_end), fragments (file, uuid, first, last: lines before the change) -> uuid, file, place, hunk_start, hunk_end,
    hunks, shift. WITHIN: each hunk that touches the fragment. BEFORE and AFTER: the nearest hunk on that side, how many there are on it and, of
    those before, by how many lines they move the fragment. The sides come from the hunks' order; only overlapping pairs are joined."""
    order = Window.partitionBy("file").orderBy("hunk_start", "hunk_end")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grown = (F.col("new_end") - F.col("new_start")) - (F.col("hunk_end") - F.col("hunk_start"))
    whole = Window.partitionBy("file")
    h = hunks.withColumns({"nth": F.row_number().over(order).cast("long"), "shift": F.sum(grown).over(upto), "all": F.count("*").over(whole)})
    carried = ["hunk_start", "hunk_end", "nth", "shift", "all"]
    sides = h.select("file", F.col("hunk_end").alias("e"), F.col("hunk_start").alias("s"), *carried)
    f = fragments.select("file", "uuid", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))
    found = lambda df, place, n, shift: df.filter("hunk_start is not null").select("uuid", "file", F.lit(place).alias("place"), "hunk_start", "hunk_end", n.cast("long").alias("hunks"), shift.cast("long").alias("shift"))
    before = as_of(f.withColumn("at", F.col("first") - 1), sides.drop("s"), ["file"], "at", "e", carried)
    after = as_of(f, sides.drop("e"), ["file"], "last", "s", carried, after=True)
    inside = spans_overlapping(f.select("file", "uuid", F.col("first").alias("start"), (F.col("last") + 1).alias("end")), h.select("file", F.col("hunk_start").alias("o_start"), (F.col("hunk_end") + 1).alias("o_end"), *carried), ["file"])
    none = F.lit(None)
    return found(before, "BEFORE", F.col("nth"), F.col("shift")).unionByName(found(inside, "WITHIN", F.lit(1), none)).unionByName(found(after, "AFTER", F.col("all") - F.col("nth") + 1, none))
