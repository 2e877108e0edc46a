"""Joins of points and spans with spans: an equality join on a key and a bin, then the comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bins(start: Column, end: Column, width: int) -> Column:
    """The bins of `width` that a half-open span touches."""
    last = F.greatest(start, end - 1)
    return F.sequence(F.floor(start / width).cast("long"), F.floor(last / width).cast("long"))


def spans_containing(points: DataFrame, spans: DataFrame, keys: list[str], at: str = "at", width: int = 1024, hint: str = "merge") -> DataFrame:
    """points (keys, at) joined with the spans (keys, start, end) that cover them. A span is listed under each bin that it touches, a point under
    its own, so that each pair meets once. hint: how the spans are joined (not left to the sizes of files)."""
    p = points.withColumn("_bin", F.floor(F.col(at) / width).cast("long"))
    s = spans.withColumn("_bin", F.explode(bins(F.col("start"), F.col("end"), width)))
    return p.join(s.hint(hint), [*keys, "_bin"]).filter((F.col("start") <= F.col(at)) & (F.col(at) < F.col("end"))).drop("_bin")


def spans_around(inner: DataFrame, outer: DataFrame, keys: list[str], width: int = 1024, hint: str = "merge") -> DataFrame:
    """inner (keys, start, end) joined with the outer spans (keys, o_start, o_end) that hold them whole. hint: how the outer ones are joined."""
    i = inner.withColumn("_bin", F.floor(F.col("start") / width).cast("long"))
    o = outer.withColumn("_bin", F.explode(bins(F.col("o_start"), F.col("o_end"), width)))
    return i.join(o.hint(hint), [*keys, "_bin"]).filter((F.col("o_start") <= F.col("start")) & (F.col("end") <= F.col("o_end"))).drop("_bin")


def spans_overlapping(left: DataFrame, right: DataFrame, keys: list[str], width: int = 1024) -> DataFrame:
    """left (keys, start, end) joined with right (keys, o_start, o_end) where they overlap; a pair comes out under its first common bin."""
    a = left.withColumn("_bin", F.explode(bins(F.col("start"), F.col("end"), width)))
    b = right.withColumn("_bin", F.explode(bins(F.col("o_start"), F.col("o_end"), width)))
    first = F.floor(F.greatest("start", "o_start") / width).cast("long")
    return a.join(b.hint("merge"), [*keys, "_bin"]).filter((F.col("start") < F.col("o_end")) & (F.col("o_start") < F.col("end")) & (F.col("_bin") == first)).drop("_bin")
