"""Sides of joins by the number of their rows, which the size of a compressed file says little about."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows up to which a counted side goes to every executor.
FEW = 100_000


def sized(df: DataFrame, most: int = FEW, other: str = "merge") -> DataFrame:
    """A written table of narrow rows as a side of a join: broadcast if it is counted to have few rows, else sorted (or joined as `other` says). Left to itself Spark goes by the file's size
    times what a projection adds to a row, and sends tables through the driver that are a hundred times larger."""
    return df.hint("broadcast") if df.count() <= most else df.hint(other)
