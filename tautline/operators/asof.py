"""As-of joins: for each request the last version that is not after it, or the first one after it, by a sort instead of a product."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a range of sequence numbers of one key should hold.
RANGE = 500_000


def as_of(requests: DataFrame, versions: DataFrame, keys: list[str], at: str, seq: str, carried: list[str], after: bool = False, rows: int = RANGE) -> DataFrame:
    """requests (keys, `at`, any others) with the columns `carried` of the version (keys, `seq`, carried) of the same keys that has the greatest seq up to
    `at`, or with `after` the least one beyond it; null where there is none, or where `at` is null. Of versions of one key and seq the one with the greatest columns
    counts.

    Both sides are sorted together and a version's columns are carried on to the requests that follow. Sequence numbers are cut into equal ranges
    beforehand, so many that a key with all rows is sorted in parts of some `rows` rows; what the ranges before it end with is carried into each."""
    others = [c for c in requests.columns if c not in keys]
    value, place = F.struct(F.col(seq).alias("_at"), *carried), F.col(seq)
    v = versions.filter(place.isNotNull()).select(*keys, place.cast("long").alias("_seq"), F.lit(1).alias("_side"), value.alias("_v"))
    r = requests.select(*keys, F.col(at).cast("long").alias("_seq"), F.lit(2).alias("_side"), F.struct(*others).alias("_r"))
    n, low, high = v.agg(F.count("*"), F.min("_seq"), F.max("_seq")).first()
    width = max(1, ((high or 0) - (low or 0) + 1) // max(1, -(-n // rows)))
    part = F.when(F.col("_seq").isNull(), F.lit(None)).otherwise(F.floor((F.col("_seq") - F.lit(low or 0)) / width)).cast("long")
    part = F.greatest(F.lit(-1), F.least(part, F.lit(max(1, -(-n // rows)))))
    none = F.lit(None)
    both = v.withColumn("_r", none.cast(r.schema["_r"].dataType)).unionByName(r.withColumn("_v", none.cast(v.schema["_v"].dataType))).withColumn("_part", part)
    sign = -1 if after else 1
    edge = F.max_by("_v", F.struct((F.col("_seq") * sign).alias("a"), F.col("_v").alias("b")))
    ends = both.filter("_side = 1").groupBy(*keys, "_part").agg(edge.alias("_end"))
    asked = r.withColumn("_part", part).select(*keys, "_part").distinct()
    over = Window.partitionBy(*keys).orderBy(F.col("_part") * sign)
    before = F.last("_end", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1))
    into = asked.join(ends, [*keys, "_part"], "full_outer").withColumn("_before", before).select(*keys, "_part", "_before")
    # at equal numbers a version stands before the requests that it answers: up to `at` it does, beyond it it doesn't
    order = [F.col("_seq") * sign, F.col("_side") * sign, F.col("_v")]
    within = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("_seen", F.last("_v", ignorenulls=True).over(within)).filter("_side = 2")
    out = seen.join(into.hint("merge"), [*keys, "_part"], "left").withColumn("_v", F.when(F.col("_seq").isNotNull(), F.coalesce("_seen", "_before")))
    return out.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in others], *[F.col(f"_v.{c}").alias(c) for c in carried])
