"""Sharding by minimax contiguous partition.

Documents of equal text form one atomic group. Groups stand in the order of their digest, and a shard is a
contiguous run of groups. The smallest capacity with which n_shards runs suffice is found by binary search; whether
a capacity suffices is checked greedily, each shard taking as many groups as fit. The search runs on a table of
running sums, and tries many capacities in one job, so that the driver sees a few numbers a job, never the groups.
At the capacity found, the cuts are put within their slack to where the shards come out level.

Running sums and slots come in two levels (within a bucket, then over a fixed number of buckets), so that no task
holds a shard or a group of copies whole. A document's shard follows from comparing its digest with the cuts.

Defined results: a null text counts as empty, and size is 1 then; a null doc_id is a row like any other; repeated rows
belong to one group and get slots of their own; an empty table gives no rows; fewer groups than shards leave
shards unused; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tautline.functions.durable import durable

#: Capacities that one job tries.
TRIES = 64
#: Fixed numbers of buckets: for running sums (hexadecimal digits of the digest), for slots (digits and salt).
SUM_DIGITS, SLOT_DIGITS, SALTS = 3, 2, 64


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("doc_id"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t).alias("text_crc32"), F.md5(t).alias("digest"))


def running_sums(rows: DataFrame) -> DataFrame:
    """digest and the bytes of all groups up to it, itself included, in digest order."""
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes")).withColumn("bucket", F.substring("digest", 1, SUM_DIGITS))
    groups = groups.withColumn("within", F.sum("bytes").over(Window.partitionBy("bucket").orderBy("digest").rowsBetween(Window.unboundedPreceding, 0)))
    before = groups.groupBy("bucket").agg(F.sum("bytes").alias("all")).select("bucket", (F.sum("all").over(Window.orderBy("bucket")) - F.col("all")).alias("before"))
    return groups.join(F.broadcast(before), "bucket").select("digest", "bytes", (F.col("before") + F.col("within")).alias("upto"))


def _last(sums: DataFrame, bounds: list[int]) -> list[int]:
    """For each bound the largest running sum that isn't above it (0: none)."""
    row = sums.agg(*[F.max(F.when(F.col("upto") <= b, F.col("upto"))).alias(f"b{k}") for k, b in enumerate(bounds)]).first()
    return [x or 0 for x in row]


def _first(sums: DataFrame, bounds: list[int], total: int) -> list[int]:
    """For each bound the smallest running sum, or 0, that isn't below it."""
    row = sums.agg(*[F.min(F.when(F.col("upto") >= b, F.col("upto"))).alias(f"b{k}") for k, b in enumerate(bounds)]).first()
    return [0 if b <= 0 else total if x is None else x for x, b in zip(row, bounds, strict=True)]


def capacity(sums: DataFrame, n_shards: int, total: int, largest: int) -> int:
    """The smallest capacity with which n_shards contiguous runs of groups take everything."""
    low, high = max(-(-total // n_shards), largest), total // n_shards + largest
    while low < high:
        tries = sorted({low + (high - 1 - low) * k // max(1, TRIES - 1) for k in range(TRIES)})
        ends = [0] * len(tries)
        for _ in range(n_shards):
            ends = _last(sums, [e + c for e, c in zip(ends, tries, strict=True)])
        enough = [c for c, e in zip(tries, ends, strict=True) if e >= total]
        short = [c for c, e in zip(tries, ends, strict=True) if e < total]
        low, high = max([low, *(c + 1 for c in short)]), min([high, *enough])
    return high


def level_cuts(sums: DataFrame, n_shards: int, total: int, most: int) -> list[int]:
    """n_shards - 1 running sums at which to cut: no shard above `most`, the shards as level as that and whole groups allow."""
    least = [total]
    for _ in range(n_shards - 1):  # from the end: where shard j may begin at the earliest
        least.append(_first(sums, [least[-1] - most], total)[0])
    least, cuts, at = least[::-1], [], 0
    for j in range(1, n_shards):
        goal = at + (total - at) // (n_shards - j + 1)
        below, top = _last(sums, [goal, at + most])
        above = _first(sums, [goal], total)[0]
        at = min(max(below if goal - below <= above - goal else above, least[j], at), top)
        cuts.append(at)
    return cuts


def shard(docs: DataFrame, n_shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard (int), slot (long, gapless from 0 in each shard)."""
    rows = durable(sized(docs, key, text), "sized")
    sums = durable(running_sums(rows), "sums")
    total, largest = sums.agg(F.max("upto"), F.max("bytes")).first()
    ends: list[str] = []
    if total:
        cuts = level_cuts(sums, n_shards, total, capacity(sums, n_shards, total, largest))
        digest = {r.upto: r.digest for r in sums.filter(F.col("upto").isin(cuts)).collect()}  # n_shards - 1 rows at most
        ends = [digest.get(c, "") for c in cuts]
    in_shard = sum((F.when(F.col("digest") > e, 1).otherwise(0) for e in ends), F.lit(0)).cast("int")
    placed = rows.select("doc_id", "size", "text_crc32", in_shard.alias("shard"), F.concat(F.substring("digest", 1, SLOT_DIGITS), F.pmod(F.xxhash64("doc_id", "digest"), F.lit(SALTS)).cast("string")).alias("cell"))
    counts = placed.groupBy("shard", "cell").count()
    before = counts.select("shard", "cell", (F.sum("count").over(Window.partitionBy("shard").orderBy("cell")) - F.col("count")).alias("before"))
    place = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size")) - 1
    return placed.withColumn("place", place).join(F.broadcast(before), ["shard", "cell"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("place")).cast("long").alias("slot"))


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op10_sharding": op10_sharding}
