"""Accepting baselines, changing and removing records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tautline.functions import text as T
from tautline.operators.check import KEY
from tautline.operators.detect import latest_commit
from tautline.operators.fragments import anchor_resolve, first_of, subrange_slice


def accept_endpoints(endpoints: DataFrame, sources: DataFrame, fragments: DataFrame | Callable[[DataFrame], DataFrame], tasks: DataFrame, commits: DataFrame | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """layer, uuid, n, new_hash, new_shape, new_commit, error: what accepting each endpoint stores, or why it can't be.

    A structural end gets the digest of its text, of an anchor also that of its shape, and the latest of `commits` (layer, file, commit, seq) on
    its file; a task the latest commit on its file in the root layer; a layer end what the structural side of its neighbour has accepted (side
    0 first). `overrides` (layer, uuid, n, hash, commit) replace digest or commit where they have a value."""
    spark, none = endpoints.sparkSession, F.lit(None).cast("string")
    head = spark.createDataFrame([], "layer string, file string, head string") if commits is None else latest_commit(commits).withColumnRenamed("commit", "head")
    whole = endpoints.filter("kind = 'structural' and anchor_name is null").join(sources.select("layer", "file", F.col("hash").alias("new_hash")), ["layer", "file"], "left")
    whole = whole.select(*KEY, "file", "new_hash", none.alias("new_shape"), F.when(F.col("new_hash").isNull(), "no such file").alias("error"))
    there = sources.select("layer", "file", F.lit(True).alias("there"))
    part = subrange_slice(anchor_resolve(endpoints, fragments)).join(there, ["layer", "file"], "left")
    found = lambda c: F.when(F.col("there"), T.digest(c))
    error = F.when(F.col("there").isNull(), "no such file").when(F.col("frag").isNull(), "anchor not found")
    part = part.select(*KEY, "file", found(F.col("frag")).alias("new_hash"), found(T.shape(F.col("node_text"))).alias("new_shape"), error.alias("error"))
    structural = whole.unionByName(part).join(head, ["layer", "file"], "left").select(*KEY, "new_hash", "new_shape", F.when(F.col("error").isNull(), F.col("head")).alias("new_commit"), "error")
    side = F.when((F.col("kind") == "structural") & F.col("hash").isNotNull(), F.col("n"))
    other = endpoints.groupBy(F.col("layer").alias("target_layer"), "uuid").agg(F.min_by(F.struct("hash", "commit"), side).alias("s"))
    layer = endpoints.filter("kind = 'layer'").select(*KEY, "target_layer").join(other, ["target_layer", "uuid"], "left")
    layer = layer.select(*KEY, F.col("s.hash").alias("new_hash"), none.alias("new_shape"), F.col("s.commit").alias("new_commit"), F.when(F.col("s.hash").isNull(), "neighbour has no digest").alias("error"))
    file = F.concat(F.lit(".stratum/worklist/"), "task_id", F.lit(".task"))
    task = endpoints.filter("kind = 'task'").select(*KEY, "task_id", file.alias("file")).join(tasks.select("task_id", T.digest(F.col("text")).alias("new_hash")), "task_id", "left")
    task = task.join(head.filter("layer = '.'").select("file", "head"), "file", "left")
    gone = F.when(F.col("new_hash").isNull(), "no such task")
    task = task.select(*KEY, "new_hash", none.alias("new_shape"), F.when(gone.isNull(), F.col("head")).alias("new_commit"), gone.alias("error"))
    out = structural.unionByName(layer).unionByName(task)
    if overrides is None:
        return out
    given = out.join(overrides.select(*KEY, F.col("hash").alias("by_hash"), F.col("commit").alias("by_commit")), KEY, "left")
    pick = lambda by, c: F.when(F.col("error").isNull(), F.coalesce(by, c)).alias(c)
    return given.select(*KEY, pick("by_hash", "new_hash"), "new_shape", pick("by_commit", "new_commit"), "error")


def apply_fixes(endpoints: DataFrame, fixes: DataFrame) -> DataFrame:
    """endpoints with the proposals fixes (layer, uuid, n, field, old, new) stored: a file, an anchor's name, a range (start~end)."""
    of = lambda field: F.max(F.when(F.col("field") == field, F.col("new")))
    new = fixes.groupBy(*KEY).agg(of("file").alias("file"), of("anchor").alias("anchor_name"), of("range").alias("range"))
    span = F.split("range", "~")
    return upsert_links(endpoints, new.select(*KEY, "file", "anchor_name", span[0].cast("long").alias("range_start"), span[1].cast("long").alias("range_end")))


def accept_bulk(endpoints: DataFrame, prefix: str | None = None) -> DataFrame:
    """Endpoints that a bulk accept takes: without digest, or in state ALTERED, RESTYLED or CHAIN_DIRTY; structural and layer
    ones, or with a prefix only structural ones whose file begins with it."""
    stale = F.col("hash").isNull() | F.coalesce(F.col("state").isin("ALTERED", "RESTYLED", "CHAIN_DIRTY"), F.lit(False))
    scope = F.col("kind").isin("structural", "layer") if prefix is None else (F.col("kind") == "structural") & F.col("file").startswith(prefix)
    return endpoints.filter(stale & scope)


def upsert_links(endpoints: DataFrame, changes: DataFrame) -> DataFrame:
    """endpoints with the columns of `changes` (keyed by layer, uuid, n) where these have a value; new keys are added."""
    cols = [c for c in changes.columns if c not in KEY]
    both = endpoints.join(changes.select(*KEY, *[F.col(c).alias(f"_{c}") for c in cols]), KEY, "full_outer")
    return both.select(*KEY, *[(F.coalesce(f"_{c}", c) if c in cols else F.col(c)).alias(c) for c in endpoints.columns if c not in KEY])


def resolve_id_prefix(requests: DataFrame, links: DataFrame) -> DataFrame:
    """request, uuid (null: none), matches: full or abbreviated (8 characters at least) ids; an exact one wins."""
    ids = links.select("uuid").distinct().withColumn("p", F.substring("uuid", 1, 8))
    hit = requests.withColumn("p", F.substring("request", 1, 8)).join(ids, "p", "left")
    hit = hit.withColumn("uuid", F.when(F.col("uuid").startswith(F.col("request")), F.col("uuid")))
    counted = hit.groupBy("request").agg(F.count("uuid").alias("matches"))
    best = first_of(hit, ["request"], F.struct(F.coalesce(F.col("uuid") != F.col("request"), F.lit(True)), F.col("uuid").isNull(), "uuid"))
    return best.select("request", "uuid").join(counted, "request")


def remove_links(endpoints: DataFrame, records: DataFrame) -> DataFrame:
    """endpoints without the records (layer, uuid)."""
    return endpoints.join(records, ["layer", "uuid"], "left_anti")
