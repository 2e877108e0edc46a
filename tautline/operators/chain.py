"""Chains: one id in several layers; lookups and reports on links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tautline.functions import text as T
from tautline.operators.ranges import spans_containing


def chain_create(chains: DataFrame) -> DataFrame:
    """chains (uuid, layers, first, last: files of the two tips) -> layer, uuid, link0, link1 for every layer: tips are structural on the
    outside and point inward, mids point both ways. Two tips in one layer give one direct record."""
    each = chains.select("uuid", "first", "last", F.size("layers").alias("k"), F.posexplode("layers").alias("pos", "layer"))
    w = Window.partitionBy("uuid").orderBy("pos")
    each = each.withColumn("prev", F.lag("layer").over(w)).withColumn("next", F.lead("layer").over(w))
    direct = (F.col("k") == 2) & (F.coalesce(F.col("next"), F.col("prev")) == F.col("layer"))
    link0 = F.when(F.col("pos") == 0, F.col("first")).otherwise(T.relative_layer(F.col("layer"), F.col("prev")))
    link1 = F.when(direct | (F.col("pos") == F.col("k") - 1), F.col("last")).otherwise(T.relative_layer(F.col("layer"), F.col("next")))
    return each.filter(~direct | (F.col("pos") == 0)).select("layer", "uuid", link0.alias("link0"), link1.alias("link1"))


def chain_roles(endpoints: DataFrame) -> DataFrame:
    """layer, uuid, role (direct: both ends structural; tip: one; mid: none), hop (place on the chain from the root), length."""
    n = F.sum((F.col("kind") == "structural").cast("int"))
    per = endpoints.groupBy("layer", "uuid").agg(n.alias("s"))
    w = Window.partitionBy("uuid")
    return per.select(
        "layer", "uuid", F.when(F.col("s") == 2, "direct").when(F.col("s") == 1, "tip").otherwise("mid").alias("role"),
        F.row_number().over(w.orderBy(T.layer_depth(F.col("layer")), "layer")).alias("hop"), F.count("*").over(w).alias("length"),
    )


def overall(states: DataFrame, key: str = "uuid") -> DataFrame:
    """key, overall (BROKEN over DIRTY over OK), nodes of records with state0 and state1."""
    bad = F.col("state0").isin("ALTERED", "DELETED", "UNANCHORED", "BROKEN") | F.coalesce(F.col("state1").isin("ALTERED", "DELETED", "UNANCHORED", "BROKEN"), F.lit(False))
    dirty = (F.col("state0") == "CHAIN_DIRTY") | (F.col("state1") == "CHAIN_DIRTY")
    state = F.when(F.max(F.coalesce(bad, F.lit(False))), "BROKEN").when(F.max(F.coalesce(dirty, F.lit(False))), "DIRTY").otherwise("OK")
    return states.groupBy(key).agg(state.alias("overall"), F.count("*").alias("nodes"))


def chain_list(states: DataFrame) -> DataFrame:
    return overall(states).orderBy("uuid")


def chain_status(states: DataFrame, links: DataFrame, uuids: DataFrame) -> DataFrame:
    """All nodes of some chains: layer, both states (NONE if unknown), both written ends, the chain's overall state."""
    mine = links.join(uuids, "uuid", "left_semi").join(states.select("layer", "uuid", "state0", "state1"), ["layer", "uuid"], "left")
    none = lambda c: F.coalesce(c, F.lit("NONE")).alias(c)
    return mine.select("layer", "uuid", none("state0"), none("state1"), "link0", "link1").join(overall(states).select("uuid", "overall"), "uuid")


def file_index_build(endpoints: DataFrame) -> DataFrame:
    """file, ref (uuid.n), layer: the inverted index of structural endpoints, dealt and sorted by file."""
    ref = F.concat_ws(".", "uuid", F.col("n").cast("string")).alias("ref")
    return endpoints.filter("kind = 'structural'").select("file", ref, "layer").repartition("file").sortWithinPartitions("file", "ref")


def file_index_status(records: DataFrame, built: DataFrame) -> DataFrame:
    """records (layer, uuid, modified), built (layer, built_at, refs) -> layer, status (OK, STALE or MISSING), newer, missing_refs."""
    newer = F.count(F.when(F.col("modified") > F.col("built_at"), 1))
    per = records.join(built, "layer", "left").groupBy("layer").agg(F.max("built_at").alias("at"), newer.alias("newer"), F.count("*").alias("records"), F.coalesce(F.max("refs"), F.lit(0)).alias("refs"))
    return per.select("layer", F.when(F.col("at").isNull(), "MISSING").when(F.col("newer") > 0, "STALE").otherwise("OK").alias("status"), "newer", F.greatest(F.col("records") - F.col("refs"), F.lit(0)).alias("missing_refs"))


def lookup_by_file(files: DataFrame, endpoints: DataFrame) -> DataFrame:
    """files (file) -> file, uuid, n, range_start, range_end, other: structural endpoints with a range, and what stands at the other end."""
    other = F.when(F.col("kind") == "structural", F.concat_ws(" :: ", "file", "anchor_name")).when(F.col("kind") == "task", F.concat(F.lit("task "), "task_id")).otherwise(F.col("target_layer"))
    opposite = endpoints.select("layer", "uuid", (1 - F.col("n")).alias("n"), other.alias("other"))
    mine = endpoints.filter("kind = 'structural' and range_start is not null").join(files.select("file").distinct(), "file", "left_semi")
    return mine.join(opposite, ["layer", "uuid", "n"], "left").select("file", "layer", "uuid", "n", "range_start", "range_end", "other")


def lens_counts(endpoints: DataFrame, lines: DataFrame) -> DataFrame:
    """layer, file, line, links, uuids: how many links begin on each line."""
    points = endpoints.filter("kind = 'structural' and range_start is not null").select("layer", "file", "uuid", F.col("range_start").alias("at"))
    hit = spans_containing(points, lines.select("layer", "file", "line", "start", (F.col("end") + 1).alias("end")), ["layer", "file"])
    return hit.groupBy("layer", "file", "line").agg(F.count("*").alias("links"), F.array_join(F.array_sort(F.collect_list("uuid")), ",").alias("uuids"))


def status_report(endpoints: DataFrame, states: DataFrame) -> DataFrame:
    """dir, name (blank where it repeats the row above), uuid, state0, state1 of every record, grouped by the directory of its structural file."""
    file = F.min_by(F.when(F.col("kind") == "structural", F.col("file")), F.when(F.col("kind") == "structural", F.col("n")))
    per = endpoints.groupBy("layer", "uuid").agg(file.alias("file")).join(states, ["layer", "uuid"])
    folder = F.when(F.col("file").isNull(), "(layer)").otherwise(F.coalesce(F.nullif(F.regexp_extract("file", "^(.*)/[^/]*$", 1), F.lit("")), F.lit(".")))
    per = per.withColumn("dir", folder).withColumn("name", F.coalesce(F.regexp_extract("file", "([^/]*)$", 1), F.lit("")))
    same = Window.partitionBy("dir", "name", F.when(F.col("name") == "", F.col("uuid"))).orderBy("uuid", "layer")  # records without a file: one each
    return per.select("dir", "layer", "uuid", F.when(F.row_number().over(same) > 1, "").otherwise(F.col("name")).alias("name"), "state0", "state1")
