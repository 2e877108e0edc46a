"""Alerts from a stream of change events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tautline.functions.durable import durable


#: Characters of the pieces by which paths meet.
GRAM = 8


def grams(path: Column, size: int) -> Column:
    """All pieces of a path of `size` characters."""
    return F.transform(F.sequence(F.lit(1), F.length(path) - size + 1), lambda i: F.substring(path, i, F.lit(size)))


def piece(path: Column) -> Column:
    """The one piece by which a path is found inside longer ones: its last GRAM characters, where names differ most, or all of a shorter path."""
    return F.when(F.length(path) >= GRAM, F.right(path, F.lit(GRAM))).otherwise(path)


def path_index(endpoints: DataFrame) -> DataFrame:
    """endpoints (uuid, file) by the keys under which a changed path meets them: its pieces (inside = false: the linked path may lie in the changed one), its
    own piece (inside = true: the changed path may lie in the linked one, which is listed under all of its pieces of up to GRAM characters)."""
    linked = endpoints.select("uuid", F.col("file").alias("linked")).filter("linked <> ''")
    within = linked.select("uuid", "linked", F.lit(False).alias("inside"), piece(F.col("linked")).alias("key"))
    all_ = F.array_distinct(F.flatten(F.array(*[F.when(F.length("linked") >= k, grams(F.col("linked"), k)).otherwise(F.array().cast("array<string>")) for k in range(1, GRAM + 1)])))
    return within.unionByName(linked.select("uuid", "linked", F.lit(True).alias("inside"), F.explode(all_).alias("key")))


def watch_alerts(changes: DataFrame, endpoints: DataFrame, store: str = ".links/", dedup_delay: str | None = None) -> DataFrame:
    """changes (event_id, file, event_type; may be a stream), endpoints (uuid, file) -> event_id, file, uuid: an alert for every linked record when a
    modified path contains the linked path or lies in it. Paths inside the folder `store` of link records, and empty ones, raise none. Paths meet by an
    equality join on pieces of them and are compared then: each pair meets once for each direction, by the shorter one's piece.

    With dedup_delay (like '10 minutes') changes have an event time `ts` as well, and of a burst of alerts for one file and record one counts: others
    within that time of it are dropped (of those that come in one batch any but one), by a watermark, so that the state that is kept doesn't grow with the
    stream."""
    modified = changes.filter((F.col("event_type") == "modify") & ~F.col("file").contains(store) & (F.col("file") != ""))
    short = [r.n for r in endpoints.select(F.length("file").alias("n")).filter(f"n between 1 and {GRAM - 1}").distinct().collect()]  # GRAM - 1 lengths at most
    file = F.col("file")
    pieces = F.flatten(F.array(*[F.when(F.length(file) >= k, grams(file, k)).otherwise(F.array().cast("array<string>")) for k in [*short, GRAM]]))
    of = lambda inside: lambda x: F.struct(F.lit(inside).alias("inside"), x.alias("key"))
    seen = modified.withColumn("k", F.explode(F.concat(F.transform(F.array_distinct(pieces), of(False)), F.transform(F.array(piece(file)), of(True))))).select(*modified.columns, "k.*")
    hit = seen.join(durable(path_index(endpoints), "path-index"), ["inside", "key"])  # written once, not worked out anew for each batch
    hit = hit.filter(F.when(F.col("inside"), F.contains("linked", "file") & (F.col("linked") != F.col("file"))).otherwise(F.contains("file", "linked")))
    if dedup_delay is None:
        return hit.select("event_id", "file", "uuid")
    return hit.withWatermark("ts", dedup_delay).dropDuplicatesWithinWatermark(["file", "uuid"]).select("event_id", "file", "uuid", "ts")


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Everything that the stream holds now, appended to Parquet files."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
