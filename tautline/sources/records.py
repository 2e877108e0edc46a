"""Link and symbol records as text files: reading, writing, parsing of endpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The keys of a link record and of a symbol record.
LINK_KEYS = ["link.0", "link.1", "subgraph.0", "subgraph.1", "hash.0", "hash.1", "hash_ast.0", "hash_ast.1", "commit.0", "commit.1", "range.0", "range.1", "state.0", "state.1", "resolved_at"]
SYMBOL_KEYS = ["symbol", "file", "range", "hash", "commit", "state", "resolved_at"]


def parse_endpoint(written: Column) -> Column:
    """A written endpoint as a struct: kind, file, query, rel_start, rel_end, target_layer, task_id."""
    t = F.trim(written)
    parts = F.transform(F.split(t, "::", 3), lambda x: F.trim(x))
    span = F.split(F.get(parts, F.lit(2)), "~")
    task = F.when(t.startswith("task "), F.trim(F.substring(t, 6, 1 << 30)))
    is_task = F.coalesce(task != "", F.lit(False))
    last = F.element_at(F.split(t, "/"), -1)
    named = t.contains("::")
    whole = ~named & last.contains(".") & ~last.isin(".", "..")
    kind = F.when(is_task, "task").when(named | whole, "structural").otherwise("layer")
    return F.struct(
        kind.alias("kind"), F.when(kind == "structural", parts[0]).alias("file"), F.when(kind == "structural", F.get(parts, F.lit(1))).alias("query"),
        F.when(kind == "structural", F.trim(F.get(span, F.lit(0))).try_cast("long")).alias("rel_start"), F.when(kind == "structural", F.trim(F.get(span, F.lit(1))).try_cast("long")).alias("rel_end"),
        F.when(kind == "layer", t).alias("target_layer"), F.when(kind == "task", task).alias("task_id"),
    )


def parse_endpoints(records: DataFrame) -> DataFrame:
    """records (layer, uuid, link0, link1, ...) -> one row for each end, n 0 and 1."""
    keep = [c for c in records.columns if c not in ("link0", "link1")]
    ends = records.select(*keep, F.posexplode(F.array("link0", "link1")).alias("n", "written"))
    return ends.withColumn("e", parse_endpoint(F.col("written"))).select(*keep, "n", "e.*")


def _texts(spark: SparkSession, path: str, files: str) -> DataFrame:
    """path, value (the text) of all record files under a folder, but those under .pending."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", files).load(path)
    return found.filter(~F.col("path").contains("/.pending/")).select("path", F.decode("content", "UTF-8").alias("value"))


def _wide(texts: DataFrame, by: list[str], keys: list[str], continued: list[str]) -> DataFrame:
    """One row for each of `by`, which names a record, with a column for each key (dots as nothing) of its key/value lines; lines without a key
    continue the one above where that key may be continued. Blank lines and # comments go."""
    lines = texts.select(*by, F.explode(F.transform(F.split("value", "\n"), lambda x, i: F.struct(i.alias("pos"), x.alias("line")))).alias("l")).select(*by, "l.*")
    lines = lines.filter((F.trim("line") != "") & ~F.ltrim("line").startswith("#"))
    key = F.regexp_extract("line", r"^([a-z_]+(?:\.[01])?)\s*=\s*", 1)
    lines = lines.withColumn("k", F.when(key != "", key))
    run = F.sum(F.col("k").isNotNull().cast("int")).over(Window.partitionBy(*by).orderBy("pos"))
    lines = lines.withColumn("run", run)
    value = F.when(F.col("k").isNotNull(), F.regexp_replace("line", r"^[a-z_]+(?:\.[01])?\s*=\s*", "")).otherwise(F.trim("line"))
    got = lines.withColumn("v", value).groupBy(*by, "run").agg(F.max("k").alias("key"), F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("vs"))
    joined = F.array_join(F.transform("vs", lambda x: x["v"]), " ")
    got = got.select(*by, "key", F.when(F.col("key").isin(continued), joined).otherwise(F.element_at("vs", 1)["v"]).alias("value"))
    wide = got.groupBy(*by).pivot("key", keys).agg(F.first("value"))
    return wide.select(*by, *[F.col(f"`{k}`").alias(k.replace(".", "")) for k in keys])


def link_records(texts: DataFrame) -> DataFrame:
    """texts (layer, uuid, value: a record as text) -> layer, uuid, one column for each key, error."""
    error = F.when(F.col("link0").isNull() | F.col("link1").isNull(), "a link is missing")
    return _wide(texts, ["layer", "uuid"], LINK_KEYS, ["link.0", "link.1"]).withColumn("error", error)


def symbol_records(texts: DataFrame) -> DataFrame:
    """texts (record: what names it, value: a symbol record as text) -> its keys, error."""
    span = F.split("range", "~")
    error = F.when(F.col("symbol").isNull() | F.col("file").isNull() | F.col("range").isNull(), "symbol, file or range is missing")
    return _wide(texts, ["record"], SYMBOL_KEYS, []).select("symbol", "file", F.get(span, F.lit(0)).try_cast("long").alias("range_start"), F.get(span, F.lit(1)).try_cast("long").alias("range_end"), "hash", "commit", "state", error.alias("error"))


def scan_links(spark: SparkSession, path: str, files: str = "*") -> DataFrame:
    """link_records() of all record files under a folder of layers."""
    uuid = F.regexp_extract("path", r"([0-9a-f]{8}-[0-9a-f-]{27})[^/]*(?:/[^/]*)?$", 1)
    layer = F.url_decode(F.regexp_extract("path", r"layer=([^/]+)/", 1))
    return link_records(_texts(spark, path, files).select(layer.alias("layer"), uuid.alias("uuid"), "value"))


def scan_symbol_links(spark: SparkSession, path: str, files: str = "*") -> DataFrame:
    """symbol_records() of all record files under a folder."""
    return symbol_records(_texts(spark, path, files).withColumnRenamed("path", "record"))


def write_links(links: DataFrame, path: str) -> None:
    """The link table as Parquet, a folder for each layer."""
    links.write.mode("error").partitionBy("layer").parquet(path)
