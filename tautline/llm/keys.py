"""Keys of documents, and rows that carry a document of any columns along."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tautline.functions.durable import durable

#: Rows of a side that is broadcast at most; beyond it joins are shuffled.
MOST = 1_000_000


def document_key(key: Column, text: Column) -> Column:
    """doc_id; where it is null a number below all doc_ids that follows from the text."""
    unnamed = F.lit(-(1 << 63)) + F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(F.lit((1 << 61) - 1))
    return F.coalesce(key.cast("long"), unnamed)


def column(name: str) -> Column:
    return F.col(f"`{name}`")


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, key, text (null: empty)."""
    return docs.select(column(key).cast("long").alias("doc_id"), document_key(column(key), column(text)).alias("key"), F.coalesce(column(text), F.lit("")).alias("text"))


def carried(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """row (a struct of all columns of docs, whatever their names), doc_id, key, text (null: empty)."""
    return docs.select(F.struct(*[column(c) for c in docs.columns]).alias("row"), column(key).cast("long").alias("doc_id"), document_key(column(key), column(text)).alias("key"), F.coalesce(column(text), F.lit("")).alias("text"))


def few(df: DataFrame, most: int = MOST) -> DataFrame:
    """df as a side to broadcast if it has `most` rows at most (it is counted), else as it is."""
    return F.broadcast(df) if df.count() <= most else df


def turned(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows with `turn`: 0, or where several rows share a key the hash of the text, so that (key, turn) names a text; and the
    same with one row for each (key, turn)."""
    h = F.xxhash64("text")
    shared = durable(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "shared-keys")
    if shared.isEmpty():
        out = rows.withColumn("turn", F.lit(0).cast("long"))
        return out, out
    out = rows.join(few(shared.withColumn("several", F.lit(True))), "key", "left").withColumn("turn", F.when(F.col("several"), h).otherwise(F.lit(0).cast("long")))
    once = out.filter("several is null").unionByName(out.filter("several").dropDuplicates(["key", "turn"]))
    return out.drop("several"), once.drop("several")
