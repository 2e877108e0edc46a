"""The corpus pipeline: stages over `documents`, each written as Parquet and read again as the next one's input.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
documents. BPE can't be expressed in SQL, so the pipeline has none; tests hold it against a plain version.

Defined results: documents with a null or empty text fail the quality rules and go; a null doc_id stays and stands before all
others wherever order decides; rows that share doc_id and text come out of the near-duplicate stage once, different texts of one
doc_id follow each other in the order of their hash; a document that loses all its lines stays with an empty text, and of several
such documents the first stays; very long texts are judged, compared and encoded whole; an empty `documents` gives no rows, an
empty `benchmark` removes nothing; extra columns of any name pass every stage but the last, which returns its own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tautline.functions.durable import durable
from tautline.llm import bpe, decontaminate, lines, quality, simhash


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line is similar to go; n_chars follows, documents stay."""
    return lines.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked as near copies (shingles of five words, similarity 0.8) the one with the smallest doc_id stays."""
    return simhash.first_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and the text they decode to."""
    return bpe.encode_decode(docs, bpe.word_bpe_path())


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near-duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = durable(docs, name.replace(" ", "-"))
    return docs
