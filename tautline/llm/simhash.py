"""SimHash near-dedup with deletion-variant signatures.

A text's fingerprint has a bit for each of 64: 1 if it is set in over half the XXH64 hashes of the text's word shingles.
To find all pairs within `radius` bits, the 64 bits are cut into radius // 2 + 1 segments, so that at least one of
them differs by one bit at most. Each distinct fingerprint is indexed under 64 keys: every segment with every one
of its bits left out. Two fingerprints with such a segment meet under a key by an equality join, where the distance
is verified; of the several keys that a pair may share only the first counts, so that a pair comes out once.
Copies fold into their fingerprint before the join, and chains of links into components after it.

Defined results: a null text counts as empty; an empty text has fingerprint zero, linked like any other; a null doc_id
is kept, and a component in which all doc_ids are null has a null component_id; repeated rows come out as often as
they went in; a bit that is set in just half of the hashes is 0; very long texts are hashed whole, block by block; an empty
table gives no rows; near_duplicates() reads no extra columns, first_of_each() keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tautline.functions.durable import durable
from tautline.llm.components import connected_components
from tautline.llm.keys import carried, column, few, turned

#: Shingles whose bits are unpacked at once.
BLOCK = 1 << 16

def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of the text with A-Z in lower case; fewer words: of all of them; none: empty."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    k = min(size, len(words)) - 1
    hashed = xxhash.xxh64_intdigest
    return np.fromiter((hashed(joined[a:b], 42) for a, b in zip(starts, ends[k:].tolist(), strict=False)), np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The majority of each bit, as a signed 64-bit number."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), BLOCK):
        counts += np.unpackbits(hashes[k : k + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, size: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield pd.DataFrame({"doc_id": x["doc_id"], "fp": [fingerprint(shingle_hashes(t, size)) for t in x["text"]]})

    rows = docs.select(column(key).cast("long").alias("doc_id"), F.coalesce(column(text), F.lit("")).alias("text"))
    return rows.mapInPandas(of, "doc_id long, fp long")


def _segments(radius: int) -> list[tuple[int, int]]:
    n = radius // 2 + 1
    edges = [64 * k // n for k in range(n + 1)]
    return list(zip(edges, edges[1:], strict=False))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _mask(low: int, high: int) -> int:
    return (1 << high) - (1 << low)


def fingerprint_links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """fps: distinct fingerprints (fp). The pairs a, b of them that differ by 1 to `radius` bits, each once."""
    segments = _segments(radius)
    masks = [_signed(_mask(low, high) & ~(1 << p)) for low, high in segments for p in range(low, high)]
    keys = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("p"))
    keys = keys.select("p", F.col("fp").bitwiseAND(F.element_at(F.array(*[F.lit(m).cast("long") for m in masks]), F.col("p") + 1)).alias("v"), "fp")
    x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))

    def first_key(rest: list[tuple[int, int]]) -> Column:
        """Whether this key is that of the first segment which differs by one bit at most (equal: the key of its first bit)."""
        if not rest:
            return F.lit(False)
        (low, high), *more = rest
        part = x.bitwiseAND(F.lit(_signed(_mask(low, high))).cast("long"))
        return F.when(part == 0, F.col("a.p") == low).when(F.bit_count(part) == 1, part.bitwiseAND(F.element_at(F.array(*[F.lit(_signed(1 << p)).cast("long") for p in range(64)]), F.col("a.p") + 1)) != 0).otherwise(first_key(more))

    same = (F.col("a.p") == F.col("b.p")) & (F.col("a.v") == F.col("b.v"))
    near = (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(x) <= radius)
    return keys.alias("a").join(keys.alias("b"), same & near & first_key(segments)).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id of its component), n_links (other fingerprints that link to its own)."""
    rows = durable(fingerprints(docs, size, key, text), "fingerprints")
    reps = rows.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    links = durable(fingerprint_links(reps.select("fp"), radius), "links")
    degree = links.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    comps = connected_components(links).withColumnRenamed("node", "fp")
    nodes = reps.join(comps, "fp", "left").join(degree, "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    nodes = durable(nodes, "nodes")
    ids = nodes.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_fp = nodes.join(ids, "component").select("fp", "component_id", "n_links")
    return rows.join(of_fp, "fp").select("doc_id", "fp", "component_id", "n_links")


def first_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each component of near copies (similar.py, which takes its first links from fingerprint_links()
    with shingles of five words): the first by doc_id. Rows that repeat a doc_id and text go as well; extra columns of any name stay."""
    from tautline.llm.similar import later_copies

    _, once = turned(carried(docs, key, text))
    later = durable(later_copies(once), "later-copies")
    return once.join(few(later), ["key", "turn"], "left_anti").select("row.*")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_links")


QUERIES = {"op4_simhash": op4_simhash}
