"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

Texts are compared with A-Z in lower case, by shingles of SHINGLE words (an item of fewer words is one shingle). For every
length that items have, windows of so many words are looked at whose shingles are, for the most part, shingles of items of
that length: a table of bits of fixed size tells which may be, and a window without SIMILAR of them can't be similar to
any item. The fingerprints (majority of each bit of the shingles' hashes) of windows and items are cut into RADIUS // 2 + 1
blocks; fingerprints within RADIUS bits have a block that differs by one bit at most, so an equality join of the
windows' blocks with the items' blocks and their one-bit neighbours finds all of them. Candidates are verified: the sum
over shingles of the smaller count, divided by that of the larger count (each shingle weighs as often as it occurs), must
reach SIMILAR. Texts of the similarity 0.8 differ by 10 of 64 bits on average; RADIUS leaves room for more than twice that.

Defined results: a null text counts as empty; items without words match nothing; a null doc_id is kept; rows that share doc_id
and text come out once, different texts of one doc_id each; copies of an item all match; of windows of equal similarity the
first counts; very long texts are looked at whole; an empty table on either side gives no rows; clean_documents() keeps extra
columns of any name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tautline.functions.durable import durable
from tautline.llm.keys import MOST, carried, column, few, keyed, turned
from tautline.llm.words import WORD_A, WordHash, Words, blocks, mix, window_hashes

SHINGLE, SIMILAR, RADIUS = 5, 0.8, 21
#: Bits of the table of item shingles.
TABLE = 1 << 22


def lower(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower()


def majority(hashes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """SimHash of the n hashes from each start on."""
    if n == 1:
        return hashes[starts].view(np.int64)
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.vstack([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
    return np.packbits(2 * (sums[starts + n] - sums[starts]) > n, axis=1, bitorder="little").view("<i8").ravel()


def slots(hashes: np.ndarray, length: int) -> np.ndarray:
    """Places in the table of shingles of items of this length (0: of any length)."""
    return (mix(hashes + np.uint64(length)) % np.uint64(TABLE)).astype(np.int64)


def item_rows(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, words (joined by one blank), n (their number), fp, slots (of the shingles) of items with words."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = WordHash(WORD_A)
        for x in batches:
            rows = []
            for i, t in zip(x["item_id"], x["text"], strict=True):
                w = Words([lower(t)])
                n = len(w)
                if n:
                    h = window_hashes(a.of(w), min(n, SHINGLE))
                    own = [slots(h, n), slots(h, 0)] if n >= SHINGLE else [slots(h, n)]
                    rows.append((i, b" ".join(w.data.split()).decode("utf-8", "surrogatepass"), n, int(majority(h, np.zeros(1, np.int64), len(h))[0]), np.unique(np.concatenate(own)).tolist()))
            yield pd.DataFrame(rows, columns=["item_id", "words", "n", "fp", "slots"])

    rows = items.select(column(key).cast("long").alias("item_id"), F.coalesce(column(text), F.lit("")).alias("text"))
    return rows.mapInPandas(of, "item_id long, words string, n int, fp long, slots array<long>")


def _dense(hit: np.ndarray, m: int, least: int) -> np.ndarray:
    """Starts of runs of m places that hold `least` or more of the places hit (sorted)."""
    if len(hit) < least:
        return hit[:0]
    first = hit[: len(hit) - least + 1]
    first = first[hit[least - 1 :] - first < m]
    starts = np.unique((first[:, None] - np.arange(m - least + 1)[None, :]).ravel())
    starts = starts[starts >= 0]
    return starts[np.searchsorted(hit, starts + m) - np.searchsorted(hit, starts) >= least]


def windows(docs: DataFrame, lengths: list[int], table: np.ndarray) -> DataFrame:
    """key, turn, start, n, fp and words of the windows that may be similar to an item. docs: key, turn, text."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((lengths, np.packbits(table)))  # fixed size, and one length for each that items have

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = WordHash(WORD_A)
        sizes, packed = shared.value
        table = np.unpackbits(packed).astype(bool)
        for x in batches:
            texts, keys, turns, rows = [lower(t) for t in x["text"]], x["key"].tolist(), x["turn"].tolist(), []
            for part in blocks([len(t) for t in texts]):
                w = Words(texts[part])
                hashed = a.of(w)
                by_size = {}
                for k in {min(n, SHINGLE) for n in sizes}:
                    h = window_hashes(hashed, k)
                    inside = w.text[: len(h)] == w.text[k - 1 : k - 1 + len(h)]
                    by_size[k] = h, np.flatnonzero(inside & table[slots(h, 0)] if k == SHINGLE else inside)
                for n in sizes:
                    h, some = by_size[min(n, SHINGLE)]
                    m = n - min(n, SHINGLE) + 1
                    starts = _dense(some[table[slots(h[some], n)]], m, int(np.ceil(SIMILAR * m - 1e-9)))
                    starts = starts[starts + n <= len(w)]
                    starts = starts[w.text[starts] == w.text[starts + n - 1]]
                    for s in starts.tolist():
                        doc, fp = int(w.text[s]), int(majority(h[s : s + m], np.zeros(1, np.int64), m)[0])
                        rows.append((keys[part.start + doc], turns[part.start + doc], int(s - w.bounds[doc]), n, fp, b" ".join(w.data[w.starts[s] : w.ends[s + n - 1]].split()).decode("utf-8", "surrogatepass")))
            yield pd.DataFrame(rows, columns=["key", "turn", "start", "n", "fp", "words"])

    return docs.select("key", "turn", "text").mapInPandas(of, "key long, turn long, start int, n int, fp long, words string")


def _blocks(radius: int) -> list[tuple[int, int]]:
    n = radius // 2 + 1
    edges = [64 * i // n for i in range(n + 1)]
    return list(zip(edges, edges[1:], strict=False))


def _value(low: int, high: int) -> Column:
    return F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << (high - low)) - 1).cast("long"))


def hamming_pairs(found: DataFrame, items: DataFrame, radius: int = RADIUS) -> DataFrame:
    """key, turn, start, n, item_id of windows and items of one length whose fingerprints differ by `radius` bits at most."""
    cuts = _blocks(radius)
    own = F.array(*[F.struct(F.lit(k).alias("block"), _value(*cut).alias("value")) for k, cut in enumerate(cuts)])
    near = F.array(*[
        F.struct(F.lit(k).alias("block"), _value(low, high).bitwiseXOR(F.lit(flip).cast("long")).alias("value"))
        for k, (low, high) in enumerate(cuts) for flip in (0, *(1 << i for i in range(high - low)))
    ])
    index = items.select("item_id", "n", F.col("fp").alias("item_fp"), F.explode(near).alias("b")).select("item_id", "n", "item_fp", "b.*")
    probes = found.select("key", "turn", "start", "n", "fp", F.explode(own).alias("b")).select("key", "turn", "start", "n", "fp", "b.*")
    small = items.count() * (64 + len(cuts)) <= MOST
    met = probes.join(F.broadcast(index) if small else index, ["n", "block", "value"])
    return met.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius).select("key", "turn", "start", "n", "item_id").distinct()


def similarity(x: str, y: str) -> float:
    a, b = x.split(" "), y.split(" ")
    size = min(SHINGLE, len(a), len(b))
    p, q = (Counter(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) for w in (a, b))
    most = sum((p | q).values())
    return sum((p & q).values()) / most if most else 0.0


def _contaminated(rows: DataFrame, items: DataFrame) -> DataFrame:
    """rows: key, turn (which name a row), text. key, turn, item_id, start, n_words, similarity: the best window of each row and item that are similar."""
    known = durable(item_rows(items), "items")
    lengths = sorted(r.n for r in known.select("n").distinct().collect())  # as many as the longest item has words at most
    table = np.zeros(TABLE, bool)
    for batch in known.select(F.explode("slots").alias("s")).distinct().toArrow().to_batches():  # TABLE rows at most
        table[batch["s"].to_numpy()] = True
    found = durable(windows(rows, lengths, table), "windows")
    at = ["key", "turn", "start", "n"]
    both = hamming_pairs(found, known).join(found.select(*at, "words"), at).join(known.select("item_id", F.col("words").alias("item")).distinct(), "item_id")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            s = np.array([similarity(a, b) for a, b in zip(x["words"], x["item"], strict=True)])
            yield x[["key", "turn", "item_id", "start", "n"]].assign(similarity=s)[s >= SIMILAR - 1e-12]

    sure = both.mapInPandas(verify, "key long, turn long, item_id long, start int, n int, similarity double")
    best = sure.groupBy("key", "turn", "item_id").agg(F.max_by(F.struct("start", "n", "similarity"), F.struct("similarity", -F.col("start"))).alias("b"))
    return best.select("key", "turn", "item_id", F.col("b.start").cast("long").alias("start"), F.col("b.n").cast("long").alias("n_words"), "b.similarity")


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, item_id, start, n_words, similarity: the best window of each document and item that are similar."""
    _, once = turned(keyed(docs, key, text))
    unnamed = F.when(F.col("key") >= -(1 << 62), F.col("key"))
    return _contaminated(once, items).select(unnamed.alias("doc_id"), "item_id", "start", "n_words", "similarity")


def clean_documents(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the documents that hold an item."""
    rows, once = turned(carried(docs, key, text))
    bad = durable(_contaminated(once, items).select("key", "turn").distinct(), "contaminated")
    return rows.join(few(bad), ["key", "turn"], "left_anti").select("row.*")


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    out = contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "item_id", "start", "n_words", F.round("similarity", 6).alias("similarity"))


QUERIES = {"op3_decontaminate": op3_decontaminate}
