"""Substring dedup by level-wise doubling.

A word is removed if a window of WINDOW = 4 * BASE words covers it whose words also start earlier: in a document of smaller
doc_id, or earlier in the same one. Windows repeated at one length alone are extended to twice that length:

- BASE words: of the BASE-word windows inside each WINDOW-word window the one with the least hash is its anchor (the
  same wherever the window stands). Anchors whose words are no other anchor's fall away.
- 2 * BASE words: an anchor's extensions to the right and to the left survive if another place has the same.
- 4 * BASE words: a window survives if all extensions inside it did. Neighbouring windows of one anchor form a run; a
  run whose windows all stand earlier is removed in one piece, other runs are compared window by window with
  the first places of runs of the same anchor.

No window outlives the last length, which is the one asked for. Copies of a whole text fold into the first one
beforehand. A window is identified by two independent 64-bit hashes (the anchor's and its own) and its offset.
Counts are summed up before rows are dealt by hash, and joins have a unique side, so that Spark can split a hot hash.

Defined results: a null text counts as empty; a text with fewer words than WINDOW loses none; rows that share
doc_id and text are one document repeated and come out alike; different texts that share a doc_id follow each other in the order
of their hash; rows without doc_id stand before all others, in the order of a hash of their text; very long texts are cut
up whole; of equal windows the first stays; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tautline.functions.durable import durable
from tautline.llm.keys import few, keyed, turned
from tautline.llm.words import WORD_A, WORD_B, WordHash, Words, blocks, doubled, window_hashes

BASE = 5
WINDOW = 4 * BASE
#: What names a text, and what names a place of a word: earlier ones are less in this order.
TEXT = ("key", "turn")
PLACE = (*TEXT, "start")


class Anchors:
    """The windows of some texts and their anchors."""

    def __init__(self, texts: list[bytes], a: WordHash, b: WordHash):
        self.words = w = Words(texts)
        n = max(0, len(w) - WINDOW + 1)
        hashed = a.of(w)
        self.base = window_hashes(hashed, BASE)
        self.double = doubled(self.base, BASE)
        least = self.base & ~np.uint64(0xFFFFF) | (np.arange(len(self.base), dtype=np.uint64) & np.uint64(0xFFFFF))
        reach = 1
        while reach < WINDOW - BASE + 1:  # least of 1, 2, 4 ... neighbours
            step = min(reach, WINDOW - BASE + 1 - reach)
            least, reach = np.minimum(least[: len(least) - step], least[step:]), reach + step
        starts = np.arange(n)
        low = (least[:n] & np.uint64(0xFFFFF)).astype(np.int64)
        self.anchor = starts + (low - starts) % (1 << 20)
        self.valid = w.text[:n] == w.text[WINDOW - 1 : WINDOW - 1 + n]
        self.full = doubled(doubled(window_hashes(b.of(w), BASE), BASE), 2 * BASE)


def copies(rows: DataFrame) -> DataFrame:
    """key and turn of each text which an earlier document has as well."""
    digests = durable(rows.select(*TEXT, F.xxhash64("text").alias("d1"), F.md5("text").alias("d2")), "digests")
    first = digests.groupBy("d1", "d2").agg(F.min(F.struct(*TEXT)).alias("first"))
    return durable(digests.join(first, ["d1", "d2"]).filter(F.struct(*TEXT) > F.col("first")).select(*TEXT), "copies")


def find_anchors(rows: DataFrame) -> DataFrame:
    """key, turn, at (word of the text), base (hash), right and left (hashes of the extensions)."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = WordHash(WORD_A), WordHash(WORD_B)
        for x in batches:
            texts, keys = [t.encode("utf-8", "surrogatepass") for t in x["text"]], x["key"].to_numpy()
            turns = x["turn"].to_numpy()
            for part in blocks([len(t) for t in texts]):
                c = Anchors(texts[part], a, b)
                m = np.unique(c.anchor[c.valid])
                pad = np.append(c.double, np.zeros(BASE + 1, np.uint64))
                doc = c.words.text[m]
                yield pd.DataFrame({
                    "key": keys[part][doc], "turn": turns[part][doc], "at": (m - c.words.bounds[doc]).astype(np.int32), "base": c.base[m].view(np.int64),
                    "right": (pad[np.minimum(m, len(c.double))] >> np.uint64(32)).astype(np.int64), "left": (pad[np.maximum(m - BASE, 0)] >> np.uint64(32)).astype(np.int64),
                })

    return rows.select(*TEXT, "text").mapInPandas(of, "key long, turn long, at int, base long, right long, left long")


def repeated_extensions(anchors: DataFrame) -> DataFrame:
    """key, turn and the sorted list `hits` of 2 * at + side for extensions (side 0: right, 1: left) that another place has too."""
    twice = anchors.groupBy("base").agg(F.count("*").alias("n")).filter("n > 1").select("base")
    live = durable(anchors.join(twice, "base"), "live")
    sides = live.select("base", *TEXT, "at", F.posexplode(F.array("right", "left")).alias("side", "h"))
    again = sides.groupBy("base", "side", "h").agg(F.count("*").alias("n")).filter("n > 1").select("base", "side", "h")
    return sides.join(again, ["base", "side", "h"]).groupBy(*TEXT).agg(F.array_sort(F.collect_set(2 * F.col("at") + F.col("side"))).alias("hits"))


def candidate_runs(rows: DataFrame, hits: DataFrame, copied: DataFrame) -> DataFrame:
    """doc_id, key, turn, n_words, digest (of all words), copy, packed (the words, where there are runs), runs."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = WordHash(WORD_A), WordHash(WORD_B)
        pack = zstandard.ZstdCompressor(level=1).compress
        factors = np.cumprod(np.full(WINDOW, 0xD1342543DE82EF95, np.uint64))
        for x in batches:
            texts = [t.encode("utf-8", "surrogatepass") for t in x["text"]]
            hit_lists, is_copy = x["hits"].tolist(), x["copy"].tolist()
            for part in blocks([len(t) for t in texts]):
                own, rows = texts[part], []
                runs: list[list[dict]] = [[] for _ in own]
                some = [k for k, h in enumerate(hit_lists[part]) if h is not None and not is_copy[part.start + k]]
                if some:
                    c = Anchors([own[k] for k in some], a, b)
                    ok = np.zeros((len(c.words) + 1, 2), bool)
                    for k, doc in enumerate(some):
                        h = np.asarray(hit_lists[part.start + doc])
                        ok[c.words.bounds[k] + h // 2, h % 2] = True
                    offset = c.anchor - np.arange(len(c.anchor))
                    good = c.valid & ((offset > 2 * BASE) | ok[c.anchor, 0]) & ((offset < BASE) | ok[c.anchor, 1])
                    s = np.flatnonzero(good)
                    if len(s):
                        begin = np.flatnonzero(np.append(True, (np.diff(s) != 1) | (np.diff(c.anchor[s]) != 0)))
                        size = np.diff(np.append(begin, len(s)))
                        place = np.arange(len(s)) - np.repeat(begin, size)
                        whole = np.add.reduceat(c.full[s] * factors[place], begin)
                        full = c.full[s].view(np.int64)
                        for i, n, h in zip(begin.tolist(), size.tolist(), whole.view(np.int64).tolist(), strict=True):
                            at = s[i]
                            doc = c.words.text[at]
                            runs[some[doc]].append({"start": int(at - c.words.bounds[doc]), "n": n, "offset": int(offset[at]), "base": int(c.base[c.anchor[at]].view(np.int64)), "whole": h, "windows": full[i : i + n]})
                for k, t in enumerate(own):
                    words = t.split()
                    joined = b" ".join(words)
                    rows.append((len(words), hashlib.sha256(joined).hexdigest(), pack(joined) if runs[k] else None, runs[k]))
                yield pd.concat([x[["doc_id", "key", "turn", "copy"]].iloc[part], pd.DataFrame(rows, columns=["n_words", "digest", "packed", "runs"], index=x.index[part])], axis=1)

    run = "start int, n int, offset int, base long, whole long, windows array<long>".replace(" int", ":int").replace(" long", ":long").replace(" array", ":array")
    joined = rows.join(hits, list(TEXT), "left").join(copied.withColumn("copied", F.lit(True)), list(TEXT), "left")
    out = joined.select("doc_id", *TEXT, "text", "hits", F.coalesce("copied", F.lit(False)).alias("copy"))
    return out.mapInPandas(of, f"doc_id long, key long, turn long, copy boolean, n_words long, digest string, packed binary, runs array<struct<{run}>>")


def repeated_windows(docs: DataFrame) -> DataFrame:
    """key, turn and the list `gone` of (start, n): n neighbouring windows from there on start earlier elsewhere."""
    runs = docs.filter(F.size("runs") > 0).select(*TEXT, F.explode("runs").alias("r")).select(*TEXT, "r.*")
    place = F.struct(*PLACE)
    first = runs.groupBy("base", "offset", "whole", "n").agg(F.min(place).alias("first"))
    several = first.groupBy("base").agg(F.count("*").alias("n")).filter("n > 1").select("base")
    placed = runs.join(first, ["base", "offset", "whole", "n"])
    in_one = placed.filter(place > F.col("first")).select(*PLACE, "n")
    each = placed.filter(place == F.col("first")).join(several, "base").select("base", *PLACE, "offset", F.posexplode("windows").alias("i", "h"))
    each = each.select("base", (F.col("offset") - F.col("i")).alias("o"), "h", *TEXT, (F.col("start") + F.col("i")).alias("start"))
    leader = each.groupBy("base", "o", "h").agg(F.min(place).alias("first"))
    one_by_one = each.join(leader, ["base", "o", "h"]).filter(place > F.col("first")).select(*PLACE, F.lit(1).alias("n"))
    return in_one.union(one_by_one).groupBy(*TEXT).agg(F.collect_set(F.struct("start", "n")).alias("gone"))


def remove_repeated(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the kept words; null where all words are kept), kept_sha256."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor().decompress
        for x in batches:
            rows = []
            for packed, gone in zip(x["packed"], x["gone"], strict=True):
                words = unpack(packed).split(b" ")
                cover = np.zeros(len(words) + 1, np.int64)
                for g in gone:
                    cover[g["start"]] += 1
                    cover[g["start"] + g["n"] + WINDOW - 1] -= 1
                keep = np.cumsum(cover[:-1]) == 0
                kept = b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])
                rows.append((int(len(words) - keep.sum()), kept.decode("utf-8", "surrogatepass"), hashlib.sha256(kept).hexdigest()))
            yield pd.concat([x[["doc_id", "n_words"]], pd.DataFrame(rows, columns=["n_removed", "kept", "kept_sha256"], index=x.index)], axis=1)

    out = "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string"
    cut = docs.filter("packed is not null").join(gone, list(TEXT)).select("doc_id", "n_words", "packed", "gone").mapInPandas(of, out)
    whole = F.col("copy") & (F.col("n_words") >= WINDOW)
    rest = docs.drop("packed", "runs").join(gone.select(*TEXT), list(TEXT), "left_anti").select(
        "doc_id", "n_words", F.when(whole, F.col("n_words")).otherwise(0).alias("n_removed"),
        F.when(whole, F.lit("")).alias("kept"), F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.col("digest")).alias("kept_sha256"),
    )
    return cut.unionByName(rest)


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    rows, once = turned(keyed(docs, key, text))
    copied = copies(once)
    distinct = once.join(few(copied), list(TEXT), "left_anti")
    hits = durable(repeated_extensions(durable(find_anchors(distinct), "anchors")), "extensions")
    runs = durable(candidate_runs(rows, hits, copied), "runs")
    return remove_repeated(runs, durable(repeated_windows(runs), "repeated"))


def op5_substring(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES = {"op5_substring": op5_substring}
